"""Judge analytics as DataFrame operators."""
