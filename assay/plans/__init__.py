"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from assay.plans.registry import ENTRIES, Entry

MODULES = (
    "metrics",
    "ranking",
    "calibration",
    "rules",
    "splits",
    "scalar",
    "records",
    "retrieval",
    "routing",
    "ledger",
    "stream",
    "learned",
    "files",
)


def load_entries() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"assay.plans.{module}")
    return ENTRIES
