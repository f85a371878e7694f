"""Fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label sets, statuses, splits and provenances of the data model.
SINGLE_LABELS = ("pass", "fail")
PAIRWISE_LABELS = ("A", "B", "TIE")
STATUSES = ("ok", "rate_limited", "provider_error", "parse_error", "skipped")
SPLITS = ("train", "dev", "calibration", "test")
PROVENANCES = (
    "deterministic_verifier",
    "answer_key",
    "executable_test",
    "human_adjudication",
    "weak_model_supervision",
)
SPLIT_POLICY = (("train", 0.50), ("dev", 0.20), ("calibration", 0.15), ("test", 0.15))
DEFAULT_SEED = 20260920
TARGET_ERRORS = (0.01, 0.02, 0.05, 0.10)
Z95 = 1.959963984540054
PROBABILITY_FLOOR = 1e-15


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def class_order(mode: Column) -> Column:
    """Legal labels of a judgment mode, in their declared order."""
    return F.when(mode == "single", lit_array(SINGLE_LABELS)).otherwise(lit_array(PAIRWISE_LABELS))
