"""Intervals and exact tests as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.vocab import Z95, lit_array


def wilson(successes: Column, trials: Column, empty: str = "null") -> Column:
    """STA1: Wilson 95% interval as ``struct(lower, upper)``.

    ``empty`` decides the interval of zero trials: ``null`` or ``unit`` ([0, 1]).
    """
    if empty not in ("null", "unit"):
        raise ValueError("empty must be 'null' or 'unit'")
    n = trials.cast("double")
    p = successes.cast("double") / F.nullif(n, F.lit(0.0))
    z2 = Z95 * Z95
    denom = 1 + z2 / F.nullif(n, F.lit(0.0))
    centre = (p + z2 / (2 * F.nullif(n, F.lit(0.0)))) / denom
    spread = F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + z2 / (4 * F.nullif(n * n, F.lit(0.0))))
    half = Z95 * spread / denom
    void = F.lit(None).cast("double")
    lower, upper = (void, void) if empty == "null" else (F.lit(0.0), F.lit(1.0))
    return F.struct(
        F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(lower).alias("lower"),
        F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(upper).alias("upper"),
    )


# Log-factorial minus its Stirling approximation, for 1..15.
_STIRLING_ERROR = [0.0] + [
    math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi))
    for n in range(1, 16)
]


def _stirling_error(n: Column) -> Column:
    small = F.element_at(lit_array(_STIRLING_ERROR), F.least(n, F.lit(15)).cast("int") + 1)
    x = n.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return F.when(n <= 15, small).otherwise(series)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """STA2: exact two-sided McNemar p-value from the discordant counts.

    The largest tail term comes from a saddle-point form, which stays accurate
    for billions of discordant pairs; the other terms follow by ratio and die
    out within a few multiples of sqrt(n), so the fold stays short.
    """
    n, k = b + c, F.least(b, c)
    nd, kd = n.cast("double"), k.cast("double")
    x = (nd - 2 * kd) / nd
    deviance = kd * F.log1p(-x) + (nd - kd) * F.log1p(x)
    log_top = (
        _stirling_error(n)
        - _stirling_error(k)
        - _stirling_error(n - k)
        - deviance
        + 0.5 * F.log(nd / (2 * math.pi * kd * (nd - kd)))
    )
    log_top = F.when(k == 0, -nd * math.log(2.0)).otherwise(log_top)
    steps = F.least(k, F.ceil(8 * F.sqrt(nd)) + 60).cast("int")
    tail = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * (kd - j) / (nd - kd + j + 1)).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(log_top) * tail))
