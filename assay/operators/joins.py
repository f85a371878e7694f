"""Joins between records, predictions, retries and judges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import refuse


def is_resolved(status: str = "execution_status", label: str = "label") -> Column:
    """A failed call is a state, not a wrong answer."""
    return (F.col(status) == "ok") & F.col(label).isNotNull()


def join_scored(records: DataFrame, preds: DataFrame, key: str = "record_id") -> DataFrame:
    """All predicted records with ``resolved`` and ``correct`` flags (0/1)."""
    joined = records.join(preds, key, "inner")
    resolved = F.coalesce(is_resolved(), F.lit(False))
    return joined.withColumn("resolved", resolved.cast("int")).withColumn(
        "correct", (resolved & (F.col("gold") == F.col("label"))).cast("int")
    )


def join_resolved(records: DataFrame, preds: DataFrame, key: str = "record_id") -> DataFrame:
    """JN1: records joined to their resolved predictions only."""
    return records.join(preds.filter(is_resolved()), key, "inner")


def with_slices(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Repeat every row once per reporting slice (plus ``overall``).

    The copies are expanded and pre-aggregated in the same stage, as GROUPING
    SETS would do, so they never reach the shuffle.
    """
    entries = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("slice_value"))]
    for name, value in dims.items():
        entries.append(
            F.struct(F.lit(name).alias("slice"), F.coalesce(value.cast("string"), F.lit("unknown")).alias("slice_value"))
        )
    return df.select("*", F.inline(F.array(*entries)))


def merge_runs(runs: Sequence[DataFrame], keys: Sequence[str] = ("judge_id", "record_id")) -> DataFrame:
    """JN2: the first ok row wins; without one, the last row stands.

    A min/max over structs combines on the map side, so a key repeated many
    times does not have to be sorted in one task.
    """
    tagged = reduce(
        lambda a, b: a.unionByName(b),
        [df.withColumn("_run", F.lit(i)) for i, df in enumerate(runs)],
    )
    value_columns = [c for c in runs[0].columns if c not in keys]
    whole = F.struct(*value_columns)
    ok = F.col("execution_status") == "ok"
    picked = tagged.groupBy(*keys).agg(
        F.min_by(whole, F.when(ok, F.col("_run"))).alias("_first_ok"),
        F.max_by(whole, F.col("_run")).alias("_last"),
    )
    row = F.coalesce("_first_ok", "_last")
    return picked.select(*keys, *[row[c].alias(c) for c in value_columns])


def merge_retry(
    base: DataFrame,
    retry: DataFrame,
    keys: Sequence[str] = ("judge_id", "record_id"),
    expected: DataFrame | None = None,
) -> DataFrame:
    """JN3: the retry row where there is one, else the base row; a key of ``expected`` in neither fails the job."""
    value_columns = [c for c in base.columns if c not in keys]
    b = base.select(*keys, F.struct(*value_columns).alias("_base"))
    r = retry.select(*keys, F.struct(*value_columns).alias("_retry"))
    row = F.coalesce("_retry", "_base")
    merged = b.join(r, list(keys), "full_outer")
    if expected is not None:
        merged = merged.join(expected.select(*keys).distinct(), list(keys), "full_outer")
        merged = refuse(merged, F.col("_base").isNull() & F.col("_retry").isNull(), "a key has no base and no retry row")
    return merged.select(
        *keys,
        F.when(F.col("_retry").isNotNull(), "retry").otherwise("base").alias("origin"),
        *[row[c].alias(c) for c in value_columns],
    )


def pending(records: DataFrame, preds: DataFrame, key: str = "record_id") -> DataFrame:
    """JN4: records without a prediction yet."""
    return records.join(preds.select(key), key, "left_anti")


def retry_candidates(preds: DataFrame, status: str, expected: int | None = None) -> DataFrame:
    """JN4: rows to call again, with an optional check of how many there should be."""
    rows = preds.filter(F.col("execution_status") == status)
    if expected is not None:
        total, distinct = rows.agg(
            F.count("*"), F.count_distinct("judge_id", "record_id")
        ).first()
        if total != expected or distinct != total:
            raise ValueError(f"expected {expected} distinct {status} rows, found {distinct} of {total}")
    return rows


def with_dimension(
    df: DataFrame, dim: DataFrame, key: str, value: str, default: str = "unknown"
) -> DataFrame:
    """JN10: look up one attribute, with a default when it is missing."""
    return df.join(dim.select(key, value), key, "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default))
    )


def judge_pairs(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """JN5: contingency table of every unordered judge pair.

    One row per (``by``, left, right, left outcome, right outcome) with the count
    of shared records. Records are first folded to their sorted outcomes (as many as
    judges saw the record), equal patterns are counted, and only the counted patterns are
    expanded to pairs, so no record is ever emitted once per pair.
    """
    outcome = F.struct(
        F.col("label").alias("label"),
        F.col("resolved").alias("resolved"),
        F.col("correct").alias("correct"),
    )
    patterns = (
        scored.groupBy(*by, "record_id", "judge_id")
        .agg(F.max(outcome).alias("o"))
        .groupBy(*by, "record_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("judge_id").alias("j"), "o"))).alias("_seen"))
        .groupBy(*by, "_seen")
        .agg(F.count("*").alias("_n"))
    )

    def with_later(x, i):
        return F.transform(
            F.slice("_seen", i + 2, F.size("_seen")),
            lambda y: F.struct(
                x["j"].alias("left"), y["j"].alias("right"), x["o"].alias("left_outcome"), y["o"].alias("right_outcome")
            ),
        )

    return (
        patterns.select(*by, "_n", F.inline(F.flatten(F.transform("_seen", with_later))))
        .groupBy(*by, "left", "right", "left_outcome", "right_outcome")
        .agg(F.sum("_n").alias("n"))
    )
