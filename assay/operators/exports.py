"""Long-form tables behind charts and viewers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def observations(summary: DataFrame, entity: str = "judge_id") -> DataFrame:
    """EXP1: one row per (entity, slice, metric) with its interval and base count."""

    def cell(metric: str, value: str, low: str, high: str, n: str) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.col(value).alias("value"),
            F.col(low).alias("ci_low"),
            F.col(high).alias("ci_high"),
            F.col(n).alias("n"),
        )

    cells = F.array(
        cell("all_record_accuracy", "all_record_accuracy", "all_record_low", "all_record_high", "records"),
        cell("conditional_accuracy", "conditional_accuracy", "conditional_low", "conditional_high", "resolved"),
        cell("coverage", "coverage", "coverage_low", "coverage_high", "records"),
    )
    return summary.select(F.col(entity).alias("entity"), "slice", "slice_value", F.inline(cells))


def pair_table(tests: DataFrame, records: int | Column) -> DataFrame:
    """EXP2: two rows per judge pair, over all and over shared records."""
    n = records if isinstance(records, Column) else F.lit(records).cast("bigint")

    def view(name: str, count: Column) -> Column:
        return F.struct(
            F.lit(name).alias("view"),
            count.alias("n"),
            F.col(f"{name}_left_only").alias("left_only_correct"),
            F.col(f"{name}_right_only").alias("right_only_correct"),
            F.col(f"{name}_p").alias("p_exact"),
            F.col(f"{name}_p_holm").alias("p_holm"),
        )

    return tests.select("left", "right", F.inline(F.array(view("all", n), view("shared", F.col("shared_resolved")))))


def decomposition(summary: DataFrame, ranks: DataFrame | None = None, baseline: float | Column | None = None) -> DataFrame:
    """EXP3: right, wrong and skipped shares per judge, with leader and baseline flags."""
    right = F.col("all_record_accuracy")
    out = summary.select(
        "judge_id",
        right.alias("right"),
        (F.col("coverage") - right).alias("wrong"),
        (1 - F.col("coverage")).alias("skipped"),
        F.col("coverage").alias("answered"),
        F.col("conditional_accuracy").alias("answered_accuracy"),
    )
    if ranks is not None:
        out = out.join(ranks.select("judge_id", (F.col("shared_rank") == 1).alias("tied_with_leader")), "judge_id", "left")
    if baseline is not None:
        floor = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
        out = out.withColumn("below_baseline", F.col("right") < floor)
    return out


def item_table(records: DataFrame, preds: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """EXP4: every record with its prediction; a missing prediction fails the job."""
    found = preds.select(
        "record_id",
        F.lit(True).alias("_found"),
        F.col("label").alias("prediction"),
        F.col("execution_status").alias("status"),
        "probabilities",
        "latency_ms",
    )
    rows = records.join(found, "record_id", "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for "), "record_id")).cast("string")
    resolved = (F.col("status") == "ok") & F.col("prediction").isNotNull()
    return rows.select(
        F.when(F.col("_found").isNull(), missing).otherwise(F.col("record_id")).alias("record_id"),
        "gold",
        "prediction",
        F.coalesce(resolved & (F.col("prediction") == F.col("gold")), F.lit(False)).alias("correct"),
        "status",
        F.array_max(F.map_values("probabilities")).alias("confidence"),
        "probabilities",
        "latency_ms",
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
