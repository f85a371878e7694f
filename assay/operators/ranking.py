"""Selective risk, thresholds, judge ranks and top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions.stats import mcnemar_exact, wilson
from assay.operators.metrics import attach, disagreement, ratio
from assay.operators.running import running_totals
from assay.vocab import TARGET_ERRORS


def _targets(targets: Sequence[float]):
    for t in targets:
        if not 0 <= t <= 1:
            raise ValueError("a target error must be in [0, 1]")
    return F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_error")


def ranked_by_confidence(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, confidence, ordinal, correct of rows with a confidence, their rank (confidence desc, ordinal asc), hits so far and group size."""
    rows = df.filter(F.col("confidence").isNotNull()).select(*by, "confidence", "ordinal", "correct")
    order = [F.col("confidence").desc(), F.col("ordinal").asc()]
    totals = {"rank": F.lit(1).cast("bigint"), "hits": F.col("correct").cast("bigint")}
    return running_totals(rows, by, order, totals, {"size": "rank"})


def risk_coverage(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """ORD1: selective-risk curve, including the zero point (0, 0, threshold 1)."""
    ranked = ranked_by_confidence(df, by)
    point = F.struct(
        F.col("rank"),
        ratio(F.col("rank"), F.col("size")).alias("coverage"),
        (1 - ratio(F.col("hits"), F.col("rank"))).alias("risk"),
        F.col("confidence").alias("threshold"),
    )
    zero = F.struct(
        F.lit(0).cast("bigint").alias("rank"),
        F.lit(0.0).alias("coverage"),
        F.lit(0.0).alias("risk"),
        F.lit(1.0).alias("threshold"),
    )
    return ranked.select(*by, F.inline(F.array_compact(F.array(point, F.when(F.col("rank") == 1, zero)))))


def coverage_at(df: DataFrame, by: Sequence[str], targets: Sequence[float] = TARGET_ERRORS) -> DataFrame:
    """ORD2: largest coverage whose risk is within each target; zero when none is."""
    ranked = ranked_by_confidence(df, by)
    risk = 1 - ratio(F.col("hits"), F.col("rank"))
    rows = ranked.select(*by, "rank", "size", risk.alias("risk"), _targets(targets))
    deepest = F.max(F.when(F.col("risk") <= F.col("target_error"), F.col("rank")).otherwise(0))
    return rows.groupBy(*by, "target_error").agg(ratio(deepest, F.max("size")).alias("coverage"))


def target_coverage(df: DataFrame, by: Sequence[str], targets: Sequence[float] = TARGET_ERRORS) -> DataFrame:
    """ORD3: deepest rank within each target, with a Wilson interval and a support flag."""
    ranked = ranked_by_confidence(df, by)
    errors = F.col("rank") - F.col("hits")
    rows = ranked.select(
        *by, "rank", "size", "confidence", errors.alias("errors"), ratio(errors, F.col("rank")).alias("risk"), _targets(targets)
    )
    point = F.struct(
        F.col("rank").alias("accepted"), "errors", "risk", F.col("confidence").alias("threshold")
    )
    inside = F.col("risk") <= F.col("target_error")
    best = rows.groupBy(*by, "target_error").agg(
        F.max_by(point, F.when(inside, F.col("rank"))).alias("_p"), F.max("size").alias("size")
    )
    zero = F.lit(0).cast("bigint")
    out = best.select(
        *by,
        "target_error",
        F.coalesce("_p.accepted", zero).alias("accepted_count"),
        F.coalesce("_p.errors", zero).alias("error_count"),
        F.coalesce("_p.risk", F.lit(0.0)).alias("risk"),
        F.coalesce("_p.threshold", F.lit(1.0)).alias("threshold"),
        "size",
    )
    interval = wilson(F.col("error_count"), F.col("accepted_count"), "unit")
    supported = (F.col("accepted_count") > 0) & (interval["upper"] <= F.col("target_error"))
    return out.withColumns(
        {
            "coverage": ratio(F.col("accepted_count"), F.col("size")),
            "risk_low": interval["lower"],
            "risk_high": interval["upper"],
            "confidence_supported": supported,
            "claim_status": F.when(supported, "confidence-supported").otherwise("descriptive"),
        }
    ).drop("size")


def select_threshold(df: DataFrame, by: Sequence[str], targets: Sequence[float] = TARGET_ERRORS) -> DataFrame:
    """ORD4: the candidate threshold that accepts most rows at or below each target error.

    Candidates are the distinct confidences plus 0 and 1. Rows are counted per
    confidence first, which also keeps ties together.
    """
    rows = df.filter(F.col("confidence").isNotNull())
    zero = F.lit(0).cast("bigint")

    def candidate(threshold, n, e):
        return F.struct(threshold.alias("threshold"), n.alias("_n"), e.alias("_e"))

    cells = F.array(
        candidate(F.col("confidence"), F.lit(1).cast("bigint"), (1 - F.col("correct")).cast("bigint")),
        candidate(F.lit(0.0), zero, zero),
        candidate(F.lit(1.0), zero, zero),
    )
    candidates = rows.select(*by, F.inline(cells)).groupBy(*by, "threshold").agg(
        F.sum("_n").alias("_n"), F.sum("_e").alias("_e")
    )
    swept = running_totals(
        candidates, by, [F.col("threshold").desc()], {"accepted_count": F.col("_n"), "error_count": F.col("_e")}
    )
    size = swept.groupBy(*by).agg(F.max("accepted_count").alias("size"), F.count("*").alias("candidate_count"))
    risk = F.coalesce(ratio(F.col("error_count"), F.col("accepted_count")), F.lit(0.0))
    points = swept.withColumn("risk", risk).select(
        *by, "threshold", "accepted_count", "error_count", "risk", _targets(targets)
    )
    point = F.struct("accepted_count", "threshold", "error_count", "risk")
    best = points.groupBy(*by, "target_error").agg(
        F.max(F.when(F.col("risk") <= F.col("target_error"), point)).alias("_in"),
        F.max_by(point, F.col("threshold")).alias("_first"),
    )
    chosen = F.coalesce("_in", "_first")
    out = attach(best, size, by).select(
        *by, "target_error", chosen.alias("_c"), "candidate_count", "size"
    ).select(*by, "target_error", "_c.*", "candidate_count", "size")
    interval = wilson(F.col("error_count"), F.col("accepted_count"), "unit")
    return out.withColumns(
        {
            "coverage": ratio(F.col("accepted_count"), F.col("size")),
            "risk_low": interval["lower"],
            "risk_high": interval["upper"],
            "confidence_supported": interval["upper"] <= F.col("target_error"),
        }
    ).drop("size")


# --- judges ------------------------------------------------------------------


def discordance(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Discordant counts per judge pair, over shared-resolved and over all records."""
    left, right = F.col("left_outcome.correct") == 1, F.col("right_outcome.correct") == 1
    both = (F.col("left_outcome.resolved") == 1) & (F.col("right_outcome.resolved") == 1)

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return pairs.groupBy(*by, "left", "right").agg(
        total(both).alias("shared_resolved"),
        total(both & left & ~right).alias("shared_left_only"),
        total(both & ~left & right).alias("shared_right_only"),
        total(left & ~right).alias("all_left_only"),
        total(~left & right).alias("all_right_only"),
    )


def mcnemar(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """STA2: exact McNemar p-values of both views."""
    counts = discordance(pairs, by)
    return counts.withColumns(
        {
            "shared_p": mcnemar_exact(F.col("shared_left_only"), F.col("shared_right_only")),
            "all_p": mcnemar_exact(F.col("all_left_only"), F.col("all_right_only")),
        }
    )


def holm(df: DataFrame, by: Sequence[str], p: str, keys: Sequence[str], name: str) -> DataFrame:
    """ORD7: Holm-adjusted p-values within each family of tests.

    A family has one row per judge pair, so its size is bounded by the judges.
    """
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    order = group.orderBy(F.col(p).asc(), *keys)
    m = F.count("*").over(group)
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    out = df.withColumn("_step", step)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return out.withColumn(name, F.max("_step").over(so_far)).drop("_step")


def paired_tests(pairs: DataFrame) -> DataFrame:
    """McNemar tests of every judge pair with Holm correction per view."""
    tests = mcnemar(pairs)
    tests = holm(tests, [], "shared_p", ["left", "right"], "shared_p_holm")
    return holm(tests, [], "all_p", ["left", "right"], "all_p_holm")


def rank_judges(summary: DataFrame, baselines: Sequence[str] = ()) -> DataFrame:
    """ORD5: rank by conditional and by all-record accuracy, and the shift between them."""
    rows = summary.filter(~F.col("judge_id").isin(*baselines)) if baselines else summary
    one = W.partitionBy(F.lit(0))
    cond = one.orderBy(F.coalesce("conditional_accuracy", F.lit(0.0)).desc(), F.col("judge_id").asc())
    whole = one.orderBy(F.col("all_record_accuracy").desc(), F.col("judge_id").asc())
    return rows.select(
        "judge_id",
        "conditional_accuracy",
        "all_record_accuracy",
        F.row_number().over(cond).alias("conditional_rank"),
        F.row_number().over(whole).alias("all_record_rank"),
    ).withColumn("rank_shift", F.col("conditional_rank") - F.col("all_record_rank"))


def shared_ranks(ranked: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """ORD6: competition ranks; a judge shares its group leader's rank while the
    Holm-adjusted test cannot separate the two.

    The walk is sequential over judges, whose number is small, so it is one fold
    over an array of names.
    """
    order = ranked.agg(
        F.array_sort(F.collect_list(F.struct(F.col("all_record_rank").alias("pos"), F.col("judge_id").alias("j")))).alias("o")
    )
    both = tests.select(
        F.explode(
            F.array(
                F.struct(F.concat_ws("\u0000", "left", "right").alias("k"), F.col("all_p_holm").alias("p")),
                F.struct(F.concat_ws("\u0000", "right", "left").alias("k"), F.col("all_p_holm").alias("p")),
            )
        ).alias("e")
    )
    lookup = both.agg(F.map_from_entries(F.collect_list("e")).alias("m")).scalar()
    start = F.struct(
        F.lit(None).cast("string").alias("top"),
        F.lit(0).alias("rank"),
        F.array().cast("array<struct<judge_id:string,rank:int>>").alias("out"),
    )

    def step(acc, item):
        p = F.try_element_at(F.col("m"), F.concat_ws("\u0000", acc["top"], item["j"]))
        shares = acc["top"].isNotNull() & (p >= alpha)
        rank = F.when(shares, acc["rank"]).otherwise(item["pos"])
        return F.struct(
            F.when(shares, acc["top"]).otherwise(item["j"]).alias("top"),
            rank.alias("rank"),
            F.concat(acc["out"], F.array(F.struct(item["j"].alias("judge_id"), rank.alias("rank")))).alias("out"),
        )

    folded = order.withColumn("m", lookup).select(F.aggregate("o", start, step, lambda acc: acc["out"]).alias("r"))
    shared = folded.select(F.inline("r")).withColumnRenamed("rank", "shared_rank")
    return ranked.join(shared, "judge_id")


# --- selections --------------------------------------------------------------


def least_confident(df: DataFrame, n: int = 10) -> DataFrame:
    """TOP3: lowest confidence first (1.0 without a map), then record id."""
    conf = F.coalesce(F.array_max(F.map_values("probabilities")), F.lit(1.0))
    return df.withColumn("confidence", conf).orderBy("confidence", "record_id").limit(n)


def most_disputed(preds: DataFrame, local: DataFrame, n: int = 10) -> DataFrame:
    """TOP4: most disagreeing labels first, then record id."""
    return disagreement(preds, local).orderBy(F.desc("disagreement"), F.asc("record_id")).limit(n)


def select_arm(metrics: DataFrame) -> DataFrame:
    """TOP5: lowest dev NLL, then highest dev accuracy, then name; test rows play no part."""
    order = F.struct(F.col("nll"), -F.col("accuracy"), F.col("arm"))
    return metrics.filter(F.col("split") == "dev").agg(F.min_by("arm", order).alias("selected_arm"))
