"""Confidence routing between a local judge and a provider, and policy reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.identity import hash_rank
from assay.functions.stats import wilson
from assay.operators.metrics import attach, classification_report, latency_summary, ratio, resource_usage
from assay.operators.ranking import target_coverage
from assay.operators.running import row_numbers
from assay.session import collect_bounded, cut_lineage
from assay.vocab import TARGET_ERRORS


def route_of(confidence: Column, threshold: Column | float) -> Column:
    """Local at or above the threshold, else escalate; an invalid confidence fails the job."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    bad = confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1)
    checked = F.when(bad, F.raise_error("confidence must be finite and in [0, 1]").cast("double")).otherwise(confidence)
    return F.when(checked >= t, "local").otherwise("escalate")


def route(df: DataFrame, threshold: float) -> DataFrame:
    """RTE1: one route per row; a calibrated confidence is used when there is one."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    p = F.sort_array(F.map_values("probabilities"), asc=False)
    raw = F.get(p, F.lit(0))
    calibrated = F.coalesce("calibrated_confidence", raw) if "calibrated_confidence" in df.columns else raw
    return df.select(
        "record_id",
        F.col("label").alias("student_label"),
        raw.alias("raw_confidence"),
        calibrated.alias("calibrated_confidence"),
        (raw - F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))).alias("margin"),
        F.lit(float(threshold)).alias("threshold"),
        route_of(calibrated, threshold).alias("route"),
    )


def outcome(route: Column, local: Column, external: Column) -> Column:
    """RTE2: final label and provider state of one route.

    ``local`` and ``external`` are prediction structs (null when missing). An
    escalated row never falls back to the local label.
    """
    away = route == "escalate"
    called = away & external.isNotNull()
    chosen = F.when(away, external).otherwise(local)
    return F.struct(
        F.when(chosen["execution_status"] == "ok", chosen["label"]).alias("final_label"),
        F.when(called, external["execution_status"]).otherwise("not_called").alias("provider_status"),
        F.when(called, external["judge_id"]).alias("provider_model"),
        F.when(away & external.isNull(), "provider_not_available").alias("provider_error"),
    )


PREDICTION_FIELDS = ("judge_id", "label", "probabilities", "execution_status", "latency_ms", "usage")


def as_struct(preds: DataFrame, name: str) -> DataFrame:
    """One prediction struct per record."""
    fields = [c for c in PREDICTION_FIELDS if c in preds.columns]
    return preds.select("record_id", F.struct(*fields).alias(name))


def resolve(routed: DataFrame, local: DataFrame, external: DataFrame) -> DataFrame:
    """RTE2: attach the outcome of every route."""
    rows = routed.join(as_struct(local, "_l"), "record_id", "left").join(as_struct(external, "_e"), "record_id", "left")
    return rows.select(*routed.columns, F.inline(F.array(outcome(F.col("route"), F.col("_l"), F.col("_e")))))


def route_all(records: DataFrame, external: DataFrame) -> DataFrame:
    """RTE3: the provider-only policy."""
    routed = records.select("record_id", F.lit("escalate").alias("route"))
    rows = routed.join(as_struct(external, "_e"), "record_id", "left")
    return rows.select("record_id", "route", F.inline(F.array(outcome(F.col("route"), F.col("_e"), F.col("_e")))))


def policy_sweep(
    final: DataFrame,
    student: DataFrame,
    external: DataFrame,
    thresholds: Mapping[str, Mapping[float, float]],
    seed: int,
) -> DataFrame:
    """RTE4: routed rows of every policy at every target error.

    ``final``: record_id, gold, mode, domain, ordinal. ``student``: predictions
    with ``raw_confidence``, ``calibrated_confidence``, ``calibrated_probabilities``.
    ``thresholds``: view (raw, calibrated) -> target -> threshold, chosen on the
    threshold partition only. Each record is joined once and expanded to the
    policies afterwards; the random control escalates as many records as the
    calibrated policy, in hash order.
    """
    base = final.join(
        student.select(
            "record_id",
            "raw_confidence",
            "calibrated_confidence",
            F.struct(*[c for c in PREDICTION_FIELDS if c in student.columns]).alias("_raw"),
            F.struct(
                *[
                    F.col("calibrated_probabilities").alias(c) if c == "probabilities" else F.col(c)
                    for c in PREDICTION_FIELDS
                    if c in student.columns
                ]
            ).alias("_cal"),
        ),
        "record_id",
    ).join(as_struct(external, "_e"), "record_id", "left")
    base = row_numbers(
        base.withColumn("_h", hash_rank(seed, "matched-control", F.col("record_id"))),
        [],
        [F.col("_h").asc(), F.col("record_id").asc()],
        "_pos",
    )
    targets = sorted(thresholds["calibrated"])
    away = base.agg(
        *[F.count_if(F.col("calibrated_confidence") < thresholds["calibrated"][t]).alias(f"t{i}") for i, t in enumerate(targets)]
    ).first()

    def policy(name: str, to: Column, local: Column, confidence: Column, t: float | None = None, cut: float | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("policy"),
            F.lit(t).cast("double").alias("target_error"),
            F.lit(cut).cast("double").alias("threshold"),
            to.alias("route"),
            local.alias("_l"),
            confidence.cast("double").alias("confidence"),
        )

    raw, cal, none = F.col("raw_confidence"), F.col("calibrated_confidence"), F.lit(None)
    cells = [
        policy("local_only", F.lit("local"), F.col("_raw"), raw),
        policy("provider_only", F.lit("escalate"), F.col("_raw"), none),
    ]
    for i, t in enumerate(targets):
        c, r = thresholds["calibrated"][t], thresholds["raw"][t]
        random = F.when(F.col("_pos") <= F.lit(int(away[f"t{i}"])), "escalate").otherwise("local")
        cells += [
            policy("calibrated_local_to_provider", route_of(cal, c), F.col("_cal"), cal, t, c),
            policy("raw_local_to_provider", route_of(raw, r), F.col("_raw"), raw, t, r),
            policy("random_matched_to_provider", random, F.col("_raw"), raw, t),
        ]
    rows = base.select("record_id", "gold", "mode", "domain", "ordinal", "_e", F.inline(F.array(*cells)))
    rows = rows.withColumns(
        {
            "_o": outcome(F.col("route"), F.col("_l"), F.col("_e")),
            "_s": F.when(F.col("route") == "local", F.col("_l")).otherwise(F.col("_e")),
        }
    )
    return rows.select(
        "policy",
        "target_error",
        "threshold",
        "record_id",
        "gold",
        "mode",
        "domain",
        "ordinal",
        "route",
        "confidence",
        "_o.*",
        (F.col("_l.label") == F.col("gold")).cast("int").alias("correct"),
        F.col("_s.probabilities").alias("probabilities"),
        F.col("_s.latency_ms").alias("latency_ms"),
        F.col("_s.usage").alias("usage"),
    )


def routing_summary(routed: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG32: coverage, escalation and risk of routed rows.

    Rows carry gold, route and final_label. In the local risk a missing label
    counts as an error; the final risk looks at resolved rows only.
    """
    final, gold = F.col("final_label"), F.col("gold")
    local = F.col("route") == "local"
    wrong_local = F.count_if(local & ~final.eqNullSafe(gold))
    wrong_final = F.count_if(final.isNotNull() & (final != gold))
    out = routed.groupBy(*by).agg(
        F.count("*").alias("total_count"),
        F.count(final).alias("final_resolved_count"),
        F.count_if(local).alias("local_accepted_count"),
        F.count_if(F.col("route") == "escalate").alias("escalated_count"),
        wrong_local.alias("local_accepted_errors"),
        wrong_final.alias("final_resolved_errors"),
        F.count_if((F.col("route") == "escalate") & (F.col("provider_status") != "not_called")).alias("external_calls"),
    )
    total = F.col("total_count")
    local_ci = wilson(F.col("local_accepted_errors"), F.col("local_accepted_count"), "unit")
    final_ci = wilson(F.col("final_resolved_errors"), F.col("final_resolved_count"), "unit")
    return out.withColumns(
        {
            "execution_coverage": ratio(F.col("final_resolved_count"), total),
            "local_coverage": ratio(F.col("local_accepted_count"), total),
            "escalation_rate": ratio(F.col("escalated_count"), total),
            "unresolved_count": total - F.col("final_resolved_count"),
            "unresolved_rate": ratio(total - F.col("final_resolved_count"), total),
            "local_accepted_risk": F.coalesce(ratio(F.col("local_accepted_errors"), F.col("local_accepted_count")), F.lit(0.0)),
            "local_risk_low": local_ci["lower"],
            "local_risk_high": local_ci["upper"],
            "final_resolved_risk": ratio(F.col("final_resolved_errors"), F.col("final_resolved_count")),
            "final_risk_low": final_ci["lower"],
            "final_risk_high": final_ci["upper"],
            "external_calls_per_1000": 1000 * ratio(F.col("external_calls"), total),
        }
    )


def routing_by_domain(routed: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG32: resolved count and errors per domain."""
    rows = routed.filter(F.col("final_label").isNotNull())
    return rows.groupBy(*by, F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(
        F.count("*").alias("count"), F.count_if(F.col("final_label") != F.col("gold")).alias("errors")
    )


def policy_report(
    routed: DataFrame, by: Sequence[str], classes: Column, targets: Sequence[float] = TARGET_ERRORS
) -> DataFrame:
    """AGG33: one wide row per policy: routing, label and probability metrics, latency, cost, coverage."""
    keyed = routed.withColumn("_key", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by]))
    keyed = cut_lineage(keyed)  # read by every part of the report
    key = ["_key"]
    summary = routing_summary(keyed, [*by, "_key"])
    resolved = keyed.filter(F.col("final_label").isNotNull()).withColumn("label", F.col("final_label"))
    quality = classification_report(resolved, key, classes).withColumnRenamed("count", "scored_count")
    speed = latency_summary(keyed, key).select(
        "_key", F.col("count").alias("latency_count"), "mean_ms", "median_ms", "p95_ms"
    )
    called = keyed.filter((F.col("route") == "escalate") & (F.col("provider_status") != "not_called"))
    cost = resource_usage(called.withColumn("judge_id", F.col("provider_model")), key).select(
        "_key", F.col("model").alias("provider_model"), "input_tokens", "output_tokens", "cost", "usage_available_calls"
    )
    depth = target_coverage(keyed.select("_key", "confidence", "correct", "ordinal"), key, targets)
    wide = depth.groupBy("_key").agg(
        *[
            F.max(F.when(F.col("target_error") == float(t), F.col("coverage"))).alias(f"coverage_at_{t:.2f}".replace(".", "_"))
            for t in targets
        ]
    )
    out = summary
    for part in (quality, speed, cost, wide):
        out = out.join(part, "_key", "left")
    reason = F.when(F.col("final_resolved_count") == 0, "no resolved predictions").when(
        ~F.col("probability_metrics_available"), "one or more resolved predictions did not provide probabilities"
    )
    target = F.col("target_error") if "target_error" in by else F.lit(None).cast("double")
    supported = F.coalesce((F.col("local_accepted_count") > 0) & (F.col("local_risk_high") <= target), F.lit(False))
    return out.withColumns(
        {
            "probability_unavailable_reason": reason,
            "latency_available": F.coalesce(F.col("latency_count") > 0, F.lit(False)),
            "confidence_supported": F.when(target.isNotNull(), supported),
            "claim_status": F.when(target.isNotNull(), F.when(supported, "confidence-supported").otherwise("descriptive")),
        }
    ).drop("_key")


def collapsed_points(points: DataFrame, family: str = "policy") -> DataFrame:
    """AGG34: policy families where every target has the same threshold and local coverage.

    One row per family and target comes in, so the groups are as small as the
    list of targets.
    """
    rows = points.filter(F.col("target_error").isNotNull())
    point = F.struct(F.coalesce("threshold", F.lit(-1.0)), "local_coverage")
    return rows.groupBy(family).agg(
        F.count("*").alias("targets"),
        ((F.count("*") > 1) & (F.min(point) == F.max(point))).alias("collapsed"),
    )


def thresholds_by_view(selection: DataFrame, view: str = "view") -> dict[str, dict[float, float]]:
    """Selected thresholds as plain numbers: views times targets, a handful of rows."""
    out: dict[str, dict[float, float]] = {}
    for r in collect_bounded(selection.select(view, "target_error", "threshold"), 1024, "the thresholds"):
        out.setdefault(r[view], {})[r["target_error"]] = r["threshold"]
    return out


__all__ = [
    "as_struct",
    "attach",
    "collapsed_points",
    "outcome",
    "policy_report",
    "policy_sweep",
    "resolve",
    "route",
    "route_all",
    "route_of",
    "routing_by_domain",
    "routing_summary",
    "thresholds_by_view",
]
