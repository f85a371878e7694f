"""Routing, policy and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import calibration as C
from assay.operators import exports as E
from assay.operators import joins as J
from assay.operators import metrics as M
from assay.operators import ranking as R
from assay.operators import routing as P
from assay.plans import derive as D
from assay.plans.calibration import _TEMP, mode_model
from assay.plans.metrics import _PAIRS, KEYS, ZSQL, mode_classes, rounded, sliced, wilson_sql
from assay.plans.ranking import _RANK, _TESTS, TARGETS, TSQL
from assay.plans.registry import query
from assay.session import cut_lineage

SEED = 20260920


def student(spark, sf):
    """Judge b as the local judge, with raw and calibrated confidence."""
    rows = D.scored(spark, sf).filter("judge_id = 'b' AND resolved = 1 AND probabilities IS NOT NULL")
    raw = rows.withColumns(
        {"raw_confidence": F.array_max(F.map_values("probabilities")), "_raw": F.col("probabilities")}
    )
    out = C.apply_temperature(raw, mode_model(spark), ["mode"], mode_classes())
    return out.select(
        *[c for c in rows.columns if c != "probabilities"],
        F.col("_raw").alias("probabilities"),
        F.col("probabilities").alias("calibrated_probabilities"),
        "raw_confidence",
        F.array_max(F.map_values("probabilities")).alias("calibrated_confidence"),
        F.col("source").alias("domain"),
    )


def external(spark, sf):
    return D.predictions(D.bare_records(spark, sf)).filter("judge_id = 'c' AND execution_status <> 'skipped'")


def selected_thresholds(rows):
    """Thresholds of both confidence views, from the threshold partition only."""
    views = F.array(
        *[F.struct(F.lit(v).alias("view"), F.col(f"{v}_confidence").alias("confidence")) for v in ("raw", "calibrated")]
    )
    return R.select_threshold(rows.select("correct", "ordinal", F.inline(views)), ["view"], TARGETS)


def routed(spark, sf):
    rows = cut_lineage(student(spark, sf))  # read for the thresholds and for the final routes
    cuts = P.thresholds_by_view(selected_thresholds(rows.filter("split <> 'test'")))
    final = rows.filter("split = 'test'")
    keep = final.select("record_id", "gold", "mode", "domain", "ordinal")
    return P.policy_sweep(keep, final, external(spark, sf), cuts, SEED)


_STUDENT = (
    _TEMP
    + """, st AS MATERIALIZED (SELECT * EXCLUDE (p1,p2,p3), greatest(p1,p2,coalesce(p3,0)) AS conf_cal, p1 AS c1, p2 AS c2, p3 AS c3 FROM tq WHERE judge_id='b'),
 ex AS (SELECT * FROM sc WHERE judge_id='c' AND execution_status<>'skipped')"""
)


@query(
    "RTE1",
    D.scored_with()
    + """ SELECT record_id, label AS student_label, round(conf,9) AS raw_confidence, round(conf,9) AS calibrated_confidence,
 round(conf-list_sort([p1,p2,coalesce(p3,0)],'DESC')[2],9) AS margin, 0.6::DOUBLE AS threshold, CASE WHEN conf>=0.6 THEN 'local' ELSE 'escalate' END AS route
 FROM sc WHERE judge_id='b' AND has_p""",
)
def confidence_routes(spark, sf):
    rows = D.scored(spark, sf).filter("judge_id = 'b' AND resolved = 1 AND probabilities IS NOT NULL")
    return rounded(P.route(rows, 0.6))


_OUT = """CASE WHEN route='local' THEN l.label WHEN e.execution_status='ok' THEN e.label END AS final_label,
 CASE WHEN route='local' OR e.execution_status IS NULL THEN 'not_called' ELSE e.execution_status END AS provider_status,
 CASE WHEN route='escalate' THEN e.judge_id END AS provider_model,
 CASE WHEN route='escalate' AND e.record_id IS NULL THEN 'provider_not_available' END AS provider_error"""


@query(
    "RTE2",
    D.scored_with(
        _STUDENT,
        "ro AS (SELECT record_id, label, CASE WHEN conf>=0.6 THEN 'local' ELSE 'escalate' END AS route FROM sc WHERE judge_id='b' AND has_p)",
    )
    + f" SELECT l.record_id, l.route, {_OUT} FROM ro l LEFT JOIN ex e USING (record_id)",
)
def route_outcomes(spark, sf):
    rows = D.scored(spark, sf).filter("judge_id = 'b' AND resolved = 1 AND probabilities IS NOT NULL")
    out = P.resolve(P.route(rows, 0.6).select("record_id", "route"), rows, external(spark, sf))
    return out.select("record_id", "route", "final_label", "provider_status", "provider_model", "provider_error")


@query(
    "RTE3",
    D.scored_with(_STUDENT)
    + """ SELECT r.record_id, 'escalate' AS route, CASE WHEN e.execution_status='ok' THEN e.label END AS final_label,
 coalesce(e.execution_status,'not_called') AS provider_status, e.judge_id AS provider_model,
 CASE WHEN e.record_id IS NULL THEN 'provider_not_available' END AS provider_error FROM rec r LEFT JOIN ex e USING (record_id)""",
)
def provider_only_routes(spark, sf):
    return P.route_all(D.bare_records(spark, sf), external(spark, sf))


_SWEPT = (
    _STUDENT
    + f""", vw AS (SELECT 'raw' AS view, conf AS c, correct, ordinal FROM st WHERE split<>'test' UNION ALL SELECT 'calibrated', conf_cal, correct, ordinal FROM st WHERE split<>'test'),
 vc AS (SELECT view, c, count(*) AS n, count(*)-sum(correct) AS e FROM vw GROUP BY ALL UNION ALL SELECT v, x, 0, 0 FROM (VALUES ('raw'),('calibrated')) a(v), (VALUES (0.0::DOUBLE),(1.0::DOUBLE)) b(x)),
 vg AS (SELECT view, c, sum(n) AS n, sum(e) AS e FROM vc GROUP BY ALL),
 vs AS (SELECT view, c, sum(n) OVER w AS a, sum(e) OVER w AS e FROM vg WINDOW w AS (PARTITION BY view ORDER BY c DESC)),
 ts AS MATERIALIZED (SELECT view, target_error, c AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY view, target_error ORDER BY (coalesce(e::DOUBLE/nullif(a,0),0)<=target_error)::INT DESC,
   CASE WHEN coalesce(e::DOUBLE/nullif(a,0),0)<=target_error THEN a ELSE 0 END DESC, c DESC) AS rn FROM vs, {TSQL}) WHERE rn=1),
 pl AS (SELECT 'local_only' AS policy, NULL::DOUBLE AS target_error, NULL::DOUBLE AS threshold UNION ALL SELECT 'provider_only', NULL, NULL
   UNION ALL SELECT view||'_local_to_provider', target_error, threshold FROM ts UNION ALL SELECT 'random_matched_to_provider', target_error, NULL FROM ts WHERE view='calibrated'),
 fi AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:matched-control:'||record_id), record_id) AS pos FROM st WHERE split='test'),
 aw AS (SELECT target_error, count(*) FILTER (conf_cal<threshold) AS k FROM fi, ts WHERE view='calibrated' GROUP BY ALL),
 rw AS (SELECT pl.policy, pl.target_error, pl.threshold, fi.record_id, gold, mode, source AS domain, ordinal, label, correct, c1, c2, c3, conf, conf_cal, latency_ms, has_usage, ti, tou,
   CASE policy WHEN 'local_only' THEN 'local' WHEN 'provider_only' THEN 'escalate'
     WHEN 'calibrated_local_to_provider' THEN CASE WHEN conf_cal>=threshold THEN 'local' ELSE 'escalate' END
     WHEN 'raw_local_to_provider' THEN CASE WHEN conf>=threshold THEN 'local' ELSE 'escalate' END
     ELSE CASE WHEN pos<=aw.k THEN 'escalate' ELSE 'local' END END AS route
   FROM fi CROSS JOIN pl LEFT JOIN aw ON aw.target_error=pl.target_error),
 rr AS MATERIALIZED (SELECT l.*, {_OUT}, e.latency_ms AS el, e.has_p AS ep, e.has_usage AS eu, e.ti AS eti, e.tou AS etou FROM rw l LEFT JOIN ex e USING (record_id))"""
)


@query(
    "RTE4 SPL10 ORD4",
    D.scored_with(_SWEPT)
    + """ SELECT policy, target_error, round(threshold,9) AS threshold, record_id, route, final_label, provider_status, provider_model, provider_error FROM rr""",
)
def policy_sweep(spark, sf):
    return rounded(
        routed(spark, sf).select(
            "policy", "target_error", "threshold", "record_id", "route", "final_label", "provider_status", "provider_model", "provider_error"
        )
    )


_SUMMARY = """sm AS (SELECT policy, target_error, threshold, count(*) AS total_count, count(final_label) AS final_resolved_count, count(*) FILTER (route='local') AS local_accepted_count,
  count(*) FILTER (route='escalate') AS escalated_count, count(*) FILTER (route='local' AND final_label IS DISTINCT FROM gold) AS local_accepted_errors,
  count(*) FILTER (final_label<>gold) AS final_resolved_errors, count(*) FILTER (route='escalate' AND provider_status<>'not_called') AS external_calls FROM rr GROUP BY ALL)"""


@query(
    "AGG32 STA1",
    D.scored_with(_SWEPT, _SUMMARY)
    + f""" SELECT policy, target_error, total_count, final_resolved_count, local_accepted_count, escalated_count, local_accepted_errors, final_resolved_errors, external_calls,
 round(final_resolved_count::DOUBLE/total_count,9) AS execution_coverage, round(local_accepted_count::DOUBLE/total_count,9) AS local_coverage,
 round(escalated_count::DOUBLE/total_count,9) AS escalation_rate, total_count-final_resolved_count AS unresolved_count,
 round((total_count-final_resolved_count)::DOUBLE/total_count,9) AS unresolved_rate,
 round(coalesce(local_accepted_errors::DOUBLE/nullif(local_accepted_count,0),0),9) AS local_accepted_risk,
 coalesce(lr_low,0.0::DOUBLE) AS local_risk_low, coalesce(lr_high,1.0::DOUBLE) AS local_risk_high,
 round(final_resolved_errors::DOUBLE/nullif(final_resolved_count,0),9) AS final_resolved_risk, fr_low AS final_risk_low, fr_high AS final_risk_high,
 round(1000.0::DOUBLE*external_calls/total_count,9) AS external_calls_per_1000
 FROM (SELECT *, CASE WHEN local_accepted_count>0 THEN ll END AS lr_low, CASE WHEN local_accepted_count>0 THEN lh END AS lr_high FROM (
  SELECT sm.*, {wilson_sql("local_accepted_errors", "local_accepted_count", "x").replace("x_low", "ll").replace("x_high", "lh")},
  {wilson_sql("final_resolved_errors", "final_resolved_count", "fr")} FROM sm, {ZSQL}))""",
)
def routing_summary(spark, sf):
    return rounded(P.routing_summary(routed(spark, sf), ["policy", "target_error"]))


@query(
    "AGG32",
    D.scored_with(_SWEPT)
    + " SELECT policy, target_error, domain, count(*) AS count, count(*) FILTER (final_label<>gold) AS errors FROM rr WHERE final_label IS NOT NULL GROUP BY ALL",
)
def routing_by_domain(spark, sf):
    return P.routing_by_domain(routed(spark, sf), ["policy", "target_error"])


@query(
    "AGG33",
    D.scored_with(
        _SWEPT,
        _SUMMARY,
        """pc AS (SELECT policy, target_error, c, count(*) FILTER (gold=c) AS s, count(*) FILTER (final_label=c) AS p, count(*) FILTER (gold=c AND final_label=c) AS t
   FROM rr CROSS JOIN (VALUES ('pass'),('fail'),('A'),('B'),('TIE')) v(c) WHERE final_label IS NOT NULL GROUP BY ALL)""",
        """pq AS (SELECT policy, target_error, sum(t)::DOUBLE/sum(s)::DOUBLE AS accuracy, avg(t::DOUBLE/nullif(s,0)) AS balanced_accuracy, avg(2.0::DOUBLE*t/(s+p)) AS macro_f1 FROM pc WHERE s+p>0 GROUP BY ALL)""",
        """pt AS (SELECT policy, target_error, median(CASE WHEN route='local' THEN latency_ms ELSE el END) AS median_ms,
   quantile_cont(CASE WHEN route='local' THEN latency_ms ELSE el END,0.95) AS p95_ms,
   sum(eti*0.00001+etou*0.00003) FILTER (route='escalate' AND eu) AS cost,
   bool_and(CASE WHEN route='local' THEN true ELSE ep END) FILTER (final_label IS NOT NULL) AS ok FROM rr GROUP BY ALL)""",
    )
    + """ SELECT sm.policy, sm.target_error, total_count, external_calls, round(accuracy,9) AS accuracy, round(balanced_accuracy,9) AS balanced_accuracy, round(macro_f1,9) AS macro_f1,
 round(median_ms,6) AS median_ms, round(p95_ms,6) AS p95_ms, round(cost,6) AS cost, ok AS probability_metrics_available
 FROM sm JOIN pq ON pq.policy=sm.policy AND pq.target_error IS NOT DISTINCT FROM sm.target_error JOIN pt ON pt.policy=sm.policy AND pt.target_error IS NOT DISTINCT FROM sm.target_error""",
)
def policy_report(spark, sf):
    wide = P.policy_report(routed(spark, sf), ["policy", "target_error"], mode_classes(), TARGETS)
    return rounded(
        wide.select(
            "policy",
            "target_error",
            "total_count",
            "external_calls",
            "accuracy",
            "balanced_accuracy",
            "macro_f1",
            F.round("median_ms", 6).alias("median_ms"),
            F.round("p95_ms", 6).alias("p95_ms"),
            F.round("cost", 6).alias("cost"),
            "probability_metrics_available",
        )
    )


@query(
    "AGG34",
    D.scored_with(_SWEPT, _SUMMARY)
    + """ SELECT policy, count(*) AS targets, count(*)>1 AND count(DISTINCT (coalesce(threshold,-1), local_accepted_count))=1 AS collapsed FROM sm WHERE target_error IS NOT NULL GROUP BY policy""",
)
def collapsed_points(spark, sf):
    return P.collapsed_points(P.routing_summary(routed(spark, sf), ["policy", "target_error", "threshold"]))


# --- exports ------------------------------------------------------------------

_SUMS = "g AS (SELECT judge_id, slice, slice_value, count(*) AS records, sum(resolved)::BIGINT AS resolved, sum(correct)::BIGINT AS correct FROM sl GROUP BY ALL)"


def _obs(metric: str, k: str, n: str) -> str:
    return (
        f"SELECT judge_id AS entity, slice, slice_value, '{metric}' AS metric, round({k}::DOUBLE/nullif({n},0),9) AS value, "
        + wilson_sql(k, n, "ci")
        + f", {n} AS n FROM g, {ZSQL}"
    )


@query(
    "EXP1",
    D.scored_with(D.SLICED, _SUMS)
    + " "
    + " UNION ALL ".join(
        [
            _obs("all_record_accuracy", "correct", "records"),
            _obs("conditional_accuracy", "correct", "resolved"),
            _obs("coverage", "resolved", "records"),
        ]
    ),
)
def tidy_observations(spark, sf):
    return rounded(E.observations(M.judge_summary(sliced(spark, sf), KEYS)))


@query(
    "EXP2",
    D.scored_with(_PAIRS, _TESTS)
    + """ SELECT "left","right",'all' AS view,(SELECT count(*) FROM rec) AS n, all_left_only AS left_only_correct, all_right_only AS right_only_correct, round(all_p,8) AS p_exact, round(all_p_holm,8) AS p_holm FROM hm
 UNION ALL SELECT "left","right",'shared', shared_resolved, shared_left_only, shared_right_only, round(shared_p,8), round(shared_p_holm,8) FROM hm""",
)
def pair_table(spark, sf):
    tests = R.paired_tests(J.judge_pairs(D.scored(spark, sf)))
    count = D.bare_records(spark, sf).agg(F.count("*").alias("n")).scalar()
    return rounded(E.pair_table(tests, count), 8)


@query(
    "EXP3 ORD6",
    "WITH RECURSIVE "
    + D.scored_with(
        _PAIRS,
        _TESTS,
        _RANK,
        """hp AS (SELECT "left" AS x,"right" AS y,all_p_holm AS p FROM hm UNION ALL SELECT "right","left",all_p_holm FROM hm),
 wk AS (SELECT judge_id, all_record_rank AS pos, judge_id AS top, all_record_rank AS shared_rank FROM rj WHERE all_record_rank=1
  UNION ALL SELECT r.judge_id, r.all_record_rank, CASE WHEN hp.p>=0.05 THEN wk.top ELSE r.judge_id END,
   CASE WHEN hp.p>=0.05 THEN wk.shared_rank ELSE r.all_record_rank END
  FROM wk JOIN rj r ON r.all_record_rank=wk.pos+1 JOIN hp ON hp.x=wk.top AND hp.y=r.judge_id)""",
        "cv AS (SELECT judge_id, sum(resolved)::DOUBLE/count(*) AS cov FROM sc GROUP BY ALL)",
    )[5:]
    + """ SELECT judge_id, round(aa,9) AS "right", round(cov-aa,9) AS wrong, round(1-cov,9) AS skipped, round(cov,9) AS answered, round(ca,9) AS answered_accuracy,
 shared_rank=1 AS tied_with_leader, aa<(SELECT max(n)::DOUBLE/sum(n)::DOUBLE FROM (SELECT gold, count(*) AS n FROM rec GROUP BY gold)) AS below_baseline
 FROM rj JOIN wk USING (judge_id) JOIN cv USING (judge_id)""",
)
def right_wrong_skipped(spark, sf):
    rows = D.scored(spark, sf)
    summary = M.judge_summary(rows, ["judge_id"])
    ranks = R.shared_ranks(R.rank_judges(summary), R.paired_tests(J.judge_pairs(rows)))
    base = M.majority_baseline(D.bare_records(spark, sf).withColumn("g", F.lit(0)), ["g"])
    return rounded(E.decomposition(summary, ranks, base.select("accuracy").scalar()))


@query(
    "EXP4 FN10",
    D.scored_with()
    + """ SELECT record_id, gold, label AS prediction, correct=1 AS correct, execution_status AS status, round(conf,9) AS confidence, round(latency_ms,6) AS latency_ms FROM sc WHERE judge_id='b'""",
)
def item_results(spark, sf):
    recs = D.bare_records(spark, sf)
    out = E.item_table(recs, D.predictions(recs).filter("judge_id = 'b'"))
    return rounded(out.drop("probabilities").withColumn("latency_ms", F.round("latency_ms", 6)))
