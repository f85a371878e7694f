"""Accuracy, calibration-error, coverage, latency and agreement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import joins as J
from assay.operators import metrics as M
from assay.plans import derive as D
from assay.plans.registry import query
from assay.vocab import PAIRWISE_LABELS, SINGLE_LABELS, class_order

KEYS = ["judge_id", "slice", "slice_value"]
ALL_LABELS = SINGLE_LABELS + PAIRWISE_LABELS


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round doubles: the last bits of a float sum depend on the partitioning."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def sliced(spark: SparkSession, sf: str) -> DataFrame:
    return J.with_slices(D.scored(spark, sf), D.slices())


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    return sliced(spark, sf).filter("resolved = 1")


def mode_classes():
    """Class order of each row, by its judgment mode."""
    return class_order(F.col("mode"))

_WILSON = (
    "round(greatest(0,({k}::DOUBLE/{n}+z2/(2*{n}))/(1+z2/{n})-z*sqrt({k}::DOUBLE/{n}*(1-{k}::DOUBLE/{n})/{n}"
    "+z2/(4*{n}::DOUBLE*{n}))/(1+z2/{n})),9) AS {name}_low, "
    "round(least(1,({k}::DOUBLE/{n}+z2/(2*{n}))/(1+z2/{n})+z*sqrt({k}::DOUBLE/{n}*(1-{k}::DOUBLE/{n})/{n}"
    "+z2/(4*{n}::DOUBLE*{n}))/(1+z2/{n})),9) AS {name}_high"
)
ZSQL = "(SELECT 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE*1.959963984540054::DOUBLE AS z2) zz"


def wilson_sql(k: str, n: str, name: str) -> str:
    return _WILSON.format(k=k, n=f"nullif({n},0)", name=name)


@query(
    "AGG12 STA1 JN1",
    D.scored_with(
        D.SLICED,
        "g AS (SELECT judge_id, slice, slice_value, count(*) AS records, sum(resolved)::BIGINT AS resolved, "
        "sum(correct)::BIGINT AS correct FROM sl GROUP BY ALL)",
    )
    + f""" SELECT judge_id, slice, slice_value, records, resolved, correct,
 round(resolved::DOUBLE/records,9) AS coverage, round(correct::DOUBLE/nullif(resolved,0),9) AS conditional_accuracy,
 round(correct::DOUBLE/records,9) AS all_record_accuracy,
 {wilson_sql("resolved", "records", "coverage")}, {wilson_sql("correct", "resolved", "conditional")},
 {wilson_sql("correct", "records", "all_record")} FROM g, {ZSQL}""",
)
def judge_comparison(spark, sf):
    return rounded(M.judge_summary(sliced(spark, sf), KEYS))


_RES = "rs AS (SELECT * FROM sl WHERE resolved=1)"


@query(
    "AGG1 JN1",
    D.scored_with(D.SLICED, _RES)
    + " SELECT judge_id, slice, slice_value, round(avg((gold=label)::INT),9) AS accuracy FROM rs GROUP BY ALL",
)
def accuracy(spark, sf):
    recs = D.bare_records(spark, sf)
    rows = J.with_slices(J.join_resolved(recs, D.predictions(recs).drop("mode", "gold")), D.slices())
    return rounded(M.accuracy(rows, KEYS))


_CLS = """cls AS (SELECT judge_id, slice, slice_value, c AS class,
  count(*) FILTER (gold=c) AS support, count(*) FILTER (label=c) AS predicted,
  count(*) FILTER (gold=c AND label=c) AS true_positive
 FROM rs CROSS JOIN (VALUES ('pass'),('fail'),('A'),('B'),('TIE')) v(c) GROUP BY ALL)"""


@query(
    "AGG2",
    D.scored_with(D.SLICED, _RES, _CLS)
    + " SELECT judge_id, slice, slice_value, round(avg(true_positive::DOUBLE/nullif(support,0)),9) AS balanced_accuracy"
    " FROM cls GROUP BY ALL",
)
def balanced_accuracy(spark, sf):
    return rounded(M.balanced_accuracy(resolved(spark, sf), KEYS))


@query(
    "AGG3",
    D.scored_with(D.SLICED, _RES, _CLS)
    + " SELECT judge_id, slice, slice_value, round(avg(2.0::DOUBLE*true_positive/(support+predicted)),9) AS macro_f1"
    " FROM cls WHERE support+predicted>0 GROUP BY ALL",
)
def macro_f1(spark, sf):
    return rounded(M.macro_f1(resolved(spark, sf), KEYS))


@query(
    "AGG8",
    D.scored_with(D.SLICED, _RES, _CLS)
    + """ SELECT judge_id, slice, slice_value, class, support, predicted, true_positive,
 round(pr,9) AS precision, round(re,9) AS recall,
 round(CASE WHEN pr>0 AND re>0 THEN 2*pr*re/(pr+re) WHEN pr IS NOT NULL OR re IS NOT NULL THEN 0.0 END,9) AS f1
 FROM (SELECT *, true_positive::DOUBLE/nullif(predicted,0) AS pr, true_positive::DOUBLE/nullif(support,0) AS re FROM cls)""",
)
def per_class_report(spark, sf):
    return rounded(M.per_class(resolved(spark, sf), KEYS, ALL_LABELS))


_TERMS = """tm AS (SELECT *,
  CASE WHEN has_p THEN pow(p1-(gold IN ('pass','A'))::INT,2)+pow(p2-(gold IN ('fail','B'))::INT,2)
       +CASE WHEN mode='pairwise' THEN pow(p3-(gold='TIE')::INT,2) ELSE 0 END END AS bt,
  CASE WHEN has_p THEN -ln(greatest(1e-15,CASE WHEN gold IN ('pass','A') THEN p1 WHEN gold IN ('fail','B') THEN p2 ELSE p3 END)) END AS nt,
  CASE WHEN has_p THEN CASE WHEN mode='single' THEN CASE WHEN p1=conf THEN 'pass' ELSE 'fail' END
    WHEN p1=conf THEN 'A' WHEN p2=conf THEN 'B' ELSE 'TIE' END END AS top,
  CASE WHEN has_p THEN list_sum([(conf>=i/10.0::DOUBLE)::INT FOR i IN range(1,10)])::INT END AS bin
 FROM rs)"""
_ECE = """eb AS (SELECT judge_id, slice, slice_value, bin, count(conf) AS m, avg(conf) AS c, avg((top=gold)::INT) AS a
  FROM tm WHERE has_p GROUP BY ALL),
 ec AS (SELECT judge_id, slice, slice_value, sum(m*abs(a-c))/sum(m) AS ece FROM eb GROUP BY ALL)"""


@query(
    "AGG4",
    D.scored_with(D.SLICED, _RES, _TERMS)
    + " SELECT judge_id, slice, slice_value, round(CASE WHEN count(bt)=count(*) THEN avg(bt) END,9) AS brier"
    " FROM tm GROUP BY ALL",
)
def brier_score(spark, sf):
    return rounded(M.brier(resolved(spark, sf), KEYS, mode_classes()))


@query(
    "AGG5",
    D.scored_with(D.SLICED, _RES, _TERMS)
    + " SELECT judge_id, slice, slice_value, round(avg(nt),9) AS nll FROM tm GROUP BY ALL",
)
def negative_log_likelihood(spark, sf):
    return rounded(M.nll(resolved(spark, sf), KEYS, mode_classes(), missing="drop"))


@query(
    "AGG6",
    D.scored_with(D.SLICED, _RES, _TERMS, _ECE) + " SELECT judge_id, slice, slice_value, round(ece,9) AS ece FROM ec",
)
def expected_calibration_error(spark, sf):
    return rounded(M.ece(resolved(spark, sf), KEYS, mode_classes(), missing="drop"))


@query(
    "AGG7",
    D.scored_with(
        D.SLICED,
        _RES,
        _CLS,
        _TERMS,
        _ECE,
        """lm AS (SELECT judge_id, slice, slice_value, sum(support)::BIGINT AS count,
   round(sum(true_positive)::DOUBLE/sum(support)::DOUBLE,9) AS accuracy,
   round(avg(true_positive::DOUBLE/nullif(support,0)),9) AS balanced_accuracy,
   round(avg(2.0::DOUBLE*true_positive/(support+predicted)),9) AS macro_f1 FROM cls WHERE support+predicted>0 GROUP BY ALL),
 pm AS (SELECT judge_id, slice, slice_value, count(bt)=count(*) AS ok, avg(bt) AS b, avg(nt) AS n FROM tm GROUP BY ALL)""",
    )
    + """ SELECT lm.*, round(CASE WHEN ok THEN b END,9) AS brier, round(CASE WHEN ok THEN n END,9) AS nll,
 round(CASE WHEN ok THEN ece END,9) AS ece, ok AS probability_metrics_available
 FROM lm JOIN pm USING (judge_id,slice,slice_value) JOIN ec USING (judge_id,slice,slice_value)""",
)
def classification_report(spark, sf):
    return rounded(M.classification_report(resolved(spark, sf), KEYS, mode_classes()))


@query(
    "AGG9",
    D.scored_with(
        D.SLICED,
        _RES,
        _TERMS,
        """gb AS (SELECT DISTINCT judge_id, slice, slice_value, b::INT AS bin FROM tm CROSS JOIN range(0,10) r(b) WHERE has_p),
 rb AS (SELECT judge_id, slice, slice_value, bin, count(*) AS n, avg(conf) AS c, avg((label=gold)::INT) AS a
        FROM tm WHERE has_p GROUP BY ALL)""",
    )
    + """ SELECT judge_id, slice, slice_value, bin, coalesce(n,0) AS count, round(c,9) AS mean_confidence,
 round(a,9) AS accuracy, round(bin/10.0::DOUBLE,9) AS bin_lower, round((bin+1)/10.0::DOUBLE,9) AS bin_upper
 FROM gb LEFT JOIN rb USING (judge_id,slice,slice_value,bin)""",
)
def reliability_table(spark, sf):
    return rounded(M.reliability(resolved(spark, sf), KEYS, mode_classes()))


@query(
    "AGG10",
    D.scored_with(
        """gb AS (SELECT DISTINCT judge_id, mode, b::INT AS bin FROM sc CROSS JOIN range(0,10) r(b) WHERE has_p),
 hb AS (SELECT judge_id, mode, least(floor(conf*10),9)::INT AS bin, count(*) AS n FROM sc WHERE has_p GROUP BY ALL)"""
    )
    + " SELECT judge_id, mode, bin, coalesce(n,0) AS count FROM gb LEFT JOIN hb USING (judge_id,mode,bin)",
)
def confidence_histogram(spark, sf):
    rows = D.scored(spark, sf)
    return M.histogram(rows, ["judge_id", "mode"], F.array_max(F.map_values("probabilities")))


@query(
    "AGG11",
    D.scored_with(D.SLICED)
    + """ SELECT judge_id, slice, slice_value, CASE WHEN resolved=1 THEN 'ok'
 WHEN execution_status='skipped' AND error_kind='abstention' THEN 'abstention'
 WHEN execution_status='skipped' AND error_kind='context_limit' THEN 'context_limit_skip'
 WHEN execution_status='provider_error' AND error_kind='timeout' THEN 'provider_timeout'
 ELSE execution_status END AS reason, count(*) AS count FROM sl GROUP BY ALL""",
)
def status_counts(spark, sf):
    return M.status_counts(sliced(spark, sf), KEYS)


def _latency_sql(median: str, p95: str) -> str:
    return (
        D.scored_with(D.SLICED)
        + f""" SELECT judge_id, slice, slice_value, count(latency_ms) AS count, round(avg(latency_ms),6) AS mean_ms,
 round(min(latency_ms),6) AS min_ms, round(max(latency_ms),6) AS max_ms, round({median},6) AS median_ms,
 round({p95},6) AS p95_ms FROM sl GROUP BY judge_id, slice, slice_value"""
    )


_SORTED = "list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))"


@query("AGG13", _latency_sql("quantile_cont(latency_ms,0.5)", "quantile_cont(latency_ms,0.95)"))
def latency_linear(spark, sf):
    return rounded(M.latency_summary(sliced(spark, sf), KEYS), 6)


def _rank_sql(f: str) -> str:
    return f"{_SORTED}[(round_even((count(latency_ms)-1)*{f}::DOUBLE,0)+1)::INT]"


@query("AGG13", _latency_sql(_rank_sql("0.5"), _rank_sql("0.95")))
def latency_nearest_rank(spark, sf):
    return rounded(M.latency_summary(sliced(spark, sf), KEYS, "nearest"), 6)


def _floor_sql(f: str) -> str:
    return f"{_SORTED}[(least(count(latency_ms)-1,floor(count(latency_ms)*{f}::DOUBLE))+1)::INT]"


@query("AGG13", _latency_sql(_floor_sql("0.5"), _floor_sql("0.95")))
def latency_floor_rank(spark, sf):
    return rounded(M.latency_summary(sliced(spark, sf), KEYS, "floor"), 6)


@query("AGG14", D.scored_with() + " SELECT split, mode, source, count(*) AS count FROM rec GROUP BY ALL")
def record_counts(spark, sf):
    return M.count_by(D.bare_records(spark, sf), ["split", "mode", "source"])


@query(
    "AGG14",
    D.scored_with()
    + """ SELECT judge_id, source, count(*) AS requests, count(*) FILTER (execution_status='ok') AS accepted,
 round(count(*) FILTER (execution_status='ok')::DOUBLE/count(*),9) AS acceptance_rate FROM sc GROUP BY ALL""",
)
def acceptance_rate(spark, sf):
    return rounded(M.acceptance_rate(D.scored(spark, sf), ["judge_id", "source"], F.col("execution_status") == "ok"))


@query(
    "AGG15",
    D.scored_with(D.SLICED)
    + """ SELECT judge_id, slice, slice_value, judge_id AS model, count(*) AS calls,
 count(*) FILTER (has_usage) AS usage_available_calls, round(sum(ti) FILTER (has_usage),6) AS input_tokens,
 round(sum(tou) FILTER (has_usage),6) AS output_tokens,
 round(sum(ti*0.00001+tou*0.00003) FILTER (has_usage),6) AS cost,
 round(1000*sum(ti*0.00001+tou*0.00003) FILTER (has_usage)/count(*),6) AS cost_per_1000
 FROM sl GROUP BY judge_id, slice, slice_value""",
)
def resource_usage(spark, sf):
    return rounded(M.resource_usage(sliced(spark, sf), KEYS), 6)


_PAIRS = """pr AS (SELECT l.source, l.mode, l.judge_id AS "left", r.judge_id AS "right", l.resolved AS lr, r.resolved AS rr,
  l.label AS ll, r.label AS rl, l.correct AS lc, r.correct AS rc, l.record_id
 FROM sc l JOIN sc r ON l.record_id=r.record_id AND l.judge_id<r.judge_id)"""


@query(
    "JN5",
    D.scored_with(_PAIRS)
    + """ SELECT "left", "right", mode, ll AS left_label, rl AS right_label, lr=1 AS left_resolved, rr=1 AS right_resolved,
 count(*) AS n FROM pr GROUP BY ALL""",
)
def judge_pair_table(spark, sf):
    pairs = J.judge_pairs(D.scored(spark, sf), ["mode"])
    return pairs.groupBy(
        "left",
        "right",
        "mode",
        F.col("left_outcome.label").alias("left_label"),
        F.col("right_outcome.label").alias("right_label"),
        (F.col("left_outcome.resolved") == 1).alias("left_resolved"),
        (F.col("right_outcome.resolved") == 1).alias("right_resolved"),
    ).agg(F.sum("n").alias("n"))


@query(
    "AGG16 JN5",
    D.scored_with(_PAIRS)
    + """ SELECT "left", "right", source, count(*) FILTER (lr=1 AND rr=1) AS comparable,
 count(*) FILTER (lr=1 AND rr=1 AND ll=rl) AS agreeing,
 round(count(*) FILTER (lr=1 AND rr=1 AND ll=rl)::DOUBLE/nullif(count(*) FILTER (lr=1 AND rr=1),0),9) AS agreement_rate
 FROM pr GROUP BY ALL""",
)
def judge_agreement(spark, sf):
    return rounded(M.agreement(J.judge_pairs(D.scored(spark, sf), ["source"]), ["source"]))


_BAL = """bs AS (SELECT judge_id, sum(resolved)::BIGINT AS resolved, sum(resolved)::DOUBLE/count(*) AS coverage,
  avg(correct) FILTER (mode='single' AND resolved=1) AS single_accuracy,
  avg(correct) FILTER (mode='pairwise' AND resolved=1) AS pairwise_accuracy FROM sc GROUP BY judge_id)"""


@query(
    "AGG17",
    D.scored_with(_BAL)
    + """ SELECT judge_id, resolved, round(coverage,9) AS coverage, round(single_accuracy,9) AS single_accuracy,
 round(pairwise_accuracy,9) AS pairwise_accuracy, round((single_accuracy+pairwise_accuracy)/2,9) AS selection_score FROM bs""",
)
def mode_balanced_score(spark, sf):
    return rounded(M.mode_balanced_score(D.scored(spark, sf), ["judge_id"]))


@query(
    "AGG17",
    D.scored_with(
        _BAL,
        "b2 AS (SELECT *, (single_accuracy+pairwise_accuracy)/2 AS s FROM bs)",
        "base AS (SELECT s FROM b2 WHERE judge_id='a')",
        """best AS (SELECT judge_id, s FROM b2 WHERE resolved>=64 AND coverage>=0.85 AND s>=(SELECT s FROM base)+0.10
   ORDER BY s DESC, coverage DESC, judge_id DESC LIMIT 1)""",
    )
    + """ SELECT 'a' AS baseline_variant, round((SELECT s FROM base),9) AS baseline_score,
 coalesce((SELECT judge_id FROM best),'a') AS selected_variant,
 round(coalesce((SELECT s FROM best),(SELECT s FROM base)),9) AS selected_score,
 (SELECT judge_id FROM best) IS NOT NULL AS gate_passed""",
)
def protocol_selection(spark, sf):
    summary = M.mode_balanced_score(D.scored(spark, sf), ["judge_id"])
    return rounded(M.select_protocol(summary, "a", variant="judge_id", min_coverage=0.85))


@query(
    "AGG21",
    D.scored_with(
        """mc AS (SELECT source, gold, count(*) AS n FROM rec GROUP BY ALL),
 mx AS (SELECT source, max(n) AS top, sum(n)::BIGINT AS total, count(*) AS k FROM mc GROUP BY source)"""
    )
    + """ SELECT source, total AS count, k AS classes, min(gold) AS label, count(*)>1 AS tie,
 round(top::DOUBLE/total,9) AS accuracy, round(1.0::DOUBLE/k,9) AS balanced_accuracy,
 round(2*(top::DOUBLE/total)/(1+top::DOUBLE/total)/k,9) AS macro_f1
 FROM mc JOIN mx USING (source) WHERE n=top GROUP BY source, total, k, top""",
)
def majority_baseline(spark, sf):
    return rounded(M.majority_baseline(D.bare_records(spark, sf), ["source"]))


@query(
    "AGG22",
    D.scored_with(
        "fc AS (SELECT judge_id, source, sum(correct)::BIGINT AS c, sum(resolved)::BIGINT AS r FROM sc GROUP BY ALL)"
    )
    + """ SELECT judge_id, round(sum(c)::DOUBLE/sum(r)::DOUBLE,9) AS micro_accuracy,
 round(CASE WHEN count(c::DOUBLE/nullif(r,0))=count(*) THEN avg(c::DOUBLE/nullif(r,0)) END,9) AS macro_accuracy,
 count(*) AS families FROM fc GROUP BY judge_id""",
)
def micro_macro_accuracy(spark, sf):
    families = M.judge_summary(D.scored(spark, sf), ["judge_id", "source"])
    return rounded(M.micro_macro(families, ["judge_id"]))


@query(
    "AGG23",
    """WITH c AS (SELECT upper(trim(n_name)) AS value, count(*) AS count FROM customer JOIN nation ON c_nationkey=n_nationkey
  GROUP BY ALL ORDER BY count(*) DESC, 1 LIMIT 20)
 SELECT value, count FROM c UNION ALL SELECT 'OTHER', NULL""",
)
def jurisdiction_vocabulary(spark, sf):
    nation = D.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    rows = D.table(spark, sf, "customer").join(nation, "c_nationkey")
    return M.top_vocabulary(rows, F.col("n_name"), 20)


@query(
    "AGG24",
    """SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY ALL
 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL
 UNION ALL SELECT 'rows_scanned', '*', count(*) FROM orders""",
)
def field_census(spark, sf):
    return M.census(D.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "AGG25",
    D.scored_with()
    + """ SELECT b.record_id, count(DISTINCT CASE WHEN p.execution_status='ok' AND p.label IS DISTINCT FROM b.label
 THEN p.label END) AS disagreement
 FROM (SELECT * FROM sc WHERE judge_id='a') b LEFT JOIN (SELECT * FROM sc WHERE judge_id<>'a') p USING (record_id)
 GROUP BY b.record_id""",
)
def disagreement_per_record(spark, sf):
    rows = D.scored(spark, sf)
    return M.disagreement(rows.filter("judge_id <> 'a'"), rows.filter("judge_id = 'a'"))


@query(
    "AGG26",
    D.scored_with()
    + """ SELECT judge_id, mode, round(avg((label IN ('pass','A','B'))::INT),9) AS valid_label_rate,
 count(*) FILTER (has_p) AS native_probability_count FROM sc GROUP BY ALL""",
)
def label_validity(spark, sf):
    legal = F.array(F.lit("pass"), F.lit("A"), F.lit("B"))
    return rounded(M.label_validity(D.scored(spark, sf), ["judge_id", "mode"], legal))
