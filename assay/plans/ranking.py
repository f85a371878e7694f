"""Selective-risk, threshold, paired-test and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import joins as J
from assay.operators import metrics as M
from assay.operators import ranking as R
from assay.plans import derive as D
from assay.plans.metrics import _PAIRS, ZSQL, rounded, wilson_sql
from assay.plans.registry import query

BY = ["judge_id", "mode"]
TARGETS = (0.05, 0.10, 0.20, 0.30)
TSQL = "(VALUES (0.05::DOUBLE),(0.10::DOUBLE),(0.20::DOUBLE),(0.30::DOUBLE)) tt(target_error)"


def confident(spark, sf):
    rows = D.scored(spark, sf).filter("resolved = 1")
    return rows.withColumn("confidence", F.array_max(F.map_values("probabilities")))


_CURVE = """cv AS (SELECT judge_id, mode, record_id, conf, row_number() OVER w AS rank,
  sum(correct) OVER (PARTITION BY judge_id, mode ORDER BY conf DESC, ordinal ROWS UNBOUNDED PRECEDING) AS hits,
  count(*) OVER (PARTITION BY judge_id, mode) AS size
 FROM sc WHERE resolved=1 AND conf IS NOT NULL WINDOW w AS (PARTITION BY judge_id, mode ORDER BY conf DESC, ordinal)),
cp AS (SELECT judge_id, mode, rank, rank::DOUBLE/size AS coverage, 1-hits::DOUBLE/rank AS risk, conf AS threshold,
  (rank-hits)::BIGINT AS errors, size FROM cv)"""


@query(
    "ORD1",
    D.scored_with(_CURVE)
    + """ SELECT judge_id, mode, rank, round(coverage,9) AS coverage, round(risk,9) AS risk, round(threshold,9) AS threshold FROM cp
 UNION ALL SELECT DISTINCT judge_id, mode, 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM cp""",
)
def risk_coverage_curve(spark, sf):
    return rounded(R.risk_coverage(confident(spark, sf), BY))


@query(
    "ORD2",
    D.scored_with(_CURVE)
    + f""" SELECT judge_id, mode, target_error, round(max(CASE WHEN risk<=target_error THEN coverage ELSE 0 END),9) AS coverage
 FROM cp, {TSQL} GROUP BY ALL""",
)
def coverage_at_target(spark, sf):
    return rounded(R.coverage_at(confident(spark, sf), BY, TARGETS))


@query(
    "ORD3 STA1",
    D.scored_with(
        _CURVE,
        f"""bt AS (SELECT judge_id, mode, target_error, size,
   coalesce(max(rank) FILTER (errors::DOUBLE/rank<=target_error),0) AS accepted_count FROM cp, {TSQL} GROUP BY ALL),
 b2 AS (SELECT bt.*, coalesce(errors,0) AS error_count, coalesce(threshold,1.0) AS threshold FROM bt
   LEFT JOIN cp ON cp.judge_id=bt.judge_id AND cp.mode=bt.mode AND cp.rank=bt.accepted_count),
 b3 AS (SELECT *, {wilson_sql("error_count", "accepted_count", "risk")} FROM b2, {ZSQL})""",
    )
    + """ SELECT judge_id, mode, target_error, accepted_count, error_count,
 round(coalesce(error_count::DOUBLE/nullif(accepted_count,0),0),9) AS risk, round(threshold,9) AS threshold,
 round(accepted_count::DOUBLE/size,9) AS coverage,
 CASE WHEN accepted_count=0 THEN 0.0::DOUBLE ELSE risk_low END AS risk_low,
 CASE WHEN accepted_count=0 THEN 1.0::DOUBLE ELSE risk_high END AS risk_high,
 accepted_count>0 AND risk_high<=target_error AS confidence_supported,
 CASE WHEN accepted_count>0 AND risk_high<=target_error THEN 'confidence-supported' ELSE 'descriptive' END AS claim_status
 FROM b3""",
)
def target_coverage(spark, sf):
    return rounded(R.target_coverage(confident(spark, sf), BY, TARGETS))


_SWEEP = f"""cd AS (SELECT judge_id, mode, conf AS threshold, count(*) AS n, count(*)-sum(correct) AS e FROM sc
   WHERE resolved=1 AND conf IS NOT NULL GROUP BY ALL
  UNION ALL SELECT DISTINCT judge_id, mode, v, 0, 0 FROM sc, (VALUES (0.0::DOUBLE),(1.0::DOUBLE)) ve(v)),
 cg AS (SELECT judge_id, mode, threshold, sum(n) AS n, sum(e) AS e FROM cd GROUP BY ALL),
 sw AS (SELECT judge_id, mode, threshold,
   (sum(n) OVER (PARTITION BY judge_id, mode ORDER BY threshold DESC))::BIGINT AS accepted_count,
   (sum(e) OVER (PARTITION BY judge_id, mode ORDER BY threshold DESC))::BIGINT AS error_count,
   (sum(n) OVER (PARTITION BY judge_id, mode))::BIGINT AS size, count(*) OVER (PARTITION BY judge_id, mode) AS candidate_count FROM cg),
 s2 AS (SELECT *, coalesce(error_count::DOUBLE/nullif(accepted_count,0),0) AS risk FROM sw),
 s3 AS (SELECT s2.*, target_error, row_number() OVER (PARTITION BY judge_id, mode, target_error
   ORDER BY (risk<=target_error)::INT DESC, CASE WHEN risk<=target_error THEN accepted_count ELSE 0 END DESC, threshold DESC) AS rn
   FROM s2, {TSQL}),
 s4 AS (SELECT *, {wilson_sql("error_count", "accepted_count", "risk")} FROM s3, {ZSQL} WHERE rn=1)"""


@query(
    "ORD4 STA1",
    D.scored_with(_SWEEP)
    + """ SELECT judge_id, mode, target_error, accepted_count, round(threshold,9) AS threshold, error_count, round(risk,9) AS risk,
 candidate_count, round(accepted_count::DOUBLE/size,9) AS coverage,
 CASE WHEN accepted_count=0 THEN 0.0::DOUBLE ELSE risk_low END AS risk_low,
 CASE WHEN accepted_count=0 THEN 1.0::DOUBLE ELSE risk_high END AS risk_high,
 CASE WHEN accepted_count=0 THEN 1.0::DOUBLE ELSE risk_high END<=target_error AS confidence_supported FROM s4""",
)
def threshold_selection(spark, sf):
    return rounded(R.select_threshold(confident(spark, sf), BY, TARGETS))


def _p_sql(b: str, c: str) -> str:
    return (
        f"CASE WHEN {b}+{c}=0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE,2*list_sum([exp(lgamma({b}+{c}+1)-lgamma(i+1)"
        f"-lgamma({b}+{c}-i+1)-({b}+{c})*ln(2.0::DOUBLE)) FOR i IN range(0,least({b},{c})+1)])) END"
    )


_TESTS = f"""dc AS (SELECT "left","right", count(*) FILTER (lr=1 AND rr=1) AS shared_resolved,
  count(*) FILTER (lr=1 AND rr=1 AND lc=1 AND rc=0) AS shared_left_only,
  count(*) FILTER (lr=1 AND rr=1 AND lc=0 AND rc=1) AS shared_right_only,
  count(*) FILTER (lc=1 AND rc=0) AS all_left_only, count(*) FILTER (lc=0 AND rc=1) AS all_right_only FROM pr GROUP BY ALL),
 mc AS (SELECT *, {_p_sql("shared_left_only", "shared_right_only")} AS shared_p,
   {_p_sql("all_left_only", "all_right_only")} AS all_p FROM dc),
 ms AS (SELECT *, least(1.0,(count(*) OVER ()-row_number() OVER (ORDER BY shared_p,"left","right")+1)*shared_p) AS ss,
   least(1.0,(count(*) OVER ()-row_number() OVER (ORDER BY all_p,"left","right")+1)*all_p) AS sa FROM mc),
 hm AS (SELECT *, max(ss) OVER (ORDER BY shared_p,"left","right") AS shared_p_holm,
   max(sa) OVER (ORDER BY all_p,"left","right") AS all_p_holm FROM ms)"""


@query(
    "STA2 ORD7 JN5",
    D.scored_with(_PAIRS, _TESTS)
    + """ SELECT "left","right",shared_resolved,shared_left_only,shared_right_only,all_left_only,all_right_only,
 round(shared_p,8) AS shared_p, round(all_p,8) AS all_p, round(shared_p_holm,8) AS shared_p_holm,
 round(all_p_holm,8) AS all_p_holm FROM hm""",
)
def paired_significance(spark, sf):
    return rounded(R.paired_tests(J.judge_pairs(D.scored(spark, sf))), 8)


_RANK = """js AS (SELECT judge_id, sum(correct)::DOUBLE/sum(resolved) AS ca, sum(correct)::DOUBLE/count(*) AS aa FROM sc GROUP BY ALL),
 rj AS (SELECT judge_id, ca, aa, row_number() OVER (ORDER BY ca DESC, judge_id)::INT AS conditional_rank,
  row_number() OVER (ORDER BY aa DESC, judge_id)::INT AS all_record_rank FROM js)"""
_RANK_COLS = """judge_id, round(ca,9) AS conditional_accuracy, round(aa,9) AS all_record_accuracy, conditional_rank,
 all_record_rank, conditional_rank-all_record_rank AS rank_shift"""


@query("ORD5", D.scored_with(_RANK) + f" SELECT {_RANK_COLS} FROM rj")
def judge_ranking(spark, sf):
    return rounded(R.rank_judges(M.judge_summary(D.scored(spark, sf), ["judge_id"])))


@query(
    "ORD6",
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
    )[5:]
    + f" SELECT {_RANK_COLS}, shared_rank FROM rj JOIN wk USING (judge_id)",
)
def shared_competition_ranks(spark, sf):
    rows = D.scored(spark, sf)
    ranked = R.rank_judges(M.judge_summary(rows, ["judge_id"]))
    return rounded(R.shared_ranks(ranked, R.paired_tests(J.judge_pairs(rows))))


@query(
    "TOP3",
    D.scored_with()
    + """ SELECT record_id, judge_id, round(coalesce(conf,1.0),9) AS confidence FROM sc WHERE judge_id='a'
 ORDER BY coalesce(conf,1.0), record_id LIMIT 10""",
)
def lowest_confidence_cases(spark, sf):
    rows = D.scored(spark, sf).filter("judge_id = 'a'")
    return rounded(R.least_confident(rows).select("record_id", "judge_id", "confidence"))


@query(
    "TOP4 AGG25",
    D.scored_with()
    + """ SELECT b.record_id, count(DISTINCT CASE WHEN p.execution_status='ok' AND p.label IS DISTINCT FROM b.label
 THEN p.label END) AS disagreement
 FROM (SELECT * FROM sc WHERE judge_id='a') b LEFT JOIN (SELECT * FROM sc WHERE judge_id<>'a') p USING (record_id)
 GROUP BY b.record_id ORDER BY 2 DESC, 1 LIMIT 10""",
)
def most_disputed_cases(spark, sf):
    rows = D.scored(spark, sf)
    return R.most_disputed(rows.filter("judge_id <> 'a'"), rows.filter("judge_id = 'a'"))
