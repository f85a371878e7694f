"""Run-ledger queries over result documents derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import ledger as L
from assay.plans import derive as D
from assay.plans.metrics import rounded
from assay.plans.registry import query
from assay.sources.readers import parse_object


def _order_paths(spark, sf):
    o = D.table(spark, sf, "orders")
    key, prio = F.col("o_orderkey").cast("string"), F.substring("o_orderpriority", 1, 1)
    base = F.concat(F.lit("experiments/EXP-20260101-"), F.lpad(F.pmod("o_custkey", F.lit(1000)).cast("string"), 3, "0"), F.lit("-demo/"))
    tail = (
        F.when(prio == "1", F.concat(F.lit("runs/r"), key))
        .when(prio == "2", F.concat(F.lit("runs/g"), key, F.lit("/arm")))
        .when(prio == "3", F.concat(F.lit("diagnostics/d"), key))
        .when(prio == "4", F.concat(F.lit("extra/x"), key))
        .otherwise(F.concat(F.lit("runs/p"), key, F.when(F.col("o_orderstatus") == "F", "-Paused").otherwise("")))
    )
    return o.withColumn("_dir", F.concat(base, tail)).withColumn("_prio", prio)


def result_documents(spark, sf):
    o = _order_paths(spark, sf).filter("_prio <> '5'")
    share = F.concat(F.lit("0."), F.lpad(F.floor("o_totalprice").cast("string"), 6, "0"))
    key, count = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    content = (
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(
                F.lit('{"metrics": {"accuracy": '), share, F.lit('}, "record_count": '), count,
                F.lit(', "status_counts": {"ok": '), count, F.lit(', "bad": true}, "provider": "'), "o_orderpriority",
                F.lit('", "created_at_utc": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "code_commit": "abc"}'),
            ),
        )
        .when(
            F.col("o_orderstatus") == "O",
            F.concat(
                F.lit('{"correct_count": '), count, F.lit(', "resolved_count": 100000, "run_id": "shared-'), F.col("o_orderdate").cast("date").cast("string"),
                F.lit('", "accuracy_wilson_95": ['), share, F.lit(', null], "arms": {"a": {"accuracy": 0.5}, "b": {}}, "latency_ms": null}'),
            ),
        )
        .when(F.col("o_totalprice") > 250000, F.concat(F.lit('{"x": '), key))
        .otherwise(
            F.concat(F.lit('{"accuracy": true, "aggregate": {"metrics": {"accuracy": '), share, F.lit('}, "count": '), count, F.lit('}}'))
        )
    )
    rows = o.select(F.concat("_dir", F.lit("/results.json")).alias("path"), content.alias("content"))
    return rows.withColumn("doc", parse_object(F.col("content")))


def file_list(spark, sf):
    o = _order_paths(spark, sf)
    return o.select(F.concat("_dir", F.when(F.col("_prio") == "5", "/notes.txt").otherwise("/results.json")).alias("path"))


def ledger(spark, sf):
    return L.run_ledger(result_documents(spark, sf), file_list(spark, sf))


_LEDGER = """od AS (SELECT *, substr(o_orderpriority,1,1) AS prio, 'EXP-20260101-'||lpad((o_custkey%1000)::VARCHAR,3,'0')||'-demo' AS experiment,
  ('0.'||lpad(floor(o_totalprice)::BIGINT::VARCHAR,6,'0'))::DOUBLE AS share FROM orders),
 ld AS (SELECT *, CASE prio WHEN '1' THEN 'runs/r'||o_orderkey WHEN '2' THEN 'runs/g'||o_orderkey||'/arm' WHEN '3' THEN 'diagnostics/d'||o_orderkey WHEN '4' THEN 'extra/x'||o_orderkey
   ELSE 'runs/p'||o_orderkey||CASE o_orderstatus WHEN 'F' THEN '-Paused' ELSE '' END END AS tail, prio<>'5' AS has_results,
   CASE WHEN prio='5' THEN NULL WHEN o_orderstatus='P' AND o_totalprice>250000 THEN 'bad' ELSE o_orderstatus END AS shape FROM od),
 le AS (SELECT 'experiments/'||experiment||'/'||tail AS run_path, experiment, CASE prio WHEN '1' THEN 'run' WHEN '2' THEN 'nested_run' WHEN '3' THEN 'diagnostic' WHEN '4' THEN 'child_run' ELSE 'run' END AS scope,
   CASE WHEN shape='O' THEN 'shared-'||strftime(o_orderdate,'%Y-%m-%d') WHEN prio='2' THEN 'arm' ELSE split_part(tail,'/',2) END AS run_id, has_results, shape, share, o_custkey, o_orderpriority, o_orderdate, o_orderstatus,
   CASE WHEN NOT has_results THEN CASE o_orderstatus WHEN 'F' THEN 'quarantined' ELSE 'partial' END WHEN shape='bad' THEN 'quarantined' ELSE 'complete' END AS completeness,
   CASE shape WHEN 'F' THEN share WHEN 'P' THEN share WHEN 'O' THEN o_custkey/100000.0::DOUBLE END AS accuracy,
   CASE shape WHEN 'F' THEN 'metrics.accuracy' WHEN 'P' THEN 'aggregate.metrics.accuracy' WHEN 'O' THEN 'correct_count/resolved_count' END AS accuracy_source,
   CASE WHEN shape IN ('F','P') THEN o_custkey END AS record_count FROM ld)"""


@query("LED1", f"WITH {_LEDGER} SELECT run_path, experiment, scope FROM le WHERE has_results")
def ledger_scopes(spark, sf):
    return L.ledger_paths(result_documents(spark, sf)).select("run_path", "experiment", "scope")


@query(
    "LED2",
    f"""WITH {_LEDGER} SELECT run_path, round(accuracy,9) AS accuracy, accuracy_source, record_count, CASE shape WHEN 'O' THEN 100000::BIGINT END AS resolved_count,
 round(CASE shape WHEN 'O' THEN share END,9) AS ci_low, CASE shape WHEN 'F' THEN o_custkey END AS ok_count FROM le WHERE has_results""",
)
def ledger_field_resolution(spark, sf):
    rows = L.run_ledger(result_documents(spark, sf))
    return rounded(
        rows.select(
            "run_path", "accuracy", "accuracy_source", "record_count", "resolved_count",
            F.col("accuracy_ci.low").alias("ci_low"), F.try_element_at("status_counts", F.lit("ok")).alias("ok_count"),
        )
    )


@query(
    "LED3",
    f"""WITH {_LEDGER} SELECT run_path, shape IS NOT DISTINCT FROM 'F' AS has_metrics, shape IS NOT DISTINCT FROM 'P' AS has_aggregate, shape IS NOT DISTINCT FROM 'O' AS has_arms,
 CASE shape WHEN 'O' THEN 2 END::INT AS arms_count, shape IS NOT DISTINCT FROM 'O' AS has_arm_accuracy, shape IS NOT DISTINCT FROM 'O' AS has_latency, shape IS NOT DISTINCT FROM 'F' AS has_code_commit FROM le""",
)
def ledger_structure_flags(spark, sf):
    names = ["has_metrics", "has_aggregate", "has_arms", "arms_count", "has_arm_accuracy", "has_latency", "has_code_commit"]
    return ledger(spark, sf).select("run_path", *[f"structure.{n}" for n in names])


@query(
    "LED4",
    f"WITH {_LEDGER} SELECT run_path, scope, experiment, run_id, CASE WHEN shape='O' THEN 'embedded' ELSE 'path' END AS run_id_source, has_results, completeness, round(accuracy,9) AS accuracy FROM le",
)
def run_ledger(spark, sf):
    return rounded(
        ledger(spark, sf).select(
            "run_path", "scope", "experiment", "run_id", "run_id_source", "has_results", "completeness", "accuracy"
        )
    )


@query(
    "AGG37",
    f"""WITH {_LEDGER}, lf AS (
 SELECT 'totals' AS section, 'all' AS key, unnest(['rows','with_results','without_results','accuracy_rows','results_sha256_rows','created_at_rows','arms_total']) AS metric,
  unnest([1,has_results::INT,(NOT has_results)::INT,(accuracy IS NOT NULL)::INT,has_results::INT,(shape IS NOT DISTINCT FROM 'F')::INT,CASE WHEN shape='O' THEN 2 ELSE 0 END]) AS v FROM le
 UNION ALL SELECT 'by_scope', scope, 'rows', 1 FROM le UNION ALL SELECT 'by_completeness', completeness, 'rows', 1 FROM le
 UNION ALL SELECT 'by_experiment', experiment, unnest(['rows','with_results','accuracy','complete','partial','quarantined']),
  unnest([1,has_results::INT,(accuracy IS NOT NULL)::INT,(completeness='complete')::INT,(completeness='partial')::INT,(completeness='quarantined')::INT]) FROM le
 UNION ALL SELECT 'structure_coverage', 'all', unnest(['has_metrics','has_aggregate','has_arms','has_arm_accuracy','has_partitions','has_model_arms','has_latency','has_elapsed_seconds','has_cost','has_code_commit']),
  unnest([coalesce(shape='F',false)::INT,coalesce(shape='P',false)::INT,coalesce(shape='O',false)::INT,coalesce(shape='O',false)::INT,0,0,coalesce(shape='O',false)::INT,0,0,coalesce(shape='F',false)::INT]) FROM le
 UNION ALL SELECT 'status_totals', 'ok', 'count', o_custkey FROM le WHERE shape='F'
 UNION ALL SELECT 'providers', o_orderpriority, 'rows', 1 FROM le WHERE shape='F')
 SELECT section, key, metric, sum(v)::BIGINT AS value FROM lf GROUP BY ALL
 UNION ALL SELECT 'reused_run_ids', run_id, 'experiments', count(DISTINCT experiment) FROM le GROUP BY run_id HAVING count(DISTINCT experiment)>1""",
)
def ledger_findings(spark, sf):
    return L.ledger_findings(ledger(spark, sf))
