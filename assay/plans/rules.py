"""Queries of the data-quality rules, over rows where each rule finds something."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import joins as J
from assay.operators import rules as V
from assay.operators import splits as S
from assay.plans import derive as D
from assay.plans.registry import query
from assay.vocab import class_order


def _bad(table: str, key: str, *rules: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {key} AS key, '{detail}' AS detail FROM {table} WHERE {where}" for rule, where, detail in rules
    )


@query(
    "VAL1",
    "SELECT event_id::VARCHAR AS record_id, event_type AS judge_id, value AS latency_ms, props AS provider_metadata FROM events",
)
def alias_columns(spark, sf):
    rows = D.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("stable_id"),
        F.col("event_type").alias("model_id"),
        F.col("event_type").alias("model"),
        F.col("value").alias("latency"),
        F.col("props").alias("runtime_metadata"),
    )
    return V.normalize_aliases(
        rows,
        {
            "record_id": ("id", "stable_id"),
            "judge_id": ("model_id", "model"),
            "latency_ms": ("latency",),
            "provider_metadata": ("runtime_metadata",),
        },
    )


_BROKEN = """br AS (SELECT record_id, source_problem_id, split, mode,
  CASE WHEN ordinal%17=0 THEN '' ELSE prompt END AS prompt, candidate_a,
  CASE WHEN mode='pairwise' AND ordinal%19=0 THEN NULL WHEN mode='single' AND ordinal%23=0 THEN 'x' ELSE candidate_b END AS candidate_b,
  CASE WHEN mode='pairwise' AND ordinal%29=0 THEN 'pass' ELSE gold END AS gold FROM rec)"""


@query(
    "VAL2",
    "WITH "
    + ",\n".join([D.REC, _BROKEN])
    + " "
    + _bad(
        "br",
        "record_id",
        ("prompt", "prompt=''", "prompt must not be empty"),
        ("pairwise_b", "mode='pairwise' AND candidate_b IS NULL", "pairwise records require candidate_b"),
        ("single_b", "mode='single' AND candidate_b IS NOT NULL", "single records must not include candidate_b"),
        ("pairwise_label", "mode='pairwise' AND gold NOT IN ('A','B','TIE')", "pairwise gold label must be A, B, or TIE"),
    ),
)
def record_shape_rule(spark, sf):
    o, pair = F.col("ordinal"), F.col("mode") == "pairwise"
    broken = D.records(spark, sf).withColumns(
        {
            "prompt": F.when(o % 17 == 0, "").otherwise(F.col("prompt")),
            "candidate_b": F.when(pair & (o % 19 == 0), None).when(~pair & (o % 23 == 0), "x").otherwise(F.col("candidate_b")),
            "gold": F.when(pair & (o % 29 == 0), "pass").otherwise(F.col("gold")),
        }
    )
    return V.check_records(broken)


@query(
    "VAL3",
    D.scored_with(
        """pb AS (SELECT record_id, CASE WHEN ordinal%5=0 THEN p1+0.25 WHEN ordinal%7=0 THEN p1-1.5 ELSE p1 END AS a, p2 AS b, coalesce(p3,0.0) AS c
  FROM sc WHERE has_p)"""
    )
    + """ SELECT 'probability_range' AS rule, record_id AS key, 'probabilities must be finite values in [0, 1]' AS detail FROM pb WHERE a<0 OR a>1
 UNION ALL SELECT 'probability_sum', record_id, 'probabilities must sum to 1' FROM pb WHERE a BETWEEN 0 AND 1 AND abs(a+b+c-1)>1e-6""",
)
def probability_rule(spark, sf):
    first = class_order(F.col("mode"))[0]
    shift = F.when(F.col("ordinal") % 5 == 0, 0.25).when(F.col("ordinal") % 7 == 0, -1.5).otherwise(0.0)
    moved = F.transform_values("probabilities", lambda k, v: F.when(k == first, v + shift).otherwise(v))
    return V.check_probabilities(D.scored(spark, sf).withColumn("probabilities", moved), class_order(F.col("mode")))


@query(
    "VAL4",
    """SELECT rule, event_type||'|'||event_id AS key, detail FROM (
 SELECT 'status' AS rule, event_type, event_id, 'unknown execution status' AS detail FROM events WHERE event_type NOT IN ('error','view')
 UNION ALL SELECT 'ok_label', event_type, event_id, 'successful predictions require a label' FROM events WHERE event_type='view' AND value<5
 UNION ALL SELECT 'latency', event_type, event_id, 'latency must be non-negative' FROM events WHERE value<2)""",
)
def prediction_state_rule(spark, sf):
    e = D.table(spark, sf, "events")
    rows = e.select(
        F.col("event_type").alias("judge_id"),
        F.col("event_id").cast("string").alias("record_id"),
        F.when(F.col("event_type") == "view", "ok")
        .when(F.col("event_type") == "error", "provider_error")
        .otherwise(F.col("event_type"))
        .alias("execution_status"),
        F.when(F.col("value") >= 5, "pass").alias("label"),
        (F.col("value") - 2).alias("latency_ms"),
    )
    return V.check_predictions(rows)


@query(
    "VAL5",
    """SELECT 'unique' AS rule, l_orderkey||'|'||l_partkey AS key, count(*)||' rows share the key' AS detail
 FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*)>1""",
)
def key_uniqueness_rule(spark, sf):
    return V.check_unique(D.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "VAL6",
    """SELECT 'coverage' AS rule, doc_id::VARCHAR AS key, 'missing' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
 UNION ALL SELECT 'coverage', doc_id::VARCHAR, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def id_coverage_rule(spark, sf):
    return V.check_coverage(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), "doc_id")


@query(
    "VAL7",
    f"""SELECT 'isolation' AS rule, p AS key, 'family spans '||min(s)||' and '||max(s) AS detail FROM (
 SELECT l_partkey::VARCHAR AS p, {D.split_sql("l_orderkey")} AS s FROM lineitem) GROUP BY p HAVING min(s)<>max(s)""",
)
def split_isolation_rule(spark, sf):
    rows = S.assign_split(D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    return V.check_isolation(rows, "l_partkey", "split")


@query(
    "VAL8",
    """WITH c AS (SELECT c_name AS id, 'Name: '||c_name||chr(10)||CASE WHEN c_custkey%3=0 THEN 'Segment: '||c_mktsegment ELSE 'Segment hidden' END AS prompt,
  CASE WHEN c_custkey%4=0 THEN 'It is '||c_mktsegment ELSE 'Pick one option.' END AS cand, c_mktsegment AS gold FROM customer)
 SELECT 'prompt_leak' AS rule, id AS key, 'masked field appears as a prompt line' AS detail FROM c WHERE contains(prompt, chr(10)||'Segment: ')
 UNION ALL SELECT 'candidate_leak', id, 'gold label appears in the candidate' FROM c WHERE contains(cand, gold)""",
)
def answer_leak_rule(spark, sf):
    c, key = D.table(spark, sf, "customer"), F.col("c_custkey")
    hidden = F.when(key % 3 == 0, F.concat(F.lit("Segment: "), "c_mktsegment")).otherwise("Segment hidden")
    rows = c.select(
        F.col("c_name").alias("id"),
        F.concat(F.lit("Name: "), "c_name", F.lit("\n"), hidden).alias("prompt"),
        F.when(key % 4 == 0, F.concat(F.lit("It is "), "c_mktsegment")).otherwise("Pick one option.").alias("cand"),
        F.col("c_mktsegment").alias("gold"),
    )
    return V.check_leaks(rows, "id", "prompt", "cand", "gold", F.lit("Segment: "))


@query(
    "VAL9",
    """SELECT 'vocabulary' AS rule, o_orderpriority AS key, count(*)||' rows outside the label set' AS detail FROM orders
 WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH') GROUP BY ALL""",
)
def vocabulary_rule(spark, sf):
    return V.check_vocabulary(D.table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(
    "VAL10",
    """WITH r AS (SELECT doc_id, text, CASE WHEN doc_id%3=0 THEN 'weak_model_supervision' WHEN doc_id%3=1 THEN 'answer_key' ELSE 'deterministic_verifier' END AS provenance FROM documents)
 SELECT 'banned:license' AS rule, doc_id::VARCHAR AS key, 'row mentions license' AS detail FROM r
 WHERE provenance<>'weak_model_supervision' AND contains(lower(text),'license')""",
)
def provenance_rule(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    prov = (
        F.when(F.col("doc_id") % 3 == 0, "weak_model_supervision")
        .when(F.col("doc_id") % 3 == 1, "answer_key")
        .otherwise("deterministic_verifier")
    )
    return V.check_provenance(V.trusted_records(d.withColumn("provenance", prov)), ["license"], "doc_id")


@query(
    "VAL11",
    """WITH t AS (SELECT CASE WHEN conv_id%11=0 THEN '-1' WHEN conv_id%13=0 THEN 'x' ELSE conv_id::VARCHAR END AS idx,
  CASE role WHEN 'user' THEN ' Yes ' WHEN 'assistant' THEN 'No' ELSE 'maybe' END AS answer, text FROM conversations)
 SELECT 'index' AS rule, idx AS key, 'index must be a non-negative integer' AS detail FROM t WHERE try_cast(idx AS BIGINT) IS NULL OR try_cast(idx AS BIGINT)<0
 UNION ALL SELECT 'answer', idx, 'unsupported answer label' FROM t WHERE answer='maybe'
 UNION ALL SELECT 'text', idx, 'text must be non-empty' FROM t WHERE trim(text)=''
 UNION ALL SELECT 'unique', i::VARCHAR, count(*)||' rows share the key' FROM (SELECT try_cast(idx AS BIGINT) AS i FROM t) WHERE i IS NOT NULL GROUP BY i HAVING count(*)>1""",
)
def task_row_rule(spark, sf):
    conv, key = D.table(spark, sf, "conversations"), F.col("conv_id")
    rows = conv.select(
        F.when(key % 11 == 0, "-1").when(key % 13 == 0, "x").otherwise(key.cast("string")).alias("index"),
        F.when(F.col("role") == "user", " Yes ").when(F.col("role") == "assistant", "No").otherwise("maybe").alias("answer"),
        "text",
    )
    return V.check_task_rows(rows)


@query(
    "VAL12",
    """WITH t AS (SELECT ' t'||(p_partkey//2)||' ' AS task_id, CASE WHEN p_partkey%9=0 THEN '  ' ELSE p_name END AS prompt FROM part)
 SELECT 'prompt' AS rule, task_id AS key, 'prompt must be a non-empty string' AS detail FROM t WHERE trim(prompt)=''
 UNION ALL SELECT 'unique', trim(task_id), count(*)||' rows share the key' FROM t GROUP BY task_id HAVING count(*)>1""",
)
def code_row_rule(spark, sf):
    p, key = D.table(spark, sf, "part"), F.col("p_partkey")
    rows = p.select(
        F.concat(F.lit(" t"), F.floor(key / 2).cast("string"), F.lit(" ")).alias("task_id"),
        F.when(key % 9 == 0, "  ").otherwise(F.col("p_name")).alias("prompt"),
        F.col("p_brand").alias("entry_point"),
        F.col("p_type").alias("canonical_solution"),
        F.col("p_name").alias("test"),
    )
    return V.check_code_rows(rows)


@query(
    "VAL13",
    D.scored_with(
        D.PRED_RETRY,
        "rt AS (SELECT redo.* FROM redo JOIN pred USING (judge_id, record_id) WHERE pred.execution_status<>'ok' OR pred.latency_ms>800)",
        "jr AS (SELECT p.judge_id||'|'||p.record_id AS key, p.execution_status AS b, rt.execution_status AS r FROM pred p LEFT JOIN rt ON rt.judge_id=p.judge_id AND rt.record_id=p.record_id)",
    )
    + """ SELECT 'keep_ok' AS policy, 'retry_over_ok' AS rule, key, 'a retry may not overwrite an ok row' AS detail FROM jr WHERE r IS NOT NULL AND b='ok'
 UNION ALL SELECT 'parse_errors_only', 'retry_target', key, 'only parse_error rows may be retried' FROM jr WHERE r IS NOT NULL AND b<>'parse_error'
 UNION ALL SELECT 'parse_errors_only', 'unresolved', key, 'a parse_error remains after the retry' FROM jr WHERE coalesce(r,b)='parse_error'""",
)
def retry_legality_rule(spark, sf):
    recs = D.bare_records(spark, sf)
    base = D.predictions(recs)
    called = base.filter("execution_status <> 'ok' OR latency_ms > 800").select("judge_id", "record_id")
    retry = D.predictions(recs, seed=43).join(called, ["judge_id", "record_id"], "left_semi")
    parts = [
        V.check_retry(base, retry, policy).withColumn("policy", F.lit(policy)) for policy in ("keep_ok", "parse_errors_only")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "VAL14",
    f"""WITH t AS (SELECT l_orderkey||':'||l_linenumber AS row_id, l_partkey AS source_problem_id, {D.split_sql("l_orderkey")} AS source_split FROM lineitem),
 te AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag='R' AND l_quantity=50)
 SELECT 'test_split' AS rule, row_id AS key, 'a test row entered training' AS detail FROM t WHERE source_split='test'
 UNION ALL SELECT 'shared_family', row_id, 'source family is in the test set' FROM t WHERE source_problem_id IN (SELECT l_partkey FROM te)
 UNION ALL SELECT 'unique', row_id, count(*)||' rows share the key' FROM t GROUP BY row_id HAVING count(*)>1""",
)
def training_leak_rule(spark, sf):
    li = D.table(spark, sf, "lineitem")
    rows = S.assign_split(
        li.select(
            F.concat_ws(":", "l_orderkey", "l_linenumber").alias("row_id"),
            "l_orderkey",
            F.col("l_partkey").alias("source_problem_id"),
        ),
        "l_orderkey",
        name="source_split",
    )
    test = li.filter("l_returnflag = 'R' AND l_quantity = 50").select(F.col("l_partkey").alias("source_problem_id"))
    return V.check_training(rows, test)


@query(
    "SET2",
    """SELECT coalesce(a.doc_id,b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both'
 WHEN a.doc_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS kind
 FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id=b.doc_id""",
)
def id_set_overlap(spark, sf):
    return V.overlap(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), "doc_id")


@query(
    "JN2",
    D.scored_with(D.PRED_RETRY)
    + """ SELECT judge_id, record_id, CASE WHEN p.execution_status='ok' THEN p.label ELSE r.label END AS label,
 CASE WHEN p.execution_status='ok' THEN 'ok' ELSE r.execution_status END AS execution_status FROM pred p JOIN redo r USING (judge_id, record_id)""",
)
def first_ok_merge(spark, sf):
    recs = D.bare_records(spark, sf)
    runs = [D.predictions(recs), D.predictions(recs, seed=43)]
    return J.merge_runs([r.select("judge_id", "record_id", "label", "execution_status") for r in runs])


@query(
    "JN3",
    D.scored_with(D.PRED_RETRY, "bad AS (SELECT judge_id, record_id FROM pred WHERE execution_status<>'ok')")
    + """ SELECT p.judge_id, p.record_id, CASE WHEN b.judge_id IS NULL THEN 'base' ELSE 'retry' END AS origin,
 CASE WHEN b.judge_id IS NULL THEN p.label ELSE r.label END AS label,
 CASE WHEN b.judge_id IS NULL THEN p.execution_status ELSE r.execution_status END AS execution_status
 FROM pred p JOIN redo r USING (judge_id,record_id) LEFT JOIN bad b ON b.judge_id=p.judge_id AND b.record_id=p.record_id""",
)
def retry_preferred_merge(spark, sf):
    recs = D.bare_records(spark, sf)
    cols = ["judge_id", "record_id", "label", "execution_status"]
    base = D.predictions(recs).select(*cols)
    failed = base.filter("execution_status <> 'ok'").select("judge_id", "record_id")
    retry = D.predictions(recs, seed=43).select(*cols).join(failed, ["judge_id", "record_id"], "left_semi")
    return J.merge_retry(base, retry)


@query(
    "JN4",
    """SELECT 'pending' AS kind, NULL AS judge_id, doc_id::VARCHAR AS record_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
 UNION ALL SELECT 'retry', judge_id, record_id FROM ("""
    + D.scored_with()
    + " SELECT judge_id, record_id FROM sc WHERE execution_status='rate_limited')",
)
def resume_candidates(spark, sf):
    todo = J.pending(D.table(spark, sf, "documents").select("doc_id"), D.table(spark, sf, "labels"), "doc_id")
    again = J.retry_candidates(D.predictions(D.bare_records(spark, sf)), "rate_limited")
    return todo.select(
        F.lit("pending").alias("kind"), F.lit(None).cast("string").alias("judge_id"), F.col("doc_id").cast("string").alias("record_id")
    ).unionByName(again.select(F.lit("retry").alias("kind"), "judge_id", "record_id"))


@query(
    "JN10",
    """SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END,'unknown') AS domain
 FROM documents LEFT JOIN labels USING (doc_id)""",
)
def dimension_lookup(spark, sf):
    dim = D.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("domain"))
    return J.with_dimension(D.table(spark, sf, "documents").select("doc_id"), dim, "doc_id", "domain")
