"""Rows travel narrow: keys before texts, digests as bytes."""

from assay.operators import records as G
from assay.operators import splits as S
from assay.plans import load_entries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def aggregates(spark, name):
    plan = load_entries()[name].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Aggregate [" in line]


def test_code_candidates_are_made_distinct_by_their_keys(spark):
    assert not [line for line in aggregates(spark, "code_candidate_records") if "Aggregate [record_id" in line]


def test_first_links_need_no_distinct_lines(spark):
    assert not [line for line in aggregates(spark, "first_link_per_part") if "l_linenumber" in line.split("]")[0]]


def test_first_per_key_keeps_other_columns_and_repeated_rows_count_once(spark):
    rows = [(i % 7, i, {"a": i}) for i in range(40)] * 2
    df = spark.createDataFrame(rows, "k int, t int, m map<string,int>")
    got = S.first_per_key(df, "k", 3, "f", ["t"], 5).collect()
    want = {}
    for r in df.select("k", "t", "m", S.hash_rank(3, "f", F.col("t")).alias("h")).collect():
        want[r.k] = min(want.get(r.k, (r.h, r.t)), (r.h, r.t))
    best = sorted((h, t, k) for k, (h, t) in want.items())[:5]
    assert sorted((r.hash_rank, r.t, r.k) for r in got) == best and all(r.m == {"a": r.t} for r in got)


def test_gold_ids_match_as_text(spark):
    df = spark.createDataFrame([("T1", "p", "c", "o", 1, "test")], "task_id string, prompt string, candidate_code string, candidate_origin string, candidate_slot int, split string")
    first = G.code_records(df, spark.createDataFrame([("x", "pass")], "record_id string, label string"), "d", "r")
    assert first.count() == 0
    fields = {"dataset_id": F.lit("d"), "dataset_revision": F.lit("r"), "task_id": F.col("task_id"), "candidate_sha256": F.sha2("candidate_code", 256)}
    fields |= {"candidate_origin": F.col("candidate_origin"), "candidate_slot": F.col("candidate_slot")}
    own = df.select(G.content_id(fields)).first()[0]
    gold = spark.createDataFrame([(own, "pass"), (own.upper(), "fail"), (own + "\n", "fail")], "record_id string, label string")
    assert [(r.record_id, r.gold, r.prompt) for r in G.code_records(df, gold, "d", "r").collect()] == [(own, "pass", "p\n\nCandidate completion:\nc")]
