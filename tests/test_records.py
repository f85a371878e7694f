"""Record builders, splits and samples."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assay.operators import records as G
from assay.operators import splits as S
from assay.operators.identity import fingerprint
from assay.operators.rules import check_isolation


def ids(spark, n=500):
    return spark.range(n).select(F.concat(F.lit("s"), "id").alias("id"))


def test_weighted_split_matches_hash(spark):
    got = {r["id"]: r["split"] for r in S.assign_split(ids(spark), "id").collect()}
    for key in ("s0", "s17", "s499"):
        u = int.from_bytes(hashlib.sha256(f"20260920:{key}".encode()).digest()[:8], "big") / 2**64
        assert got[key] == ("train" if u < 0.5 else "dev" if u < 0.7 else "calibration" if u < 0.85 else "test")
    with pytest.raises(ValueError):
        S.assign_split(ids(spark), "id", policy=[("a", 0.5), ("b", 0.4)])


@pytest.mark.parametrize("seed", range(5))
def test_rank_split_counts_are_exact(spark, seed):
    got = S.rank_split(ids(spark, 103), "id", seed, "f", 0.2, 0.3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"dev": 20, "calibration": 30, "test": 53}


def test_samples_ignore_input_order(spark):
    a = S.matched_control(ids(spark), "id", 25, 3)
    b = S.matched_control(ids(spark).orderBy(F.rand(1)).unionByName(ids(spark)), "id", 25, 3)
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()} and a.count() == 25
    with pytest.raises(Exception, match="exceeds"):
        S.matched_control(ids(spark, 5), "id", 6, 3).collect()


def test_short_groups_fail(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, o int")
    assert S.first_n_per_group(df, "g", 1, "o").count() == 2
    with pytest.raises(Exception, match="fewer than 2"):
        S.first_n_per_group(df, "g", 2, "o").collect()


def test_upstream_split(spark):
    df = spark.createDataFrame([("Train", "1"), ("testing", "2")], "s string, id string")
    assert [r["x"] for r in df.select(S.map_upstream_split(F.col("s"), F.col("id")).alias("x")).collect()] == ["train", "test"]
    with pytest.raises(Exception, match="unsupported upstream split"):
        df.select(S.map_upstream_split(F.lit("odd"), F.col("id"))).collect()


def question(spark, choices, answer, kind="array<string>"):
    return spark.createDataFrame([("q1", " What? ", choices, answer, "train")], f"id string, question string, choices {kind}, answer_key string, upstream_split string")


def test_choices(spark):
    got = G.normalize_choices(question(spark, ["x", "y"], "1")).first()
    assert (got["labels"], got["answer_label"]) == (["A", "B"], "B")
    boxed = question(spark, (["1", "2"], ["x", "y"]), "1", "struct<label: array<string>, text: array<string>>")
    assert G.normalize_choices(boxed).first()["answer_label"] == "1"
    for bad in (["x", "y"], "7"), (["x"], "B"):
        with pytest.raises(Exception, match="answer key"):
            G.normalize_choices(question(spark, *bad)).collect()


def test_question_pairs(spark):
    rows = G.normalize_choices(question(spark, ["x", "y", "z"], "B"))
    sources, records = G.pairwise_records(rows)
    r = records.first()
    wrong = ["A", "C"][int.from_bytes(hashlib.sha256(b"20260920:q1:wrong").digest()[:8], "big") % 2]
    first = hashlib.sha256(b"20260920:q1:order").digest()[0] % 2 == 0
    assert r["gold"] == ("A" if first else "B") and r["wrong_label"] == wrong
    assert r["candidate_a" if first else "candidate_b"] == "B) y"
    assert r["prompt"] == "Question: What?\nChoices:\nA) x\nB) y\nC) z"
    assert sources.first()["answer_text"] == "y"
    singles = {x["variant"]: x["candidate_a"] for x in G.single_pair(rows).collect()}
    assert singles == {"correct": "B) y", "wrong": "A) x"}


@pytest.mark.parametrize("answer,right,wrong", [("a #### 1,200", "1200", "1201"), ("#### $3.50", "3.5", "4.5"), ("#### -1", "-1", "0"), ("#### 0.10", "0.1", "1.1")])
def test_numeric_pairs(spark, answer, right, wrong):
    df = spark.createDataFrame([("s", "q", answer, "dev")], "source_problem_id string, question string, answer string, split string")
    got = {r["variant"]: r["candidate_a"] for r in G.numeric_pair(df).collect()}
    assert got == {"correct": f"Final answer: {right}", "wrong": f"Final answer: {wrong}"}


ENTITY = "lei string, legal_name string, entity_category string, legal_jurisdiction string, registration_status string, initial_registration_date string"


def test_registry_claims(spark):
    rows = [("a" * 20, "N", "FUND", "US", "ISSUED", "2020-02-29"), ("b" * 20, "M", "GENERAL", "US", "LAPSED", "soon")]
    e = spark.createDataFrame(rows, ENTITY)
    claims = G.registry_claims(e, 7)
    # one jurisdiction only: that family is skipped
    assert {r["family"] for r in claims.collect()} == {"status", "entity-category"}
    dates = {r["variant"]: r["candidate_a"] for r in G.date_claims(e, 7).collect()}
    assert dates == {"correct": "Answer: 2020-02-29", "wrong": "Answer: 2020-03-01"}
    alias = spark.createDataFrame([("a" * 20, "enn", "a" * 20)], "lei string, alias string, wrong_lei string")
    with pytest.raises(Exception, match="must differ"):
        G.alias_claims(e, alias, 7).collect()


def test_classification_hides_the_target(spark):
    e = spark.createDataFrame([("a" * 20, "N", "FUND", "XX", "ISSUED", "2020-01-01")], ENTITY)
    items = {r["family"]: r for r in G.classification_items(e, {"entity-category": ["FUND"], "registration-status": ["LAPSED"], "legal-jurisdiction": ["US", "OTHER"]}, 7).collect()}
    assert "Entity category: FUND" not in items["entity-category"]["prompt"]
    assert items["registration-status"]["skipped"] and items["registration-status"]["gold"] is None
    assert items["legal-jurisdiction"]["gold"] == "OTHER"


def test_template_slots():
    with pytest.raises(ValueError):
        G.fill_template("{{text}} {{text}}", {"text": F})


def test_swap_is_an_involution_on_gold(spark):
    df = spark.createDataFrame([("1", "pairwise", "x", "y", "A"), ("2", "pairwise", "x", "y", "TIE")], "record_id string, mode string, candidate_a string, candidate_b string, gold string")
    once = G.swap_pairs(df)
    assert {r["gold"] for r in once.collect()} == {"B", "TIE"}
    back = {(r["record_id"], r["candidate_a"], r["gold"]) for r in G.swap_pairs(once).collect()}
    assert back == {("1", "x", "A"), ("2", "x", "TIE")}
    with pytest.raises(Exception, match="only pairwise"):
        G.swap_pairs(df.withColumn("mode", F.lit("single"))).collect()


def test_request_packets_never_hold_gold(spark):
    df = spark.createDataFrame([("1", "single", "p", "c", None, "GOLDEN")], "record_id string, mode string, prompt string, candidate_a string, candidate_b string, gold string")
    assert "GOLDEN" not in G.request_packets(df).first()["packet"]
    with pytest.raises(ValueError):
        G.request_packets(df, ["x", "y"], order=["x", "z"])


def test_training_arms(spark):
    schema = "record_id string, source_problem_id string, mode string, split string, domain string, prompt string, candidate_a string, gold string, criterion_text string"
    rows = spark.createDataFrame(
        [("1", "s1", "single", "train", "d", "p", "c", "pass", "k"), ("2", "s2", "single", "test", "d", "p", "c", "pass", "k"), ("3", "s3", "pairwise", "train", "d", "p", "c", "A", "k")], schema
    )
    hard = spark.createDataFrame([("n1", "s1", "single", "train", "e", "p", "c", "fail", "k")], schema)
    sizes = {arm: G.training_arm(rows, arm, hard, {"d": "other words"}).count() for arm in "ABCD"}
    assert sizes == {"A": 1, "B": 2, "C": 2, "D": 3}
    with pytest.raises(Exception, match="fail labels"):
        G.training_arm(rows, "C", hard.withColumn("gold", F.lit("pass"))).collect()


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_fingerprint_is_stable(spark, parts):
    df = ids(spark).withColumn("x", F.length("id"))
    want = fingerprint(df).first()
    got = fingerprint(df.orderBy(F.rand(parts)).repartition(parts).select("x", "id")).first()
    assert (got["rows"], got["fingerprint"]) == (want["rows"], want["fingerprint"])
    assert fingerprint(df.unionByName(df.limit(1))).first()["fingerprint"] != want["fingerprint"]


@pytest.mark.parametrize("seed", range(4))
def test_case_split_keeps_texts_together(spark, seed):
    df = spark.createDataFrame([(f"text {i % 40}" + " " * (i % 3), i) for i in range(200)], "text string, i int")
    out = df.select(F.trim("text").alias("family"), S.case_split(F.col("text"), "t", seed).alias("split"))
    assert check_isolation(out, "family", "split").count() == 0
