"""Selective risk, thresholds, ranks; brute force and partition independence."""

import random

import pytest
from pyspark.sql import functions as F

from assay.operators import joins as J
from assay.operators import ranking as R
from assay.operators.running import row_numbers, running_totals


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ordinal bigint, confidence double, correct int")


def test_risk_coverage_known_values(spark):
    df = frame(spark, [("g", 0, 0.9, 1), ("g", 1, 0.8, 0), ("g", 2, 0.7, 1)])
    got = sorted((r["rank"], r["coverage"], r["risk"]) for r in R.risk_coverage(df, ["k"]).collect())
    assert [x[1] for x in got] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert [x[2] for x in got] == pytest.approx([0, 0, 0.5, 1 / 3])


def random_rows(seed, n=400):
    rng = random.Random(seed)
    # two groups, one of them hot, with many tied confidences
    return [("hot" if rng.random() < 0.8 else "cold", i, rng.randint(0, 20) / 20, int(rng.random() < 0.7)) for i in range(n)]


def brute_threshold(rows, target):
    points = []
    for t in sorted({0.0, 1.0, *(r[2] for r in rows)}, reverse=True):
        inside = [r for r in rows if r[2] >= t]
        errors = sum(1 - r[3] for r in inside)
        points.append((t, len(inside), errors, errors / len(inside) if inside else 0.0))
    good = [p for p in points if p[3] <= target]
    return max(good, key=lambda p: (p[1], p[0])) if good else points[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_threshold_selection_against_brute_force(spark, seed):
    rows = random_rows(seed)
    got = R.select_threshold(frame(spark, rows), ["k"], (0.1, 0.25, 0.3)).collect()
    assert len(got) == 6
    for r in got:
        want = brute_threshold([x for x in rows if x[0] == r["k"]], r["target_error"])
        assert (r["threshold"], r["accepted_count"], r["error_count"]) == want[:3]


def test_threshold_without_groups(spark):
    rows = random_rows(9)
    got = R.select_threshold(frame(spark, rows).drop("k"), [], (0.3,)).first()
    assert (got["threshold"], got["accepted_count"]) == brute_threshold(rows, 0.3)[:2]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_running_totals_do_not_depend_on_partitions(spark, parts):
    rows = random_rows(5, 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = frame(spark, rows).orderBy(F.rand(parts)).repartition(parts)
        order = [F.col("confidence").desc(), F.col("ordinal").asc()]
        out = running_totals(df, ["k"], order, {"rank": F.lit(1), "hits": F.col("correct")})
        got = {r["ordinal"]: (r["rank"], r["hits"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for k in ("hot", "cold"):
        hits = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])), 1):
            hits += r[3]
            want[r[1]] = (n, hits)
    assert got == want


def test_null_group_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = {r["v"]: r["n"] for r in row_numbers(df, ["k"], [F.col("v").asc()], "n").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_target_coverage_empty_point(spark):
    df = frame(spark, [("g", 0, 0.9, 0), ("g", 1, 0.8, 0)])
    r = R.target_coverage(df, ["k"], (0.05,)).first()
    assert (r["accepted_count"], r["risk"], r["threshold"], r["coverage"]) == (0, 0.0, 1.0, 0.0)
    assert not r["confidence_supported"] and r["claim_status"] == "descriptive"


def test_holm_known_values(spark):
    df = spark.createDataFrame([("a", "x", 0.01), ("b", "x", 0.04), ("c", "x", 0.03)], "left string, right string, p double")
    got = {r["left"]: r["h"] for r in R.holm(df, [], "p", ["left", "right"], "h").collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_judge_pairs_equal_self_join(spark):
    rng = random.Random(3)
    rows = [
        (j, str(i), rng.choice("AB"), int(rng.random() < 0.9), rng.choice([0, 1])) for j in "wxyz" for i in range(60) if rng.random() < 0.9
    ]
    df = spark.createDataFrame(rows, "judge_id string, record_id string, label string, resolved int, correct int")
    table = J.judge_pairs(df)
    got = {(r["left"], r["right"]): r["n"] for r in table.groupBy("left", "right").agg(F.sum("n").alias("n")).collect()}
    ids = {j: {r[1] for r in rows if r[0] == j} for j in "wxyz"}
    assert got == {(a, b): len(ids[a] & ids[b]) for a in "wxyz" for b in "wxyz" if a < b}


def test_shared_ranks(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "judge_id string, all_record_rank int")
    p = {("a", "b"): 0.5, ("a", "c"): 0.01, ("c", "d"): 0.2, ("a", "d"): 0.001, ("b", "c"): 0.9, ("b", "d"): 0.9}
    tests = spark.createDataFrame([(*k, v) for k, v in p.items()], "left string, right string, all_p_holm double")
    got = {r["judge_id"]: r["shared_rank"] for r in R.shared_ranks(ranked, tests).collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": 3}


def test_risk_curves_carry_only_what_they_rank(spark, monkeypatch):
    """The checkpointed slabs hold neither maps nor texts, and the group size needs no second ranking."""
    from assay.operators import running

    seen = []
    cut = running.cut_lineage
    monkeypatch.setattr(running, "cut_lineage", lambda df: seen.append(df.columns) or cut(df))
    rows = [(k, 0.9 - i / 100, i, i % 2, "long text") for k in ("a", None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, confidence double, ordinal long, correct int, text string")
    got = R.ranked_by_confidence(df, ["k"])
    assert {(r["k"], r["rank"], r["hits"], r["size"]) for r in got.collect()} == {
        (k, i + 1, (i + 1) // 2, 5) for k in ("a", None) for i in range(5)
    }
    assert len(seen) == 1 and "text" not in seen[0]
