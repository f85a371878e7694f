"""Known values of the metrics, hand-computed."""

import math

import pytest
from pyspark.sql import functions as F

from assay.functions.stats import mcnemar_exact, wilson
from assay.operators import joins as J
from assay.operators import metrics as M
from assay.vocab import lit_array


def one(df):
    return df.collect()[0].asDict()


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [("g", a, b) for a, b in zip("AABBC", "ABBCC")]
    return spark.createDataFrame(rows, "k string, gold string, label string")


def test_label_metrics(labelled):
    got = one(M.label_metrics(labelled, ["k"]))
    assert got["accuracy"] == pytest.approx(0.6)
    assert got["balanced_accuracy"] == pytest.approx(2 / 3)
    assert got["macro_f1"] == pytest.approx(11 / 18)


def test_label_metrics_without_groups(labelled):
    assert one(M.label_metrics(labelled, []))["macro_f1"] == pytest.approx(11 / 18)


def test_declared_class_without_rows_has_zero_f1(labelled):
    assert one(M.macro_f1(labelled, ["k"], ["A", "B", "C", "D"]))["macro_f1"] == pytest.approx(11 / 18 * 3 / 4)


def test_per_class_nulls(spark):
    rows = spark.createDataFrame([("g", "A", "A"), ("g", "B", "A")], "k string, gold string, label string")
    got = {r["class"]: r for r in M.per_class(rows, ["k"], ["A", "B", "C"]).collect()}
    assert got["B"]["precision"] is None and got["B"]["recall"] == 0 and got["B"]["f1"] == 0
    assert got["C"]["support"] == 0 and got["C"]["f1"] is None


@pytest.fixture(scope="module")
def probable(spark):
    rows = [("g", "A", "A", {"A": 0.8, "B": 0.2}), ("g", "B", "B", {"A": 0.3, "B": 0.7})]
    return spark.createDataFrame(rows, "k string, gold string, label string, probabilities map<string,double>")


def test_probability_metrics(probable):
    got = one(M.probability_metrics(probable, ["k"], lit_array("AB")))
    assert got["brier"] == pytest.approx(0.13)
    assert got["nll"] == pytest.approx(-(math.log(0.8) + math.log(0.7)) / 2)
    assert got["ece"] == pytest.approx(0.25)


def test_one_missing_map_nulls_the_slice(spark, probable):
    more = probable.unionByName(spark.createDataFrame([("g", "A", "A", None)], probable.schema))
    got = one(M.probability_metrics(more, ["k"], lit_array("AB")))
    assert got["brier"] is None and got["nll"] is None and got["ece"] is None
    assert one(M.probability_metrics(more, ["k"], lit_array("AB"), missing="drop"))["brier"] == pytest.approx(0.13)


def test_gold_outside_classes_fails(spark, probable):
    with pytest.raises(Exception, match="outside the class order"):
        M.nll(probable, ["k"], lit_array(["B", "C"])).collect()


@pytest.mark.parametrize("value,want", [(0.0, 0), (0.1, 1), (0.3, 3), (0.6, 6), (0.7, 7), (0.9, 9), (1.0, 9)])
def test_bins_use_literal_edges(spark, value, want):
    df = spark.range(1).select(M.bin_index(F.lit(value), 10).alias("b"))
    assert df.first()["b"] == want


def test_latency_summary(spark):
    rows = spark.createDataFrame([("g", float(x)) for x in (10, 20, 30, 40, 50)], "k string, latency_ms double")
    got = one(M.latency_summary(rows, ["k"]))
    assert (got["count"], got["mean_ms"], got["median_ms"]) == (5, 30, 30)
    assert got["p95_ms"] == pytest.approx(48)
    assert one(M.latency_summary(rows, ["k"], "nearest"))["p95_ms"] == 50
    assert one(M.latency_summary(rows, ["k"], "floor"))["median_ms"] == 30


def test_negative_latency_fails(spark):
    rows = spark.createDataFrame([("g", -1.0)], "k string, latency_ms double")
    with pytest.raises(Exception, match="non-negative"):
        M.latency_summary(rows, ["k"]).collect()


def test_wilson(spark):
    df = spark.createDataFrame([(684, 760), (0, 0)], "k bigint, n bigint")
    full, none = df.select(wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert full["w"]["lower"] == pytest.approx(0.8766185431070428, abs=1e-12)
    assert full["w"]["upper"] == pytest.approx(0.9193581520290133, abs=1e-12)
    assert none["w"]["lower"] is None
    unit = df.filter("n = 0").select(wilson(F.col("k"), F.col("n"), "unit").alias("w")).first()
    assert (unit["w"]["lower"], unit["w"]["upper"]) == (0.0, 1.0)


def exact(b, c):
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    return min(1.0, float(2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n))


def test_mcnemar_matches_integers(spark):
    pairs = [(0, 0), (0, 5), (3, 3), (1, 0), (2, 9), (16, 15), (40, 70), (400, 450), (400, 900), (999, 1001)]
    got = spark.createDataFrame(pairs, "b bigint, c bigint").select("b", "c", mcnemar_exact(F.col("b"), F.col("c")).alias("p"))
    for r in got.collect():
        assert r["p"] == pytest.approx(exact(r["b"], r["c"]), rel=1e-11), (r["b"], r["c"])


def test_mcnemar_of_huge_counts(spark):
    df = spark.createDataFrame([(10**9, 10**9 + 40_000)], "b bigint, c bigint")
    p = df.select(mcnemar_exact(F.col("b"), F.col("c")).alias("p")).first()["p"]
    z = (40_000 - 1) / math.sqrt(2 * 10**9 + 40_000)
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_majority_baseline_tie(spark):
    rows = spark.createDataFrame([("g", x) for x in "BBAAC"], "k string, gold string")
    got = one(M.majority_baseline(rows, ["k"]))
    assert (got["label"], got["tie"], got["accuracy"]) == ("A", True, 0.4)


def test_swap_consistency(spark):
    left = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "TIE")], "record_id string, label string")
    right = spark.createDataFrame([("1", "B"), ("2", "A"), ("3", "TIE")], "source_record_id string, label string")
    assert one(M.swap_consistency(left, right))["swap_consistency"] == 1.0


def test_failed_calls_are_not_wrong_answers(spark):
    recs = spark.createDataFrame([("1", "pass"), ("2", "pass"), ("3", "fail")], "record_id string, gold string")
    preds = spark.createDataFrame(
        [("j", "1", "pass", "ok"), ("j", "2", None, "rate_limited"), ("j", "3", "pass", "ok")],
        "judge_id string, record_id string, label string, execution_status string",
    )
    got = one(M.judge_summary(J.join_scored(recs, preds), ["judge_id"]))
    assert got["coverage"] == pytest.approx(2 / 3)
    assert got["conditional_accuracy"] == 0.5
    assert got["all_record_accuracy"] == pytest.approx(1 / 3)


def test_protocol_gate_keeps_baseline(spark):
    rows = [("base", 100, 1.0, 0.5), ("better", 100, 1.0, 0.59), ("thin", 10, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "variant string, resolved bigint, coverage double, selection_score double")
    got = one(M.select_protocol(df, "base"))
    assert got["selected_variant"] == "base" and not got["gate_passed"]
    more = df.unionByName(spark.createDataFrame([("good", 70, 0.96, 0.61)], df.schema))
    assert one(M.select_protocol(more, "base"))["selected_variant"] == "good"
