"""Every rule finds its bad row and passes the good ones."""

import pytest
from pyspark.sql import functions as F

from assay.operators import rules as V
from assay.vocab import lit_array


def found(df):
    return sorted((r["rule"], r["key"]) for r in df.collect())


RECORD = "record_id string, source_problem_id string, mode string, prompt string, candidate_a string, candidate_b string, gold string, split string, rubric array<string>"


@pytest.mark.parametrize(
    "change,rule",
    [
        ({}, None),
        ({"record_id": ""}, "record_id"),
        ({"mode": "pairwise", "gold": "A"}, "pairwise_b"),
        ({"candidate_b": "x"}, "single_b"),
        ({"mode": "pairwise", "candidate_b": "x"}, "pairwise_label"),
        ({"rubric": []}, "rubric"),
        ({"split": "holdout"}, "split"),
        ({"prompt": None}, "prompt"),
    ],
)
def test_record_shape(spark, change, rule):
    row = {"record_id": "1", "source_problem_id": "s", "mode": "single", "prompt": "p", "candidate_a": "a", "candidate_b": None, "gold": "pass", "split": "dev", "rubric": ["r"]}
    df = spark.createDataFrame([tuple((row | change).values())], RECORD)
    assert [r for r, _ in found(V.check_records(df))] == ([rule] if rule else [])


@pytest.mark.parametrize(
    "p,classes,bad",
    [
        ({"A": 0.5, "B": 0.5}, None, False),
        (None, None, False),
        ({}, None, True),
        ({"A": 0.5, "B": 0.4}, None, True),
        ({"A": 1.5, "B": -0.5}, None, True),
        ({"A": float("nan"), "B": 1.0}, None, True),
        ({"A": 0.5, "B": 0.5}, ["A"], True),
        ({"A": 1.0, "Z": 0.7}, ["A", "B"], False),
    ],
)
def test_probabilities(spark, p, classes, bad):
    df = spark.createDataFrame([("1", p)], "record_id string, probabilities map<string,double>")
    assert bool(V.check_probabilities(df, lit_array(classes) if classes else None).count()) == bad


def test_prediction_states(spark):
    rows = [("j", "1", "ok", "pass", 1.0), ("j", "2", "ok", None, 1.0), ("j", "3", "lost", "pass", 1.0), ("j", "4", "skipped", None, -1.0)]
    df = spark.createDataFrame(rows, "judge_id string, record_id string, execution_status string, label string, latency_ms double")
    assert found(V.check_predictions(df)) == [("latency", "j|4"), ("ok_label", "j|2"), ("status", "j|3")]


def test_enforce_names_the_row(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    with pytest.raises(V.RuleViolation, match="2 rows share the key"):
        V.enforce(V.check_unique(df, ["id"]))
    V.enforce(V.check_unique(df.distinct(), ["id"]))


def test_coverage_reports_both_sides(spark):
    a = spark.createDataFrame([("1",), ("2",)], "record_id string")
    b = spark.createDataFrame([("2",), ("3",)], "record_id string")
    assert sorted((r["key"], r["detail"]) for r in V.check_coverage(a, b).collect()) == [("1", "missing"), ("3", "extra")]


def test_isolation(spark):
    df = spark.createDataFrame([("f", "train"), ("f", "test"), ("g", "dev"), ("g", "dev")], "family string, split string")
    assert found(V.check_isolation(df, "family", "split")) == [("isolation", "f")]


def test_aliases_keep_the_target(spark):
    df = spark.createDataFrame([("x", "y", "z")], "record_id string, id string, model string")
    out = V.normalize_aliases(df, {"record_id": ("id", "stable_id"), "judge_id": ("model_id", "model")})
    assert out.first().asDict() == {"record_id": "x", "judge_id": "z"}


def test_task_rows(spark):
    rows = [("1", " Yes ", "t"), ("1", "No", "t"), ("-2", "No", "t"), ("x", "No", "t"), ("4", "maybe", "t"), ("5", "No", " \t")]
    df = spark.createDataFrame(rows, "index string, answer string, text string")
    assert found(V.check_task_rows(df)) == [("answer", "4"), ("index", "-2"), ("index", "x"), ("text", "5"), ("unique", "1")]


@pytest.mark.parametrize("policy,want", [("keep_ok", [("retry_over_ok", "j|1")]), ("parse_errors_only", [("retry_target", "j|1"), ("unresolved", "j|3")])])
def test_retry_policies(spark, policy, want):
    schema = "judge_id string, record_id string, execution_status string"
    base = spark.createDataFrame([("j", "1", "ok"), ("j", "2", "parse_error"), ("j", "3", "parse_error")], schema)
    retry = spark.createDataFrame([("j", "1", "ok"), ("j", "2", "ok")], schema)
    assert found(V.check_retry(base, retry, policy)) == want


def test_training_leaks(spark):
    rows = spark.createDataFrame(
        [("r1", "f1", "train"), ("r2", "f2", "test"), ("r3", "f3", "train"), ("r3", "f3", "train")], "row_id string, source_problem_id string, source_split string"
    )
    test = spark.createDataFrame([("f1",)], "source_problem_id string")
    assert found(V.check_training(rows, test)) == [("shared_family", "r1"), ("test_split", "r2"), ("unique", "r3")]


def test_leaks_and_vocabulary(spark):
    df = spark.createDataFrame([("1", "a\nCategory: X", "pick", "X"), ("2", "a", "say X", "X"), ("3", "a", "pick", "X")], "id string, p string, c string, g string")
    assert found(V.check_leaks(df, "id", "p", "c", "g", F.lit("Category: "))) == [("candidate_leak", "2"), ("prompt_leak", "1")]
    assert found(V.check_vocabulary(df, "p", ["a"])) == [("vocabulary", "a\nCategory: X")]
