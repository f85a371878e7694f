"""Numbers of any length, checks that no column pruning removes, and repeated keys."""

import pytest
from pyspark.sql import functions as F

from assay.functions import verifiers as V
from assay.operators import joins, metrics, records
from assay.operators.splits import bernoulli_top
from assay.session import ensure_checkpoint_dir
from assay.sources.readers import read_corpus
from tests.test_functions import value


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("1e-20", "0", False),
        ("1.5e-19", "1.6e-19", False),
        ("1E+30", "1" + "0" * 30, True),
        ("1e40", "1" + "0" * 40, True),
        ("12.50e-1", "1.25", True),
        ("-0.00", "0e9", True),
        ("1_000", "1,000", True),
        ("Infinity", "inf", True),
        ("-inf", "inf", False),
        ("1e500", "10e499", True),
        ("1e500", "1e501", False),
        (".5e1", "5", True),
        ("123456789012345678901234567890.12345678901234567890", "123456789012345678901234567890.1234567890123456789", True),
        ("1e99999999999999999999", "1", False),
        ("five", "5", False),
    ],
)
def test_numbers_compare_exactly(spark, a, b, same):
    assert value(spark, V.verify_numeric(F.lit(a), F.lit(b)))["is_correct"] is same


@pytest.mark.parametrize(
    "x,want",
    [
        ("0.123456789012", "1.123456789012"),
        ("999", "1000"),
        ("0", "1"),
        ("9.99", "10.99"),
        ("-1", "0"),
        ("-0.25", "0.75"),
        ("-10.5", "-9.5"),
        ("-0.999", "0.001"),
        ("9" * 45, "1" + "0" * 45),
    ],
)
def test_plus_one(spark, x, want):
    assert value(spark, V.plus_one(V.canonical_number(F.lit(x)))) == want


def test_of_equal_keys_the_last_counts(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    assert value(spark, V.verify_json(F.lit('{"a":1,"a":2}'), F.lit('{"a":2}')))["is_correct"]


def test_bad_rows_fail_whatever_is_selected(spark):
    bad = spark.createDataFrame([("x", "q?", ["a", "b"], 7, "dev")], "source_problem_id string, question string, choices array<string>, answer_index int, split string")
    with pytest.raises(Exception, match="answer among them"):
        records.choice_pair(bad, "d").select("split").collect()
    late = spark.createDataFrame([("j", -3.0), ("j", 1.0)], "judge_id string, latency_ms double")
    with pytest.raises(Exception, match="non-negative"):
        metrics.latency_summary(late, ["judge_id"]).select("median_ms").collect()
    wordy = spark.createDataFrame([("x", "q", "no number", "dev")], "source_problem_id string, question string, answer string, split string")
    with pytest.raises(Exception, match="no plain number"):
        records.numeric_pair(wordy).select("split").collect()


def test_missing_retry_key_and_repeated_corpus_key_fail(spark, tmp_path):
    rows = spark.createDataFrame([("j", "a", 1)], "judge_id string, record_id string, x int")
    want = spark.createDataFrame([("j", "a"), ("j", "b")], "judge_id string, record_id string")
    assert joins.merge_retry(rows, rows, expected=want.limit(1)).count() == 1
    with pytest.raises(Exception, match="no base and no retry"):
        joins.merge_retry(rows, rows.limit(0), expected=want).select("x").collect()
    spark.createDataFrame([("k", "t"), ("k", "u")], "entry_cid string, title string").write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="occurs 2 times"):
        read_corpus(spark, str(tmp_path / "c"))


def test_many_judges_make_pairs(spark):
    n = 300
    scored = spark.range(n).select(
        F.format_string("j%03d", "id").alias("judge_id"), F.lit("r").alias("record_id"), F.lit("pass").alias("label"),
        F.lit(1).alias("resolved"), F.lit(1).alias("correct"))
    assert joins.judge_pairs(scored).count() == n * (n - 1) // 2


def test_sample_keeps_a_fixed_row_of_equal_keys(spark):
    rows = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "c")], "k string, v string")
    got = [bernoulli_top(rows.repartition(n), "k", 1, "f", 1.1, 5, required=False).first()["v"] for n in (1, 2, 3)]
    assert got == ["a", "a", "a"]


def test_no_machine_local_checkpoints_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="all executors share"):
        ensure_checkpoint_dir(Session())
