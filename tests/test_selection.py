"""Selection in hash order against sorting, with hot and null groups, and without a task that holds a group."""

import re

import pytest
from pyspark.sql import functions as F

from assay.operators import splits as S
from assay.operators.running import top_per_group
from assay.operators.selection import first_by_hash


def table(spark, n=3000):
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    return spark.range(n).select("id", g.alias("g"), F.sha2((F.col("id") % 2000).cast("string"), 256).alias("hash_rank"))


@pytest.mark.parametrize("n", [0, 1, 7, 400, 1700, 5000])
@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("prefix", [1, 4])
def test_first_by_hash_is_the_head_of_the_sorted_group(spark, n, by, prefix):
    df = table(spark)
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"] if by else "", []).append((r["hash_rank"], r["id"]))
    want = sorted(i for rows in groups.values() for _, i in sorted(rows)[:n])
    assert sorted(r["id"] for r in first_by_hash(df, n, tie=["id"], by=by, prefix=prefix).collect()) == want


def test_a_bin_that_ends_at_n(spark):
    df = spark.createDataFrame([("a1", 1), ("a2", 2), ("b1", 3), ("c1", 4)], "hash_rank string, id int")
    for n in range(1, 6):
        assert sorted(r["id"] for r in first_by_hash(df, n, prefix=1).collect()) == list(range(1, min(n, 4) + 1))


def test_samples_use_no_global_limit(spark):
    df = table(spark).withColumn("mode", F.lit("single"))
    for out in (
        S.stable_sample(df, "id", 1, "f", 2500),
        S.stable_sample(df, "id", 1, "f", 2500, ["g"]),
        S.bernoulli_top(df.drop("hash_rank"), "id", 1, "f", 0.9, 2000, required=False),
        S.first_per_key(df.drop("hash_rank"), "id", 1, "f", ["id"], 2000),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"TakeOrdered|GlobalLimit|CartesianProduct", plan)


@pytest.mark.parametrize("k", [5, 1500])
def test_top_per_group_beyond_the_group_limit(spark, k):
    df = table(spark, 6000)
    got = top_per_group(df, ["g"], [F.col("id").desc()], k)
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append(r["id"])
    want = sorted((i, n + 1) for ids in groups.values() for n, i in enumerate(sorted(ids, reverse=True)[:k]))
    assert sorted((r["id"], r["rank"]) for r in got.collect()) == want and dict(got.dtypes)["rank"] == "int"
