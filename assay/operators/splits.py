"""Seeded splits and samples. A split belongs to the source family, never to the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.identity import case_key, hash_rank, hash_unit
from assay.operators.running import row_numbers, top_per_group
from assay.operators.selection import first_by_hash
from assay.vocab import DEFAULT_SEED, SPLIT_POLICY


def split_of(key: Column, seed: int = DEFAULT_SEED, policy: Sequence[tuple[str, float]] = SPLIT_POLICY) -> Column:
    """SPL2: first split whose cumulative weight exceeds the hash; the last one is the fallback."""
    total = sum(w for _, w in policy)
    if not policy or abs(total - 1.0) > 1e-9 or any(w <= 0 for _, w in policy):
        raise ValueError("split weights must be positive and sum to 1")
    u, edge, out = hash_unit(seed, key), 0.0, None
    for name, weight in policy[:-1]:
        edge += weight
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return F.lit(policy[-1][0]) if out is None else out.otherwise(policy[-1][0])


def assign_split(
    df: DataFrame,
    key: str,
    seed: int = DEFAULT_SEED,
    policy: Sequence[tuple[str, float]] = SPLIT_POLICY,
    name: str = "split",
) -> DataFrame:
    """SPL2 on a column: weighted multi-way split by source identity."""
    return df.withColumn(name, split_of(F.col(key), seed, policy))


def entity_split(key: Column, seed: int, family: str) -> Column:
    """SPL3, registry layout ``seed:family:KEY``."""
    return F.when(hash_unit(seed, family, F.upper(F.trim(key))) < 0.5, "calibration").otherwise("test")


def source_split(key: Column, salt: int, family: str) -> Column:
    """SPL3, citation layout ``salt:family:split:key``."""
    return F.when(hash_unit(salt, family, "split", key) < 0.5, "dev").otherwise("test")


def case_split(text: Column, task: str, seed: int, family: str = "legalbench-subset") -> Column:
    """SPL3, task layout ``seed:family:task:casekey``; rows sharing a text share a split."""
    return F.when(hash_unit(seed, family, task, case_key(text)) < 0.5, "calibration").otherwise("test")


def map_upstream_split(split: Column, key: Column, seed: int = DEFAULT_SEED, dev_fraction: float = 0.5) -> Column:
    """SPL4: upstream split names to ours; validation is halved by hash; others fail."""
    if not 0 < dev_fraction < 1:
        raise ValueError("dev_fraction must be between 0 and 1")
    low = F.lower(split)
    half = F.when(hash_unit(seed, key, "validation") < dev_fraction, "dev").otherwise("calibration")
    return (
        F.when(low == "train", "train")
        .when(low.isin("test", "testing"), "test")
        .when(low.isin("validation", "valid", "dev"), half)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported upstream split: "), split)))
    )


def rank_split(
    df: DataFrame, key: str, seed: int, family: str, dev: float = 0.2, calibration: float = 0.2
) -> DataFrame:
    """SPL5: exact-count split along the hash order of the distinct keys."""
    if not 0 <= dev < 1 or not 0 <= calibration < 1 or dev + calibration >= 1:
        raise ValueError("fractions must leave a test split")
    ids = df.select(key).distinct().withColumn("_rank", hash_rank(seed, family, F.col(key)))
    total = ids.agg(F.count("*").alias("n")).scalar()
    ranked = row_numbers(ids, [], [F.col("_rank").asc(), F.col(key).asc()], "_pos")
    n_dev = F.floor(total * F.lit(float(dev)))
    n_cal = F.floor(total * F.lit(float(calibration)))
    return ranked.select(
        key,
        F.when(F.col("_pos") <= n_dev, "dev")
        .when(F.col("_pos") <= n_dev + n_cal, "calibration")
        .otherwise("test")
        .alias("split"),
    )


def stable_sample(
    df: DataFrame, key: str, seed: int, family: str, n: int, by: Sequence[str] = ()
) -> DataFrame:
    """SPL6: first ``n`` distinct keys in hash order, optionally per group."""
    if n < 0:
        raise ValueError("n must be non-negative")
    ids = df.select(*by, key).distinct().withColumn("hash_rank", hash_rank(seed, family, F.col(key)))
    return first_by_hash(ids, n, tie=[key], by=by)


def bernoulli_top(
    df: DataFrame, key: str, seed: int, family: str, ratio: float, n: int, required: bool = True
) -> DataFrame:
    """SPL7: hash-threshold sample, deduplicated, first ``n`` in hash order.

    With ``required`` a short sample fails the job when it is read.
    """
    whole = F.struct(*df.columns)
    rows = (
        df.filter(hash_unit(seed, family, F.col(key)) < ratio)
        .groupBy(key)
        .agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
        .select("_row.*")
    )
    top = first_by_hash(rows.withColumn("hash_rank", hash_rank(seed, family, F.col(key))), n, tie=[key])
    if not required:
        return top
    have = top.agg(F.count("*").alias("n")).scalar()
    return top.filter(
        F.when(have < n, F.raise_error(f"sample holds fewer than {n} rows").cast("boolean")).otherwise(True)
    )


def first_per_key(df: DataFrame, key: str, seed: int, family: str, tie: Sequence[str], n: int) -> DataFrame:
    """SPL8: walk in hash order, keep the first row of every start key, stop at ``n``."""
    digest = F.unhex(hash_rank(seed, family, *[F.col(c) for c in tie]))  # half the bytes of its text, in the same order
    first = F.struct(digest.alias("_rank"), *tie)
    others = [c for c in df.columns if c != key and c not in tie]
    held = [F.min(first).alias("_first"), *([F.min_by(F.struct(*others), first).alias("_others")] if others else [])]

    def field(c: str) -> Column:
        return F.col(c) if c == key else F.col(f"_{'first' if c in tie else 'others'}.{c}").alias(c)

    firsts = df.groupBy(key).agg(*held).select(*map(field, df.columns), F.lower(F.hex("_first._rank")).alias("hash_rank"))
    return first_by_hash(firsts, n, tie=tie)


def first_n_per_group(df: DataFrame, group: str, n: int, ordinal: str) -> DataFrame:
    """SPL9: first ``n`` rows of every group in canonical order; a short group is an error."""
    top = top_per_group(df, [group], [F.col(ordinal).asc()], n)
    short = top.groupBy(group).agg(F.count("*").alias("_have")).filter(F.col("_have") < n)
    lacking = short.agg(F.count("*").alias("n")).scalar()
    return top.filter(
        F.when(lacking > 0, F.raise_error(f"a group has fewer than {n} rows").cast("boolean")).otherwise(True)
    )


def matched_control(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """SPL10: exactly ``n`` distinct keys, fixed by the seed and independent of input order."""
    ids = stable_sample(df, key, seed, "matched-control", n)
    have = ids.agg(F.count("*").alias("n")).scalar()
    return ids.filter(
        F.when(have < n, F.raise_error("sample count exceeds the distinct keys").cast("boolean")).otherwise(True)
    ).select(key)


def perturbation_schedule(
    df: DataFrame, seed: int, n: int = 12, repeats: int = 3, key: str = "record_id"
) -> DataFrame:
    """SPL11: three independent samples: repeats, option order (single only), paraphrase."""
    none = F.lit(None).cast("int")
    repeat = stable_sample(df, key, seed, "repeat", n).select(
        F.lit("repeat").alias("kind"), key, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_index")
    )
    option = stable_sample(df.filter(F.col("mode") == "single"), key, seed, "option_order", n).select(
        F.lit("option_order").alias("kind"), key, none.alias("repeat_index")
    )
    paraphrase = stable_sample(df, key, seed, "rubric_paraphrase", n).select(
        F.lit("rubric_paraphrase").alias("kind"), key, none.alias("repeat_index")
    )
    return repeat.unionByName(option).unionByName(paraphrase)


def partition_records(df: DataFrame, split: str = "split") -> DataFrame:
    """SPL12: test rows are the final evaluation, all others select thresholds."""
    return df.withColumn(
        "partition", F.when(F.col(split) == "test", "final_evaluation").otherwise("threshold_selection")
    )
