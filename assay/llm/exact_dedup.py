"""Exact duplicates by skew-safe combining.

Rows are combined in three steps: equal texts inside a map task (partial
aggregation), equal texts inside a salted digest group, and the salt winners of
a digest. Each step groups by digest and whole normalised text, so two texts
that merely share a digest are never merged. A text held by a third of all rows
is at most one row per map task and salt after the first step.

Nulls and ties: a null text is the empty text; empty texts are equal to each
other. A null id loses to every other id. Rows that repeat an id and a text are
one document: all carry the same marks, and ``keep_rows`` leaves one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import saved, texts, without_spaces

SALTS = 16


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` only routes rows; a weak one costs time, not correctness.
    """
    rows = (
        texts(docs, id_col, text_col)
        .select("doc_id", F.length("text").alias("points"), without_spaces(F.col("text")).alias("norm"))
        .withColumn("digest", digest(F.col("norm")))
    )
    rank = F.struct(F.col("points"), F.col("doc_id").isNotNull(), F.bitwise_not(F.col("doc_id")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "norm", "salt")
        .agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    same_digest = Window.partitionBy("digest")
    winners = (
        salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
        .withColumn("contents", F.count(F.lit(1)).over(same_digest))
        .select(
            "digest",
            F.when(F.col("contents") > 1, F.col("norm")).alias("content"),
            F.bitwise_not(F.col("best.col3")).alias("keep_id"),
            "group_size",
            "contents",
        )
    )
    winners = saved(winners, "winners")
    clashing = winners.where("contents > 1").select("digest").distinct()
    if clashing.isEmpty():
        narrow = rows.select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256"))
        marked = narrow.join(winners.drop("content"), "digest")
    else:  # texts of a shared digest are told apart by the whole text
        told = rows.join(clashing.withColumn("clash", F.lit(True)), "digest", "left").select(
            "doc_id",
            "digest",
            F.when(F.col("clash"), F.col("norm")).alias("content"),
            F.sha2("norm", 256).alias("text_sha256"),
        )
        w = winners.alias("w")
        marked = told.alias("t").join(
            w, (F.col("t.digest") == F.col("w.digest")) & F.col("t.content").eqNullSafe(F.col("w.content"))
        )
    return marked.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = duplicate_classes(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_stay")).distinct()
    found = docs.join(stay, docs[id_col].eqNullSafe(stay["_stay"]), "left_semi")
    return found.dropDuplicates([id_col, text_col])
