"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys, sorted by key inside its partitions: how many
documents hold the key, the largest id among them and whether the key was new.
Batches are added one after the other. Each is aggregated to a run (combined on
the map side, so a line held by a third of all documents is one row per task),
merge-joined against the runs so far to tell new keys from known ones, and
stored at level 0; a level that holds ``fan`` runs is compacted to one run of
the next level. Keys travel as the first 128 bits of SHA-256, never as text.

Nulls and ties: a null text is one empty line. Documents are distinct ids: rows
that repeat an id count once, a row without an id does not count and loses no line. Rows
that repeat the largest id all keep their lines. Lines whose keys are shorter
than ``min_points`` code points always stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import SPACES, ascii_lower, saved, texts

MIN_POINTS = 40
MIN_DOCS = 5
BATCHES = 4
FAN = 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def key_hash(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key.cast("binary"), 256)), 1, 16)


def long_line_keys(docs: DataFrame, min_points: int) -> DataFrame:
    """(doc_id, key) for each row and each of its distinct keys that is long enough."""
    lines = F.filter(
        F.split("text", "\n", -1), lambda x: F.length(x) >= min_points
    )  # a key is never longer than its line
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_points))
    return docs.select("doc_id", F.explode(keys).alias("line")).select("doc_id", key_hash(F.col("line")).alias("key"))


class LineRuns:
    """Runs by level; ``add`` takes (doc_id, key) rows, all rows of a document in one batch."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self) -> DataFrame:
        """Every key once, counted over all runs."""
        return self._combined(self.runs())

    @staticmethod
    def _combined(runs: list[DataFrame]) -> DataFrame:
        return (
            reduce(DataFrame.unionByName, runs)
            .groupBy("key")
            .agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"), F.max("fresh").alias("fresh"))
        )

    def add(self, batch: DataFrame) -> DataFrame:
        """Store the batch as a run; returns the keys that no earlier run holds."""
        run = batch.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_id"))
        if self.runs():
            known = reduce(DataFrame.unionByName, self.runs()).select("key")
            fresh = run.join(known, "key", "left_anti").withColumn("fresh", F.lit(True))
            run = fresh.unionByName(run.join(known, "key", "left_semi").withColumn("fresh", F.lit(False)))
        else:
            run = run.withColumn("fresh", F.lit(True))
        stored = self._store(0, run)
        return stored.where("fresh").select("key")

    def _store(self, level: int, run: DataFrame) -> DataFrame:
        stored = saved(run.sortWithinPartitions("key"), f"lines-level{level}")
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored)
        if len(self.levels[level]) == self.fan:
            whole, self.levels[level] = self._combined(self.levels[level]), []
            self._store(level + 1, whole)
        return stored


def without_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_points: int = MIN_POINTS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fan: int = FAN,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: common lines stay in the largest id only."""
    rows = texts(docs, id_col, text_col)
    keys = saved(
        long_line_keys(rows, min_points).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "line-keys"
    )
    runs = LineRuns(docs.sparkSession, fan)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("doc_id", "key"))
    # written, so that a skewed join can split the hot keys of both sides
    common = saved(runs.merged().where(F.col("n_docs") >= min_docs).select("key", "last_id"), "common-lines")
    drops = (
        keys.join(common, "key")
        .where("doc_id < last_id")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("drops"))
    )
    lines = F.split("text", "\n", -1)

    def stays(line: Column) -> Column:
        key = line_key(line)
        return ~((F.length(key) >= min_points) & F.array_contains("drops", key_hash(key)))

    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(lines, stays))
    return (
        rows.join(drops, "doc_id", "left")
        .select("doc_id", F.size(lines).alias("n_lines"), kept.alias("kept"))
        .select(
            "doc_id",
            F.col("n_lines").cast("long").alias("n_lines"),
            (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("kept_text"),
        )
    )
