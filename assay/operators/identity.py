"""Fingerprints and checksums of tables and file sets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.identity import canonical_json

LANES = 4


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """IDN3: digest of a set of rows, independent of order and partitioning.

    Every row is hashed to four 64-bit lanes which are summed exactly and hashed
    again with the row count. The sums combine on the map side, so no task and
    no driver ever holds the rows in order.
    """
    fields = {c: F.col(c) for c in df.columns if c not in by}
    return fingerprint_hashes(df.select(*by, F.sha2(canonical_json(fields), 256).alias("_h")), F.col("_h"), by)


def fingerprint_hashes(df: DataFrame, digest: Column, by: Sequence[str] = ()) -> DataFrame:
    lanes = [
        F.sum(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"_l{i}")
        for i in range(LANES)
    ]
    sums = df.groupBy(*by).agg(F.count("*").alias("rows"), *lanes)
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"_l{i}") for i in range(LANES)])
    return sums.select(*by, "rows", F.sha2(text, 256).alias("fingerprint"))


def file_digests(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Relative path and SHA-256 of the LF-normalised content of every file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).select(F.col("path"), F.col("content"))
    hexed = F.hex("content")
    pairs = F.regexp_replace(hexed, "(..)", "$1 ")
    clean = F.unhex(F.regexp_replace(F.regexp_replace(pairs, "0D 0A ", "0A "), " ", ""))
    root = re.sub("^([a-z]+:)?/+", "", path.rstrip("/"))
    relative = F.regexp_replace(F.col("path"), "^[a-z]+:/+" + _quoted(root) + "/?", "")
    return files.select(relative.alias("file"), F.sha2(clean, 256).alias("sha256"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def content_revision(digests: DataFrame) -> DataFrame:
    """IDN4: one digest of a file set; changes only when a path or a content changes."""
    pair = F.sha2(F.concat_ws(":", "file", "sha256"), 256)
    return fingerprint_hashes(digests, pair).select(
        F.col("rows").alias("files"), F.col("fingerprint").alias("revision")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Checksum manifest lines ``<sha256>  <path>``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = F.regexp_extract("value", r"^([0-9a-f]{64})\s+\*?(.+)$", 1), F.regexp_extract(
        "value", r"^([0-9a-f]{64})\s+\*?(.+)$", 2
    )
    return lines.select(parts[0].alias("expected"), F.trim(parts[1]).alias("file"))


def verify_manifest(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """IDN5: files of a checksum manifest that are missing or differ."""
    joined = manifest.join(digests, "file", "left")
    problem = F.when(F.col("sha256").isNull(), "missing file").when(
        F.col("sha256") != F.col("expected"), "checksum mismatch"
    )
    return joined.select(
        F.lit("manifest").alias("rule"), F.col("file").alias("key"), problem.alias("detail")
    ).filter(F.col("detail").isNotNull())
