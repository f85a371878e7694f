"""What the corpus operators share: inputs, scratch tables and the learning split."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import ensure_checkpoint_dir, settings

# The six white space characters of the contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "1000"
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # at the end of a query


def ready_workers(df: DataFrame) -> None:
    """Settings of the session for Python tasks: batches of few rows, and this package on their path.

    Texts may be long and a batch is held whole, so 10,000 rows are too many.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and texts only; a null text counts as empty, other columns are left behind."""
    ready_workers(docs)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it from there.

    Unlike a checkpoint this computes the plan once and keeps column pruning. The
    shuffles go with the end of the write, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/assay-{what}-{uuid.uuid4().hex}"
    with settings(spark, SHUFFLES_GO):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; pure ASCII takes the fast built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pure = F.octet_length(text) == F.length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, upper, lower))


def filtered(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows whose texts a task's judge keeps, with all their columns and without a shuffle.

    ``judge`` makes one judge per task: an array of texts (nulls as empty) to flags.
    """
    ready_workers(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = judge()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                cut = batch.slice(first, 500)
                stay = keeps(pc.fill_null(pc.cast(cut.column(at), pa.string()), ""))
                yield cut.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
