"""File sources with explicit schemas and fail-closed contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.text import norm_id

_PREDICTION_FIELDS = (
    "record_id string, judge_id string, protocol_version string, label string, "
    "probabilities map<string,double>, raw_scores map<string,double>, execution_status string, "
    "latency_ms double, token_usage map<string,double>, provider_metadata variant, error variant"
)
PREDICTION_NAMES = tuple(f.split()[0] for f in _PREDICTION_FIELDS.split(", "))
PREDICTION_DDL = (
    _PREDICTION_FIELDS
    + ", dataset string, partition string, source_problem_id string, gold_label string, kind string, repeat_index int, "
    + f"prediction struct<{', '.join(f.replace(' ', ': ', 1) for f in _PREDICTION_FIELDS.split(', '))}>"
)
RECORD_DDL = (
    "dataset string, partition string, source_problem_id string, source_revision string, "
    "record struct<record_id: string, source_problem_id: string, mode: string, prompt: string, "
    "rubric: array<struct<criterion_id: string, description: string, weight: double, aggregation_rule: string>>, "
    "candidate_a: string, candidate_b: string, "
    "gold: struct<label: string, provenance: string, evidence: variant, verifier_id: string>, "
    "split: string, perturbation: variant>"
)


def error_kind(error: Column) -> Column:
    """``kind`` of an error object; a plain string stands for itself."""
    plain = F.schema_of_variant(error) == "STRING"
    return F.when(plain, F.try_variant_get(error, "$", "string")).otherwise(F.try_variant_get(error, "$.kind", "string"))


def read_predictions(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SRC1: one prediction per line, flat or inside an envelope; the inner object wins.

    Blank lines are skipped; a malformed line fails the job.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.schema(PREDICTION_DDL).option("mode", "FAILFAST").json(paths)
    cols = []
    for name in PREDICTION_NAMES:
        inner = F.col(f"prediction.{name}")
        cols.append(F.when(F.col("prediction").isNotNull(), inner).otherwise(F.col(name)).alias(name))
    out = raw.select(*cols, "dataset", "partition", "source_problem_id", "gold_label", "kind", "repeat_index")
    return out.withColumn("error_kind", error_kind(F.col("error")))


def read_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SRC1: pool rows with their nested record flattened."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.schema(RECORD_DDL).option("mode", "FAILFAST").json(paths)
    return raw.select(
        "dataset",
        "partition",
        "source_revision",
        "record.record_id",
        F.coalesce("record.source_problem_id", "source_problem_id").alias("source_problem_id"),
        "record.mode",
        "record.prompt",
        "record.rubric",
        "record.candidate_a",
        "record.candidate_b",
        F.col("record.gold.label").alias("gold"),
        F.col("record.gold.provenance").alias("provenance"),
        F.col("record.gold.evidence").alias("evidence"),
        F.col("record.gold.verifier_id").alias("verifier_id"),
        "record.split",
        "record.perturbation",
    )


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path).columns


def _exact_width(spark: SparkSession, path: str, names: Sequence[str], sep: str, **options: str) -> DataFrame:
    """String columns by position; a row of another width fails the job."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST")
    reader = reader.option("enforceSchema", False)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.csv(path)


def read_registry_csv(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], id_column: str = "lei") -> DataFrame:
    """SRC2: logical columns by their first present header name.

    A missing column or a ragged row is an error; rows whose identifier is not
    20 upper-case alphanumerics are dropped.
    """
    header = [h.lstrip("﻿") for h in _header(spark, path, ",")]
    picked: dict[str, str] = {}
    for logical, options in aliases.items():
        found = next((o for o in options if o in header), None)
        if found is None:
            raise ValueError(f"none of {list(options)} present in header for {logical!r}")
        picked[logical] = found
    raw = _exact_width(spark, path, header, ",", quote='"', escape='"', multiLine="true")
    out = raw.select(
        *[F.coalesce(F.col(f"`{actual}`"), F.lit("")).alias(logical) for logical, actual in picked.items()]
    )
    return out.filter(F.rlike(norm_id(F.col(id_column)), F.lit("^[0-9A-Z]{20}$")))


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """SRC3: the header must hold exactly the expected columns."""
    header = [h.lstrip("﻿") for h in _header(spark, path, "\t")]
    missing, extra = sorted(set(columns) - set(header)), sorted(set(header) - set(columns))
    if missing or extra:
        raise ValueError(f"column mismatch: missing={missing} extra={extra}")
    return _exact_width(spark, path, header, "\t", quote='"', escape='"', multiLine="true").select(*columns)


def read_corpus(spark: SparkSession, path: str, key: str = "entry_cid") -> DataFrame:
    """SRC4: documents with text fields never null; a repeated key is an error."""
    texts = ["citation", "family", "title", "text", "section_id"]
    df = spark.read.parquet(path)
    repeated = df.groupBy(key).count().filter("count > 1").first()
    if repeated is not None:
        raise ValueError(f"{key} {repeated[key]!r} occurs {repeated['count']} times")
    have = [c for c in texts if c in df.columns]
    out = df.select(F.col(key).cast("string").alias(key), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in have])
    for c in texts:
        if c not in have:
            out = out.withColumn(c, F.lit(""))
    return out.withColumn("body", F.concat("title", F.lit("\n"), "text"))


def read_graph(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """SRC5: a file or a directory of shards; only the named columns are read.

    An empty directory fails, as Spark cannot infer a schema from it.
    """
    return spark.read.parquet(path).select(*columns)


def read_result_tree(spark: SparkSession, root: str, name: str = "results.json") -> DataFrame:
    """SRC6: every document below ``root`` with its path relative to ``root``.

    ``doc`` is null when the text is malformed or its root is not an object.
    """
    raw = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .text(root)
        .select(relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("content"))
    )
    return raw.select("path", "content", parse_object(F.col("content")).alias("doc"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths of all files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(relative_path(F.col("path"), root).alias("path"))


def relative_path(path: Column, root: str) -> Column:
    base = root.split("://")[-1].strip("/")
    return F.regexp_replace(path, r"^[a-z0-9]+:/*\Q" + base + r"\E/*", "")


def parse_object(text: Column) -> Column:
    """Variant of a JSON object text, null for anything else."""
    doc = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), doc)
