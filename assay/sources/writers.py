"""Deterministic sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.rules import check_unique, enforce



def _alphabetical(column, kind: T.DataType):
    """Rebuild nested structs with alphabetical fields, and maps in key order."""
    if isinstance(kind, T.StructType):
        parts = [_alphabetical(column[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(column, lambda x: _alphabetical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(column)))
    return column


def _has_nan(column, kind: T.DataType):
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(False))
    if isinstance(kind, T.StructType):
        out = F.lit(False)
        for f in kind:
            out = out | _has_nan(column[f.name], f.dataType)
        return out
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(column, lambda x: _has_nan(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(column), lambda x: _has_nan(x, kind.valueType)), F.lit(False))
    return F.lit(False)


def canonical_rows(df: DataFrame, key: str) -> DataFrame:
    """Columns and nested fields in alphabetical order, rows sorted by key, NaN refused."""
    bad = F.lit(False)
    for f in df.schema:
        bad = bad | _has_nan(F.col(f.name), f.dataType)
    name = F.when(bad, F.raise_error("NaN and infinity cannot be written as JSON").cast(df.schema[key].dataType)).otherwise(F.col(key))
    checked = df.withColumn(key, name)
    cols = [_alphabetical(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)]
    return checked.select(*cols).orderBy(key)


def write_jsonl(df: DataFrame, path: str, key: str, mode: str = "errorifexists") -> None:
    """SNK1: sorted keys and rows, explicit nulls, unique key.

    Files hold consecutive key ranges, so reading them in name order gives one
    sorted sequence whatever the number of partitions.
    """
    enforce(check_unique(df, [key]))
    canonical_rows(df, key).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_observations(df: DataFrame, path: str, by: str = "slice", mode: str = "errorifexists") -> None:
    """SNK2: long-form metric rows, one folder per slice."""
    df.write.mode(mode).partitionBy(by).parquet(path)
