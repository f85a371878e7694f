"""The first n rows in hash order, for any n and any size of group, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREFIX = 4  # hex digits: at most 65,536 bins a group


def first_by_hash(df: DataFrame, n: int, rank: str = "hash_rank", tie: Sequence[str] = (), by: Sequence[str] = (), prefix: int = PREFIX) -> DataFrame:
    """Rows whose ``rank`` (hex digest), then ``tie``, is among the first ``n`` of their group.

    Counts of digest prefixes find the bin in which the n-th row of a group lies. Rows
    of earlier bins are taken by a filter; only those of that bin, a 65,536th of the
    group, are ranked. ``rank`` and ``tie`` must order a group totally; a null group is
    a group.
    """
    if n <= 0:
        return df.limit(0)
    bin_ = F.substring(rank, 1, prefix)
    before = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = df.groupBy(*by, bin_.alias("_bin")).agg(F.count("*").alias("_n")).select(*by, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    last = F.max(F.struct("_bin", "_before")).alias("_last")
    cuts = bins.where(F.col("_before") < n).groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(last)
    if by:
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
        rows = df.join(cuts, all_of(same))
    else:
        rows = df.withColumn("_last", cuts.select("_last").scalar())
    whole = rows.where(bin_ < F.col("_last._bin"))
    spot = F.row_number().over(W.partitionBy(*by).orderBy(rank, *tie))
    edge = rows.where(bin_ == F.col("_last._bin")).withColumn("_spot", spot).where(F.col("_spot") + F.col("_last._before") <= n)
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def all_of(conditions: Sequence[Column]) -> Column:
    """All of them."""
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
