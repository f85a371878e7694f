"""Ordered running totals and ranks that no single task has to hold.

A window over one hot group (or over no group at all) sends every row of that
group to one task. Here rows are range-partitioned on group and order, so a hot
group is cut into many slabs; each slab is ranked on its own and shifted by the
totals of the slabs before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.session import cut_lineage


GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add one inclusive running sum per entry of ``totals`` within each group.

    ``whole`` names columns with the sum of a total over the group, known from its slabs.

    ``order`` must be a total order inside a group, or the result is not
    deterministic.
    """
    whole = whole or {}
    keys = [F.col(c) for c in by]
    slabs = df.repartitionByRange(*[k.asc_nulls_first() for k in keys], *order)
    slabs = slabs.withColumn("_slab", F.spark_partition_id())
    for name, value in totals.items():
        slabs = slabs.withColumn(f"_v_{name}", value)
    slabs = cut_lineage(slabs)

    before = W.partitionBy(*by).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)
    offsets = slabs.groupBy(*by, "_slab").agg(
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in totals]
    )
    offsets = offsets.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col("_slab").alias("_k_slab"),
        *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in totals],
        *[F.sum(f"_s_{total}").over(W.partitionBy(*by)).alias(name) for name, total in whole.items()],
    )
    match = F.col("_slab") == F.col("_k_slab")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = W.partitionBy(*by, "_slab").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ranked = slabs.join(offsets, match)
    for name in totals:
        ranked = ranked.withColumn(name, F.sum(f"_v_{name}").over(inside) + F.col(f"_o_{name}"))
    return ranked.select(*df.columns, *totals, *whole)


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Dense 1-based position of every row inside its group."""
    return running_totals(df, by, order, {name: F.lit(1).cast("bigint")})


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    Up to the planner's limit, ``row_number() <= k`` cuts every map-side partition to
    ``k`` rows per group before the shuffle, so a hot group never travels whole. Beyond
    it ranks come from sorted slabs, which needs a total order inside a group.
    """
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        return row_numbers(df, by, order, name).filter(F.col(name) <= k).withColumn(name, F.col(name).cast("int"))
    spot = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, spot).filter(F.col(name) <= k)
