"""Two-edge path counts that no hub can blow up.

A middle node is heavy when the paths through it, incoming times outgoing edges, pass
``heavy``. Paths through light nodes are a join. Those through heavy ones are a product
of two adjacency matrices in blocks: sources and ends are dealt to blocks, middle nodes
to slices, and a task adds up the products of the slices of one block pair. It hands on
one row per connected pair, where a join would hand on one per path, and holds one block
of counts and one slice of edges.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAVY = 1_000_000
BLOCK_NODES = 2048
SLICE_NODES = 512


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    for batch in batches:
        cell, at = batch.column("cell").to_numpy(), batch.column("slice").to_numpy()
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(at) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi > lo:
                yield (int(cell[lo]), int(at[lo])), batch.slice(lo, hi - lo)


def _coded(column: pa.ChunkedArray, known: dict) -> np.ndarray:
    return np.fromiter((known.setdefault(v, len(known)) for v in column.to_pylist()), np.int64, len(column))


class Counts:
    """Paths between the sources and the ends of one block pair; both grow as they are met."""

    def __init__(self) -> None:
        self.sources: dict = {}
        self.ends: dict = {}
        self.paths = np.zeros((0, 0))

    def add(self, edges: pa.Table) -> None:
        """One slice of middle nodes: kind 0 leads into them, kind 1 out of them."""
        first, second = (edges.filter(pc.equal(edges.column("kind"), k)) for k in (0, 1))
        if not len(first) or not len(second):
            return
        middle: dict = {}
        s, m1 = _coded(first.column("node"), self.sources), _coded(first.column("mid"), middle)
        c, m2 = _coded(second.column("node"), self.ends), _coded(second.column("mid"), middle)
        into, out = np.zeros((len(self.sources), len(middle))), np.zeros((len(middle), len(self.ends)))
        np.add.at(into, (s, m1), first.column("n").to_numpy())
        np.add.at(out, (m2, c), second.column("n").to_numpy())
        grown = np.zeros((len(self.sources), len(self.ends)))
        grown[: self.paths.shape[0], : self.paths.shape[1]] = self.paths
        self.paths = grown + into @ out

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        s, c = np.nonzero(self.paths)
        sources, ends = pa.array(list(self.sources), kind), pa.array(list(self.ends), kind)
        return pa.RecordBatch.from_arrays(
            [sources.take(pa.array(s)), ends.take(pa.array(c)), pa.array(self.paths[s, c].astype(np.int64))], names=["source", "candidate", "paths"]
        )


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, of_cell in groupby(_slices(batches), key=lambda p: p[0][0]):
        counts, kind = Counts(), None
        for _, rows in groupby(of_cell, key=lambda p: p[0][1]):
            table = pa.Table.from_batches([r for _, r in rows])
            kind = table.schema.field("node").type
            counts.add(table)
        yield counts.rows(kind)


def heavy_paths(first: DataFrame, second: DataFrame, block_nodes: int = BLOCK_NODES, slice_nodes: int = SLICE_NODES) -> DataFrame:
    """source, candidate, paths by block products. ``first``: source, mid, n. ``second``: mid, candidate, n."""
    sizes = [
        max(1, ceil(df.select(c).distinct().count() / size))
        for df, c, size in ((first, "source", block_nodes), (second, "candidate", block_nodes), (second, "mid", slice_nodes))
    ]

    def dealt(value: str, n: int) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    into = first.select(F.lit(0).alias("kind"), F.col("source").alias("node"), "mid", "n", dealt("source", sizes[0]).alias("row"), numbers(sizes[1]).alias("col"))
    out = second.select(F.lit(1).alias("kind"), F.col("candidate").alias("node"), "mid", "n", numbers(sizes[0]).alias("row"), dealt("candidate", sizes[1]).alias("col"))
    cells = (
        into.unionByName(out)
        .select("kind", "node", "mid", "n", (F.col("row") * sizes[1] + F.col("col")).alias("cell"), dealt("mid", sizes[2]).alias("slice"))
        .repartitionById(sizes[0] * sizes[1], F.col("cell"))
        .sortWithinPartitions("cell", "slice")
    )
    kind = first.schema["source"].dataType.simpleString()
    return cells.mapInArrow(_products, f"source {kind}, candidate {kind}, paths long")


def two_edge_paths(
    edges: DataFrame, sources: DataFrame, heavy: int = HEAVY, block_nodes: int = BLOCK_NODES, slice_nodes: int = SLICE_NODES
) -> DataFrame:
    """source, candidate, paths: two-edge paths from every source to every other node. ``edges``: source, target."""
    counted = edges.groupBy("source", "target").agg(F.count("*").alias("n"))  # repeated edges are paths each
    first = counted.join(sources.select("source").distinct(), "source", "left_semi").withColumnRenamed("target", "mid")
    second = counted.select(F.col("source").alias("mid"), F.col("target").alias("candidate"), "n")
    into, out = (df.groupBy("mid").agg(F.count("*").cast("double").alias(c)) for df, c in ((first, "_in"), (second, "_out")))
    # at most 2 * edges / sqrt(heavy) nodes
    hubs = into.join(out, "mid").where(F.col("_in") * F.col("_out") > heavy).select("mid")
    joined = lambda a, b: (
        a.withColumnRenamed("n", "_a").join(b, "mid").select("source", "candidate", (F.col("_a") * F.col("n")).alias("paths"))
    )
    if hubs.isEmpty():
        pairs = joined(first, second)
    else:
        light = joined(first.join(hubs, "mid", "left_anti"), second)
        pairs = light.unionByName(
            heavy_paths(first.join(hubs, "mid", "left_semi"), second.join(hubs, "mid", "left_semi"), block_nodes, slice_nodes)
        )
    return pairs.where("candidate <> source").groupBy("source", "candidate").agg(F.sum("paths").alias("paths"))
