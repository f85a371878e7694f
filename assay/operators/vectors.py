"""Exact nearest-neighbour search over vector windows, on a two-level index.

Rows belong to the cell of their nearest pivot, and inside a cell to shells: blocks of
bounded size along the angle to the pivot. The number of cells follows the square root
of the number of blocks, so there is no limit to either. For a query both levels bound
what they can hold: a cell by the largest angle in it, a shell by its smallest and
largest one (triangle inequality on angles). A first pass over the query's own shell
gives it a score to beat; the second pass visits every shell that may hold a better
one. A task holds one shell and lets its visitors stream past in blocks of bounded size,
so rows of the index are shuffled once per pass and never copied, however many queries
there are. Nothing else
is skipped: the result is exact.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.identity import hash_rank
from assay.operators.running import row_numbers, top_per_group
from assay.session import collect_bounded, cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
LEAST_BLOCK_ROWS = 256
SCORES = 1 << 20  # of visitors and rows of a shell that a task holds at once
REACHED_ROWS = 1 << 14  # pairs of windows and cells of one batch
SLACK = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _assign(windows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the angle to it."""

    def near(batches):
        for batch in filter(len, batches):
            cos = np.clip(_matrix(batch.column("vec")) @ pivots.T, -1.0, 1.0)
            cell = cos.argmax(axis=1)
            yield _with(batch, cell=cell.astype("int32"), angle=np.arccos(cos[np.arange(len(cell)), cell]))

    schema = f"owner {windows.schema['owner'].dataType.simpleString()}, window_index int, vec array<float>, cell int, angle double"
    return windows.select("owner", F.col("window_index").cast("int"), F.col("vec").cast("array<float>")).mapInArrow(near, schema)


def indexed(windows: DataFrame, cells: int | None = None, block_rows: int | None = None) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Rows with cell, angle and shell; the shells (cell, shell, low, high); the pivots (on the driver: ``cells`` rows)."""
    n = windows.count()
    if block_rows is None:
        # blocks for all tasks that run at once, while they are worth it
        tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        block_rows = min(BLOCK_ROWS, max(LEAST_BLOCK_ROWS, math.ceil(n / tasks)))
    cells = cells or max(1, math.ceil(math.sqrt(n / block_rows)))
    pick = windows.orderBy(hash_rank("pivot", F.col("owner"), F.col("window_index"))).limit(cells)
    pivots = _unit(np.array([r["vec"] for r in collect_bounded(pick, cells, "the pivots")], dtype=np.float64).reshape(-1, _width(windows)))
    placed = cut_lineage(_assign(windows, pivots)) if len(pivots) else _assign(windows, np.zeros((1, 1)))
    spots = row_numbers(placed.select("owner", "window_index", "cell", "angle"), ["cell"], [F.col("angle"), F.col("owner"), F.col("window_index")], "spot")
    shells = spots.select("owner", "window_index", "cell", F.floor((F.col("spot") - 1) / block_rows).cast("int").alias("shell"))
    rows = cut_lineage(placed.join(shells, ["owner", "window_index", "cell"]))
    bounds = rows.groupBy("cell", "shell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    return rows, cut_lineage(bounds), pivots


def _width(windows: DataFrame) -> int:
    first = windows.select(F.size("vec").alias("d")).first()
    return first["d"] if first else 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _with(batch: pa.RecordBatch, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], names=[*batch.schema.names, *more])


class Shell:
    """One block of the index, its rows ordered by owner."""

    def __init__(self, table: pa.Table):
        owners = table.column("owner").to_numpy()
        order = np.argsort(owners, kind="stable")
        self.owners, self.starts = np.unique(owners[order], return_index=True)
        self.rows = _matrix(table.column("vec").combine_chunks())[order]

    def best(self, visits: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Visitor, owner, score: the ``k`` best owners of each visiting window that reach its floor, by a window's maximum over theirs.

        Blocks of visitors hold SCORES scores at most, however large the shell is.
        """
        step = max(1, SCORES // len(self.rows))
        asked = visits.column("owner").to_numpy(zero_copy_only=False)
        floors = visits.column("floor").to_numpy()
        for lo in range(0, len(asked), step):
            own = slice(lo, lo + step)
            scores = np.maximum.reduceat(_matrix(visits.column("vec").slice(lo, step)) @ self.rows.T, self.starts, axis=1)
            fits = (scores > 0) & (scores >= floors[own, None])
            same = np.minimum(np.searchsorted(self.owners, asked[own]), len(self.owners) - 1)
            fits[np.arange(len(same)), same] &= self.owners[same] != asked[own]
            many = np.flatnonzero(fits.sum(axis=1) > k)
            if len(many):
                listed = np.where(fits[many], scores[many], -np.inf)
                fits[many] &= scores[many] >= np.partition(listed, -k, axis=1)[:, [-k]]
                for i in many[fits[many].sum(axis=1) > k]:  # ties: the smaller owners, which stand first
                    found = np.flatnonzero(fits[i])
                    fits[i, found[np.argsort(-scores[i, found], kind="stable")[k:]]] = False
            at, to = np.nonzero(fits)
            yield asked[own][at], self.owners[to], scores[at, to]


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "shell", "kind")])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if hi > lo:
                    yield tuple(int(x) for x in keys[:, lo]), batch.slice(lo, hi - lo)

    held, shell = None, None
    for (cell, number, kind), part in groupby(pieces(), key=lambda p: p[0]):
        if kind == 0:
            held, shell = (cell, number), Shell(pa.Table.from_batches([b for _, b in part]))
            continue
        for _, visits in part:
            if held != (cell, number):
                continue
            owner = visits.schema.field("owner").type
            for source, candidate, score in shell.best(visits, k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(source, owner), pa.array(candidate, owner), pa.array(score, pa.float64())], names=["source", "candidate", "score"]
                )


def _visited(rows: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Every visit (owner, vec, floor, cell, shell) against the rows of its shell."""
    columns = ["cell", "shell", "kind", "owner", "vec", "floor"]
    held = rows.withColumns({"kind": F.lit(0), "floor": F.lit(0.0)}).select(*columns)
    asked = visits.withColumn("kind", F.lit(1)).select(*columns)
    kind = rows.schema["owner"].dataType.simpleString()
    return (
        held.unionByName(asked)
        .repartition(F.col("cell"), F.col("shell"))
        .sortWithinPartitions("cell", "shell", "kind")
        .mapInArrow(lambda batches: _searched(batches, k), f"source {kind}, candidate {kind}, score double")
    )


def vector_search(
    windows: DataFrame, queries: DataFrame, k: int = 100, cells: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """RET3/JN8: best ``k`` owners per query owner by maximum window cosine; scores <= 0 are dropped.

    ``windows``: owner, window_index, vec. ``queries``: owner. The owner itself
    is never a candidate.
    """
    rows, shells, pivots = indexed(windows, cells, block_rows)
    asked = rows.join(queries.select("owner").distinct(), "owner", "left_semi")
    order = [F.col("score").desc(), F.col("candidate").asc()]

    home = _visited(rows, asked.withColumn("floor", F.lit(0.0)), k)
    found = cut_lineage(home.groupBy("source", "candidate").agg(F.max("score").alias("score")))
    best = top_per_group(found, ["source"], order, k)
    floor = best.groupBy(F.col("source").alias("owner")).agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("floor")
    )

    balls = shells.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ball_low, ball_high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)  # of cells without rows
    for r in collect_bounded(balls, max(1, len(pivots)), "the cells"):
        ball_low[r["cell"]], ball_high[r["cell"]] = r["low"], r["high"]

    def angles(batches):
        """Cells within reach: the angle to the pivot, and the largest angle that may still hold a better score."""
        step = max(1, REACHED_ROWS // max(1, len(pivots)))
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
            at = np.arccos(np.clip(_matrix(batch.column("vec")) @ pivots.T, -1.0, 1.0))
            reach = np.arccos(np.clip(batch.column("floor").to_numpy() - SLACK, -1.0, 1.0)) + SLACK
            within = (ball_high >= at - reach[:, None]) & (ball_low <= at + reach[:, None])
            rows_, cells_ = np.nonzero(within)
            yield _with(batch.take(pa.array(rows_)), at=at[within], reach=reach[rows_], to=cells_.astype("int32"))

    kind = windows.schema["owner"].dataType.simpleString()
    known = asked.join(floor, "owner", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    inside = (F.col("high") >= F.col("at") - F.col("reach")) & (F.col("low") <= F.col("at") + F.col("reach"))
    own = (F.col("to") == F.col("cell")) & (F.col("to_shell") == F.col("shell"))
    further = (
        known.select("owner", "window_index", "vec", "cell", "shell", "floor")
        .mapInArrow(
            angles,
            f"owner {kind}, window_index int, vec array<float>, cell int, shell int, floor double, at double, reach double, to int",
        )
        .join(shells.select(F.col("cell").alias("to"), F.col("shell").alias("to_shell"), "low", "high"), "to")
        .where(inside & ~own)
        .select("owner", "vec", "floor", F.col("to").alias("cell"), F.col("to_shell").alias("shell"))
    )
    rest = _visited(rows, further, k)
    scores = found.unionByName(rest).groupBy("source", "candidate").agg(F.max("score").alias("score"))
    return top_per_group(scores, ["source"], order, k)
