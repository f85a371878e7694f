"""Product codes of vectors: integer k-means whose exact assignments are pruned by pivots.

Vectors of integers are cut into parts; every part position has a codebook. A few
entries of the starting codebook, far from one another, are its fixed pivots: the
distance of every part to every pivot is computed once and kept with the rows. In a
round the distances from the pivots to the present entries bound the distance of
each part to each entry from below, since |d(x, p) - d(e, p)| <= d(x, e). Entries are
taken by growing bound and compared exactly, in integers, until the next bound passes
the best distance found. Bounds are lowered by more than their rounding, so nothing
that could be nearest or tie is skipped.

Each round is one pass over the written rows: a task sums the parts per entry, Spark
adds the sums, and only the codebooks (``entries`` times the dimension) pass the driver.

Null vectors and vectors with null or non-finite components take no part. Codebooks
start from the rows of the smallest ids (nulls last, then by vector); fewer rows give
fewer entries. Shorter vectors are filled up with zeros, and all of them up to a
multiple of ``parts``. Rows repeated under one id are rows each. Components of any
finite size are summed and compared exactly; an error that does not fit a long fails.
Ties go to the lower entry. Empty tables give no rows and empty codebooks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ready_workers, saved
from assay.llm.hard_negatives import matrix, quantised, usable
from assay.session import collect_bounded

PIVOTS = 8
STEP = 16  # entries compared at once
SLICE_ROWS = 2048
LIMB = 31  # bits of a limb, where sums may pass 64 bits
SLACK = 4e-7  # of the distances, more than float32 rounds away


@dataclass
class Book:
    """The codebook of one part position and its distances to the fixed pivots."""

    entries: np.ndarray  # (entries, width), int64 or Python integers
    pivots: np.ndarray  # (pivots, width)

    def __post_init__(self) -> None:
        self.far = distances(self.entries, self.pivots)


@dataclass
class Codes:
    """rows: vec_id, label, codes array<int>, error long; books: entries of each part, as lists of integers."""

    rows: DataFrame
    books: list[list[list[int]]]


def whole(values: np.ndarray, wide: bool) -> np.ndarray:
    """Whole doubles as integers that can be squared and added."""
    if not wide:
        return values.astype(np.int64)
    out = np.empty(values.shape, object)
    out[...] = [[int(x) for x in row] for row in values]
    return out


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) Euclidean distances in float32."""
    out = np.zeros((len(rows), len(pivots)), np.float32)
    for j, p in enumerate(pivots):
        squares = ((rows - p) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            out[:, j] = np.sqrt(squares.astype(np.float64))
    return out


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """Places of up to ``n`` entries, each the farthest from those before it."""
    chosen = [0]
    gap = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(entries)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def bounds(far: np.ndarray, book: Book) -> np.ndarray:
    """(rows, entries) lower bounds of the distances, from the pivots."""
    out = np.zeros((len(far), len(book.far)), np.float32)
    with np.errstate(invalid="ignore"):
        for j in range(far.shape[1]):
            x, e = far[:, j, None], book.far[None, :, j]
            gap = np.abs(x - e) - np.float32(SLACK) * (x + e)
            np.maximum(out, np.where(np.isfinite(gap), gap, 0), out=out)
    return out


def nearest(rows: np.ndarray, far: np.ndarray, book: Book, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance; ``counted`` receives the number of exact comparisons."""
    least = bounds(far, book)
    order = np.argsort(least, axis=1, kind="stable")
    ranked = np.take_along_axis(least, order, axis=1)
    n = len(book.entries)
    place = np.full(len(rows), n)
    best = np.zeros(len(rows), rows.dtype)
    alive = np.arange(len(rows))
    for at in range(0, n, STEP):
        if at:
            reach = np.sqrt(best[alive].astype(np.float64))
            alive = alive[ranked[alive, at] <= reach]
        if not len(alive):
            break
        some = order[alive, at : at + STEP]
        found = ((rows[alive, None, :] - book.entries[some]) ** 2).sum(axis=2)
        if counted is not None:
            counted.append(found.size)
        low = found.min(axis=1)
        entry = np.where(found == low[:, None], some, n).min(axis=1).astype(np.int64)
        better = (place[alive] == n) | (low < best[alive]) | ((low == best[alive]) & (entry < place[alive]))
        best[alive[better]], place[alive[better]] = low[better], entry[better]
    return place, best


def parted(values: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(values, parts, axis=1)


def limbs(value: int, count: int) -> list[int]:
    """``value`` as ``count`` limbs, the last one with its sign."""
    out = []
    for _ in range(count - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def fitted(
    rows: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    pivots: int = PIVOTS,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> Codes:
    """Fit the codebooks and code every row."""
    ready_workers(rows)
    spark = rows.sparkSession
    vectors = (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
        .where(usable(F.col("v")))
        .withColumn("v", quantised(F.col("v"), scale))
    )
    sizes = vectors.agg(
        F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    dims = max(1, ceil((sizes["dims"] or 0) / parts)) * parts
    top = int(sizes["top"] or 0)
    wide = dims * (2 * top) ** 2 >= 1 << 62 or (sizes["n"] + 1) * top >= 1 << 62
    count = ceil((top.bit_length() + 1) / LIMB) if wide else 1
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # ``entries`` rows
    if not first:
        empty = spark.createDataFrame([], "vec_id long, codes array<int>, error long")
        label = F.lit(None).cast(vectors.schema["label"].dataType).alias("label")
        return Codes(empty.select("vec_id", label, "codes", "error"), [[] for _ in range(parts)])
    start = whole(matrix(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dims), wide)
    fixed = [part[far_apart(part, pivots)] for part in parted(start, parts)]
    ends = np.cumsum([0, *map(len, fixed)])
    kinds = dict(vectors.dtypes)
    stored = "array<double>" if wide else "array<long>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                values = matrix(cut.column(2), dims)
                far = np.hstack([distances(x, p) for x, p in zip(parted(whole(values, wide), parts), fixed, strict=True)])
                kept = values if wide else values.astype(np.int64)
                arrays = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                    for m in (kept, far)
                ]
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), *arrays], names=["vec_id", "label", "v", "far"])

    known = saved(
        vectors.mapInArrow(measure, f"vec_id long, label {kinds['label']}, v {stored}, far array<float>"), "pivot-distances"
    )

    def assigned(batch: pa.RecordBatch, books: list[Book]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, nearest entries and squared distances of each part; v and far are the batch's last columns."""
        values = batch.column(batch.num_columns - 2)
        values = whole(matrix(values, dims), wide)
        far = matrix(batch.column(batch.num_columns - 1), int(ends[-1])).astype(np.float32)
        for k, (x, book) in enumerate(zip(parted(values, parts), books, strict=True)):
            yield x, *nearest(x, far[:, ends[k] : ends[k + 1]], book)

    current = parted(start, parts)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((current, fixed))  # of fixed size

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, pivots_ = shared.value
            books = [Book(e, p) for e, p in zip(now, pivots_, strict=True)]
            sums = [np.zeros_like(b.entries) for b in books]
            sizes = [np.zeros(len(b.entries), np.int64) for b in books]
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    for k, (x, place, _) in enumerate(assigned(batch.slice(at, SLICE_ROWS), books)):
                        np.add.at(sums[k], place, x)
                        sizes[k] += np.bincount(place, minlength=len(sizes[k]))
            used = [(k, int(e)) for k in range(parts) for e in np.flatnonzero(sizes[k])]
            spread = [[limb for x in sums[k][e] for limb in limbs(int(x), count)] for k, e in used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
                    pa.array([int(sizes[k][e]) for k, e in used], pa.int64()), pa.array(spread, pa.list_(pa.int64())),
                ],
                names=["part", "entry", "size", "sums"],
            )

        added = (
            known.select("v", "far")
            .mapInArrow(total, "part int, entry int, size long, sums array<long>")
            .select("part", "entry", "size", F.posexplode("sums").alias("spot", "x"))
            .groupBy("part", "entry", "spot")
            .agg(F.sum("size").alias("size"), F.sum("x").alias("x"))
        )
        current = [e.copy() for e in current]
        width = dims // parts
        pieces: dict[tuple[int, int, int], int] = {}
        filled: dict[tuple[int, int], int] = {}
        for r in collect_bounded(added, parts * entries * width * count, "the sums of the entries"):
            spot, limb = divmod(r["spot"], count)
            at = r["part"], r["entry"], spot
            pieces[at] = pieces.get(at, 0) + (r["x"] << (LIMB * limb))
            filled[at[:2]] = r["size"]
        for (k, e, spot), x in pieces.items():
            current[k][e, spot] = x // filled[k, e]
        shared.unpersist()

    final = spark.sparkContext.broadcast((current, fixed))  # of fixed size

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots_ = final.value
        books = [Book(e, p) for e, p in zip(now, pivots_, strict=True)]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                found = list(assigned(cut, books))
                codes = np.stack([place for _, place, _ in found], axis=1).astype(np.int32)
                error = sum(d for _, _, d in found)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), cut.column(1), listed, pa.array([int(x) for x in error], pa.int64())],
                    names=["vec_id", "label", "codes", "error"],
                )

    coded = known.mapInArrow(code, f"vec_id long, label {kinds['label']}, codes array<int>, error long")
    return Codes(coded, [[[int(x) for x in row] for row in part] for part in current])
