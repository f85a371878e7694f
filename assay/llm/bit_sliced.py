"""Exact top-k by inner product over a bit-sliced index.

Rows are dealt to spans and queries to chunks; a cell is one span against one
chunk, streamed in blocks. A block keeps, per component, one bitmap for each of
the high bits of its values. The scores of all rows of a block are added up as
bitmaps (carry-save adders over 64 rows a word), the k best are selected from
the most significant slice downward, and every row whose cut-off low bits could
still lift it into the best k is scored exactly. Each cell hands on k rows per
query, which a window merges.

Vectors that are null or hold a null, NaN or infinite component take no part, as
rows and as queries; an empty vector takes part and scores 0 with every row.
Missing trailing components of a shorter vector count as zero. Rows without an id
take no part. Ties go to the smaller id; a row repeated under one id is a
candidate each time. An empty table gives no rows. Vectors of any length are held
a block at a time.

Components of any finite size are exact: a block and a batch of queries whose
products might leave 64 bits are added up as integers of any width, all others as
64-bit ones. A score beyond a long is reported as the nearest long; ranks follow
the exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import ready_workers

BLOCK_ROWS = 4096
SPAN_ROWS = 4096
MOST_SPANS = 256
CHUNK_QUERIES = 8192
QUERY_BATCH = 64
SLICES = 6
NARROW = 1 << 58  # products and their sums below it fit 64 bits with room for the bounds of a block
SCORE_BYTES = 300  # holds the product of any two doubles times 1024, summed over a vector
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

# beyond: the exact score, where it is at or outside the limits of a long, in the order of its bytes
FOUND = "query_id long, vec_id long, score long, beyond binary"
LONG = np.iinfo(np.int64)


def packed_rows(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (…, words) of a boolean array whose last axis is rows, a multiple of 64."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def narrowed(values: np.ndarray) -> np.ndarray:
    """64-bit integers where all of them are small enough, else integers of any width."""
    if values.dtype == object and largest(values) < NARROW:
        return values.astype(np.int64)
    return values


def largest(values: np.ndarray) -> int:
    return int(np.abs(values).max()) if values.size else 0


class Block:
    """The slices of up to ``BLOCK_ROWS`` rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: int = SLICES):
        values = narrowed(values)
        self.ids, self.values, self.largest = ids, values, largest(values)
        rows = len(ids)
        self.low = values.min(axis=0)
        spread = int((values.max(axis=0) - self.low).max())
        self.shift = max(0, spread.bit_length() - slices)
        self.bits = min(slices, max(1, spread.bit_length()))
        coarse = np.zeros((values.shape[1], -(-rows // 64) * 64), np.int64)
        coarse[:, :rows] = ((values - self.low) >> self.shift).T
        self.slices = [packed_rows((coarse >> b) & 1 == 1) for b in range(self.bits)]
        valid = np.zeros(coarse.shape[1], bool)
        valid[:rows] = True
        self.valid = packed_rows(valid)

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices of sum |q| * coarse, where a negative q takes the complement."""
        size = np.abs(queries)
        flip = np.where(queries < 0, ALL, np.uint64(0))
        waiting: list[list[np.ndarray]] = []

        def put(at: int, bitmap: np.ndarray) -> None:
            while len(waiting) <= at:
                waiting.append([])
            waiting[at].append(bitmap)
            if len(waiting[at]) == 3:
                a, b, c = waiting[at]
                either = a ^ b
                waiting[at] = [either ^ c]
                put(at + 1, (a & b) | (either & c))

        for j in range(int(size.max()).bit_length()):
            taken = np.where((size >> j) & 1 == 1, ALL, np.uint64(0))
            for d in np.flatnonzero(taken.any(axis=0)):
                for b in range(self.bits):
                    put(j + b, (self.slices[b][d] ^ flip[:, d : d + 1]) & taken[:, d : d + 1])
        at = 0
        while at < len(waiting):  # at most two are left at each place: ripple them
            if len(waiting[at]) == 2:
                a, b = waiting[at]
                waiting[at] = [a ^ b]
                put(at + 1, a & b)
            at += 1
        blank = np.zeros((len(queries), self.valid.shape[0]), np.uint64)
        return [w[0] if w else blank for w in waiting]

    def wide(self, queries: np.ndarray) -> bool:
        return self.largest * largest(queries) * self.values.shape[1] >= NARROW

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        exact = object if self.wide(query) else np.int64
        return self.values[rows].astype(exact) @ query.astype(exact)

    def boundary(self, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray) -> np.ndarray:
        """(queries, rows) flags: all rows that may be among the k best.

        ``known`` is a score that each query's k-th best reaches at least.
        """
        if queries.dtype != object and self.wide(queries):
            queries = queries.astype(object)
        planes = self.sums(queries)
        own = np.zeros((len(queries), len(self.valid) * 64), bool)
        own[:, : len(self.ids)] = self.ids == query_ids[:, None]
        allowed = self.valid & ~packed_rows(own)
        sure, even = np.zeros_like(allowed), allowed.copy()
        kth = np.zeros(len(queries), object)
        for p in reversed(range(len(planes))):
            ones = even & planes[p]
            enough = np.bitwise_count(sure | ones).sum(axis=1) >= k
            kth += enough.astype(object) * (1 << p)
            mask = np.where(enough, ALL, np.uint64(0))[:, None]
            sure |= ones & ~mask
            even = (ones & mask) | (even & ~planes[p] & ~mask)
        size = np.abs(queries)
        step, width = 1 << self.shift, (1 << self.bits) - 1
        low = self.low.astype(queries.dtype)
        base = queries @ low - step * width * np.where(queries < 0, size, 0).sum(axis=1)
        below = (step - 1) * np.where(queries < 0, -size, 0).sum(axis=1)
        above = (step - 1) * np.where(queries > 0, size, 0).sum(axis=1)
        full = np.bitwise_count(allowed).sum(axis=1) >= k
        reach = np.where(full, np.maximum(known, base + step * kth + below), known)
        least = np.maximum(-((base + above - reach) // step), 0)  # smallest sum that may reach it
        more, even = np.zeros_like(allowed), allowed
        top = int(least.max()).bit_length()
        for p in reversed(range(max(len(planes), top))):
            plane = planes[p] if p < len(planes) else np.zeros_like(allowed)
            want = np.where((least >> p) & 1 == 1, ALL, np.uint64(0))[:, None]
            more |= even & plane & ~want
            even = even & ~(plane ^ want)
        flags = np.unpackbits((more | even).view(np.uint8), axis=1, bitorder="little")
        return flags[:, : len(self.ids)].astype(bool)


LEAST = -(1 << (8 * SCORE_BYTES))


class Best:
    """The k best rows of each query so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.parts = [narrowed(queries[at : at + QUERY_BATCH]) for at in range(0, len(queries), QUERY_BATCH)]
        empty = np.zeros(0, np.int64)
        self.found = [(empty, empty)] * len(query_ids)
        self.known = np.full(len(query_ids), LEAST, object)

    def take(self, block: Block) -> None:
        for nth, queries in enumerate(self.parts):
            at = nth * QUERY_BATCH
            part = slice(at, at + QUERY_BATCH)
            flags = block.boundary(self.query_ids[part], queries, self.k, self.known[part])
            for q in np.flatnonzero(flags.any(axis=1)):
                rows = np.flatnonzero(flags[q])
                scores, ids = self.found[at + q]
                scores = np.concatenate([scores, block.scores(rows, queries[q])])
                ids = np.concatenate([ids, block.ids[rows]])
                by_id = np.argsort(ids, kind="stable")
                keep = by_id[np.argsort(-scores[by_id], kind="stable")][: self.k]
                self.found[at + q] = scores[keep], ids[keep]
                if len(keep) == self.k:
                    self.known[at + q] = int(scores[keep[-1]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        counts = [len(s) for s, _ in self.found]
        if sum(counts):
            scores = np.concatenate([s for s, _ in self.found])
            beyond = [None] * len(scores)
            if scores.dtype == object:
                beyond = [ordered_bytes(s) for s in scores]
                scores = np.array([max(LONG.min, min(LONG.max, s)) for s in scores], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(self.query_ids, counts)),
                    pa.array(np.concatenate([i for _, i in self.found])),
                    pa.array(scores),
                    pa.array(beyond, pa.binary()),
                ],
                names=["query_id", "vec_id", "score", "beyond"],
            )


def ordered_bytes(score: int) -> bytes | None:
    if LONG.min < score < LONG.max:
        return None
    return (int(score) - LEAST // 2).to_bytes(SCORE_BYTES, "big")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, shorter ones padded with zeros."""
    offsets = column.offsets.to_numpy()
    flat = quantised(column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def quantised(flat: np.ndarray) -> np.ndarray:
    """floor(1024 * x), exact for every finite double."""
    if not flat.size or np.abs(flat).max() < NARROW >> 10:
        return np.floor(flat * 1024).astype(np.int64)
    # a double of 2**52 or more is an integer
    return np.array([int(x) * 1024 if abs(x) >= 1 << 52 else floor(x * 1024) for x in flat.tolist()], object)


def top_rows(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    span_rows: int = SPAN_ROWS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, itself left out."""
    ready_workers(rows)
    finite = F.forall(
        vector_col, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")), F.lit(False))
    )
    vectors = rows.where(is_query.isNotNull() & F.col(id_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"),
        is_query.alias("asks"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    sizes = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("dims")
    ).first()
    spans = max(1, min(MOST_SPANS, ceil(sizes["n"] / span_rows)))
    chunks = max(1, ceil(sizes["q"] / chunk_queries))
    dims = sizes["dims"] or 1

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    spread = F.pmod(F.xxhash64("vec_id"), F.lit(spans))
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks))
    asked = vectors.where("asks").select(
        F.lit(0).alias("kind"), "vec_id", "v", chunk.alias("chunk"), numbers(spans).alias("span")
    )
    held = vectors.select(F.lit(1).alias("kind"), "vec_id", "v", spread.alias("span"), numbers(chunks).alias("chunk"))
    cells = (
        asked.unionByName(held)
        .select((F.col("span") * chunks + F.col("chunk")).alias("cell"), "kind", "vec_id", "v")
        .repartition(spans * chunks, "cell")
        .sortWithinPartitions("cell", "kind", "vec_id")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked_ids, asked_rows, best = None, [], [], None
        ids: list[np.ndarray] = []
        values: list[np.ndarray] = []

        def flush() -> None:
            nonlocal best
            if best is None and asked_ids:
                best = Best(np.concatenate(asked_ids), np.concatenate(asked_rows), k)
            if best is not None and ids:
                best.take(Block(np.concatenate(ids), np.concatenate(values)))
            ids.clear()
            values.clear()

        for batch in batches:
            cell_of = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            vec_ids = batch.column(2).to_numpy()
            cuts = np.flatnonzero((np.diff(cell_of) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if cell_of[lo] != cell:
                    flush()
                    if best is not None:
                        yield from best.rows()
                    cell, asked_ids, asked_rows, best = cell_of[lo], [], [], None
                for at in range(lo, hi, BLOCK_ROWS):
                    end = min(hi, at + BLOCK_ROWS)
                    found = matrix(batch.column(3).slice(at, end - at), dims)
                    if kinds[lo] == 0:
                        asked_ids.append(vec_ids[at:end])
                        asked_rows.append(found)
                        continue
                    if ids and sum(map(len, ids)) + end - at > BLOCK_ROWS:
                        flush()
                    ids.append(vec_ids[at:end])
                    values.append(found)
        flush()
        if best is not None:
            yield from best.rows()

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return (
        cells.mapInArrow(search, FOUND)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
