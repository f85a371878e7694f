"""Hard negatives by exact scores, multiplied in residue number systems.

Rows are dealt to spans and anchors to chunks; a cell is one span against one
chunk, whose anchors are held while its rows stream by in blocks. The score matrix
of a block is found modulo several small primes: centred residues are multiplied in
float32, in slices of components short enough that every partial sum is an exact
integer below 2**24. Chinese remaindering in mixed radix puts the exact signed
scores together; a block takes as many primes as its largest components ask for.

A first pass keeps, per cell and anchor, the best rows of the same label; a window
merges them into the positives. A second pass takes the anchors with their positives
and keeps, per cell and pair, the best rows of other labels whose score lies between
``low`` and ``high`` hundredths (of ``den``) of the positive's; a window merges those.

Null and non-finite components, null vectors, null labels and null ids leave a row
out. An empty vector takes part and scores 0; missing trailing components count as 0.
Ties go to the smaller id. A row repeated under one id is a candidate each time and
never a positive of its own id; of anchors that share an id the one with the smallest
label and vector asks. Components of any finite size are scored exactly; only a
returned score that does not fit a long fails. Vectors may be of any dimension: memory
of a task is a chunk of anchors and a block of rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import ready_workers, saved

BLOCK_ROWS = 4096
SPAN_ROWS = 16384
CHUNK_ANCHORS = 16384
ANCHOR_BATCH = 256
EXACT_FLOAT32 = 1 << 24
NARROW = 1 << 55  # products of primes below this leave room for the factors of the band


@cache
def primes() -> tuple[int, ...]:
    """Primes below 2048: those below 256 from the largest down, then the others upward."""
    sieve = np.ones(2048, bool)
    sieve[:2] = False
    for n in range(2, 46):
        sieve[n * n :: n] &= not sieve[n]
    found = [int(p) for p in np.flatnonzero(sieve)]
    return (*[p for p in reversed(found) if p < 256], *[p for p in found if p > 256])


def moduli(bound: int) -> list[int]:
    """The fewest leading primes whose product tells all integers of size up to ``bound`` apart."""
    out, product = [], 1
    for p in primes():
        if product > 2 * bound + 1:
            break
        out.append(p)
        product *= p
    if product <= 2 * bound + 1:
        raise ValueError("components are too large for the primes below 2048")
    return out


class Residues:
    """Rows of integers (held as doubles, which are exact) and their centred residues, each made once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.largest = int(np.abs(values).max()) if values.size else 0
        self.known: dict[int, np.ndarray] = {}

    def of(self, p: int) -> np.ndarray:
        if p not in self.known:
            rest = np.fmod(self.values, p)  # exact for doubles of any size
            rest -= p * np.round(rest / p)
            self.known[p] = rest.astype(np.float32)
        return self.known[p]


def modular_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p (0 to p - 1) of centred residues."""
    step = max(1, (EXACT_FLOAT32 - 1) // max(1, (p // 2) ** 2))
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], step):
        total += (a[:, at : at + step] @ b[:, at : at + step].T).astype(np.int64)
    return total % p


def exact_scores(a: Residues, rows: slice, b: Residues) -> np.ndarray:
    """All inner products of ``a``'s ``rows`` with ``b``'s: int64, or Python integers where those are too narrow."""
    dims = a.values.shape[1]
    used = moduli(dims * a.largest * b.largest)
    digits: list[np.ndarray] = []
    product = 1
    for p in used:
        found = modular_product(a.of(p)[rows], b.of(p), p)
        known = np.zeros_like(found)
        for digit, q in zip(reversed(digits), reversed(used[: len(digits)]), strict=True):
            known = (known * q + digit) % p
        digits.append((found - known) * pow(product % p, -1, p) % p)
        product *= p
    total = np.zeros((len(range(*rows.indices(len(a.values)))), len(b.values)), np.int64)
    if product >= NARROW:
        total = total.astype(object)
        digits = [d.astype(object) for d in digits]
    for digit, q in zip(reversed(digits), reversed(used), strict=True):
        total = total * q + digit
    return np.where(total > product // 2, total - product, total)


class Best:
    """The k best (score, id) of each of n askers so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (minus score, id), ascending

    def take(self, asker: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = self.found[asker]
        if len(own) == self.k:
            reach = scores >= -own[-1][0]
            scores, ids = scores[reach], ids[reach]
        if len(scores) > self.k:
            reach = scores >= np.sort(scores)[-self.k]
            scores, ids = scores[reach], ids[reach]
        if len(scores):
            self.found[asker] = sorted([*own, *((-int(s), int(i)) for s, i in zip(scores, ids, strict=True))])[: self.k]


class Scores:
    """Scores as Arrow columns: longs, or big-endian bytes that sort alike where longs may be too narrow."""

    def __init__(self, bound: int):
        self.width = 0 if bound < 1 << 62 else bound.bit_length() // 8 + 1
        self.kind = "binary" if self.width else "long"
        self.half = 1 << (8 * self.width - 1) if self.width else 0

    def column(self, scores: list[int]) -> pa.Array:
        if not self.width:
            return pa.array(scores, pa.int64())
        return pa.array([(s + self.half).to_bytes(self.width, "big") for s in scores], pa.binary())

    def number(self, score: int | bytes) -> int:
        return int.from_bytes(score, "big") - self.half if self.width else score

    def longs(self, df: DataFrame, names: list[str]) -> DataFrame:
        """The named columns as longs; one that does not fit fails."""
        if not self.width:
            return df
        spots = [df.columns.index(n) for n in names]
        kinds = ", ".join(f"{n} {'long' if n in names else kind}" for n, kind in df.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = list(batch.columns)
                for i in spots:
                    columns[i] = pa.array([self.number(s) for s in columns[i].to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return df.mapInArrow(run, kinds)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles, shorter ones padded with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as whole doubles: exact at any size."""
    return F.transform(vector, lambda x: F.rint((x.cast("double") * scale) - F.pmod(x.cast("double") * scale, F.lit(1.0))))


def usable(vector: Column) -> Column:
    """No component is null or non-finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")), F.lit(False))
    )


def cells(anchors: DataFrame, rows: DataFrame, spans: int, chunks: int) -> DataFrame:
    """Anchors once per span, rows once per chunk of anchors; the anchors of a cell come first."""

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    span, chunk = F.pmod(F.xxhash64("vec_id"), F.lit(spans)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks))
    asked = anchors.select("*", F.lit(0).alias("kind"), chunk.alias("chunk"), numbers(spans).alias("span"))
    held = rows.select("*", F.lit(1).alias("kind"), span.alias("span"), numbers(chunks).alias("chunk"))
    cell = (F.col("span") * chunks + F.col("chunk")).cast("int")
    return (
        asked.unionByName(held, allowMissingColumns=True)
        .withColumn("cell", cell)
        .drop("span", "chunk")
        .repartitionById(spans * chunks, F.col("cell"))
        .sortWithinPartitions("cell", "kind", "vec_id")
    )


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, kind, piece): pieces of one cell and kind, at most ``BLOCK_ROWS`` long."""
    for batch in batches:
        cell, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            for at in range(lo, hi, BLOCK_ROWS):
                yield int(cell[at]), int(kind[at]), batch.slice(at, min(hi, at + BLOCK_ROWS) - at)


def blocks(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Neighbouring pieces joined to blocks of about ``BLOCK_ROWS``."""
    waiting: list[pa.RecordBatch] = []
    for piece in pieces:
        if waiting and sum(p.num_rows for p in waiting) + piece.num_rows > BLOCK_ROWS:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
        waiting.append(piece)
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def searched(batches: Iterator[pa.RecordBatch], dims: int, judge) -> Iterator[pa.RecordBatch]:
    """For each cell a judge of its anchors, fed the exact scores of its rows block by block."""
    for _, pieces in groupby(runs(batches), key=lambda r: r[0]):
        asked: list[pa.RecordBatch] = []
        found = None
        for kind, part in groupby(pieces, key=lambda r: r[1]):
            if kind == 0:
                asked = [piece for _, _, piece in part]
                continue
            if not asked:
                continue
            anchors = pa.Table.from_batches(asked).combine_chunks()
            found = judge(anchors)
            a = Residues(matrix(anchors.column("v").combine_chunks(), dims))
            for block in blocks(piece for _, _, piece in part):
                ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
                b = Residues(matrix(block.column("v").combine_chunks(), dims))
                for at in range(0, len(anchors), ANCHOR_BATCH):
                    rows = slice(at, at + ANCHOR_BATCH)
                    for n, scores in enumerate(exact_scores(a, rows, b), at):
                        found.take(n, scores, ids, labels)
        if found is not None:
            yield found.rows()


class Positives:
    """The best rows of the anchor's own label."""

    def __init__(self, anchors: pa.Table, k: int, kind: Scores):
        self.kind = kind
        self.ids, self.labels = anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist()
        self.best = Best(len(self.ids), k)

    def take(self, n: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fit = (labels == self.labels[n]) & (ids != self.ids[n])
        self.best.take(n, scores[fit], ids[fit])

    def rows(self) -> pa.RecordBatch:
        flat = [(anchor, i, -s) for anchor, own in zip(self.ids, self.best.found, strict=True) for s, i in own]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64()), self.kind.column([r[2] for r in flat])],
            names=["anchor_id", "positive_id", "positive_score"],
        )


class Negatives:
    """For each positive of an anchor, the best rows of other labels within its band."""

    def __init__(self, anchors: pa.Table, k: int, kind: Scores, low: int, high: int, den: int):
        self.kind, self.band = kind, (low, high, den)
        self.ids, self.labels = anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist()
        given = anchors.column("positives").to_pylist()
        self.positives = [[(p["place"], p["positive_id"], kind.number(p["positive_score"])) for p in own] for own in given]
        self.best = [Best(len(own), k) for own in self.positives]

    def take(self, n: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        low, high, den = self.band
        other = labels != self.labels[n]
        scores, ids = scores[other], ids[other]
        for m, (_, _, positive) in enumerate(self.positives[n]):
            least, most = -(-low * positive // den), high * positive // den  # scores are integers
            fit = (scores >= least) & (scores <= most)
            if fit.any():
                self.best[n].take(m, scores[fit], ids[fit])

    def rows(self) -> pa.RecordBatch:
        flat = [
            (anchor, *positive, i, -s)
            for anchor, own, best in zip(self.ids, self.positives, self.best, strict=True)
            for positive, found in zip(own, best.found, strict=True)
            for s, i in found
        ]
        columns = list(zip(*flat, strict=True)) or [()] * 6
        longs = [pa.array(list(columns[c]), pa.int64()) for c in (0, 2, 4)]
        return pa.RecordBatch.from_arrays(
            [
                longs[0], pa.array(list(columns[1]), pa.int32()), longs[1], self.kind.column(list(columns[3])),
                longs[2], self.kind.column(list(columns[5])),
            ],
            names=["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"],
        )


def mined(
    rows: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    den: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    span_rows: int = SPAN_ROWS,
    chunk_anchors: int = CHUNK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says which rows ask, ``label`` gives the label of a row (null: it takes no part).
    """
    ready_workers(rows)
    vectors = (
        rows.select(
            F.col(id_col).cast("long").alias("vec_id"),
            label.cast("long").alias("label"),
            F.coalesce(anchors, F.lit(False)).alias("asks"),
            F.col(vector_col).alias("v"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
        .withColumn("v", quantised(F.col("v"), scale))
    )
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    sizes = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("dims"), F.max(largest).alias("top")
    ).first()
    dims = sizes["dims"] or 1
    kind = Scores(dims * int(sizes["top"] or 0) ** 2)
    spans, chunks = max(1, ceil(sizes["n"] / span_rows)), max(1, ceil(sizes["q"] / chunk_anchors))
    held = vectors.drop("asks")
    first = F.min(F.struct("label", "v")).alias("first")
    asking = vectors.where("asks").groupBy("vec_id").agg(first).select("vec_id", "first.label", "first.v")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return searched(batches, dims, lambda a: Positives(a, positives, kind))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return searched(batches, dims, lambda a: Negatives(a, negatives, kind, low, high, den))

    by_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = saved(
        cells(asking, held, spans, chunks)
        .mapInArrow(nearest, f"anchor_id long, positive_id long, positive_score {kind.kind}")
        .withColumn("place", F.row_number().over(by_anchor))
        .where(F.col("place") <= positives),
        "positives",
    )
    own = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives")
    )  # at most ``positives`` each
    by_pair = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = (
        cells(asking.join(own, "vec_id"), held, spans, chunks)
        .mapInArrow(
            within,
            f"anchor_id long, place int, positive_id long, positive_score {kind.kind}, negative_id long, negative_score {kind.kind}",
        )
        .withColumn("rank", F.row_number().over(by_pair))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
    return kind.longs(found, ["positive_score", "negative_score"])
