"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence.

The columns (hashed n-grams) are dealt into column blocks whose number follows from the
size of a row: two rows that differ in every block differ in more columns than
their sizes allow, so such pairs are discarded unseen. What is left is found by one
shuffle of block signatures: rows with an equal block become neighbours, and
neighbourhoods are closed to clusters. Inside a cluster the product is
computed exactly, in bounded pairs of row blocks: overlaps are counted first over
each row's rarest columns, pairs without overlap there cannot reach the bound
that follows from their sizes, and only the others are counted in full.

Blocks with fewer than two columns say little, not counting columns that a
large share of all documents holds (passages, licence lines). There are more blocks than may
differ, so most rows do without theirs; a row with many such blocks, like the
members of a large family of copies, uses them too. The few rows with very many empty
blocks join those with their smallest hashes, of which linked rows share one. Which columns are common only
steers the work. Nothing is capped: every linked pair is compared.

Passages and weak blocks chain rows that are not linked, and the chains grow faster than the input. A cluster of more
than one row block is therefore split once more, by blocks of its rare columns alone (``finer_keys``).
What is still larger is compared in pairs of row blocks, for which its sets are copied; the copies are
made in rounds of bounded size, and the shuffles of a round go when it is written.

Rows with equal sets are one class, compared once; the first of a class in each
map task stands for it. Null and empty texts have no shingles and link with nothing.
A text of fewer words than a shingle is one shingle. Rows that repeat an id are
one document, a row without an id links with nothing. Sets are of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil, exp, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import SHUFFLES_GO, saved, texts
from assay.session import Scratch, settings

BLOCK_SHINGLES = 1 << 20  # shingles of a row block
SLICE_ROWS = 500
SEEN = 500_000
KEYS_AT_ONCE = 1 << 19
LEAST_RARE = 2  # columns that are not common, in a block that says enough
COMMON_SHARE = 0.0005  # of all documents; at most (mean set size / share) columns are that common
COMMON_LEAST = 10
FINER = 1.4  # blocks of rare columns over those that may differ
ROUND_SHARE = 0.5  # of the shingles of all rows: so many are copied to pairs of row blocks at once
COUNTED_AT_ONCE = 1 << 20  # shingles whose documents are counted together in a task
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
ODD3 = np.uint64(0x165667B19E3779F9)
LOW32 = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD2
    x = (x ^ (x >> np.uint64(29))) * ODD3
    return x ^ (x >> np.uint64(32))


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(column))
    coded = pc.dictionary_encode(split.flatten())
    spelled = coded.dictionary.to_pylist()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in spelled), np.uint64, len(spelled))
    blank = np.fromiter((not w for w in spelled), bool, len(spelled))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = codes[a:b]
        if b > a:  # only the first and the last may be blank
            own = own[int(blank[own[0]]) : len(own) - int(len(own) > 1 and blank[own[-1]])]
        h = known[own]
        if not len(h):
            out.append(h)
            continue
        size = min(words, len(h))
        total = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            total = mix(total * ODD + h[i : len(h) - size + 1 + i])
        out.append(np.unique(total))
    return out


class Bounds:
    """What a least similarity of num/den means for sizes and differences."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        width = (den / num) ** 1.5
        self.edges = [1]  # first size of each band; a row links into its own or the next band at most
        while self.edges[-1] < 1 << 40:
            self.edges.append(int(self.edges[-1] * width) + 1)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def bands(self, n: int) -> list[int]:
        own = self.band(n)
        reaches = n * self.den >= self.edges[own + 1] * self.num
        return [own, own + 1] if reaches else [own]

    def differ(self, n: int, band: int) -> int:
        """Columns in which a row of ``n`` and a linked row of the band may differ at most."""
        most = 2 * (self.edges[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        return min(most, n * (self.den - self.num) // self.num)

    @lru_cache(maxsize=4096)  # noqa: B019  one object per task
    def blocks(self, band: int) -> int:
        """Column blocks of a band: enough that few rows of it have too many weak ones."""
        sizes = np.unique(np.linspace(self.edges[band], self.edges[band + 1] - 1, 5).astype(np.int64))
        differ = [self.differ(int(n), band) for n in sizes]
        if not differ[-1]:
            return 1  # linked rows are equal
        for blocks in range(differ[-1] + 1, 2 * differ[-1] + 8):
            weak = [blocks * exp(-n / blocks) * (1 + n / blocks) for n in sizes]
            spare = 1 + blocks // 50  # for a few blocks of common columns
            if all(blocks - d >= w + 2 * sqrt(w) + spare for d, w in zip(differ, weak, strict=True)):
                return blocks
        return differ[-1] + 1

    def prefix(self, n: int) -> int:
        """Linked rows share one of so many smallest hashes."""
        return n - -(-n * self.num // self.den) + 1

    def linked(self, overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether ``overlap`` reaches the bound for two rows of ``sizes`` together."""
        return overlap * (self.den + self.num) >= self.num * sizes


def signatures(row: np.ndarray, bounds: Bounds, common: np.ndarray) -> np.ndarray:
    """Keys of which every two linked rows share one at least; ``common`` is sorted."""
    out = []
    rare = np.ones(len(row), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, row), len(common) - 1)] != row
    for band in bounds.bands(len(row)):
        blocks = bounds.blocks(band)
        place = (((row * ODD) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
        spread = mix(row)
        low = np.bincount(place, (spread & LOW32).astype(np.float64), blocks).astype(np.uint64)
        high = np.bincount(place, (spread >> np.uint64(32)).astype(np.float64), blocks).astype(np.uint64)
        key = mix(mix(low + ODD * high) + np.arange(blocks, dtype=np.uint64) * ODD2 + np.uint64(band))
        strong = (np.bincount(place, rare, blocks) >= LEAST_RARE) | (blocks == 1)
        out.append(key[strong])
        equal = blocks - bounds.differ(len(row), band)  # so many blocks at least are equal in linked rows
        filled = np.bincount(place, minlength=blocks) > 0
        if (~strong).sum() >= equal:  # all of them may be weak
            out.append(key[filled & ~strong])
        if (~filled).sum() >= equal:  # all of them may be empty
            second = row[: bounds.prefix(len(row))]
            out.append(mix(key[~filled][:, None] * ODD3 + second).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def finer_keys(row: np.ndarray, bounds: Bounds, common: np.ndarray) -> np.ndarray:
    """Keys of which every two linked rows share one at least, of rare columns alone where these say enough.

    Linked rows differ in no more blocks of rare columns than of all. If so few blocks of one of them are weak that
    one of the equal blocks must say enough, both have its key. Otherwise both of them add their first columns, the rare ones before
    the common ones: linked rows share one of so many first columns in any order.
    """
    out = []
    rare = np.ones(len(row), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, row), len(common) - 1)] != row
    said = row[rare]
    spread = mix(said)
    for band in bounds.bands(len(row)):
        most = bounds.differ(bounds.edges[band + 1] - 1, band)
        blocks = int((most + 1) * FINER) + 1 if most else 1
        place = (((said * ODD) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
        low = np.bincount(place, (spread & LOW32).astype(np.float64), blocks).astype(np.uint64)
        high = np.bincount(place, (spread >> np.uint64(32)).astype(np.float64), blocks).astype(np.uint64)
        key = mix(mix(low + ODD * high) + np.arange(blocks, dtype=np.uint64) * ODD2 + np.uint64(band))
        strong = np.bincount(place, minlength=blocks) >= LEAST_RARE
        out.append(key[strong])
        if (~strong).sum() >= blocks - bounds.differ(len(row), band):
            first = np.concatenate([said, row[~rare]])[: bounds.prefix(len(row))]
            out.append(mix(mix(first) * ODD3 + np.uint64(band)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def digest(row: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(row.tobytes())


def often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than a small share of these documents hold, with their documents here."""
    found, held = np.unique(np.concatenate(sets), return_counts=True)
    many = held >= max(3, COMMON_SHARE / 2 * len(sets))
    return found[many], held[many]


def sets_of(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, n, digest of every row (no digest without a shingle); and rows of shingle, held counts."""

    def row_batch(ids, sizes, digests, shingles, held) -> pa.RecordBatch:
        count, more = len(sizes), len(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(more, pa.int64())]),
                pa.array([*sizes, *[None] * more], pa.int64()),
                pa.array([*digests, *[None] * more], pa.binary()),
                pa.concat_arrays([pa.nulls(count, pa.int64()), pa.array(shingles.view(np.int64))]),
                pa.concat_arrays([pa.nulls(count, pa.int64()), pa.array(held.astype(np.int64))]),
            ],
            names=["doc_id", "n", "digest", "shingle", "held"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        waiting: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                found = shingle_sets(cut.column(1), words)
                yield row_batch(cut.column(0), [len(s) for s in found], [digest(s) if len(s) else None for s in found], *none)
                waiting += [s for s in found if len(s)]
                if sum(map(len, waiting)) >= COUNTED_AT_ONCE:
                    yield row_batch(pa.nulls(0), [], [], *often(waiting))
                    waiting = []
        if waiting:
            yield row_batch(pa.nulls(0), [], [], *often(waiting))

    return rows.mapInArrow(run, "doc_id long, n long, digest binary, shingle long, held long")


def common_shingles(known: DataFrame) -> np.ndarray:
    """Sorted shingles of a large share of all documents; their number has the bound stated above."""
    documents = known.where("held is null").count()
    rows = (
        known.where("held is not null")
        .groupBy("shingle")
        .agg(F.sum("held").alias("held"))
        .where(F.col("held") >= max(COMMON_LEAST, COMMON_SHARE * documents))
        .select("shingle")
        .collect()
    )
    return np.sort(np.array([r["shingle"] for r in rows], np.int64).view(np.uint64))


def neighbours(rows: DataFrame, words: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """(a, b) with a > b: documents with an equal column block, each with the smallest of its key."""

    shared = rows.sparkSession.sparkContext.broadcast(common)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, seen = Bounds(num, den), set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                ids, found = [], []
                for doc, row in zip(cut.column(0).to_pylist(), shingle_sets(cut.column(1), words), strict=True):
                    mark = digest(row)
                    if not len(row) or mark in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(mark)
                    ids.append(doc)
                    found.append(signatures(row, bounds, shared.value))
                    if sum(map(len, found)) >= KEYS_AT_ONCE:
                        yield key_batch(ids, found)
                        ids, found = [], []
                if ids:
                    yield key_batch(ids, found)

    return beside(rows.where("doc_id is not null").mapInArrow(keys, "key long, doc_id long"))


def finer_neighbours(members: DataFrame, num: int, den: int, common: np.ndarray) -> DataFrame:
    """As ``neighbours``, of (rep, hashes) rows by their finer keys."""
    shared = members.sparkSession.sparkContext.broadcast(common)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(num, den)
        for batch in batches:
            ids, found = [], []
            for doc, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                found.append(finer_keys(np.frombuffer(held.as_buffer(), np.uint64), bounds, shared.value))
                if sum(map(len, found)) >= KEYS_AT_ONCE:
                    yield key_batch(ids, found)
                    ids, found = [], []
            if ids:
                yield key_batch(ids, found)

    return beside(members.select("rep", "hashes").mapInArrow(keys, "key long, doc_id long"))


def key_batch(ids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(found).view(np.int64)),
            pa.array(np.repeat(np.array(ids, np.int64), [len(f) for f in found])),
        ],
        names=["key", "doc_id"],
    )


def beside(keyed: DataFrame) -> DataFrame:
    """(a, b) with a > b: of the (key, doc_id) rows of a key, each id with the smallest."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_doc = None
        for batch in batches:  # sorted by key and id
            key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            starts = np.concatenate([[True], key[1:] != key[:-1]])
            if key[0] == last_key:
                starts[0] = False
            place = np.maximum.accumulate(np.where(starts, np.arange(len(key)), -1))
            first = np.where(place >= 0, doc[np.maximum(place, 0)], last_doc if last_doc is not None else 0)
            last_key, last_doc = key[-1], first[-1]
            told = first != doc
            edges = np.unique(np.stack([doc[told], first[told]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(pairs, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of an edge.

    Stars over larger and over smaller neighbours by turns; both only take minima
    per node, which combine before the shuffle, so a node with very many
    neighbours is no hot spot.
    """
    def state_of(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = saved(ordered.distinct(), "edges")
    mark = state_of(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b")
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        now = saved(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        state = state_of(now)
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def product(left: list, right: list | None, bounds: Bounds) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Links among ``left``, or between ``left`` and ``right``: (id, smallest id of its component), and links per id.

    Members are (id, copies, sorted hashes). Links count the copies of the other side.
    """
    members = [(len(s), 0, i, c, s) for i, c, s in left] + [(len(s), 1, i, c, s) for i, c, s in right or []]
    members.sort(key=lambda m: (m[0], m[1], m[2]))
    sizes = np.array([m[0] for m in members])
    side = np.array([m[1] for m in members])
    copies = np.array([m[3] for m in members])
    ids = [m[2] for m in members]
    ends = np.cumsum(sizes)
    columns, inverse, df = np.unique(
        np.concatenate([m[4] for m in members]), return_inverse=True, return_counts=True
    )
    row_of = np.repeat(np.arange(len(members)), sizes)
    postings = row_of[np.argsort(inverse, kind="stable")]
    starts = np.cumsum(df) - df

    def overlaps(cols: np.ndarray) -> np.ndarray:
        counts = df[cols]
        spots = np.repeat(starts[cols] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.bincount(postings[spots], minlength=len(members))

    group = np.arange(len(members))
    links = np.zeros(len(members), np.int64)
    for i in range(len(members) - 1):
        own = inverse[ends[i] - sizes[i] : ends[i]]
        last = int(np.searchsorted(sizes, sizes[i] * bounds.den // bounds.num, side="right"))
        fits = np.zeros(len(members), bool)
        fits[i + 1 : last] = True
        if right is not None:
            fits &= side != side[i]
        if not fits.any():
            continue
        rare = own[np.argsort(df[own], kind="stable")[: bounds.prefix(len(own))]]
        fits &= overlaps(rare[df[rare] > 1]) > 0
        if not fits.any():
            continue
        found = np.flatnonzero(fits & bounds.linked(overlaps(own), sizes + sizes[i]))
        links[i] += copies[found].sum()
        links[found] += copies[i]
        for j in found:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
    least: dict[int, int] = {}
    for g, i in zip(group.tolist(), ids, strict=True):
        least[g] = min(least.get(g, i), i)
    stars = [(i, least[g]) for g, i in zip(group.tolist(), ids, strict=True) if least[g] != i]
    return stars, {i: int(n) for i, n in zip(ids, links, strict=True) if n}


def linked(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    num: int = 80,
    den: int = 100,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row; linked where den * overlap >= num * union."""
    rows = texts(docs, id_col, text_col)
    counted = saved(sets_of(rows, words), "sets")
    known = counted.where("held is null").select("doc_id", "n", "digest")
    named = known.where("digest is not null and doc_id is not null")
    classes = saved(
        named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    common = common_shingles(counted)
    near = components(neighbours(rows, words, num, den, common))
    # one member per class; all that stand for a class share every key, so they are in one cluster
    members = saved(
        near.join(named, F.col("node") == F.col("doc_id"))
        .groupBy("digest")
        .agg(F.min("root").alias("cluster"), F.min("n").alias("n"))
        .join(classes, "digest"),
        "members",
    )

    def in_clusters(rows: DataFrame) -> DataFrame:
        totals = rows.groupBy("cluster").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
        return rows.join(totals.where("size > 1"), "cluster")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(first, SLICE_ROWS)
                found = [s.tobytes() for s in shingle_sets(cut.column(1), words)]
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), cut.column(2), pa.array(found, pa.binary())], names=["rep", "large", "hashes"]
                )

    spark = docs.sparkSession
    with Scratch(spark, "ngram-join") as scratch, settings(spark, SHUFFLES_GO):
        large = F.col("total") > block_shingles
        asked = in_clusters(members).groupBy("rep").agg(F.max(large).alias("large"))
        # texts move once; later steps read the sets of members from here
        hashes = scratch.write(
            rows.join(asked, F.col("doc_id") == F.col("rep")).select("rep", "text", "large").mapInArrow(with_sets, "rep long, large boolean, hashes binary"),
            "hashes",
        )
        if in_clusters(members).where(large).limit(1).count():
            finer = components(finer_neighbours(hashes.where("large"), num, den, common))
            members = saved(
                members.join(in_clusters(members).where(large).select("digest", F.lit(True).alias("_large")), "digest", "left")
                .join(finer, F.col("rep") == F.col("node"), "left")
                .withColumn("cluster", F.when(F.col("_large"), F.coalesce("root", "rep")).otherwise(F.col("cluster")))
                .select("digest", "cluster", "n", "rep", "copies"),
                "finer-members",
            )
        compared = compared_members(in_clusters(members), hashes, known.agg(F.sum("n")).first()[0], num, den, block_shingles)
    roots = components(compared.where("links = 0").select("a", "b"))
    links = compared.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    by_class = (
        classes.join(roots, F.col("rep") == F.col("node"), "left")
        .join(links, F.col("rep") == F.col("a"), "left")
        .select(
            "digest",
            F.coalesce("root", "rep").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return known.join(by_class, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"),
    )


def compared_members(members: DataFrame, hashes: DataFrame, shingles: int, num: int, den: int, block_shingles: int) -> DataFrame:
    """(a, b, links): stars of linked members and, with a = b, the links per member; ``members`` with total and size of their cluster.

    ``shingles``: of all rows, which bounds what a round copies.
    """
    # a cluster of more than one row block is cut by size: links join a band or two neighbouring ones
    step = log(den / num) * 1.0001
    band = F.when(F.col("total") <= block_shingles, F.lit(0)).otherwise(F.floor(F.log("n") / step)).cast("long")
    members = members.withColumn("band", band)
    cuts = members.groupBy("cluster", "band").agg(F.ceil(F.sum("n") / block_shingles).alias("parts"))

    def beside(offset: int, name: str) -> DataFrame:
        return cuts.select("cluster", (F.col("band") - offset).alias("band"), F.col("parts").alias(name))

    placed = (
        members.join(beside(0, "own"), ["cluster", "band"])
        .join(beside(1, "above"), ["cluster", "band"], "left")
        .join(beside(-1, "below"), ["cluster", "band"], "left")
        .withColumn("i", F.pmod(F.xxhash64("rep"), F.col("own")))
    )

    def numbers(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(
            F.array().cast("array<long>")
        )

    def cell(low_band, high_band, low, high, side):
        return F.struct(
            F.col("cluster").alias("cluster"),
            low_band.alias("low_band"),
            high_band.alias("high_band"),
            low.alias("low"),
            high.alias("high"),
            side.alias("side"),
        )

    at, i = F.col("band"), F.col("i")
    cells = F.concat(
        F.transform(
            numbers("own"), lambda j: cell(at, at, F.least(i, j), F.greatest(i, j), (i > j).cast("int"))
        ),
        F.transform(numbers("above"), lambda j: cell(at, at + 1, i, j, F.lit(0))),
        F.transform(numbers("below"), lambda j: cell(at - 1, at, j, i, F.lit(1))),
    )
    wanted = saved(placed.select("rep", "copies", "n", cells.alias("cells")), "cells")
    copied = wanted.agg(F.sum(F.col("n") * F.size("cells"))).first()[0] or 0
    rounds = max(1, ceil(copied / max(block_shingles, ROUND_SHARE * (shingles or 0))))

    def compare(group: pa.Table) -> pa.Table:
        bounds = Bounds(num, den)
        sides: list[dict] = [{}, {}]
        low_band, high_band, low, high = (group.column(c)[0].as_py() for c in ("low_band", "high_band", "low", "high"))
        for side, rep, copies, hashes in zip(
            *(group.column(c).to_pylist() for c in ("side", "rep", "copies", "hashes")), strict=True
        ):
            sides[side][rep] = (rep, copies, np.frombuffer(hashes, np.uint64))
        alone = low_band == high_band and low == high
        left, right = (list(s.values()) for s in sides)
        stars, links = product(left, None if alone else right, bounds)
        a = [e[0] for e in stars] + list(links)
        b = [e[1] for e in stars] + list(links)
        counts = [0] * len(stars) + list(links.values())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(counts, pa.int64())})

    def of_round(i: int) -> DataFrame:
        mine = F.filter("cells", lambda c: F.pmod(F.xxhash64(c["cluster"], c["low_band"], c["high_band"], c["low"], c["high"]), F.lit(rounds)) == i)
        held = (
            hashes.join(wanted.withColumn("cells", mine).where(F.size("cells") > 0), "rep")
            .select("rep", "copies", "hashes", F.explode("cells").alias("cell"))
            .select("cell.*", "rep", "copies", "hashes")
        )
        return held.groupBy("cluster", "low_band", "high_band", "low", "high").applyInArrow(compare, "a long, b long, links long")

    done = [saved(of_round(i), "links") for i in range(rounds)]
    return reduce(DataFrame.unionByName, done)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, with all their columns."""
    stay = (
        linked(docs, id_col, text_col, **how)
        .where("doc_id = component_id or doc_id is null")
        .select(F.col("doc_id").alias("_stay"))
        .distinct()
    )
    return docs.join(stay, docs[id_col].eqNullSafe(stay["_stay"]), "left_semi")
