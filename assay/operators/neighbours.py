"""Graph scores of whole sources: adjacency lists travel, not paths.

A source's score for a candidate is one point per edge plus the number of two-edge
paths. Lists of at most ``PACK`` targets are joined to the edges that lead into their
node and dealt by source; a task counts the entries of the sources it meets in sorted
order, so a path costs one list entry and never a row. Only the best candidates, or the
ranks of wanted ones, become rows.

Middle nodes that pass the limit of ``operators/paths.py`` and sources with more than
``WIDE`` targets are counted as rows instead.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.paths import HEAVY, heavy_paths, two_edge_paths

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACK = 256
WIDE = 10_000
BLOCK_ENTRIES = 2_000_000
WANTED = 0  # weight of a list of wanted candidates; lists of paths weigh 1 at least


def _flat(rows: pa.Table) -> pa.Table:
    """One row per list entry: source, weight, candidate."""
    lists = rows.column("candidates").combine_chunks()
    at = pc.list_parent_indices(lists)
    return pa.table(
        {
            "source": rows.column("source").combine_chunks().take(at),
            "weight": rows.column("weight").combine_chunks().take(at),
            "candidate": lists.flatten(),
        }
    )


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the values, and the sorted values."""
    coded = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


class Scores:
    """Summed weights of a block of entries by source and candidate, both in order."""

    def __init__(self, entries: pa.Table) -> None:
        source, self.sources = _codes(entries.column("source"))
        candidate, self.candidates = _codes(entries.column("candidate"))
        weight = entries.column("weight").to_numpy()
        key = source * len(self.candidates) + candidate
        self.wanted = key[weight == WANTED]
        key, weight = key[weight != WANTED], weight[weight != WANTED]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.key = key[first]
        self.score = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(key, max(1, len(self.candidates)))

    def entries(self) -> pa.Table:
        """The same block with one entry per pair."""
        keys = np.concatenate([self.wanted, self.key])
        source, candidate = self.split(keys)
        weight = np.concatenate([np.full(len(self.wanted), WANTED, np.int64), self.score])
        return pa.table(
            {"source": self.sources.take(pa.array(source)), "weight": weight, "candidate": self.candidates.take(pa.array(candidate))}
        )

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, scores and ranks of all pairs but a source with itself, in order of source and rank."""
        source, candidate = self.split(self.key)
        own = pc.index_in(self.sources, value_set=self.candidates).fill_null(-1).to_numpy(zero_copy_only=False)
        other = candidate != own[source]
        key, score, source = self.key[other], self.score[other], source[other]
        order = np.lexsort((-score, source))  # stable: equal scores stay in the order of the candidates
        key, score, source = key[order], score[order], source[order]
        return key, score, np.arange(len(key)) - np.searchsorted(source, source) + 1


def _best(block: Scores, k: int) -> pa.RecordBatch:
    key, score, rank = block.ranked()
    kept = rank <= k
    source, candidate = block.split(key[kept])
    return pa.RecordBatch.from_arrays(
        [
            block.sources.take(pa.array(source)),
            block.candidates.take(pa.array(candidate)),
            pa.array(score[kept].astype(np.float64)),
            pa.array(rank[kept].astype(np.int32)),
        ],
        names=["source", "candidate", "score", "rank"],
    )


def _wanted(block: Scores, k: int) -> pa.RecordBatch:
    key, _, rank = block.ranked()
    wanted = np.unique(block.wanted)
    source, candidate = block.split(wanted)
    n = np.bincount(block.split(key)[0], minlength=len(block.sources))
    order = np.argsort(key)
    key, rank = key[order], rank[order]
    at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
    found = (key[at] == wanted) & (rank[at] <= k) if len(key) else np.zeros(len(wanted), bool)
    ranks = rank[at] if len(key) else np.zeros(len(wanted), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            block.sources.take(pa.array(source)),
            block.candidates.take(pa.array(candidate)),
            pa.array(ranks.astype(np.int32), mask=~found),
            pa.array(np.minimum(n, k)[source].astype(np.int32)),
        ],
        names=["source", "target", "rank", "returned"],
    )


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Scores]:
    """Whole sources, about ``limit`` entries at a time. A source beyond it is added up on the way."""
    held: list[pa.Table] = []
    n, bound = 0, limit
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_flat(pa.Table.from_batches([batch])))
        n += held[-1].num_rows
        if n < bound:
            continue
        last = batch.column("source")[batch.num_rows - 1]
        rows = pa.concat_tables(held)
        open_ = pc.equal(rows.column("source"), last)
        whole = rows.filter(pc.invert(open_))
        if whole.num_rows:
            yield Scores(whole)
        rest = rows.filter(open_)
        held = [Scores(rest).entries() if rest.num_rows >= limit else rest]
        n = held[0].num_rows
        bound = max(limit, 2 * n)
    if n:
        yield Scores(pa.concat_tables(held))


def _counter(rows_of, k: int, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, limit):
            yield rows_of(block, k)

    return count


def _packs(pairs: DataFrame, node: str, value: str, n: Column, pack: int) -> DataFrame:
    """node, weight, candidates: lists of ``pack`` values or so. ``n``: weight of a pair."""
    rows = pairs.select(F.col(node).alias("node"), F.col(value).alias("_v"), n.alias("weight"))
    size = rows.groupBy("node").agg(F.ceil(F.count("*") / F.lit(pack)).alias("_p"))
    dealt = F.pmod(F.xxhash64("_v"), F.col("_p"))
    return rows.join(size, "node").groupBy("node", "weight", dealt.alias("_i")).agg(F.collect_list("_v").alias("candidates")).drop("_i")


def _lists(edges: DataFrame, sources: DataFrame, heavy: int, pack: int) -> DataFrame:
    """source, weight, candidates: every edge and every two-edge path of the sources."""
    counted = edges.groupBy("source", "target").agg(F.count("*").alias("n"))  # repeated edges are paths each
    wanted = sources.select("source").distinct()
    first = counted.join(wanted, "source", "left_semi").withColumnRenamed("target", "mid")
    second = counted.select(F.col("source").alias("mid"), F.col("target").alias("candidate"), "n")
    into, out = (df.groupBy("mid").agg(F.count("*").cast("double").alias(c)) for df, c in ((first, "_in"), (second, "_out")))
    hubs = into.join(out, "mid").where(F.col("_in") * F.col("_out") > heavy).select("mid")
    packs = _packs(second, "mid", "candidate", F.col("n"), pack)
    direct = packs.withColumnRenamed("node", "source").join(wanted, "source", "left_semi").select("source", "weight", "candidates")

    def paths(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.withColumnRenamed("node", "mid"), "mid").select("source", (F.col("n") * F.col("weight")).alias("weight"), "candidates")

    if hubs.isEmpty():
        return direct.unionByName(paths(first, packs))
    light = paths(first.join(hubs, "mid", "left_anti"), packs)
    dense = heavy_paths(first.join(hubs, "mid", "left_semi"), second.join(hubs, "mid", "left_semi"))
    return direct.unionByName(light).unionByName(dense.select("source", F.col("paths").alias("weight"), F.array("candidate").alias("candidates")))


def _row_scores(edges: DataFrame, sources: DataFrame, heavy: int) -> DataFrame:
    direct = edges.join(sources.select("source"), "source", "left_semi").select(
        "source", F.col("target").alias("candidate"), F.lit(1).cast("bigint").alias("paths")
    )
    both = direct.unionByName(two_edge_paths(edges, sources, heavy)).filter("candidate <> source")
    return both.groupBy("source", "candidate").agg(F.sum("paths").cast("double").alias("score"))


def _parted(edges: DataFrame, sources: DataFrame, wide: int) -> tuple[DataFrame, DataFrame | None]:
    """Sources for lists and those, if any, that are counted as rows."""
    named = sources.select("source").distinct()
    many = edges.groupBy("source").agg(F.count("*").alias("_n")).where(F.col("_n") > wide).select("source")
    hubs = named.join(many, "source", "left_semi")
    if hubs.isEmpty():
        return named, None
    return named.join(many, "source", "left_anti"), hubs


def _dealt(lists: DataFrame) -> DataFrame:
    return lists.repartition("source").sortWithinPartitions("source")


def best_neighbours(
    edges: DataFrame, sources: DataFrame, k: int, heavy: int = HEAVY, wide: int = WIDE, pack: int = PACK, block: int = BLOCK_ENTRIES
) -> DataFrame:
    """source, candidate, score, rank: best ``k`` of every source by score, then smaller candidate."""
    from assay.operators.running import top_per_group

    listed, hubs = _parted(edges, sources, wide)
    lists = _dealt(_lists(edges, listed, heavy, pack))
    kind = edges.schema["source"].dataType.simpleString()
    best = lists.mapInArrow(_counter(_best, k, block), f"source {kind}, candidate {kind}, score double, rank int")
    if hubs is None:
        return best
    rows = top_per_group(_row_scores(edges, hubs, heavy), ["source"], [F.col("score").desc(), F.col("candidate").asc()], k)
    return best.unionByName(rows.select("source", "candidate", "score", "rank"))


def ranks_of(
    pairs: DataFrame,
    edges: DataFrame,
    sources: DataFrame,
    k: int,
    heavy: int = HEAVY,
    wide: int = WIDE,
    pack: int = PACK,
    block: int = BLOCK_ENTRIES,
) -> DataFrame:
    """source, target, rank, returned: rank of every pair among its source's best ``k`` (null beyond), and how many those are.

    ``pairs``: source, target. Pairs of other sources than the given ones are left out.
    """
    from assay.operators.running import top_per_group

    listed, hubs = _parted(edges, sources, wide)
    asked = pairs.join(listed, "source", "left_semi").groupBy("source", F.pmod(F.xxhash64("target"), F.lit(64)).alias("_i"))
    asked = asked.agg(F.collect_set("target").alias("candidates")).select("source", F.lit(WANTED).cast("bigint").alias("weight"), "candidates")
    kind = edges.schema["source"].dataType.simpleString()
    lists = _dealt(_lists(edges, listed, heavy, pack).unionByName(asked))
    found = lists.mapInArrow(_counter(_wanted, k, block), f"source {kind}, target {kind}, rank int, returned int")
    if hubs is None:
        return found
    rows = top_per_group(_row_scores(edges, hubs, heavy), ["source"], [F.col("score").desc(), F.col("candidate").asc()], k)
    sizes = rows.groupBy("source").agg(F.count("*").cast("int").alias("returned"))
    of_hubs = (
        pairs.join(hubs, "source", "left_semi")
        .select("source", "target")
        .distinct()
        .join(rows.select("source", F.col("candidate").alias("target"), "rank"), ["source", "target"], "left")
        .join(sizes, "source", "left")
    )
    return found.unionByName(of_hubs.select("source", "target", "rank", F.coalesce("returned", F.lit(0)).alias("returned")))
