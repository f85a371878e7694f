"""Best documents per query from postings in document blocks, with upper bounds per block and term.

Documents are dealt to spans of blocks, queries to chunks; a task holds the terms of
one chunk and takes the postings of its span block by block. A block knows its largest
impact of every term, so the sum of these over a query's terms bounds every score in
the block: a query whose k-th best score so far is larger skips the block. The other
queries add up the impacts of their terms, in the order of the terms, which makes equal
documents tie exactly. Where a score is weight * impact / damp, the product comes first, as
it stands: another order rounds otherwise and breaks ties of unequal documents.
A span hands on k rows per query; nothing grows with the number
of matching (query, document) pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_DOCS = 4096
LEAST_SPAN_DOCS = 1024
SPAN_DOCS = 64 * BLOCK_DOCS
CHUNK_QUERIES = 4096


class Chunk:
    """The queries of a chunk as one array of weighted terms, and the k best documents of each so far."""

    def __init__(self, table: pa.Table, k: int):
        sources = table.column("source").to_pylist()
        starts = [i for i, s in enumerate(sources) if i == 0 or s != sources[i - 1]]
        self.sources = [sources[i] for i in starts]
        self.ends = [*starts[1:], len(sources)]
        self.starts = np.array(starts)
        coded = table.column("term").combine_chunks().dictionary_encode()
        self.terms = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        self.term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = table.column("idf").to_numpy()
        self.k = k
        self.best: list[list[tuple[float, object]]] = [[] for _ in self.sources]  # (minus score, doc), ascending
        self.kth = np.zeros(len(self.sources))
        self.skipped = 0

    def take(self, block: pa.Table) -> None:
        """Merge a block, whose rows are sorted by term."""
        docs = sorted(set(block.column("doc").to_pylist()))
        place = {d: i for i, d in enumerate(docs)}
        by_text = {str(d): i for d, i in place.items()}
        spots = np.fromiter((place[d] for d in block.column("doc").to_pylist()), np.int64, block.num_rows)
        impact = block.column("impact").to_numpy()
        damp = block.column("damp").to_numpy() if "damp" in block.column_names else np.ones(len(impact))
        coded = block.column("term").combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(codes, prepend=-1))
        first, last = np.zeros(len(self.terms), np.int64), np.zeros(len(self.terms), np.int64)
        largest = np.zeros(len(self.terms))
        names = coded.dictionary.to_pylist()
        tops = np.maximum.reduceat(impact / damp, cuts)
        for lo, hi, top in zip(cuts, [*cuts[1:], len(codes)], tops, strict=True):
            at = self.terms.get(names[codes[lo]])
            if at is not None:
                first[at], last[at], largest[at] = lo, hi, top
        reach = np.add.reduceat(self.weight * largest[self.term], self.starts)
        # sums of rounded products may differ in their last bits
        active = np.flatnonzero((reach > 0) & (reach * (1 + 1e-12) >= self.kth))
        self.skipped += int((reach > 0).sum()) - len(active)
        for q in active:
            scores = np.zeros(len(docs))
            for i in range(self.starts[q], self.ends[q]):
                lo, hi = first[self.term[i]], last[self.term[i]]
                scores[spots[lo:hi]] += self.weight[i] * impact[lo:hi] / damp[lo:hi]
            own = by_text.get(str(self.sources[q]))
            if own is not None:
                scores[own] = 0
            found = np.flatnonzero((scores > 0) & (scores >= self.kth[q]))
            if len(found) > self.k:
                least = np.partition(scores[found], -self.k)[-self.k]
                found = found[scores[found] >= least]
            if len(found):
                mine = self.best[q] = sorted([*self.best[q], *((-float(scores[i]), docs[i]) for i in found)])[: self.k]
                if len(mine) == self.k:
                    self.kth[q] = -mine[-1][0]

    def rows(self, kinds: list[pa.DataType]) -> pa.RecordBatch:
        flat = [(s, d, -v) for s, own in zip(self.sources, self.best, strict=True) for v, d in own]
        columns = list(zip(*flat, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(list(c), kind) for c, kind in zip(columns, kinds)), pa.array(list(columns[2]), pa.float64())],
            names=["source", "candidate", "score"],
        )


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """((cell, block), rows) in order; block -1 holds the queries."""
    for batch in batches:
        cell, block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi > lo:
                yield (int(cell[lo]), int(block[lo])), batch.slice(lo, hi - lo)


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    cell, chunk, kinds = None, None, []
    for (at, block), rows in groupby(pieces(batches), key=lambda p: p[0]):
        table = pa.Table.from_batches([r for _, r in rows])
        if at != cell:
            if chunk is not None:
                yield chunk.rows(kinds)
            cell, chunk = at, None
        if block < 0:
            chunk, kinds = Chunk(table, k), [table.schema.field(c).type for c in ("source", "doc")]
        elif chunk is not None:
            chunk.take(table)
    if chunk is not None:
        yield chunk.rows(kinds)


def best_documents(postings: DataFrame, weights: DataFrame, n_docs: int, k: int, span_docs: int | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """source, candidate, score: the best documents of each span, at most ``k`` each and never the query itself.

    ``postings``: doc, term, impact and, if impacts are divided, damp (only terms of queries are needed); ``weights``:
    source, term, idf, once per source and term. A query is the document of the same text as its id.
    """
    spark = postings.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if span_docs is None:
        # as many spans as tasks run at once while they are worth it, and never more than SPAN_DOCS documents in one
        span_docs = min(SPAN_DOCS, max(LEAST_SPAN_DOCS, ceil(n_docs / most)))
    spans = max(1, ceil(n_docs / span_docs))
    blocks = max(1, ceil(span_docs / block_docs))
    chunks = max(1, ceil(weights.select("source").distinct().count() / CHUNK_QUERIES))

    def dealt(value: Column, n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(value, F.lit(salt)), F.lit(n)).cast("int")

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    source, doc = F.col("source"), F.col("doc")
    asked = weights.select(
        "source", "term", "idf", dealt(source, chunks, 1).alias("chunk"), F.lit(-1).alias("block"), numbers(spans).alias("span")
    )
    held = postings.select(
        "doc", "term", *[c for c in ("impact", "damp") if c in postings.columns], numbers(chunks).alias("chunk"), dealt(doc, blocks, 2).alias("block"), dealt(doc, spans, 3).alias("span")
    )
    cells = (
        asked.unionByName(held, allowMissingColumns=True)
        .withColumn("cell", F.col("span") * chunks + F.col("chunk"))
        .drop("span", "chunk")
        .repartitionById(spans * chunks, F.col("cell"))
        .sortWithinPartitions("cell", "block", "source", "term")
    )
    kinds = f"source {dict(weights.dtypes)['source']}, candidate {dict(postings.dtypes)['doc']}, score double"
    return cells.mapInArrow(lambda batches: searched(batches, k), kinds)
