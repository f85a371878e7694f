"""SentencePiece encoding and decoding by relational lattices.

Words are cut where no piece of the table can reach across (before white space
marks). For each distinct word all substrings up to the longest piece are joined to the piece
table; the matches, grouped by word, are its lattice. A fold over the lattice
picks the segmentation: ``viterbi`` the path with the best sum of scores (the
rule of unigram models), ``merges`` the order of merges by score (the rule of
models trained by pair merging, whose scores are ranks and no log-probabilities).

``encoded`` does this in Arrow batches: substrings, join, grouping and fold are
array operations over all distinct words of a batch, and texts never move.
``segmented_words`` is the same in DataFrame operations with a higher-order
aggregate as the fold. README gives the reason for the first.

A null text is the empty text, which has no pieces. Characters without a piece
become byte pieces. The white space mark itself in a text decodes to a space. Null ids
pass through, repeated rows are encoded each, long texts and words are whole.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ready_workers, texts

MARK = "▁"
NONE = np.int64(1) << 60
UNKNOWN_COST = 10  # below the lowest score
CHUNK = 1 << 17  # characters in one lattice
LONG_WORD = 128  # longer words are merged one by one
CACHED_WORDS = 400_000
SLICE_ROWS = 1000
PARTING = "\x00"  # parts words inside a batch that does not hold it
WORD_START = re.compile(f"(?<!{MARK})(?={MARK})")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in ids]
        self.text = [sp.id_to_piece(i) for i in ids]
        self.ids = np.array([i for i in ids if not special[i]], np.int64)
        self.scores = {int(i): round(sp.get_score(int(i))) for i in self.ids}
        self.bytes = {int(self.text[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(len(self.text[i]) for i in self.ids)
        if any(MARK in self.text[i].lstrip(MARK) for i in self.ids):
            raise ValueError("pieces reach across white space; words cannot be encoded apart")
        self.lowest = min(self.scores.values())
        order = sorted({s for s in self.scores.values()}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        self.rank = {i: place[s] for i, s in self.scores.items()}
        # per length: sorted hashes and the ids behind them
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            own = [int(i) for i in self.ids if len(self.text[i]) == n]
            hashes = np.array([window_hash(codes(self.text[i])) for i in own], np.uint64)
            if len(np.unique(hashes)) != len(hashes):
                raise ValueError("two pieces share a hash")
            turn = np.argsort(hashes)
            self.tables.append((hashes[turn], np.array(own, np.int64)[turn]))
        size = len(self.text)
        self.score_of = np.full(size, -NONE, np.int64)
        self.rank_of = np.full(size, NONE, np.int64)
        for i in self.scores:
            self.score_of[i], self.rank_of[i] = self.scores[i], self.rank[i]
        self.raw = [
            bytes([int(t[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else t.replace(MARK, " ").encode()
            for i, t in enumerate(self.text)
        ]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def sign_hash(c: np.ndarray) -> np.ndarray:
    c = (c + np.uint64(0x51ED2701)) * np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    return c * np.uint64(0xD6E8FEB86659FD93)


def window_hash(c: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in sign_hash(c):
            h = h * FACTOR + x
    return h


def lattice(words: list[str], table: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids by (end, length - 1), -1 without a piece; start and end of each word."""
    flat = codes("".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    inside = np.arange(len(flat)) - np.repeat(starts, sizes)  # place in the word
    found = np.full((len(flat), table.longest), -1, np.int32)
    signs = sign_hash(flat)
    h = signs.copy()
    power = np.uint64(1)
    for n, (hashes, ids) in enumerate(table.tables[: len(flat)], 1):
        if n > 1:
            power = np.uint64((int(power) * int(FACTOR)) & 0xFFFFFFFFFFFFFFFF)
            h[n - 1 :] = h[n - 1 :] + signs[: len(signs) - n + 1] * power
        spots = np.flatnonzero(inside >= n - 1)
        if not len(spots) or not len(hashes):
            continue
        own = h[spots]
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = hashes[at] == own
        found[spots[hit], n - 1] = ids[at[hit]]
    return found, starts, ends


def viterbi(found: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ends and lengths of the best paths' steps in order, folded over places of all words at once."""
    size = len(found)
    inside = np.arange(size) - np.repeat(starts, ends - starts)
    score = np.where(found >= 0, table.score_of[found], -NONE)
    no_sign = found[:, 0] < 0
    score[no_sign, 0] = table.lowest - UNKNOWN_COST
    best = np.zeros(size + 1, np.int64)  # best[e + 1]: score of the path that ends behind place e
    back = np.ones(size, np.int64)
    order = np.argsort(inside, kind="stable")
    cuts = np.searchsorted(inside[order], np.arange(int(inside.max(initial=-1)) + 2))
    for p in range(len(cuts) - 1):
        at = order[cuts[p] : cuts[p + 1]]
        most = min(p + 1, table.longest)
        sums = score[at, :most].copy()
        for n in range(1, most + 1):
            if n <= p:
                sums[:, n - 1] += best[at - n + 1]
        turned = sums[:, ::-1]  # longest first, so that it wins ties
        n = most - turned.argmax(axis=1)
        back[at] = n
        best[at + 1] = sums[np.arange(len(at)), n - 1]
    at, first, steps = ends[ends > starts] - 1, starts[ends > starts], []
    while len(at):
        steps.append(at)
        at = at - back[at]
        at, first = at[at >= first], first[at >= first]
    taken = np.sort(np.concatenate(steps)) if steps else np.zeros(0, np.int64)
    return taken, back[taken]


def merge_long(found: np.ndarray, a: int, b: int, rank_of: np.ndarray) -> list[tuple[int, int]]:
    """Merges of one long word by a queue."""
    right = {i: i + 1 for i in range(a, b)}  # start of a symbol -> its end
    left = {i + 1: i for i in range(a, b)}  # end of a symbol -> its start
    queue: list[tuple[int, int, int, int]] = []

    def offer(start: int, middle: int) -> None:
        end = right.get(middle)
        if end is not None and end - start <= found.shape[1] and found[end - 1, end - start - 1] >= 0:
            heapq.heappush(queue, (int(rank_of[found[end - 1, end - start - 1]]), start, middle, end))

    for i in range(a, b - 1):
        offer(i, i + 1)
    while queue:
        _, start, middle, end = heapq.heappop(queue)
        if right.get(start) != middle or right.get(middle) != end:
            continue
        del right[middle], left[middle]
        right[start], left[end] = end, start
        if start > a:
            offer(left[start], start)
        offer(start, end)
    return [(e - 1, e - s) for s, e in sorted(right.items())]


def merges(found: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ends and lengths of all symbols in order after repeated best merges, one per word and round."""
    rank = np.where(found >= 0, table.rank_of[found], NONE)
    sizes = ends - starts
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.flatnonzero(sizes > LONG_WORD):
        steps = np.array(merge_long(found, int(starts[w]), int(ends[w]), table.rank_of))
        kept.append((steps[:, 0], steps[:, 1]))
    live = (sizes <= LONG_WORD) & (sizes > 0)
    word = np.repeat(np.arange(len(sizes)), sizes)
    first = np.flatnonzero(live[word])
    word = word[first]
    while len(first):
        head = np.append(True, word[1:] != word[:-1])
        end = np.append(first[1:], 0)
        last = np.append(head[1:], True)
        end[last] = ends[word[last]]
        span = np.append(end[1:], 0) - first
        pair = np.flatnonzero(~last & (span <= table.longest))
        value = np.full(len(first), NONE, np.int64)
        value[pair] = rank[end[pair + 1] - 1, span[pair] - 1]
        heads = np.flatnonzero(head)
        least = np.minimum.reduceat(value, heads)
        going = np.repeat(least < NONE, np.diff(np.append(heads, len(first))))
        kept.append((end[~going] - 1, (end - first)[~going]))
        chosen = np.flatnonzero(going & (value == np.repeat(least, np.diff(np.append(heads, len(first))))))
        leftmost = chosen[np.append(True, word[chosen[1:]] != word[chosen[:-1]])] if len(chosen) else chosen
        going[leftmost + 1] = False
        first, word = first[going], word[going]
    at, size = (np.concatenate([k[i] for k in kept]) if kept else np.zeros(0, np.int64) for i in (0, 1))
    order = np.argsort(at)
    return at[order], size[order]


FOLDS = {"viterbi": viterbi, "merges": merges}


class Encoder:
    """Ids of texts through the ids of their distinct words, with a bounded memory of words."""

    def __init__(self, path: str, fold: str):
        self.table, self.fold, self.known = pieces(path), FOLDS[fold], {}

    def words(self, words: list[str]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = []
        at = 0
        while at < len(words):
            size, end = 0, at
            while end < len(words) and (end == at or size + len(words[end]) <= CHUNK):
                size += len(words[end])
                end += 1
            out += self.chunk(words[at:end])
            at = end
        return out

    def chunk(self, words: list[str]) -> list[tuple[int, ...]]:
        found, starts, ends = lattice(words, self.table)
        at, size = self.fold(found, starts, ends, self.table)
        ids = found[at, size - 1].astype(np.int64)
        bounds = np.searchsorted(at, np.append(starts, ends[-1] if len(ends) else 0)).tolist()
        flat = ids.tolist()
        out = [tuple(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if (ids < 0).any():  # characters without a piece
            text = "".join(words)
            for w in np.unique(np.searchsorted(ends, at[ids < 0], side="right")):
                own: list[int] = []
                for k in range(bounds[w], bounds[w + 1]):
                    if flat[k] >= 0:
                        own.append(flat[k])
                    elif self.table.bytes:
                        own += [self.table.bytes[b] for b in text[at[k]].encode("utf-8", "surrogatepass")]
                    else:
                        own.append(self.table.unknown)
                out[w] = tuple(own)
        return out

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and the bounds of each text in them."""
        marked = pc.replace_substring(column, " ", MARK)
        marked = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(MARK, marked, ""))
        # a word is a run of marks and what follows it
        if pc.any(pc.match_substring(marked, PARTING)).as_py():
            split = pa.array([WORD_START.split(t) for t in marked.to_pylist()], pa.list_(pa.string()))
        else:
            parted = pc.replace_substring(marked, MARK, PARTING + MARK)
            while pc.any(pc.match_substring(parted, MARK + PARTING)).as_py():
                parted = pc.replace_substring(parted, MARK + PARTING + MARK, MARK + MARK)
            split = pc.split_pattern(parted, PARTING)
        coded = pc.dictionary_encode(split.flatten())
        spelled = coded.dictionary.to_pylist()
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = [w for w in spelled if w not in self.known]
        self.known.update(zip(new, self.words(new), strict=True))
        lists = [self.known[w] for w in spelled]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        which = coded.indices.to_numpy(zero_copy_only=False)
        begins, counts = (np.cumsum(sizes) - sizes)[which], sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        spots = np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])
        return flat[spots], ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def decode(ids: np.ndarray, table: Pieces) -> str:
    """The text behind ``ids``; bytes that are no UTF-8 become replacement characters."""
    raw = b"".join([table.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return raw[1:] if raw.startswith(" ") else raw


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: str = "merges", path: str | None = None
) -> DataFrame:
    """doc_id, ids (array<int>), text_back: the ids of every text and what they decode to."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, fold)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                ids, bounds = encoder.batch(cut.column(1))
                back = [
                    decode(ids[a:b], encoder.table) for a, b in zip(bounds[:-1], bounds[1:], strict=True)
                ]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), lists, pa.array(back, pa.string())], names=["doc_id", "ids", "text_back"]
                )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text_back string")


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text from ids; null ids are no pieces."""
    path = path or model_path()
    ready_workers(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            back = [decode(np.array(x or [], np.int64), table) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )


def digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: str = "merges", path: str | None = None
) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), round_trip."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, fold)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                ids, bounds = encoder.batch(cut.column(1))
                spans = list(zip(bounds[:-1], bounds[1:], strict=True))
                same = [
                    decode(ids[a:b], encoder.table) == t.replace(MARK, " ")
                    for (a, b), t in zip(spans, cut.column(1).to_pylist(), strict=True)
                ]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_pieces", "ids_crc32", "round_trip"],
                )

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"
    )


def piece_table(spark, path: str | None = None) -> DataFrame:
    """piece, id, score of every ordinary piece: as many rows as the vocabulary has."""
    table = pieces(path or model_path())
    return spark.createDataFrame(
        [(table.text[i], int(i), table.scores[int(i)]) for i in table.ids], "piece string, id int, score long"
    )


def segmented_words(words: DataFrame, word_col: str = "word", path: str | None = None) -> DataFrame:
    """word, ids (array<int>): Viterbi segmentation in DataFrame operations.

    Substrings are exploded and joined to the piece table (broadcast: one row per
    piece of the vocabulary); edges are grouped by word and folded by a
    higher-order aggregate from place to place. A character without a piece is an
    edge of id ``-1 - place``.
    """
    table = pieces(path or model_path())
    w = words.select(F.col(word_col).alias("word")).where("word is not null and word <> ''").distinct()
    n = F.length("word")
    spans = (
        w.withColumn("end", F.explode(F.sequence(F.lit(1), n)))
        .withColumn("size", F.explode(F.sequence(F.lit(1), F.least("end", F.lit(table.longest)))))
        .withColumn("piece", F.substring("word", F.col("end") - F.col("size") + 1, F.col("size")))
    )
    edges = spans.join(F.broadcast(piece_table(words.sparkSession, path)), "piece", "left").where(
        "id is not null or size = 1"
    )
    edge = F.struct(
        F.col("end"),
        -F.col("size"),  # longest first, so that it wins ties
        F.coalesce("id", -F.col("end") - 1).alias("id"),
        F.coalesce("score", F.lit(table.lowest - UNKNOWN_COST)).cast("long").alias("score"),
    ).alias("edge")
    grouped = edges.select("word", edge).groupBy("word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    # state: for each place behind a character the best score and the last edge's size and id
    start = F.array(F.struct(F.lit(0).cast("long").alias("score"), F.lit(0).alias("size"), F.lit(-1).alias("id")))

    def step(state, e):
        size = -e["col2"]
        now = F.struct(
            (F.element_at(state, e["end"] - size + 1)["score"] + e["score"]).alias("score"),
            size.alias("size"),
            e["id"].alias("id"),
        )
        known = F.size(state) > e["end"]
        better = now["score"] > F.element_at(state, -1)["score"]
        return F.when(~known, F.concat(state, F.array(now))).when(
            better, F.concat(F.slice(state, 1, e["end"]), F.array(now))
        ).otherwise(state)

    folded = grouped.withColumn("state", F.aggregate("edges", start, step))
    back = F.struct(F.length("word").alias("at"), F.array().cast("array<int>").alias("ids"))

    def walk(path_, _):
        last = F.element_at(F.col("state"), path_["at"] + 1)
        return F.when(path_["at"] <= 0, path_).otherwise(
            F.struct(
                (path_["at"] - last["size"]).alias("at"), F.concat(F.array(last["id"]), path_["ids"]).alias("ids")
            )
        )

    return folded.select(
        "word", F.aggregate(F.sequence(F.lit(1), n), back, walk, lambda p: p["ids"]).alias("ids")
    )
