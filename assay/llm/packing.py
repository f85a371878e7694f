"""Packing documents into token windows with bounded open space.

Each partition tokenizes its documents and keeps ``open_windows`` windows open.
A document, or what is left of it after whole windows are cut off, goes to the
fullest window that can hold it. When none can, the fullest window is filled
with the head of the document and emitted, and the tail is placed again, so no
emitted window is padded. The few windows still open at the end of a partition
are written with their ids and merged in groups of ``merge_fan`` partitions by
the same rule; what remains there is cut into lengths that are powers of two,
which need no padding.

A null text is an empty document: the end id alone. Null ids pass through,
repeated rows are packed each, an empty table gives no piece, and no length of
text is special. Partition ids and row order of a scan are the same when a task
runs again, so sequence ids are stable after a lost executor.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import saved, texts

WINDOW = 4096
OPEN_WINDOWS = 16
MERGE_FAN = 16
END_ID = 2
SLICE_ROWS = 1000
CACHED_WORDS = 300_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts through the ids of their distinct words.

    The vocabulary ignores white space and never merges across it, so a text's
    ids are those of its words in order. Words of ordinary Latin letters, digits
    and signs are split here and go to the merge model directly; all others,
    control characters and special-token strings go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        # Fixed value: the pattern by which this vocabulary splits text.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        if not word:
            return ()
        if max(word) > "ɏ" or not word.isprintable() or "<|" in word or not unicodedata.is_normalized("NFC", word):
            return tuple(self.full.encode(word, add_special_tokens=False).ids)
        out: list[int] = []
        for part in self.split.findall("".join(map(str.lower, word)) if not word.isascii() else word.lower()):
            ids = self.parts.get(part)
            if ids is None:
                mapped = part if part.isascii() else "".join(self.signs[b] for b in part.encode())
                ids = self.parts[part] = tuple(t.id for t in self.model.tokenize(mapped))
            out += ids
        return tuple(out)

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and the bounds of each text in them."""
        split = pc.ascii_split_whitespace(column)
        coded = pc.dictionary_encode(split.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        lists, known = [], self.words
        for w in coded.dictionary.to_pylist():
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self.word(w)
            lists.append(ids)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        which = coded.indices.to_numpy(zero_copy_only=False)
        begins, counts = (np.cumsum(sizes) - sizes)[which], sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        spots = np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return flat[spots], bounds


class Packer:
    """Open windows of one partition; ``done`` gathers the rows of emitted ones."""

    def __init__(self, window: int, open_windows: int, first_sequence: int):
        self.window, self.most, self.next = window, open_windows, first_sequence
        self.open: list[list] = []  # [used, pieces]
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, None))
            at += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc, start, ids[: self.window], total)])
            ids, start = ids[self.window :], start + self.window
        while len(ids):
            fitting = [w for w in self.open if w[0] + len(ids) <= self.window]
            if not fitting and len(self.open) < self.most:
                self.open.append([0, []])
                fitting = self.open[-1:]
            target = max(fitting or self.open, key=lambda w: w[0])
            head = ids[: self.window - target[0]]
            target[0] += len(head)
            target[1].append((doc, start, head, total))
            ids, start = ids[len(head) :], start + len(head)
            if target[0] == self.window:
                self.emit(target[1])
                self.open.remove(target)

    def cut_rest(self) -> None:
        """Emit what is open in lengths that are powers of two."""
        rest = [p for w in self.open for p in w[1]]
        left = sum(len(p[2]) for p in rest)
        while left:
            room = min(self.window, 1 << (left.bit_length() - 1))
            left -= room
            taken = []
            while room:
                doc, start, ids, total = rest.pop(0)
                taken.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= len(taken[-1][2])
            self.emit(taken)
        self.open = []

    def rows(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        return as_batch(done)


FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
ARROW = pa.schema([(f, pa.int64()) for f in FIELDS] + [("ids", pa.binary())])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    merge_fan: int = MERGE_FAN,
    path: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        packer = Packer(window, open_windows, part << 32)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                ids, bounds = encode.batch(cut.column(1))
                for k, doc in enumerate(cut.column(0).to_pylist()):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    packer.add(doc, 0, own, len(own))
                yield packer.rows()
        left = [
            (doc, start, len(own), zlib.crc32(own.tobytes()), total, part, n, own.tobytes())
            for n, w in enumerate(packer.open)
            for doc, start, own, total in w[1]
        ]
        yield as_batch(left)

    def merge(group: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("sequence_id", "offset", "doc_id", "start")]
        rows = group.sort_by(order).to_pylist()
        packer = Packer(window, open_windows, (1 << 62) + ((rows[0]["sequence_id"] // merge_fan) << 32))
        for r in rows:
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        packer.cut_rest()
        return pa.Table.from_batches([packer.rows()])

    filled = saved(texts(docs, id_col, text_col).mapInArrow(fill, PIECES), "windows")
    whole = filled.where("ids is null")
    left = (
        filled.where("ids is not null")
        .withColumn("fan", F.floor(F.col("sequence_id") / merge_fan))
        .groupBy("fan")
        .applyInArrow(lambda t: merge(t.drop_columns(["fan"])), PIECES)
    )
    return whole.unionByName(left).drop("ids")
