"""Toxicity behind disguises: a noisy channel before a learned lexicon.

1. One pass over all texts counts every character trigram (words and their counts
   per task, then trigrams, summed by Spark). The table is neither cut nor collected.
2. Disguised spans: words with a sign or digit beside a letter, words of
   signs, words with a doubled letter, and three or more characters spelled apart. The channel lets an observed
   sign stand for several letters, a run shrink to one or two letters and
   separators vanish; Viterbi search through that lattice under the trigram
   model restores the likeliest spelling, once per distinct span. The trigrams
   that the lattices need are joined to the counts, so a task holds the costs of
   the spans at hand only.
3. A lexicon of words and word beginnings is learned from a bounded sample of
   labelled texts, with their spans restored, by a sparse logistic regression.
4. A second pass writes the spans of all texts, keyed by the MD5 of the text. A span none of
   whose readings begins with a lexicon entry can restore to nothing that counts; its
   lattice is walked against the beginnings of the entries and it is left out there.
5. The score of a text is the probability that this regression gives to the
   lexicon entries among its words, restored words and neighbouring fragments
   read as one word; restored words reach it by a join of texts and spans. What a
   doubled letter restores counts only where the word itself meets no entry.

Null and empty texts hold no evidence and get the base score. With nothing to
learn from every score is 0. Rows are scored alone: repeated rows, hot sources
and very long texts need nothing special. A row without an id is never learned from.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import id_remainder, ready_workers, saved, texts
from assay.session import collect_bounded

PER_LABEL = 3000
PREFIXES = (4, 5, 6)
LEAST_TEXTS = 4
LEAST_PRECISION = 0.4
MOST_ENTRIES = 4000
PENALTY = 2.5
STEPS = 600
THRESHOLD = 0.3
SLICE_ROWS = 1000
HELD_WORDS = 1 << 18  # distinct words or trigrams of a task before they are passed on

# Letters that a sign often stands for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*'"
# Costs of the channel, in nats: a sign for a letter, a dropped repetition, a dropped separator.
SIGN_COST, RUN_COST, GAP_COST = 0.3, 0.2, 0.1
WORD = re.compile(r"[^\W\d_]+")
SIGNS = "".join(re.escape(c) for c in LEET)
OTHER_SIGNS = "".join(re.escape(c) for c in LEET if not c.isalnum())
# A sign or digit beside a letter, signs alone (one of them no digit), or a doubled letter.
DISGUISED = re.compile(rf"(?:[^\W\d_][{SIGNS}]|[{SIGNS}][^\W\d_]|^(?=.*[{OTHER_SIGNS}])[{SIGNS}]{{3,}}$|([^\W\d_])\1)")
# For Arrow's RE2, which has no back references: the same without doubled letters, which are found by comparing letters.
SPELLED_APART = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{SIGNS}])(?:[{re.escape(SEPARATORS)}]{{1,2}}(?:[^\W\d_]|[{SIGNS}])){{2,}}(?![^\W_])")
SPELLED_APART_RE2 = rf"(?:^|[^\pL\pN])(?:[\pL\pN]|[{SIGNS}])(?:[{re.escape(SEPARATORS)}]{{1,2}}(?:\pL|[{SIGNS}])){{2,}}"
DISGUISED_RE2 = rf"\pL[{SIGNS}]|[{SIGNS}]\pL|[{SIGNS}]{{3}}"
EDGE = "\x02"


def trimmed(word: str) -> str:
    """The word without punctuation around it; signs that may stand for letters stay at its start."""
    return word.strip(".,;:?\"'`)]}>#%&*=~^\\/[{<").lstrip("(").rstrip("!+|(")


# --- the character model ---------------------------------------------------------------------


def trigrams_of(words: Iterable[tuple[str, int]]) -> Counter:
    out: Counter = Counter()
    for word, n in words:
        s = EDGE + EDGE + word + EDGE
        for i in range(len(s) - 2):
            out[s[i : i + 3]] += n
    return out


def word_counts(column: pa.Array) -> pa.Table:
    """(word, n) of the letter runs of the lower-cased texts."""
    split = pc.split_pattern_regex(pc.utf8_lower(column), r"[^\pL]+").flatten()
    found = pc.value_counts(split)
    table = pa.table({"word": found.field(0), "n": found.field(1)})
    return table.filter(pc.greater(pc.binary_length(table["word"]), 0))


def summed_words(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
    return whole.rename_columns({"n_sum": "n"})


def trigram_table(words: pa.Table) -> pa.Table:
    """(gram, n): the trigrams of distinct words with their counts, as ``trigrams_of`` counts them, by arrays."""
    sizes = pc.utf8_length(words["word"]).to_numpy()
    line = EDGE + EDGE + (EDGE + EDGE).join(words["word"].to_pylist()) + EDGE
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64)
    inner = (codes[1:-1] != ord(EDGE)) | (codes[2:] != ord(EDGE))  # else the window lies between two words
    grams = ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[inner]
    order = np.argsort(grams, kind="stable")
    grams, weights = grams[order], np.repeat(words["n"].to_numpy(), sizes + 1)[order]
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    low = (1 << 21) - 1
    spelled = [chr(g >> 42) + chr(g >> 21 & low) + chr(g & low) for g in grams[first].tolist()]
    return pa.table({"gram": pa.array(spelled, pa.string()), "n": np.add.reduceat(weights, first)})


class CharacterModel:
    """Interpolated trigram log-probabilities of counts held in memory; ``gram_costs`` is the same over tables."""

    def __init__(self, counts: Iterable[tuple[str, int]]):
        self.three: dict[str, int] = dict(counts)
        self.two: Counter = Counter()
        self.before: Counter = Counter()
        self.one: Counter = Counter()
        for g, n in self.three.items():
            self.before[g[:2]] += n
            self.two[g[1:]] += n
            self.one[g[2]] += n
        self.middle: Counter = Counter()
        for g, n in self.two.items():
            self.middle[g[0]] += n
        self.all = sum(self.one.values())
        self.signs = len(self.one) + 1

    def cost(self, before: str, c: str) -> float:
        p1 = (self.one[c] + 0.5) / (self.all + 0.5 * self.signs)
        p2 = (self.two[before[1] + c] + 5 * p1) / (self.middle[before[1]] + 5)
        p3 = (self.three.get(before + c, 0) + 5 * p2) / (self.before[before] + 5)
        return -math.log(p3)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, n) over all texts, summed per task first; a task holds ``HELD_WORDS`` distinct words and one slice at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                held.append(word_counts(batch.column(0).slice(at, SLICE_ROWS)))
                if sum(t.num_rows for t in held) < HELD_WORDS:
                    continue
                held = [summed_words(held)]
                if held[0].num_rows >= HELD_WORDS // 2:
                    yield from trigram_table(held.pop()).to_batches()
        words = summed_words(held) if held else None
        if words is not None and words.num_rows:
            yield from trigram_table(words).to_batches()

    parts = rows.select("text").mapInArrow(run, "gram string, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


class Reach:
    """Whether the lattice of a span can spell an entry of the lexicon; exact up to the channel's costs, never too narrow."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.ends = {k.removesuffix(EDGE) for k in lexicon}
        self.heads = {k[:n] for k in self.ends for n in range(len(k) + 1)}

    def __call__(self, span: str, apart: bool) -> bool:
        # a word that meets an entry is scored as it is written
        return self.spells(span, apart) and (apart or not any(strength(p, self.lexicon) for p in WORD.findall(span)))

    def spells(self, span: str, apart: bool) -> bool:
        begun = {""}
        for options in readings(span):
            onward = {""} if apart else set()  # letters spelled apart may run into each other
            for head in begun:
                for letter, _ in options:
                    longer = head + letter
                    if letter and longer in self.ends:
                        return True
                    if longer in self.heads:
                        onward.add(longer)
            if not onward:
                return False
            begun = onward
        return False


def spans_in_reach(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(text_key, span, apart) of the disguised spans that may restore to a lexicon entry."""
    keyed = rows.select("text", text_key(F.col("text")).alias("text_key"))
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # of bounded size
    if not lexicon:
        return keyed.limit(0).select("text_key", F.col("text").alias("span"), F.lit(True).alias("apart"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = Reach(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                found = list(spans_of_batch(cut.column(0), reach))
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column(1).take(pa.array([row for row, _, _ in found], pa.int64())),
                        pa.array([span for _, span, _ in found], pa.string()),
                        pa.array([apart for _, _, apart in found], pa.bool_()),
                    ],
                    names=["text_key", "span", "apart"],
                )

    return keyed.mapInArrow(run, "text_key binary, span string, apart boolean")


def gram_costs(needed: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, cost) for the distinct grams of ``needed``, as ``CharacterModel.cost`` gives them."""

    def summed(at: int, size: int, name: str) -> DataFrame:
        return counts.groupBy(F.substring("gram", at, size).alias(f"k_{name}")).agg(F.sum("n").alias(name))

    one = summed(3, 1, "one")
    whole = one.agg(F.coalesce(F.sum("one"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("signs")).first()
    rows = needed.select("gram").distinct()
    for at, size, table_ in (
        (1, 3, summed(1, 3, "three")),
        (1, 2, summed(1, 2, "before")),
        (2, 2, summed(2, 2, "two")),
        (2, 1, summed(2, 1, "middle")),
        (3, 1, one),
    ):
        key = table_.columns[0]
        rows = rows.join(table_, F.substring("gram", at, size) == F.col(key), "left").drop(key)
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("three", "before", "two", "middle", "one")}
    signs = whole["signs"] + 1
    p1 = (n["one"] + 0.5) / F.lit(whole["all"] + 0.5 * signs)
    p2 = (n["two"] + 5 * p1) / (n["middle"] + 5)
    p3 = (n["three"] + 5 * p2) / (n["before"] + 5)
    return rows.select("gram", (-F.log(p3)).alias("cost"))


# --- the channel -----------------------------------------------------------------------------


def readings(span: str) -> Iterator[list[tuple[str, float]]]:
    """For each observed place the letters it may stand for (``""``: dropped), with costs."""
    last, run = "", 0
    for c in span:
        own = LEET.get(c)
        run = run + 1 if c == last else 1
        last = c
        if own is not None:
            options = [(letter, SIGN_COST) for letter in own]
            if not c.isalnum():
                options.append(("", SIGN_COST + GAP_COST))
        elif c.isalpha():
            options = [(c, 0.0)]
        else:
            options = [("", GAP_COST)]
        if run > 2:
            options = [("", RUN_COST)]  # nothing is spelled with three equal letters
        elif run == 2 and c.isalpha():
            options.append(("", RUN_COST))
        yield options


def restored(span: str, model: CharacterModel) -> str:
    """The likeliest spelling behind ``span`` (lower case)."""
    paths = {EDGE + EDGE: (0.0, "")}
    for options in readings(span):
        onward: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in paths.items():
            for letter, extra in options:
                if letter:
                    now, spelled, state_on = cost + extra + model.cost(state, letter), text + letter, state[1] + letter
                else:
                    now, spelled, state_on = cost + extra, text, state
                if state_on not in onward or (now, spelled) < onward[state_on]:
                    onward[state_on] = (now, spelled)
        paths = onward
    return min((cost + model.cost(state, EDGE), text) for state, (cost, text) in paths.items())[1]


def grams_needed(span: str) -> set[str]:
    """The trigrams that ``restored`` may ask the costs of."""
    states, out = {EDGE + EDGE}, set()
    for options in readings(span):
        onward = set()
        for state in states:
            for letter, _ in options:
                if letter:
                    out.add(state + letter)
                onward.add(state[1] + letter if letter else state)
        states = onward
    return out | {state + EDGE for state in states}


class Costs:
    """Costs of the trigrams at hand."""

    def __init__(self, known: dict[str, float]):
        self.known = known

    def cost(self, before: str, c: str) -> float:
        return self.known[before + c]


def restored_spans(spans: DataFrame, counts: DataFrame) -> DataFrame:
    """(span, spelled) for every distinct span, each restored once from the costs of its own lattice."""

    def list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                pairs = [(x, g) for x in batch.column(0).slice(at, SLICE_ROWS).to_pylist() for g in grams_needed(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["span", "gram"]
                )

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = [
                restored(span, Costs({c["gram"]: c["cost"] for c in costs}))
                for span, costs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelled, pa.string())], names=["span", "spelled"])

    needed = saved(spans.select("span").distinct().mapInArrow(list_grams, "span string, gram string"), "span-grams")
    costs = saved(gram_costs(needed, counts), "gram-costs")
    lattices = needed.join(costs, "gram").groupBy("span").agg(F.collect_list(F.struct("gram", "cost")).alias("costs"))
    return lattices.mapInArrow(restore, "span string, spelled string")


class Restorer:
    """Restores spans and remembers a bounded number of them."""

    def __init__(self, model: CharacterModel, most: int = 100_000):
        self.model, self.most, self.known = model, most, {}

    def __call__(self, span: str) -> str:
        found = self.known.get(span)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[span] = restored(span, self.model)
        return found


def spans_of(text: str) -> set[tuple[str, bool]]:
    """The disguised spans of a lower-cased text, and whether they are spelled apart."""
    out = {(t, False) for t in map(trimmed, text.split()) if DISGUISED.search(t)}
    return out | {(m.group(), True) for m in SPELLED_APART.finditer(text)}


def may_double(words: pa.Array) -> np.ndarray:
    """Words with two equal bytes side by side or a byte beyond ASCII: all words with a doubled letter, and some others."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    sign = data >= 0x80
    sign[1:] |= data[1:] == data[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    sign[starts] = data[starts] >= 0x80  # the first byte of a word follows nothing
    total = np.concatenate([[0], np.cumsum(sign)])
    return total[offsets[1:]] > total[offsets[:-1]]


def spans_of_batch(column: pa.Array, reach: Callable[[str, bool], bool] = lambda span, apart: True) -> Iterator[tuple[int, str, bool]]:
    """(row, span, apart): ``spans_of`` each text, as far as ``reach`` holds; words are looked at once per batch."""
    lower = pc.utf8_lower(column)
    words = pc.split_pattern_regex(lower, r"[\pZ\s]+")
    coded = pc.dictionary_encode(words.flatten())
    spelled = coded.dictionary
    maybe = pc.match_substring_regex(spelled, DISGUISED_RE2).to_numpy(zero_copy_only=False) | may_double(spelled)
    spans = {}
    for i, w in zip(np.flatnonzero(maybe).tolist(), spelled.filter(pa.array(maybe)).to_pylist(), strict=True):
        seen = trimmed(w)
        if DISGUISED.search(seen) and reach(seen, False):
            spans[i] = seen
    if spans:
        codes = coded.indices.to_numpy(zero_copy_only=False)
        spots = np.flatnonzero(np.isin(codes, np.fromiter(spans, np.int64)))
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        at = np.searchsorted(offsets, spots, side="right") - 1
        for row, span in {(int(r), spans[int(codes[x])]) for r, x in zip(at, spots, strict=True)}:
            yield row, span, False
    for row in np.flatnonzero(pc.match_substring_regex(lower, SPELLED_APART_RE2).to_numpy(zero_copy_only=False)):
        for span in {m.group() for m in SPELLED_APART.finditer(str(lower[int(row)]))}:
            if reach(span, True):
                yield int(row), span, True


def restored_words(text: str, restore: Callable[[str], str]) -> list[str]:
    """Restored spellings of the disguised spans of a lower-cased text."""
    return [w for w in (restore(span) for span, _ in spans_of(text)) if w]


# --- the lexicon -----------------------------------------------------------------------------


def keys_of(word: str) -> list[str]:
    """The word itself (with an end mark) and its beginnings."""
    return [word + EDGE, *(word[:n] for n in PREFIXES if len(word) >= n)]


def learn(rows: list[tuple[str, int]], restore: Callable[[str], str], toxic_share: float) -> tuple[dict[str, float], float]:
    """Weights of lexicon entries and the bias, from (text, label) rows."""
    n = [sum(label == k for _, label in rows) for k in (0, 1)]
    if not all(n):
        return {}, -math.inf

    def keys(text: str) -> set[str]:
        lower = pc.utf8_lower(pa.scalar(text, pa.string())).as_py()
        return {k for w in {*WORD.findall(lower), *restored_words(lower, restore)} for k in keys_of(w)}

    held: dict[str, list[int]] = defaultdict(list)
    for i, (text, label) in enumerate(rows):
        if label:
            for key in keys(text):
                held[key].append(i)
    held = {k: d for k, d in held.items() if len(d) >= LEAST_TEXTS}
    clean: dict[str, list[int]] = defaultdict(list)  # of keys that may be entries, few of all keys of clean texts
    for i, (text, label) in enumerate(rows):
        if not label:
            for key in keys(text) & held.keys():
                clean[key].append(i)
    # labels are sampled apart: weigh clean texts as they occur
    weight = (n[1] / toxic_share - n[1]) / n[0] if 0 < toxic_share < 1 else 1.0
    usual = n[1] / (n[1] + weight * n[0])
    likely = {
        k: len(d)
        for k, d in held.items()
        if len(d) >= LEAST_PRECISION * (len(d) + weight * len(clean.get(k, ())))
    }
    names = sorted(likely, key=lambda k: (-likely[k], k))[:MOST_ENTRIES]
    of = [held[k] + clean.get(k, []) for k in names]
    places = np.fromiter((i for d in of for i in d), np.int32)
    sizes = np.fromiter(map(len, of), np.int64)
    x = Marks(places, np.repeat(np.arange(len(names), dtype=np.int32), sizes), (len(rows), len(names)))
    truth = np.array([label for _, label in rows], np.float32)
    share = np.where(truth == 1, 1.0, weight).astype(np.float32)
    values, bias = covering_weights(x, truth, share, math.log(usual / (1 - usual)))
    return {k: float(v) for k, v in zip(names, values, strict=True) if v > 0}, bias


class Marks:
    """A matrix of zeros and ones, kept as the places of its ones."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.shape = rows, columns, shape

    @property
    def T(self) -> Marks:  # noqa: N802
        return Marks(self.columns, self.rows, self.shape[::-1])

    def __matmul__(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, vector[self.columns], self.shape[0]).astype(np.float32)


def covering_weights(x: np.ndarray | Marks, truth: np.ndarray, share: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic regression with weights of at least 0 and an L1 penalty, by accelerated proximal steps.

    An entry enters only if enough toxic texts are not explained by others, so the
    harmless words of a copied toxic text stay out.
    """
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        probe = x.T @ (share * (x @ probe))
        size = float(np.linalg.norm(probe)) or 1.0
        probe /= size
    step = 4 / (size + float(share.sum()))
    values = seen = np.zeros(x.shape[1], np.float32)
    speed = 1.0
    for _ in range(STEPS):
        error = share * (1 / (1 + np.exp(-(x @ seen + np.float32(bias)))) - truth)
        new = np.maximum(seen - step * (x.T @ error + PENALTY), 0).astype(np.float32)
        bias -= step * float(error.sum())
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        seen = np.maximum(new + np.float32((speed - 1) / faster) * (new - values), 0)
        values, speed = new, faster
    return values, bias


def strength(word: str, lexicon: dict[str, float]) -> list[tuple[str, float]]:
    """The entries that a word meets, with their weights."""
    return [(key, lexicon[key]) for key in keys_of(word) if key in lexicon]


def part_heads(lexicon: dict[str, float]) -> set[str]:
    """Proper beginnings of the entries: what the first of two fragments of a word may be."""
    return {k[:n] for k in (e.removesuffix(EDGE) for e in lexicon) for n in range(1, len(k))}


def joined_hits(first: str, second: str, lexicon: dict[str, float]) -> list[tuple[str, float]]:
    """Entries that two neighbouring fragments meet as one word and that reach into the second."""
    return [(k, v) for k, v in strength(first + second, lexicon) if len(k.removesuffix(EDGE)) > len(first)]


# --- the operator ----------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, learned: Column, per_label: int) -> tuple[list[tuple[str, int]], float]:
    """Texts of up to ``per_label`` ids of either label, smallest id hashes first, and the share of label 1."""
    usable = labels.where(learned & F.col("toxic").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic")
    )
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    ids = []
    for label in (0, 1):
        own = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        ids += collect_bounded(own, per_label, "the label sample")
    chosen = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["toxic"]) for r in ids], "_id long, toxic int"
    )  # at most 2 * per_label rows
    rows = (
        docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select(F.xxhash64("doc_id").alias("h"), "text", "toxic")
        .distinct()  # an id may stand in any number of rows
        .collect()
    )
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return [(t, y) for _, t, y in sorted({(r["h"], r["text"], r["toxic"]) for r in rows})], share


SCHEMA = "doc_id long, score double, evidence array<string>"


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def fitted(rows: DataFrame, labels: DataFrame, learned: Column, per_label: int) -> tuple:
    """Lexicon, bias and the table (text_key, entries) of what restored words add; ``rows`` are (doc_id, text)."""
    spark = rows.sparkSession
    counts = saved(gram_counts(rows), "toxicity-grams")
    train_rows, share = sample(rows, labels, F.coalesce(learned, F.lit(False)), per_label)
    lowered = (pc.utf8_lower(pa.scalar(t, pa.string())).as_py() for t, _ in train_rows)
    own = sorted({span for t in lowered for span, _ in spans_of(t)})  # of the sampled texts
    known = {}
    if own:
        sampled = spark.createDataFrame(pa.table({"span": pa.array(own, pa.string())}))
        known = {r["span"]: r["spelled"] for r in restored_spans(sampled, counts).collect()}
    lexicon, bias = learn(train_rows, lambda span: known.get(span, ""), share)
    spans = saved(spans_in_reach(rows, lexicon), "toxicity-spans")
    spelled = saved(restored_spans(spans, counts), "toxicity-spelled")
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # of bounded size

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for span, apart, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # letters spelled apart may run into each other: look for entries at every start
                starts = range(len(word)) if apart else (0,)
                entries = sorted({k for i in starts for k, _ in strength(word[i:], shared.value)})
                if entries:
                    found.append((span, apart, entries))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["span", "apart", "entries"]
            )

    pairs = spans.select("span", "apart").distinct().join(spelled, "span").select("span", "apart", "spelled")
    hits = saved(pairs.mapInArrow(meet, "span string, apart boolean, entries array<string>"), "toxicity-hits")
    entries = spans.join(hits, ["span", "apart"]).select("text_key", F.explode("entries").alias("entry"))
    added = saved(entries.groupBy("text_key").agg(F.collect_set("entry").alias("entries")), "toxicity-added")
    return lexicon, bias, added


def scored(
    docs: DataFrame,
    labels: DataFrame,
    learned: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = PER_LABEL,
) -> DataFrame:
    """doc_id, score, evidence (the entries that words and restored words meet) for every row.

    ``learned`` is a condition on ``labels.doc_id``: the rows that may be learned from.
    """
    rows = texts(docs, id_col, text_col)
    lexicon, bias, added = fitted(rows, labels, learned, per_label)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, bias))  # of bounded size
    joined = rows.withColumn("text_key", text_key(F.col("text"))).join(added, "text_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, bias = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), *score_batch(cut.column(1), cut.column(2), lexicon, bias)],
                    names=["doc_id", "score", "evidence"],
                )

    return joined.select("doc_id", "text", "entries").mapInArrow(run, SCHEMA)


def keep_clean(
    docs: DataFrame,
    labels: DataFrame,
    learned: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = PER_LABEL,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""
    rows = texts(docs, id_col, text_col)
    lexicon, bias, added = fitted(rows, labels, learned, per_label)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, bias))  # of bounded size
    ready_workers(docs)
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = ["_toxicity_key", "_toxicity_entries"]
    joined = docs.withColumn(names[0], text_key(own)).join(added.toDF(*names), names[0], "left")
    width, at = len(docs.columns), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, bias = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                cut = batch.slice(first, 500)
                column = pc.fill_null(pc.cast(cut.column(at), pa.string()), "")
                stay = score_batch(column, cut.column(width), lexicon, bias)[0].to_numpy() < threshold
                yield cut.select(range(width)).filter(pa.array(stay, pa.bool_()))

    return joined.select(*docs.columns, names[1]).mapInArrow(run, docs.schema)


def score_batch(column: pa.Array, added: pa.Array, lexicon: dict[str, float], bias: float) -> list[pa.Array]:
    """Scores and evidence of a batch, ``added`` from restored words; words are judged once per batch."""
    words = pc.split_pattern_regex(pc.utf8_lower(column), r"[\pZ\s]+")
    coded = pc.dictionary_encode(words.flatten())
    found: dict[int, list[tuple[str, float]]] = {}
    # a word of at least three letters shares three with an entry that it meets
    heads, firsts, ends = part_heads(lexicon), {k.removesuffix(EDGE)[:3] for k in lexicon}, []
    spelled = coded.dictionary.to_pylist()
    for i, w in enumerate(spelled):
        if w.isalpha():  # one part
            if w[:3] in firsts and (hits := strength(w, lexicon)):
                found[i] = hits
            if w in heads:
                ends.append(i)
            continue
        parts = WORD.findall(w)
        hits = [h for p in parts if p[:3] in firsts for h in strength(p, lexicon)]
        for a, b in zip(parts, parts[1:]):
            if a in heads:
                hits += joined_hits(a, b, lexicon)
        if hits:
            found[i] = hits
        if parts and parts[-1] in heads:
            ends.append(i)
    evidence: list[dict[str, float]] = [{k: lexicon[k] for k in keys or ()} for keys in added.to_pylist()]
    if found:
        codes = coded.indices.to_numpy(zero_copy_only=False)
        spots = np.flatnonzero(np.isin(codes, np.fromiter(found, np.int64)))
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        for row, spot in zip(np.searchsorted(offsets, spots, side="right") - 1, spots, strict=True):
            evidence[row].update(found[int(codes[spot])])
    if ends:
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        flagged = np.zeros(len(coded.dictionary), bool)
        flagged[ends] = True
        inner = np.ones(len(codes), bool)
        inner[offsets[1:][offsets[1:] > 0] - 1] = False  # the last word of a text has no neighbour
        spots = np.flatnonzero(flagged[codes] & inner)
        met: dict[tuple[int, int], list] = {}
        for spot in spots:
            pair = int(codes[spot]), int(codes[spot + 1])
            if pair not in met:
                last, behind = WORD.findall(spelled[pair[0]])[-1], WORD.search(spelled[pair[1]])
                met[pair] = joined_hits(last, behind.group(), lexicon) if behind else []
            if met[pair]:
                evidence[np.searchsorted(offsets, spot, side="right") - 1].update(met[pair])
    known = bias > -math.inf  # else nothing was learned
    totals = [1 / (1 + math.exp(min(700.0, -bias - sum(e.values())))) if known else 0.0 for e in evidence]
    shown = [sorted(k.removesuffix(EDGE) for k in e) for e in evidence]
    return [pa.array(totals, pa.float64()), pa.array(shown, pa.list_(pa.string()))]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: remainder 2, and rows without an id."""
    return F.coalesce(id_remainder(F.col(id_col), 4) == 2, F.lit(True))
