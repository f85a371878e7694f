"""Line labels by a linear-chain conditional random field, and the verdict they give.

Every line of a text shows some traits (bins of its length, of its share of signs,
capitals, digits and repeated words, how it ends, whether it repeats an earlier line),
packed into one integer. A conditional random field over the lines has a weight for
each trait and one for each step from label to label; Viterbi decoding marks each line
as content or boilerplate. A text stays when at least ``least_share`` of its words
stand in content lines.

Only texts are labelled, so training starts from the label of the text for each of its
lines and then, ``RELABELLED`` times, decodes the lines of bad texts and fits again: a
clean line inside a bad text is content. Learned from: the texts of up to ``per_label``
ids of either label with the smallest hashes, but for those of more than ``LONGEST``
lines; scored: every whole text. The driver sees one integer a line of the sample.

Null and empty texts have no words, no content share and are not kept by the rules.
With nothing to learn from, every line is content. Texts are judged alone, so repeated
rows and hot sources need nothing special; a text is held once in a task, however long,
with some forty bytes a word. A row without an id is never learned from. Empty tables
give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import SPACES, ready_workers, texts
from assay.session import collect_bounded

PER_LABEL = 600
LONGEST = 500
RELABELLED = 2
STEPS = 120
PENALTY = 0.001
LEAST_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # words in repeated windows, of 100
WINDOW = 3

BOILERPLATE, CONTENT = 0, 1

# Upper ends of the bins of each trait; a last bin holds the rest.
BINS = {
    "words": (0, 2, 7, 25, 120),
    "symbols": (0.0, 0.05, 0.3, 0.8),  # signs a word
    "capitals": (0.02, 0.1, 0.3, 0.6),  # of the letters
    "digits": (0.0, 0.05, 0.2),  # of the characters
    "other": (0.06, 0.2, 0.5),  # neither letter, digit, space nor plain punctuation, a word
    "distinct": (0.3, 0.6, 0.9),  # of the words
    "marks": (0.1, 0.4, 0.8),  # exclamation and question marks a word
    "length": (2.5, 4.0, 9.0, 15.0),  # characters a word
}
FLAGS = ("ends_sentence", "starts_upper", "repeats")
STARTS = dict(zip(BINS, np.cumsum([0, *(len(b) + 1 for b in BINS.values())])[:-1].tolist(), strict=True))
FLAG_AT = sum(len(b) + 1 for b in BINS.values())
TRAITS = FLAG_AT + len(FLAGS)
assert TRAITS < 63  # they fit one long
BLANK, MARKS, ASCII = SPACES.encode(), SYMBOLS.encode(), bytes(range(128))
UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
PLAIN = b".,;:'\"-()!?"


def counted(text: bytes, signs: bytes) -> int:
    """How many of the ASCII ``signs`` stand in a text."""
    return len(text) - len(text.translate(None, signs))


def trait_bits(line: bytes, repeats: bool) -> tuple[int, int]:
    """The traits of a UTF-8 line, one bit each, and its number of words."""
    words = line.split()  # at the six white space characters, as the contracts ask
    n = len(words)
    bare = line.translate(None, BLANK)
    beyond = bare.translate(None, ASCII).decode()  # what is not ASCII is looked at letter by letter
    points = counted(bare, ASCII) + len(beyond)
    size = max(1, points)
    capitals = counted(bare, UPPER) + sum(map(str.isupper, beyond))
    letters = counted(bare, UPPER + LOWER) + sum(map(str.isalpha, beyond))
    digits = counted(bare, DIGITS) + sum(map(str.isdecimal, beyond))
    values = {
        "words": n,
        "symbols": counted(bare, MARKS) / max(1, n),
        "capitals": capitals / max(1, letters),
        "digits": digits / size,
        "other": max(0, points - letters - digits - counted(bare, PLAIN)) / max(1, n),
        "distinct": len(set(words)) / max(1, n),
        "marks": counted(bare, b"!?") / max(1, n),
        "length": size / max(1, n),
    }
    bits = 0
    for name, ends in BINS.items():
        bits |= 1 << (STARTS[name] + bisect_left(ends, values[name]))
    first = words[0].decode()[0] if words else ""
    for i, flag in enumerate((bare[-1:] in (b".", b"!", b"?", b'"', b":"), first.isupper(), repeats)):
        bits |= flag << (FLAG_AT + i)
    return bits, n


def lines_of(text: str) -> tuple[list[bytes], list[bool]]:
    """The lines, and whether each has a word and equals an earlier one."""
    seen: set[bytes] = set()
    repeats = []
    lines = text.encode().split(b"\n")
    for line in lines:
        repeats.append(line in seen and not line.isspace() and line != b"")
        seen.add(line)
    return lines, repeats


def text_traits(lines: list[bytes], repeats: list[bool]) -> list[tuple[int, int]]:
    return [trait_bits(line, again) for line, again in zip(lines, repeats, strict=True)]


# --- the field -------------------------------------------------------------------------------


@dataclass
class Field:
    """Trait weights in favour of content and the scores of steps between labels."""

    weights: np.ndarray  # (TRAITS,)
    steps: np.ndarray  # (2, 2)

    def scores(self, traits: np.ndarray) -> np.ndarray:
        """Score of each line for content, less that for boilerplate."""
        return unpacked(traits) @ self.weights

    def decoded(self, scores: np.ndarray) -> np.ndarray:
        """The likeliest labels (Viterbi); content wins ties."""
        (stay0, go1), (go0, stay1) = self.steps.tolist()
        best0, best1 = 0.0, 0.0
        back = []
        for i, s in enumerate(scores.tolist()):
            if i:
                from0, from1 = best0 + stay0 > best1 + go0, best0 + go1 > best1 + stay1
                best0, best1 = (best0 + stay0 if from0 else best1 + go0), (best0 + go1 if from1 else best1 + stay1)
                back.append((from0, from1))
            best1 += s
        label = BOILERPLATE if best0 > best1 else CONTENT
        out = [label]
        for choice in reversed(back):
            label = BOILERPLATE if choice[label] else CONTENT
            out.append(label)
        return np.array(out[::-1], np.int8)


def unpacked(traits: np.ndarray) -> np.ndarray:
    """(lines, TRAITS) of zeros and ones."""
    return ((np.asarray(traits, np.int64)[:, None] >> np.arange(TRAITS)) & 1).astype(np.float64)


class Sample:
    """Sequences laid out by place, the longest first, so that a step takes all that are still running."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: (-len(sequences[i]), i))
        self.sizes = np.array([len(sequences[i]) for i in self.order])
        longest = int(self.sizes.max()) if len(self.sizes) else 0
        self.running = [int((self.sizes > t).sum()) for t in range(longest)]
        self.starts = np.cumsum([0, *self.running])
        self.traits = np.concatenate(
            [np.array([sequences[i][t] for i in self.order[:n]], np.int64) for t, n in enumerate(self.running)]
        )

    def laid(self, labels: list[np.ndarray]) -> np.ndarray:
        """Labels in the order of ``traits``."""
        return np.concatenate([[labels[i][t] for i in self.order[:n]] for t, n in enumerate(self.running)])


def gradient(field: Field, sample: Sample, x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood of the labels and its gradient, by forward and backward sums.

    ``weight`` belongs to the sequences in the order of the sample.
    """
    s = x @ field.weights
    runs = sample.running
    at = [slice(int(a), int(b)) for a, b in zip(sample.starts, sample.starts[1:])]
    ahead = np.zeros((len(s), 2))
    behind = np.zeros((len(s), 2))
    emit = np.stack([np.zeros_like(s), s], axis=1)
    for t, n in enumerate(runs):
        own = emit[at[t]]
        if t:
            before = ahead[at[t - 1]][:n]
            own = own + np.logaddexp(before[:, :1] + field.steps[0], before[:, 1:] + field.steps[1])
        ahead[at[t]] = own
    for t in range(len(runs) - 2, -1, -1):
        n = runs[t + 1]
        after = emit[at[t + 1]] + behind[at[t + 1]]
        behind[at[t]][:n] = np.logaddexp(field.steps[:, 0] + after[:, :1], field.steps[:, 1] + after[:, 1:])
    whole = np.logaddexp(*(ahead[at[0]] + behind[at[0]]).T)
    likely, g_steps = 0.0, np.zeros((2, 2))
    chance = np.zeros(len(s))
    share = np.zeros(len(s))
    for t, n in enumerate(runs):
        chance[at[t]] = np.exp(ahead[at[t], 1] + behind[at[t], 1] - whole[:n])
        share[at[t]] = weight[:n]
        if t:
            before, now = ahead[at[t - 1]][:n], emit[at[t]] + behind[at[t]]
            pairs = np.exp(before[:, :, None] + field.steps + now[:, None, :] - whole[:n, None, None])
            g_steps -= (weight[:n, None, None] * pairs).sum(axis=0)
            was, is_ = labels[at[t - 1]][:n], labels[at[t]]
            np.add.at(g_steps, (was, is_), weight[:n])
            likely += float((weight[:n] * field.steps[was, is_]).sum())
    likely += float((share * s * labels).sum() - (weight * whole).sum())
    return likely, x.T @ (share * (labels - chance)), g_steps


def maximised(sample: Sample, x: np.ndarray, labels: np.ndarray, weight: np.ndarray, chained: bool = True) -> Field:
    """Penalised maximum likelihood by Adam steps of falling size; sequences weigh ``weight``.

    Without ``chained`` steps from label to label stay at 0: lines are taken apart.
    """
    field = Field(np.zeros(TRAITS), np.zeros((2, 2)))
    at = np.zeros(TRAITS + 4)
    mean, square = np.zeros_like(at), np.zeros_like(at)
    scale = 1 / max(1e-9, float(weight.sum()))
    for step in range(1, STEPS + 1):
        _, g, g_steps = gradient(field, sample, x, labels, weight)
        slope = scale * np.concatenate([g, g_steps.ravel() * chained]) - PENALTY * scale * at
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        at = at + 0.3 * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        field = Field(at[:TRAITS], at[TRAITS:].reshape(2, 2))
    return field


def learn(rows: list[tuple[np.ndarray, int]]) -> Field:
    """The field of (traits of the lines, label of the text) rows; without both labels every line is content."""
    counts = [sum(y == k for _, y in rows) for k in (0, 1)]
    if not all(counts):
        return Field(np.zeros(TRAITS), np.zeros((2, 2)))
    sequences, truth = [t for t, _ in rows], [y for _, y in rows]
    sample = Sample(sequences)
    x = unpacked(sample.traits)
    # either label weighs the same, and a long text no more than a short one
    weight = np.array([1 / (counts[truth[i]] * len(sequences[i])) for i in sample.order])
    labels = [np.full(len(t), y, np.int64) for t, y in rows]
    # labels of whole texts never change from line to line: steps learned from them would hide every clean line
    field = maximised(sample, x, sample.laid(labels), weight, chained=False)
    for _ in range(RELABELLED):
        for i, (traits, y) in enumerate(rows):
            if y == 0 and (found := field.decoded(field.scores(traits))).min() == BOILERPLATE:
                labels[i] = found.astype(np.int64)
        field = maximised(sample, x, sample.laid(labels), weight)
    return field


# --- counts ----------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that stand in the text twice or more."""
    if len(words) <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    window = codes[: len(words) - WINDOW + 1]
    for i in range(1, WINDOW):
        # pairs of numbers below 2**31 each, numbered anew
        _, window = np.unique(window * len(known) + codes[i : len(words) - WINDOW + 1 + i], return_inverse=True)
    again = np.bincount(window)[window] > 1
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(again), 1)
    np.add.at(inside, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def measured(text: str, field: Field) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, labels of the lines, content words."""
    coded = text.encode()
    lines, repeats = lines_of(text)
    traits, sizes = (np.array(c, np.int64) for c in zip(*text_traits(lines, repeats), strict=True))
    labels = field.decoded(field.scores(traits))
    return (
        int(sizes.sum()),
        len(text) - counted(coded, BLANK),
        counted(coded, MARKS),
        sum(repeats),
        repeated_words(coded.split()),
        labels,
        int(sizes[labels == CONTENT].sum()),
    )


# --- the operator ----------------------------------------------------------------------------


def fitted(docs: DataFrame, labels: DataFrame, learned: Column, quality_col: str, per_label: int) -> Field:
    """Fit on a bounded sample; ``docs`` are (doc_id, text), ``learned`` a condition on labels.doc_id."""
    usable = (
        labels.where(learned & F.col(quality_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min((F.col(quality_col) == 1).cast("int")).alias("quality"))
    )
    ids = []
    for label in (0, 1):
        own = usable.where(F.col("quality") == label).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
        ids += collect_bounded(own, per_label, "the quality sample")
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in ids], "_id long, quality int")  # at most 2 * per_label rows
    lines = F.octet_length(F.regexp_replace("text", r"[^\n]", "")) + 1

    def traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[bits for bits, _ in text_traits(*lines_of(t))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64())), batch.column(2)], names=["doc_id", "traits", "quality"]
            )

    rows = (
        docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .where(lines <= LONGEST)
        .select("doc_id", "text", "quality")
        .mapInArrow(traits, "doc_id long, traits array<long>, quality int")
        .groupBy("doc_id")
        .agg(F.min(F.struct("traits", "quality")).alias("one"))  # repeated ids count once
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", "one.*")
    )
    rows = sorted(collect_bounded(rows, 2 * per_label, "the quality sample"), key=lambda r: (r["h"], r["doc_id"]))
    return learn([(np.array(r["traits"], np.int64), r["quality"]) for r in rows])


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_words long, line_labels array<tinyint>, kept boolean"
)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    learned: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    per_label: int = PER_LABEL,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """The counts, the base rules, the label of every line (1: content) and the verdict of every row."""
    ready_workers(docs)
    rows = texts(docs, id_col, text_col)
    allowed = F.lit(True) if learned is None else F.coalesce(learned, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(rows, labels, allowed, quality_col, per_label))  # some 50 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            found = [measured(t, field) for t in batch.column(1).to_pylist()]
            n, chars, symbols, dup, again, marks, content = zip(*found, strict=True) if found else [()] * 7
            failed = [a < LEAST_WORDS or 100 * b > MOST_REPEATED * a for a, b in zip(n, again, strict=True)]
            kept = [not f and c >= least_share * a for f, c, a in zip(failed, content, n, strict=True)]
            longs = [pa.array(list(c), pa.int64()) for c in (n, chars, symbols, dup, again)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *longs, pa.array(failed, pa.bool_()), pa.array(list(content), pa.int64()),
                    pa.array(list(marks), pa.list_(pa.int8())), pa.array(kept, pa.bool_()),
                ],
                names=SCHEMA.replace(", ", " ").split()[::2],
            )

    return rows.mapInArrow(run, SCHEMA)
