"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed letter n-grams (within words,
word ends included); a linear softmax turns the mean into languages. Embeddings
and weights are trained together by stochastic gradient descent in numpy on the
driver, on at most ``per_language`` labelled texts of each language, the ones
with the smallest id hashes. A part of that sample is held back to fit the
temperature and the confidence below which a prediction is rejected. Scoring is
one pass over all texts without a shuffle: the product of embeddings and weights
is one small table, and letters are hashed and summed as arrays.

Rejection is a second logistic model: the probability that a text is of a learned
language, from the lead of the best logit over the second, its height and the number of n-grams. It is
fitted on held-back texts and short cuts of them against texts of no learned
language: held-back texts of languages that a model has been trained without, the letters of
a text in random order, and words of random letters. A text is rejected below
one half, or below half of what the surest 99.9 % of the held-back texts reach if that is less.

Texts that are null or have no letter get ``und`` and are rejected, score 0.
With nothing to learn from, every text is ``und``. Rows are independent, so
repeated rows and very long texts need nothing special; a row without an id is
never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import filtered, id_remainder, texts
from assay.session import collect_bounded

BUCKETS = 1 << 15
DIMS = 16
PER_LANGUAGE = 800
MOST_LANGUAGES = 200
EPOCHS = 6
RATE = 0.5
SALTS = 64  # parts of a language that are ranked apart
LEFT_OUT = 4  # models trained without a share of the languages, for the rejection
HELD_BACK = 5  # one of so many sampled texts calibrates instead of training
REJECTED_SHARE = 0.001  # of the calibration texts that are predicted rightly
SPAN = 1 << 17  # letters hashed at once
PACKED = 200  # texts whose features are kept in one array
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters as 0."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letter_table()[found], found, 0).astype(np.uint32)


def grams(codes: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of all n-grams of 2 to 4 places that lie in one word, word ends as place 0."""
    mixed = codes * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    code = mixed.copy()
    for n in (2, 3, 4):
        if len(codes) < n:
            return
        code = (code[:-1] ^ (code[:-1] >> np.uint32(13))) * np.uint32(2246822519) + mixed[n - 1 :]
        inner = codes[1 : len(codes) - n + 2] != 0 if n > 2 else (codes[:-1] | codes[1:]) != 0
        if n == 4:
            inner = inner & (codes[2 : len(codes) - 1] != 0)
        start = np.flatnonzero(inner)
        bucket = code[start]
        bucket ^= bucket >> np.uint32(16)
        yield start, bucket % np.uint32(buckets)


def padded(text: str) -> np.ndarray:
    return np.concatenate([[0], points(text), [0]]).astype(np.uint32)


def features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares, for training."""
    found = [b for _, b in grams(padded(text), buckets)]
    buckets_, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
    return buckets_, (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): embeddings times weights
    bias: np.ndarray
    heat: float  # inverse temperature
    known: np.ndarray  # weights of ``signals``: log odds that a text is of a learned language
    least: float  # that probability below which a prediction is rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def packed(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of many texts as parts of few large arrays, whose memory goes back when the fit ends."""
    out = []
    for at in range(0, len(texts), PACKED):
        own = [features(text, BUCKETS) for text in texts[at : at + PACKED]]
        buckets, shares = (np.concatenate(column) for column in zip(*own, strict=True))
        ends = np.cumsum([len(b) for b, _ in own])
        out += [(buckets[end - len(b) : end], shares[end - len(b) : end]) for end, (b, _) in zip(ends, own, strict=True)]
    return out


Sample = list[tuple[tuple[np.ndarray, np.ndarray], int]]


def descended(fit: Sample, languages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times weights, and biases, by stochastic gradient descent."""
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    weight = np.zeros((DIMS, languages), np.float32)
    weight += draw.normal(0, 0.1, weight.shape).astype(np.float32)
    bias = np.zeros(languages, np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(fit)):
            (buckets, shares), lang = fit[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = shares @ embed[buckets]
            error = softmax(mean @ weight + bias)
            error[lang] -= 1
            back = weight @ error
            weight -= rate * np.outer(mean, error)
            bias -= rate * np.float32(0.1) * error
            embed[buckets] -= (rate * len(buckets) ** 0.5) * np.outer(shares, back)
    return (embed @ weight).astype(np.float32), bias


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """``rows`` are (text, language) in a fixed order."""
    languages = sorted({lang for _, lang in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    sample = [(f, place[lang], text) for f, (text, lang) in zip(packed([text for text, _ in rows]), rows, strict=True)]
    sample = [s for s in sample if len(s[0][0])]
    nothing = np.zeros(4)
    if not sample:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, nothing, 0.0)
    held = [s for i, s in enumerate(sample) if i % HELD_BACK == 0] or sample
    fit = [(f, lang) for i, (f, lang, _) in enumerate(sample) if i % HELD_BACK] or [s[:2] for s in sample]
    table, bias = descended(fit, len(languages), seed)
    model = Model(languages, table, bias, 1.0, nothing, 0.0)
    logits, counts, _ = logits_of(pa.array([t for _, _, t in held], pa.string()), model)
    truth = np.array([lang for _, lang, _ in held])
    heats = np.geomspace(0.25, 16, 49)
    losses = [-np.log(softmax(h * logits)[np.arange(len(truth)), truth] + 1e-12).mean() for h in heats]
    model.heat = float(heats[int(np.argmin(losses))])
    right = logits.argmax(axis=1) == truth
    if right.any():
        good = signals(logits[right], counts[right])
        model.known = rejection(model, fit, [(t, lang) for _, lang, t in held], good, seed)
        sure = np.sort(sigmoid(good @ model.known))
        model.least = min(0.5, 0.5 * float(sure[int(len(sure) * REJECTED_SHARE)]))
    return model


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def signals(logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(rows, 4): one, the lead of the best logit over the second (over 0 if there is none), its height, 1 / sqrt(n-grams)."""
    top = np.sort(np.concatenate([np.zeros((len(logits), 1)), logits] if logits.shape[1] < 2 else [logits], axis=1), axis=1)
    return np.column_stack([np.ones(len(top)), top[:, -1] - top[:, -2], top[:, -1], np.maximum(counts, 1) ** -0.5])


def rejection(model: Model, fit: Sample, held: list[tuple[str, int]], good: np.ndarray, seed: int) -> np.ndarray:
    """Weights of ``signals`` that tell held-back texts and cuts of them from texts of no learned language."""
    draw = np.random.default_rng(seed + 1)

    def seen(texts: list[str], by: Model) -> tuple[np.ndarray, np.ndarray]:
        logits, counts, letters = logits_of(pa.array(texts, pa.string()), by)
        return signals(logits[letters], counts[letters]), logits.argmax(axis=1)[letters]

    cuts, langs = [], []
    for text, lang in held:
        size = int(draw.integers(8, 80))
        at = int(draw.integers(0, max(1, len(text) - size)))
        if any(c.isalpha() for c in text[at : at + size]):
            cuts.append(text[at : at + size])
            langs.append(lang)
    short, taken = seen(cuts, model)
    yes = [good, short[taken == np.array(langs, taken.dtype)]]
    signs = sorted({c for text, _ in held for c in text if c.isalpha()})
    mixed = ["".join(np.array(list(text))[draw.permutation(len(text))]) for text, _ in held]
    made = [
        " ".join("".join(signs[i] for i in draw.integers(0, len(signs), draw.integers(2, 10))) for _ in range(draw.integers(2, 200)))
        for _ in held
    ]
    no = [seen(mixed, model)[0], seen(made, model)[0]]
    n = len(model.languages)
    for part in range(min(LEFT_OUT, n) if n > 2 else 0):
        stay = [k for k in range(n) if k % LEFT_OUT != part]
        place = {k: i for i, k in enumerate(stay)}
        table, bias = descended([(f, place[k]) for f, k in fit if k in place], len(stay), seed)
        without = Model([model.languages[k] for k in stay], table, bias, 1.0, model.known, 0.0)
        no.append(seen([text for text, k in held if k not in place], without)[0])
    x = np.concatenate(yes + no)
    y = np.concatenate([np.ones(sum(map(len, yes))), np.zeros(sum(map(len, no)))])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    weights = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge, so that parted classes have an end
        p = sigmoid(x @ weights)
        slope = x.T @ (share * (p - y)) + 1e-4 * weights
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        move = np.linalg.solve(curve, slope)
        weights = weights - move * min(1.0, 5 / (np.abs(move).max() + 1e-12))
    return weights


def fitted(docs: DataFrame, learned: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> Model:
    """Train on a bounded sample of the rows for which ``learned`` holds."""
    usable = docs.where(learned & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # most rows may be of one language: the smallest hashes of each salt first, so that no task ranks them all
    ids = usable.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    for keys in (["lang", F.pmod(F.hash("h"), F.lit(SALTS))], ["lang"]):
        first = Window.partitionBy(*keys).orderBy("h", "doc_id")
        ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language)
    ids = ids.select("doc_id").distinct()
    chosen = [r[0] for r in collect_bounded(ids, per_language * MOST_LANGUAGES, "the language sample")]
    small = docs.sparkSession.createDataFrame([(i,) for i in chosen], "_id long")  # bounded as above
    rows = (
        usable.join(F.broadcast(small), usable[id_col] == small["_id"])
        .select(F.xxhash64(usable[id_col]).alias("h"), usable[text_col].alias("text"), usable[lang_col].alias("lang"))
        .distinct()  # an id may stand in any number of rows
        .collect()
    )
    rows = sorted({(r["h"], r["text"], r["lang"]) for r in rows})
    return train([(text, lang) for _, text, lang in rows])


def logits_of(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, languages) logits before the temperature, the number of n-grams, whether there is a letter."""
    codes = [padded(str(t)) for t in column]
    sums = np.zeros((len(codes), len(model.languages)))
    counts = np.zeros(len(codes), np.int64)
    letters = np.zeros(len(codes), bool)
    ends = np.cumsum([len(c) for c in codes])
    whole = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    starts = ends - [len(c) for c in codes]
    for at in range(0, len(whole), SPAN):
        part = whole[at : at + SPAN + 3]  # an n-gram may reach 3 places on
        for start, bucket in grams(part, BUCKETS):
            inside = start < SPAN
            start, bucket = start[inside], bucket[inside]
            if not len(start):
                continue
            row = np.searchsorted(ends, start + at, side="right")
            first = np.flatnonzero(np.diff(row, prepend=-1))
            sums[row[first]] += np.add.reduceat(model.table[bucket], first, axis=0, dtype=np.float64)
            counts += np.bincount(row, minlength=len(codes))
    if len(whole):
        letters = np.maximum.reduceat(whole, starts) > 0
    return sums / np.maximum(counts, 1)[:, None] + model.bias, counts, letters


def judged(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """``scores`` and which rows are rejected."""
    logits, counts, letters = logits_of(column, model)
    out = softmax(model.heat * logits)
    out[~letters] = np.nan
    return out, ~letters | (sigmoid(signals(logits, counts) @ model.known) < model.least)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """(rows, languages) probabilities; NaN for rows without a letter."""
    return judged(column, model)[0]


SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def identified(
    docs: DataFrame,
    learned: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; learns where ``learned`` holds."""
    learned = F.coalesce(learned, F.lit(False))
    model = fitted(docs, learned, id_col, text_col, lang_col, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x MOST_LANGUAGES floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cut = batch.slice(at, 500)
                if m.languages:
                    p, refused = judged(cut.column(1), m)
                else:
                    p, refused = np.full((cut.num_rows, 1), np.nan), np.ones(cut.num_rows, bool)
                known = ~np.isnan(p[:, 0])
                top = np.where(known, np.nan_to_num(p).max(axis=1), 0.0)
                best = np.nan_to_num(p).argmax(axis=1)
                names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), pa.array(names, pa.string()), pa.array(top), pa.array(refused)],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_identified(
    docs: DataFrame,
    learned: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """The rows whose language is not rejected, with all their columns."""
    learned = F.coalesce(learned, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(
        fitted(docs, learned, id_col, text_col, lang_col, per_language)
    )

    def judge():
        m = shared.value
        if not m.languages:
            return lambda column: np.zeros(len(column), bool)
        return lambda column: ~judged(column, m)[1]

    return filtered(docs, text_col, judge)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: remainder 1, and rows without an id."""
    return F.coalesce(id_remainder(F.col(id_col), 3) == 1, F.lit(True))
