import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from assay.llm import line_quality as L
from assay.llm.common import table
from tests.llm.cases import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(line)) and line in lines[:i] for i, line in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def field(seed=4):
    draw = np.random.default_rng(seed)
    return L.Field(draw.normal(0, 1, L.TRAITS), draw.normal(0, 1, (2, 2)))


def test_counts_match_brute_force(spark):
    docs = awkward(spark, extra=True)
    want = sorted(brute(r.text) for r in docs.collect() if r.text is None or len(r.text) < 5000)
    got = L.judged(docs, labels(spark, [(1, 1), (7, 0), (8, None), (None, 1)])).collect()
    assert len(got) == docs.count()
    assert sorted(tuple(r[c] for c in COUNTS) for r in got if r.n_words < 1000) == want
    long = next(r for r in got if r.doc_id == 6)
    assert long.n_words == long.n_repeat_words == 13 * 800 and long.base_failed and not long.kept
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)


def test_random_counts():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("ab#é \n\t\x0b\xa0\x85|") for _ in range(draw.randrange(60)))
        assert L.measured(text, field())[:5] == brute(text), repr(text)


def test_viterbi_is_the_best_of_all_labellings():
    f = field()
    draw = np.random.default_rng(7)
    for n in range(1, 8):
        scores = draw.normal(0, 2, n)

        def worth(path):
            return sum(s for s, y in zip(scores, path) if y) + sum(f.steps[a, b] for a, b in zip(path, path[1:]))

        assert worth(f.decoded(scores)) == max(map(worth, itertools.product((0, 1), repeat=n)))


def test_likelihood_and_gradient_match_enumeration():
    f = field()
    draw = np.random.default_rng(8)
    sequences = [draw.integers(0, 1 << L.TRAITS, n) for n in (3, 1, 4)]
    truth = [draw.integers(0, 2, len(s)) for s in sequences]
    sample = L.Sample(sequences)
    weight = np.array([0.5, 1.0, 2.0])

    def likely(f):
        total = 0.0
        for w, i in zip(weight, sample.order):
            x = L.unpacked(sequences[i]) @ f.weights

            def worth(path, x=x):
                return sum(s for s, y in zip(x, path) if y) + sum(f.steps[a, b] for a, b in zip(path, path[1:]))

            total += w * (worth(truth[i]) - np.logaddexp.reduce([worth(p) for p in itertools.product((0, 1), repeat=len(x))]))
        return total

    x, laid = L.unpacked(sample.traits), sample.laid(truth)
    value, g, g_steps = L.gradient(f, sample, x, laid, weight)
    assert np.isclose(value, likely(f))
    for k in (0, 5, L.TRAITS - 1):
        e = np.eye(L.TRAITS)[k] * 1e-5
        slope = (likely(L.Field(f.weights + e, f.steps)) - likely(L.Field(f.weights - e, f.steps))) / 2e-5
        assert np.isclose(slope, g[k], atol=1e-5)
    for a, b in itertools.product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[a, b] = 1e-5
        slope = (likely(L.Field(f.weights, f.steps + e)) - likely(L.Field(f.weights, f.steps - e))) / 2e-5
        assert np.isclose(slope, g_steps[a, b], atol=1e-5)


def test_held_out_texts_are_told_apart(spark, sf):
    docs, marks = table(spark, sf.replace("sf0.001", "sf0.01"), "documents"), table(spark, sf.replace("sf0.001", "sf0.01"), "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = L.judged(docs, marks, ~held).where(held & ~F.col("base_failed")).join(marks, "doc_id").where("quality IS NOT NULL")
    counts = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    good, bad = counts.get((1, True), 0), counts.get((0, False), 0)
    assert good >= 0.98 * (good + counts.get((1, False), 0)) > 50
    assert bad >= 0.8 * (bad + counts.get((0, True), 0)) > 0


def test_boilerplate_lines_are_marked_inside_a_text(spark):
    """Lines of a bad text that look like those of good ones stay content."""
    draw = random.Random(6)
    clean = lambda: "The " + " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(12)) + "."
    junk = lambda: " ".join("".join(draw.choices("abcd", k=4)) + "###" for _ in range(8))
    good = [(i, "\n".join(clean() for _ in range(8))) for i in range(40)]
    bad = [(100 + i, "\n".join([clean(), *[junk() for _ in range(9)], clean()])) for i in range(40)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    marks = labels(spark, [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad])
    got = {r.doc_id: r for r in L.judged(docs, marks).collect()}
    assert all(set(got[i].line_labels) == {1} and got[i].kept for i, _ in good)
    assert all(got[i].line_labels[1:10] == [0] * 9 and not got[i].kept for i, _ in bad)
    assert sum(got[i].line_labels[0] for i, _ in bad) > 20


def test_nothing_to_learn_from_and_empty_tables(spark):
    none = labels(spark, [])
    assert L.judged(empty(spark), none).count() == 0
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (1, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.kept) for r in L.judged(docs, none).collect()) == [(0, False), (60, True)]
