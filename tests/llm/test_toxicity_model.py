"""The character model over tables: every trigram counts."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from assay.llm import toxicity
from tests.llm.test_toxicity import labelled

COMMON = "idiot stupid loser moron pathetic scum trash clown"


def tables(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = sorted({span for t in texts for span, _ in toxicity.spans_of(t)})
    return toxicity.gram_counts(rows), spark.createDataFrame([(s,) for s in found], "span string")


def test_table_model_is_the_model_of_all_counts(spark):
    spans = ["1d10t", "stuuupid", "m o r o n", "z3lk4v"]
    texts = [COMMON] * 50 + ["zelkav said " + " ".join(spans)]
    counts, found = tables(spark, texts)
    got = {r.span: r.spelled for r in toxicity.restored_spans(found, counts).collect()}
    words = Counter(w for t in texts for w in toxicity.WORD.findall(t))
    model = toxicity.CharacterModel(toxicity.trigrams_of(words.items()).items())
    assert set(got) == set(spans)
    assert got == {s: toxicity.restored(s, model) for s in got}
    # the trigrams of zelkav occur once only
    assert got["z3lk4v"] == "zelkav"


def test_grams_of_single_words_are_kept(spark):
    counts, _ = tables(spark, [COMMON] * 3 + ["漢字語 나라말"])
    n = {r.gram: r.n for r in counts.collect()}
    assert n["漢字語"] == 1 and n["나라말"] == 1
    needed = spark.createDataFrame([(g,) for g in (*n, "qqq", "id漢")], "gram string")
    model = toxicity.CharacterModel(n.items())
    for r in toxicity.gram_costs(needed, counts).collect():
        assert abs(r.cost - model.cost(r.gram[:2], r.gram[2])) < 1e-9


def test_restored_words_reach_repeated_texts_and_keep_rows(spark):
    docs, labels = labelled(spark)
    new = [(900, "some 1d10t here"), (900, "some 1d10t here"), (None, "some 1d10t here"), (901, "plain words")]
    both = docs.unionByName(spark.createDataFrame(new, docs.schema))
    got = [r.score for r in toxicity.scored(both, labels, F.lit(True)).collect() if r.doc_id in (900, None)]
    assert len(got) == 3 and min(got) >= toxicity.THRESHOLD
    kept = toxicity.keep_clean(both, labels, F.lit(True))
    assert kept.columns == both.columns and kept.where("doc_id = 901").count() == 1
    assert kept.where("doc_id = 900 OR doc_id IS NULL").count() == 0


def test_every_kind_of_disguise_scores_high(spark):
    docs, labels = labelled(spark)
    toxic = [(200 + i, f"some words {w} stand here number {i}") for i, w in enumerate(["stupid", "ass", "asshole"] * 14)]
    docs = docs.unionByName(spark.createDataFrame(toxic, docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(i, 1) for i, _ in toxic], labels.schema))
    planted = ["a$$", "a55", "@$$", "@$$hole", "stuupid", "a s s", "stu pid", "id-iot", "mo. ron", "lo\nser"]
    plain = ["hello letter 3rd of 1990s", "$500 or a b c", "the pid stu of iot id", None]
    new = [(900 + i, w and f"some words {w} stand here") for i, w in enumerate(planted + plain)]
    both = docs.unionByName(spark.createDataFrame(new, docs.schema))
    got = {r.doc_id: r.score for r in toxicity.scored(both, labels, F.lit(True)).collect()}
    assert {w for i, w in enumerate(planted) if got[900 + i] < toxicity.THRESHOLD} == set()
    assert {w for i, w in enumerate(plain, len(planted)) if got[900 + i] >= toxicity.THRESHOLD} == set()


def test_words_of_several_flushes_add_up(spark, monkeypatch):
    texts = [COMMON, "漢字語 " + COMMON, "", "a a a bb"] * 5
    words = Counter(w for t in texts for w in toxicity.WORD.findall(t))
    monkeypatch.setattr(toxicity, "HELD_WORDS", 3)  # forked or not, the sums are the same
    got = {r.gram: r.n for r in toxicity.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == dict(toxicity.trigrams_of(words.items()))


def test_reach_leaves_out_only_spans_that_restore_to_nothing(spark):
    lexicon = {"idiot" + toxicity.EDGE: 1.0, "stup": 1.0, "ass" + toxicity.EDGE: 1.0}
    reach = toxicity.Reach(lexicon)
    model = toxicity.CharacterModel(toxicity.trigrams_of({w: 50 for w in COMMON.split() + ["ass"]}.items()).items())
    spans = {s for t in ["1d10t a$$ stuupid hello letter b00k i d i o t", "x i d 1 o t y @55 $tup1d stupid77 ass1"] for s in toxicity.spans_of(t)}
    for span, apart in spans:
        word = toxicity.restored(span, model)
        starts = range(len(word)) if apart else (0,)
        written = not apart and any(toxicity.strength(p, lexicon) for p in toxicity.WORD.findall(span))
        meets = not written and any(toxicity.strength(word[i:], lexicon) for i in starts)
        assert reach(span, apart) or not meets
    assert {s for s, apart in spans if reach(s, apart)} >= {"1d10t", "a$$", "stuupid", "$tup1d"}
    assert not reach("hello", False) and not reach("letter", False)


def test_weights_of_marks_equal_those_of_the_dense_matrix():
    draw = np.random.default_rng(4)
    dense = (draw.random((200, 40)) < 0.1).astype(np.float32)
    dense[:, 39] = 0  # an entry that no text holds
    truth = (dense[:, :3].sum(axis=1) > 0).astype(np.float32)
    share = np.where(truth == 1, 1.0, 2.5).astype(np.float32)
    at, of = np.nonzero(dense)
    marks = toxicity.Marks(at, of, dense.shape)
    found = toxicity.covering_weights(marks, truth, share, -1.0)
    wanted = toxicity.covering_weights(dense, truth, share, -1.0)
    assert np.allclose(found[0], wanted[0], atol=1e-3) and abs(found[1] - wanted[1]) < 1e-3
    assert (found[0] > 0).tolist() == (wanted[0] > 0).tolist()
