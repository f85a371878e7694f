from collections import Counter

from pyspark.sql import functions as F

from assay.llm import toxicity
from tests.llm.cases import awkward, empty

WORDS = "idiot stupid loser moron pathetic scum trash clown worthless disgusting the and of then house lead"


def model():
    return toxicity.CharacterModel(toxicity.trigrams_of(Counter(WORDS.split() * 50).items()).items())


def test_channel_restores_disguised_words():
    m = model()
    pairs = {
        "1d10t": "idiot",
        "stuuupid": "stupid",
        "l0$er": "loser",
        "m o r o n": "moron",
        "s.c.u.m": "scum",
        "p4th3t1c": "pathetic",
        "tra$h": "trash",
        "d1sgu$ting": "disgusting",
    }
    assert {k: toxicity.restored(k, m) for k in pairs} == pairs


def test_spans_are_found_in_text():
    restore = toxicity.Restorer(model())
    found = toxicity.restored_words("what a l0ser, you m o r o n and 1d10t! plain words here", restore)
    assert set(found) >= {"loser", "moron", "idiot"}


def test_viterbi_is_the_best_of_all_readings():
    import itertools

    m = model()
    for span in ("1d10t", "l00ser", "cl0wnn"):
        best = None
        for choice in itertools.product(*toxicity.readings(span)):
            text, cost, state = "".join(c for c, _ in choice), sum(x for _, x in choice), toxicity.EDGE * 2
            for c in text + toxicity.EDGE:
                cost += m.cost(state, c)
                state = state[1] + c
            best = min(best or (cost, text), (cost, text))
        assert toxicity.restored(span, m) == best[1]


def labelled(spark):
    toxic = [(i, f"some words {w} stand here number {i}") for i, w in enumerate(["idiot", "loser", "moron"] * 14)]
    clean = [(100 + i, f"some words stand here and there number {i}") for i in range(60)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in clean], "doc_id long, toxic int")
    return docs, labels


def test_disguised_texts_score_high(spark):
    docs, labels = labelled(spark)
    new = [
        (900, "some words 1d10t stand"),
        (901, "you are a m o r o n here"),
        (902, "plain words stand here"),
        (903, None),
        (904, "such a looooser"),
    ]
    both = docs.unionByName(spark.createDataFrame(new, docs.schema))
    got = {r.doc_id: r.score for r in toxicity.scored(both, labels, F.lit(True)).collect()}
    assert min(got[i] for i in (900, 901, 904)) >= toxicity.THRESHOLD > max(got[i] for i in (902, 903, 110))
    kept = {r.doc_id for r in toxicity.keep_clean(both, labels, F.lit(True)).collect()}
    assert {902, 903, 110} <= kept and kept.isdisjoint({900, 901, 904, 0})


def test_held_out_documents(spark, sf):
    at = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs, labels, ~toxicity.held_out()).join(labels, "doc_id").where(toxicity.held_out())
    r = got.groupBy("toxic").agg(F.avg((F.col("score") >= toxicity.THRESHOLD).cast("int")).alias("share")).collect()
    share = {x.toxic: x.share for x in r}
    assert share[1] > 0.75 and share[0] < 0.02


def test_awkward_and_empty_tables(spark):
    _, labels = labelled(spark)
    docs = awkward(spark, extra=True)
    assert toxicity.scored(docs, labels, F.lit(True)).count() == docs.count()
    assert toxicity.keep_clean(docs, labels, F.lit(True)).columns == docs.columns
    assert toxicity.scored(empty(spark), labels, F.lit(True)).count() == 0
    none = toxicity.scored(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in none.collect()} == {0.0}
