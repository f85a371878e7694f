import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assay.llm import language_id
from tests.llm.cases import awkward, empty


def any_id():
    return F.col("doc_id").isNotNull()


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = language_id.identified(docs, ~language_id.held_out()).join(docs.select("doc_id", "lang"), "doc_id")
    r = (
        got.where(language_id.held_out())
        .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")))
        .first()
    )
    assert r[0] > 0.97 and r[1] < 0.01


def test_awkward_texts_have_defined_results(spark):
    got = {r.doc_id: r for r in language_id.identified(awkward(spark, extra=True), any_id()).collect()}
    for doc in (3, 4, 5):
        assert (got[doc].lang_pred, got[doc].score, got[doc].rejected) == ("und", 0.0, True)
    assert got[None].lang_pred in ("en", "de") and got[6].lang_pred == "en"
    kept = language_id.keep_identified(awkward(spark, extra=True), any_id())
    assert kept.columns == awkward(spark, extra=True).columns
    assert {3, 4, 5}.isdisjoint(r.doc_id for r in kept.collect())


def test_nothing_to_learn(spark):
    got = language_id.identified(awkward(spark), F.lit(False))
    assert got.where("lang_pred <> 'und' or not rejected").count() == 0
    assert language_id.identified(empty(spark), any_id()).count() == 0
    assert language_id.keep_identified(empty(spark), any_id()).count() == 0


def test_spans_do_not_change_scores(monkeypatch, spark):
    import pyarrow as pa

    model = language_id.train([("the of and to in that", "en"), ("der die und das ein nicht", "de")] * 20)
    texts = pa.array(["the end of that", "", "das ist nicht die ", "1234", "und " * 50])
    whole = language_id.scores(texts, model)
    monkeypatch.setattr(language_id, "SPAN", 7)
    parts = language_id.scores(texts, model)
    assert abs(whole - parts)[[0, 2, 4]].max() < 1e-9


def test_texts_of_no_learned_language_go_and_clean_ones_stay(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    learned = docs.where("lang <> 'fr'")
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(4000)]
    planted = [(10**7 + i, " ".join(words[40 * i : 40 * i + 40])) for i in range(100)]
    planted += [(2 * 10**7, "то есть язык людей в большом городе"), (2 * 10**7 + 1, "if (x[i] == y[k]) { return fn(&z, 0x1f); }")]
    junk = spark.createDataFrame(planted, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    foreign = docs.where("lang = 'fr'").withColumn("lang", F.lit(None).cast("string"))
    both = learned.select("doc_id", "text", "lang").unionByName(junk).unionByName(foreign.select("doc_id", "text", "lang"))
    kept = language_id.keep_identified(both, ~language_id.held_out()).select("doc_id", "lang").cache()
    clean = learned.where("length(text) > 0").count()
    assert kept.where("lang IS NOT NULL").count() >= 0.99 * clean
    assert kept.where("doc_id >= 10000000").count() <= 2
    assert kept.where("lang IS NULL").count() <= 0.1 * foreign.count()


def test_fit_holds_little_beside_its_model(monkeypatch):
    """The driver fits the model: scoring the held-back texts may not hold n-grams of all of them."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop" if k else "klmnopqrstuvwxyz", k=6)) for k in (0, 1) for _ in range(400)]
    rows = [(" ".join(rng.choices(words[k * 400 : k * 400 + 400], k=4000)), "xy"[k]) for k in (0, 1) for _ in range(40)]
    plain = [language_id.features(text, language_id.BUCKETS) for text, _ in rows]
    for (a, b), (c, d) in zip(plain, language_id.packed([text for text, _ in rows]), strict=True):
        assert (a == c).all() and (b == d).all()
    model = language_id.train(rows)
    texts = pa.array([text for text, _ in rows], pa.string())
    whole = sum(len(text) for text, _ in rows)
    tracemalloc.start()
    logits, counts, letters = language_id.logits_of(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * whole, peak  # two copies of the code points at 4 bytes and a span's n-grams
    assert letters.all() and [model.languages[k] for k in logits.argmax(axis=1)] == [lang for _, lang in rows]
    monkeypatch.setattr(language_id, "SPAN", 1 << 20)
    again = language_id.logits_of(texts, model)
    assert np.allclose(logits, again[0], rtol=1e-12) and (counts == again[1]).all() and (letters == again[2]).all()
