import sentencepiece

from assay.llm import pieces
from tests.llm.cases import LONG, awkward, empty

TEXTS = ["", " ", "a  b", "  x   y    z", "\n\nx", "tab\tx é€😀 y", "x" * 500, "lorem" * 100, "a\x00b c\x00", " " * 40, LONG,
         "Hello, World! 1234 don't", "日本語 テキスト"]


def test_ids_equal_the_library_and_decode_back(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    given = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(TEXTS + given)), "doc_id long, text string")
    for r in pieces.encoded(docs).collect():
        text = (TEXTS + given)[r.doc_id]
        assert r.ids == library.encode(text), text[:80]
        assert r.text_back == text
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs)).collect()}
    assert back == dict(enumerate(TEXTS + given))


def unigram():
    """The library with the same pieces, read as a unigram model."""
    raw = open(pieces.model_path(), "rb").read()
    at = raw.rfind(b"tok_v0\x18\x02") + len(b"tok_v0\x18")
    return sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x01" + raw[at + 1 :])


def test_viterbi_is_the_best_path_and_both_styles_agree(spark, sf):
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect() for w in r.text.split()})
    words = [w for w in words if w.isascii()][:1500]
    encoder = pieces.Encoder(pieces.model_path(), "viterbi")
    library = unigram()
    marked = [pieces.MARK + w for w in words]
    folded = encoder.words(marked)
    for w, ids in zip(words[:300], folded, strict=False):
        assert list(ids) == library.nbest_encode_as_ids(w, 1)[0]
    df = spark.createDataFrame([(w,) for w in marked], "word string")
    got = {r.word: tuple(r.ids) for r in pieces.segmented_words(df).collect()}
    assert got == dict(zip(marked, folded, strict=True))


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark, extra=True)
    got = pieces.digests(docs)
    assert got.count() == docs.count() and got.where("not round_trip").count() == 0
    assert {r.n_pieces for r in got.where("doc_id in (3, 4)").collect()} == {0}
    assert pieces.digests(empty(spark)).count() == 0 and pieces.encoded(empty(spark)).count() == 0
