from pyspark.sql import functions as F

from assay.llm import exact_dedup
from tests.llm.cases import awkward, empty, rows


def brute(docs):
    found = [(r.doc_id, r.text or "") for r in docs.collect()]
    norm = [("".join(c for c in t if c not in " \t\n\x0b\x0c\r")) for _, t in found]
    out = []
    for (doc, _), n in zip(found, norm, strict=True):
        group = [(-len(t), d is None, d, d) for (d, t), m in zip(found, norm, strict=True) if m == n]
        keep = min(group, key=lambda g: (g[0], g[1], g[2] or 0))[3]
        out.append((doc, keep, len(group), doc == keep))
    return sorted(out, key=str)


def test_classes_match_brute_force_whatever_the_digest(spark):
    docs = awkward(spark)
    want = brute(docs)
    weak = lambda c: F.substring(exact_dedup.sha256_bytes(c), 1, 0)  # noqa: E731  one digest for all texts
    for digest in (exact_dedup.sha256_bytes, weak):
        got = exact_dedup.duplicate_classes(docs, digest=digest).drop("text_sha256")
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_kept_rows_have_all_columns_and_one_row_per_text(spark):
    docs = awkward(spark, extra=True)
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns
    assert rows(kept.select("doc_id")) == [(2,), (5,), (6,), (7,), (8,), *[(20 + i,) for i in range(6)], (None,)]


def test_empty_table(spark):
    assert exact_dedup.duplicate_classes(empty(spark)).count() == 0
    assert exact_dedup.keep_rows(empty(spark)).count() == 0
