from assay.llm import line_dedup
from tests.llm.cases import SHARED, awkward, empty


def brute(docs, least=5):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({65 + i: 97 + i for i in range(26)})
    found = [(r.doc_id, (r.text or "").split("\n")) for r in docs.collect()]
    holders: dict = {}
    for n, (doc, lines) in enumerate(found):
        for k in {key(x) for x in lines if len(key(x)) >= 40}:
            holders.setdefault(k, []).append((n, doc))
    last = {k: max(d for _, d in h if d is not None) for k, h in holders.items() if len(h) >= least}
    out = []
    for doc, lines in found:
        kept = [x for x in lines if not (doc is not None and doc < last.get(key(x), -1))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    docs = awkward(spark, extra=True)
    got = sorted((tuple(r) for r in line_dedup.without_common_lines(docs).collect()), key=str)
    assert got == brute(docs)
    assert (20, 3, 2, "own line 0") in got and any(g[0] == 25 and g[2] == 0 for g in got)


def test_runs_tell_new_keys_and_compact(spark):
    runs = line_dedup.LineRuns(spark, fan=2)
    batch = lambda *kv: spark.createDataFrame([(d, bytearray(k)) for d, k in kv], "doc_id long, key binary")
    fresh = [
        sorted(bytes(r.key) for r in runs.add(b).collect())
        for b in (batch((1, b"a"), (2, b"a"), (2, b"b")), batch((3, b"a"), (3, b"c")), batch((4, b"c"), (4, b"d")))
    ]
    assert fresh == [[b"a", b"b"], [b"c"], [b"d"]]
    assert [len(level) for level in runs.levels] == [1, 1]
    merged = {bytes(r.key): (r.n_docs, r.last_id) for r in runs.merged().collect()}
    assert merged == {b"a": (3, 3), b"b": (1, 2), b"c": (2, 4), b"d": (1, 4)}


def test_short_and_rare_lines_stay_and_empty_table_works(spark):
    docs = spark.createDataFrame([(i, SHARED) for i in range(4)], "doc_id long, text string")
    assert line_dedup.without_common_lines(docs).where("n_dropped > 0").count() == 0
    assert line_dedup.without_common_lines(empty(spark)).count() == 0
