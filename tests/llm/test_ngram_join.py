import re

import numpy as np
import pytest

from assay.llm import ngram_join
from tests.llm.cases import awkward, empty


def brute(docs, words, num, den):
    lower = {65 + i: 97 + i for i in range(26)}
    sets = {}
    for r in docs.collect():
        w = [x for x in re.split("[\x20\x09-\x0d]+", (r.text or "").translate(lower)) if x]
        s = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
        sets[r.doc_id] = s
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(ids, 0)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


@pytest.mark.parametrize(("words", "num", "block"), [(3, 90, 1 << 20), (5, 80, 2000)])
def test_given_documents_match_brute_force(spark, sf, words, num, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ngram_join.linked(docs, words=words, num=num, den=100, block_shingles=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute(docs, words, num, 100)
    assert len(got) == docs.count()


def test_families_of_near_copies_match_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = []
    for family in range(6):
        base = [f"w{family}x{i}" for i in range(60 + 40 * family)]
        for _ in range(25):
            own = list(base)
            for spot in draw.integers(0, len(own), draw.integers(0, 9)):
                own[spot] = f"n{draw.integers(1 << 40)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + i, " ".join(f"hot{j}" for j in range(30)) + f" tail{i} tail{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words, num, block in ((3, 90, 1 << 20), (5, 80, 3000)):
        got = ngram_join.linked(docs, words=words, num=num, den=100, block_shingles=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute(docs, words, num, 100)


def test_signatures_share_a_key_for_every_linked_pair():
    draw = np.random.default_rng(1)
    for num in (90, 80, 50):
        bounds = ngram_join.Bounds(num, 100)
        for _ in range(300):
            n = int(draw.integers(1, 400))
            a = np.unique(draw.integers(0, 1 << 60, n).astype(np.uint64))
            drop = int(draw.integers(0, max(1, len(a) * (100 - num) // 100) + 1))
            b = np.union1d(draw.permutation(a)[drop:], draw.integers(0, 1 << 60, drop // 2).astype(np.uint64))
            both = len(np.intersect1d(a, b))
            if both * 100 >= num * (len(a) + len(b) - both):
                for common in (a[:0], np.intersect1d(a, b), a[::3]):
                    keys = [ngram_join.signatures(x, bounds, common) for x in (a, b)]
                    assert np.intersect1d(*keys).size


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 200)]
    got = ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark, extra=True)
    got = {r.doc_id: r for r in ngram_join.linked(docs).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in (1, 2, 3, 4, 5)} == {
        1: (4, 1), 2: (4, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
    assert got[7].component_id == 6 and got[None].component_id is None
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, *range(20, 26)]
    assert ngram_join.linked(empty(spark)).count() == 0
    assert ngram_join.keep_first(empty(spark)).count() == 0
