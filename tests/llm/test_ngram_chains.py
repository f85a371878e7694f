"""Chains of rows that are not linked, and clusters of many row blocks."""

import numpy as np
import pyarrow as pa

from assay.llm import common, ngram_join
from assay.session import ensure_checkpoint_dir
from tests.llm.test_ngram_join import brute


def test_finer_keys_are_shared_by_every_linked_pair():
    draw = np.random.default_rng(2)
    seen = 0
    for num in (90, 80, 50):
        bounds = ngram_join.Bounds(num, 100)
        for _ in range(400):
            n = int(draw.integers(1, 400))
            a = np.unique(draw.integers(0, 1 << 60, n).astype(np.uint64))
            drop = int(draw.integers(0, max(1, len(a) * (100 - num) // 100) + 1))
            b = np.union1d(draw.permutation(a)[drop:], draw.integers(0, 1 << 60, drop // 2).astype(np.uint64))
            both = np.intersect1d(a, b)
            if len(both) * 100 >= num * (len(a) + len(b) - len(both)):
                for held in (a[:0], both, a[::3], both[1:], np.union1d(a, b)):
                    seen += 1
                    assert np.intersect1d(*(ngram_join.finer_keys(x, bounds, held) for x in (a, b))).size
    assert seen > 2000


def rows_of(case: int = 4) -> list[tuple[int, str]]:
    """Texts of own words and common passages, which chain them, and a family of near copies."""
    draw = np.random.default_rng(case)
    word = lambda: f"w{draw.integers(1 << 40)}"
    passages = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = []
    for _ in range(160):
        own = [" ".join(word() for _ in range(int(draw.integers(120, 150)))), *(passages[i] for i in draw.permutation(12)[:3])]
        rows.append(" ".join(own[i] for i in draw.permutation(len(own))))
    base = [word() for _ in range(150)]
    for _ in range(60):
        own = list(base)
        for spot in draw.integers(0, len(own), draw.integers(0, 4)):
            own[spot] = word()
        rows.append(" ".join(own))
    return list(enumerate(rows))


def test_chained_rows_are_split_before_their_sets_are_copied(spark, monkeypatch):
    """The sets that go to pairs of row blocks are few, their rounds bounded, and no set nor shuffle stays behind."""
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    written = []

    def saved(df, what):
        out = common.saved(df, what)
        written.append((what, out))
        return out

    monkeypatch.setattr(ngram_join, "saved", saved)
    got = ngram_join.linked(docs, block_shingles=2000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute(docs, 5, 80, 100)
    totals = {what: out.groupBy("cluster").count().agg({"count": "max"}).first()[0] for what, out in written if what.endswith("members")}
    assert totals["finer-members"] < totals["members"]
    cells = next(out for what, out in written if what == "cells")
    shingles = sum(r.n_shingles for r in got)
    copied = cells.selectExpr("sum(n * size(cells))").first()[0]
    rounds = sum(what == "links" for what, _ in written)
    assert rounds == -(-copied // max(2000, shingles // 2)) and rounds > 1
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    left = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(hadoop, "assay-ngram-join-*"))
    assert not list(left or [])


def test_one_cell_of_every_pair_of_blocks_is_compared_once(spark, monkeypatch):
    """Rounds of any number give the links of one round."""
    docs = spark.createDataFrame(rows_of(6)[130:], "doc_id long, text string")
    whole = sorted(ngram_join.linked(docs, block_shingles=1500).collect())
    monkeypatch.setattr(ngram_join, "ROUND_SHARE", 1e9)
    assert sorted(ngram_join.linked(docs, block_shingles=1500).collect()) == whole


def test_finer_keys_of_a_batch_and_of_a_row_agree(spark):
    row = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 90).astype(np.uint64))
    members = spark.createDataFrame([(1, row.tobytes()), (2, row.tobytes())], "rep long, hashes binary")
    edges = ngram_join.finer_neighbours(members, 80, 100, row[:3]).collect()
    assert [tuple(e) for e in edges] == [(2, 1)]
    assert isinstance(ngram_join.key_batch([1], [ngram_join.finer_keys(row, ngram_join.Bounds(80, 100), row[:3])]), pa.RecordBatch)
