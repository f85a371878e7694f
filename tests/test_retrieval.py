"""Citation hold-out, graph, lexical and vector search against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.operators import lexical, paths
from assay.operators import retrieval as R
from assay.operators import vectors as V


def edge_frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def random_edges(seed, nodes=30, n=200):
    rng = random.Random(seed)
    # node n0 is a hub: a third of all edges leave it or reach it
    pick = lambda: "n0" if rng.random() < 0.17 else f"n{rng.randrange(nodes)}"
    return {(a, b) for a, b in ((pick(), pick()) for _ in range(n)) if a != b}


def unit(*parts):
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big") / 2**64


def brute_holdout(edges, salt):
    out = defaultdict(list)
    for s, t in edges:
        out[s].append(t)
    held = set()
    for s, ts in out.items():
        if len(ts) >= 3:
            order = sorted(sorted(ts), key=lambda t: unit(salt, R.FAMILY, s, t))
            held |= {(s, t) for t in order[: max(1, round(0.3 * len(ts)))]}
    kept = edges - held
    return held - {(s, t) for s, t in held if (t, s) in kept}


def test_six_edges_hold_two(spark):
    edges, _ = R.edge_holdout(edge_frame(spark, [("s", f"t{i}") for i in range(6)]), 1)
    assert edges.filter("held").count() == 2 and edges.filter("NOT held").count() == 4


@pytest.mark.parametrize("salt", [1, 2, 3])
def test_holdout_against_brute_force(spark, salt):
    pairs = random_edges(salt)
    edges, sources = R.edge_holdout(edge_frame(spark, pairs), salt)
    rows = edges.collect()
    held = {(r["source"], r["target"]) for r in rows if r["held"]}
    assert held == brute_holdout(pairs, salt)
    assert {(r["source"], r["target"]) for r in rows} == pairs
    h, k = edges.filter("held"), edges.filter("NOT held")
    assert R.readable_gold(h, k).count() == 0 and R.reciprocal(h, k).count() == 0
    want = {s for s, _ in held} & {s for s, _ in pairs - held}
    assert {r["source"] for r in sources.collect()} == want


def test_graph_scores_against_brute_force(spark):
    pairs = random_edges(4)
    out = defaultdict(set)
    for s, t in pairs:
        out[s].add(t)
    sources = edge_frame(spark, pairs).select("source").distinct()
    got = {(r["source"], r["candidate"]): r["score"] for r in R.graph_scores(edge_frame(spark, pairs), sources).collect()}
    want = Counter()
    for s in out:
        for u in out[s]:
            want[s, u] += 1
            for c in out[u]:
                if c != s:
                    want[s, c] += 1
    assert got == dict(want)


def test_reachability_against_brute_force(spark):
    pairs = random_edges(6, nodes=40, n=90)
    held = brute_holdout(pairs, 3)
    kept = pairs - held
    out, into = defaultdict(set), defaultdict(set)
    for s, t in kept:
        out[s].add(t)
        into[t].add(s)
    gold = defaultdict(set)
    for s, t in held:
        gold[s].add(t)
    two = [any(t in out[u] for t in ts for u in out[s]) for s, ts in gold.items()]
    co = [any((out[s] - {t}) & (out[t] - {s}) for t in ts) for s, ts in gold.items()]
    ci = [any((into[s] - {t}) & (into[t] - {s}) for t in ts) for s, ts in gold.items()]
    r = R.reachability(edge_frame(spark, held), edge_frame(spark, kept)).first()
    n = len(gold)
    assert r["sources_measured"] == n
    assert r["two_hop_fraction"] == pytest.approx(sum(two) / n)
    assert r["co_citation_fraction"] == pytest.approx(sum(co) / n)
    assert r["common_citer_fraction"] == pytest.approx(sum(ci) / n)
    assert r["any_signal_fraction"] == pytest.approx(sum(map(any, zip(two, co, ci))) / n)


def test_unknown_endpoint_fails(spark):
    nodes = spark.createDataFrame([("n1", "document", "d1"), ("n2", "document", "d2"), ("n3", "token", "x")], "node_cid string, kind string, entry_cid string")
    corpus = spark.createDataFrame([("d1",)], "entry_cid string")
    raw = spark.createDataFrame([("n1", "n3", "cites"), ("n1", "n1", "cites")], "subject_cid string, object_cid string, relation string")
    assert R.resolve_edges(raw, nodes, corpus, "cites").count() == 0
    bad = raw.unionByName(spark.createDataFrame([("n1", "n2", "cites")], raw.schema))
    with pytest.raises(Exception, match="not in corpus"):
        R.resolve_edges(bad, nodes, corpus, "cites").collect()


def brute_bm25(docs, queries, k):
    tok = lambda x: re.findall("[a-z0-9]+", x.lower())
    tf = {}
    for d, title, text in docs:
        c = Counter()
        for t in tok(title):
            c[t] += 5.0
        for t in tok(title + "\n" + text):
            c[t] += 1.0
        tf[d] = c
    size = {d: sum(c.values()) or 1.0 for d, c in tf.items()}
    avg, n = sum(size.values()) / len(size), len(tf)
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for q, text in queries:
        s = Counter()
        for t in set(tok(text)):
            if t in df:
                idf = max(1e-6, math.log((n - df[t] + 0.5) / (df[t] + 0.5)))
                for d, c in tf.items():
                    if t in c:
                        s[d] += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[d] / avg))
        out[q] = sorted(((round(v, 9), d) for d, v in s.items() if v > 0), key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.mark.parametrize("k", [3, 100])
def test_bm25_against_brute_force(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(["the", "of"] + [words[min(int(rng.expovariate(0.15)), 39)] for _ in range(n)])
    docs = [(f"d{i:03d}", f"title {i % 7}", text(rng.randint(1, 30))) for i in range(60)] + [("d900", "", "")]
    queries = [("q1", text(4)), ("q2", "the of"), ("q3", "absent"), ("q4", "w39 the")]
    got = R.bm25_search(
        spark.createDataFrame(docs, "doc string, title string, text string"), spark.createDataFrame(queries, "source string, text string"), k
    )
    found = defaultdict(list)
    for r in got.orderBy("source", "rank").collect():
        found[r["source"]].append((round(r["score"], 9), r["candidate"]))
    for q, want in brute_bm25(docs, queries, k).items():
        assert [x[0] for x in found[q]] == pytest.approx([x[0] for x in want], abs=1e-8)
        # ties in the last float bits may swap, so compare ids where scores are apart
        assert {x[1] for x in found[q][:-1]} <= {x[1] for x in want} | {x[1] for x in found[q][-1:]}


def lexical_case(n=400, seed=11):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    text = lambda m: " ".join(["the"] + [words[min(int(rng.expovariate(0.03)), 199)] for _ in range(m)])
    docs = [(i, "", text(rng.randint(1, 30))) for i in range(n)]
    docs += [(n + i, "", docs[i % 3][2]) for i in range(n // 2)]  # many equal documents
    return docs, [(i, docs[i][2]) for i in range(0, 40, 4)] + [(-1, text(3)), (-2, "absent")]


def test_lexical_blocks_and_spans_change_nothing(spark):
    """Integer ids, exact ties at the cut, a query that is a document, many small blocks."""
    docs, queries = lexical_case()
    dd = spark.createDataFrame(docs, "doc long, title string, text string")
    qq = spark.createDataFrame(queries, "source long, text string")
    postings = R.bm25_index(dd).withColumn("impact", F.col("tf") / (F.col("tf") + F.col("doc_len")))
    words = qq.select("source", F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("term"))
    weights = words.join(R.inverse_frequency(postings, F.lit(len(docs))).select("term", "idf"), "term")
    impact = {(r["doc"], r["term"]): r["impact"] for r in postings.collect()}
    scores = defaultdict(float)
    for r in weights.collect():
        for d, *_ in docs:
            if (d, r["term"]) in impact and d != r["source"]:
                scores[r["source"], d] += r["idf"] * impact[d, r["term"]]
    for span, block in ((10_000, 10_000), (100, 10), (60, 60)):
        found = R.best_documents(postings.select("doc", "term", "impact"), weights, len(docs), 7, span, block)
        got = defaultdict(list)
        for r in R.top_k(found, 7).orderBy("source", "rank").collect():
            got[r["source"]].append((r["candidate"], r["score"]))
        assert -2 not in got
        for q, _ in queries[:-1]:
            want = sorted(((-round(s, 9), d) for (a, d), s in scores.items() if a == q and s > 0))[:7]
            assert [c for c, _ in got[q]] == [d for _, d in want], (span, q)
            assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in want], abs=1e-8)


def test_lexical_blocks_are_skipped():
    """A block whose bound stays below the k-th score is not added up."""
    queries = pa.table({"source": ["q", "q"], "term": ["a", "b"], "idf": [1.0, 2.0]})
    chunk = lexical.Chunk(queries, 2)
    block = lambda docs, impacts: pa.table({"doc": docs, "term": ["a"] * len(docs), "impact": impacts})
    chunk.take(block(["d1", "d2", "d3"], [0.9, 0.8, 0.1]))
    chunk.take(block(["e1", "e2"], [0.7, 0.2]))
    assert chunk.skipped == 1 and [d for _, d in chunk.best[0]] == ["d1", "d2"]
    chunk.take(block(["c9"], [0.8]))  # ties with the k-th: the smaller id wins
    assert chunk.skipped == 1 and [d for _, d in chunk.best[0]] == ["d1", "c9"]


def test_lexical_search_shuffles_no_pairs(spark):
    docs, queries = lexical_case(60)
    got = R.bm25_search(
        spark.createDataFrame(docs, "doc long, title string, text string"), spark.createDataFrame(queries, "source long, text string"), 5
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"hashpartitioning\(source[^)]*, doc", plan)


@pytest.mark.parametrize("k,cells,block", [(3, 8, None), (50, 4, 7), (5, 1, 10), (4, None, 16)])
def test_vector_search_against_brute_force(spark, k, cells, block):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(5, 8)) * 3
    rows = []
    for i in range(150):
        # a third of all vectors sits in one tight cluster
        c = centres[0] if i % 3 == 0 else centres[rng.integers(5)]
        rows.append((int(i // 2), int(i % 2), [float(x) for x in (c + rng.normal(size=8)).astype("float32")]))
    rows.append((900, 0, [0.0] * 8))
    df = spark.createDataFrame(rows, "owner bigint, window_index int, vec array<float>")
    got = defaultdict(list)
    for r in V.vector_search(df, df.select("owner"), k, cells, block).orderBy("source", "rank").collect():
        got[r["source"]].append((r["candidate"], r["score"]))
    m = np.array([r[2] for r in rows], dtype=np.float64)
    m = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    sims = m @ m.T
    owners = np.array([r[0] for r in rows])
    for q in set(owners.tolist()):
        best = {c: sims[np.ix_(owners == q, owners == c)].max() for c in set(owners.tolist()) - {q}}
        want = sorted(((c, s) for c, s in best.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]
        assert [c for c, _ in got[q]] == [c for c, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want])


def test_vector_index_bounds_hold_and_shells_are_bounded(spark):
    """No shell is larger than a block, though a third of the rows are one vector; angles lie within the shell's."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, [1.0, 0.5, 0.0, 0.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "owner bigint, window_index int, vec array<float>")
    placed, shells, pivots = V.indexed(df, None, 20)
    sizes = [r["count"] for r in placed.groupBy("cell", "shell").count().collect()]
    assert max(sizes) <= 20 and sum(sizes) == 300 and len(pivots) == 4
    assert placed.join(shells, ["cell", "shell"]).where("angle < low OR angle > high").count() == 0


def test_lexical_search_reads_the_texts_once(spark):
    """Lengths of all documents and postings of the asked terms come from one pass, also of empty, null and repeated documents."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [(1, "a b", "a a c"), (2, None, None), (3, "", "x y"), (4, "", "a z"), (4, "", "a z"), (4, "", "z z")]
    docs = spark.createDataFrame(rows, "doc long, title string, text string").cache()
    words = spark.createDataFrame([("a",), ("b",), ("q",)], "term string")
    matched, n, mean = R.asked_postings(docs.withColumn("text", seen("text")), words)
    size = R.corpus_size(docs).first()
    assert (n, mean, read.value) == (size["n"], size["avg_len"], len(rows))
    want = R.bm25_index(docs).join(words, "term", "left_semi").select("doc", "doc_len", "term", "tf").collect()
    assert sorted(matched.select("doc", "doc_len", "term", "tf").collect()) == sorted(want) and (1, 15.0, "a", 8.0) in [tuple(r) for r in want]
    R.bm25_search(docs.withColumn("text", seen("text")), words.select(F.xxhash64("term").alias("source"), F.col("term").alias("text")), 3).collect()
    assert read.value == 2 * len(rows)
    docs.unpersist()


def test_a_shell_holds_few_scores_at_once_and_ties_go_to_the_smaller_owner():
    """Ten thousand visitors of a whole block, all of one vector: k rows each, without a score of every pair."""
    n, k = 4096, 3
    visits = pa.RecordBatch.from_pydict(
        {"owner": pa.array(range(2, 10_002), pa.int64()), "vec": pa.array([[1.0, 2.0]] * 10_000, pa.list_(pa.float32())), "floor": [0.0] * 10_000}
    )
    shell = V.Shell(pa.table({"owner": pa.array(range(n, 0, -1), pa.int64()), "vec": pa.array([[1.0, 2.0]] * n, pa.list_(pa.float32()))}))
    tracemalloc.start()
    try:
        sizes, first = 0, []
        for source, candidate, _ in shell.best(visits, k):
            sizes += np.size(source)
            first = first or list(zip(source[:6].tolist(), candidate[:6].tolist()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert first == [(2, 1), (2, 3), (2, 4), (3, 1), (3, 2), (3, 4)] and sizes == 10_000 * k
    assert peak < 64 << 20


def test_vector_search_of_nothing(spark):
    none = spark.createDataFrame([], "owner bigint, window_index int, vec array<float>")
    one = spark.createDataFrame([(1, 0, [1.0, 2.0])], none.schema)
    assert V.vector_search(none, none.select("owner"), 3).count() == 0
    assert V.vector_search(one, one.select("owner"), 3).count() == 0


@pytest.mark.parametrize("n,want", [(0, [0]), (5, [5]), (10, [10]), (11, [10, 6]), (20, [10, 10, 10]), (21, [10, 10, 10, 6])])
def test_windows(spark, n, want):
    df = spark.createDataFrame([("d", ["w"] * n)], "doc string, w array<string>")
    got = R.token_windows(df, "doc", F.col("w"), 10, 5).orderBy("window_index").collect()
    assert [len(r["window"]) for r in got] == want


def test_popularity_leaves_the_query_out(spark):
    edges = edge_frame(spark, [("a", "x"), ("b", "x"), ("a", "y"), ("c", "z")])
    got = R.popularity(edges, spark.createDataFrame([("x",), ("a",)], "source string"), 2).collect()
    lists = {q: [r["candidate"] for r in sorted(got, key=lambda r: r["rank"]) if r["source"] == q] for q in ("x", "a")}
    assert lists == {"x": ["y", "z"], "a": ["x", "y"]}


def test_reachability_opens_hubs_only_against_hubs(spark):
    """A hub target that a third of all edges point to: its in-edges are not paired with its gold pairs."""
    n = 300
    edges = [(f"s{i}", "hub") for i in range(n)] + [(f"s{i}", f"a{i}") for i in range(n)] + [(f"a{i}", "hub") for i in range(n)]
    retained = spark.createDataFrame(edges, "source string, target string")
    gold = spark.createDataFrame([(f"s{i}", "hub") for i in range(n)] + [("s0", "nowhere"), ("lone", "hub")], "source string, target string")
    pairs = gold.distinct()
    low, high = R.opened(pairs, retained.select("source", F.col("target").alias("x")), retained.select(F.col("source").alias("x"), "target"))
    assert low.count() + high.count() <= 2 * n
    r = R.reachability(gold, retained).first()
    assert r["sources_measured"] == n + 1
    assert r["two_hop_fraction"] == pytest.approx(n / (n + 1))


@pytest.mark.parametrize("seed", range(2))
def test_reachability_against_brute_force(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"n{min(int(rng.expovariate(0.2)), 25)}"
    out = {(a, b) for a, b in ((name(), name()) for _ in range(160)) if a != b}
    gold = {(a, b) for a, b in ((name(), name()) for _ in range(40)) if a != b}
    got = R.reachability(spark.createDataFrame(sorted(gold), "source string, target string"), spark.createDataFrame(sorted(out), "source string, target string")).first()
    nodes = {x for e in out for x in e}
    two = {s for s, t in gold if any((s, x) in out and (x, t) in out for x in nodes)}
    cocite = {s for s, t in gold if any(x not in (s, t) and (s, x) in out and (t, x) in out for x in nodes)}
    citer = {s for s, t in gold if any(x not in (s, t) and (x, s) in out and (x, t) in out for x in nodes)}
    n = len({s for s, _ in gold})
    assert (got["two_hop_fraction"], got["co_citation_fraction"], got["common_citer_fraction"]) == pytest.approx((len(two) / n, len(cocite) / n, len(citer) / n))
    assert got["any_signal_fraction"] == pytest.approx(len(two | cocite | citer) / n)


@pytest.mark.parametrize("heavy", [0, 50, 10**9])
def test_two_edge_paths_through_hubs(spark, heavy):
    """A node on a third of all edges, repeated edges and loops; block products equal the join."""
    rng = random.Random(5)
    name = lambda: f"n{rng.randrange(60):02d}"
    edges = [(name(), name()) for _ in range(200)] + [(name(), "hub") for _ in range(50)] + [("hub", name()) for _ in range(50)]
    asked = sorted({s for s, _ in edges})[::2] + ["unknown"]
    want = Counter((s, c) for s, m in edges if s in asked for a, c in edges if a == m and c != s)
    df = spark.createDataFrame(edges, "source string, target string")
    got = paths.two_edge_paths(df, spark.createDataFrame([(s,) for s in asked], "source string"), heavy, 7, 5)
    assert {(r["source"], r["candidate"]): r["paths"] for r in got.collect()} == want


def test_a_hub_hands_on_one_row_per_pair(spark):
    """Many middle nodes between the same ends: rows are pairs, not paths."""
    first = [(f"s{i}", f"m{j}", 1) for i in range(12) for j in range(40)]
    second = [(f"m{j}", f"c{i}", 1) for i in range(9) for j in range(40)]
    rows = paths.heavy_paths(
        spark.createDataFrame(first, "source string, mid string, n long"), spark.createDataFrame(second, "mid string, candidate string, n long"), 5, 8
    ).collect()
    assert len(rows) == 12 * 9 and {r["paths"] for r in rows} == {40}
