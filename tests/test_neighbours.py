"""Graph scores and signals from adjacency lists against brute force."""

import random
from collections import Counter

import pytest

from assay.operators import neighbours as N
from assay.operators import retrieval as R


def graph(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = [(f"p{rng.randrange(nodes)}", f"p{min(rng.randrange(nodes), rng.randrange(nodes))}") for _ in range(n)]
    edges += edges[:5] + [("p0", f"p{i}") for i in range(nodes)]  # repeated edges, a hub source with a loop
    return edges, spark.createDataFrame(edges, "source string, target string")


def best(edges, sources, k):
    out = {}
    for s, t in edges:
        out.setdefault(s, []).append(t)
    found = {}
    for s in sources:
        score = Counter(out.get(s, []))
        for m in out.get(s, []):
            score.update(out.get(m, []))
        score.pop(s, None)
        found[s] = sorted(score.items(), key=lambda p: (-p[1], p[0]))[:k]
    return found


@pytest.mark.parametrize("heavy,wide,pack,block", [(10**6, 10**4, 256, 10**6), (60, 10**4, 3, 20), (10**6, 12, 2, 50), (60, 12, 3, 1)])
def test_best_neighbours_and_ranks_against_brute_force(spark, heavy, wide, pack, block):
    edges, df = graph(spark, 5, 40, 300)
    sources = [f"p{i}" for i in range(0, 40, 2)] + ["absent"]
    table = spark.createDataFrame([(s,) for s in sources], "source string")
    want = best(edges, sources, 7)
    got = N.best_neighbours(df, table, 7, heavy, wide, pack, block).collect()
    assert sorted(map(tuple, got)) == sorted((s, c, float(n), i + 1) for s, l in want.items() for i, (c, n) in enumerate(l))
    pairs = [(s, f"p{t}") for s in sources for t in range(0, 40, 3)]
    asked = spark.createDataFrame(pairs + pairs[:3], "source string, target string")
    ranks = {(r.source, r.target): (r["rank"], r.returned) for r in N.ranks_of(asked, df, table, 7, heavy, wide, pack, block).collect()}
    names = {s: [c for c, _ in l] for s, l in want.items()}
    assert ranks == {(s, t): (names[s].index(t) + 1 if t in names[s] else None, len(names[s])) for s, t in pairs}


def test_graph_search_shuffles_no_row_per_path(spark):
    edges = [(f"s{i}", f"m{j}") for i in range(60) for j in range(20)] + [(f"m{j}", f"t{k}") for j in range(20) for k in range(60)]
    df = spark.createDataFrame(edges, "source string, target string")
    sources = spark.createDataFrame([(f"s{i}",) for i in range(60)], "source string")
    store = spark._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    assert R.graph_search(df, sources, 5).count() == 300
    assert shuffled() - before < 60 * 20 * 60 / 2  # 72000 paths


@pytest.mark.parametrize("listed", [1000, 30, 0])
def test_reachability_from_lists_against_brute_force(spark, listed):
    edges, df = graph(spark, 8, 40, 160)
    gold = [(f"p{i}", f"p{(7 * i + 3) % 40}") for i in range(1, 40)]
    out, into = ({a: {e[1 - i] for e in edges if e[i] == a} for a in [f"p{n}" for n in range(40)]} for i in (0, 1))
    flags = [
        (bool(out[s] & into[t]), bool((out[s] & out[t]) - {s, t}), bool((into[s] & into[t]) - {s, t})) for s, t in gold
    ]
    row = R.reachability(spark.createDataFrame(gold, "source string, target string"), df, listed).first()
    shares = [sum(f[i] for f in flags) / len(flags) for i in range(3)] + [sum(any(f) for f in flags) / len(flags)]
    assert list(row)[0] == 39 and list(row)[1:] == pytest.approx(shares)


def test_popularity_ranks_read_off_the_list(spark):
    edges, df = graph(spark, 3, 30, 200)
    sources = spark.createDataFrame([(f"p{i}",) for i in range(30)], "source string")
    gold = spark.createDataFrame([(f"p{i}", f"p{j}") for i in range(30) for j in range(30) if i != j], "source string, target string")
    listed = {(r.source, r.candidate): r["rank"] for r in R.popularity(df, sources, 6).collect()}
    for r in R.popularity_ranks(gold, df, 6).collect():
        assert (r["rank"], r.returned) == (listed.get((r.source, r.target)), 6)


def test_holdout_is_the_same_with_and_without_hubs(spark):
    edges, df = graph(spark, 9, 40, 300)
    found = []
    for hub in (10**4, 8, 0):
        final, sources = R.edge_holdout(df, 11, hub=hub)
        found.append((sorted(map(tuple, final.collect())), sorted(map(tuple, sources.collect()))))
    assert found[0] == found[1] == found[2]
    held = {(s, t) for s, t, h in found[0][0] if h}
    retained = {(s, t) for s, t, h in found[0][0] if not h}
    assert held | retained == {e for e in edges if e[0] != e[1]} and not {(t, s) for s, t in held} & retained
