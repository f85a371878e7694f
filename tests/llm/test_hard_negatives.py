import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, score int, place string"


def brute(rows, positives=5, negatives=5):
    ok = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = {}
    for i, label, v in ok:
        if i % 5 == 0:
            first[i] = min(first.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in first.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, own, w in ok)
        for p, i, _ in [s for s in scored if s[2] == label and s[1] != a][:positives]:
            inside = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(i, v, label, 1, "clash") for i, v, label in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mined(table, F.col("vec_id") % 5 == 0, F.col("label"), **more).collect())


def made(n, seed=3, dims=6, scale=1.0):
    draw = random.Random(seed)
    return [(i, [draw.uniform(-1, 1) * scale for _ in range(dims)], draw.randrange(3)) for i in range(n)]


def test_matches_brute_force_with_ties_repeats_and_bad_rows(spark):
    rows = made(200)
    hot = rows[7][1]
    rows += [(1000 + i, hot, i % 3) for i in range(120)] + [rows[5], rows[10], (10, hot, 2)]
    rows += [(2000, None, 1), (2005, [], 1), (2010, [1.0, None], 1), (2015, [math.nan], 1), (2020, [math.inf], 1)]
    rows += [(2025, [0.5] * 6, None), (None, hot, 1), (2030, [1.0, -1.0], 0), (2035, [0.0] * 6, 0), (2036, [], 2)]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, span_rows=40, chunk_anchors=9) == want


@pytest.mark.parametrize("scale", [3e5, 1e9, 1e30])
def test_large_components(spark, scale):
    """Blocks beyond 64 bits, and scores that do not fit a long fail only when they are returned."""
    rows = made(60, seed=9) + [(1001, [scale] * 6, 0), (1002, [-scale] * 6, 1)]
    want = brute(rows)
    top = max(max(abs(r[4]), abs(r[5])) for r in want)
    if top < 2**63:
        assert mined(spark, rows) == want
    else:
        with pytest.raises(Exception, match="(?i)int|large|overflow"):
            mined(spark, rows)


def test_wide_scores_that_fit(spark):
    """The bound passes 64 bits, no returned score does."""
    rows = made(60, seed=9) + [(1001, [1e12] + [0.0] * 6, 0), (1002, [1e12] + [0.0] * 6, 7)]
    rows = [(i, [0.0, *v[:6]] if i < 1000 else v, label) for i, v, label in rows]
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


@pytest.mark.parametrize("top", [1, 300, 10**6, 10**12, 10**25])
def test_remainders_give_exact_scores(top):
    draw = np.random.default_rng(1)
    a = np.floor(draw.uniform(-top, top, (5, 70)))
    b = np.floor(draw.uniform(-top, top, (9, 70)))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    got = H.exact_scores(H.Residues(a), slice(0, 5), H.Residues(b))
    assert [[int(x) for x in r] for r in got] == want


def test_partial_sums_stay_exact():
    """No slice of components can pass 2**24 in float32, whatever the prime."""
    for p in H.primes():
        step = max(1, (H.EXACT_FLOAT32 - 1) // max(1, (p // 2) ** 2))
        assert step * (p // 2) ** 2 < H.EXACT_FLOAT32
        r = np.full((1, 3 * step + 1), p // 2, np.float32)
        assert H.modular_product(r, r, p)[0, 0] == (3 * step + 1) * (p // 2) ** 2 % p
