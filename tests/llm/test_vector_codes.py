import hashlib
import math
import random

import numpy as np
import pytest

from assay.llm import vector_codes as V
from assay.llm.queries import vector_digests

SCHEMA = "vec_id long, embedding array<double>, label int, v int, far string, codes int, error string"


def brute(rows, parts=4, entries=256, rounds=4):
    ok = [
        (i, label, [math.floor(1024 * x) for x in v])
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max(1, -(-max((len(v) for *_, v in ok), default=0) // parts))
    ok = [(i, label, v + [0] * (width * parts - len(v))) for i, label, v in ok]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[v[k * width : (k + 1) * width] for k in range(parts)] for *_, v in ok]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(c[k], books[k])[1], []).append(c[k])
            books[k] = [
                [sum(col) // len(members[n]) for col in zip(*members[n])] if n in members else e for n, e in enumerate(books[k])
            ]
    found = [[near(c[k], books[k]) for k in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, label, _), e in zip(ok, errors):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (i, "".join(f"{n:02x}" for _, n in f), e, by_label[label], sha)
        for (i, label, _), f, e in zip(ok, found, errors)
    ]


def digests(spark, rows):
    table = spark.createDataFrame([(i, v, label, 1, "clash", 2, "clash") for i, v, label in rows], SCHEMA)
    got = vector_digests(table.repartition(5)).collect()
    return [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) if x is None or isinstance(x, int) else (False, x) for x in r))


def made(n, dims=8, seed=1, scale=1.0):
    draw = random.Random(seed)
    return [(i, [draw.uniform(-1, 1) * scale for _ in range(dims)], draw.choice([0, 1, None])) for i in range(n)]


def test_matches_brute_force(spark):
    rows = made(600)
    rows += [(1000 + i, rows[3][1], 1) for i in range(300)] + [rows[5], rows[300], (3, rows[9][1], 0)]
    rows += [(2000, None, 1), (2001, [1.0, None], 0), (2002, [math.nan], 0), (2003, [math.inf], 0)]
    rows += [(2004, [], None), (2005, [0.5], None), (None, [0.25] * 8, 0)]
    assert order(digests(spark, rows)) == order(brute(rows))


def test_dimension_that_cannot_be_cut_evenly_and_few_rows(spark):
    rows = made(40, dims=7)
    assert order(digests(spark, rows)) == order(brute(rows))


@pytest.mark.parametrize("scale", [1e6, 3e8])
def test_large_components(spark, scale):
    rows = made(300, scale=1e3) + [(1000, [scale] * 8, 1), (1001, [-scale, *[scale] * 7], 0)]
    want = brute(rows)
    if all(max(r[2], r[3]) < 2**63 for r in want):
        assert order(digests(spark, rows)) == order(want)
    else:
        with pytest.raises(Exception, match="(?i)int|large|overflow"):
            digests(spark, rows)


def test_huge_component_of_its_own_entry(spark):
    """A vector far away becomes an entry of its own: everything fits, though squares of it do not."""
    rows = made(300) + [(-1, [1e25] * 8, 1)]
    assert order(digests(spark, rows)) == order(brute(rows))


def test_empty(spark):
    assert digests(spark, []) == []
    assert digests(spark, [(1, None, 1)]) == []


def test_pivots_prune_and_lose_nothing():
    draw = np.random.default_rng(2)
    middles = draw.integers(-4000, 4000, (256, 16))
    rows = (middles[draw.integers(0, 256, 3000)] + draw.integers(-200, 200, (3000, 16))).astype(np.int64)
    book = V.Book(middles.astype(np.int64), middles[V.far_apart(middles, V.PIVOTS)].astype(np.int64))
    counted = []
    place, best = V.nearest(rows, V.distances(rows, book.pivots), book, counted)
    exact = ((rows[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (place == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert sum(counted) < 0.2 * exact.size
    assert (V.bounds(V.distances(rows, book.pivots), book) <= np.sqrt(exact)).all()


def test_limbs_come_back():
    for x in (0, 1, -1, 2**62, -(2**70) + 5, 10**30):
        assert sum(v << (V.LIMB * n) for n, v in enumerate(V.limbs(x, 6))) == x
