import math
import random
import struct
from fractions import Fraction

from pyspark.sql import functions as F

from assay.llm import bit_sliced

SCHEMA = "vec_id long, embedding array<float>, vec string, score int"


def brute(rows, k):
    ok = [
        (i, [math.floor(1024 * Fraction(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in ok:
        if q % 5:
            continue
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def test_matches_brute_force_with_ties_and_bad_vectors(spark):
    draw = random.Random(5)
    vector = lambda: [draw.randrange(-64, 64) / 32 for _ in range(7)]
    same = vector()
    rows = [(i, vector()) for i in range(300)] + [(1000 + i, same) for i in range(200)]
    rows += [(2000, None), (2005, []), (2010, [1.0, None] + [0.0] * 5), (2015, [float("nan")] * 7)]
    rows += [(2020, [float("inf")] + [0.0] * 6), (None, vector()), (2025, [1.0, -2.0]), (2030, [0.0] * 7)]
    for span, chunk in ((4096, 8192), (50, 20)):
        got = bit_sliced.top_rows(table(spark, rows), F.col("vec_id") % 5 == 0, 4, span_rows=span, chunk_queries=chunk)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4)


def test_fewer_rows_than_k_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (5, [2.0, -1.0]), (6, [0.5, 0.5])]
    got = bit_sliced.top_rows(table(spark, rows), F.col("vec_id") % 5 == 0, 10)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)
    assert bit_sliced.top_rows(table(spark, []), F.col("vec_id") % 5 == 0, 10).count() == 0


def test_components_of_any_finite_size_are_ranked_exactly(spark):
    draw = random.Random(7)
    plain = [(i, [draw.randrange(-64, 64) / 32 for _ in range(5)]) for i in range(120)]
    large = [(200, [300000.0] * 5), (201, [300000.0, -300000.0, 0.5, 1.0, 2.0]), (205, [-3.0e5] * 5)]
    huge = [(300, [1e30, 1.0, 0.0, 0.0, -1e30]), (301, [1.5e30, 0.0, 0.0, 0.0, 1.0]), (305, [-3e38] * 5), (310, [3e38] * 5)]
    as_float = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in plain + large + huge]
    for span, chunk in ((4096, 8192), (20, 10)):
        got = bit_sliced.top_rows(table(spark, as_float), F.col("vec_id") % 5 == 0, 6, span_rows=span, chunk_queries=chunk)
        assert sorted(tuple(r) for r in got.collect()) == brute(as_float, 6)


def test_doubles_of_the_largest_size(spark):
    rows = [(0, [1e308, -1e308]), (1, [1.7e308, 1.0]), (5, [1e300, 1e-300]), (6, [-1.0, 2.0]), (7, [9e15 + 1, 0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bit_sliced.top_rows(frame, F.col("vec_id") % 5 == 0, 3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3)
