"""Small tables with the awkward cases every operator has to take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "the quick brown fox jumps over the lazy dog and runs away again " * 800
SHARED = "This line is long enough to be a key of forty points at least."


def awkward(spark, extra: bool = False):
    """Nulls, empties, a long text, repeated rows, ties and shared lines."""
    rows = [
        (1, "a b c d e f g h", "en", "s", 15),
        (2, "a b  c d e f\tg h", "en", "s", 16),
        (2, "a b  c d e f\tg h", "en", "s", 16),
        (3, "", None, None, None),
        (4, None, "en", None, None),
        (5, " \n\t ", "en", "s", 4),
        (6, LONG, "en", "s", len(LONG)),
        (7, LONG + "x", "en", "s", len(LONG) + 1),
        (None, "a row without an id", "en", "s", 19),
        (8, "Ünïcode ÄÖÜ ß 😀 ▁ \x00 zero", "de", "s", 20),
        *[(20 + i, f"{SHARED}\nown line {i}\n  {SHARED.upper()} ", "en", "hot", 90) for i in range(6)],
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("digest", "norm", "key", "n", "rep", "cluster", "score", "ids", "salt", "batch", "_stay", "_id"):
            df = df.withColumn(name, df["source"])
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))
