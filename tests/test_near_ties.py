"""Lexical scores that are equal but for their last bits rank as in SQL."""

import random

import duckdb

from assay.plans import load_entries


def test_near_ties_rank_as_in_sql(spark, tmp_path):
    """Documents of one length that hold other words equally often: only the rounding parts their scores."""
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(12)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    rows = []
    for i in range(600):
        own = rng.sample(words, 5)
        text = " ".join(w for w, n in zip(own, (1, 2, 3, 4, 5), strict=True) for _ in range(n))
        rows.append((i, text, "en", "web", len(text)))
    rows += [(600 + i, "other words only", "en", "web", 16) for i in range(900)]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [(i, " ".join(rng.sample(words, 9))) for i in range(20)])
    for t in ("documents", "benchmark"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    entry = load_entries()["bm25_search"]
    want = con.sql(f"SELECT source, candidate, score, rank FROM ({entry.sql}) ORDER BY source, rank").fetchall()
    got = [tuple(r) for r in entry.run(spark, str(tmp_path)).select("source", "candidate", "score", "rank").orderBy("source", "rank").collect()]
    assert len(want) == 2000 and got == want
