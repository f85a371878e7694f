"""Run registered queries beside their SQL twins: ``python tests/parity.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(value):
    return (value is None, str(type(value)), "" if value is None else str(value))


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return type(a) is type(b) and a == b
    return type(a) is type(b) and a == b


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else the first difference."""
    cols = sorted(df.columns)
    left = [tuple(normal(r[c]) for c in cols) for r in df.collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    spot = [rel.columns.index(c) for c in cols]
    right = [tuple(normal(r[i]) for i in spot) for r in rel.fetchall()]
    if len(left) != len(right):
        return f"{len(left)} vs {len(right)} rows; {left[:2]} vs {right[:2]}"
    order = lambda row: tuple(_key(v) for v in row)
    wrong = [
        (a, b)
        for a, b in zip(sorted(left, key=order), sorted(right, key=order))
        if not all(same(x, y) for x, y in zip(a, b))
    ]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, columns {cols}: {wrong[:3]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from assay.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                verdict = compare(df, con, oracle[name])
                rows = ""
            else:
                verdict, rows = None, f" rows={df.count()} (no SQL twin)"
        except Exception as exc:  # report every query, then fail
            verdict = f"{type(exc).__name__}: {str(exc)[:1200]}"
            rows = ""
            if "-v" in args:
                traceback.print_exc()
        failed += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '} {name} {time.time() - start:.2f}s{rows} {verdict or ''}", flush=True)
        spark.catalog.clearCache()
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
