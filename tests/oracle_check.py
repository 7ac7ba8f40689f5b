"""Compare every bound query with its DuckDB twin: python tests/oracle_check.py [dir] [names…]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty text when columns, row count and all values agree."""
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main():
    from conftest import make_session

    from verdara.plans.oracle import all_sql
    from verdara.plans.queries import all_queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(sys.argv[2:])
    spark, con, sql = make_session(), duck(sf_dir), all_sql()
    failed = 0
    for name, fn in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            note = compare(df, con, sql[name]) if name in sql else f"rows only: {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(note) and not note.startswith("rows only")
        print(f"{time.time() - start:6.2f}s {name:22s} {note or 'ok'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
