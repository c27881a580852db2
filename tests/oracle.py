"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", float(value))
    if isinstance(value, datetime.datetime):
        return ("ts", value.replace(tzinfo=None).isoformat())
    if isinstance(value, float):
        return ("float", value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return (type(value).__name__, value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in records]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, folder) -> tuple[str, float]:
    from brightrow.suite import QUERIES, SQL

    began = time.time()
    df = QUERIES[name](spark, folder)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if name not in SQL:
        return f"rows only ({len(got)})", took
    result = con.execute(SQL[name])
    want_names, want = rows([c[0] for c in result.description], result.fetchall())
    if got_names != want_names:
        return f"COLUMNS {got_names} <> {want_names}", took
    if len(got) != len(want):
        return f"ROWS {len(got)} <> {len(want)}", took
    if got == want:
        return f"same ({len(got)})", took
    differing = [(g, w) for g, w in zip(got, want) if g != w]
    cells = [(n, a, b) for n, a, b in zip(got_names, *differing[0]) if a != b]
    return f"VALUES differ in {len(differing)} of {len(got)} rows, e.g. {cells}"[:700], took


def main() -> None:
    from brightrow.session import local_session
    from brightrow.suite import QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("8"), connection(folder)
    chosen = [n for n in QUERIES if not sys.argv[2:] or any(w in n for w in sys.argv[2:])]
    bad = []
    for name in chosen:
        try:
            verdict, took = compare(spark, con, name, folder)
        except Exception as error:
            verdict, took = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0
        if not verdict.startswith(("same", "rows only")):
            bad.append(name)
        print(f"{name:34s} {took:6.2f}s  {verdict}", flush=True)
    print(f"{len(chosen)} queries, {len(bad)} wrong: {bad}")


if __name__ == "__main__":
    main()
