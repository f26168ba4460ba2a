"""Run registered queries next to their DuckDB checks and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0 if value else 0.0)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return repr(value)


def canonical(arrow):
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    rows = sorted(tuple(plain(v) for v in row) for row in zip(*columns))
    types = {n: str(arrow.schema.field(n).type) for n in names}
    return names, types, rows


def loose(kind: str) -> str:
    kind = kind.replace("large_string", "string").replace("string_view", "string")
    if kind.startswith("timestamp"):
        return "timestamp"
    return kind


def compare(spark, con, fn, sql, sf_dir):
    """Return (problem or None, rows, spark seconds)."""
    started = time.time()
    left = fn(spark, sf_dir).toArrow()
    seconds = time.time() - started
    if sql is None:
        return None, left.num_rows, seconds
    right = con.execute(sql).to_arrow_table()
    names_l, types_l, rows_l = canonical(left)
    names_r, types_r, rows_r = canonical(right)
    if names_l != names_r:
        return f"columns {names_l} != {names_r}", len(rows_l), seconds
    bad = {
        n: (types_l[n], types_r[n])
        for n in names_l
        if loose(types_l[n]) != loose(types_r[n]) and "list" not in types_l[n]
    }
    if bad:
        return f"types {bad}", len(rows_l), seconds
    if len(rows_l) != len(rows_r):
        return f"rows {len(rows_l)} != {len(rows_r)}\n  {rows_l[:3]}\n  {rows_r[:3]}", len(rows_l), seconds
    if rows_l != rows_r:
        diff = [(a, b) for a, b in zip(rows_l, rows_r) if a != b][:3]
        return f"values differ in {len(diff)}+ rows: {names_l} {diff}", len(rows_l), seconds
    return None, len(rows_l), seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tablelens.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session("8")
    con = connect(sf)
    checks = entry.oracle_sql()
    failed = 0
    for key, fn in entry.queries().items():
        if wanted and not any(w == key or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        try:
            problem, rows, seconds = compare(spark, con, fn, checks.get(key), sf)
        except Exception as error:  # report and go on with the next query
            lines = str(error).splitlines()
            problem, rows, seconds = f"{type(error).__name__}: " + " | ".join(lines[:6])[:1500], -1, 0
        failed += problem is not None
        kind = "ok " if checks.get(key) else "run"
        print(f"{kind if problem is None else 'BAD'} {key:24s} rows={rows} {seconds:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
