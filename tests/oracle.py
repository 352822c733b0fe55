"""Compare queries with their SQL in DuckDB: ``python -m tests.oracle [FOLDER] [NAME...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if __import__('os').path.isdir(f'{folder}/{t}.parquet') else ''}')")
    return con


def plain(value):
    """A value that both engines give alike: numbers to six digits, whole ones as whole."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()[:26] if hasattr(value, "hour") else value.isoformat()
    return value


def rows(columns: list[str], found) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(spark, con, query, sql: str, folder: str) -> str:
    """What differs, or an empty string."""
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:1]} {want[:1]}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} of {len(got)} rows: {wrong[0]}" if wrong else "" if got else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, con, queries, bad = session(), connection(folder), entry.queries(), 0
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        began = time.time()
        try:
            said = difference(spark, con, queries[name], sql, folder)
        except Exception as e:  # noqa: BLE001  told, and counted as wrong
            said = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(said)
        if said or time.time() - began > 5:
            print(f"{name} ({time.time() - began:.1f} s): {said or 'same'}", flush=True)
    print(f"{bad} differ of {len(entry.oracle_sql())}")


if __name__ == "__main__":
    main()
