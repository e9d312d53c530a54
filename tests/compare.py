"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, (int, str)):
        return value
    return float(value) if hasattr(value, "as_tuple") else value


def compare(spark, con, name, function, sql, sf_dir):
    """``(ok, message)`` for one query."""
    started = time.time()
    result = function(spark, sf_dir)
    columns = sorted(result.columns)
    rows = [tuple(normal(row[c]) for c in columns) for row in result.collect()]
    spark_time = time.time() - started
    if sql is None:
        return True, f"{len(rows)} rows, {spark_time:.1f}s, no SQL"
    started = time.time()
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    raw = cursor.fetchall()
    check_time = time.time() - started
    if sorted(found) != columns:
        return False, f"columns {columns} against {sorted(found)}"
    at = [found.index(c) for c in columns]
    expected = [tuple(normal(row[i]) for i in at) for row in raw]
    message = f"{len(rows)} rows, spark {spark_time:.1f}s, sql {check_time:.1f}s"
    key = lambda row: tuple((v is not None, str(type(v)), str(v)) for v in row)
    rows.sort(key=key)
    expected.sort(key=key)
    if rows != expected:
        missing = set(expected) - set(rows)
        extra = set(rows) - set(expected)
        sample = lambda s: sorted(s, key=key)[:2]
        return False, (
            f"{message}; expected {len(expected)}; missing {len(missing)} {str(sample(missing))[:600]}"
            f" extra {len(extra)} {str(sample(extra))[:600]} columns {columns}"
        )
    return True, message


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from attestry.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = connection(sf_dir)
    failed = []
    checks = oracle_sql()
    for name, function in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, name, function, checks.get(name), sf_dir)
        except Exception as problem:  # noqa: BLE001
            ok, message = False, f"{type(problem).__name__}: {str(problem)[:1500]}"
        print(("ok   " if ok else "FAIL ") + name, message, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
