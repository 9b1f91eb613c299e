"""Compare registered queries with their SQL on a data folder.

    python -m tests.oracle_check /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            files = path / "*.parquet" if path.is_dir() else path
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def kind(value: object) -> str:
    for name, types in (
        ("bool", bool),
        ("int", int),
        ("float", float),
        ("decimal", Decimal),
        ("datetime", datetime),
        ("date", date),
        ("str", str),
    ):
        if isinstance(value, types):
            return name
    return type(value).__name__


def sort_key(row: tuple) -> tuple:
    return tuple((v is None, kind(v), v if v is not None and v == v else "") for v in row)


def same(left: object, right: object) -> bool:
    if isinstance(left, float) and isinstance(right, float) and math.isnan(left):
        return math.isnan(right)
    return kind(left) == kind(right) and left == right


def differences(ours: tuple[list[str], list[tuple]], theirs: tuple[list[str], list[tuple]]) -> list[str]:
    """Exact comparison without regard to row or column order."""
    if sorted(ours[0]) != sorted(theirs[0]):
        return [f"columns {sorted(ours[0])} against {sorted(theirs[0])}"]
    if len(ours[1]) != len(theirs[1]):
        return [f"{len(ours[1])} rows against {len(theirs[1])}"]

    def ordered(names: list[str], rows: list[tuple]) -> list[tuple]:
        places = [names.index(n) for n in sorted(names)]
        return sorted((tuple(r[i] for i in places) for r in rows), key=sort_key)

    bad = [
        f"{a} against {b}"
        for a, b in zip(ordered(*ours), ordered(*theirs))
        if not all(same(x, y) for x, y in zip(a, b))
    ]
    return bad


def run_spark(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def run_duckdb(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as driver
    from mercadia.session import local_session

    spark, con = local_session(), connect(sf_dir)
    sql, failed = driver.oracle_sql(), 0
    for name, query in driver.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ours = run_spark(query(spark, sf_dir))
        except Exception as error:  # report and go on with the next query
            failed += 1
            print(f"FAIL {name}: {str(error)[:1500]}")
            continue
        took = time.time() - start
        if name not in sql:
            print(f"rows {name}: {len(ours[1])} rows, {took:.2f}s")
            continue
        try:
            bad = differences(ours, run_duckdb(con, sql[name]))
        except Exception as error:
            bad = [str(error)[:800]]
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name}: {len(ours[1])} rows, {took:.2f}s", *bad[:3], sep="\n     ")
    print("unknown SQL:", set(sql) - set(driver.queries()), "failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
