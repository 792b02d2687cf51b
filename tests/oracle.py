"""Run registered queries against their SQL twins: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", "") for v in r))


def compare(con, sql: str, frame) -> str:
    """Empty string when equal, else the first difference."""
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    expected = sorted_rows(names, done.fetchall())
    got = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    if len(expected) != len(got):
        return f"{len(got)} rows, expected {len(expected)}"
    for mine, theirs in zip(got, expected):
        if mine != theirs:
            return f"{mine} vs {theirs}"
    if not got:
        return "no rows"
    return ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from vektorloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    twins = oracle_sql()
    failed = []
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            if name in twins:
                problem = compare(con, twins[name], frame)
                text = "ok" if not problem else f"DIFF {problem[:300]}"
            else:
                problem = "" if (n := frame.count()) else "no rows"
                text = f"rows only: {n}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = text = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        if problem:
            failed.append(name)
        print(f"{name:24s} {time.time() - start:6.2f}s {text}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
