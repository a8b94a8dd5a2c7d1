"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when both results are equal, else a short account of the difference."""
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    types = {d[0]: str(d[1]).upper() for d in want.description}
    expected = want.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    spark_types = {"bigint": "NUMBER BIGINT", "double": "NUMBER DOUBLE", "string": "STRING VARCHAR",
                   "boolean": "BOOL BOOLEAN"}
    for name, kind in df.dtypes:
        if kind in spark_types and types[name] not in spark_types[kind].split() and not (
                kind == "boolean" and "BOOL" in types[name]):
            return f"type of {name}: {kind} vs {types[name]}"
    got = _rows(df.columns, df.collect())
    expected = _rows(columns, expected)
    if len(got) != len(expected):
        return f"{len(got)} rows vs {len(expected)}"
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ ({sorted(columns)}), e.g. {wrong[0]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from sunledger.session import build_session
    folder = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = duck(folder), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problem = compare(df, con, oracles[name]) if name in oracles else (
                None if df.count() > 0 else "no rows")
        except Exception as error:  # shown with the query that raised it
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok':5}{name:34}{kind:5}{time.time() - start:6.2f}s"
              f" {problem or ''}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
