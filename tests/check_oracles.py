"""Compare queries with their SQL: ``python tests/check_oracles.py [folder] [names...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
# Spark type -> DuckDB type the SQL should give.
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}


def open_oracle(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def rows_of(frame, columns):
    """Rows with columns by name, in a comparable form and order."""
    import datetime as dt
    import math

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, dt.datetime):
            return v.isoformat()
        if isinstance(v, float):
            return repr(v)
        return str(v)

    return sorted(tuple(plain(r[c]) for c in columns) for r in frame)


def compare(spark, con, name, folder):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    started = time.time()
    mine = rows_of([r.asDict() for r in df.collect()], columns)
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(mine), took, []
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns, f"{name}: {sorted(names)} vs {columns}"
    kinds = {n: str(d[1]) for n, d in zip(names, result.description)}
    for field in df.schema.fields:
        want = KINDS.get(field.dataType.simpleString())
        assert want is None or want == kinds[field.name], (
            f"{name}.{field.name}: {field.dataType.simpleString()} vs {kinds[field.name]}"
        )
    theirs = rows_of([dict(zip(names, r)) for r in result.fetchall()], columns)
    diff = []
    if mine != theirs:
        a, b = set(mine), set(theirs)
        diff = [("spark", r) for r in sorted(a - b)[:2]] + [("sql", r) for r in sorted(b - a)[:2]]
        diff.append(("counts", len(mine), len(theirs), len(a - b), len(b - a)))
    return mine == theirs, len(mine), took, diff


if __name__ == "__main__":
    from rostrum.session import build_session
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("oracles", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = open_oracle(folder)
    bad = 0
    for name in names:
        try:
            ok, n, took, diff = compare(spark, con, name, folder)
        except Exception as e:  # report and go on to the next query
            ok, n, took, diff = False, -1, 0.0, [str(e)[:1500]]
        bad += ok is False
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'BAD '} {name:24} {n:7} {took:6.2f}s", flush=True)
        for d in diff:
            print("     ", str(d)[:600])
    print("bad:", bad)
