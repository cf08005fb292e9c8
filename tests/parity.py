"""Run a registered query in Spark and its SQL in DuckDB and compare the rows.

    python tests/parity.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DATA = "/root/testdata/sf"


def oracle_connection(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, plan, sql):
    start = time.time()
    df = plan(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if sql is None:
        return False, f"no SQL; {len(left[1])} rows", seconds
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = rows_of(names, result.fetchall())
    if left[0] != right[0]:
        return False, f"columns {left[0]} != {right[0]}", seconds
    if left[1] != right[1]:
        only_left = [r for r in left[1] if r not in set(right[1])][:3]
        only_right = [r for r in right[1] if r not in set(left[1])][:3]
        return False, f"{len(left[1])} vs {len(right[1])} rows; spark {only_left} duckdb {only_right}", seconds
    return True, f"{len(left[1])} rows", seconds


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "0.001"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at:at + 2]
    import __spark_entry__ as entry
    from lexmesh.session import local_session

    spark = local_session(8)
    folder = DATA + sf
    con = oracle_connection(folder)
    plans, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in plans if not args or any(n.startswith(a) for a in args)]
    bad = 0
    for name in names:
        try:
            ok, note, seconds = compare(spark, con, folder, plans[name], oracles.get(name))
        except Exception as error:  # report and go on with the next query
            ok, note, seconds = False, f"{type(error).__name__}: {str(error)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} {seconds:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
