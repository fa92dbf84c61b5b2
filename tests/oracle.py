"""Run registered queries against DuckDB: ``python tests/oracle.py [names] [--sf 0.01]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return ("n", None)
        # -0.0 and 0.0 are the same value.
        return ("f", float(value) + 0.0)
    if isinstance(value, (list, tuple)):
        return ("l", tuple(plain(v) for v in value))
    return ("n", None) if value is None else ("s", str(value))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def compare(got, want) -> str | None:
    """None when equal, else what differs."""
    (gc, gr), (wc, wr) = got, want
    if gc != wc:
        return f"columns {gc} != {wc}"
    if len(gr) != len(wr):
        return f"rows {len(gr)} != {len(wr)}"
    for a, b in zip(gr, wr):
        if a != b:
            return f"first difference {a} != {b}"
    return None


def main(argv: list[str]) -> int:
    from eventloom.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
        except Exception as error:  # report and go on
            bad += 1
            print(f"FAIL {name}: {str(error)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in sqls:
            print(f"rows {name} {len(rows)} rows {took:.1f}s {rows[:2]}"[:300], flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            want = normal([d[0] for d in cur.description], cur.fetchall())
        except Exception as error:
            bad += 1
            print(f"FAIL {name} oracle: {str(error)[:400]}", flush=True)
            continue
        problem = compare(normal(df.columns, rows), want)
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {len(rows)} rows {took:.1f}s {problem or ''}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
