"""Compare every registered query with its SQL: ``python tests/check_oracle.py <sf_dir> [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tests.session import make_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(r[i] for i in order) for r in rows], key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def check(spark, con, name, sf_dir):
    """None when equal, else what differs."""
    result = con.execute(E.oracle_sql()[name])
    want = rows_of([c[0] for c in result.description], result.fetchall())
    df = E.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(E.oracle_sql())
    spark, con, bad = make_session(), duck(sf_dir), 0
    for name in names:
        started = time.time()
        try:
            problem = check(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    sys.exit(bad > 0)
