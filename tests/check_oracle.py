"""Compare every query with its SQL at one scale: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from muster.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES.split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(frame, columns):
    """Rows as sorted text, columns in name order, nulls and floats written one way."""

    def cell(v):
        if pd.isna(v):
            return "∅"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 6))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def compare(spark, con, sf_dir, name):
    """Problem text, or None where both give the same rows."""
    sql = entry.oracle_sql().get(name)
    result = entry.queries()[name](spark, sf_dir)
    got = result.toPandas()
    if sql is None:
        return None if len(got) else "no rows"
    want = con.sql(sql).df()
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} / {sorted(want.columns)}"
    a, b = canonical(got, columns), canonical(want, columns)
    if a == b:
        return None if a else "no rows"
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{columns}\n   rows {len(a)} / {len(b)}\n   got  {only_a}\n   want {only_b}"


def main(argv):
    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            traceback.print_exc(limit=-3)
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main(sys.argv[1:])
