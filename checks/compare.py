"""Run queries and their SQL side by side: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.queries import ORACLE, QUERIES


def session(cpus: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    ordered = frame[sorted(frame.columns)]
    return ordered.sort_values(list(ordered.columns), na_position="first").reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when the frames hold the same rows; a short reason otherwise."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = canonical(left), canonical(right)
    for name in a.columns:
        same = (a[name] == b[name]) | (a[name].isna() & b[name].isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{name}: {(~same).sum()} differ, first {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
        types = {str(frame[name].dtype) for frame in (a, b) if frame[name].dtype.kind in "iufb"}
        if len(types) > 1 and not a[name].isna().any():
            return f"{name}: type {a[name].dtype} / {b[name].dtype}"
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        started = time.time()
        try:
            result = QUERIES[name](spark, sf_dir).toPandas()
            spark_sec = time.time() - started
            expected = con.execute(ORACLE[name]).fetchdf()
            reason = difference(result, expected)
            print(f"{'ok ' if reason is None else 'BAD'} {name:26s} rows={len(result):7d} spark={spark_sec:5.1f}s duck={time.time() - started - spark_sec:5.1f}s {reason or ''}", flush=True)
        except Exception as error:
            reason = str(error)[:600]
            print(f"ERR {name}: {reason}", flush=True)
        bad += reason is not None
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
