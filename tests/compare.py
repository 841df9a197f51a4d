"""Run registered queries next to their SQL twins.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """'' when both sides agree, else what differs."""
    from sharewise.suite import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return "" if got else "no rows"
    rel = con.execute(ORACLES[name])
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if cols != want_cols:
        return f"columns {cols} / {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    if not got:
        return "no rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else ""


def local_session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> None:
    from sharewise.suite import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            diff = compare(spark, con, sf_dir, name)
        except Exception as exc:  # noqa: BLE001
            diff = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += bool(diff)
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {diff}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
