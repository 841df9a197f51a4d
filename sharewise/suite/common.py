"""Shared parts of the registered queries: tables, the scored rows, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE_LANG = "en"
MINDF = 5
NON_SPACE_SQL = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]+"
WORD_SQL = r"[\p{L}\p{N}_]{3,}"


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the SQL that must give the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ratios of small counts often lie half-way between two roundings, where the last bit of a
#: sum decides; this nudge puts both engines on the same side.
NUDGE = 1.23e-9


def r6(df: DataFrame, nudge: float = 0.0) -> DataFrame:
    """Round doubles to six places, as the SQL twins do."""
    return df.select(
        *[
            F.round(F.col(f.name) + F.lit(nudge), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def R(expr: str, nudge: float = 0.0) -> str:
    """SQL for :func:`r6`; adding 0.0 turns a negative zero into zero."""
    shifted = f"{expr} + CAST({nudge} AS DOUBLE)" if nudge else expr
    return f"(round({shifted}, 6) + 0.0)"


# --- scored rows: one score per order line ----------------------------------------------

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
ROW_KEY_SQL = ", ".join(ROW_KEY)

SCORED_SQL = """scored AS (
  SELECT *, CASE WHEN l_linenumber <= CASE WHEN y = 1 THEN 2 ELSE 5 END THEN 'test' ELSE 'train' END AS split
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
               CAST(0.0005 AS DOUBLE) + CAST(0.6 AS DOUBLE) * l_quantity / 50 + CAST(0.5 AS DOUBLE) * l_discount
                 + CAST(0.3 AS DOUBLE) * (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS p
        FROM lineitem) lines)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines with label, score and split.

    Returned lines are the positive class.  The split follows the line number and is lopsided
    between the classes, so positives are common in 'train' and rare in 'test'.
    """
    line = table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    p = F.lit(0.0005) + F.lit(0.6) * F.col("l_quantity") / 50 + F.lit(0.5) * F.col("l_discount") + F.lit(0.3) * y
    test = F.col("l_linenumber") <= F.when(F.col("y") == 1, 2).otherwise(5)
    return line.select(*ROW_KEY, "l_linestatus", y.alias("y"), p.alias("p")).withColumn(
        "split", F.when(test, "test").otherwise("train")
    )


def train_rows(spark, sf_dir):
    return scored(spark, sf_dir).where("split = 'train'")


def test_rows(spark, sf_dir):
    return scored(spark, sf_dir).where("split = 'test'")


DENSITY_SQL = f"""{SCORED_SQL},
bins AS (SELECT y AS cls, least(CAST(floor(p * 1000) AS INTEGER) + 1, 1000) AS cell, count(*) AS c
         FROM scored WHERE split = 'train' GROUP BY 1, 2),
grid AS (SELECT cls, cell, coalesce(c, 0) AS c
         FROM (SELECT cls, CAST(r.cell AS INTEGER) AS cell FROM (SELECT DISTINCT cls FROM bins), range(0, 1001) r(cell))
         LEFT JOIN bins USING (cls, cell)),
cums AS (SELECT cls, cell, sum(c) OVER (PARTITION BY cls ORDER BY cell) AS cum FROM grid),
raw AS (SELECT i.cls, i.cell AS bin, (hi.cum - lo.cum) / CAST(hi.cell - lo.cell AS DOUBLE) AS h
        FROM cums i JOIN cums hi ON hi.cls = i.cls AND hi.cell = least(i.cell + 100, 1000)
                    JOIN cums lo ON lo.cls = i.cls AND lo.cell = greatest(i.cell - 100, 0)
        WHERE i.cell < 1000),
floored AS (SELECT cls, bin, h + sum(h) OVER (PARTITION BY cls) * CAST(1e-20 AS DOUBLE) AS g FROM raw),
dens AS (SELECT cls, bin, g / sum(g) OVER (PARTITION BY cls) AS density FROM floored),
pair AS (SELECT bin, max(CASE WHEN cls = 1 THEN density END) AS dt, max(CASE WHEN cls = 0 THEN density END) AS df
         FROM dens GROUP BY bin)"""

HIST_ONLY_SQL = """hcounts AS (SELECT y AS cls, least(CAST(floor(p * 3) AS INTEGER), 2) AS bin, count(*) AS c
            FROM scored WHERE split = 'train' GROUP BY 1, 2),
hist AS (SELECT cls, CAST(r.bin AS INTEGER) AS bin, coalesce(c, 0) / CAST(sum(coalesce(c, 0)) OVER (PARTITION BY cls) AS DOUBLE) AS density
         FROM (SELECT DISTINCT cls FROM hcounts) CROSS JOIN range(0, 3) r(bin) LEFT JOIN hcounts USING (cls, bin))"""
HIST_SQL = f"{SCORED_SQL},\n{HIST_ONLY_SQL}"


def bisect_sql(cells: str = "cells", out: str = "share") -> str:
    """SQL: the share at which the slope of the log-likelihood over ``cells`` changes sign."""
    return f"""bis(k, lo) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT k + 1, lo + CASE WHEN (SELECT sum(c * (dt - df) / (dt * (lo + pow(2, -(k + 1))) + df * (1 - (lo + pow(2, -(k + 1))))))
                                FROM {cells}) > 0 THEN pow(2, -(k + 1)) ELSE 0 END
  FROM bis WHERE k < 40),
{out} AS (SELECT max(lo) AS pi FROM bis)"""


CELLS_SQL = """cells AS (SELECT bin, c, dt, df FROM
  (SELECT CAST(floor(p * 999) AS INTEGER) AS bin, count(*) AS c FROM scored WHERE split = 'test' GROUP BY 1) b JOIN pair USING (bin))"""

SHARE_SQL = f"""{DENSITY_SQL},
{CELLS_SQL},
{bisect_sql()}"""

STATE_SQL = f"""{SHARE_SQL},
ordered AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM scored WHERE split = 'test'),
state AS (SELECT pi, n, p AS threshold FROM ordered, share
          WHERE i = least(CAST(floor((1 - pi) * n) AS BIGINT), n - 1))"""

FOUR_SQL = f"""{STATE_SQL},
four AS (SELECT s.*, p > 0.5 AS raw_label, p AS raw_proba, p >= threshold AS cal_label,
                pi * dt / (pi * dt + (1 - pi) * df) AS cal_proba, threshold
         FROM scored s JOIN pair ON bin = CAST(floor(p * 999) AS INTEGER), state WHERE split = 'test')"""


# --- documents --------------------------------------------------------------------------

DOCS_SQL = "docs AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
LABELLED_SQL = """labelled AS (SELECT d.doc_id, d.text, d.lang, CAST(l.toxic AS DOUBLE) AS label
             FROM documents d JOIN labels l USING (doc_id))"""
TOKENS_SQL = f"""tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2)"""
VOCAB_SQL = f"""{TOKENS_SQL},
vocab AS (SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx,
                 ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf
          FROM (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= {MINDF}) kept)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def labelled(spark, sf_dir):
    """Labelled documents; a toxic document is a positive one."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    return documents(spark, sf_dir).select("doc_id", "text", "lang").join(labels, "doc_id")


def hash_sql(seed: str, key: str) -> str:
    """SQL twin of ``hash32``."""
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT)"


def unit_sql(seed: str, key: str) -> str:
    """SQL twin of ``unit_hash``."""
    return f"(CAST('0x' || substr(md5('{seed}|' || {key}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"
