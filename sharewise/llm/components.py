"""Connected components by alternating large and small stars, all in Spark.

Each round rewrites the links: large stars point every larger neighbour of a node at the
smallest one, small stars do so for the smaller neighbours.  The smallest neighbours are a table
of their own, so that Spark can split the links of a node that has very many.  Rounds are written to
the shared checkpoint folder, and only a count and a checksum of the links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.plans import store


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    least = store(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) for every node that has a link.

    ``links`` has two columns of one orderable type; direction, repeats and loops don't
    matter, rows with a null are left out.
    """
    a, b = links.columns[:2]
    links = links.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = store(links, "links")
    seen = _checksum(links)
    while seen[0]:
        links = store(_small(_large(links)), "links")
        now = _checksum(links)
        if now == seen:
            break
        seen = now
    centres = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)
