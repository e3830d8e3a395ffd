"""Connected components of a table of links, by alternating large and small stars; nothing of it reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import counted, discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (columns a, b; long): component is the smallest id that is reachable.

    Each round is one job: two aggregates to a minimum and two joins back to it, in which Spark splits an id with very many
    links; rounds grow as the square of the logarithm of the links. The edges of each round are a table in the shared folder.

    Defined results: links of an id with itself, repeated ones and ones with a null side change nothing and name no id; no
    links give an empty table.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small, now = counted(small, "links", F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        discard(edges)
        edges = small
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
