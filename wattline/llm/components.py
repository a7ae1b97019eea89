"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("v", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u gets an edge to the smallest of u and its neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours get an edge to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` (two columns of one ordered type, u <> v) to ``node``, ``root``: the smallest node that each node
    with an edge can reach. Every round is kept in the shared folder; two numbers a round come to the driver."""
    edges = cut(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        edges = cut(_small_star(_large_star(_both_ways(edges))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(pairs.select("root", "root")).distinct()
