"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import stored


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)),
                           F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the smallest node reachable, for every linked node.

    Large-star joins each node's larger neighbours to its smallest one,
    small-star its smaller ones; both only need a minimum per node, so no
    neighbourhood is ever gathered and a hub is a skewed join that Spark can
    split.  Each round is written to the shared scratch folder, which cuts the
    lineage.  Ends when a round changes nothing: every node then points at the
    smallest node of its component.
    """
    edges = stored(links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = _digest(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")) \
            .select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = (edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
                 .unionByName(edges.select("u", F.col("v").alias("w")))
                 .filter(F.col("w") > F.col("u"))
                 .join(least, F.col("u") == F.col("x"))
                 .select(F.col("w").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m")) \
            .select(F.col("u").alias("x"), "m")
        small = (large.join(down, F.col("u") == F.col("x")).filter(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select(F.col("x").alias("u"), F.col("m").alias("v")))
                 .distinct())
        edges = stored(small, "small-star")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
