"""Connected components of a link table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import staged


def _nearest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (columns ``a``, ``b``) that isn't the smallest of its component.

    Alternates large stars (each larger neighbour of a node is tied to the node's smallest neighbour) and small stars
    (each smaller neighbour likewise) until no link changes; the rounds grow with the logarithm of the longest path. Every round
    is a map-side-combined minimum and a join, and is written out, so a lost executor costs no more than its round.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        print_of = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = print_of
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _nearest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large)
        # links now point down: v < u
        low = _nearest(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct())
