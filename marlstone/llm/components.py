"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins, so a node with very many
neighbours is split by adaptive skew joins and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(directed: DataFrame, keep) -> DataFrame:
    """directed: (u, v). Joins each u to the least of itself and its v."""
    least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = directed.join(least, "u")
    return keep(joined).where("a <> b").distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(back)


def _round(edges: DataFrame) -> DataFrame:
    large = _star(
        _both_ways(edges),
        lambda j: j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")),
    )
    down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return _star(
        down,
        lambda j: j.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")),
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of node's component.

    edges has two columns of one orderable type; nulls and self-links are
    ignored. Roots themselves and nodes without a link are not returned.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = staged(now.where("a <> b").distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] == 0 or seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen
        now = staged(_round(now), "edges")
