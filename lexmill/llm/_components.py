"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a few joins and map-side-combined minima; nothing is gathered by node, so a hub with a third of all
links only makes one skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of the component.  Nodes without links aren't returned.

    Links of a node with itself and with null are ignored; no links give no rows.
    """
    edges = materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        before, edges = edges, materialize(
            large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        )
        release(before)
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
