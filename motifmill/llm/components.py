"""Connected components of an edge table: alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(pairs: DataFrame, to_smaller_only: bool) -> DataFrame:
    """Links every neighbour of u to u's least neighbour (u included).

    The least neighbour is a partial aggregate and comes back by an equi-join, so that a vertex with very many
    neighbours is summed before the shuffle and its rows can be split by the skew join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("c"))
    if to_smaller_only:
        return joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b")
    return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def connected_components(edges: DataFrame, a: str, b: str, what: str = "components") -> DataFrame:
    """(node, root) for each node that has an edge: root is the least node of its component.

    edges may repeat, be given in either direction and hold self-loops or nulls (these link nothing). Each round is
    written to the shared folder; rounds end when the edge set no longer changes. An empty table gives an empty one."""
    spark = edges.sparkSession
    link = (
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and a <> b")
        .select("a", "b")
        .distinct()
    )
    link = stored(link, what)
    seen = None
    while True:
        state = link.agg(F.count("*"), F.sum(F.expr("cast(hash(a, b) as decimal(20,0))")), F.sum(F.expr("cast(xxhash64(b, a) as decimal(38,0))"))).first()
        if state == seen or state[0] == 0:
            return link.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(link.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
        both = link.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(link.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, to_smaller_only=False).distinct()
        small = _star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), to_smaller_only=True)
        new = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
        discard(spark, link)
        link = new
