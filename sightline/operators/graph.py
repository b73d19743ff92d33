"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.plans.lineage import materialize
from sightline.plans.skew import join_counted


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges with m, the least of u and its neighbours; a hub that most edges have is joined by broadcast."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("rows"))
    return join_counted(edges, least, "u", total)


def _settled(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges (u over v), and whether they are stars: then each u has one edge, to a v that has none of its own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    of = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    total, open_ends = of.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return total or 0, not open_ends


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected edge table: (node, component), component = least node of the component.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm of the longest path.
    Minima are aggregated before the shuffle, no neighbour list is ever built, hubs are joined by broadcast, and each
    round is written to shared storage. Rounds end where all edges are stars; edges that are at first need none. Null end
    points are ignored; a self loop gives its node a component of its own.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = raw.select(F.col("u").alias("node")).union(raw.select("v")).distinct()
    cur = raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = materialize(cur, "cc")
    total, settled = _settled(cur)
    for _ in range(max_rounds):
        if settled:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")  # hubs have been relinked to their least neighbour: few edges have the same u here
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        cur = materialize(small.where("u <> v").distinct(), "cc")
        total, settled = _settled(cur)
    if not settled:
        raise RuntimeError("connected components did not settle")
    return nodes.join(cur.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
