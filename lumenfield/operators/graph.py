"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of ``edges`` (src, dst); the component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges no longer change; each
    round is written to the shared folder in place of the one before; an error where they still change after ``max_rounds``. Minima are partial aggregations and joins, no neighbour list is
    ever collected. Null ends and loops are left out; nodes without an edge do not appear.
    """
    both = lambda e: e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    e = written(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges", plain=True)
    before = None
    for _ in range(max_rounds):
        b = both(e)
        low = b.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = b.join(low, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where(F.col("src") != F.col("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        hang = large.join(low, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct("src", F.col("low").alias("dst")))).alias("x")).select("x.*")
        e = written(hang.where(F.col("src") != F.col("dst")).distinct(), "edges", spent=[e], plain=True)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are unfinished after {max_rounds} rounds")
    stars = e.groupBy("src").agg(F.min("dst").alias("component")).select(F.col("src").alias("node"), "component")
    return stars.unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct().join(stars.select("node"), "node", "left_anti"))


def extended_components(forest: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``forest`` (node, component) with new ``edges``: what ``connected_components`` gives for all edges so far.

    An edge between components is one between their smallest nodes, so only the new edges, at most, take part in the rounds; the
    stored rows are read once, to look up the ends and to move the components that joined. Null ends and loops are left out.
    """
    e = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    e = written(e.distinct(), "new_edges", plain=True)
    root = lambda side: forest.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    known = e.join(root("src"), "src", "left").join(root("dst"), "dst", "left")
    short = written(known.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")), "short_edges", plain=True)
    moved = connected_components(short, max_rounds).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    fresh = e.select("src").union(e.select("dst")).distinct().toDF("node").join(forest.select("node"), "node", "left_anti")
    nodes = forest.select("node", "component").unionByName(fresh.withColumn("component", F.col("node")))
    return nodes.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
