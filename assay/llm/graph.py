"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _link_down(edges: DataFrame, only_smaller: bool) -> DataFrame:
    """One star step: every neighbour of a node is linked to the smallest node
    around it. ``only_smaller`` looks at smaller neighbours, else at all and
    moves the larger ones. Minima combine before the shuffle; a hub is a hot
    join key that adaptive execution may split."""
    if only_smaller:
        around = edges
    else:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = around.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    moved = around if only_smaller else around.where(F.col("b") > F.col("a"))
    moved = moved.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    if only_smaller:
        moved = moved.unionByName(lowest.select("a", F.col("low").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component_id)`` for every node with a link to another node;
    ``component_id`` is the smallest node reachable, itself included.

    Large-star and small-star steps alternate until every component is a star
    around its smallest node, which takes a number of rounds that grows with
    the logarithm of the size. Each round is written to the checkpoint folder.
    Nulls and self-links say nothing and are dropped; no links give no rows.
    """
    edges = (
        links.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y"))
        .where("x is not null and y is not null and x <> y")
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
    )
    edges = stored(edges, "links")
    last = _signature(edges)
    while last[0]:
        edges = stored(_link_down(_link_down(edges, False), True), "links")
        now = _signature(edges)
        if now == last:
            break
        last = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct())
