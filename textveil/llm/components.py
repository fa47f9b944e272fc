"""Connected components of a link table, whatever the shape of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textveil.llm.frames import stored, with_group_values


def connected_components(links: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node that links reach) for linked nodes.

    ``links``: a, b.  Star contraction in two alternating steps: every node hands
    its larger neighbours to its smallest one, then every node its smaller ones.
    Rounds grow with the logarithm of the longest path.  A node with very many
    links is no bottleneck: minima are taken before rows move, and the minima of
    such nodes are broadcast.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    before = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stored(_star(both, larger=True), "large-star")
        edges = stored(_star(edges, larger=False), "small-star")
        # the edge set is a function of the component labels once it is stable
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n"))
    least = least.withColumn("_m", F.least("_m", "u"))
    n = edges.count()
    known = with_group_values(edges, least, ["u"], "_n", n)
    if larger:  # neighbours above the node go to its smallest neighbour
        out = known.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = known.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
            known.select("u", F.col("_m").alias("v"))
        )
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
