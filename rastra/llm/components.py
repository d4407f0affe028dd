"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.llm.common import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, read once."""
    return edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the least node of its neighbourhood; rows may repeat, but are no more than the edges."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
    return below.where("a <> b").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node hangs below two others, or below one and has some below it."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0


def stars(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link and is not the root; root is the component's least node.

    Each round is a few joins and aggregations over the links alone; nothing but one count reaches
    the driver. Links may repeat and may run either way; loops and nulls are left out. An empty table gives an empty result.
    """
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    )
    while not _is_forest(edges):
        edges = checkpointed(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link, the roots included (a node without other links than loops and nulls has no row): see stars()."""
    below = stars(links, a, b)
    return below.union(below.select(F.col("root").alias("node"), "root").distinct())
