"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest one around: those above a node, or those below it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    if large:
        pairs = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        below = edges.groupBy("a").agg(F.min("b").alias("least"))
        pairs = edges.join(below, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        pairs = pairs.union(below.select("a", F.col("least").alias("b")))
    return pairs.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``): its least reachable node.

    Alternating large-star and small-star steps, each a minimum by node and a join back,
    until nothing changes; the rounds needed grow with the logarithm of the
    longest path. Each round is a stored table, so lost executors cost a re-read.
    A node with very many neighbours is met by partial aggregation and by adaptive
    splitting of skewed joins. Loops and repeated edges are ignored; null ends too.
    """
    tidy = (
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now, mark = materialize(tidy, "edges"), None
    for _ in range(max_rounds):
        now = materialize(_star(_star(now, True), False), "stars")
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
