"""Connected components as Spark jobs (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, stored


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the smallest node that links reach.

    Every round is a grouped minimum (partial aggregation, so a hub costs nothing) and an equi join
    that adaptive execution can split; each round's edges go to the shared folder in place of the last one's. The driver sees
    a count and a checksum only. An empty edge table gives an empty result; self-links and null
    ends are ignored.
    """
    e = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e, path = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = _digest(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: neighbours above a node link to the smallest of its neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # small star: neighbours below a node, and the node, link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e, new = stored(small.select("x.a", "x.b").where("a != b").distinct(), "cc")
        discard(edges.sparkSession, path)
        path = new
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")
    out = materialize(roots.unionByName(roots.select(F.col("comp").alias("node"), "comp").distinct()), "components")
    discard(edges.sparkSession, path)
    return out
