"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), each a shuffle of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sieveline.llm import common as C


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node long, root long): the least node of its component; nodes without an edge are left out.

    A hot node's neighbours meet only in partial minima and in joins that Spark can split. Each round is written to the
    shared folder. Ends when a round changes nothing; no component goes to the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u")
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = C.stored(out.where("a <> b").distinct(), "edges")
        C.dropped(e)
        return out

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = C.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last, todo = mark(now), rounds
    while last[0]:
        if not todo:
            raise RuntimeError(f"components are unfinished after {rounds} rounds")
        now, todo = star(star(now, True), False), todo - 1
        new = mark(now)
        if new == last:
            break
        last = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
