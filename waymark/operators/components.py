"""Connected components of a graph, and what can be reached in a directed one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.shared import settle


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star steps, each a grouped minimum and a join; the
    edges left after a round are settled, so a lost executor costs one round at most.
    Roots are not listed. Edges from a node to itself are ignored.
    """
    spark = edges.sparkSession

    def distinct(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = settle(distinct(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    state = None
    for _ in range(rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = distinct(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(distinct(small.unionByName(least.select("u", F.col("m").alias("v")))))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): what each of ``starts`` (start) reaches along directed ``edges`` (a, b), itself left out.

    A round takes one step from all that the last one reached first, so it ends in cycles too.
    """
    steps = settle(edges.where("a <> b").select("a", "b").distinct())
    seen = front = settle(starts.select("start", F.col("start").alias("node")).distinct())
    rounds = 0
    while not front.isEmpty():
        rounds += 1
        onward = front.join(steps, front["node"] == steps["a"]).select("start", F.col("b").alias("node")).distinct()
        front = settle(onward.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(front)
        if rounds % 8 == 0:
            seen = settle(seen)
    return seen.where("start <> node")
