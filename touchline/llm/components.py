"""Connected components of links between numbered nodes, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.staging import stage

MOST_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """Smallest node of each node's component, for every node that has a link: node, component.

    ``links`` has columns a and b. Each round, every node points to the one of least hash among itself and its
    neighbours, and the links are redrawn between what they point to; loops and doubles go. Hashes make long chains
    shrink by a constant share per round. The pointers are followed at the end, last round first. Links stay in
    tables throughout; a node with very many links is merged before each shuffle.
    """
    spark = links.sparkSession
    now = stage(links.select("a", "b").where("a <> b").distinct())
    nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    pointers = []
    for _ in range(MOST_ROUNDS):
        if now.isEmpty():
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("other")
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        points = stage(both.groupBy("a").agg(least).select("a", F.least(own, "other")["n"].alias("to")))
        pointers.append(points)
        to_a = points.select("a", F.col("to").alias("_ta"))
        to_b = points.select(F.col("a").alias("b"), F.col("to").alias("_tb"))
        drawn = now.join(to_a, "a").join(to_b, "b").where("_ta <> _tb")
        now = stage(drawn.select(F.least("_ta", "_tb").alias("a"), F.greatest("_ta", "_tb").alias("b")).distinct())
    else:
        raise RuntimeError(f"links were not contracted in {MOST_ROUNDS} rounds")
    if not pointers:
        return spark.createDataFrame([], "node bigint, component bigint")
    # root of each node of a round, from the last round back to the first
    roots = pointers[-1].select("a", F.col("to").alias("root"))
    for points in reversed(pointers[:-1]):
        later = roots.select(F.col("a").alias("to"), "root")
        roots = points.join(later, "to", "left").select("a", F.coalesce("root", "to").alias("root"))
    placed = stage(nodes.join(roots.withColumnRenamed("a", "node"), "node").select("node", "root"))
    names = placed.groupBy("root").agg(F.min("node").alias("component"))
    return placed.join(names, "root").select("node", "component")
