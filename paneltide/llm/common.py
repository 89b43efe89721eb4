"""Shared Spark helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges(src, dst)``; root is the smallest node id
    of the component.

    Alternating large-star / small-star rounds: each round re-hangs neighbours on their
    smallest neighbour, so the number of rounds grows with the logarithm of the longest
    path. The shuffles are min-aggregations (combined before the shuffle) and equi-joins
    whose skewed side AQE can split; every round is a written table, so a lost executor
    costs a re-read. Self loops only name their node (it becomes its own root)."""
    ids = materialise(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "cc-edges")
    nodes = ids.select(F.col("a").alias("node")).union(ids.select("b")).distinct()
    cur = materialise(
        ids.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "cc0"
    )
    before = None
    for _ in range(max_rounds):
        # large star: the larger neighbours of u hang on the smallest of u and its neighbours
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours hang on the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialise(hung.union(low2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        state = nxt.agg(F.count("*").alias("c"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        cur = nxt
        if (state["c"], state["h"]) == before:
            break
        before = (state["c"], state["h"])
    else:
        raise RuntimeError("connected_components: not converged")
    roots = cur.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root"))
