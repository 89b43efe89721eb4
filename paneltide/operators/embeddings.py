"""Embedding features per entity-year without dense matrices or pair lists:
vectors are exploded to (id, k, x) and every statistic is a grouped sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_vectors(df: DataFrame, id_col: str, vec_col: str, keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    return df.select(id_col, *keep, F.posexplode(vec_col).alias("k", "x")).withColumn("x", F.col("x").cast("double"))


def cosine_to_centroid(vecs: DataFrame, reference: DataFrame, id_col: str, keep: list[str]) -> DataFrame:
    """cos(v, c) with c the mean of the reference vectors (dimension-sized table)."""
    c = reference.groupBy("k").agg(F.avg("x").alias("c"))
    cn = c.agg(F.sqrt(F.sum(F.col("c") * F.col("c")))).scalar()
    j = vecs.join(F.broadcast(c), "k")
    return j.groupBy(id_col, *keep).agg((F.sum(F.col("x") * F.col("c")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * cn)).alias("cos"))


def novelty(vecs: DataFrame, id_col: str, year: str, keep: list[str]) -> DataFrame:
    """1 - cos(v, centroid of all vectors of earlier years). The centroid direction
    equals the direction of the earlier-year *sum*, taken from per-(year, k) sums
    accumulated over years (a table of years x dimensions)."""
    ys = vecs.groupBy(year, "k").agg(F.sum("x").alias("_s"))
    w = Window.partitionBy("k").orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    prev = ys.withColumn("p", F.sum("_s").over(w)).where(F.col("p").isNotNull()).select(year, "k", "p")
    pn = prev.groupBy(year).agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("pn"))
    j = vecs.join(prev, [year, "k"])
    dots = j.groupBy(id_col, year, *keep).agg(F.sum(F.col("x") * F.col("p")).alias("_d"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
    return dots.join(pn, year).select(id_col, year, *keep, (F.lit(1.0) - F.col("_d") / (F.col("_n") * F.col("pn"))).alias("novelty"))


def cohesion(vecs: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """Mean pairwise cosine inside each group without forming pairs:
    (||sum u||^2 - n) / (n (n - 1)) for unit vectors u, n >= 2."""
    norms = vecs.groupBy(id_col).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_nrm"))
    u = vecs.join(norms, id_col).select(id_col, *by, "k", (F.col("x") / F.col("_nrm")).alias("u"))
    sums = u.groupBy(*by, "k").agg(F.sum("u").alias("_su"))
    sq = sums.groupBy(*by).agg(F.sum(F.col("_su") * F.col("_su")).alias("_ss"))
    n = u.select(id_col, *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    j = sq.join(n, by).where(F.col("n") >= 2)
    return j.select(*by, "n", ((F.col("_ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("intra_cohesion"))
