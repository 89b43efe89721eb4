"""Spatial operators over *places* (distinct locations).

Weights live in a long sparse table ``(i, j, w)`` and never as a dense matrix.
Pair construction (distances, equal-category links) runs on the place table,
whose size is checked before any pair join: places are a dimension (nations in
the fixture), and entity-level spatial lags are derived from place sums, so no
entity x entity pairs are ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_km, md5_uniform
from .ranking import row_number_rank

def place_pairs(places: DataFrame, ordered: bool = False) -> DataFrame:
    """All place pairs (i < j, or i != j when ``ordered``) with distance and
    same-category flags: the definition of the pair study, over the place dimension."""
    a = places.select(*[F.col(c).alias(f"{c}_i") for c in places.columns])
    b = places.select(*[F.col(c).alias(f"{c}_j") for c in places.columns])
    cond = (F.col("place_i") != F.col("place_j")) if ordered else (F.col("place_i") < F.col("place_j"))
    pairs = a.join(b, cond)
    return pairs.withColumn("distance_km", haversine_km(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")))


def weights_inverse_distance(places: DataFrame) -> DataFrame:
    """w_ij = 1/d_ij for i != j (co-located places, d = 0, get no link)."""
    p = place_pairs(places, ordered=True)
    return p.where(F.col("distance_km") > 0).select(F.col("place_i").alias("i"), F.col("place_j").alias("j"), (1.0 / F.col("distance_km")).alias("w"))


def weights_same(places: DataFrame, col: str) -> DataFrame:
    """w_ij = 1 for i != j sharing ``col`` (an equi-join on the category)."""
    a = places.select(F.col("place").alias("i"), F.col(col).alias("_c"))
    b = places.select(F.col("place").alias("j"), F.col(col).alias("_c"))
    return a.join(b, "_c").where(F.col("i") != F.col("j")).select("i", "j", F.lit(1.0).alias("w"))


def row_normalise(w: DataFrame) -> DataFrame:
    """w_ij / sum_j w_ij; rows without weight simply have no entries (stay zero)."""
    s = F.sum("w").over(Window.partitionBy("i"))
    return w.withColumn("_s", s).where(F.col("_s") > 0).select("i", "j", (F.col("w") / F.col("_s")).alias("w"))


def combine(weights: dict[str, DataFrame], alphas: dict[str, float]) -> DataFrame:
    """sum_k alpha_k W_k (each W_k row-normalised first), then row-normalised."""
    parts = None
    for k, a in alphas.items():
        if a == 0 or k not in weights:
            continue
        part = row_normalise(weights[k]).select("i", "j", (F.col("w") * F.lit(float(a))).alias("w"))
        parts = part if parts is None else parts.unionByName(part)
    return row_normalise(parts.groupBy("i", "j").agg(F.sum("w").alias("w")))


def spatial_lag(w: DataFrame, values: DataFrame, key: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(W y)_i = sum_j w_ij y_j per ``by`` (e.g. year); i without neighbours gets no row."""
    by = list(by or [])
    v = values.select(*by, F.col(key).alias("j"), F.col(value).alias("_y"))
    return w.join(v, "j").groupBy(*by, "i").agg(F.sum(F.col("w") * F.col("_y")).alias("lag"))


def morans_i(w: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """I = n z'Wz / (z'z S0), E = -1/(n-1); degenerate z'z or S0 -> (0, E)."""
    v = values.select(F.col(key).alias("id"), F.col(value).alias("y")).where(F.col("y").isNotNull())
    mean = v.agg(F.avg("y")).scalar()
    z = v.select("id", (F.col("y") - mean).alias("z"))
    zz = z.agg(F.sum(F.col("z") * F.col("z"))).scalar()
    n = z.agg(F.count(F.lit(1))).scalar()
    s0 = w.agg(F.sum("w")).scalar()
    cross = (
        w.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i")
        .join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
        .agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("_c"))
        .select("_c")
        .scalar()
    )
    e = F.lit(-1.0) / (n - 1)
    ok = (zz >= 1e-12) & (s0 >= 1e-12)
    one = w.sparkSession.range(1)
    return one.select(
        n.alias("n"),
        F.when(ok, n * cross / (zz * s0)).otherwise(F.lit(0.0)).alias("I"),
        e.alias("E_I"),
        s0.alias("S0"),
    )


def morans_permutations(w: DataFrame, values: DataFrame, key: str, value: str, n_perm: int = 999, salt: str = "perm") -> DataFrame:
    """Permutation distribution of I.

    Replicate b reorders the values by the md5 of (b, id) -- deterministic and
    engine independent. The (b, id) rows come from exploding the replicate range
    per id (a generator, not a join); the per-replicate rank is a window over one
    replicate (bounded by the checked place count); I_b is one grouped aggregate
    over W joined twice to the permuted values.
    """
    v = values.select(F.col(key).alias("id"), F.col(value).alias("y")).where(F.col("y").isNotNull())
    mean = v.agg(F.avg("y")).scalar()
    z = v.select("id", (F.col("y") - mean).alias("z"))
    zz = z.agg(F.sum(F.col("z") * F.col("z"))).scalar()
    n = z.agg(F.count(F.lit(1))).scalar()
    s0 = w.agg(F.sum("w")).scalar()
    idx = row_number_rank(
        z.withColumn("_k", F.col("id").cast("double")), "_k", "id", "pos"
    ).select(F.col("pos").alias("src_pos"), F.col("z").alias("zp"))
    per = z.select("id", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("b"))
    wr = Window.partitionBy("b").orderBy(md5_uniform(F.col("b"), F.col("id"), salt=salt), F.col("id"))
    per = per.withColumn("src_pos", F.row_number().over(wr)).join(idx, "src_pos").select("b", "id", "zp")
    cross = (
        w.join(per.select("b", F.col("id").alias("i"), F.col("zp").alias("zi")), "i")
        .join(per.select("b", F.col("id").alias("j"), F.col("zp").alias("zj")), ["b", "j"])
        .groupBy("b")
        .agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("_c"))
    )
    ok = (zz >= 1e-12) & (s0 >= 1e-12)
    return cross.select("b", F.when(ok, n * F.col("_c") / (zz * s0)).otherwise(F.lit(0.0)).alias("I_perm"))


def morans_test(w: DataFrame, values: DataFrame, key: str, value: str, n_perm: int = 999) -> DataFrame:
    """I, E[I], permutation z and two-sided p (share of |I_b - mean| >= |I - mean|, no +1).
    Degenerate input (constant y or empty W) gives (0, E, 0, 1)."""
    obs = morans_i(w, values, key, value)
    perm = morans_permutations(w, values, key, value, n_perm)
    i_obs = obs.select("I").scalar()
    stats = perm.agg(F.avg("I_perm").alias("m"), F.stddev_pop("I_perm").alias("sd"))
    m = stats.select("m").scalar()
    sd = stats.select("sd").scalar() + F.lit(1e-12)
    p = perm.agg(F.avg((F.abs(F.col("I_perm") - m) >= F.abs(i_obs - m)).cast("double"))).scalar()
    return obs.select(
        "n",
        "I",
        "E_I",
        F.when(F.col("I") == 0, F.lit(0.0)).otherwise((i_obs - m) / sd).alias("z_perm"),
        F.when(F.col("I") == 0, F.lit(1.0)).otherwise(p).alias("p_perm"),
        m.alias("I_perm_mean"),
    )
