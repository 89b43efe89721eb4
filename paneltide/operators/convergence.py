"""Convergence operators: sigma (dispersion trend, segmented), beta (catch-up),
balanced panel, log-t regression and club formation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_pvalue
from .describe import sigma_by_year
from .panel import segment_expand


def simple_regression_stats(df: DataFrame, y: str, x: str, by: list[str], min_n: int = 3) -> DataFrame:
    """OLS of y on x per group from the built-in ``regr_*`` aggregates:
    slope, classical se, two-sided t p-value (n - 2 df), R^2 and n."""
    g = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") >= min_n)
    rss = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    se = F.sqrt(rss / (F.col("n") - 2) / F.col("_sxx"))
    g = g.withColumn("se", se)
    return g.withColumn("p_value", t_pvalue(F.col("slope") / F.col("se"), F.col("n") - 2)).drop("_sxx", "_syy", "_sxy")


def sigma_segments(df: DataFrame, value: str, segments: dict[str, tuple[int, int]], min_years: int = 3) -> DataFrame:
    """Slope of the yearly cross-sectional sd on year inside half-open segments."""
    sig = sigma_by_year(df, value)
    tagged = segment_expand(sig, segments)
    out = simple_regression_stats(tagged, "sigma", "year", ["segment", "year_start", "year_end"], min_n=min_years)
    return out.select("segment", "year_start", "year_end", "slope", "se", "p_value", "r_squared", "n")


# ---------------------------------------------------------------------------- balanced panel and log-t
import math  # noqa: E402

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import Window  # noqa: E402

from ..functions.stats import normal_two_sided  # noqa: E402
from .ranking import row_number_rank  # noqa: E402
from ..session import materialise  # noqa: E402

V_FLOOR = 1e-12


def balanced_panel(df: DataFrame, value: str, entity: str = "entity", year: str = "year") -> DataFrame:
    """Complete entity x year grid (years = the distinct years present, a bounded
    array exploded per entity -- no cross join); a missing cell takes the entity
    mean, an entity with no value at all takes 0."""
    years = df.select(F.sort_array(F.collect_set(year))).scalar()
    ents = df.select(entity).distinct()
    grid = ents.select(entity, F.explode(years).alias(year))
    means = df.groupBy(entity).agg(F.avg(value).alias("_m"))
    obs = df.select(entity, year, F.col(value).alias("_v"))
    return grid.join(obs, [entity, year], "left").join(means, entity, "left").select(
        entity, year, F.coalesce("_v", "_m", F.lit(0.0)).alias("y")
    )


def prefix_sums(df: DataFrame, order: str, by: list[str], cols: list[str], bucket_size: int) -> DataFrame:
    """Running sums of ``cols`` along ``order`` (1-based, dense) within ``by``.

    Rows are cut into buckets of ``bucket_size`` consecutive positions: the window
    runs per (by, bucket), so no task holds more than one bucket, and per-bucket
    totals (a table of #buckets rows per group) supply the offsets."""
    b = F.floor((F.col(order) - 1) / F.lit(bucket_size)).cast("long")
    t = df.withColumn("_bk", b)
    w = Window.partitionBy(*by, "_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for c in cols:
        t = t.withColumn(f"_loc_{c}", F.sum(c).over(w))
    tot = t.groupBy(*by, "_bk").agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    wo = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*by, "_bk", *[F.coalesce(F.sum(f"_tot_{c}").over(wo), F.lit(0.0)).alias(f"_off_{c}") for c in cols])
    out = t.join(tot, [*by, "_bk"])
    return out.select(*[c for c in df.columns], *[(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(f"cum_{c}") for c in cols])


def year_variance(bal: DataFrame, year: str = "year") -> DataFrame:
    """V_t = var_pop(h_t) with h = y / (mean_t + 1e-12), floored at 1e-12."""
    g = bal.groupBy(year).agg(F.var_pop("y").alias("_v"), F.avg("y").alias("_m"), F.count(F.lit(1)).alias("n"))
    return g.select(year, "n", F.greatest(F.col("_v") / F.pow(F.col("_m") + F.lit(1e-12), 2), F.lit(V_FLOOR)).alias("V"))


def logt_regression(v: np.ndarray, drop_frac: float = 0.2) -> tuple[float, float, float]:
    """Regress ln(V_t / V_T0) - 2 ln ln(t + 2) on ln(t + 1) for t = T0..T-1 with a
    Bartlett HAC covariance (lag floor(4 (m/100)^0.25)); normal tails."""
    T = len(v)
    t0 = max(1, int(math.floor(drop_frac * T)))
    t_idx = np.arange(t0, T, dtype=float)
    m = len(t_idx)
    if m < 3:
        return float("nan"), float("nan"), float("nan")
    yv = np.log(v[t0:] / v[t0]) - 2.0 * np.log(np.log(t_idx + 2.0))
    x = np.column_stack([np.ones(m), np.log(t_idx + 1.0)])
    a = np.linalg.pinv(x.T @ x)
    b = a @ x.T @ yv
    e = yv - x @ b
    lags = int(math.floor(4 * (m / 100.0) ** 0.25))
    xe = x * e[:, None]
    s = xe.T @ xe
    for lag in range(1, lags + 1):
        w = 1.0 - lag / (lags + 1.0)
        g = xe[lag:].T @ xe[:-lag]
        s += w * (g + g.T)
    cov = a @ s @ a
    se = math.sqrt(max(cov[1, 1], 0.0))
    tstat = b[1] / se if se > 0 else float("nan")
    return float(b[1]), float(tstat), normal_two_sided(tstat)


def convergence_status(b: float) -> str:
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return "indeterminate"
    if b >= 0:
        return "convergence"
    if b > -2:
        return "conditional convergence"
    return "divergence"


LOGT_SCHEMA = "size long, b_coef double, t_stat double, p_value double"


def _logt_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("year")
    b, t, p = logt_regression(pdf["V"].to_numpy(dtype=float))
    return pd.DataFrame([{"size": int(pdf["size"].iloc[0]), "b_coef": b, "t_stat": t, "p_value": p}])


def prefix_variances(bal: DataFrame, entity: str = "entity", year: str = "year", bucket_size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """V(size, t) of every prefix of the entities ranked by last-period value
    (descending, ties by entity), from running sums of per-year centred values."""
    last_year = bal.agg(F.max(year)).scalar()
    last = bal.where(F.col(year) == last_year).select(entity, F.col("y").alias("_last"))
    ranked = row_number_rank(last, "_last", entity, "r", descending=True).select(entity, "r")
    centre = bal.groupBy(year).agg(F.avg("y").alias("_c"))
    cy = bal.join(ranked, entity).join(centre, year).select(entity, year, "r", "_c", (F.col("y") - F.col("_c")).alias("_d"))
    cy = cy.withColumn("_d2", F.col("_d") * F.col("_d"))
    ps = prefix_sums(cy, "r", [year], ["_d", "_d2"], bucket_size)
    size = F.col("r").cast("double")
    m1 = F.col("cum__d") / size
    var = F.col("cum__d2") / size - m1 * m1
    mean = F.col("_c") + m1
    v = ps.select(F.col("r").alias("size"), year, F.greatest(var / F.pow(mean + F.lit(1e-12), 2), F.lit(V_FLOOR)).alias("V"))
    return v.where(F.col("size") >= 2), ranked


def logt_by_prefix(v: DataFrame) -> DataFrame:
    """One log-t regression per prefix size, in parallel (each group has T rows)."""
    return v.groupBy("size").applyInPandas(_logt_group, LOGT_SCHEMA)


CLUB_SCHEMA = "entity long, club int, b_coef double, t_stat double, converging boolean"


def form_clubs(bal: DataFrame, t_crit: float = -1.65, max_iter: int | None = None, entity: str = "entity") -> DataFrame:
    """Iterative club formation. Each round ranks the remaining entities, tests all
    prefixes at once and keeps the largest prefix with t > t_crit as a club; the
    rest continues (checkpointed per round). If no prefix passes, the remaining
    entities form one non-converging club; a single leftover stays unlabelled. Rounds go
    on until nothing is left, or for ``max_iter`` rounds."""
    spark = bal.sparkSession
    remaining = bal
    clubs = None
    club_id = 0
    while max_iter is None or club_id < max_iter:
        n_left = remaining.select(entity).distinct().count()
        if n_left < 2:
            break
        v, ranked = prefix_variances(remaining)
        tests = logt_by_prefix(v)
        best = tests.where(F.col("t_stat") > t_crit).orderBy(F.desc("size")).first()
        club_id += 1
        if best is None or best["size"] < 2:
            members = remaining.select(entity).distinct().select(
                entity, F.lit(club_id).alias("club"), F.lit(None).cast("double").alias("b_coef"), F.lit(None).cast("double").alias("t_stat"), F.lit(False).alias("converging")
            )
            clubs = members if clubs is None else clubs.unionByName(members)
            break
        members = ranked.where(F.col("r") <= best["size"]).select(
            entity, F.lit(club_id).alias("club"), F.lit(best["b_coef"]).alias("b_coef"), F.lit(best["t_stat"]).alias("t_stat"), F.lit(True).alias("converging")
        )
        clubs = materialise(members if clubs is None else clubs.unionByName(members), "clubs")
        remaining = materialise(remaining.join(members.select(entity), entity, "left_anti"), "club_rest")
    if clubs is None:
        return spark.createDataFrame([], CLUB_SCHEMA)
    return clubs.select(F.col(entity).cast("long").alias("entity"), F.col("club").cast("int"), "b_coef", "t_stat", "converging")
