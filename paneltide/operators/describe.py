"""Descriptive aggregates: variable table, dispersion and means by year, group
shares, entropy, top-k, coefficient stability, arg-max."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import percentile_row


def long_values(df: DataFrame, variables: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., variable, value) via ``unpivot``; absent variables are skipped."""
    keys = list(keys or [])
    present = [v for v in variables if v in df.columns]
    casted = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in present])
    return casted.unpivot(keys, present, "variable", "value") if keys else casted.unpivot([], present, "variable", "value")


def descriptives(df: DataFrame, variables: list[str], by: list[str] | None = None) -> DataFrame:
    """N, mean, SD (ddof 1), min, median, max per variable; nulls skipped.

    The median is the exact distributed percentile (no single-task buffer)."""
    by = list(by or [])
    lv = long_values(df, variables, by).where(F.col("value").isNotNull())
    stats = lv.groupBy(*by, "variable").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    med = percentile_row(lv, "value", {"median": 0.5}, by=[*by, "variable"])
    return stats.join(med, [*by, "variable"], "left")


def sigma_by_year(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Cross-sectional sample sd per year; single-row years (null sd) are dropped."""
    by = list(by or [])
    return df.groupBy(*by, "year").agg(F.stddev_samp(value).alias("sigma")).where(F.col("sigma").isNotNull())


def mean_by_year(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("year").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def shannon_entropy(df: DataFrame, by: list[str], category: str) -> DataFrame:
    """-sum p ln p of category shares per group (zero shares never appear)."""
    counts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    p = F.col("_n") / F.sum("_n").over(w)
    return counts.select(*by, p.alias("_p")).groupBy(*by).agg((-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"))


def top_k(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """k largest groups by sum(value), ties broken by key (a top-k report: the limit is the feature)."""
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), F.asc(key)).limit(k)


def coef_stability(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """CV = sd / (|mean| + 1e-10) across runs; label STABLE < 0.5 <= MODERATE <= 1.0 < UNSTABLE.
    Groups with fewer than two non-null values get no row."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n_values"), F.stddev_samp(value).alias("_sd"), F.avg(value).alias("_m")
    ).where(F.col("n_values") > 1)
    cv = F.col("_sd") / (F.abs("_m") + F.lit(1e-10))
    return g.select(
        *by,
        "n_values",
        cv.alias("cv"),
        F.when(cv < 0.5, "STABLE").when(cv > 1.0, "UNSTABLE").otherwise("MODERATE").alias("status"),
    )


def arg_max(df: DataFrame, label: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Row with the largest value (ties: smallest label) via ``max_by`` on a struct key."""
    by = list(by or [])
    clean = df.where(F.col(value).isNotNull())
    aggs = [F.max(value).alias(f"max_{value}"), F.min_by(label, F.struct(-F.col(value), F.col(label))).alias(label)]
    return clean.groupBy(*by).agg(*aggs) if by else clean.agg(*aggs)
