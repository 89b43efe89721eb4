"""Panel preparation: enrichment, dummies, logs, time scaling, policy steps,
interactions, lags, group means and within deviations (one window pass).

Every list of names (events, dummy categories, variables) is an argument; the
fixture values live in :data:`FIXTURE`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log1p0, log_clip1
from ..sources.tables import resolve_optional

ENTITY = "entity"
YEAR = "year"


@dataclass(frozen=True)
class Study:
    """Study parameters (years, policy events, category labels)."""

    year_start: int
    year_end: int
    events: dict[str, int]
    type_flags: dict[str, str]  # dummy name -> inst_type value
    east_types: tuple[str, ...]
    trend_event: str
    split_year: int  # temporal train/test split
    cutoff_year: int  # pre/post flag for walk-forward folds
    segments: dict[str, tuple[int, int]] = field(default_factory=dict)


# Fixed values of the fixture study over the driver tables (1995-2001 ship years).
FIXTURE = Study(
    year_start=1995,
    year_end=2001,
    events={"BRI": 1997, "MiC2025": 1998, "NEV": 1999, "COVID": 2000},
    type_flags={"is_c9": "ASIA", "is_c7": "AMERICA", "is_transport": "EUROPE", "is_research": "MIDDLE EAST"},
    east_types=("ASIA", "AFRICA"),
    trend_event="BRI",
    split_year=1999,
    cutoff_year=2000,
    segments={
        "Pre-BRI": (1995, 1997),
        "BRI-COVID": (1997, 2000),
        "Post-COVID": (2000, 2002),
        "Overall": (1995, 2002),
    },
)

TV_VARS = ["tech_prox", "research_novelty", "topic_entropy", "intra_cohesion", "log_n_papers"]
FE_VARS = ["log_mean_pat", "tech_prox", "research_novelty", "topic_entropy", "intra_cohesion", "log_n_papers", "novelty_sq", "oa_share"]


def enrich(panel: DataFrame, meta: DataFrame) -> DataFrame:
    """Dimension enrichment; unmatched entities keep nulls. The dimension is joined
    by key and Catalyst/AQE broadcasts it when its measured size is small."""
    m = meta.select(
        ENTITY,
        F.col("city").alias("inst_city"),
        F.col("region").alias("inst_region"),
        F.col("type").alias("inst_type"),
        F.col("rank").alias("inst_rank"),
    )
    return panel.join(m, ENTITY, "left")


def dummies(df: DataFrame, study: Study) -> DataFrame:
    cols = [F.coalesce(F.col("inst_type") == F.lit(v), F.lit(False)).cast("int").alias(k) for k, v in study.type_flags.items()]
    cols.append(F.coalesce(F.col("inst_type").isin(*study.east_types), F.lit(False)).cast("int").alias("is_east"))
    return df.select("*", *cols)


def logs(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        log1p0(F.col("n_papers")).alias("log_n_papers"),
        log1p0(F.col("mean_patent_cit")).alias("log_mean_pat"),
        log_clip1(F.col("inst_rank")).alias("log_inst_rank"),
    )


def time_scale(df: DataFrame, study: Study) -> DataFrame:
    span = float(study.year_end - study.year_start)
    return df.select(
        "*",
        ((F.col(YEAR) - F.lit(study.year_start)) / F.lit(span)).alias("year_norm"),
        (F.col(YEAR) - F.lit(study.year_start)).cast("int").alias("year_idx"),
    )


def policy_dummies(df: DataFrame, study: Study) -> DataFrame:
    posts = [(F.col(YEAR) >= F.lit(y)).cast("int").alias(f"post_{e}") for e, y in study.events.items()]
    df = df.select("*", *posts)
    t = study.trend_event
    return df.withColumn(f"post_{t}_trend", F.col(f"post_{t}") * F.col("year_norm"))


def interactions(df: DataFrame, study: Study) -> DataFrame:
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    t = study.trend_event
    return df.select(
        "*",
        F.pow(z("research_novelty"), 2).alias("novelty_sq"),
        (z("tech_prox") * F.col("is_transport")).alias("tech_x_transport"),
        (z("tech_prox") * F.col("is_c9")).alias("tech_x_c9"),
        (z("research_novelty") * F.col("log_inst_rank")).alias("novelty_x_rank"),
        (z("oa_share") * F.col(f"post_{t}")).alias("oa_x_post"),
        (z("oa_share") * z("tech_prox")).alias("oa_x_tech"),
    )


def lags(df: DataFrame) -> DataFrame:
    """Lag by one *row* within entity (gaps in years are bridged), lagged high-state flag."""
    w = Window.partitionBy(ENTITY).orderBy(YEAR)
    return df.select(
        "*",
        F.lag("log_mean_pat", 1).over(w).alias("log_mean_pat_lag"),
        F.coalesce((F.lag("state", 1).over(w) == 2), F.lit(False)).cast("int").alias("high_state_lag"),
    )


def group_means(df: DataFrame, variables: list[str], gm_prefix: str = "gm_", dm_prefix: str = "dm_") -> DataFrame:
    """Mundlak means over non-nulls per entity and deviations with null taken as 0."""
    w = Window.partitionBy(ENTITY)
    cols = []
    for v in variables:
        if v not in df.columns:
            continue
        gm = F.avg(v).over(w)
        cols.append(gm.alias(f"{gm_prefix}{v}"))
        cols.append((F.coalesce(F.col(v), F.lit(0.0)) - F.coalesce(gm, F.lit(0.0))).alias(f"{dm_prefix}{v}"))
    return df.select("*", *cols)


def within(df: DataFrame, variables: list[str], suffix: str = "_fe") -> DataFrame:
    """Entity demeaning ``v_fe = coalesce(v, 0) - coalesce(mean(v), 0)`` (one window)."""
    w = Window.partitionBy(ENTITY)
    cols = [
        (F.coalesce(F.col(v).cast("double"), F.lit(0.0)) - F.coalesce(F.avg(v).over(w), F.lit(0.0))).alias(f"{v}{suffix}")
        for v in variables
        if v in df.columns
    ]
    return df.select("*", *cols)


def prepare(panel: DataFrame, meta: DataFrame, study: Study = FIXTURE, with_means: bool = True) -> DataFrame:
    """The prepared panel: every derived column the analyses read.

    Window work (lags, group means, FE deviations) shares one partitioning by
    entity, so Spark plans a single exchange for all of them.
    """
    df = resolve_optional(panel, {"oa_share": 0.0})
    df = enrich(df, meta)
    df = dummies(df, study)
    df = logs(df)
    df = time_scale(df, study)
    df = policy_dummies(df, study)
    df = interactions(df, study)
    df = lags(df)
    if with_means:
        df = group_means(df, TV_VARS + ["oa_share"])
        df = within(df, FE_VARS)
    return df


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df[cols].dropna()``: keep the model's columns and drop rows with any null."""
    return df.select(*cols).na.drop()


def segment_expand(df: DataFrame, segments: dict[str, tuple[int, int]], year_col: str = YEAR) -> DataFrame:
    """Half-open segment tags (overlapping allowed): one output row per (row, segment)
    with ``y0 <= year < y1``. The segment table is a handful of literals, so the
    range join is a broadcast nested-loop join against a bounded side."""
    spark = df.sparkSession
    seg = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in segments.items()], "segment string, year_start int, year_end int")
    return df.join(F.broadcast(seg), (F.col(year_col) >= seg.year_start) & (F.col(year_col) < seg.year_end))


def threshold_sweep(df: DataFrame, col: str, thresholds: list[float]) -> DataFrame:
    """Theta join with a literal threshold table: threshold 0 keeps every row (nulls too)."""
    spark = df.sparkSession
    thr = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    cond = (thr.threshold <= 0) | (F.col(col) >= thr.threshold)
    return df.join(F.broadcast(thr), cond)


def add_lag(df: DataFrame, col: str, out: str, by: str = ENTITY, order: str = YEAR) -> DataFrame:
    return df.withColumn(out, F.lag(col, 1).over(Window.partitionBy(by).orderBy(order)))


def first_diff(df: DataFrame, cols: list[str], prefix: str = "fd_", by: str = ENTITY, order: str = YEAR) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return df.select("*", *[(F.col(c) - F.lag(c, 1).over(w)).alias(f"{prefix}{c}") for c in cols])

