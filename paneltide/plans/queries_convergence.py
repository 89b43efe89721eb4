"""Registered queries, part 5: balanced panel, log-t test and convergence clubs
(operators 48, 52, 55, 81, 81d, 81e)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convergence as CV
from .common import R, finish, meta, prep
from .oracle import META_CTES, PANEL_CTES, PREP_CTES, with_ctes
from .registry import query

_BASE = (PANEL_CTES, META_CTES, PREP_CTES)

BAL_CTES = """
bal_years AS (SELECT DISTINCT year FROM prep),
bal_ents AS (SELECT DISTINCT entity FROM prep),
bal_means AS (SELECT entity, avg(log_mean_pat) AS m FROM prep GROUP BY entity),
bal AS (
  SELECT e.entity, y.year, coalesce(p.log_mean_pat, m.m, 0.0) AS y
  FROM bal_ents e CROSS JOIN bal_years y
  LEFT JOIN prep p ON p.entity = e.entity AND p.year = y.year
  LEFT JOIN bal_means m ON m.entity = e.entity
)"""


def _sql(body: str, doubles: str, *ctes: str) -> str:
    return R(with_ctes(*ctes, body=body), doubles)


def _bal(spark, sf):
    return CV.balanced_panel(prep(spark, sf), "log_mean_pat")


@query("balanced_panel", sql=_sql("SELECT entity, year, y FROM bal", "y", *_BASE, BAL_CTES))
def q_balanced(spark, sf):
    return finish(_bal(spark, sf))


@query(
    "logt_variance",
    sql=_sql(
        "SELECT year, count(*) AS n, greatest(var_pop(y) / pow(avg(y) + 1e-12, 2), 1e-12) AS V FROM bal GROUP BY year",
        "V",
        *_BASE,
        BAL_CTES,
    ),
)
def q_logt_variance(spark, sf):
    return finish(CV.year_variance(_bal(spark, sf)))


@query("logt_global")
def q_logt_global(spark, sf):
    v = CV.year_variance(_bal(spark, sf)).orderBy("year").collect()  # one row per year: bounded
    import numpy as np

    b, t, p = CV.logt_regression(np.array([r["V"] for r in v], dtype=float))
    return finish(
        spark.createDataFrame(
            [(b if b == b else None, t if t == t else None, p if p == p else None, CV.convergence_status(b), len(v))],
            "b_coef double, t_stat double, p_value double, status string, n_years bigint",
        )
    )


@query(
    "club_prefix_variance",
    sql=_sql(
        """SELECT size, year, greatest((s2 / size - pow(s1 / size, 2)) / pow(c + s1 / size + 1e-12, 2), 1e-12) AS V FROM (
  SELECT k.r AS size, b.year, c.c,
         sum(b.y - c.c) OVER (PARTITION BY b.year ORDER BY k.r ROWS UNBOUNDED PRECEDING) AS s1,
         sum(pow(b.y - c.c, 2)) OVER (PARTITION BY b.year ORDER BY k.r ROWS UNBOUNDED PRECEDING) AS s2
  FROM bal b
  JOIN (SELECT entity, row_number() OVER (ORDER BY y DESC, entity) AS r FROM bal WHERE year = (SELECT max(year) FROM bal)) k ON b.entity = k.entity
  JOIN (SELECT year, avg(y) AS c FROM bal GROUP BY year) c ON b.year = c.year
) WHERE size >= 2""",
        "V",
        *_BASE,
        BAL_CTES,
    ),
)
def q_club_prefix(spark, sf):
    v, _ = CV.prefix_variances(_bal(spark, sf))
    return finish(v)


@query("logt_prefix_tests")
def q_logt_prefix(spark, sf):
    v, _ = CV.prefix_variances(_bal(spark, sf))
    return finish(CV.logt_by_prefix(v))


@query("clubs")
def q_clubs(spark, sf):
    clubs = CV.form_clubs(_bal(spark, sf))
    m = meta(spark, sf).select("entity", F.col("type").alias("inst_type"), F.col("region").alias("inst_region"))
    return finish(clubs.join(m, "entity", "left").select("entity", "club", "inst_type", "inst_region", "b_coef", "t_stat", "converging"))


@query(
    "logt_slope",
    sql=_sql(
        "SELECT regr_slope(yv, xv) AS b_coef, regr_intercept(yv, xv) AS intercept, count(*) AS n_points FROM lt_r",
        "b_coef intercept",
        *_BASE,
        BAL_CTES,
        "lt_v AS (SELECT year, greatest(var_pop(y) / pow(avg(y) + 1e-12, 2), 1e-12) AS V FROM bal GROUP BY year)",
        "lt_vi AS (SELECT year, V, row_number() OVER (ORDER BY year) - 1 AS t, count(*) OVER () AS T FROM lt_v)",
        "lt_t0 AS (SELECT greatest(1, CAST(floor(0.2 * max(T)) AS BIGINT)) AS t0 FROM lt_vi)",
        """lt_r AS (SELECT ln(lt_vi.V / (SELECT a.V FROM lt_vi a, lt_t0 b WHERE a.t = b.t0)) - 2 * ln(ln(lt_vi.t + 2)) AS yv, ln(lt_vi.t + 1) AS xv
      FROM lt_vi, lt_t0 WHERE lt_vi.t >= lt_t0.t0)""",
    ),
)
def q_logt_slope(spark, sf):
    """OLS part of the log-t regression (slope b and intercept) on the year
    variances; the HAC t statistic is in ``logt_global``."""
    from ..operators.ranking import row_number_rank

    v = CV.year_variance(_bal(spark, sf))
    vi = row_number_rank(v.withColumn("_k", F.col("year").cast("double")), "_k", "year", "_pos").select("year", "V", (F.col("_pos") - 1).alias("t"))
    n_years = vi.agg(F.count(F.lit(1))).scalar()
    t0 = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(0.2) * n_years).cast("bigint"))
    v0 = vi.where(F.col("t") == t0).select("V").scalar()
    r = vi.where(F.col("t") >= t0).select(
        (F.log(F.col("V") / v0) - F.lit(2.0) * F.log(F.log(F.col("t") + 2))).alias("yv"), F.log(F.col("t") + 1).alias("xv")
    )
    return finish(r.agg(F.regr_slope("yv", "xv").alias("b_coef"), F.regr_intercept("yv", "xv").alias("intercept"), F.count(F.lit(1)).alias("n_points")))
