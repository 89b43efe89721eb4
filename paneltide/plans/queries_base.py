"""Registered queries, part 1: panel construction and preparation, filters,
joins, descriptive aggregates, windows and sigma convergence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import md5_uniform, md5_uniform_sql, sig_stars
from ..operators import describe as D
from ..operators import panel as P
from ..sources.tables import read_table
from .common import R, finish, meta, panel, prep, round_sig, sql_round_sig
from .oracle import META_CTES, PANEL_CTES, PREP_CTES, with_ctes
from .registry import query

S = P.FIXTURE

PANEL_COLS = "entity, year, n_papers, mean_patent_cit, tech_prox, research_novelty, topic_entropy, intra_cohesion, oa_share, imputed_share, state"
PANEL_DBL = "n_papers mean_patent_cit tech_prox research_novelty topic_entropy intra_cohesion oa_share imputed_share"


def _sql(body: str, doubles: str, *ctes: str) -> str:
    return R(with_ctes(*ctes, body=body), doubles)


# ---------------------------------------------------------------- panel build (104, 111)
@query("build_panel", sql=_sql(f"SELECT {PANEL_COLS} FROM panel", PANEL_DBL, PANEL_CTES))
def q_build_panel(spark, sf):
    return finish(panel(spark, sf).select(*[c.strip() for c in PANEL_COLS.split(",")]))


@query(
    "states",
    sql=_sql(
        "SELECT state, count(*) AS n_cells, avg(mean_patent_cit) AS mean_value FROM panel GROUP BY state",
        "mean_value",
        PANEL_CTES,
    ),
)
def q_states(spark, sf):
    return finish(panel(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("mean_patent_cit").alias("mean_value")))


# ---------------------------------------------------------------- 1, 39 panel profile
@query(
    "panel_profile",
    sql=_sql(
        "SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT year) AS n_years, "
        "CAST(min(year) AS INTEGER) AS year_min, CAST(max(year) AS INTEGER) AS year_max FROM panel",
        "",
        PANEL_CTES,
    ),
)
def q_panel_profile(spark, sf):
    return panel(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("entity").alias("n_entities"),
        F.count_distinct("year").alias("n_years"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
    )


# ---------------------------------------------------------------- 8 enrichment
@query(
    "panel_enrich",
    sql=_sql(
        "SELECT p.entity, p.year, m.city AS inst_city, m.region AS inst_region, m.type AS inst_type, m.rank AS inst_rank "
        "FROM panel p LEFT JOIN meta m ON p.entity = m.entity",
        "",
        PANEL_CTES,
        META_CTES,
    ),
)
def q_panel_enrich(spark, sf):
    return P.enrich(panel(spark, sf), meta(spark, sf)).select("entity", "year", "inst_city", "inst_region", "inst_type", "inst_rank")


_PREP_BASE = (PANEL_CTES, META_CTES, PREP_CTES)


def _prep_q(name: str, cols: list[str], doubles: str):
    sql = _sql(f"SELECT entity, year, {', '.join(cols)} FROM prep", doubles, *_PREP_BASE)

    @query(name, sql=sql)
    def _q(spark, sf, cols=cols):
        return finish(prep(spark, sf).select("entity", "year", *cols))

    return _q


# 9 dummies, 10 logs, 11 time, 12 policy steps, 13 interactions, 41/42 lags
_prep_q("panel_dummies", ["is_c9", "is_c7", "is_transport", "is_research", "is_east"], "")
_prep_q("panel_logs", ["log_n_papers", "log_mean_pat", "log_inst_rank"], "log_n_papers log_mean_pat log_inst_rank")
_prep_q("panel_time", ["year_norm", "year_idx"], "year_norm")
_prep_q("policy_dummies", ["post_BRI", "post_MiC2025", "post_NEV", "post_COVID", "post_BRI_trend"], "post_BRI_trend")
_prep_q(
    "interactions",
    ["novelty_sq", "tech_x_transport", "tech_x_c9", "novelty_x_rank", "oa_x_post", "oa_x_tech"],
    "novelty_sq tech_x_transport tech_x_c9 novelty_x_rank oa_x_post oa_x_tech",
)
_prep_q("panel_lag", ["log_mean_pat_lag"], "log_mean_pat_lag")
_prep_q("lag_state_flag", ["state", "high_state_lag"], "")


# 43 first difference
@query(
    "first_diff",
    sql=_sql(
        "SELECT entity, year, log_mean_pat - lag(log_mean_pat) OVER (PARTITION BY entity ORDER BY year) AS fd_log_mean_pat, "
        "tech_prox - lag(tech_prox) OVER (PARTITION BY entity ORDER BY year) AS fd_tech_prox FROM prep",
        "fd_log_mean_pat fd_tech_prox",
        *_PREP_BASE,
    ),
)
def q_first_diff(spark, sf):
    df = P.first_diff(prep(spark, sf), ["log_mean_pat", "tech_prox"])
    return finish(df.select("entity", "year", "fd_log_mean_pat", "fd_tech_prox"))


# 44 Mundlak means, 45 within demeaning
_MUNDLAK = ["tech_prox", "research_novelty", "topic_entropy", "intra_cohesion", "log_n_papers", "oa_share"]


@query(
    "mundlak_means",
    sql=_sql(
        "SELECT entity, year, "
        + ", ".join(
            f"avg({v}) OVER (PARTITION BY entity) AS gm_{v}, coalesce({v}, 0) - coalesce(avg({v}) OVER (PARTITION BY entity), 0) AS dm_{v}"
            for v in _MUNDLAK
        )
        + " FROM prep",
        " ".join(f"gm_{v} dm_{v}" for v in _MUNDLAK),
        *_PREP_BASE,
    ),
)
def q_mundlak(spark, sf):
    df = prep(spark, sf)
    return finish(df.select("entity", "year", *[c for v in _MUNDLAK for c in (f"gm_{v}", f"dm_{v}")]))


@query(
    "within_demean",
    sql=_sql(
        "SELECT entity, year, "
        + ", ".join(f"coalesce({v}, 0) - coalesce(avg({v}) OVER (PARTITION BY entity), 0) AS {v}_fe" for v in P.FE_VARS)
        + " FROM prep",
        " ".join(f"{v}_fe" for v in P.FE_VARS),
        *_PREP_BASE,
    ),
)
def q_within(spark, sf):
    return finish(prep(spark, sf).select("entity", "year", *[f"{v}_fe" for v in P.FE_VARS]))


# 14 complete cases
_CC = ["log_mean_pat", "tech_prox", "research_novelty", "log_n_papers", "log_mean_pat_lag"]


@query(
    "complete_cases",
    sql=_sql(
        f"SELECT entity, year, {', '.join(_CC)} FROM prep WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _CC),
        " ".join(_CC),
        *_PREP_BASE,
    ),
)
def q_complete_cases(spark, sf):
    return finish(P.complete_cases(prep(spark, sf), ["entity", "year", *_CC]))


# 15 segments
def _seg_values() -> str:
    return ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in S.segments.items())


@query(
    "segment_expand",
    sql=_sql(
        f"SELECT p.entity, p.year, s.segment FROM panel p JOIN (VALUES {_seg_values()}) s(segment, y0, y1) "
        "ON p.year >= s.y0 AND p.year < s.y1",
        "",
        PANEL_CTES,
    ),
)
def q_segment_expand(spark, sf):
    return P.segment_expand(panel(spark, sf), S.segments).select("entity", "year", "segment")


# 16 threshold sweep (counts per threshold)
THRESHOLDS = [round(0.05 * i, 2) for i in range(8)]


def tech_share(c):
    """Fixture stand-in for the domain share swept by thresholds 0..0.35: the cell
    mean discount (about 0.04..0.06) mapped onto [0, 0.4]; the odd offset keeps
    thresholds off exact cell values, so comparisons cannot flip on last bits."""
    return (c - F.lit(0.0401234567)) * F.lit(20.0)


@query(
    "threshold_sweep",
    sql=_sql(
        "SELECT t.threshold, count(p.entity) AS n_rows FROM (VALUES "
        + ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
        + ") t(threshold) LEFT JOIN panel p ON (t.threshold <= 0 OR (p.tech_prox - 0.0401234567) * 20.0 >= t.threshold) GROUP BY t.threshold",
        "threshold",
        PANEL_CTES,
    ),
)
def q_threshold_sweep(spark, sf):
    df = panel(spark, sf).withColumn("tech_scaled", tech_share(F.col("tech_prox")))
    swept = P.threshold_sweep(df, "tech_scaled", THRESHOLDS)
    counts = swept.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_rows"))
    thr = spark.createDataFrame([(float(t),) for t in THRESHOLDS], "threshold double")
    return finish(thr.join(counts, "threshold", "left").select("threshold", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")))


# 17 provenance filter
@query(
    "confirmed_share",
    sql=_sql(
        "SELECT source AS entity, count(*) AS n_docs, sum(CASE WHEN doc_id % 10 <> 0 THEN 1 ELSE 0 END) AS n_confirmed, "
        "avg(CASE WHEN doc_id % 10 <> 0 THEN 1.0 ELSE 0.0 END) AS confirmed_share FROM documents GROUP BY source",
        "confirmed_share",
    ),
)
def q_confirmed_share(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    conf = (F.col("doc_id") % 10 != 0)
    return finish(
        d.groupBy(F.col("source").alias("entity")).agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum(conf.cast("long")).alias("n_confirmed"),
            F.avg(conf.cast("double")).alias("confirmed_share"),
        )
    )


# ---------------------------------------------------------------- aggregates 27-39
DESC_VARS = ["mean_patent_cit", "n_papers", "tech_prox", "research_novelty", "topic_entropy", "intra_cohesion", "oa_share", "is_c9", "is_transport"]


def _desc_sql(by: str = "") -> str:
    parts = []
    for v in DESC_VARS:
        parts.append(
            f"SELECT {by + ', ' if by else ''}'{v}' AS variable, count({v}) AS n, avg(CAST({v} AS DOUBLE)) AS mean, "
            f"stddev_samp(CAST({v} AS DOUBLE)) AS sd, min(CAST({v} AS DOUBLE)) AS min, "
            f"quantile_cont(CAST({v} AS DOUBLE), 0.5) AS median, max(CAST({v} AS DOUBLE)) AS max FROM prep"
            + (f" WHERE {v} IS NOT NULL GROUP BY {by}" if by else f" WHERE {v} IS NOT NULL")
        )
    return " UNION ALL ".join(parts)


@query("descriptives", sql=_sql(_desc_sql(), "mean sd min median max", *_PREP_BASE))
def q_descriptives(spark, sf):
    return finish(D.descriptives(prep(spark, sf), DESC_VARS).select("variable", "n", "mean", "sd", "min", "median", "max"))


@query("desc_by_group", sql=_sql(_desc_sql("inst_type"), "mean sd min median max", *_PREP_BASE))
def q_desc_by_group(spark, sf):
    return finish(D.descriptives(prep(spark, sf), DESC_VARS, by=["inst_type"]).select("inst_type", "variable", "n", "mean", "sd", "min", "median", "max"))


@query(
    "between_means",
    sql=_sql(
        "SELECT entity, avg(log_mean_pat) AS log_mean_pat, avg(topic_entropy) AS topic_entropy, avg(tech_prox) AS tech_prox, "
        "avg(log_n_papers) AS log_n_papers, max(is_c9) AS is_c9, max(log_inst_rank) AS log_inst_rank FROM prep GROUP BY entity",
        "log_mean_pat topic_entropy tech_prox log_n_papers log_inst_rank",
        *_PREP_BASE,
    ),
)
def q_between_means(spark, sf):
    df = prep(spark, sf)
    return finish(
        df.groupBy("entity").agg(
            F.avg("log_mean_pat").alias("log_mean_pat"),
            F.avg("topic_entropy").alias("topic_entropy"),
            F.avg("tech_prox").alias("tech_prox"),
            F.avg("log_n_papers").alias("log_n_papers"),
            F.max("is_c9").alias("is_c9"),
            F.max("log_inst_rank").alias("log_inst_rank"),
        )
    )


@query(
    "sigma_by_year",
    sql=_sql(
        "SELECT year, stddev_samp(log_mean_pat) AS sigma FROM prep GROUP BY year HAVING stddev_samp(log_mean_pat) IS NOT NULL",
        "sigma",
        *_PREP_BASE,
    ),
)
def q_sigma_by_year(spark, sf):
    return finish(D.sigma_by_year(prep(spark, sf), "log_mean_pat"))


@query(
    "sigma_by_region",
    sql=_sql(
        "SELECT inst_type, year, stddev_samp(log_mean_pat) AS sigma FROM prep GROUP BY inst_type, year "
        "HAVING stddev_samp(log_mean_pat) IS NOT NULL",
        "sigma",
        *_PREP_BASE,
    ),
)
def q_sigma_by_region(spark, sf):
    return finish(D.sigma_by_year(prep(spark, sf), "log_mean_pat", by=["inst_type"]))


@query(
    "mean_by_year",
    sql=_sql("SELECT year, avg(log_mean_pat) AS mean_value, count(log_mean_pat) AS n FROM prep GROUP BY year", "mean_value", *_PREP_BASE),
)
def q_mean_by_year(spark, sf):
    return finish(D.mean_by_year(prep(spark, sf), "log_mean_pat"))


@query(
    "state_share",
    sql=_sql(
        "SELECT entity, avg(CASE WHEN state = 2 THEN 1.0 ELSE 0.0 END) AS availability_empirical FROM panel WHERE state >= 0 GROUP BY entity",
        "availability_empirical",
        PANEL_CTES,
    ),
)
def q_state_share(spark, sf):
    p = panel(spark, sf).where(F.col("state") >= 0)
    return finish(p.groupBy("entity").agg(F.avg((F.col("state") == 2).cast("double")).alias("availability_empirical")))


@query(
    "impute_rate",
    sql=_sql("SELECT entity, avg(imputed_share) AS imputation_rate FROM panel GROUP BY entity", "imputation_rate", PANEL_CTES),
)
def q_impute_rate(spark, sf):
    return finish(panel(spark, sf).groupBy("entity").agg(F.avg("imputed_share").alias("imputation_rate")))


@query(
    "low_support",
    sql=_sql(
        "SELECT e.entity, coalesce(c.n, 0) AS n_confirmed, coalesce(c.n, 0) < 5 AS low_support FROM "
        "(SELECT DISTINCT source AS entity FROM documents) e LEFT JOIN "
        "(SELECT source AS entity, count(*) AS n FROM documents WHERE doc_id % 10 <> 0 GROUP BY source) c "
        "ON e.entity = c.entity",
        "",
    ),
)
def q_low_support(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    ents = d.select(F.col("source").alias("entity")).distinct()
    conf = d.where(F.col("doc_id") % 10 != 0).groupBy(F.col("source").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return ents.join(conf, "entity", "left").select("entity", n.alias("n_confirmed"), (n < 5).alias("low_support"))


@query(
    "shannon_entropy",
    sql=_sql(
        "SELECT entity, -sum(p * ln(p)) AS entropy FROM (SELECT entity, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY entity) AS p "
        "FROM (SELECT source AS entity, lang, count(*) AS n FROM documents GROUP BY source, lang)) GROUP BY entity",
        "entropy",
    ),
)
def q_shannon(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("source").alias("entity"), "lang")
    return finish(D.shannon_entropy(d, ["entity"], "lang"))


@query(
    "top_entities",
    sql=_sql("SELECT entity, sum(n_papers) AS total FROM panel WHERE state >= 0 GROUP BY entity ORDER BY total DESC, entity LIMIT 5", "total", PANEL_CTES),
)
def q_top_entities(spark, sf):
    return finish(D.top_k(panel(spark, sf).where(F.col("state") >= 0), "entity", "n_papers", 5))


@query(
    "sig_labels",
    sql=_sql(
        "SELECT entity, year, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' "
        "WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '†' ELSE '' END AS stars, "
        "CASE WHEN (tech_prox - 0.0501234) * (research_novelty - 0.0401234) > 0 THEN '★' ELSE '' END AS interval_flag "
        f"FROM (SELECT *, pow({md5_uniform_sql('entity', 'year', salt='p')}, 4) AS p FROM panel)",
        "",
        PANEL_CTES,
    ),
)
def q_sig_labels(spark, sf):
    from ..functions.columns import excludes_zero

    # values over the whole range of a p-value, so every label occurs
    p = panel(spark, sf).withColumn("p", F.pow(md5_uniform("entity", "year", salt="p"), 4))
    return p.select(
        "entity",
        "year",
        sig_stars(F.col("p")).alias("stars"),
        excludes_zero(F.col("tech_prox") - 0.0501234, F.col("research_novelty") - 0.0401234).alias("interval_flag"),
    )


# ---------------------------------------------------------------- 81b/81c sigma convergence
def _seg_sql() -> str:
    return (
        f"WITH sig AS (SELECT year, stddev_samp(log_mean_pat) AS sigma FROM prep GROUP BY year HAVING stddev_samp(log_mean_pat) IS NOT NULL) "
        f"SELECT s.segment, CAST(s.y0 AS INTEGER) AS year_start, CAST(s.y1 AS INTEGER) AS year_end, "
        "regr_slope(sigma, year) AS slope, "
        "sqrt(greatest(regr_syy(sigma, year) - regr_sxy(sigma, year) * regr_sxy(sigma, year) / regr_sxx(sigma, year), 0) "
        "/ (count(*) - 2) / regr_sxx(sigma, year)) AS se, regr_r2(sigma, year) AS r_squared, count(*) AS n "
        f"FROM sig JOIN (VALUES {_seg_values()}) s(segment, y0, y1) ON sig.year >= s.y0 AND sig.year < s.y1 "
        "GROUP BY s.segment, s.y0, s.y1 HAVING count(*) >= 3"
    )


def sigma_segments_frame(spark, sf):
    from ..operators.convergence import sigma_segments

    return sigma_segments(prep(spark, sf), "log_mean_pat", S.segments)


@query("sigma_segments", sql=R(with_ctes(*_PREP_BASE, body="SELECT * FROM (" + _seg_sql() + ")"), "slope se r_squared"))
def q_sigma_segments(spark, sf):
    return finish(sigma_segments_frame(spark, sf).select("segment", "year_start", "year_end", "slope", "se", "r_squared", "n"))


@query("sigma_segment_tests")
def q_sigma_segment_tests(spark, sf):
    return finish(sigma_segments_frame(spark, sf))


@query(
    "sigma_slope",
    sql=_sql(
        "SELECT regr_slope(sigma, year) AS sigma_slope, regr_r2(sigma, year) AS r_squared, count(*) AS n_years FROM "
        "(SELECT year, stddev_samp(log_mean_pat) AS sigma FROM prep GROUP BY year HAVING stddev_samp(log_mean_pat) IS NOT NULL)",
        "sigma_slope r_squared",
        *_PREP_BASE,
    ),
)
def q_sigma_slope(spark, sf):
    sig = D.sigma_by_year(prep(spark, sf), "log_mean_pat")
    return finish(
        sig.agg(
            F.regr_slope("sigma", "year").alias("sigma_slope"),
            F.regr_r2("sigma", "year").alias("r_squared"),
            F.count(F.lit(1)).alias("n_years"),
        )
    )


# ---------------------------------------------------------------- 46 average ranks (ties share the mean rank)
@query(
    "avg_rank",
    sql=_sql(
        "SELECT entity, year, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS avg_rank FROM ("
        "SELECT entity, year, " + sql_round_sig("mean_patent_cit") + " AS v FROM panel)",
        "avg_rank",
        PANEL_CTES,
    ),
)
def q_avg_rank(spark, sf):
    from ..operators.ranking import average_rank

    p = panel(spark, sf).select("entity", "year", round_sig(F.col("mean_patent_cit")).alias("v"))
    return finish(average_rank(p, "v", "avg_rank").select("entity", "year", "avg_rank"))
