"""Registered queries, part 4: regressions and tests (operators 35, 36, 71-80e,
81a, 113, 115, 118-120)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import sig_stars
from ..functions.stats import normal_two_sided
from ..operators import inference as INF
from ..operators import panel as P
from ..operators.describe import coef_stability
from ..operators.regression import fits_frame, ols
from .common import R, finish, prep
from .oracle import META_CTES, PANEL_CTES, PREP_CTES, with_ctes
from .queries_base import THRESHOLDS, tech_share
from .registry import ORACLES, query

S = P.FIXTURE
_BASE = (PANEL_CTES, META_CTES, PREP_CTES)


def _sql(body: str, doubles: str, *ctes: str) -> str:
    return R(with_ctes(*ctes, body=body), doubles)


def _with_stars(df):
    return df.withColumn("stars", sig_stars(F.col("pvalue")))


FIT_SCHEMA = "variable string, coef double, se double, stat double, pvalue double, ci_lo double, ci_hi double, n bigint, r2 double"


def _first(fits: list):
    """The only fit, or None where the sample was too small for one."""
    return fits[0] if fits else None


def _fits(spark, named: list[tuple], label: str):
    """Coefficient rows with stars of the (label, fit) pairs; no row for a missing fit."""
    frames = [fits_frame(spark, [f], label=lab) for lab, f in named if f is not None]
    if not frames:
        return _with_stars(spark.createDataFrame([], f"{label} string, {FIT_SCHEMA}"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return _with_stars(out)


def _rows(spark, rows: list[dict], schema: str):
    cols = [c.split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(_clean(r.get(c)) for c in cols) for r in rows], schema)


def _clean(v):
    if isinstance(v, (float, np.floating)):
        v = float(v)
        return None if (np.isnan(v) or np.isinf(v)) else v
    if isinstance(v, np.integer):
        return int(v)
    return v


# ------------------------------------------------------------------ 71 simple OLS
@query(
    "ols_simple",
    sql=_sql(
        "SELECT regr_slope(log_mean_pat, tech_prox) AS slope, regr_intercept(log_mean_pat, tech_prox) AS intercept, "
        "regr_r2(log_mean_pat, tech_prox) AS r2, regr_count(log_mean_pat, tech_prox) AS n FROM prep",
        "slope intercept r2",
        *_BASE,
    ),
)
def q_ols_simple(spark, sf):
    df = prep(spark, sf)
    return finish(
        df.agg(
            F.regr_slope("log_mean_pat", "tech_prox").alias("slope"),
            F.regr_intercept("log_mean_pat", "tech_prox").alias("intercept"),
            F.regr_r2("log_mean_pat", "tech_prox").alias("r2"),
            F.regr_count("log_mean_pat", "tech_prox").cast("bigint").alias("n"),
        )
    )


# ------------------------------------------------------------------ 72/73 Mundlak specifications
_MUNDLAK_MEMO: dict = {}


def mundlak_results(spark, sf):
    """All six specifications (driver-side k x k results, reused within a session)."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _MUNDLAK_MEMO:
        return _MUNDLAK_MEMO[key]
    from ..operators.validation import parallel

    df = prep(spark, sf)
    specs = INF.mundlak_specs(list(S.events))
    # the six specifications are independent: fitted as concurrent Spark jobs
    fits = parallel([lambda tv=tv: INF.mundlak_fit(df, tv) for _, tv in specs])
    out = {name: fit for (name, _), fit in zip(specs, fits) if fit is not None}
    _MUNDLAK_MEMO[key] = out
    return out


@query("mundlak_ols")
def q_mundlak_ols(spark, sf):
    res = mundlak_results(spark, sf)
    df = _fits(spark, [({"spec": name}, f) for name, f in res.items()], "spec")
    return finish(df.select("spec", "variable", "coef", "se", "pvalue", "ci_lo", "ci_hi", "stars", "n"))


# ------------------------------------------------------------------ 74 within FE, 75 Hausman
FE_COVS = ["tech_prox", "research_novelty", "log_n_papers", "topic_entropy", "intra_cohesion"]


@query("within_fe")
def q_within_fe(spark, sf):
    fit = INF.within_fit(prep(spark, sf), FE_COVS)
    return finish(_fits(spark, [({"spec": "FE_within"}, fit)], "spec"))


@query(
    "within_fe_slope",
    sql=_sql(
        "SELECT regr_slope(log_mean_pat_fe, tech_prox_fe) AS slope, count(*) AS n FROM (SELECT "
        "coalesce(log_mean_pat, 0) - coalesce(avg(log_mean_pat) OVER (PARTITION BY entity), 0) AS log_mean_pat_fe, "
        "coalesce(tech_prox, 0) - coalesce(avg(tech_prox) OVER (PARTITION BY entity), 0) AS tech_prox_fe FROM prep)",
        "slope",
        *_BASE,
    ),
)
def q_within_fe_slope(spark, sf):
    fits = ols(prep(spark, sf), "log_mean_pat_fe", ["tech_prox_fe"])
    return finish(spark.createDataFrame([(float(f.coef[1]), int(f.n)) for f in fits], "slope double, n bigint"))


@query("hausman")
def q_hausman(spark, sf):
    df = prep(spark, sf)
    fe = INF.within_fit(df, FE_COVS)
    re = INF.mundlak_fit(df, FE_COVS)
    h = INF.hausman(fe, re) if fe is not None and re is not None else {}
    return finish(_rows(spark, [{**h, "variables": ",".join(h.get("variables", []))}], "H double, df bigint, p_value double, variables string"))


# ------------------------------------------------------------------ 76 Chow, 77 placebo, 36 strongest
CHOW_X = ["year", "log_n_papers"]


def chow_frame(spark, sf):
    df = prep(spark, sf).select("log_mean_pat", "tech_prox", "research_novelty", "log_n_papers", "year", "entity").na.drop()
    rows = INF.chow_tests(df, S.events, "log_mean_pat", CHOW_X)
    sdf = _rows(spark, rows, "event string, break_year int, n bigint, n_pre bigint, n_post bigint, f_stat double, p_value double")
    return sdf.withColumn("stars", F.when(F.col("p_value").isNull(), "").otherwise(sig_stars(F.col("p_value"))))


@query("chow_breaks")
def q_chow(spark, sf):
    return finish(chow_frame(spark, sf))


@query("strongest_break")
def q_strongest(spark, sf):
    c = chow_frame(spark, sf).where(F.col("f_stat").isNotNull())
    return finish(c.agg(F.max_by("event", F.struct(F.col("f_stat"), -F.col("break_year"))).alias("event"), F.max("f_stat").alias("f_stat")))


@query("placebo_breaks")
def q_placebo(spark, sf):
    df = prep(spark, sf).select("year", "year_idx", "log_mean_pat", "log_n_papers").na.drop()
    rows = INF.placebo_breaks(df, S.events, "log_mean_pat", ["year_idx", "log_n_papers"])
    return finish(
        _rows(spark, rows, "event string, year int, F_true double, F_placebo_mean double, F_ratio double, perm_p double, n_placebo bigint")
    )


# ------------------------------------------------------------------ 78 ITS
@query("its")
def q_its(spark, sf):
    ev = S.events[S.trend_event]
    df = prep(spark, sf).select("log_mean_pat", "tech_prox", "research_novelty", "log_n_papers", "year", "entity").na.drop()
    df = df.select(
        "log_mean_pat",
        (F.col("year") - S.year_start).cast("double").alias("trend"),
        (F.col("year") >= ev).cast("double").alias("post"),
        ((F.col("year") >= ev).cast("double") * (F.col("year") - ev)).alias("post_trend"),
    )
    fits = ols(df, "log_mean_pat", ["trend", "post", "post_trend"])
    return finish(_fits(spark, [({"model": f"ITS_{S.trend_event}"}, f) for f in fits], "model"))


# ------------------------------------------------------------------ 79 inverted U
INVERTED_U_SCHEMA = "source string, beta_novelty double, beta_novelty_sq double, p_novelty_sq double, optimal_novelty double, supported boolean"


@query("inverted_u")
def q_inverted_u(spark, sf):
    res = mundlak_results(spark, sf)
    fit = res.get("MC_D_Quad")
    source = "MC_D_Quad"
    if fit is None:
        xs = ["research_novelty", "novelty_sq", "tech_prox", "log_n_papers", "year_norm", "is_c9", "is_transport"]
        fit = _first(ols(prep(spark, sf), "log_mean_pat", xs, cov="HC3"))
        source = "OLS_HC3"
    if fit is None:
        return _rows(spark, [], INVERTED_U_SCHEMA)
    b1, b2, p2 = fit.get("research_novelty"), fit.get("novelty_sq"), fit.get("novelty_sq", "p")
    opt = -b1 / (2 * b2) if b2 not in (0.0,) and not np.isnan(b2) else None
    row = {"source": source, "beta_novelty": b1, "beta_novelty_sq": b2, "p_novelty_sq": p2, "optimal_novelty": opt, "supported": bool(b2 < 0 and p2 < 0.05)}
    return finish(_rows(spark, [row], INVERTED_U_SCHEMA))


# ------------------------------------------------------------------ 80 mediation (three strategies)
def _between(spark, sf):
    df = prep(spark, sf)
    return df.groupBy("entity").agg(
        F.avg("log_mean_pat").alias("log_mean_pat"),
        F.avg("topic_entropy").alias("topic_entropy"),
        F.avg("tech_prox").alias("tech_prox"),
        F.avg("log_n_papers").alias("log_n_papers"),
        F.max("is_c9").alias("is_c9"),
        F.max("log_inst_rank").alias("log_inst_rank"),
    ).na.fill(0.0, ["is_c9", "log_n_papers", "log_inst_rank"])  # regressors; a missing mediator or outcome drops the row


# size guards: a strategy runs on more rows than this
MEDIATION_MIN = {"C1_Between_FE": 5, "C2_Pooled": 30, "C3_TV_Prestige": 30}
MEDIATION_SCHEMA = "strategy string, a_coef double, b_coef double, acme double, sobel_z double, beta_within double, beta_between double"


@query("mediation")
def q_mediation(spark, sf):
    return finish(_rows(spark, mediation_rows(_between(spark, sf), prep(spark, sf)), MEDIATION_SCHEMA))


def mediation_rows(between, panel_df) -> list[dict]:
    """One row for each strategy whose sample is large enough and can be fitted."""
    rows = []

    def fitted(name: str, df, models: list[tuple]) -> list | None:
        if df.count() <= MEDIATION_MIN[name]:
            return None
        fits = [_first(ols(df, y, xs, **kw)) for y, xs, kw in models]
        return None if any(f is None for f in fits) else fits

    own = ["is_c9", "log_n_papers", "log_inst_rank"]
    fits = fitted("C1_Between_FE", between.na.drop(subset=["log_mean_pat", "topic_entropy"]), [("topic_entropy", own, {}), ("log_mean_pat", ["topic_entropy", *own], {})])
    if fits:
        a, b = fits
        ac, bc = a.get("is_c9"), b.get("topic_entropy")
        z = INF.sobel(ac, a.get("is_c9", "se"), bc, b.get("topic_entropy", "se"))
        rows.append({"strategy": "C1_Between_FE", "a_coef": ac, "b_coef": bc, "acme": ac * bc, "sobel_z": z})
    by_entity = {"cov": "cluster", "cluster": "entity"}
    xs = ["is_c9", "log_n_papers", "year_norm"]
    sub = panel_df.select("log_mean_pat", "topic_entropy", *xs, "entity").na.drop()
    fits = fitted("C2_Pooled", sub, [("topic_entropy", xs, by_entity), ("log_mean_pat", ["topic_entropy", *xs], by_entity)])
    if fits:
        a, b = fits
        rows.append({"strategy": "C2_Pooled", "a_coef": a.get("is_c9"), "b_coef": b.get("topic_entropy"), "acme": a.get("is_c9") * b.get("topic_entropy")})
    both = ["dm_topic_entropy", "gm_topic_entropy"]
    sub = panel_df.select("log_mean_pat", *both, *xs, "entity").na.drop()
    fits = fitted("C3_TV_Prestige", sub, [("log_mean_pat", [*both, *xs], by_entity)])
    if fits:
        rows.append({"strategy": "C3_TV_Prestige", "beta_within": fits[0].get(both[0]), "beta_between": fits[0].get(both[1])})
    return rows


# ------------------------------------------------------------------ 80c domain sensitivity, 35 stability
def sensitivity_fits(spark, sf):
    df = prep(spark, sf).withColumn("tech_share", tech_share(F.col("tech_prox")))
    thr = spark.createDataFrame([(float(t),) for t in THRESHOLDS], "threshold double")
    swept = df.join(F.broadcast(thr), (thr.threshold <= 0) | (F.col("tech_share") >= thr.threshold))
    sizes = {r["threshold"]: r["n"] for r in swept.groupBy("threshold").agg(F.count(F.lit(1)).alias("n")).collect()}
    feat = ["tech_prox", "research_novelty", "log_n_papers", "year_idx", "oa_share"]
    fits = {f.group[0]: f for f in ols(swept, "log_mean_pat", feat, cov="HC3", by=["threshold"], min_rows=15)}
    rows = []
    for t in THRESHOLDS:
        t = float(t)
        if sizes.get(t, 0) < 20:
            rows.append({"threshold": t, "n_obs": 0})
            continue
        f = fits.get(t)
        if f is None:
            continue
        row = {"threshold": t, "n_obs": f.n}
        for name, key in (("beta_tech", "tech_prox"), ("beta_novelty", "research_novelty"), ("beta_oa", "oa_share")):
            row[name] = f.get(key)
            row[f"{name}_se"] = f.get(key, "se")
        rows.append(row)
    return _rows(
        spark,
        rows,
        "threshold double, n_obs bigint, beta_tech double, beta_tech_se double, beta_novelty double, beta_novelty_se double, beta_oa double, beta_oa_se double",
    )


@query("domain_sensitivity")
def q_domain_sensitivity(spark, sf):
    return finish(sensitivity_fits(spark, sf))


@query(
    "coef_stability",
    sql=_sql(
        """SELECT 'slope_tech' AS variable, count(b) AS n_values, stddev_samp(b) / (abs(avg(b)) + 1e-10) AS cv,
  CASE WHEN stddev_samp(b) / (abs(avg(b)) + 1e-10) < 0.5 THEN 'STABLE' WHEN stddev_samp(b) / (abs(avg(b)) + 1e-10) > 1.0 THEN 'UNSTABLE' ELSE 'MODERATE' END AS status
FROM (SELECT t.threshold, regr_slope(p.log_mean_pat, p.tech_prox) AS b FROM (VALUES """
        + ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
        + """) t(threshold) JOIN prep p ON t.threshold <= 0 OR (p.tech_prox - 0.0401234567) * 20.0 >= t.threshold
      GROUP BY t.threshold HAVING count(*) >= 20) WHERE b IS NOT NULL HAVING count(b) > 1""",
        "cv",
        *_BASE,
    ),
)
def q_coef_stability(spark, sf):
    df = prep(spark, sf).withColumn("tech_share", tech_share(F.col("tech_prox")))
    thr = spark.createDataFrame([(float(t),) for t in THRESHOLDS], "threshold double")
    swept = df.join(F.broadcast(thr), (thr.threshold <= 0) | (F.col("tech_share") >= thr.threshold))
    slopes = swept.groupBy("threshold").agg(F.regr_slope("log_mean_pat", "tech_prox").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 20)
    out = coef_stability(slopes.withColumn("variable", F.lit("slope_tech")), ["variable"], "b")
    return finish(out.select("variable", "n_values", "cv", "status"))


@query("coef_stability_models")
def q_coef_stability_models(spark, sf):
    sens = sensitivity_fits(spark, sf)
    long = sens.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("b")) for c in ("beta_tech", "beta_novelty", "beta_oa")])).alias("s")).select("s.*")
    return finish(coef_stability(long, ["variable"], "b"))


# ------------------------------------------------------------------ 80d first differences, 80e VIF, 119 BP
@query("fd_regression")
def q_fd(spark, sf):
    df = P.first_diff(prep(spark, sf), ["log_mean_pat", "tech_prox", "research_novelty", "log_n_papers"])
    sub = df.select("fd_log_mean_pat", "fd_tech_prox", "fd_research_novelty", "fd_log_n_papers").na.drop()
    fits = ols(sub, "fd_log_mean_pat", ["fd_tech_prox", "fd_research_novelty", "fd_log_n_papers"], cov="HC3", min_rows=21)
    return finish(_with_stars(fits_frame(spark, fits, label={"model": "P2_FD"})))


VIF_COLS = ["tech_prox", "research_novelty", "log_n_papers", "is_c9", "post_BRI", "year_norm"]


@query("vif")
def q_vif(spark, sf):
    v = INF.vif(prep(spark, sf), VIF_COLS)
    return finish(spark.createDataFrame(list(v.items()), "variable string, vif double"))


@query(
    "vif_pair",
    sql=_sql(
        "SELECT 1.0 / (1.0 - pow(corr(tech_prox, research_novelty), 2)) AS vif FROM prep WHERE tech_prox IS NOT NULL AND research_novelty IS NOT NULL",
        "vif",
        *_BASE,
    ),
)
def q_vif_pair(spark, sf):
    v = INF.vif(prep(spark, sf), ["tech_prox", "research_novelty"])
    return finish(spark.createDataFrame([(v["tech_prox"],)], "vif double"))


@query("breusch_pagan")
def q_bp(spark, sf):
    r = INF.breusch_pagan(prep(spark, sf), "log_mean_pat", ["tech_prox", "research_novelty", "log_n_papers"])
    return finish(_rows(spark, [r], "lm double, df bigint, p_value double, n bigint"))


@query(
    "breusch_pagan_one",
    sql=_sql(
        """SELECT count(*) * regr_r2(e2, tech_prox) AS lm, count(*) AS n FROM (
  SELECT tech_prox, pow(log_mean_pat - (regr_intercept(log_mean_pat, tech_prox) OVER () + regr_slope(log_mean_pat, tech_prox) OVER () * tech_prox), 2) AS e2
  FROM prep)""",
        "lm",
        *_BASE,
    ),
)
def q_bp_one(spark, sf):
    r = INF.breusch_pagan(prep(spark, sf), "log_mean_pat", ["tech_prox"])
    return finish(spark.createDataFrame([(float(r["lm"]), int(r["n"]))], "lm double, n bigint"))


# ------------------------------------------------------------------ 118 Poisson QMLE
POISSON_X = ["tech_prox", "research_novelty", "log_n_papers", "year_norm"]


@query("poisson")
def q_poisson(spark, sf):
    df = prep(spark, sf).select("mean_patent_cit", *POISSON_X).na.drop()
    rows = poisson_qmle(df, "mean_patent_cit", POISSON_X)
    return finish(_with_stars(_rows(spark, rows, "variable string, coef double, se double, pvalue double")))


def poisson_qmle(df, y: str, xs: list[str], max_iter: int = 50, tol: float = 1e-10) -> list[dict]:
    """Poisson quasi-maximum likelihood with log link by Newton steps, and the sandwich
    covariance A^-1 B A^-1 (robust to any variance). Each step is one aggregate: the
    gradient, the Hessian A = sum mu x x' and B = sum (y - mu)^2 x x'; only these k x k
    sums reach the driver. Fewer rows than coefficients give an empty result."""
    names = ["const", *xs]
    k = len(names)
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    target = F.col(y).cast("double")
    start = df.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("m")).first()
    if start["n"] <= k or not start["m"] or start["m"] <= 0:
        return []
    b = np.zeros(k)
    b[0] = np.log(start["m"])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(max_iter):
        mu = F.exp(sum((x[i] * F.lit(float(b[i])) for i in range(1, k)), x[0] * F.lit(float(b[0]))))
        got = df.select(target.alias("_y"), mu.alias("_mu"), *[c.alias(f"_x{i}") for i, c in enumerate(x)]).agg(
            *[F.sum((F.col("_y") - F.col("_mu")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(k)],
            *[F.sum(F.col("_mu") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"a{i}_{j}") for i, j in pairs],
            *[F.sum(F.pow(F.col("_y") - F.col("_mu"), 2) * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"b{i}_{j}") for i, j in pairs],
        ).first()
        g = np.array([got[f"g{i}"] for i in range(k)])
        hess, meat = np.zeros((k, k)), np.zeros((k, k))
        for i, j in pairs:
            hess[i, j] = hess[j, i] = got[f"a{i}_{j}"]
            meat[i, j] = meat[j, i] = got[f"b{i}_{j}"]
        inverse = np.linalg.pinv(hess)
        step = inverse @ g
        if np.abs(step).max() < tol * (1 + np.abs(b).max()):
            break
        b = b + step
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
    return [
        {"variable": v, "coef": c, "se": e, "pvalue": normal_two_sided(c / e) if e > 0 else None}
        for v, c, e in zip(names, b.tolist(), se.tolist())
    ]


# ------------------------------------------------------------------ 120 sub-periods, 113 by type, 81a beta convergence, 115 DiD
def _segments_sql() -> str:
    return ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in S.segments.items())


@query(
    "subperiod_ols",
    sql=_sql(
        f"""SELECT s.segment, regr_slope(p.log_mean_pat, p.tech_prox) AS slope, regr_intercept(p.log_mean_pat, p.tech_prox) AS intercept,
  regr_r2(p.log_mean_pat, p.tech_prox) AS r2, count(*) AS n
FROM prep p JOIN (VALUES {_segments_sql()}) s(segment, y0, y1) ON p.year >= s.y0 AND p.year < s.y1 GROUP BY s.segment""",
        "slope intercept r2",
        *_BASE,
    ),
)
def q_subperiod(spark, sf):
    seg = P.segment_expand(prep(spark, sf), S.segments)
    return finish(
        seg.groupBy("segment").agg(
            F.regr_slope("log_mean_pat", "tech_prox").alias("slope"),
            F.regr_intercept("log_mean_pat", "tech_prox").alias("intercept"),
            F.regr_r2("log_mean_pat", "tech_prox").alias("r2"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query(
    "slope_by_type",
    sql=_sql(
        "SELECT inst_type, regr_slope(log_mean_pat, tech_prox) AS elasticity, regr_count(log_mean_pat, tech_prox) AS n FROM prep GROUP BY inst_type",
        "elasticity",
        *_BASE,
    ),
)
def q_slope_by_type(spark, sf):
    return finish(
        prep(spark, sf).groupBy("inst_type").agg(
            F.regr_slope("log_mean_pat", "tech_prox").alias("elasticity"), F.regr_count("log_mean_pat", "tech_prox").cast("bigint").alias("n")
        )
    )


@query(
    "beta_convergence",
    sql=_sql(
        "SELECT regr_slope(d, lagv) AS beta_conv, regr_intercept(d, lagv) AS intercept, count(*) AS n FROM ("
        "SELECT log_mean_pat - log_mean_pat_lag AS d, log_mean_pat_lag AS lagv FROM prep WHERE log_mean_pat_lag IS NOT NULL)",
        "beta_conv intercept",
        *_BASE,
    ),
)
def q_beta_conv(spark, sf):
    df = prep(spark, sf).where(F.col("log_mean_pat_lag").isNotNull()).select(
        (F.col("log_mean_pat") - F.col("log_mean_pat_lag")).alias("d"), F.col("log_mean_pat_lag").alias("lagv")
    )
    return finish(df.agg(F.regr_slope("d", "lagv").alias("beta_conv"), F.regr_intercept("d", "lagv").alias("intercept"), F.count(F.lit(1)).alias("n")))


@query("beta_convergence_test")
def q_beta_conv_test(spark, sf):
    df = prep(spark, sf).where(F.col("log_mean_pat_lag").isNotNull()).select(
        (F.col("log_mean_pat") - F.col("log_mean_pat_lag")).alias("delta_log_pat"), F.col("log_mean_pat_lag").alias("log_pat_lag")
    )
    fits = ols(df, "delta_log_pat", ["log_pat_lag"], cov="HC3", min_rows=21)
    out = fits_frame(spark, fits, label={"model": "beta_convergence"})
    return finish(out.withColumn("supported", (F.col("variable") == "log_pat_lag") & (F.col("coef") < 0) & (F.col("pvalue") < 0.05)))


@query(
    "did",
    sql=_sql(
        """SELECT (t1 - t0) - (c1 - c0) AS did, t0, t1, c0, c1 FROM (
  SELECT avg(CASE WHEN is_east = 1 AND year < 1998 THEN log_mean_pat END) AS t0, avg(CASE WHEN is_east = 1 AND year >= 1998 THEN log_mean_pat END) AS t1,
         avg(CASE WHEN is_east = 0 AND year < 1998 THEN log_mean_pat END) AS c0, avg(CASE WHEN is_east = 0 AND year >= 1998 THEN log_mean_pat END) AS c1
  FROM prep)""",
        "did t0 t1 c0 c1",
        *_BASE,
    ),
)
def q_did(spark, sf):
    ev = S.events["MiC2025"]
    df = prep(spark, sf)
    cell = lambda t, post: F.avg(F.when((F.col("is_east") == t) & ((F.col("year") >= ev) == post), F.col("log_mean_pat")))
    g = df.agg(cell(1, False).alias("t0"), cell(1, True).alias("t1"), cell(0, False).alias("c0"), cell(0, True).alias("c1"))
    return finish(g.select(((F.col("t1") - F.col("t0")) - (F.col("c1") - F.col("c0"))).alias("did"), "t0", "t1", "c0", "c1"))


def _rss_sql(cond: str) -> str:
    """RSS of y on (1, year, log_n_papers) over the rows matching ``cond``, from
    centred second moments (closed form of the 2 x 2 solve)."""
    m = lambda a, b: f"covar_pop({a}, {b}) * count(*)"
    s11, s22, s12 = m("year", "year"), m("log_n_papers", "log_n_papers"), m("year", "log_n_papers")
    s1y, s2y, syy = m("year", "log_mean_pat"), m("log_n_papers", "log_mean_pat"), m("log_mean_pat", "log_mean_pat")
    return (
        f"(SELECT {syy} - ({s22} * pow({s1y}, 2) - 2 * {s12} * {s1y} * {s2y} + {s11} * pow({s2y}, 2)) / ({s11} * {s22} - pow({s12}, 2)) "
        f"FROM cb WHERE {cond})"
    )


_EVENTS_SQL = ", ".join(f"('{e}', {y})" for e, y in S.events.items())


_CB_CTE = (
    "cb AS (SELECT CAST(year AS DOUBLE) AS year, log_n_papers, log_mean_pat FROM prep WHERE log_mean_pat IS NOT NULL "
    "AND tech_prox IS NOT NULL AND research_novelty IS NOT NULL AND log_n_papers IS NOT NULL AND entity IS NOT NULL)"
)
_CHOW_BODY = f"""SELECT e.event, CAST(e.b AS INTEGER) AS break_year,
  CASE WHEN (SELECT count(*) FROM cb WHERE year < e.b) >= 5 AND (SELECT count(*) FROM cb WHERE year >= e.b) >= 5 THEN
    (({_rss_sql('true')} - {_rss_sql('year < e.b')} - {_rss_sql('year >= e.b')}) / 3.0)
    / (({_rss_sql('year < e.b')} + {_rss_sql('year >= e.b')}) / ((SELECT count(*) FROM cb) - 6)) END AS f_stat
FROM (VALUES {_EVENTS_SQL}) e(event, b)"""


@query("chow_f", sql=_sql(_CHOW_BODY, "f_stat", *_BASE, _CB_CTE))
def q_chow_f(spark, sf):
    """The Chow F statistics of ``chow_breaks`` (year-Gram sums), SQL-checked."""
    return finish(chow_frame(spark, sf).select("event", "break_year", "f_stat"))


# the strongest break is an arg-max over the same F statistics: SQL-checkable too
ORACLES["strongest_break"] = _sql(
    f"SELECT arg_max(event, struct_pack(f := f_stat, b := -break_year)) AS event, max(f_stat) AS f_stat FROM ({_CHOW_BODY}) WHERE f_stat IS NOT NULL",
    "f_stat",
    *_BASE,
    _CB_CTE,
)
