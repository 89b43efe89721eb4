"""Registered queries, part 2: state transitions, durations, reliability and
their robustness checks (operators 32, 49, 82-89, 112, 116)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import md5_uniform_sql
from ..operators import panel as P
from ..operators import transitions as TR
from ..operators.ranking import average_rank
from .common import R, finish, meta, panel, prep, round_sig, sql_round_sig
from .oracle import META_CTES, PANEL_CTES, PREP_CTES, with_ctes
from .registry import query

S = P.FIXTURE
N_BOOT = 500
LOW_IMPUTATION = 0.5  # fixture: imputed_share (open-line share) centres on 0.5, the reference's 0.30 would keep nobody

GRID = "(VALUES (0,0),(0,1),(0,2),(1,0),(1,1),(1,2),(2,0),(2,1),(2,2)) g(s_from, s_to)"

TRANS_CTES = """
tr_obs AS (
  SELECT entity, year, state AS s_from, lead(state) OVER (PARTITION BY entity ORDER BY year) AS s_to
  FROM panel WHERE state >= 0
),
tr_pairs AS (SELECT entity, year, s_from, s_to FROM tr_obs WHERE s_to IS NOT NULL),
tr_counts AS (SELECT s_from, s_to, count(*) AS n FROM tr_pairs GROUP BY s_from, s_to),
tr_full AS (
  SELECT g.s_from, g.s_to, coalesce(c.n, 0) AS n FROM """ + GRID + """ LEFT JOIN tr_counts c ON g.s_from = c.s_from AND g.s_to = c.s_to
),
tr_mat AS (
  SELECT s_from, s_to, n, sum(n) OVER (PARTITION BY s_from) AS row_n,
         CASE WHEN sum(n) OVER (PARTITION BY s_from) > 0 THEN n / sum(n) OVER (PARTITION BY s_from) ELSE 1.0 / 3 END AS p
  FROM tr_full
)"""

SOJ_CTES = f"""
sj_f AS (
  SELECT entity, year, state AS s,
         CASE WHEN lag(state) OVER (PARTITION BY entity ORDER BY year) IS NULL
                OR lag(state) OVER (PARTITION BY entity ORDER BY year) <> state THEN 1 ELSE 0 END AS chg
  FROM panel
),
sj_i AS (SELECT entity, year, s, sum(chg) OVER (PARTITION BY entity ORDER BY year ROWS UNBOUNDED PRECEDING) AS isl FROM sj_f),
sj_g AS (SELECT entity, isl, max(s) AS s, min(year) AS start FROM sj_i GROUP BY entity, isl),
sj_n AS (
  SELECT *, lead(s) OVER (PARTITION BY entity ORDER BY isl) AS next_s, lead(start) OVER (PARTITION BY entity ORDER BY isl) AS next_start
  FROM sj_g
),
sojourn AS (
  SELECT entity, s AS from_state, next_s AS to_state, CAST(next_start - start AS INTEGER) AS sojourn_len, start AS year_start
  FROM sj_n WHERE s >= 0 AND next_s >= 0
  UNION ALL
  SELECT entity, s AS from_state, -1 AS to_state, CAST({S.year_end} - start + 1 AS INTEGER) AS sojourn_len, start AS year_start
  FROM sj_n WHERE s >= 0 AND next_s IS NULL
)"""

RATE_CTES = """
rt_exp AS (SELECT from_state AS s_from, sum(sojourn_len) AS exposure FROM sojourn WHERE from_state BETWEEN 0 AND 2 GROUP BY from_state),
rt_raw AS (
  SELECT g.s_from, g.s_to, CAST(coalesce(c.n, 0) AS DOUBLE) AS n, CAST(coalesce(e.exposure, 0) AS DOUBLE) AS exposure
  FROM """ + GRID + """ LEFT JOIN tr_counts c ON g.s_from = c.s_from AND g.s_to = c.s_to LEFT JOIN rt_exp e ON g.s_from = e.s_from
),
rates AS (
  SELECT s_from, s_to, n, exposure,
         CASE WHEN s_from <> s_to THEN sqrt(1 + n) / (2 + exposure) ELSE 0.0 END AS q_sd,
         CASE WHEN s_from <> s_to THEN (1 + n) / (2 + exposure)
              ELSE -sum(CASE WHEN s_from <> s_to THEN (1 + n) / (2 + exposure) END) OVER (PARTITION BY s_from) END AS q_mean
  FROM rt_raw
)"""


def _sql(body: str, doubles: str, *ctes: str) -> str:
    return R(with_ctes(*ctes, body=body), doubles)


def _counts(spark, sf):
    return TR.transition_counts(panel(spark, sf))


def _sojourns(spark, sf):
    return TR.sojourns(panel(spark, sf), S.year_end)


def _rates(spark, sf):
    return TR.ctmc_rates(_counts(spark, sf), _sojourns(spark, sf))


@query("transition_counts", sql=_sql("SELECT s_from, s_to, n FROM tr_counts", "", PANEL_CTES, TRANS_CTES))
def q_transition_counts(spark, sf):
    return _counts(spark, sf).select("s_from", "s_to", "n")


@query("transition_matrix", sql=_sql("SELECT s_from, s_to, n, row_n, p FROM tr_mat", "p", PANEL_CTES, TRANS_CTES))
def q_transition_matrix(spark, sf):
    return finish(TR.normalise_rows(_counts(spark, sf)).select("s_from", "s_to", "n", "row_n", "p"))


@query("sojourn", sql=_sql("SELECT * FROM sojourn", "", PANEL_CTES, SOJ_CTES))
def q_sojourn(spark, sf):
    return _sojourns(spark, sf).select("entity", "from_state", "to_state", "sojourn_len", "year_start")


@query("ctmc_rates", sql=_sql("SELECT s_from, s_to, n, exposure, q_mean, q_sd FROM rates", "n exposure q_mean q_sd", PANEL_CTES, TRANS_CTES, SOJ_CTES, RATE_CTES))
def q_ctmc_rates(spark, sf):
    return finish(_rates(spark, sf).select("s_from", "s_to", "n", "exposure", "q_mean", "q_sd"))


def _rates_by_type(spark, sf):
    """Rates for all entities ('all') and per entity type, as one grouped table."""
    p = panel(spark, sf).join(meta(spark, sf).select("entity", "type"), "entity", "left")
    overall = TR.ctmc_rates(TR.transition_counts(p), TR.sojourns(p, S.year_end)).withColumn("grp", F.lit("all"))
    pairs = TR.transition_pairs(p.select("entity", "year", "state")).join(p.select("entity", "type").distinct(), "entity")
    cnt = pairs.groupBy(F.col("type").alias("grp"), "s_from", "s_to").agg(F.count(F.lit(1)).alias("n"))
    soj = TR.sojourns(p, S.year_end).join(p.select("entity", "type").distinct(), "entity").withColumnRenamed("type", "grp")
    by_type = TR.ctmc_rates(cnt, soj, by=["grp"])
    return overall.unionByName(by_type.select(*overall.columns))


@query("reliability")
def q_reliability(spark, sf):
    return finish(TR.reliability(_rates_by_type(spark, sf)))


@query(
    "reliability_closed",
    sql=_sql(
        "SELECT (q21 + q10 + q12) / ((q10 + q12) * (q20 + q21) - q12 * q21) AS mttf, "
        "(q01 + q10 + q12) / ((q01 + q02) * (q10 + q12) - q01 * q10) AS mttr FROM ("
        + "SELECT "
        + ", ".join(f"max(CASE WHEN s_from = {i} AND s_to = {j} THEN q_mean END) AS q{i}{j}" for i in range(3) for j in range(3) if i != j)
        + " FROM rates)",
        "mttf mttr",
        PANEL_CTES,
        TRANS_CTES,
        SOJ_CTES,
        RATE_CTES,
    ),
)
def q_reliability_closed(spark, sf):
    return finish(TR.closed_form_mttf_mttr(_rates(spark, sf)))


_TOP5 = "top5 AS (SELECT entity FROM panel WHERE state >= 0 GROUP BY entity ORDER BY sum(n_papers) DESC, entity LIMIT 5)"


@query(
    "transition_loo",
    sql=_sql(
        """SELECT excluded, s_from, s_to, n, p, max(abs(p - p_full)) OVER (PARTITION BY excluded) AS max_abs_change FROM (
  SELECT l.excluded, l.s_from, l.s_to, l.n,
         CASE WHEN sum(l.n) OVER (PARTITION BY l.excluded, l.s_from) > 0 THEN l.n / sum(l.n) OVER (PARTITION BY l.excluded, l.s_from) ELSE 1.0 / 3 END AS p,
         m.p AS p_full
  FROM (
    SELECT t.entity AS excluded, g.s_from, g.s_to,
           (SELECT count(*) FROM tr_pairs q WHERE q.entity <> t.entity AND q.s_from = g.s_from AND q.s_to = g.s_to) AS n
    FROM top5 t, """ + GRID + """
  ) l JOIN tr_mat m ON l.s_from = m.s_from AND l.s_to = m.s_to)""",
        "p max_abs_change",
        PANEL_CTES,
        TRANS_CTES,
        _TOP5,
    ),
)
def q_transition_loo(spark, sf):
    from ..operators.describe import top_k

    p = panel(spark, sf)
    top = top_k(p.where(F.col("state") >= 0), "entity", "n_papers", 5).select("entity")
    return finish(TR.leave_one_out(p, top))


_BOOT_SQL = f"""
bt_ents AS (SELECT DISTINCT entity FROM panel WHERE state >= 0),
bt_idx AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS idx FROM bt_ents),
bt_n AS (SELECT count(*) AS n_ent FROM bt_ents),
bt_slots AS (SELECT r.rep, unnest(range(b.n_ent)) AS slot, b.n_ent FROM range({N_BOOT}) r(rep), bt_n b),
bt_picks AS (SELECT rep, CAST(floor({md5_uniform_sql('rep', 'slot', salt='boot')} * n_ent) AS BIGINT) AS idx FROM bt_slots),
bt_ec AS (SELECT entity, s_from, s_to, count(*) AS n FROM tr_pairs GROUP BY entity, s_from, s_to),
bt_counts AS (
  SELECT p.rep, e.s_from, e.s_to, sum(e.n) AS n FROM bt_picks p JOIN bt_idx i ON p.idx = i.idx JOIN bt_ec e ON i.entity = e.entity
  GROUP BY p.rep, e.s_from, e.s_to
),
bt_full AS (
  SELECT r.rep, g.s_from, g.s_to, coalesce(c.n, 0) AS n FROM range({N_BOOT}) r(rep) CROSS JOIN {GRID}
  LEFT JOIN bt_counts c ON c.rep = r.rep AND c.s_from = g.s_from AND c.s_to = g.s_to
),
bt_mat AS (
  SELECT rep, s_from, s_to,
         CASE WHEN sum(n) OVER (PARTITION BY rep, s_from) > 0 THEN n / sum(n) OVER (PARTITION BY rep, s_from) ELSE 1.0 / 3 END AS p
  FROM bt_full
)"""


@query(
    "transition_bootstrap",
    sql=_sql(
        "SELECT s_from, s_to, quantile_cont(p, 0.025) AS p_lo, quantile_cont(p, 0.975) AS p_hi, avg(p) AS p_mean FROM bt_mat GROUP BY s_from, s_to",
        "p_lo p_hi p_mean",
        PANEL_CTES,
        TRANS_CTES,
        _BOOT_SQL,
    ),
)
def q_transition_bootstrap(spark, sf):
    boot = TR.bootstrap_matrices(panel(spark, sf), N_BOOT)
    return finish(TR.percentile_band(boot))


def _spearman_frame(df, x, y):
    ranked = average_rank(average_rank(df, x, "_rx"), y, "_ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


@query(
    "subsample_spearman",
    sql=_sql(
        f"""SELECT f.n AS n_full, f.rho AS rho_full, s.n AS n_sub, CASE WHEN s.n >= 30 THEN s.rho END AS rho_sub FROM
(SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
   SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
          rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ss_act)) f,
(SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
   SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
          rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
   FROM ss_act WHERE entity IN (SELECT entity FROM ss_imp WHERE r <= {LOW_IMPUTATION}))) s""",
        "rho_full rho_sub",
        PANEL_CTES,
        "ss_imp AS (SELECT entity, avg(imputed_share) AS r FROM panel GROUP BY entity)",
        f"ss_act AS (SELECT entity, {sql_round_sig('coalesce(tech_prox, 0)')} AS x, {sql_round_sig('mean_patent_cit')} AS y FROM panel WHERE state >= 0)",
    ),
)
def q_subsample_spearman(spark, sf):
    p = panel(spark, sf)
    imp = p.groupBy("entity").agg(F.avg("imputed_share").alias("r"))
    # values are canonicalised before ranking: cells equal up to float noise must tie
    act = p.where(F.col("state") >= 0).select(
        "entity", round_sig(F.coalesce("tech_prox", F.lit(0.0))).alias("x"), round_sig(F.col("mean_patent_cit")).alias("y")
    )
    sub = act.join(imp.where(F.col("r") <= LOW_IMPUTATION).select("entity"), "entity", "left_semi")
    full = _spearman_frame(act, "x", "y").select(F.col("n").alias("n_full"), F.col("rho").alias("rho_full"))
    subr = _spearman_frame(sub, "x", "y").select(F.col("n").alias("n_sub"), F.when(F.col("n") >= 30, F.col("rho")).alias("rho_sub"))
    return finish(full.select("n_full", "rho_full", subr.select("n_sub").scalar().alias("n_sub"), subr.select("rho_sub").scalar().alias("rho_sub")))


@query(
    "transition_posterior",
    sql=_sql(
        "SELECT s_from, s_to, n, (n + 1.0) / (row_n + 3.0) AS p_mean, "
        "sqrt((n + 1.0) * (row_n + 3.0 - n - 1.0) / ((row_n + 3.0) * (row_n + 3.0) * (row_n + 4.0))) AS p_sd FROM tr_mat",
        "p_mean p_sd",
        PANEL_CTES,
        TRANS_CTES,
    ),
)
def q_transition_posterior(spark, sf):
    return finish(TR.dirichlet_posterior(_counts(spark, sf)))


def _steady_sql() -> str:
    m = "SELECT " + ", ".join(f"max(CASE WHEN s_from = {i} AND s_to = {j} THEN (n + 1.0) / (row_n + 3.0) END) AS p{i}{j}" for i in range(3) for j in range(3)) + " FROM tr_mat"
    return (
        "SELECT m0 / (m0 + m1 + m2) AS pi_low, m1 / (m0 + m1 + m2) AS pi_medium, m2 / (m0 + m1 + m2) AS pi_high FROM ("
        "SELECT (1 - p11) * (1 - p22) - p12 * p21 AS m0, (1 - p00) * (1 - p22) - p02 * p20 AS m1, (1 - p00) * (1 - p11) - p01 * p10 AS m2 FROM ("
        + m
        + "))"
    )


@query("steady_state", sql=_sql(_steady_sql(), "pi_low pi_medium pi_high", PANEL_CTES, TRANS_CTES))
def q_steady_state(spark, sf):
    return finish(TR.steady_state(TR.dirichlet_posterior(_counts(spark, sf)), "p_mean"))


@query(
    "persistence",
    sql=_sql(
        "SELECT (SELECT p FROM tr_mat WHERE s_from = 2 AND s_to = 2) AS stay_high, (SELECT p FROM tr_mat WHERE s_from = 0 AND s_to = 0) AS stay_low, "
        "(SELECT p FROM tr_mat WHERE s_from = 2 AND s_to = 2) - (SELECT p FROM tr_mat WHERE s_from = 0 AND s_to = 0) AS persistence_gap, "
        "(SELECT avg(log_mean_pat) FROM prep WHERE high_state_lag = 1) AS mean_y_after_high, "
        "(SELECT avg(log_mean_pat) FROM prep WHERE high_state_lag = 0) AS mean_y_after_other",
        "stay_high stay_low persistence_gap mean_y_after_high mean_y_after_other",
        PANEL_CTES,
        TRANS_CTES,
        META_CTES,
        PREP_CTES,
    ),
)
def q_persistence(spark, sf):
    mat = TR.normalise_rows(_counts(spark, sf))
    cell = lambda i: mat.where((F.col("s_from") == i) & (F.col("s_to") == i)).select("p").scalar()
    pr = prep(spark, sf)
    m_hi = pr.where(F.col("high_state_lag") == 1).agg(F.avg("log_mean_pat")).scalar()
    m_lo = pr.where(F.col("high_state_lag") == 0).agg(F.avg("log_mean_pat")).scalar()
    one = spark.range(1)
    return finish(
        one.select(
            cell(2).alias("stay_high"),
            cell(0).alias("stay_low"),
            (cell(2) - cell(0)).alias("persistence_gap"),
            m_hi.alias("mean_y_after_high"),
            m_lo.alias("mean_y_after_other"),
        )
    )
