"""Registered queries, part 3: spatial weights, lags, Moran's I and the
distance-versus-difference study, on the place table (operators 22, 25, 47,
67-70, 109, 110, 114)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import md5_uniform_sql
from ..functions.stats import t_pvalue
from ..operators import spatial as SP
from ..operators.ranking import average_rank, percentile_row
from . import fixtures
from .common import R, finish, prep, round_sig, sql_round_sig
from .oracle import META_CTES, PANEL_CTES, PREP_CTES, with_ctes
from .registry import query

N_PERM = 999
ALPHAS = {"geo": 1 / 3, "type": 1 / 3, "region": 1 / 3, "text": 0.0}  # text channel weight 0, as in the reference's combination

PLACE_CTES = """
places AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS place, n.n_name AS name,
         CAST((n.n_nationkey * 37) % 120 - 60 AS DOUBLE) AS lat, CAST((n.n_nationkey * 73) % 360 - 180 AS DOUBLE) AS lon,
         r.r_name AS region,
         (CASE WHEN (n.n_nationkey * 37) % 120 - 60 >= 0 THEN 'N' ELSE 'S' END) || (CASE WHEN (n.n_nationkey * 73) % 360 - 180 >= 0 THEN 'E' ELSE 'W' END) AS quadrant
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
pairs AS (
  SELECT a.place AS place_i, b.place AS place_j, a.region AS region_i, b.region AS region_j,
         2 * 6371.0 * asin(sqrt(least(greatest(
           pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
           + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 0.0), 1.0))) AS distance_km
  FROM places a JOIN places b ON a.place <> b.place
),
w_geo AS (SELECT place_i AS i, place_j AS j, 1.0 / distance_km AS w FROM pairs WHERE distance_km > 0),
w_type AS (SELECT a.place AS i, b.place AS j, 1.0 AS w FROM places a JOIN places b ON a.region = b.region AND a.place <> b.place),
w_region AS (SELECT a.place AS i, b.place AS j, 1.0 AS w FROM places a JOIN places b ON a.quadrant = b.quadrant AND a.place <> b.place),
wn_geo AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w_geo),
wn_type AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w_type),
wn_region AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w_region),
w_combo0 AS (
  SELECT i, j, sum(w) AS w FROM (
    SELECT i, j, w / 3.0 AS w FROM wn_geo UNION ALL SELECT i, j, w / 3.0 FROM wn_type UNION ALL SELECT i, j, w / 3.0 FROM wn_region
  ) GROUP BY i, j
),
w_combo AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w_combo0)"""

PLACE_Y_CTES = """
ent_place AS (SELECT s_suppkey AS entity, CAST(s_nationkey AS BIGINT) AS place FROM supplier),
place_y AS (SELECT e.place, avg(p.log_mean_pat) AS y FROM prep p JOIN ent_place e ON p.entity = e.entity GROUP BY e.place),
place_year_y AS (SELECT e.place, p.year, avg(p.log_mean_pat) AS y FROM prep p JOIN ent_place e ON p.entity = e.entity GROUP BY e.place, p.year)"""

_BASE = (PANEL_CTES, META_CTES, PREP_CTES, PLACE_CTES, PLACE_Y_CTES)


def _sql(body: str, doubles: str, *ctes: str) -> str:
    return R(with_ctes(*ctes, body=body), doubles)


def _places(spark, sf):
    return fixtures.places(spark, sf)


def _weights(spark, sf):
    pl = _places(spark, sf)
    return {"geo": SP.weights_inverse_distance(pl), "type": SP.weights_same(pl, "region"), "region": SP.weights_same(pl, "quadrant")}


def _place_y(spark, sf, by_year: bool = False):
    ep = fixtures.entity_place(spark, sf)
    keys = ["place", "year"] if by_year else ["place"]
    return prep(spark, sf).join(ep, "entity").groupBy(*keys).agg(F.avg("log_mean_pat").alias("y"))


@query(
    "haversine",
    sql=_sql("SELECT place_i, place_j, distance_km FROM pairs WHERE place_i < place_j", "distance_km", PLACE_CTES),
)
def q_haversine(spark, sf):
    return finish(SP.place_pairs(_places(spark, sf)).select("place_i", "place_j", "distance_km"))


@query(
    "spatial_pairs",
    sql=_sql(
        "SELECT p.place_i, p.place_j, p.distance_km, abs(a.y - b.y) AS delta_pat, CAST(p.region_i = p.region_j AS INTEGER) AS same_region "
        "FROM pairs p JOIN place_y a ON p.place_i = a.place JOIN place_y b ON p.place_j = b.place WHERE p.place_i < p.place_j",
        "distance_km delta_pat",
        *_BASE,
    ),
)
def q_spatial_pairs(spark, sf):
    return finish(_pair_table(spark, sf))


def _pair_table(spark, sf):
    y = _place_y(spark, sf)
    pairs = SP.place_pairs(_places(spark, sf))
    out = (
        pairs.join(y.select(F.col("place").alias("place_i"), F.col("y").alias("y_i")), "place_i")
        .join(y.select(F.col("place").alias("place_j"), F.col("y").alias("y_j")), "place_j")
        .select(
            "place_i",
            "place_j",
            "distance_km",
            F.abs(F.col("y_i") - F.col("y_j")).alias("delta_pat"),
            (F.col("region_i") == F.col("region_j")).cast("int").alias("same_region"),
        )
    )
    return out.na.drop(subset=["delta_pat"])


def _w_query(kind: str):
    @query(f"w_{kind}", sql=_sql(f"SELECT i, j, w FROM wn_{kind}", "w", PLACE_CTES))
    def _q(spark, sf, kind=kind):
        return finish(SP.row_normalise(_weights(spark, sf)[kind]))

    return _q


for _k in ("geo", "type", "region"):
    _w_query(_k)


@query("w_combo", sql=_sql("SELECT i, j, w FROM w_combo", "w", PLACE_CTES))
def q_w_combo(spark, sf):
    return finish(SP.combine(_weights(spark, sf), ALPHAS))


@query("row_norm", sql=_sql("SELECT i, sum(w) AS row_sum, count(*) AS n_links FROM wn_geo GROUP BY i", "row_sum", PLACE_CTES))
def q_row_norm(spark, sf):
    w = SP.row_normalise(_weights(spark, sf)["geo"])
    return finish(w.groupBy("i").agg(F.sum("w").alias("row_sum"), F.count(F.lit(1)).alias("n_links")))


@query(
    "spatial_lag",
    sql=_sql("SELECT w.i AS place, sum(w.w * y.y) AS lag FROM wn_geo w JOIN place_y y ON w.j = y.place GROUP BY w.i", "lag", *_BASE),
)
def q_spatial_lag(spark, sf):
    w = SP.row_normalise(_weights(spark, sf)["geo"])
    return finish(SP.spatial_lag(w, _place_y(spark, sf), "place", "y").select(F.col("i").alias("place"), "lag"))


@query(
    "spatial_lag_panel",
    sql=_sql(
        "SELECT e.entity, l.year, l.geo_lag FROM (SELECT w.i AS place, y.year, sum(w.w * y.y) AS geo_lag FROM wn_geo w JOIN place_year_y y "
        "ON w.j = y.place GROUP BY w.i, y.year) l JOIN ent_place e ON l.place = e.place JOIN panel p ON p.entity = e.entity AND p.year = l.year",
        "geo_lag",
        *_BASE,
    ),
)
def q_spatial_lag_panel(spark, sf):
    w = SP.row_normalise(_weights(spark, sf)["geo"])
    lag = SP.spatial_lag(w, _place_y(spark, sf, by_year=True), "place", "y", by=["year"]).select(F.col("i").alias("place"), "year", F.col("lag").alias("geo_lag"))
    cells = fixtures.panel(spark, sf).select("entity", "year").join(fixtures.entity_place(spark, sf), "entity")
    return finish(cells.join(lag, ["place", "year"]).select("entity", "year", "geo_lag"))


_MORAN_CTES = """
mz AS (SELECT place AS id, y - avg(y) OVER () AS z FROM place_y WHERE y IS NOT NULL),
mstat AS (SELECT count(*) AS n, sum(z * z) AS zz FROM mz),
ms0 AS (SELECT sum(w) AS s0 FROM wn_geo),
mcross AS (SELECT sum(w.w * a.z * b.z) AS c FROM wn_geo w JOIN mz a ON w.i = a.id JOIN mz b ON w.j = b.id),
mobs AS (
  SELECT n, CASE WHEN zz >= 1e-12 AND s0 >= 1e-12 THEN n * c / (zz * s0) ELSE 0.0 END AS I, -1.0 / (n - 1) AS E_I, s0, zz
  FROM mstat, ms0, mcross
)"""


@query("morans_i", sql=_sql("SELECT n, I, E_I FROM mobs", "I E_I", *_BASE, _MORAN_CTES))
def q_morans_i(spark, sf):
    w = SP.row_normalise(_weights(spark, sf)["geo"])
    return finish(SP.morans_i(w, _place_y(spark, sf), "place", "y").select("n", "I", "E_I"))


_PERM_CTES = f"""
mpos AS (SELECT id, z, row_number() OVER (ORDER BY id) AS src_pos FROM mz),
mper AS (
  SELECT m.id, r.b, row_number() OVER (PARTITION BY r.b ORDER BY {md5_uniform_sql('r.b', 'm.id', salt='perm')}, m.id) AS src_pos
  FROM mz m, range({N_PERM}) r(b)
),
mperz AS (SELECT p.b, p.id, q.z AS zp FROM mper p JOIN mpos q ON p.src_pos = q.src_pos),
mperm AS (
  SELECT a.b, CASE WHEN (SELECT zz FROM mobs) >= 1e-12 AND (SELECT s0 FROM mobs) >= 1e-12
                   THEN (SELECT n FROM mobs) * sum(w.w * a.zp * c.zp) / ((SELECT zz FROM mobs) * (SELECT s0 FROM mobs)) ELSE 0.0 END AS I_perm
  FROM wn_geo w JOIN mperz a ON w.i = a.id JOIN mperz c ON w.j = c.id AND a.b = c.b GROUP BY a.b
),
mpstat AS (SELECT avg(I_perm) AS m, stddev_pop(I_perm) AS sd FROM mperm)"""


@query(
    "morans_perm",
    sql=_sql(
        "SELECT o.n, o.I, o.E_I, CASE WHEN o.I = 0 THEN 0.0 ELSE (o.I - s.m) / (s.sd + 1e-12) END AS z_perm, "
        "CASE WHEN o.I = 0 THEN 1.0 ELSE (SELECT avg(CASE WHEN abs(I_perm - s.m) >= abs(o.I - s.m) THEN 1.0 ELSE 0.0 END) FROM mperm) END AS p_perm, "
        "s.m AS I_perm_mean FROM mobs o, mpstat s",
        "I E_I z_perm p_perm I_perm_mean",
        *_BASE,
        _MORAN_CTES,
        _PERM_CTES,
    ),
)
def q_morans_perm(spark, sf):
    w = SP.row_normalise(_weights(spark, sf)["geo"])
    return finish(SP.morans_test(w, _place_y(spark, sf), "place", "y", N_PERM))


_RANKED_PAIRS = f"""
pt AS (
  SELECT p.place_i, p.place_j, {sql_round_sig('p.distance_km')} AS d, {sql_round_sig('abs(a.y - b.y)')} AS dy,
         CAST(p.region_i = p.region_j AS INTEGER) AS same_region
  FROM pairs p JOIN place_y a ON p.place_i = a.place JOIN place_y b ON p.place_j = b.place
  WHERE p.place_i < p.place_j AND a.y IS NOT NULL AND b.y IS NOT NULL
)"""


@query(
    "pair_spearman",
    sql=_sql(
        "SELECT count(*) AS n_pairs, corr(rd, rdy) AS spearman_rho FROM (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rd, "
        "rank() OVER (ORDER BY dy) + (count(*) OVER (PARTITION BY dy) - 1) / 2.0 AS rdy FROM pt)",
        "spearman_rho",
        *_BASE,
        _RANKED_PAIRS,
    ),
)
def q_pair_spearman(spark, sf):
    pt = _pair_table(spark, sf).select(round_sig(F.col("distance_km")).alias("d"), round_sig(F.col("delta_pat")).alias("dy"))
    r = average_rank(average_rank(pt, "d", "rd"), "dy", "rdy")
    return finish(r.agg(F.count(F.lit(1)).alias("n_pairs"), F.corr("rd", "rdy").alias("spearman_rho")))


@query(
    "distance_quintiles",
    sql=_sql(
        """SELECT quintile, avg(dy) AS mean_delta, stddev_samp(dy) AS std_delta, quantile_cont(dy, 0.5) AS median_delta, count(*) AS count FROM (
  SELECT dy, CASE WHEN d <= e.e1 THEN 'Q1' WHEN d <= e.e2 THEN 'Q2' WHEN d <= e.e3 THEN 'Q3' WHEN d <= e.e4 THEN 'Q4' ELSE 'Q5' END AS quintile
  FROM pt, (SELECT quantile_cont(d, 0.2) AS e1, quantile_cont(d, 0.4) AS e2, quantile_cont(d, 0.6) AS e3, quantile_cont(d, 0.8) AS e4 FROM pt) e
) GROUP BY quintile""",
        "mean_delta std_delta median_delta",
        *_BASE,
        _RANKED_PAIRS,
    ),
)
def q_distance_quintiles(spark, sf):
    pt = _pair_table(spark, sf).select(round_sig(F.col("distance_km")).alias("d"), round_sig(F.col("delta_pat")).alias("dy"))
    # four cut points: a bounded result, fetched once and used as literals
    edges = percentile_row(pt, "d", {"e1": 0.2, "e2": 0.4, "e3": 0.6, "e4": 0.8}).first()
    e = {k: F.lit(edges[k]) for k in ("e1", "e2", "e3", "e4")}
    d = F.col("d")
    q = F.when(d <= e["e1"], "Q1").when(d <= e["e2"], "Q2").when(d <= e["e3"], "Q3").when(d <= e["e4"], "Q4").otherwise("Q5")
    binned = pt.select("dy", q.alias("quintile"))
    stats = binned.groupBy("quintile").agg(F.avg("dy").alias("mean_delta"), F.stddev_samp("dy").alias("std_delta"), F.count(F.lit(1)).alias("count"))
    med = percentile_row(binned, "dy", {"median_delta": 0.5}, by=["quintile"])
    return finish(stats.join(med, "quintile").select("quintile", "mean_delta", "std_delta", "median_delta", "count"))


def _ttest_frame(spark, sf):
    pt = _pair_table(spark, sf).select(round_sig(F.col("delta_pat")).alias("dy"), "same_region")
    g = pt.groupBy("same_region").agg(F.count(F.lit(1)).alias("n"), F.avg("dy").alias("m"), F.var_samp("dy").alias("v"))
    pick = lambda flag, c: g.where(F.col("same_region") == flag).select(c).scalar()
    n1, m1, v1 = pick(1, "n"), pick(1, "m"), pick(1, "v")
    n0, m0, v0 = pick(0, "n"), pick(0, "m"), pick(0, "v")
    sp2 = ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)
    t = (m1 - m0) / F.sqrt(sp2 * (F.lit(1.0) / n1 + F.lit(1.0) / n0))
    return spark.range(1).select(
        n1.alias("n_within"), m1.alias("within_region_mean"), n0.alias("n_across"), m0.alias("across_region_mean"), t.alias("t_stat"), (n1 + n0 - 2).alias("df")
    )


@query(
    "pair_ttest",
    sql=_sql(
        """SELECT w.n AS n_within, w.m AS within_region_mean, a.n AS n_across, a.m AS across_region_mean,
  (w.m - a.m) / sqrt(((w.n - 1) * w.v + (a.n - 1) * a.v) / (w.n + a.n - 2) * (1.0 / w.n + 1.0 / a.n)) AS t_stat, w.n + a.n - 2 AS df
FROM (SELECT count(*) AS n, avg(dy) AS m, var_samp(dy) AS v FROM pt WHERE same_region = 1) w,
     (SELECT count(*) AS n, avg(dy) AS m, var_samp(dy) AS v FROM pt WHERE same_region = 0) a""",
        "within_region_mean across_region_mean t_stat",
        *_BASE,
        _RANKED_PAIRS,
    ),
)
def q_pair_ttest(spark, sf):
    return finish(_ttest_frame(spark, sf))


@query("pair_study")
def q_pair_study(spark, sf):
    """Operator 70 summary with p-values (Student t tails)."""
    t = _ttest_frame(spark, sf)
    return finish(t.withColumn("t_pval", t_pvalue(F.col("t_stat"), F.col("df"))))


@query(
    "channel_corr",
    sql=_sql(
        """SELECT period, corr(geo_lag, y) AS corr_geo, corr(type_lag, y) AS corr_type, count(*) AS n FROM (
  SELECT y.place, y.year, y.y, g.lag AS geo_lag, t.lag AS type_lag, CASE WHEN y.year < 1998 THEN 'pre' ELSE 'post' END AS period
  FROM place_year_y y
  JOIN (SELECT w.i AS place, v.year, sum(w.w * v.y) AS lag FROM wn_geo w JOIN place_year_y v ON w.j = v.place GROUP BY w.i, v.year) g ON g.place = y.place AND g.year = y.year
  JOIN (SELECT w.i AS place, v.year, sum(w.w * v.y) AS lag FROM wn_type w JOIN place_year_y v ON w.j = v.place GROUP BY w.i, v.year) t ON t.place = y.place AND t.year = y.year
) GROUP BY period
UNION ALL
SELECT CAST(y.year AS VARCHAR) AS period, corr(g.lag, y.y), corr(t.lag, y.y), count(*) FROM place_year_y y
  JOIN (SELECT w.i AS place, v.year, sum(w.w * v.y) AS lag FROM wn_geo w JOIN place_year_y v ON w.j = v.place GROUP BY w.i, v.year) g ON g.place = y.place AND g.year = y.year
  JOIN (SELECT w.i AS place, v.year, sum(w.w * v.y) AS lag FROM wn_type w JOIN place_year_y v ON w.j = v.place GROUP BY w.i, v.year) t ON t.place = y.place AND t.year = y.year
GROUP BY y.year""",
        "corr_geo corr_type",
        *_BASE,
    ),
)
def q_channel_corr(spark, sf):
    ws = _weights(spark, sf)
    y = _place_y(spark, sf, by_year=True)
    g = SP.spatial_lag(SP.row_normalise(ws["geo"]), y, "place", "y", by=["year"]).select(F.col("i").alias("place"), "year", F.col("lag").alias("geo_lag"))
    t = SP.spatial_lag(SP.row_normalise(ws["type"]), y, "place", "y", by=["year"]).select(F.col("i").alias("place"), "year", F.col("lag").alias("type_lag"))
    j = y.join(g, ["place", "year"]).join(t, ["place", "year"])
    period = F.when(F.col("year") < 1998, "pre").otherwise("post")
    by_period = j.groupBy(period.alias("period")).agg(F.corr("geo_lag", "y").alias("corr_geo"), F.corr("type_lag", "y").alias("corr_type"), F.count(F.lit(1)).alias("n"))
    by_year = j.groupBy(F.col("year").cast("string").alias("period")).agg(F.corr("geo_lag", "y").alias("corr_geo"), F.corr("type_lag", "y").alias("corr_type"), F.count(F.lit(1)).alias("n"))
    return finish(by_period.unionByName(by_year))
