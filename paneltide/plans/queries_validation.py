"""Registered queries, part 6: out-of-sample validation (operators 21, 90-97, 121)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import validation as V
from ..session import materialise
from .common import R, finish, fixtures, prep, round_sig, sql_round_sig
from .oracle import META_CTES, PANEL_CTES, PREP_CTES, with_ctes
from .registry import query

S = P.FIXTURE
_BASE = (PANEL_CTES, META_CTES, PREP_CTES)
TARGET = "log_mean_pat"
OOS_FEATURES = [
    "tech_prox", "research_novelty", "topic_entropy", "intra_cohesion", "log_n_papers", "oa_share",
    "is_c9", "is_transport", "log_inst_rank", "post_BRI", "post_MiC2025", "post_NEV", "year_idx",
]
WF_FEATURES = ["tech_prox", "research_novelty", "oa_share", "log_n_papers", "year_idx"]
SHOWN = ["tech_prox", "research_novelty", "log_n_papers"]
N_FOLDS = 5


def _sql(body: str, doubles: str, *ctes: str) -> str:
    return R(with_ctes(*ctes, body=body), doubles)


OOS_CTE = "oos AS (SELECT entity, year, " + ", ".join(OOS_FEATURES) + f", {TARGET} FROM prep WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in OOS_FEATURES + [TARGET]
) + ")"


def _oos(spark, sf, features=OOS_FEATURES):
    return prep(spark, sf).select("entity", "year", *features, TARGET).na.drop()


def _split(spark, sf):
    df = _oos(spark, sf)
    return df.withColumn("role", F.when(F.col("year") <= S.split_year, "train").otherwise("test"))


@query(
    "temporal_split",
    sql=_sql(
        f"SELECT sum(CASE WHEN year <= {S.split_year} THEN 1 ELSE 0 END) AS n_train, sum(CASE WHEN year > {S.split_year} THEN 1 ELSE 0 END) AS n_test, "
        f"sum(CASE WHEN year <= {S.split_year} THEN 1 ELSE 0 END) >= 20 AND sum(CASE WHEN year > {S.split_year} THEN 1 ELSE 0 END) >= 10 AS kept FROM oos",
        "",
        *_BASE,
        OOS_CTE,
    ),
)
def q_temporal_split(spark, sf):
    s = _split(spark, sf)
    g = s.agg(F.sum((F.col("role") == "train").cast("long")).alias("n_train"), F.sum((F.col("role") == "test").cast("long")).alias("n_test"))
    return g.select("n_train", "n_test", ((F.col("n_train") >= 20) & (F.col("n_test") >= 10)).alias("kept"))


_FOLD_CTES = f"""
yrs AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i FROM (SELECT DISTINCT year FROM oos)),
ny AS (SELECT count(*) AS n, greatest(2, count(*) // {N_FOLDS + 1}) AS fs FROM yrs),
folds AS (
  SELECT CAST(f.fold AS INTEGER) AS fold, CAST(a.year AS INTEGER) AS train_end, CAST(a.year + 1 AS INTEGER) AS test_start, CAST(b.year AS INTEGER) AS test_end
  FROM range({N_FOLDS}) f(fold), ny
  JOIN yrs a ON a.i = least(f.fold * ny.fs + ny.fs, ny.n - 2)
  JOIN yrs b ON b.i = least(f.fold * ny.fs + ny.fs + 1, ny.n - 1)
)"""


@query(
    "walkforward_folds",
    sql=_sql(
        f"""SELECT f.fold, f.train_end, f.test_start, f.test_end,
  (SELECT count(*) FROM oos WHERE year <= f.train_end) AS n_train,
  (SELECT count(*) FROM oos WHERE year >= f.test_start AND year <= f.test_end) AS n_test,
  (SELECT count(*) FROM oos WHERE year <= f.train_end) >= 15 AND (SELECT count(*) FROM oos WHERE year >= f.test_start AND year <= f.test_end) >= 5 AS kept,
  f.test_end < {S.cutoff_year} AS pre_cutoff
FROM folds f""",
        "",
        *_BASE,
        OOS_CTE,
        _FOLD_CTES,
    ),
)
def q_walkforward_folds(spark, sf):
    df = _oos(spark, sf)
    folds = V.fold_table(spark, df, N_FOLDS)
    tagged = V.tag_folds(df, folds)
    counts = tagged.groupBy("fold").pivot("role", ["train", "test"]).agg(F.count(F.lit(1)))
    out = folds.join(counts, "fold", "left").select(
        "fold", "train_end", "test_start", "test_end",
        F.coalesce("train", F.lit(0)).cast("bigint").alias("n_train"), F.coalesce("test", F.lit(0)).cast("bigint").alias("n_test"),
    )
    return out.withColumn("kept", (F.col("n_train") >= 15) & (F.col("n_test") >= 5)).withColumn("pre_cutoff", F.col("test_end") < S.cutoff_year)


_DM_SQL = f"""
split AS (SELECT *, CASE WHEN year <= {S.split_year} THEN 'train' ELSE 'test' END AS role FROM oos),
tmeans AS (SELECT entity, {', '.join(f'avg({c}) AS gm_{c}' for c in SHOWN)} FROM split WHERE role = 'train' GROUP BY entity),
dm AS (
  SELECT s.entity, s.year, s.role, {', '.join(f'coalesce(s.{c}, 0) - coalesce(t.gm_{c}, 0) AS {c}' for c in SHOWN)}
  FROM split s LEFT JOIN tmeans t ON s.entity = t.entity
)"""


@query("train_demean", sql=_sql(f"SELECT entity, year, role, {', '.join(SHOWN)} FROM dm", " ".join(SHOWN), *_BASE, OOS_CTE, _DM_SQL))
def q_train_demean(spark, sf):
    return finish(V.train_demean(_split(spark, sf), OOS_FEATURES).select("entity", "year", "role", *SHOWN))


@query(
    "train_standardise",
    sql=_sql(
        f"""SELECT d.entity, d.year, d.role, {', '.join(f'(d.{c} - st.mu_{c}) / (CASE WHEN st.sd_{c} > 0 THEN st.sd_{c} ELSE 1.0 END) AS {c}' for c in SHOWN)}
FROM dm d, (SELECT {', '.join(f'avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}' for c in SHOWN)} FROM dm WHERE role = 'train') st""",
        " ".join(SHOWN),
        *_BASE,
        OOS_CTE,
        _DM_SQL,
    ),
)
def q_train_standardise(spark, sf):
    dm = V.train_demean(_split(spark, sf), OOS_FEATURES)
    return finish(V.train_standardise(dm, OOS_FEATURES).select("entity", "year", "role", *SHOWN))


@query("linear_models")
def q_linear_models(spark, sf):
    """Temporal split: penalised linear models on demeaned + standardised features,
    GBT on demeaned features; R2 (squared Pearson), Spearman, MAE on the test years."""
    dm = V.train_demean(_split(spark, sf), OOS_FEATURES)
    sc = V.train_standardise(dm, OOS_FEATURES)
    tr, te = sc.where(F.col("role") == "train"), sc.where(F.col("role") == "test")
    preds = V.penalised_models(tr, te, OOS_FEATURES, TARGET)
    preds["GBM"] = V.gbt_predict(dm.where(F.col("role") == "train"), dm.where(F.col("role") == "test"), OOS_FEATURES, TARGET)
    frames = [V.fit_metrics(p.withColumn("model", F.lit(name)), TARGET, "pred", ["model"]) for name, p in preds.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return finish(out.select("model", "R2", "SpearmanRho", "MAE", "n"))


_WF_MEMO: dict = {}


def walkforward(spark, sf, features: list[str], demean_scale: bool):
    """Per-fold GBT predictions (folds trained as concurrent Spark jobs)."""
    key = (spark.sparkContext.applicationId, sf, tuple(features), demean_scale)
    if key in _WF_MEMO:
        return _WF_MEMO[key]
    df = _oos(spark, sf, features)
    folds = V.fold_table(spark, df, N_FOLDS)
    tagged = V.tag_folds(df, folds)
    if demean_scale:
        tagged = V.train_standardise(V.train_demean(tagged, features, by=["fold"]), features, by=["fold"])
    # written once: each of the thousands of tasks of a fit would send back the counters of every
    # operator of the panel's plan, joins and folds included; now those of a scan
    tagged = materialise(tagged, "walkforward")
    plan = folds.collect()
    sizes = {(r["fold"], r["role"]): r["n"] for r in tagged.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")).collect()}

    # folds with the same (train_end, test window) share one fit: identical inputs,
    # identical seeded model, so the result is reused instead of retrained
    windows: dict[tuple, list[int]] = {}
    for f in plan:
        if sizes.get((f["fold"], "train"), 0) < 15 or sizes.get((f["fold"], "test"), 0) < 5:
            continue
        windows.setdefault((f["train_end"], f["test_start"], f["test_end"]), []).append(f["fold"])

    def run(folds_same):
        part = tagged.where(F.col("fold") == folds_same[0])
        pred = V.gbt_predict(part.where(F.col("role") == "train"), part.where(F.col("role") == "test"), features, TARGET)
        pred = materialise(pred.drop("fold"), "gbt_pred")
        return pred.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in folds_same])))

    preds = V.parallel([lambda w=w: run(w) for w in windows.values()])
    # no fold is large enough: an empty table of predictions
    out = preds[0] if preds else tagged.where(F.lit(False)).withColumn("pred", F.lit(None).cast("double"))
    for p in preds[1:]:
        out = out.unionByName(p)
    _WF_MEMO[key] = (out, folds)
    return out, folds


def _wf_metrics(spark, sf, features, demean_scale):
    preds, folds = walkforward(spark, sf, features, demean_scale)
    m = V.fit_metrics(preds, TARGET, "pred", ["fold"]).join(V.ndcg(preds, TARGET, "pred", ["fold"]).select("fold", "NDCG"), "fold")
    return folds.join(m, "fold").select(
        "fold", "train_end", "test_start", "test_end", "SpearmanRho", "R2", "NDCG", (F.col("test_end") < S.cutoff_year).alias("pre_covid"), "n"
    )


@query("gbt_walkforward")
def q_gbt_walkforward(spark, sf):
    """Rank validation with raw features (supplementary module B)."""
    return finish(_wf_metrics(spark, sf, WF_FEATURES, False))


@query("oos_walkforward")
def q_oos_walkforward(spark, sf):
    """Walk-forward with fold-wise training demeaning and scaling (main OOS)."""
    return finish(_wf_metrics(spark, sf, OOS_FEATURES, True))


@query("walkforward_summary")
def q_walkforward_summary(spark, sf):
    m = _wf_metrics(spark, sf, WF_FEATURES, False)
    flags = spark.createDataFrame([(True,), (False,)], "pre_covid boolean")
    agg = m.groupBy("pre_covid").agg(F.avg("SpearmanRho").alias("mean_spearman"), F.count(F.lit(1)).alias("n_folds"))
    return finish(flags.join(agg, "pre_covid", "left").select("pre_covid", "mean_spearman", F.coalesce("n_folds", F.lit(0)).alias("n_folds")))


# ---------------------------------------------------------------- metrics on a deterministic predictor (lagged outcome)
_LAG_CTE = (
    f"lagp AS (SELECT entity, year, {sql_round_sig('log_mean_pat')} AS y, {sql_round_sig('log_mean_pat_lag')} AS pred FROM prep "
    "WHERE log_mean_pat_lag IS NOT NULL)"
)


def _lagged(spark, sf):
    """Outcome and its previous value per entity-year: the persistence forecast
    used to check the metric operators against SQL (values canonicalised so ties
    are the same in both engines)."""
    return prep(spark, sf).where(F.col("log_mean_pat_lag").isNotNull()).select(
        "entity", "year", round_sig(F.col("log_mean_pat")).alias("y"), round_sig(F.col("log_mean_pat_lag")).alias("pred")
    )


@query(
    "fit_metrics",
    sql=_sql(
        """SELECT year, count(*) AS n, pow(corr(y, pred), 2) AS R2, corr(ry, rp) AS SpearmanRho, avg(abs(y - pred)) AS MAE FROM (
  SELECT year, y, pred,
    rank() OVER (PARTITION BY year ORDER BY y) + (count(*) OVER (PARTITION BY year, y) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY year ORDER BY pred) + (count(*) OVER (PARTITION BY year, pred) - 1) / 2.0 AS rp FROM lagp) GROUP BY year""",
        "R2 SpearmanRho MAE",
        *_BASE,
        _LAG_CTE,
    ),
)
def q_fit_metrics(spark, sf):
    return finish(V.fit_metrics(_lagged(spark, sf), "y", "pred", ["year"]).select("year", "n", "R2", "SpearmanRho", "MAE"))


@query(
    "ndcg",
    sql=_sql(
        """SELECT d.year, d.dcg, i.idcg, d.dcg / i.idcg AS NDCG FROM
(SELECT year, sum(y * ad) AS dcg FROM (
   SELECT year, y, avg(1.0 / log2(rn + 1)) OVER (PARTITION BY year, pred) AS ad FROM (
     SELECT year, y, pred, row_number() OVER (PARTITION BY year ORDER BY pred DESC, entity) AS rn FROM lagp)) GROUP BY year) d
JOIN (SELECT year, sum(y / log2(rn + 1)) AS idcg FROM (SELECT year, y, row_number() OVER (PARTITION BY year ORDER BY y DESC, entity) AS rn FROM lagp) GROUP BY year) i
ON d.year = i.year""",
        "dcg idcg NDCG",
        *_BASE,
        _LAG_CTE,
    ),
)
def q_ndcg(spark, sf):
    return finish(V.ndcg(_lagged(spark, sf), "y", "pred", ["year"]))


@query(
    "precision_at_k",
    sql=_sql(
        """SELECT p.year, coalesce(h.hits, 0) / 10.0 AS precision_at_k, p.k_eff FROM
(SELECT year, count(*) AS k_eff FROM (SELECT year, row_number() OVER (PARTITION BY year ORDER BY pred DESC, entity) AS r FROM lagp) WHERE r <= 10 GROUP BY year) p
LEFT JOIN (SELECT a.year, count(*) AS hits FROM
  (SELECT year, entity FROM (SELECT year, entity, row_number() OVER (PARTITION BY year ORDER BY pred DESC, entity) AS r FROM lagp) WHERE r <= 10) a
  JOIN (SELECT year, entity FROM (SELECT year, entity, row_number() OVER (PARTITION BY year ORDER BY y DESC, entity) AS r FROM lagp) WHERE r <= 10) b
  ON a.year = b.year AND a.entity = b.entity GROUP BY a.year) h ON p.year = h.year""",
        "precision_at_k",
        *_BASE,
        _LAG_CTE,
    ),
)
def q_precision_at_k(spark, sf):
    return finish(V.precision_at_k(_lagged(spark, sf), "y", "pred", ["year"], "entity", 10))


@query(
    "qwk",
    sql=_sql(
        """SELECT year, 1.0 - sum(w * o) / sum(w * e) AS qwk FROM (
  SELECT g.year, g.a, g.b, pow(g.a - g.b, 2) / 4.0 AS w, coalesce(o.o, 0) AS o, ra.na * rb.nb / CAST(n.n AS DOUBLE) AS e
  FROM (SELECT DISTINCT l.year, a.a, b.b FROM lab l, (VALUES (0), (1), (2)) a(a), (VALUES (0), (1), (2)) b(b)) g
  JOIN (SELECT year, a, count(*) AS na FROM lab GROUP BY year, a) ra ON ra.year = g.year AND ra.a = g.a
  JOIN (SELECT year, b, count(*) AS nb FROM lab GROUP BY year, b) rb ON rb.year = g.year AND rb.b = g.b
  JOIN (SELECT year, count(*) AS n FROM lab GROUP BY year) n ON n.year = g.year
  LEFT JOIN (SELECT year, a, b, count(*) AS o FROM lab GROUP BY year, a, b) o ON o.year = g.year AND o.a = g.a AND o.b = g.b
) GROUP BY year""",
        "qwk",
        *_BASE,
        _LAG_CTE,
        """cuts AS (SELECT year, quantile_cont(y, 1.0/3) AS ya1, quantile_cont(y, 2.0/3) AS ya2, quantile_cont(pred, 1.0/3) AS pa1, quantile_cont(pred, 2.0/3) AS pa2 FROM lagp GROUP BY year),
lab AS (SELECT l.year, CASE WHEN l.y <= c.ya1 THEN 0 WHEN l.y <= c.ya2 THEN 1 ELSE 2 END AS a,
               CASE WHEN l.pred <= c.pa1 THEN 0 WHEN l.pred <= c.pa2 THEN 1 ELSE 2 END AS b FROM lagp l JOIN cuts c ON l.year = c.year)""",
    ),
)
def q_qwk(spark, sf):
    return finish(V.quadratic_kappa(_lagged(spark, sf), "y", "pred", ["year"]))
