"""Out-of-sample validation: temporal split, walk-forward folds, training-set
demeaning and standardising, penalised linear models and gradient-boosted
trees (pyspark.ml), fit metrics, tie-aware NDCG, precision@k and quadratic
weighted kappa.

Rank metrics use the distributed position helper, so no fold is ever sorted
inside one task.
"""

from __future__ import annotations

import threading

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import average_rank, percentile_row, value_positions

DISCOUNT_CHUNK = 100_000  # terms summed per row when averaging discounts over a tie run


# ------------------------------------------------------------------ folds
def fold_plan(years: list[int], n_folds: int = 5) -> list[dict]:
    """Walk-forward plan: fold size max(2, T // (n_folds + 1)); train ends at
    years[min(f*fs + fs, T-2)], the test window runs to years[min(f*fs + fs + 1, T-1)]."""
    years = sorted(years)
    n = len(years)
    fs = max(2, n // (n_folds + 1))
    out = []
    for f in range(n_folds):
        train_end = years[min(f * fs + fs, n - 2)]
        test_end = years[min(f * fs + fs + 1, n - 1)]
        out.append({"fold": f, "train_end": int(train_end), "test_start": int(train_end) + 1, "test_end": int(test_end)})
    return out


def fold_table(spark: SparkSession, df: DataFrame, n_folds: int = 5, year: str = "year") -> DataFrame:
    years = [r[0] for r in df.select(year).distinct().collect()]  # one value per year: bounded
    return spark.createDataFrame(fold_plan(years, n_folds), "fold int, train_end int, test_start int, test_end int")


def tag_folds(df: DataFrame, folds: DataFrame, year: str = "year") -> DataFrame:
    """Rows tagged with (fold, role) by a range join against the small fold table."""
    f = F.broadcast(folds)
    train = df.join(f, F.col(year) <= f.train_end).withColumn("role", F.lit("train"))
    test = df.join(f, (F.col(year) >= f.test_start) & (F.col(year) <= f.test_end)).withColumn("role", F.lit("test"))
    return train.unionByName(test)


# ------------------------------------------------------------------ feature transforms
def train_demean(df: DataFrame, features: list[str], role: str = "role", by: list[str] | None = None, entity: str = "entity") -> DataFrame:
    """x - training mean of the entity (unseen entity -> no correction; null x -> 0)."""
    by = list(by or [])
    means = df.where(F.col(role) == "train").groupBy(*by, entity).agg(*[F.avg(c).alias(f"_gm_{c}") for c in features])
    j = df.join(means, [*by, entity], "left")
    return j.select(
        *[c for c in df.columns if c not in features],
        *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.coalesce(F.col(f"_gm_{c}"), F.lit(0.0))).alias(c) for c in features],
    )


def train_standardise(df: DataFrame, features: list[str], role: str = "role", by: list[str] | None = None) -> DataFrame:
    """(x - train mean) / train population sd (sd 0 -> 1), as a fitted scaler does."""
    by = list(by or [])
    stats = df.where(F.col(role) == "train").groupBy(*by).agg(
        *[F.avg(c).alias(f"_mu_{c}") for c in features], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in features]
    )
    # per-group statistics: one row per group (folds), a bounded broadcast
    j = df.join(F.broadcast(stats), by) if by else _attach_global(df, stats)
    sd = lambda c: F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(F.lit(1.0))
    return j.select(*[c for c in df.columns if c not in features], *[((F.col(c) - F.col(f"_mu_{c}")) / sd(c)).alias(c) for c in features])


def _attach_global(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row statistics table as scalar subqueries (no cross join)."""
    return df.select("*", *[stats.select(c).scalar().alias(c) for c in stats.columns])


# ------------------------------------------------------------------ metrics
def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation, null when either side is constant (ANSI-mode ``corr``
    raises on a zero variance, e.g. a lasso that predicts one value)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def fit_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Squared Pearson (reported as R2), Spearman (average ranks), MAE."""
    by = list(by or [])
    r = average_rank(average_rank(df, y, "_ry", by), pred, "_rp", by)
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.pow(safe_corr(y, pred), 2).alias("R2"),
        safe_corr("_ry", "_rp").alias("SpearmanRho"),
        F.avg(F.abs(F.col(y) - F.col(pred))).alias("MAE"),
    )


def run_discounts(pos: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of 1/log2(p + 1) over positions before+1 .. before+c of every tie run.

    Long runs are cut into chunks of DISCOUNT_CHUNK positions (exploded rows), so a
    run holding a third of the rows is summed by many tasks, exactly."""
    ch = DISCOUNT_CHUNK
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / F.lit(ch)).cast("long")))
    parts = pos.select(*keys, "before", "c", k.alias("_k"))
    lo = F.col("before") + 1 + F.col("_k") * ch
    hi = F.least(F.col("before") + F.col("c"), lo + ch - 1)
    terms = F.aggregate(F.sequence(lo, hi), F.lit(0.0), lambda acc, p: acc + F.lit(1.0) / F.log2(p.cast("double") + 1))
    return parts.select(*keys, terms.alias("_s")).groupBy(*keys).agg(F.sum("_s").alias("disc_sum"))


def ndcg(df: DataFrame, y: str, pred: str, by: list[str]) -> DataFrame:
    """NDCG with linear gain and 1/log2(rank + 1) discount; tied predictions share
    the mean discount of their positions; ideal DCG from y sorted descending."""
    pp = value_positions(df, pred, by, descending=True)
    dp = run_discounts(pp, [*by, pred]).join(pp.select(*by, pred, "c"), [*by, pred]).select(*by, pred, (F.col("disc_sum") / F.col("c")).alias("_d"))
    dcg = df.join(dp, [*by, pred]).groupBy(*by).agg(F.sum(F.col(y) * F.col("_d")).alias("dcg"))
    yp = value_positions(df, y, by, descending=True)
    idcg = run_discounts(yp, [*by, y]).groupBy(*by).agg(F.sum(F.col(y) * F.col("disc_sum")).alias("idcg"))
    return dcg.join(idcg, by).select(*by, "dcg", "idcg", (F.col("dcg") / F.col("idcg")).alias("NDCG"))


def precision_at_k(df: DataFrame, y: str, pred: str, by: list[str], key: str, k: int = 10) -> DataFrame:
    """Share of the top-k by prediction that are in the top-k by outcome (ties by key).

    ``row_number() <= k`` is planned with a per-partition group limit, so each
    task keeps only k rows per group before the shuffle."""
    wy = Window.partitionBy(*by).orderBy(F.desc(y), F.asc(key))
    wp = Window.partitionBy(*by).orderBy(F.desc(pred), F.asc(key))
    top_y = df.withColumn("_r", F.row_number().over(wy)).where(F.col("_r") <= k).select(*by, key)
    top_p = df.withColumn("_r", F.row_number().over(wp)).where(F.col("_r") <= k).select(*by, key)
    hits = top_p.join(top_y, [*by, key]).groupBy(*by).agg(F.count(F.lit(1)).alias("hits"))
    sizes = top_p.groupBy(*by).agg(F.count(F.lit(1)).alias("k_eff"))
    return sizes.join(hits, by, "left").select(*by, (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision_at_k"), "k_eff")


def tercile(col: str, cuts: DataFrame, prefix: str) -> Column:
    return F.when(F.col(col) <= F.col(f"{prefix}1"), 0).when(F.col(col) <= F.col(f"{prefix}2"), 1).otherwise(2)


def quadratic_kappa(df: DataFrame, y: str, pred: str, by: list[str]) -> DataFrame:
    """Quadratic weighted kappa between tercile classes of y and of the prediction
    (cut points: exact percentiles 1/3, 2/3 within each group)."""
    cy = percentile_row(df, y, {"ya1": 1 / 3, "ya2": 2 / 3}, by)
    cp = percentile_row(df, pred, {"pa1": 1 / 3, "pa2": 2 / 3}, by)
    lab = df.join(cy, by).join(cp, by).select(*by, tercile(y, cy, "ya").alias("a"), tercile(pred, cp, "pa").alias("b"))
    o = lab.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("o"))
    ra = lab.groupBy(*by, "a").agg(F.count(F.lit(1)).alias("na"))
    rb = lab.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("nb"))
    n = lab.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    e = ra.join(rb, by).join(n, by).select(*by, "a", "b", (F.col("na") * F.col("nb") / F.col("n")).alias("e"))
    full = e.join(o, [*by, "a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    w = F.pow(F.col("a") - F.col("b"), 2) / 4.0
    return full.groupBy(*by).agg((F.lit(1.0) - F.sum(w * F.col("o")) / F.sum(w * F.col("e"))).alias("qwk"))


# ------------------------------------------------------------------ models (pyspark.ml)
def penalised_models(train: DataFrame, test: DataFrame, features: list[str], label: str) -> dict[str, DataFrame]:
    """Ridge(1.0), Lasso(0.01), ElasticNet(0.01, 0.5) with their penalties mapped onto
    Spark's parametrisation (Spark scales the L2 part by the label's sample sd s):
    ridge regParam = a s / n; lasso regParam = a, elasticNet 1; elastic net
    r = a l1 + a (1 - l1) s, elasticNetParam = a l1 / r."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    va = VectorAssembler(inputCols=features, outputCol="features")
    tr = va.transform(train)
    te = va.transform(test)
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(label).alias("s")).first()
    n, s = float(st["n"]), float(st["s"] or 1.0)
    specs = {
        "Ridge": (1.0 * s / n, 0.0),
        "Lasso": (0.01, 1.0),
    }
    r = 0.01 * 0.5 + 0.01 * 0.5 * s
    specs["ElasticNet"] = (r, 0.01 * 0.5 / r)
    out = {}
    for name, (reg, en) in specs.items():
        m = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=en, standardization=False, solver="l-bfgs", maxIter=500, tol=1e-10)
        out[name] = m.fit(tr).transform(te).select(*[c for c in test.columns], F.col("prediction").alias("pred"))
    return out


def gbt_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, n_trees: int = 200, depth: int = 3, rate: float = 0.05, seed: int = 42) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    va = VectorAssembler(inputCols=features, outputCol="features")
    m = GBTRegressor(featuresCol="features", labelCol=label, maxIter=n_trees, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=1.0)
    return m.fit(va.transform(train)).transform(va.transform(test)).select(*test.columns, F.col("prediction").alias("pred"))


def parallel(fns: list, workers: int = 4) -> list:
    """Run independent Spark actions (e.g. one model per fold) as concurrent jobs; the
    threads inherit the caller's job group and scheduler pool."""
    results: list = [None] * len(fns)
    errors: list[BaseException] = []
    waiting = iter(range(len(fns)))
    lock = threading.Lock()

    def work() -> None:
        while not errors:
            with lock:
                i = next(waiting, None)
            if i is None:
                return
            try:
                results[i] = fns[i]()
            except BaseException as e:  # noqa: BLE001 - raised again below
                errors.append(e)

    threads = [InheritableThread(target=work) for _ in range(min(workers, len(fns)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
    return results
