"""Linear-model kernel: Gram aggregation on Spark, k x k algebra on the driver.

One aggregate job computes, per group, ``X'X``, ``X'y`` and ``y'y`` of the
centred design ``[1, x - mean(x)]`` (centring keeps raw years or sizes from
ruining the conditioning; slopes, residuals and leverages are unchanged and the
intercept and its covariance are mapped back exactly). Robust covariances take
one more pass:

- HC3: leverage ``h = x' A x`` and residual as Column expressions, then the
  meat ``sum x x' e^2 / (1 - h)^2`` as another Gram aggregate.
- cluster: scores ``s_g = sum_{i in g} x_i e_i`` by ``groupBy(cluster)``, then
  ``sum_g s_g s_g'``; factor ``G/(G-1) * (N-1)/(N-k)``.

Only k x k numbers per group reach the driver; groups are specifications,
segments, thresholds, folds or years, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import Z975, normal_two_sided, t_two_sided

CONST = "const"


def t_quantile_975(df: float) -> float:
    """Upper 97.5% point of Student t (bisection on the two-sided tail)."""
    if not df or df <= 0 or math.isnan(df):
        return float("nan")
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_two_sided(mid, df) > 0.05:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    k: int
    rss: float
    tss: float
    rank: int
    cov_type: str
    group: tuple = ()
    extra: dict = field(default_factory=dict)

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss if self.tss > 0 else float("nan")

    @property
    def df_resid(self) -> float:
        return float(self.n - self.rank)

    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def get(self, name: str, what: str = "coef") -> float:
        if name not in self.names:
            return float("nan")
        i = self.names.index(name)
        if what == "coef":
            return float(self.coef[i])
        if what == "se":
            return float(self.se()[i])
        if what == "p":
            return float(self.pvalues()[i])
        raise KeyError(what)

    def stats(self) -> np.ndarray:
        se = self.se()
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(se > 0, self.coef / se, np.nan)

    def pvalues(self) -> np.ndarray:
        st = self.stats()
        if self.cov_type == "classical":
            return np.array([t_two_sided(float(s), self.df_resid) for s in st])
        return np.array([normal_two_sided(float(s)) for s in st])

    def crit(self) -> float:
        return t_quantile_975(self.df_resid) if self.cov_type == "classical" else Z975

    def rows(self) -> list[tuple]:
        se, st, p, q = self.se(), self.stats(), self.pvalues(), self.crit()
        out = []
        for i, name in enumerate(self.names):
            c = float(self.coef[i])
            out.append((name, c, float(se[i]), float(st[i]), float(p[i]), c - q * float(se[i]), c + q * float(se[i])))
        return out


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def prepare_design(df: DataFrame, y: str, xs: list[str], by: list[str], extra: list[str] | None = None) -> tuple[DataFrame, DataFrame | None, dict]:
    """Complete cases of the model columns and x centred by group means."""
    extra = extra or []
    q = lambda c: f"`{c}`"
    base = df.selectExpr(*[q(c) for c in by + extra], f"CAST({q(y)} AS DOUBLE) AS _y", *[f"CAST({q(x)} AS DOUBLE) AS _x{i}" for i, x in enumerate(xs)])
    base = base.na.drop(subset=["_y"] + [f"_x{i}" for i in range(len(xs))] + extra)
    mean_exprs = [f"_x{i} AS _m{i}" for i in range(len(xs))]
    if by:
        sums = _sum_frame(base, by, ["1L AS _cnt"] + mean_exprs)
        means = sums.selectExpr(*[q(b) for b in by], *[f"_m{i} / _cnt AS _m{i}" for i in range(len(xs))])
        cen = base.join(means, by)
        const_means = None
    else:
        row = base.selectExpr(*[f"avg(_x{i}) AS _m{i}" for i in range(len(xs))]).first() if xs else None
        const_means = {i: float(row[f"_m{i}"]) if row is not None and row[f"_m{i}"] is not None else 0.0 for i in range(len(xs))}
        means = None
        cen = base.selectExpr("*", *[f"{_lit(const_means[i])} AS _m{i}" for i in range(len(xs))])
    cen = cen.selectExpr(*[q(c) for c in by + extra], "_y", *[f"_m{i}" for i in range(len(xs))], *[f"_x{i} - _m{i} AS _xc{i}" for i in range(len(xs))])
    return cen, means, const_means or {}


def _lit(v: float) -> str:
    """Exact SQL double literal (shortest round-trip repr, D suffix)."""
    v = float(v)
    if math.isnan(v) or math.isinf(v):
        return "CAST(NULL AS DOUBLE)"
    return f"{v!r}D"


def _sum_frame(df: DataFrame, by: list[str], exprs: list[str]) -> DataFrame:
    """Per-row products as SQL strings (one ``selectExpr`` call) summed by
    ``groupBy().sum()`` (one call): planning cost stays flat for hundreds of sums,
    unlike building each aggregate Column through py4j."""
    prods = df.selectExpr(*[f"`{b}`" for b in by], *exprs)
    names = [n for n in prods.columns if n not in by]
    return prods.groupBy(*by).sum(*names).toDF(*by, *names)


def _key(values) -> tuple:
    return tuple(v.item() if hasattr(v, "item") else v for v in values)


def _batches(pdf: pd.DataFrame, by: list[str]):
    if not by:
        yield (), pdf
        return
    for key, g in pdf.groupby(by, sort=False, dropna=False):
        yield _key(key if isinstance(key, tuple) else (key,)), g


def _design_np(g: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.empty((len(g), k))
    x[:, 0] = 1.0
    for i in range(k - 1):
        x[:, i + 1] = g[f"_xc{i}"].to_numpy(dtype=float)
    return x, g["_y"].to_numpy(dtype=float)


def _partials(df: DataFrame, by: list[str], fn, schema_extra: list[T.StructField] | None = None, extra_keys: list[str] | None = None) -> DataFrame:
    """Per-partition numpy partial sums emitted as (keys..., idx, v) rows and
    reduced on Spark with groupBy(keys, idx).sum: BLAS does the k x k work per
    Arrow batch, Spark does the distributed reduction; only k^2 numbers per group
    and partition cross the shuffle."""
    keys = by + (extra_keys or [])
    fields = [f for f in df.schema.fields if f.name in keys]
    fields = sorted(fields, key=lambda f: keys.index(f.name))
    schema = T.StructType(fields + [T.StructField("idx", T.LongType()), T.StructField("v", T.DoubleType())])

    def run(it):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in it:
            for key, g in _batches(pdf, keys):
                v = fn(key, g)
                acc[key] = v if key not in acc else acc[key] + v
        for key, v in acc.items():
            out = {kname: [kv] * len(v) for kname, kv in zip(keys, key)}
            out["idx"] = np.arange(len(v), dtype=np.int64)
            out["v"] = v
            yield pd.DataFrame(out)

    return df.mapInPandas(run, schema).groupBy(*keys, "idx").agg(F.sum("v").alias("v"))


def _collect_vectors(part: DataFrame, keys: list[str], size: int) -> dict[tuple, np.ndarray]:
    out: dict[tuple, np.ndarray] = {}
    for r in part.collect():  # k^2 numbers per group: bounded
        key = tuple(r[c] for c in keys)
        vec = out.setdefault(key, np.zeros(size))
        vec[int(r["idx"])] = float(r["v"])
    return out


def gram_partials(cen: DataFrame, k: int, by: list[str]) -> dict[tuple, dict]:
    iu = np.triu_indices(k)
    m = len(iu[0])

    def fn(key, g):
        x, y = _design_np(g, k)
        return np.concatenate([(x.T @ x)[iu], x.T @ y, [y @ y, y.sum(), float(len(y))]])

    vecs = _collect_vectors(_partials(cen, by, fn), by, m + k + 3)
    out = {}
    for key, v in vecs.items():
        xtx = np.zeros((k, k))
        xtx[iu] = v[:m]
        xtx = xtx + np.triu(xtx, 1).T
        out[key] = {"xtx": xtx, "xty": v[m : m + k], "yy": v[m + k], "sy": v[m + k + 1], "n": int(round(v[m + k + 2]))}
    return out


def _solve(gram: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float, int, int]:
    n = int(gram["n"])
    xtx, xty, yy, sy = gram["xtx"], gram["xty"], float(gram["yy"]), float(gram["sy"])
    scale = np.sqrt(np.clip(np.diag(xtx), 1e-300, None))
    a_scaled = np.linalg.pinv(xtx / np.outer(scale, scale), rcond=1e-12)
    a = a_scaled / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(xtx / np.outer(scale, scale), tol=1e-10))
    b = a @ xty
    rss = max(yy - 2 * b @ xty + b @ xtx @ b, 0.0)
    tss = yy - sy * sy / n if n > 0 else float("nan")
    return a, b, xtx, rss, tss, rank, n


def _back_transform(means: list[float]) -> np.ndarray:
    """T with b_orig = T b_centred (intercept shifted by -mean'b)."""
    k = len(means) + 1
    t = np.eye(k)
    t[0, 1:] = -np.asarray(means)
    return t


@dataclass
class _GroupState:
    key: tuple
    a: np.ndarray
    b: np.ndarray
    rss: float
    tss: float
    rank: int
    n: int
    means: list[float]


def ols(
    df: DataFrame,
    y: str,
    xs: list[str],
    cov: str = "classical",
    by: list[str] | None = None,
    cluster: str | None = None,
    min_rows: int = 0,
) -> list[Fit]:
    """OLS with intercept per ``by`` group; ``cov`` in classical / HC3 / cluster."""
    by = list(by or [])
    k = len(xs) + 1
    extra = [cluster] if cov == "cluster" and cluster else []
    cen, means_df, const_means = prepare_design(df, y, xs, by, extra)
    grams = gram_partials(cen, k, by)
    if by:
        mean_rows = {tuple(r[c] for c in by): [float(r[f"_m{i}"]) for i in range(len(xs))] for r in means_df.collect()}  # one row per group
    states: list[_GroupState] = []
    for key, gram in grams.items():
        n = int(gram["n"])
        if n < max(min_rows, 1):
            continue
        means = mean_rows[key] if by else [const_means[i] for i in range(len(xs))]
        a, b, xtx, rss, tss, rank, n = _solve(gram, k)
        states.append(_GroupState(key, a, b, rss, tss, rank, n, means))
    if not states:
        return []
    meats: dict[tuple, np.ndarray] = {}
    n_clusters: dict[tuple, int] = {}
    if cov in ("HC3", "cluster"):
        spark = df.sparkSession
        params = {st.key: (st.a, st.b) for st in states}
        iu = np.triu_indices(k)
        m = len(iu[0])
        if cov == "HC3":

            def hc3(key, g):
                if key not in params:
                    return np.zeros(m)
                a, b = params[key]
                x, y = _design_np(g, k)
                e = y - x @ b
                h = np.einsum("ij,jk,ik->i", x, a, x)
                w = e * e / (1.0 - h) ** 2
                return (x.T @ (x * w[:, None]))[iu]

            for key, v in _collect_vectors(_partials(cen, by, hc3), by, m).items():
                mt = np.zeros((k, k))
                mt[iu] = v
                meats[key] = mt + np.triu(mt, 1).T
        else:
            kb = by + [cluster]

            # score sums x * e of each cluster, as Column expressions: one grouped sum
            if by:
                fitted = [(*key, [float(v) for v in b]) for key, (_, b) in params.items() if b is not None]
                types = [f for f in cen.schema.fields if f.name in by]
                types = sorted(types, key=lambda f: by.index(f.name)) + [T.StructField("_b", T.ArrayType(T.DoubleType()))]
                coefs = cen.sparkSession.createDataFrame(fitted, T.StructType(types))  # one row a fit
                rows = cen.join(F.broadcast(coefs), by)
                beta = [F.get("_b", F.lit(i)) for i in range(k)]
            else:
                rows, beta = cen, [F.lit(float(v)) for v in params[()][1]]
            x = [F.lit(1.0), *[F.col(f"_xc{i}") for i in range(k - 1)]]
            e = F.col("_y") - sum((x[i] * beta[i] for i in range(1, k)), beta[0])
            wide = rows.withColumn("_e", e).groupBy(*kb).agg(*[F.sum(x[i] * F.col("_e")).alias(f"_s{i}") for i in range(k)])

            def outer(key, g):
                s_ = np.column_stack([g[f"_s{i}"].to_numpy(dtype=float) for i in range(k)])
                return np.concatenate([(s_.T @ s_)[iu], [float(len(g))]])

            for key, v in _collect_vectors(_partials(wide, by, outer), by, m + 1).items():
                mt = np.zeros((k, k))
                mt[iu] = v[:m]
                meats[key] = mt + np.triu(mt, 1).T
                n_clusters[key] = int(round(v[m]))
    names = [CONST] + list(xs)
    fits = []
    for s in states:
        if cov == "classical":
            dfr = s.n - s.rank
            s2 = s.rss / dfr if dfr > 0 else float("nan")
            vc = s2 * s.a
        elif cov == "HC3":
            vc = s.a @ meats[s.key] @ s.a
        elif cov == "cluster":
            g = n_clusters[s.key]
            c = (g / (g - 1.0)) * ((s.n - 1.0) / (s.n - s.rank)) if g > 1 and s.n > s.rank else float("nan")
            vc = c * (s.a @ meats[s.key] @ s.a)
        else:
            raise ValueError(cov)
        t = _back_transform(s.means)
        fits.append(Fit(names, t @ s.b, t @ vc @ t.T, s.n, k, s.rss, s.tss, s.rank, cov if cov != "HC3" else "HC3", s.key))
    return fits


def fits_frame(spark: SparkSession, fits: list[Fit], by: list[str] | None = None, label: dict | None = None) -> DataFrame:
    """Coefficient table ``(by..., variable, coef, se, stat, pvalue, ci_lo, ci_hi, n, r2)``."""
    by = list(by or [])
    label = label or {}
    rows = []
    for f in fits:
        for name, c, se, st, p, lo, hi in f.rows():
            rows.append(tuple(f.group) + tuple(label.values()) + (name, _f(c), _f(se), _f(st), _f(p), _f(lo), _f(hi), int(f.n), _f(f.r2)))
    cols = [*by, *label.keys(), "variable", "coef", "se", "stat", "pvalue", "ci_lo", "ci_hi", "n", "r2"]
    types = [None] * (len(by) + len(label)) + ["string", "double", "double", "double", "double", "double", "double", "bigint", "double"]
    schema = ", ".join(f"`{c}` {t or _infer(rows, i)}" for i, (c, t) in enumerate(zip(cols, types)))
    return spark.createDataFrame(rows, schema)


def _infer(rows: list[tuple], i: int) -> str:
    for r in rows:
        v = r[i]
        if isinstance(v, bool):
            return "boolean"
        if isinstance(v, int):
            return "bigint"
        if isinstance(v, float):
            return "double"
        if isinstance(v, str):
            return "string"
    return "string"


def _f(x) -> float | None:
    try:
        x = float(x)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(x) or math.isinf(x) else x


def gram_by(df: DataFrame, y: str, xs: list[str], by: list[str], shift: dict[str, float] | None = None) -> dict[tuple, tuple[np.ndarray, np.ndarray, float, int]]:
    """Gram pieces per group, for callers that sum Grams over groups (Chow: every
    break is a sum of year Grams). All columns are shifted by their pooled
    complete-case means first (one small aggregate; ``shift`` overrides), so sums
    over any subset stay well conditioned; RSS and slopes do not depend on it."""
    k = len(xs) + 1
    base = df.select(*by, F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]).na.drop()
    means = base.agg(F.avg("_y").alias("_y"), *[F.avg(f"_x{i}").alias(f"_x{i}") for i in range(len(xs))]).first()
    sh = {"_y": float(means["_y"] or 0.0), **{f"_x{i}": float(means[f"_x{i}"] or 0.0) for i in range(len(xs))}}
    for i, x in enumerate(xs):
        if shift and x in shift:
            sh[f"_x{i}"] = float(shift[x])
    base = base.select(*by, (F.col("_y") - F.lit(sh["_y"])).alias("_y"), *[(F.col(f"_x{i}") - F.lit(sh[f"_x{i}"])).alias(f"_xc{i}") for i in range(len(xs))])
    out = {}
    for key, g in gram_partials(base, k, by).items():
        out[key] = (g["xtx"], g["xty"], g["yy"], g["n"])
    return out


def rss_from_gram(xtx: np.ndarray, xty: np.ndarray, yy: float) -> tuple[float, int]:
    scale = np.sqrt(np.clip(np.diag(xtx), 1e-300, None))
    m = xtx / np.outer(scale, scale)
    a = np.linalg.pinv(m, rcond=1e-12) / np.outer(scale, scale)
    b = a @ xty
    return max(yy - b @ xty, 0.0), int(np.linalg.matrix_rank(m, tol=1e-10))
