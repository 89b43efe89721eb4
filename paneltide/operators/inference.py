"""Model-based tests built on the Gram kernel: Mundlak specifications, within
FE, Hausman, Chow breaks and placebos, interrupted time series, inverted-U,
mediation, sensitivity sweeps, first differences, VIF, Breusch-Pagan.

Every function returns small driver-side results (k x k per group) and the
query layer turns them into DataFrames.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_upper, f_upper
from .regression import CONST, Fit, gram_by, ols, rss_from_gram

BASE_TVARS = ["tech_prox", "research_novelty", "log_n_papers", "year_norm"]
NLP_TVARS = BASE_TVARS + ["topic_entropy", "intra_cohesion"]
TIME_INVARIANT = ["is_c9", "is_transport", "is_research", "log_inst_rank"]
MUNDLAK_MEANS = ["tech_prox", "research_novelty", "topic_entropy", "log_n_papers", "oa_share"]


def mundlak_specs(events: list[str]) -> list[tuple[str, list[str]]]:
    policy = NLP_TVARS + [f"post_{e}" for e in events]
    quad = policy + ["novelty_sq"]
    het = quad + ["tech_x_transport", "tech_x_c9", "oa_share"]
    rank = het + ["novelty_x_rank"]
    return [
        ("MC_A_Base", BASE_TVARS + TIME_INVARIANT),
        ("MC_B_NLP", NLP_TVARS + TIME_INVARIANT),
        ("MC_C_Policy", policy + TIME_INVARIANT),
        ("MC_D_Quad", quad + TIME_INVARIANT),
        ("MC_E_Het", het + TIME_INVARIANT),
        ("MC_F_RankMod", rank + TIME_INVARIANT),
    ]


def mundlak_fit(df: DataFrame, tvars: list[str], y: str = "log_mean_pat", cluster: str = "entity", min_rows: int = 30) -> Fit | None:
    """Pooled OLS on time-varying regressors plus group means (correlated random
    effects), entity-clustered covariance; fewer than ``min_rows`` complete rows -> None."""
    covs = [v for v in tvars if v in df.columns] + [f"gm_{v}" for v in MUNDLAK_MEANS if f"gm_{v}" in df.columns]
    fits = ols(df, y, covs, cov="cluster", cluster=cluster, min_rows=min_rows)
    return fits[0] if fits else None


def within_fit(df: DataFrame, covs: list[str], y: str = "log_mean_pat", min_rows: int = 30) -> Fit | None:
    """Entity-demeaned regression on the ``*_fe`` columns with HC3 covariance."""
    xs = [f"{v}_fe" for v in covs if f"{v}_fe" in df.columns]
    if not xs:
        return None
    dep = f"{y}_fe" if f"{y}_fe" in df.columns else y
    fits = ols(df, dep, xs, cov="HC3", min_rows=min_rows)
    return fits[0] if fits else None


def hausman(fe: Fit, re: Fit) -> dict:
    """Wald form on the coefficients both models share (aligned by *name*; the FE
    names carry a ``_fe`` suffix), pseudo-inverse of the covariance difference."""
    shared = [n[:-3] for n in fe.names if n.endswith("_fe") and n[:-3] in re.names]
    if not shared:
        return {"H": float("nan"), "df": 0, "p_value": float("nan")}
    i_fe = [fe.names.index(v + "_fe") for v in shared]
    i_re = [re.names.index(v) for v in shared]
    d = fe.coef[i_fe] - re.coef[i_re]
    v = fe.cov[np.ix_(i_fe, i_fe)] - re.cov[np.ix_(i_re, i_re)]
    h = float(d @ np.linalg.pinv(v) @ d)
    return {"H": h, "df": len(shared), "p_value": chi2_upper(h, len(shared)), "variables": shared}


def chow_tests(df: DataFrame, breaks: dict[str, int], y: str, xs: list[str], year: str = "year", min_side: int = 5, shift: dict | None = None) -> list[dict]:
    """Chow F per break year from *one* Gram aggregate grouped by year: the pooled,
    pre (year < b) and post fits of every break are sums of year Grams."""
    per_year = gram_by(df, y, xs, [year], shift)
    k = len(xs) + 1
    years = sorted(per_year)
    out = []

    def total(sel):
        xtx = sum((per_year[t][0] for t in sel), np.zeros((k, k)))
        xty = sum((per_year[t][1] for t in sel), np.zeros(k))
        yy = sum(per_year[t][2] for t in sel)
        n = sum(per_year[t][3] for t in sel)
        return xtx, xty, yy, n

    full = total(years)
    rss_full, _ = rss_from_gram(*full[:3])
    for name, b in breaks.items():
        pre = total([t for t in years if t[0] < b])
        post = total([t for t in years if t[0] >= b])
        row = {"event": name, "break_year": int(b), "n": int(full[3]), "n_pre": int(pre[3]), "n_post": int(post[3])}
        if pre[3] < min_side or post[3] < min_side:
            row.update(f_stat=None, p_value=None)
        else:
            rss_split = rss_from_gram(*pre[:3])[0] + rss_from_gram(*post[:3])[0]
            d2 = full[3] - 2 * k
            f = ((rss_full - rss_split) / k) / (rss_split / max(d2, 1))
            row.update(f_stat=float(f), p_value=f_upper(float(f), k, d2))
        out.append(row)
    return out


def placebo_breaks(df: DataFrame, events: dict[str, int], y: str, xs: list[str], year: str = "year", window: int = 2, min_side: int = 3, shift: dict | None = None) -> list[dict]:
    """True-break F against every admissible placebo year (|yr - event| > window and
    index 3..T-3); all are used (<= 200), so the result is deterministic."""
    per_year = gram_by(df, y, xs, [year], shift)
    years = sorted(t[0] for t in per_year)
    allb = {str(t): t for t in years}
    res = {r["break_year"]: r for r in chow_tests(df, {**events, **allb}, y, xs, year, min_side, shift)}
    out = []
    for name, b in events.items():
        f_true = res[b]["f_stat"]
        placebo = [t for i, t in enumerate(years) if abs(t - b) > window and 3 <= i <= len(years) - 3]
        fs = [res[t]["f_stat"] for t in placebo if res[t]["f_stat"] is not None]
        mean = float(np.mean(fs)) if fs else None
        ratio = (f_true / (mean + 1e-10)) if (f_true is not None and mean is not None) else None
        perm_p = float(np.mean([f >= f_true for f in fs])) if (fs and f_true is not None) else None
        out.append({"event": name, "year": int(b), "F_true": f_true, "F_placebo_mean": mean, "F_ratio": ratio, "perm_p": perm_p, "n_placebo": len(fs)})
    return out


def vif(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """VIF_i = [R^-1]_ii from one correlation aggregate (complete cases)."""
    sub = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    aggs = [F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    row = sub.agg(*aggs).first()
    k = len(cols)
    r = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            v = row[f"{i}_{j}"]
            r[i, j] = r[j, i] = float(v) if v is not None else 0.0
    inv = np.linalg.pinv(r)
    return {c: float(inv[i, i]) for i, c in enumerate(cols)}


def residual_col(fit: Fit, y: str, xs: list[str]):
    pred = F.lit(float(fit.coef[0]))
    for i, x in enumerate(xs):
        pred = pred + F.lit(float(fit.coef[i + 1])) * F.col(x).cast("double")
    return F.col(y).cast("double") - pred


def breusch_pagan(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Regress e^2 on X: LM = n R^2 ~ chi2(k - 1)."""
    sub = df.select(y, *xs).na.drop()
    fit = ols(sub, y, xs)[0]
    e2 = sub.withColumn("_e2", F.pow(residual_col(fit, y, xs), 2))
    aux = ols(e2, "_e2", xs)[0]
    lm = aux.n * aux.r2
    return {"lm": lm, "df": len(xs), "p_value": chi2_upper(lm, len(xs)), "n": aux.n}


def sobel(a: float, sa: float, b: float, sb: float) -> float:
    return a * b / (math.sqrt(b * b * sa * sa + a * a * sb * sb) + 1e-10)
