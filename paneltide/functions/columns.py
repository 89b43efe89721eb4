"""Small scalar Column helpers: labels, logs, distances, hashed uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def log1p0(c: Column) -> Column:
    """ln(1 + x) with a missing x taken as 0."""
    return F.log1p(F.coalesce(c.cast("double"), F.lit(0.0)))


def log_clip1(c: Column) -> Column:
    """ln(max(x, 1)); a missing x stays missing (Spark's greatest would skip it)."""
    return F.when(c.isNotNull(), F.log(F.greatest(c.cast("double"), F.lit(1.0))))


def sig_stars(p: Column) -> Column:
    """Significance label: <.001 '***', <.01 '**', <.05 '*', <.1 dagger, else ''; null p -> ''."""
    return (
        F.when(p < 0.001, "***")
        .when(p < 0.01, "**")
        .when(p < 0.05, "*")
        .when(p < 0.1, "†")
        .otherwise("")
    )


def excludes_zero(lo: Column, hi: Column) -> Column:
    """Interval flag: a star when both bounds have the same sign."""
    return F.when(lo * hi > 0, "★").otherwise("")


def verdict(flag: Column) -> Column:
    """Supported / Not supported / Partial (unknown) from a nullable boolean."""
    return F.when(flag, "✓").when(~flag, "✗").otherwise("Partial")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a 6371 km sphere, argument clipped to [0, 1]."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = p2 - p1
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def md5_uniform(*parts: Column | str, salt: str = "7") -> Column:
    """Deterministic uniform in [0, 1) from md5 of ``salt|part|...``.

    The same value is computed by DuckDB from the same string, so resampling and
    permutation operators stay SQL-checkable and identical on every engine and
    under any partitioning or task retry.
    """
    cols = [F.lit(salt)] + [F.col(p) if isinstance(p, str) else p for p in parts]
    s = F.concat_ws("|", *[c.cast("string") for c in cols])
    hex8 = F.substring(F.md5(s), 1, 8)
    return F.conv(hex8, 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def md5_uniform_sql(*parts: str, salt: str = "7") -> str:
    """DuckDB twin of :func:`md5_uniform` (for oracle SQL)."""
    inner = " || '|' || ".join([f"'{salt}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5({inner}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


SIG_DIGITS = 10


def round_sig(c, digits: int = SIG_DIGITS):
    """Round to ``digits`` significant digits with the arithmetic DuckDB uses
    (``round(x * 10^s) / 10^s``, half away from zero). Values computed by
    different summation orders agree to ~1e-13 relative, so after this step both
    engines hold the very same double and any later rounding cannot split them;
    decimal rounding at a fixed place would hit exact .5 ties of averages."""
    # absolute 1e-12 grid first: exact zeros computed as +-1e-17 noise become 0
    x = F.round(c.cast("double") * F.lit(1e12)) / F.lit(1e12)
    e = F.floor(F.log10(F.abs(x)))
    s = F.lit(digits - 1) - e
    up = F.round(x * F.pow(F.lit(10.0), s)) / F.pow(F.lit(10.0), s)
    down = F.round(x / F.pow(F.lit(10.0), -s)) * F.pow(F.lit(10.0), -s)
    return F.when(x.isNull() | (x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).when(s >= 0, up).otherwise(down)


def sql_round_sig(c: str, digits: int = SIG_DIGITS) -> str:
    x = f"(round(CAST({c} AS DOUBLE) * 1e12) / 1e12)"
    e = f"floor(log10(abs({x})))"
    s = f"({digits - 1} - {e})"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = 0 OR isnan({x}) OR isinf({x}) THEN {x} "
        f"WHEN {s} >= 0 THEN round({x} * pow(10.0, {s})) / pow(10.0, {s}) "
        f"ELSE round({x} / pow(10.0, -{s})) * pow(10.0, -{s}) END"
    )
