"""Skew-safe global ranks and exact percentiles.

A window ``partitionBy(g).orderBy(v)`` sends a whole group to one task, and a
global ``orderBy(v)`` window sends the whole table to one task. Both break when
one group holds a third of the rows. Here values are first collapsed to
``(group, value, count)``, then cut into value buckets whose bounds come from a
bounded ``percentile_approx`` sketch. Running counts are computed per
``(group, bucket)`` and shifted by per-bucket offsets, so no task sees more than
about one bucket of distinct values, yet the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n_buckets(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def _bounds(df: DataFrame, key: str, n_buckets: int) -> list[float]:
    """Approximate quantile cut points of ``key`` (bounded sketch, tiny result)."""
    if n_buckets <= 1:
        return []
    qs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(F.percentile_approx(F.col(key).cast("double"), qs, 10000).alias("b")).first()
    vals = row["b"] if row is not None else None
    return sorted({float(x) for x in (vals or []) if x is not None})


def _bucket(key: Column, bounds: list[float]) -> Column:
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(arr, lambda b: b < key.cast("double")))


def value_positions(
    df: DataFrame,
    value: str,
    by: Iterable[str] = (),
    descending: bool = False,
    tiebreak: str | None = None,
) -> DataFrame:
    """Distinct values with multiplicity ``c``, number of rows ordered before them
    (``before``) and group size ``n``.

    With ``tiebreak`` the order key is ``(value, tiebreak ascending)`` so every row is
    its own position (row_number semantics); without it, ties share one row.
    """
    by = list(by)
    sign = -1.0 if descending else 1.0
    keys = [*by, value] + ([tiebreak] if tiebreak else [])
    vals = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_k", F.col(value).cast("double") * F.lit(sign))
    )
    bounds = _bounds(vals, "_k", _n_buckets(df))
    vals = vals.withColumn("_b", _bucket(F.col("_k"), bounds))
    order = [F.col("_k")]
    if tiebreak:
        order.append(F.col(tiebreak).asc())  # ties always broken by the key ascending
    w = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("_cum", F.sum("_c").over(w))
    tot = vals.groupBy(*by, "_b").agg(F.sum("_c").alias("_bt"))
    wo = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(wo), F.lit(0))).withColumn(
        "n", F.sum("_bt").over(Window.partitionBy(*by))
    )
    return vals.join(tot.drop("_bt"), [*by, "_b"]).select(
        *keys,
        F.col("_c").alias("c"),
        (F.col("_off") + F.col("_cum") - F.col("_c")).alias("before"),
        "n",
    )


def average_rank(df: DataFrame, value: str, out: str, by: Iterable[str] = ()) -> DataFrame:
    """Add ``out`` = average rank of ``value`` within ``by`` (ties share the mean rank,
    1-based, nulls keep a null rank), as in Spearman's correlation."""
    by = list(by)
    pos = value_positions(df, value, by).select(
        *by, value, (F.col("before") + (F.col("c") + F.lit(1)) / F.lit(2.0)).alias(out)
    )
    return df.join(pos, [*by, value], "left")


def row_number_rank(df: DataFrame, value: str, tiebreak: str, out: str, by: Iterable[str] = (), descending: bool = False) -> DataFrame:
    """Add ``out`` = 1-based row number ordered by ``value`` then ``tiebreak``
    (``(value, tiebreak)`` must be unique within ``by``)."""
    by = list(by)
    pos = value_positions(df, value, by, descending=descending, tiebreak=tiebreak).select(
        *by, value, tiebreak, (F.col("before") + F.lit(1)).alias(out)
    )
    return df.join(pos, [*by, value, tiebreak], "left")


def percentile_row(df: DataFrame, value: str, qs: Mapping[str, float], by: Iterable[str] = ()) -> DataFrame:
    """Exact linear-interpolation percentiles (numpy default, DuckDB ``quantile_cont``)
    of ``value`` per ``by`` group, nulls skipped: ``by`` keys plus one column per name."""
    by = list(by)
    pos = value_positions(df, value, by)
    sizes = pos.select(*by, "n").distinct()
    rows = None
    for name, q in qs.items():
        t = sizes.select(*by, F.lit(name).alias("_q"), (F.lit(float(q)) * (F.col("n") - 1)).alias("_p"), "n")
        rows = t if rows is None else rows.unionByName(t)
    rows = rows.withColumn("_lo", F.floor("_p").cast("long")).withColumn(
        "_hi", F.least(F.col("_lo") + 1, F.col("n") - 1)
    )
    p = pos.alias("p")
    # without groups this side is one row a percentile
    r = (rows if by else F.broadcast(rows)).alias("r")
    keycond = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]

    def in_run(idx: str) -> Column:
        return (F.col("p.before") <= F.col(f"r.{idx}")) & (F.col(f"r.{idx}") < F.col("p.before") + F.col("p.c"))

    lo = p.join(r, keycond + [in_run("_lo")]).select(*[F.col(f"r.{k}").alias(k) for k in by], F.col("r._q").alias("_q"), F.col("r._p").alias("_p"), F.col("r._lo").alias("_lo"), F.col(f"p.{value}").alias("_vlo"))
    hi = p.join(r, keycond + [in_run("_hi")]).select(*[F.col(f"r.{k}").alias(k) for k in by], F.col("r._q").alias("_q"), F.col(f"p.{value}").alias("_vhi"))
    both = lo.join(hi, [*by, "_q"]).select(
        *by, "_q", (F.col("_vlo") + (F.col("_p") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))).alias("_v")
    )
    names = list(qs)
    wide = both.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == n, F.col("_v"))).alias(n) for n in names])
    return wide
