"""Shared helpers for registered queries: fixture access and output finishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SIG_DIGITS, round_sig, sql_round_sig  # noqa: F401
from ..operators import panel as P
from . import fixtures


def finish(df: DataFrame) -> DataFrame:
    """Round every floating column to SIG_DIGITS significant digits."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_sig(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def R(body: str, doubles: str) -> str:
    """Oracle twin of :func:`finish`: round the listed double columns."""
    cols = doubles.split()
    if not cols:
        return body
    rep = ", ".join(f"{sql_round_sig(c)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) q"


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.panel(spark, sf)


def meta(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.entity_meta(spark, sf)


def prep(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared panel, materialised once per session (many analyses read it)."""
    return fixtures._memo(spark, sf, "prep", lambda: P.prepare(fixtures.panel(spark, sf), fixtures.entity_meta(spark, sf), P.FIXTURE))
