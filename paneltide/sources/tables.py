"""Readers for the input tables, the panel file and spatial weights.

All readers return lazy DataFrames; Catalyst prunes columns and pushes filters
into the Parquet scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Panel file layout (entity x year), as written by the panel builder.
PANEL_SCHEMA = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("n_papers", T.DoubleType()),
        T.StructField("mean_patent_cit", T.DoubleType()),
        T.StructField("tech_prox", T.DoubleType()),
        T.StructField("research_novelty", T.DoubleType()),
        T.StructField("topic_entropy", T.DoubleType()),
        T.StructField("intra_cohesion", T.DoubleType()),
        T.StructField("oa_share", T.DoubleType()),
        T.StructField("state", T.IntegerType()),
        T.StructField("imputed_share", T.DoubleType()),
    ]
)

WEIGHT_SCHEMA = "kind string, i string, j string, w double"


class MissingInputError(FileNotFoundError):
    """An input dataset is absent; the message names it and how to produce it."""


def _read(spark: SparkSession, path: str, name: str, reader) -> DataFrame:
    try:
        return reader(path)
    except AnalysisException as exc:  # path does not exist / unreadable
        raise MissingInputError(f"input '{name}' not found at {path}: {exc}") from exc


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, e.g. ``read_table(spark, dir, 'lineitem')``."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    return _read(spark, path, name, spark.read.parquet)


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN -> null in every floating column, once at the source (pandas treats NaN
    as missing; Spark's avg would be poisoned by it)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            cols.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_panel(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType = PANEL_SCHEMA) -> DataFrame:
    """Panel file (CSV with header, optional UTF-8 BOM, or Parquet), NaN -> null."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        reader = lambda p: spark.read.schema(schema).csv(p, header=True, multiLine=True, escape='"', encoding="UTF-8")
    else:
        reader = spark.read.parquet
    return normalise_nan(_read(spark, path, "panel", reader))


def read_weights(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """Long sparse weights ``(kind, i, j, w)``; ``kinds`` not present are reported."""
    w = _read(spark, path, "weights", lambda p: spark.read.schema(WEIGHT_SCHEMA).parquet(p))
    if kinds:
        w = w.where(F.col("kind").isin(*kinds))
    return w


def resolve_optional(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add each optional column that is absent, with its default (plan-time check)."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def column_report(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Completeness report: one row per wanted column with presence and non-null share."""
    spark = df.sparkSession
    present = [c for c in wanted if c in df.columns]
    if present:
        agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in present])
        stacked = agg.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("column"), F.lit(True).alias("present"), (F.col(c) / F.col("_n")).alias("non_null_share")) for c in present])
            ).alias("s")
        ).select("s.*")
    else:
        stacked = spark.createDataFrame([], "column string, present boolean, non_null_share double")
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        stacked = stacked.unionByName(
            spark.createDataFrame([(c, False, None) for c in missing], "column string, present boolean, non_null_share double")
        )
    return stacked
