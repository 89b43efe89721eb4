"""Result sinks: tables (Parquet/CSV) and nested results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write a result table; ``partition_by`` (e.g. ``['year']``) enables partition pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON string per row (nested structs/arrays/maps serialised by Spark)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested results as JSON lines; NaN/inf are written as null by Spark's JSON writer."""
    df.write.mode(mode).json(path)
