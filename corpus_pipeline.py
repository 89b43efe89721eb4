"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark
decontamination, byte-level BPE. Each stage takes ``(spark, docs, sf_dir)`` and returns a
DataFrame; its result is written as Parquet and read again as the next stage's input, so
a lost executor costs a re-read. All stages but the last keep the columns of the input
documents; ``text`` may get shorter, and ``n_chars`` follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm import decontaminate, jaccard_join, language_id, line_templates
from paneltide.llm.common import table
from paneltide.llm.queries import bpe
from paneltide.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Learns from the given ``lang`` labels (two of three folds, as its query
    does) and drops the documents whose language can't be told: null texts, texts without
    a letter, and texts whose best language has a posterior below 0.5."""
    model = language_id.fit(docs, language_id.fold("doc_id") != 1)
    return language_id.keep_identified(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Recurring template lines go, but for their earliest occurrence; a
    document that loses every line that is not blank goes as a whole."""
    out = line_templates.drop_templates(docs, line_templates.recurring_lines(docs, min_tokens=1), n_dropped="__dropped")
    out = out.where((F.col("__dropped") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. Of each group linked by 5-word shingle similarity 0.8, the document
    with the smallest doc_id stays."""
    return jaccard_join.keep_one_of_each(docs, width=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. (doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return bpe(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("jaccard_join", keep_one_near_copy),
    ("decontaminate", drop_benchmark_leaks),
    ("byte_bpe", tokenise),
]

#: Naive Bayes and BPE merges have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
