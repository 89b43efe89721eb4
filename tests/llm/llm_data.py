"""Small tables for the tests of this folder."""

SF_SMALL = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """A documents table from (doc_id, text[, lang]) tuples, with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", 1) for r in rows]
    return spark.createDataFrame(full, DOC + ", class string, score int").repartition(3)
