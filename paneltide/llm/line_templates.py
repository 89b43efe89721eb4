"""Line dedup (operator 3) by a log-template tree of fixed depth.

Lines are parsed like log records. A token that holds a digit is a variable field
(``<*>``). The path of a line in the tree is its token count and its first ``depth``
tokens; the lines that share a path form a leaf. A leaf generalises its remaining
fields: at each position its template has the token found in most (document, line)
pairs; positions where a line differs from it are that line's fields, and a line belongs
to the template if at least ``similar`` percent of its tokens equal it. The lines of a
leaf that did not match vote again, round by round, so a leaf keeps all the templates its
votes find; a group of lines whose template does not recur (the votes of several templates
can mix) is split by the most frequent tokens with at most half of its votes. A template
whose field values are more frequent than its fixed tokens can be split with them, and each
part then has to recur by itself. Besides, every masked line is a template of its own. A template recurs if it is found in at least
``min_docs`` different documents; its lines are dropped but for the earliest one
(smallest doc_id, then line number), so no content leaves the corpus entirely.

A masked line of ``long_tokens`` tokens or more hardly stands twice by chance: it is
dropped from its second document on, the first document keeps it. A document that has
``copy_percent`` of its tokens or more in several lines of earlier documents (or
``SINGLE_PERCENT`` in one) is a copy as a whole; it keeps its long lines, since half a
copy is worse than one that document-level dedup can still find.

Only hashes, ids and offsets of lines are shuffled; tokens are read again for one
representative of each distinct line in leaves that can recur and hold several lines.
Counts are combined before each shuffle, and hot lines meet joins that AQE splits.

Defined cases: null text: no line, text stays null. Empty text, lines of fewer than
``min_tokens`` tokens (1 takes every line) and lines whose tokens are all fields (numbers
alone): never dropped. Null doc_id: such rows count as one document that
ranks last. Rows repeated under a doc_id count as one document; equal line numbers tie
and both stay. Extra columns are kept by :func:`drop_templates`; the helper columns are
prefixed ``__lt_``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

DEPTH = 4
SIMILAR = 70
MIN_DOCS = 10
MIN_TOKENS = 4
LONG_TOKENS = 50
COPY_PERCENT = 35
SINGLE_PERCENT = 80
FIELD = "<*>"
_TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
_DIGIT = re.compile(r"[0-9]")


def parse(line: str) -> list[str]:
    """Tokens of a line, variable fields masked."""
    tokens = _TOKEN.findall(line)
    if _DIGIT.search(line):
        tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _lines(depth: int, min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, idx, leaf, line, width = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, raw in enumerate(text.split("\n") if text else ()):
                    tokens = parse(raw)
                    if len(tokens) >= min_tokens and any(t != FIELD for t in tokens):
                        at.append(i)
                        idx.append(k)
                        leaf.append(_hash("\n".join([str(len(tokens)), *tokens[:depth]])))
                        line.append(_hash(" ".join(tokens)))
                        width.append(len(tokens))
            pick = pa.array(at, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(pick), batch.column(1).take(pick), *(pa.array(c, pa.int64()) for c in (idx, leaf, line, width))],
                names=["doc_id", "key", "idx", "leaf", "line", "width"],
            )

    return run


def _tokens(depth: int):
    """(leaf, line, n_docs, width, position, token) of the wanted lines of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = text.split("\n")
                for w in wanted:
                    tokens = parse(lines[w["idx"]])
                    for pos in range(min(depth, len(tokens) - 1), len(tokens)):
                        for c, v in zip(cols, (w["leaf"], w["line"], w["n_docs"], len(tokens), pos, tokens[pos])):
                            c.append(v)
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["leaf", "line", "n_docs", "width", "pos", "token"])

    return run


def _round(lines: DataFrame, rest: DataFrame, depth: int, similar: int, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """One vote in each group of ``rest``: (leaf, line, first) of the lines whose template
    recurs, and the tokens of the other lines in the groups of the next round."""
    votes = rest.groupBy("grp", "pos", "token").agg(F.sum("n_docs").alias("votes"))
    modal = votes.groupBy("grp", "pos").agg(F.min(F.struct((-F.col("votes")).alias("v"), "token")).getField("token").alias("token"))
    # the leading tokens are equal by construction: min(depth, width - 1) of them
    equal = rest.join(modal, ["grp", "pos", "token"]).groupBy("grp", "leaf", "line").agg(F.count("*").alias("same"), F.max("width").alias("width"))
    equal = equal.where((F.col("same") + F.least(F.lit(depth), F.col("width") - 1)) * 100 >= F.lit(similar) * F.col("width"))
    matched = equal.select("grp", "leaf", "line")
    members = lines.join(matched, ["leaf", "line"])
    general = members.groupBy("grp", "doc_id").agg(F.min(F.struct("idx", "key")).alias("f")).groupBy("grp").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("f.idx").alias("idx"))).alias("first")
    ).where(F.col("n") >= min_docs).drop("n")
    found = materialise(matched.join(general, "grp"), "lt-found")
    # groups that gave a template vote again without its lines; in the others each line
    # follows its most frequent token with at most half of the votes (a template with more
    # than half would have been the vote), so the rounds grow with the logarithm of a group
    left = rest.join(found.select("leaf", "line"), ["leaf", "line"], "left_anti")
    total = votes.groupBy("grp", "pos").agg(F.sum("votes").alias("t")).groupBy("grp").agg(F.max("t").alias("t")).join(found.select("grp").distinct(), "grp", "left_anti")
    apart = votes.join(total, "grp").where(F.col("votes") * 2 <= F.col("t")).select("grp", "pos", "token", "votes")
    dealt = left.join(apart, ["grp", "pos", "token"]).groupBy("grp", "leaf", "line").agg(
        F.max("n_docs").alias("n_docs"), F.min(F.struct((-F.col("votes")).alias("v"), "pos", "token")).alias("by")
    ).select(F.xxhash64("grp", "by.pos", "by.token").alias("to"), "leaf", "line", "n_docs")
    again = left.join(found.select("grp").distinct(), "grp", "left_semi").select(F.col("grp").alias("to"), "leaf", "line", "n_docs").distinct()
    moved = dealt.union(again)
    # groups found in too few documents are done; so is a line alone, dropped as an exact one
    several = moved.groupBy("to").agg(F.sum("n_docs").alias("n"), F.count("*").alias("m")).where((F.col("n") >= min_docs) & (F.col("m") > 1)).select("to")
    moved = materialise(moved.join(several, "to"), "lt-moved")
    enough = lines.join(moved, ["leaf", "line"]).select("to", "doc_id").distinct().groupBy("to").count().where(F.col("count") >= min_docs).select("to")
    moved = moved.join(enough, "to").select("leaf", "line", "to")
    left = left.join(moved, ["leaf", "line"]).drop("grp").withColumnRenamed("to", "grp")
    return found.select("leaf", "line", "first"), materialise(left, "lt-rest")


def _second_documents(lines: DataFrame, per_line: DataFrame, long_tokens: int, copy_percent: int) -> DataFrame:
    """(doc_id, key, idx) of long lines that an earlier document has, but for copies."""
    known = per_line.where("n_docs > 1").select("leaf", "line", F.struct("first.no", "first.doc_id").alias("origin"))
    own = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")
    again = F.col("origin").isNotNull() & ~own.eqNullSafe(F.col("origin"))
    docs = lines.join(known, ["leaf", "line"], "left").groupBy("doc_id", "key").agg(
        F.sum("width").alias("tokens"), F.sum(F.when(again, F.col("width")).otherwise(0)).alias("old"), F.count_if(again).alias("n_old"),
        F.collect_set(F.when(again & (F.col("width") >= long_tokens), F.col("idx"))).alias("long"),
    )
    least = F.when(F.col("n_old") > 1, F.lit(copy_percent)).otherwise(F.lit(max(SINGLE_PERCENT, copy_percent)))
    docs = docs.where((F.size("long") > 0) & (F.col("old") * 100 < F.col("tokens") * least))
    return docs.select("doc_id", "key", F.explode("long").alias("idx"))


def recurring_lines(
    docs: DataFrame, depth: int = DEPTH, similar: int = SIMILAR, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS,
    long_tokens: int = LONG_TOKENS, copy_percent: int = COPY_PERCENT,
) -> DataFrame:
    """(doc_id, key, idx) of the lines to drop; ``key`` is the hash of the text."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    lines = materialise(own.mapInArrow(_lines(depth, min_tokens), "doc_id bigint, key bigint, idx bigint, leaf bigint, line bigint, width bigint"), "lt-lines")
    # distinct documents of each line and of each leaf
    per_doc = lines.groupBy("leaf", "line", "doc_id").agg(F.min(F.struct("idx", "key")).alias("f"))
    per_line = per_doc.groupBy("leaf", "line").agg(
        F.count("*").alias("n_docs"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("f.idx").alias("idx"), F.col("f.key").alias("key"))).alias("first")
    )
    leaves = lines.select("leaf", "doc_id").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf", F.lit(True).alias("shared"))
    # lines that only one document has, in a leaf of few, play no part
    per_line = per_line.join(leaves, "leaf", "left").where("shared OR n_docs > 1")
    every = materialise(per_line.withColumn("shared", F.coalesce("shared", F.lit(False))), "lt-distinct")
    twice = _second_documents(lines, every, long_tokens, copy_percent)
    per_line = every.where("shared").drop("shared")
    exact = per_line.where(F.col("n_docs") >= min_docs).select("leaf", "line", "first")
    # leaves with several lines: tokens of one occurrence of each
    several = per_line.groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1").select("leaf")
    reps = per_line.join(several, "leaf").groupBy(F.col("first.doc_id").alias("r_id"), F.col("first.key").alias("r_key")).agg(
        F.collect_list(F.struct(F.col("first.idx").alias("idx"), "leaf", "line", "n_docs")).alias("wanted")
    )
    # the same sort-merge join at every size: the representatives grow with the corpus
    texts = own.join(reps.hint("merge"), own["doc_id"].eqNullSafe(reps["r_id"]) & (own["key"] == reps["r_key"])).select("doc_id", "key", "text", "wanted")
    texts = texts.dropDuplicates(["doc_id", "key"]).select("text", "wanted")
    tokens = materialise(texts.mapInArrow(_tokens(depth), "leaf bigint, line bigint, n_docs bigint, width bigint, pos bigint, token string"), "lt-tokens")
    # a leaf starts as one group of lines; a round takes one template out of each group
    rest = tokens.withColumn("grp", F.col("leaf"))
    general = None
    while True:
        found, rest = _round(lines, rest, depth, similar, min_docs)
        general = found if general is None else general.union(found)
        if rest.isEmpty():
            break
    here = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "idx")
    by_leaf = lines.join(general, ["leaf", "line"]).where(~here.eqNullSafe(F.col("first"))).select("doc_id", "key", "idx")
    exact = exact.select("leaf", "line", F.struct(F.col("first.no").alias("no"), F.col("first.doc_id").alias("doc_id"), F.col("first.idx").alias("idx")).alias("first"))
    by_line = lines.join(exact, ["leaf", "line"]).where(~here.eqNullSafe(F.col("first"))).select("doc_id", "key", "idx")
    return by_leaf.union(by_line).union(twice).distinct()


def drop_templates(docs: DataFrame, found: DataFrame, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` with the lines in ``found`` (of :func:`recurring_lines`) taken out of
    ``text``; optional counts are appended under the given names."""
    gone = found.groupBy("doc_id", "key").agg(F.collect_list("idx").alias("__lt_gone"))
    gone = gone.select(F.col("doc_id").alias("__lt_id"), F.col("key").alias("__lt_key"), "__lt_gone")
    keyed = docs.withColumn("__lt_own", F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(gone.hint("merge"), keyed["doc_id"].cast("bigint").eqNullSafe(gone["__lt_id"]) & (keyed["__lt_own"] == gone["__lt_key"]), "left")
    joined = joined.select(*[joined[f"`{c}`"] for c in docs.columns], "__lt_gone")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, dropped = [], [], []
            for text, ids in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = text.split("\n") if text else []
                total.append(len(lines))
                out = set(ids or ())
                dropped.append(len(out))
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in out) if out else text)
            cols = [*batch.columns[:at], pa.array(kept, batch.column(at).type), *batch.columns[at + 1 : -1]]
            names = list(batch.schema.names[:-1])
            for name, values in ((n_lines, total), (n_dropped, dropped)):
                if name:
                    cols.append(pa.array(values, pa.int64()))
                    names.append(name)
            yield pa.record_batch(cols, names=names)

    fields = [*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in (n_lines, n_dropped) if n)]
    return joined.mapInArrow(run, T.StructType(fields))
