"""Substring dedup (operator 7) by line or paragraph hashing.

A text is cut into units: lines (``\\n``), paragraphs (blank lines), and, as the finest,
the sentences of a line (up to ``.``, ``!`` or ``?`` before a blank), so a passage is also
found where it stands inside a longer line. Several kinds may be asked for at once; a
unit that repeats at any of them goes. A unit is
normalised (lower case, runs of ASCII white space to one blank, trimmed) and hashed to 128
bits; units with fewer than ``min_words`` words are never removed. Digests are grouped
over all documents; the earliest ranked occurrence (smallest doc_id, then smallest
offset) stays, every other one is removed from its text together with its line end. The
removed spans are kept, merged, as code point offsets into the original text.

Only digests, ids and offsets are shuffled by digest: the minimum is combined before the
shuffle, and the join back is a plain equi-join whose hot digests AQE splits.

Defined cases: null text: no unit, nothing removed, kept text null. Empty text: one
empty unit, kept. A null doc_id ranks after every other. Rows repeated under one doc_id
count as the same document: equal offsets tie and both stay. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 6
_WORD = re.compile(r"[^ \t\n\r\f\v]+")
_SENTENCE = re.compile(r".*?[.!?][ \t]+|.+")
_BREAK = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}


def units(text: str, kind: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end of the words, end with the break, unit) of every unit."""
    at = 0
    if kind == "sentence":
        for start, end, stop, line in units(text, "line"):
            if not line:
                yield start, end, stop, line
            for m in _SENTENCE.finditer(line):
                last = m.end() == len(line)
                yield start + m.start(), start + m.end(), stop if last else start + m.end(), m.group()
        return
    for m in _BREAK[kind].finditer(text):
        yield at, m.start(), m.end(), text[at : m.start()]
        at = m.end()
    yield at, len(text), len(text), text[at:]


def digest(unit: str, min_words: int) -> bytes | None:
    words = _WORD.findall(unit.lower())
    if len(words) < min_words:
        return None
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _emit(kinds: tuple[str, ...], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            cols: list[list] = [[], [], [], [], []]
            for i, t in enumerate(texts.to_pylist()):
                if t is None:
                    continue
                for start, end, unit in {(a, z, u) for kind in kinds for a, _, z, u in units(t, kind)}:
                    d = digest(unit, min_words)
                    if d is not None:
                        for c, v in zip(cols, (i, start, end, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True))):
                            c.append(v)
            pick = pa.array(cols[0], pa.int64())
            yield pa.record_batch(
                [ids.take(pick), keys.take(pick), *(pa.array(c, pa.int64()) for c in cols[1:])],
                names=["doc_id", "key", "start", "stop", "d1", "d2"],
            )

    return run


def _cut(kinds: tuple[str, ...]):
    """Texts without their spans; units are counted at the finest (last) kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for t, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged: list[list[int]] = []
                for x in sorted((s["start"], s["stop"]) for s in gone or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                total = inside = k = 0
                for start, _, stop, _ in units(t, kinds[-1]) if t is not None else ():
                    total += 1
                    while k < len(merged) and merged[k][1] <= start:
                        k += 1
                    inside += k < len(merged) and merged[k][0] <= start and stop <= merged[k][1] and stop > start
                out, at = [], 0
                for a, z in merged:
                    out.append(t[at:a])
                    at = z
                for c, v in zip(cols, (total, inside, [{"start": a, "stop": z} for a, z in merged], "".join([*out, t[at:]]) if merged else t)):
                    c.append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), span, pa.string())))],
                names=["doc_id", "n_units", "n_removed", "removed", "text"],
            )

    return run


def dedup_units(docs: DataFrame, kinds: tuple[str, ...] = ("line", "sentence"), min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_units, n_removed, removed array<struct<start,stop>>, text) for each row of
    ``docs(doc_id, text)``; ``text`` is what stays, units are counted at the last kind."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("key"), "text")
    found = own.mapInArrow(_emit(kinds, min_words), "doc_id bigint, key bigint, start bigint, stop bigint, d1 bigint, d2 bigint")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("start"))
    first = found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = found.join(first, ["d1", "d2"]).where(~rank.eqNullSafe(F.col("first")))
    gone = gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("removed"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), "removed")
    joined = own.join(gone, own["doc_id"].eqNullSafe(gone["g_id"]) & (own["key"] == gone["g_key"]), "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(_cut(kinds), "doc_id bigint, n_units bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, text string")
