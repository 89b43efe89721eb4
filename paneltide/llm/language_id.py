"""Language identification (operator 6): multinomial naive Bayes over hashed character
n-grams.

Features: the text is lower-cased, every code point that is not a letter or a mark
becomes a blank, runs of blanks become one; the 1-, 2- and 3-grams of the rest (within a
text, blank-padded) are hashed into ``2**bits`` buckets. Training counts every n-gram of
every training text: each task sums its own (language, bucket) counts, Spark adds them.
The model is a (languages x buckets) matrix of log probabilities with add-``alpha``
smoothing and log document shares as priors. Its size depends on the number of
languages only (256 KB each at 16 bits), which is checked before it is broadcast.
Scoring adds, for each whole text, the matrix columns of its n-grams in numpy.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no
training row every text is ``und`` with score 0. Ties go to the language that sorts
first. Rows repeated or sharing ids are scored one by one. Extra columns are ignored by
:func:`fit` and kept by :func:`predict`.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

BITS = 16
ALPHA = 0.1
MAX_MODEL_BYTES = 256 << 20
_CHUNK_CHARS = 1 << 18
UNDETERMINED = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """1 for letters, 2 for marks, 0 otherwise, by code point (built once a worker)."""
    if not _LETTER:
        kinds = {"L": 1, "M": 2}
        _LETTER.append(np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], dtype=np.uint8))
    return _LETTER[0]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _CHUNK_CHARS and i > lo:
            yield lo, i
            lo, size = i, len(t or "")
    if len(texts) > lo:
        yield lo, len(texts)


def ngrams(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every hashed n-gram and whether each row has a letter."""
    low = [(t or "").lower() for t in texts]
    if not low:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype=bool)
    joined = "\n" + "\n\n".join(low) + "\n"  # each text between two blanks of its own
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _letters()[cp]
    row = np.repeat(np.arange(len(low)), np.array([len(t) + 2 for t in low], dtype=np.int64))
    has = np.zeros(len(low), dtype=bool)
    has[row[kind == 1]] = True
    c = np.where(kind > 0, cp, 0)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (row[1:] != row[:-1])
    c, row = c[keep].astype(np.uint64), row[keep]
    rows, hashes = [], []
    h = np.zeros(len(c), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = (h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            # inside one text; a gram of blanks only says nothing
            ok = (c[:m] != 0) | (c[n - 1 :] != 0)
            if n > 1:
                ok &= row[:m] == row[n - 1 :]
            x = h[ok]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            rows.append(row[:m][ok])
            hashes.append((x >> np.uint64(64 - bits)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(rows), np.concatenate(hashes), has


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (2**bits, languages) float64 log probabilities
    prior: np.ndarray
    bits: int


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                row, bucket, _ = ngrams(texts[lo:hi], bits)
                names, code = np.unique(np.array(langs[lo:hi], dtype=object).astype(str), return_inverse=True)
                got = np.bincount(code[row] * (1 << bits) + bucket, minlength=len(names) << bits).reshape(len(names), -1)
                for k, name in enumerate(names.tolist()):
                    counts[name] = counts.get(name, 0) + got[k]
                    docs[name] = docs.get(name, 0) + int((code == k).sum())
        for name, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.record_batch(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], docs[name]).astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    return run


def fit(docs: DataFrame, train, bits: int = BITS, alpha: float = ALPHA) -> Model:
    """Count the rows of ``docs(text, lang)`` where ``train`` (a Column) holds and text
    and lang are not null; all of them, no sample."""
    rows = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("text").cast("string"), F.col("lang").cast("string")
    )
    counted = rows.mapInArrow(_count(bits), "lang string, bucket int, n bigint")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "lid-counts")
    names = sorted(r["lang"] for r in counted.where("bucket = -1").select("lang").collect())
    if (len(names) << bits) * 8 > MAX_MODEL_BYTES:
        raise ValueError(f"{len(names)} languages x 2**{bits} buckets exceed the broadcast bound of {MAX_MODEL_BYTES} bytes; lower bits")
    got = counted.toArrow()  # at most languages x buckets rows, checked above
    code = {n: k for k, n in enumerate(names)}
    lang = np.array([code[x] for x in got.column("lang").to_pylist()], dtype=np.int64)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    counts = np.full((1 << bits, len(names)), alpha)
    real = bucket >= 0
    counts[bucket[real], lang[real]] += n[real]
    prior = np.zeros(len(names))
    prior[lang[~real]] = n[~real]
    with np.errstate(divide="ignore"):
        return Model(names, np.log(counts / counts.sum(axis=0)) if names else counts, np.log(prior / max(prior.sum(), 1)), bits)


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text (given the learned languages)."""
    pred, prob = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return pred, prob
    for lo, hi in _chunks(texts):
        row, bucket, has = ngrams(texts[lo:hi], model.bits)
        total = np.stack([np.bincount(row, weights=model.table[bucket, k], minlength=hi - lo) for k in range(len(model.langs))], axis=1)
        total += model.prior
        best = total.argmax(axis=1)
        post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i in np.flatnonzero(has):
            pred[lo + i] = model.langs[best[i]]
        prob[lo:hi] = np.where(has, post, 0)
    return pred, prob


def predict(docs: DataFrame, model: Model, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language of ``text`` and its score appended."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, prob = score(batch.column(at).to_pylist(), sent.value)
            yield pa.record_batch(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(prob)], names=[*batch.schema.names, lang_col, score_col]
            )

    fields = [*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return docs.mapInArrow(run, T.StructType(fields))


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3 (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows whose language is identified with at least ``min_score`` (same columns)."""
    marked = predict(docs, model, "__lid_lang", "__lid_score")
    kept = marked.where((F.col("__lid_lang") != UNDETERMINED) & (F.col("__lid_score") >= min_score))
    return kept.drop("__lid_lang", "__lid_score")
