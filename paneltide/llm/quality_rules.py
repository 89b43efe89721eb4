"""Quality rules (operator 13): base counts, and distribution divergence from language
references.

:func:`fit` counts, over all documents of a language with at least ``min_words`` words,
the characters of each class and every word; the shares of the classes and of the
``top_words`` most frequent words (the rest is one more bin) are the language's reference.
:func:`judge` compares each document's own shares with the reference of its language by
the Jensen-Shannon distance (base 2, 0 to 1):

- character classes, for texts of ``min_chars`` code points or more: at most
  ``max_char_distance``;
- common words, for texts of ``min_words`` words or more: at most ``max_word_distance``
  beyond ``sqrt(bins / (8 n ln 2))``, the distance that n words drawn from the reference
  itself would be expected to have.

Shorter texts have too few counts to be judged that way; the base rules alone decide.

Words are maximal runs without ASCII white space. For the histogram they are lower-cased
and lose sentence punctuation at both ends; only words with a letter can be common. Every
count is exact and over whole texts: a task sums its own words and hands them on whenever
its table is full, Spark adds them up. The references hold ``top_words`` + 7 numbers a
language, which is checked against a bound before they are sent to tasks.

Defined cases: null text counts as empty (no words: fails the base rules). A null lang, or
one without a reference, is compared with every reference and judged by the nearest (the
smaller sum of both distances; ties to the language that sorts first); with no reference
at all the base rules alone decide. Repeated rows and ids are judged one by one. Ties
among words go to the word that sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
TOP_WORDS = 100
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.12
MAX_REFERENCE_BYTES = 64 << 20
_CHUNK_CHARS = 1 << 18
_TABLE_WORDS = 1 << 18

# Fixed classes: lower-case and other letters and marks, capitals, digits and numbers,
# white space, sentence punctuation, anything else.
CLASSES = ("letter", "capital", "number", "space", "punctuation", "other")
PUNCTUATION = ".,;:!?'\"()-"
SPACE = "\t\n\v\f\r "
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_LETTER = re.compile(r"[^\W\d_]")
_KIND: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Class of each code point (built once a worker)."""
    if not _KIND:
        table = np.full(sys.maxunicode + 1, 5, np.uint8)
        for c in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(c))
            table[c] = 1 if k in ("Lu", "Lt") else 0 if k[0] in "LM" else 2 if k[0] == "N" else 5
        table[[ord(c) for c in SPACE]] = 3
        table[[ord(c) for c in PUNCTUATION]] = 4
        _KIND.append(table)
    return _KIND[0]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``_CHUNK_CHARS`` together; a longer text is a run by itself."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > _CHUNK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def class_counts(texts: list[str]) -> np.ndarray:
    """(texts x classes) characters of each class."""
    out = np.zeros((len(texts), len(CLASSES)), np.int64)
    for lo, hi in _chunks(texts):
        cp = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(hi - lo), [len(t) for t in texts[lo:hi]])
        width = len(CLASSES)
        out[lo:hi] = np.bincount(row * width + _kinds()[cp], minlength=(hi - lo) * width).reshape(-1, width)
    return out


def word_counts(text: str) -> Counter:
    """Lower-cased words without sentence punctuation at their ends (may be empty)."""
    out: Counter = Counter()
    for raw, n in Counter(text.lower().encode("utf-8", "surrogatepass").split()).items():
        out[raw.decode("utf-8", "surrogatepass").strip(PUNCTUATION)] += n
    return out


@dataclass
class References:
    langs: list[str]
    classes: np.ndarray  # (languages x classes) shares
    words: list[dict[str, int]]  # bin of each common word
    shares: np.ndarray  # (languages x (top_words + 1)), the last bin is every other word


def _count(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, str | None], int] = {}

        def emit() -> pa.RecordBatch:
            langs, names = zip(*words) if words else ((), ())
            out = pa.record_batch([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])
            words.clear()
            return out

        classes: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, text, mine in zip(langs, texts, class_counts(texts)):
                found = word_counts(text)
                n = found.total()
                if n < min_words:
                    continue
                classes[lang] = classes.get(lang, 0) + mine
                words[lang, None] = words.get((lang, None), 0) + n  # a null word is the total
                for w, k in found.items():
                    if _LETTER.search(w):
                        words[lang, w] = words.get((lang, w), 0) + k
                if len(words) > _TABLE_WORDS:
                    yield emit()
        # class totals travel as one-character names that no stripped word can have
        for lang, total in classes.items():
            for k, n in enumerate(total.tolist()):
                words[lang, f" {k}"] = n
        yield emit()

    return run


def fit(docs: DataFrame, top_words: int = TOP_WORDS, min_words: int = MIN_WORDS) -> References:
    """References of all languages in ``docs(lang, text)``; null languages teach nothing."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = own.mapInArrow(_count(min_words), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "qr-counts")
    extra = F.coalesce(F.col("word").startswith(" "), F.lit(True))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    # a plain limit on the rank: each task passes on its own top words only
    common = counted.where(~extra).withColumn("rank", rank).where(F.col("rank") <= top_words)
    best = materialise(common.unionByName(counted.where(extra).withColumn("rank", F.lit(0))), "qr-references")
    n_langs = best.where("word IS NULL").count()
    if n_langs * (top_words + 8) * 64 > MAX_REFERENCE_BYTES:
        raise ValueError(f"{n_langs} languages x {top_words} words exceed the bound of {MAX_REFERENCE_BYTES} bytes; lower top_words")
    rows = best.orderBy("lang", "rank").collect()  # top_words + 7 rows a language, checked above
    langs = sorted({r["lang"] for r in rows})
    at = {name: k for k, name in enumerate(langs)}
    classes, shares = np.zeros((len(langs), len(CLASSES))), np.zeros((len(langs), top_words + 1))
    total, words = np.zeros(len(langs)), [dict() for _ in langs]
    for r in rows:
        k = at[r["lang"]]
        if r["word"] is None:
            total[k] = r["n"]
        elif r["word"].startswith(" "):
            classes[k, int(r["word"][1:])] = r["n"]
        else:
            words[k][r["word"]] = r["rank"] - 1
            shares[k, r["rank"] - 1] = r["n"]
    shares[:, -1] = total - shares.sum(axis=1)
    return References(langs, classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), words, shares / np.maximum(total[:, None], 1))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance of shares (base 2); 0 for rows without counts."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(p.sum(axis=1) > 0, np.sqrt(np.maximum(half / 2, 0)), 0.0)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
    _, at, n = np.unique(pairs * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    blanks = len(raw) - sum(map(len, words))
    return len(words), len(text) - blanks, len(_SYMBOLS.findall(text)), again, repeated_words(words)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(
    docs: DataFrame, references: References, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """(doc_id, n_words, the base counts, base_failed, char_distance, word_distance, kept)
    of each row of ``docs(doc_id, lang, text)``; a distance is null where it is not judged."""
    sent = docs.sparkSession.sparkContext.broadcast(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = sent.value
        code = {name: k for k, name in enumerate(ref.langs)}
        for batch in batches:
            every = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in _chunks(every):
                part, texts, n = batch.slice(lo, hi - lo), every[lo:hi], hi - lo
                langs = part.column(1).to_pylist()
                base = np.array([base_counts(t) for t in texts], np.int64)
                failed = (base[:, 0] < BASE_MIN_WORDS) | (100 * base[:, 4] > BASE_MAX_REPEAT_PERCENT * base[:, 0])
                chars, words = class_counts(texts), [word_counts(t) for t in texts]
                best = np.full((n, 2), np.inf)  # distances to the document's reference
                judged = np.zeros(n, dtype=bool)
                for k, name in enumerate(ref.langs):
                    rows = np.array([i for i, g in enumerate(langs) if g == name or g not in code], np.int64)
                    counts = np.zeros((len(rows), ref.shares.shape[1]))
                    for j, i in enumerate(rows.tolist()):
                        for w in ref.words[k].keys() & words[i].keys():
                            counts[j, ref.words[k][w]] = words[i][w]
                        counts[j, -1] = words[i].total() - counts[j].sum()
                    got = np.stack([js_distance(_shares(chars[rows]), ref.classes[k]), js_distance(_shares(counts), ref.shares[k])], axis=1)
                    nearer = got.sum(axis=1) < best[rows].sum(axis=1)
                    best[rows[nearer]] = got[nearer]
                    judged[rows] = True
                by_char = judged & (np.fromiter(map(len, texts), np.int64, n) >= min_chars)
                by_word = judged & (base[:, 0] >= min_words)
                allowed = max_word_distance + np.sqrt(ref.shares.shape[1] / (8 * np.maximum(base[:, 0], 1) * np.log(2)))
                kept = ~failed & ~(by_char & (best[:, 0] > max_char_distance)) & ~(by_word & (best[:, 1] > allowed))
                distances = [pa.array(best[:, j], pa.float64(), mask=~m) for j, m in enumerate((by_char, by_word))]
                yield pa.record_batch(
                    [part.column(0), *(pa.array(base[:, j]) for j in range(len(_COUNTS))), pa.array(failed), *distances, pa.array(kept)],
                    names=["doc_id", *_COUNTS, "base_failed", "char_distance", "word_distance", "kept"],
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    return own.mapInArrow(run, f"doc_id bigint, {counts}, base_failed boolean, char_distance double, word_distance double, kept boolean")
