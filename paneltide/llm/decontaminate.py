"""Benchmark decontamination (operator 4): SimHash over item-sized windows.

* Words are the runs of ASCII letters and digits and of non-ASCII bytes of the lower-cased
  text. Each benchmark item of L words gets a window size W (the largest power
  of two up to L / 2, at most 128, so a copy always holds whole windows) and a stride W / 4.
* The fingerprint of a window is the 64-bit SimHash of its words (per bit, the majority
  of the word hashes). Documents are windowed at the stride, items at every offset.
* **Multi-index Hamming blocks**: the 64 bits form four blocks of 16. Two fingerprints
  within distance 7 differ by at most one bit in at least one block, so looking up each
  block among the item blocks and their one-bit neighbours finds *every* item
  fingerprint within radius 7.
* Each candidate aligns the item with the document; the aligned words are then verified
  by the exact weighted Jaccard similarity of their 5-word shingles (a multiset; a
  shingle weighs its bytes). At ``similarity`` 0.8 or more the document holds the item.

Finding is a narrow pass over the documents: nothing is shuffled. Items are a stated query
set: they are sent to the tasks in blocks of at most ``BLOCK_WORDS`` words on average,
one pass a block, so the broadcast is bounded whatever the size of the benchmark.

Defined cases: null or empty texts and texts shorter than the window hold nothing. Null
or empty items and items of fewer than 5 words are never found. Equal items are each
reported. Repeated rows are reported once for a (doc_id, item_id). A null doc_id is
reported as null and is dropped by :func:`decontaminate` like any other. Extra columns
are ignored by :func:`contaminations` and kept by :func:`decontaminate`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B

SIMILARITY = 0.8
SHINGLE = 5
RADIUS = 7
BLOCK_WORDS = 200_000
SEGMENT = 1 << 16  # words whose bit counts are held at a time
# Fixed ladder of window sizes: powers of two; counts of up to 128 words fit a byte.
LADDER = np.array([2, 4, 8, 16, 32, 64, 128])
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def window_size(words: int) -> int:
    return int(LADDER[max(0, np.searchsorted(LADDER, 0.5 * words, side="right") - 1)])


def stride(window: int) -> int:
    return max(1, window // 4)


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(hashes, byte lengths, first word of each row, word count of each row)."""
    starts, ends, row = B.token_spans(_WORD[data], offsets)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), first, counts
    return B.span_hash(B.prefix_hash(data), starts, ends), ends - starts, first, counts


def simhash(hashes: np.ndarray, starts: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, starts, 64-bit fingerprints) for the sorted starts of each window size.

    Bit counts of 2, 4, 8, ... words are sums of two halves, so all sizes share them; a
    segment of words is expanded to bits at a time."""
    sizes = sorted(starts)
    for base in range(0, len(hashes), SEGMENT):
        end = min(len(hashes), base + SEGMENT + sizes[-1])
        ones, width = np.unpackbits(hashes[base:end].view(np.uint8)).reshape(-1, 64), 1
        for w in sizes:
            while width < w:
                ones, width = ones[:-width] + ones[width:], 2 * width
            lo, hi = np.searchsorted(starts[w], (base, base + SEGMENT))
            if hi > lo:
                at = starts[w][lo:hi]
                yield w, at, np.packbits((ones[at - base] > w // 2).reshape(-1)).view(np.uint64)


def shingles(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of the shingle that begins at each word but the last four."""
    n = max(0, len(hashes) - SHINGLE + 1)
    acc, weight = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(SHINGLE if n else 0):  # order-sensitive: each place has its own odd factor
        acc += hashes[k : k + n] * np.uint64((k * 2 + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))
        weight += sizes[k : k + n]
    return B.mix(acc), weight


def bag(value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a sequence, their counts and weights (sorted by shingle)."""
    value, at, count = np.unique(value, return_index=True, return_counts=True)
    return value, count, weight[at]


def weighted_jaccard(a, b) -> float:
    """Sum of weighted minimal over sum of weighted maximal counts."""
    (va, ca, wa), (vb, cb, wb) = a, b
    both, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    low = int((np.minimum(ca[ia], cb[ib]) * wa[ia]).sum())
    high = int((ca * wa).sum() + (cb * wb).sum()) - low
    return low / high if high else 0.0


class ItemIndex:
    """Fingerprints of a block of items, by window size, with their block tables."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.sizes, self.shingles = [], [], [], []
        grouped: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        with np.errstate(over="ignore"):
            for item_id, text in items:
                data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                h, size, _, _ = words_of(data, np.array([0, len(data)]))
                if len(h) < SHINGLE:
                    continue
                w = window_size(len(h))
                offs = np.arange(len(h) - w + 1)
                grouped.setdefault(w, []).append((len(self.ids), offs, np.concatenate([f for _, _, f in simhash(h, {w: offs})])))
                self.ids.append(item_id)
                self.words.append(len(h))
                self.shingles.append(bag(*shingles(h, size)))
        #: of every 20-bit value, whether an item shingle ends in it
        self.flags = np.zeros(1 << 20, dtype=bool)
        for value, _, _ in self.shingles:
            self.flags[(value & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.tables = {}
        for w, parts in grouped.items():
            item = np.concatenate([np.full(len(o), k) for k, o, _ in parts])
            off = np.concatenate([o for _, o, _ in parts])
            fp = np.concatenate([f for _, _, f in parts])
            blocks = []
            for b in range(4):
                v = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                near = np.concatenate([v, *(v ^ (1 << i) for i in range(16))])
                who = np.tile(np.arange(len(v)), 17)
                order = np.argsort(near, kind="stable")
                blocks.append((np.searchsorted(near[order], np.arange(65537)), who[order]))
            self.tables[w] = (item, off, fp, blocks)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(row, item number, first word, similarity) of every item held by a row (the best place)."""
        h, size, first, counts = words_of(data, offsets)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        # how many shingles up to each word may be an item's: an alignment over none of
        # them has similarity 0 and needs no look
        value, weight = shingles(h, size)
        shared = np.zeros(len(h) + 1, dtype=np.int64)
        np.cumsum(self.flags[(value & np.uint64(0xFFFFF)).astype(np.int64)], out=shared[1 : len(value) + 1])
        shared[len(value) + 1 :] = shared[len(value)]
        lengths = np.array(self.words, dtype=np.int64)
        starts = {}
        for w in self.tables:
            s = stride(w)
            per_row = np.maximum(0, (counts - w) // s + 1) * (counts >= w)
            total = int(per_row.sum())
            if total:
                row = np.repeat(np.arange(len(counts)), per_row)
                nth = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(per_row)])[:-1], per_row)
                starts[w] = first[row] + nth * s
        for w, start, prints in simhash(h, starts) if starts else ():
            item, off, fp, blocks = self.tables[w]
            for b, (ptr, who) in enumerate(blocks):
                v = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                n = ptr[v + 1] - ptr[v]
                at = np.repeat(np.arange(len(v)), n)
                k = who[np.repeat(ptr[v] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
                hit = np.bitwise_count(prints[at] ^ fp[k]) <= RADIUS
                at, k = at[hit], k[hit]
                row = np.searchsorted(first + counts, start[at], side="right")
                begin = np.maximum(start[at] - off[k], first[row])
                stop = np.minimum(start[at] - off[k] + lengths[item[k]], (first + counts)[row])
                live = shared[np.maximum(stop - SHINGLE + 1, begin)] > shared[begin]
                for r, it, x, z in set(zip(row[live].tolist(), item[k][live].tolist(), begin[live].tolist(), stop[live].tolist())):
                    if (it, x, z) in tried:
                        continue
                    tried.add((it, x, z))
                    z = max(x, z - SHINGLE + 1)
                    sim = weighted_jaccard(self.shingles[it], bag(value[x:z], weight[x:z]))
                    got = (sim, int(first[r]) - x)
                    if got > best.get((r, it), (0.0, 1)):
                        best[r, it] = got
        return [(r, it, -p, sim) for (r, it), (sim, p) in best.items()]


def _item_blocks(benchmark: DataFrame) -> Iterator[ItemIndex]:
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = max(1, math.ceil(words / BLOCK_WORDS))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield ItemIndex(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in rows))


def _scan(batch: pa.RecordBatch, at: int, index: ItemIndex) -> Iterator[tuple[int, int, int, float]]:
    np.seterr(over="ignore")
    low = pc.utf8_lower(batch.column(at).cast(pa.large_string()))
    for lo, _, data, offs in B.text_chunks(low):
        for row, item, start, sim in index.find(data, offs):
            yield lo + row, item, start, sim


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): every item held by a document."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
    out = None
    for block in _item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                found = [f for f in _scan(batch, 1, index) if f[3] >= similarity]
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.record_batch(
                    [ids, pa.array([index.ids[f[1]] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64()),
                     pa.array([f[2] for f in found], pa.int64()), pa.array([index.words[f[1]] for f in found], pa.int64())],
                    names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

        part = own.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("p"), "n_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.p")).alias("first_word"), F.col("b.n_words").alias("n_words")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (same columns, no shuffle)."""
    spark, at, out = docs.sparkSession, docs.columns.index("text"), docs
    for block in _item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, _, _, sim in _scan(batch, at, sent.value):
                    if sim >= similarity:
                        keep[row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
