"""Filter interaction audit (operator 12) over a sparse document-term matrix.

1. Tasks cut their documents into blocks (about ``block_chars`` of text; a longer text is
   a block by itself), count words exactly and keep a local matrix in compressed rows:
   row offsets, local word numbers, counts. A block's vocabulary is ordered by bucket (a
   hash of the word), so its part for each bucket is one run.
2. The runs are shuffled by bucket. A task streams them in (bucket, block) order and
   numbers each word when it first comes: ``index * buckets + bucket`` is a dictionary id
   that is unique in the whole table without any coordination. Memory holds the
   vocabulary of one bucket; a word that every document has comes once a block.
3. The ids return to their blocks, replace the local numbers, and the result is the table
   of CSR shards (:func:`csr_shards`). Row sums and nonzero counts of the shards are the
   words and distinct words of each document; they decide filters A and B.
4. The flags that no word count gives (C, D and, by text digests over the whole table, E)
   are attached and documents are aggregated to at most 32 failure patterns a part. All
   that the audit reports is linear in these counts: a fixed 0/1 matrix per measure turns
   them into the rows of all 120 orders.

The filters (failure conditions): A fewer than 200 words, B fewer than 50 distinct words
in 100, C more than 2 capital letters A-Z in 100 code points, D one of ``#$%&*|``, E the
text of a smaller doc_id. Words are maximal runs without ASCII white space.

Defined cases: null text is an empty text (fails A; equal to other empty texts); a null
source is the part ``''``; rows repeated under one doc_id are counted one by one and only
a strictly smaller doc_id makes a copy; a null doc_id has no copies before it, is no
copy's original and has no labels. A label repeated for a doc_id counts once, if any of
its rows says so. An empty table gives empty shards and no rows. Extra columns are
ignored. Texts that are equal in 128 bits of BLAKE2 count as identical.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import shuffle_partitions

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
BLOCK_CHARS = 1 << 21
_SYMBOL = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_ROW = pa.list_(
    pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("capitals", pa.int64()), ("chars", pa.int64()), ("symbol", pa.bool_()), ("d1", pa.int64()), ("d2", pa.int64())])
)
_ROW_DDL = "array<struct<doc_id:bigint,part:string,capitals:bigint,chars:bigint,symbol:boolean,d1:bigint,d2:bigint>>"


def _pack(values: np.ndarray | bytes) -> bytes:
    """Compressed; whole numbers that are not negative in the narrowest width, which the
    first byte tells."""
    if isinstance(values, bytes):
        return zstandard.ZstdCompressor(1).compress(values)
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(1).compress(values.astype(kind).tobytes())


def _unpack_bytes(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def unpack(packed: bytes) -> np.ndarray:
    """The numbers of a packed column of the shards."""
    return np.frombuffer(_unpack_bytes(packed[1:]), f"<u{packed[0]}")


def _describe(doc_id: int | None, part: str | None, text: str) -> tuple[dict, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    h = hashlib.blake2b(raw, digest_size=16).digest()
    row = {
        "doc_id": doc_id, "part": part, "capitals": len(raw) - len(raw.translate(None, _CAPITALS)), "chars": len(text),
        "symbol": _SYMBOL.search(raw) is not None, "d1": int.from_bytes(h[:8], "big", signed=True), "d2": int.from_bytes(h[8:], "big", signed=True),
    }
    return row, raw


def _blocks(buckets: int, block_chars: int):
    """Local matrices; ``words`` is the vocabulary by bucket, ``sizes`` its run lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        rows: list[dict] = []
        vocab: dict[bytes, int] = {}
        indptr, local, counts, size = [0], [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal made, rows, vocab, indptr, local, counts, size
            words = list(vocab)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            block = (TaskContext.get().partitionId() << 32) + made
            out = pa.record_batch(
                [
                    pa.array([block], pa.int64()), pa.array([rows], _ROW),
                    *(pa.array([_pack(x)], pa.binary()) for x in (
                        np.array(indptr, np.int64), place[np.array(local, np.int64)], np.array(counts, np.int64),
                        b" ".join([words[i] for i in order.tolist()]), np.bincount(bucket, minlength=buckets),
                    )),
                ],
                names=["block", "rows", "indptr", "local", "counts", "words", "sizes"],
            )
            made += 1
            rows, vocab, indptr, local, counts, size = [], {}, [0], [], [], 0
            return out

        for batch in batches:
            for doc_id, part, text in zip(*(batch.column(i) for i in range(3))):
                text = text.as_py() or ""
                if rows and size + len(text) > block_chars:
                    yield emit()
                row, raw = _describe(doc_id.as_py(), part.as_py(), text)
                found = Counter(raw.split())  # bytes.split(): exactly 0x20 and 0x09-0x0D
                rows.append(row)
                local.extend([vocab.setdefault(w, len(vocab)) for w in found])
                counts.extend(found.values())
                indptr.append(len(local))
                size += len(text)
        if rows:
            yield emit()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vocabulary of each block, one row a bucket."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = _unpack_bytes(batch.column(1)[i].as_py()).split()
            sizes = unpack(batch.column(2)[i].as_py()).astype(np.int64)
            used = np.flatnonzero(sizes)
            ends = np.cumsum(sizes)[used].tolist()
            runs = [_pack(b" ".join(words[e - n : e])) for e, n in zip(ends, sizes[used].tolist())]
            yield pa.record_batch(
                [pa.array(used.astype(np.int32)), pa.array([batch.column(0)[i].as_py()] * len(runs), pa.int64()), pa.array(runs, pa.binary())],
                names=["bucket", "block", "words"],
            )


def _number():
    """Index of each word of a run in its bucket; a bucket's rows come together, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, {}
        for batch in batches:
            ids = []
            for bucket, words in zip(batch.column(0).to_pylist(), batch.column(2)):
                if bucket != current:
                    current, seen = bucket, {}
                index = [seen.setdefault(w, len(seen)) for w in _unpack_bytes(words.as_py()).split()]
                ids.append(_pack(np.array(index, np.int64)))
            yield pa.record_batch([batch.column(1), batch.column(0), pa.array(ids, pa.binary())], names=["block", "bucket", "ids"])

    return run


def _shards(buckets: int):
    """Local numbers to dictionary ids: a block's matrix comes first, then its indices by bucket."""

    def done(head: dict, ids: list[np.ndarray]) -> pa.RecordBatch:
        table = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        indices = _pack(table[unpack(head["local"]).astype(np.int64)])
        return pa.record_batch(
            [pa.array([head["block"]], pa.int64()), pa.array([head["rows"]], _ROW), *(pa.array([x], pa.binary()) for x in (head["indptr"], indices, head["counts"]))],
            names=["block", "rows", "indptr", "indices", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ids = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column(1)[i].as_py()
                if bucket >= 0:
                    ids.append(unpack(batch.column(2)[i].as_py()).astype(np.int64) * buckets + bucket)
                    continue
                if head is not None:
                    yield done(head, ids)
                head = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names) if n not in ("bucket", "ids")}
                ids = []
        if head is not None:
            yield done(head, ids)

    return run


def csr_shards(docs: DataFrame, part: str = "source", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The document-term matrix of ``docs(doc_id, text, part)``: one row per block with
    ``rows`` (the documents, in row order) and the packed columns ``indptr``, ``indices``
    (dictionary ids) and ``counts``, read by :func:`unpack`. Written, so every later step
    reads the same ids."""
    buckets = shuffle_partitions(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.col("text").cast("string"))
    blocks = own.mapInArrow(
        _blocks(buckets, block_chars), f"block bigint, rows {_ROW_DDL}, indptr binary, local binary, counts binary, words binary, sizes binary"
    )
    blocks = materialise(blocks, "fa-blocks")
    runs = blocks.select("block", "words", "sizes").mapInArrow(_runs, "bucket int, block bigint, words binary")
    runs = runs.repartition("bucket").sortWithinPartitions("bucket", "block")
    ids = runs.mapInArrow(_number(), "block bigint, bucket int, ids binary")
    none = F.lit(None)
    heads = blocks.select("block", F.lit(-1).alias("bucket"), none.cast("binary").alias("ids"), "rows", "indptr", "local", "counts")
    back = ids.select("block", "bucket", "ids", none.cast(_ROW_DDL).alias("rows"), *(none.cast("binary").alias(c) for c in ("indptr", "local", "counts")))
    both = heads.union(back).repartition("block").sortWithinPartitions("block", "bucket")
    shards = both.mapInArrow(_shards(buckets), f"block bigint, rows {_ROW_DDL}, indptr binary, indices binary, counts binary")
    return materialise(shards, "fa-shards")


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            indptr = unpack(batch.column(1)[i].as_py()).astype(np.int64)
            counts = unpack(batch.column(2)[i].as_py())
            sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            rows = batch.column(0)[i].values
            fields = [rows.field(k) for k in range(rows.type.num_fields)]
            yield pa.record_batch(
                [*fields, pa.array(sums[indptr[1:]] - sums[indptr[:-1]]), pa.array(np.diff(indptr))],
                names=[*(f.name for f in rows.type), "n_words", "n_distinct"],
            )


def failures(shards: DataFrame) -> DataFrame:
    """(doc_id, part, n_words, n_distinct, A..E booleans: fails the filter) per document."""
    rows = shards.select("rows", "indptr", "counts").mapInArrow(
        _row_counts, "doc_id bigint, part string, capitals bigint, chars bigint, symbol boolean, d1 bigint, d2 bigint, n_words bigint, n_distinct bigint"
    )
    first = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, ["d1", "d2"], "left")
    return rows.select(
        "doc_id", "part", "n_words", "n_distinct",
        (F.col("n_words") < MIN_WORDS).alias("A"),
        (100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words")).alias("B"),
        (100 * F.col("capitals") > MAX_CAPITAL_PERCENT * F.col("chars")).alias("C"),
        F.col("symbol").alias("D"),
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"),
    )


def _effects(n: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of n filters, and for each measure the 0/1 matrix from failure pattern
    (bit f: fails filter f) to (order, step)."""
    orders = list(permutations(range(n)))
    pattern = np.arange(1 << n)
    fails = (pattern[:, None] >> np.arange(n)) & 1 == 1
    shape = (1 << n, len(orders), n)
    kept, removed, redundant, alone = (np.zeros(shape, np.int64) for _ in range(4))
    for o, order in enumerate(orders):
        gone = np.zeros(1 << n, dtype=bool)
        for s, f in enumerate(order):
            removed[:, o, s] = fails[:, f] & ~gone
            redundant[:, o, s] = fails[:, f] & gone
            gone = gone | fails[:, f]
            kept[:, o, s] = ~gone
            alone[:, o, s] = pattern == 1 << f
    # a filter's removals over all orders, set beside each of its steps
    step = np.array(orders)
    total = np.stack([removed[:, step == f].sum(axis=1) for f in range(n)], axis=1)
    return orders, {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": alone, "shapley": total[:, step]}


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(flags: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per (part, order of ``filters``, step) with the measures. ``flags`` has
    doc_id, part and a boolean column per filter; ``labels`` doc_id, quality, toxic."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    bits = sum((F.col(f).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    rows = flags.select("doc_id", "part", bits.alias("pattern")).join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "pattern").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.col("good").cast("long"), F.lit(0))).alias("good"), F.sum(F.coalesce(F.col("toxic").cast("long"), F.lit(0))).alias("toxic")
    )
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("counts"))  # 2**filters at most
    n = len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, effect = _effects(n)
        names = ["".join(filters[f] for f in o) for o in orders for _ in range(n)]
        steps = list(range(1, n + 1)) * len(orders)
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                have = np.zeros((3, 1 << n), np.int64)
                for c in found:
                    have[:, c["pattern"]] = c["n"], c["good"], c["toxic"]
                got = {m: np.tensordot(have[0], e, 1).ravel() for m, e in effect.items()}
                got["good_lost"], got["toxic_lost"] = (np.tensordot(h, effect["removed"], 1).ravel() for h in have[1:])
                yield pa.record_batch(
                    [pa.array([part] * len(names)), pa.array(names), pa.array(steps, pa.int32()), *(pa.array(got[m]) for m in MEASURES)],
                    names=["part", "filter_order", "step", *MEASURES],
                )

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES))
