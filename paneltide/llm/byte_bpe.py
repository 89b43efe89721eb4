"""Byte-level BPE encoding and decoding (operator 2) by a global distinct-word shuffle.

1. Every text is cut into pre-tokens by the vocabulary's pattern. A task gathers its
   texts into *blocks* (up to ``BLOCK_BYTES`` of text or ``BLOCK_WORDS`` distinct
   words): the positions of a text's pre-tokens become numbers into the block's list of
   distinct words. Words and positions go separate ways, each by a pass of its own: a
   second cut costs less than a table of all positions would take on disk. Rows are
   ordered within a partition first, and a block is named by a digest of its texts, so
   both passes, and every retry, cut the same blocks; a block whose halves do not meet is
   an error, never a wrong result.
2. The distinct words of all blocks are shuffled by word hash, packed by (block, hash
   part), so each distinct word of the corpus meets in one place and is merged by BPE
   exactly once (:func:`merge_word`); its ids go back to each block that holds it.
3. Positions and ids meet again by block: the ids of each text are assembled in position
   order. Decoding looks up every id in the token-byte table (one entry a rank; its size
   is fixed by the vocabulary) and joins the bytes.

A block holds at most a few times ``BLOCK_BYTES`` in memory, a hash part the distinct
words of one shuffle partition; a hot word is one row a block at most. Texts come out of a
block in batches of ``OUT_BYTES``: a block handed over as one table was held by the worker
twice, and by the JVM once more.

Defined cases: null or empty text: no ids, empty bytes. Repeated rows and null ids are
encoded row by row. An empty table gives an empty result. Extra columns are ignored by
:func:`encode`.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

BLOCK_BYTES = 24 << 20
BLOCK_WORDS = 250_000
PIECE_BYTES = 1 << 20  # text whose positions are stored as one row
OUT_BYTES = 2 << 20  # ids and decoded bytes that leave a block as one batch
MAX_VOCABULARY = 1_000_000
LEVEL = 3  # of compression

_ROW = "block bigint, part int, locals binary, words binary, docs binary, positions binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file (``base64 rank`` a line); its size is checked."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens exceed the broadcast bound of {MAX_VOCABULARY}")
    return ranks


def _pack(values: np.ndarray) -> bytes:
    """Compressed unsigned 32-bit integers, byte planes apart."""
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(w) for w in words], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(struct.pack("<I", len(words)) + sizes + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4), dtype=np.int64)
    starts = np.concatenate([[4 + 4 * n], ends[:-1]])
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _rows(block: int, part, locals_, words, docs, positions) -> pa.RecordBatch:
    n = len(part)
    return pa.record_batch(
        [pa.array([block] * n, pa.int64()), pa.array(part, pa.int32()), pa.array(locals_, pa.binary()), pa.array(words, pa.binary()),
         pa.array(docs, pa.binary()), pa.array(positions, pa.binary())],
        names=["block", "part", "locals", "words", "docs", "positions"],
    )


def _blocks(pattern: str, parts: int, want: str):
    """Blocks of one task: the positions (``want`` = "texts") or the distinct words ("words")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        number: dict[str, int] = {}
        pieces: list[tuple[bytes, np.ndarray]] = []  # (ids and counts of texts, word numbers)
        ids: list[bytes] = []
        flat: list[np.ndarray] = []
        piece = held = 0
        name = hashlib.blake2b(digest_size=8)

        def close_piece() -> None:
            nonlocal ids, flat, piece
            if ids:
                pieces.append((b"".join(ids), np.concatenate(flat)))
            ids, flat, piece = [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            """Frequent words get small numbers, which compress best."""
            nonlocal number, pieces, held, name
            if not pieces:
                return
            key = int.from_bytes(name.digest(), "little", signed=True)
            count = np.zeros(len(number), dtype=np.int64)
            for _, own in pieces:
                count += np.bincount(own, minlength=len(number))
            rank = np.empty(len(number), dtype=np.uint32)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(number), dtype=np.uint32)
            for docs, own in pieces if want == "texts" else ():
                yield _rows(key, [None], [None], [None], [docs], [_pack(rank[own])])
            by_part: dict[int, tuple[list[int], list[bytes]]] = {}
            for word, k in number.items() if want == "words" else ():
                raw = word.encode()
                part = int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "little") % parts
                at = by_part.setdefault(part, ([], []))
                at[0].append(k)
                at[1].append(raw)
            for part, (k, words) in by_part.items():
                yield _rows(key, [part], [_pack(rank[np.array(k)])], [_pack_words(words)], [None], [None])
            number, pieces, held, name = {}, [], 0, hashlib.blake2b(digest_size=8)

        for batch in batches:
            # one text at a time: a batch has 10,000
            for doc_id, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))):
                got = find(text) if text else []
                add = number.setdefault
                flat.append(np.array([add(w, len(number)) for w in got], dtype=np.uint32))
                ids.append(struct.pack("<?qI", doc_id is not None, doc_id or 0, len(got)))
                name.update(ids[-1])
                name.update((text or "").encode())
                size = len(text or "") + 16
                piece += size
                held += size
                if piece >= PIECE_BYTES:
                    close_piece()
                if held >= BLOCK_BYTES or len(number) >= BLOCK_WORDS:
                    close_piece()
                    yield from block()
        close_piece()
        yield from block()

    return run


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the neighbouring parts whose joint bytes have the lowest rank
    (the leftmost of equal ones) are joined until no two neighbours are a token.

    Candidates wait in a heap, so a pre-token of n bytes takes n log n steps: a text
    without blanks can be a single pre-token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 inside a part
    before = list(range(-1, n))  # start of the part left of the one that starts here
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = end[start]
        if middle in (0, n) or end[middle] != stop:
            continue  # one of the two parts has been joined with another since
        end[start], end[middle], before[stop] = stop, 0, start
        left = before[start]
        if left >= 0 and (rank := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (rank, left, stop))
        if stop < n and (rank := ranks.get(word[start : end[stop]])) is not None:
            heapq.heappush(heap, (rank, start, end[stop]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


def _encode_words(sent):
    """Every distinct word of one hash part, encoded once; ids packed for each block."""

    def run(group: pa.Table) -> pa.Table:
        ranks = sent.value
        known: dict[bytes, list[int]] = {}
        sizes, ids = [], []
        for packed in group.column("words"):
            n, out = [], []
            for w in _unpack_words(packed.as_py()):
                got = known.get(w)
                if got is None:
                    got = known[w] = merge_word(w, ranks)
                n.append(len(got))
                out.extend(got)
            sizes.append(_pack(np.array(n, dtype=np.uint32)))
            ids.append(_pack(np.array(out, dtype=np.uint32)))
        return pa.table({
            "block": group.column("block"), "locals": group.column("locals"), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary()),
            "docs": pa.nulls(len(sizes), pa.binary()), "positions": pa.nulls(len(sizes), pa.binary()),
        })

    return run


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start .. start + count of every run, one after the other."""
    total = int(counts.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total) if total else np.zeros(0, np.int64)


def _assemble(sent):
    """Texts of one block: ids by position, and the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes, token_size = sent.value
        token_start = np.concatenate([[0], np.cumsum(token_size)])[:-1]
        locals_, sizes, ids, texts = [], [], [], []
        for batch in batches:
            for loc, n, out, docs, packed in zip(*(batch.column(c) for c in ("locals", "sizes", "ids", "docs", "positions"))):
                if loc.as_py() is not None:
                    locals_.append(_unpack(loc.as_py()))
                    sizes.append(_unpack(n.as_py()))
                    ids.append(_unpack(out.as_py()))
                if docs.as_py() is not None:
                    texts.append((docs.as_py(), packed.as_py()))
        if locals_:
            local, size, flat = np.concatenate(locals_), np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
            start_of, size_of = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
            start_of[local], size_of[local] = np.concatenate([[0], np.cumsum(size)])[:-1], size
        else:
            size_of = np.zeros(0, np.int64)
        del locals_, sizes, ids
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        cols: list[list] = [[], [], [], []]
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_tokens", "ids", "decoded"])

        for docs, packed in texts:
            position, at = _unpack(packed), 0
            if len(position) and position.max() >= len(size_of):
                raise RuntimeError("a block was cut differently by the two passes: its rows did not come in the same order")
            for has_id, doc_id, n in struct.iter_unpack("<?qI", docs):
                own = position[at : at + n]
                at += n
                tokens = flat[_gather(start_of[own], size_of[own])] if n else np.zeros(0, np.uint32)
                text = token_bytes[_gather(token_start[tokens], token_size[tokens])] if n else np.zeros(0, np.uint8)
                for c, v in zip(cols, (doc_id if has_id else None, len(tokens), tokens.astype("<u4").tobytes(), text.tobytes())):
                    c.append(v)
                held += 4 * len(tokens) + len(text)
                if held >= OUT_BYTES:
                    yield batch_of()
                    cols, held = [[], [], [], []], 0
        yield batch_of()

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of ``docs(doc_id, text)``: ``ids`` are
    little-endian unsigned 32-bit integers, ``decoded`` the bytes they decode to."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = shuffle_partitions(spark)
    own = own.sortWithinPartitions("doc_id", F.xxhash64("text"))
    sent = spark.sparkContext.broadcast(ranks)
    schema = "block bigint, locals binary, sizes binary, ids binary, docs binary, positions binary"
    words = own.mapInArrow(_blocks(pattern, parts, "words"), _ROW).select("part", "block", "locals", "words")
    encoded = words.groupBy("part").applyInArrow(_encode_words(sent), schema)
    none = F.lit(None).cast("binary")
    texts = own.mapInArrow(_blocks(pattern, parts, "texts"), _ROW).select("block", none.alias("locals"), none.alias("sizes"), none.alias("ids"), "docs", "positions")
    by_rank = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_rank[rank] = token
    table = (np.frombuffer(b"".join(by_rank), dtype=np.uint8), np.array([len(t) for t in by_rank], dtype=np.int64))
    return encoded.unionByName(texts).groupBy("block").applyInArrow(
        _assemble(spark.sparkContext.broadcast(table)), "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
    )
