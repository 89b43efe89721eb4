"""Suffix-array dedup (operator 10): every byte covered by a ``length``-byte string that
also starts earlier (smaller doc_id, or the same document and an earlier start) goes.

A global suffix array over all texts does not fit one task, so strings are dealt to
groups that must hold all their occurrences:

1. **Anchors.** Each ``length``-byte window is represented by the anchor it contains: its
   ``K``-byte substring of smallest hash (the leftmost on ties). Equal windows have equal
   anchors at equal offsets, and the windows of one anchor occurrence are consecutive.
2. **Repeats.** Anchor hashes are shuffled once, packed by hash part; those that occur
   more than once go back to their documents. Only around them can a window repeat.
3. **Contexts.** The bytes of the windows of such an occurrence (at most ``2 * length - K``)
   go to the anchor's group, each distinct context once. A group of one distinct context
   repeats as a whole. In a group of several, the contexts are joined into one string and
   its *suffix array* is built by linear grouping (``suffix_groups``); neighbours in it
   that share ``length`` bytes are equal windows, and the earliest one stays.
4. **Hot anchors** (in more than ``HOT`` places) never meet in one task: their windows are
   keyed by digest, and the earliest place of each is a minimum combined before the
   shuffle; it goes back to its document, where all other windows of hot anchors go. A group of more than ``JOINED`` contexts is cut by the bytes that all windows
   of a range of offsets share, until each part is small enough or holds one offset.
5. The removed ranges return to their documents as merged spans.

Defined cases: null text: as empty. Texts shorter than ``length`` keep everything. A null
doc_id ranks last. Rows that share a doc_id rank by a hash of their text; a row repeated
exactly counts as one document (each copy of it loses the same bytes). Extra columns are
ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import bytescan as B
from .common import shuffle_partitions
from .suffix_groups import _spread, suffix_arrays

LENGTH = 100
K = 36
HOT = 4096
JOINED = 16  # contexts in one suffix array
BATCH_SYMBOLS = 1 << 20
SEGMENT = 1 << 20  # bytes of a text that are hashed at a time
_NULL = np.int64(2**63 - 1)


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(row, anchor position in the row, first and last window start, anchor hash)."""
    cols = [[], [], [], [], []]
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    w = length - k + 1
    for lo in range(0, len(data) - length + 1, SEGMENT):  # window starts lo .. lo + SEGMENT
        part = data[lo : lo + SEGMENT + length - 1]
        prefix = B.prefix_hash(part)
        m = len(part) - k + 1
        with np.errstate(over="ignore"):
            h = B.mix((prefix[k:] - prefix[:m]) * B.powers(len(part), inverse=True)[:m])
        # 40 bits of hash over the place, so the smallest is the leftmost smallest
        best = (h & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= w:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < w:
            best = np.minimum(best[: len(best) - (w - width)], best[w - width :])
        start = np.arange(len(best))
        row = np.searchsorted(offsets, start + lo, side="right") - 1
        start = start[start + lo + length <= offsets[row + 1]]
        if len(start) == 0:
            continue
        row = row[start] if len(row) != len(start) else row
        at = (best[start] & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.ones(len(start), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        begin = offsets[row[first]] - lo
        for c, v in zip(cols, (row[first], at[first] - begin, start[first] - begin, start[last] - begin, h[at[first]])):
            c.append(v)
    if not cols[0]:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    return [np.concatenate(c) for c in cols]


def _zip(*arrays: np.ndarray) -> bytes:
    """Compressed columns; integers as differences, byte planes apart."""
    out = []
    for a in arrays:
        if a.dtype != np.uint8:
            a = np.ascontiguousarray(a).view(np.int64)
            a = np.diff(a, prepend=np.int64(0))
            a = np.ascontiguousarray(((a << 1) ^ (a >> 63)).view(np.uint8).reshape(-1, 8).T)
        raw = a.tobytes()
        out.append(struct.pack("<I", len(raw)) + raw)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unzip(data: bytes, kinds: str) -> list[np.ndarray]:
    """Columns of :func:`_zip`: ``i`` for integers, ``b`` for bytes."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        n = struct.unpack_from("<I", raw, at)[0]
        a = np.frombuffer(raw, dtype=np.uint8, count=n, offset=at + 4)
        at += 4 + n
        if kind == "i":
            a = np.ascontiguousarray(a.reshape(8, -1).T).view(np.uint64).ravel()
            a = np.cumsum((a >> np.uint64(1)).view(np.int64) ^ -(a & np.uint64(1)).view(np.int64))
        out.append(a)
    return out


def _dealt(parts: int, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    part = ((hashes >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts), side="right")
    for p in np.unique(part).tolist():
        yield p, order[ends[p - 1] if p else 0 : ends[p]]


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([_NULL if v is None else v for v in column.to_pylist()], dtype=np.int64)


def _emit_anchors(parts: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: list[tuple] = []
        size = 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            doc = np.concatenate([x[1] for x in held])
            at = np.concatenate([x[2] for x in held])
            rows = [(p, _zip((h[i] >> np.uint64(24)).view(np.int64), doc[i], at[i])) for p, i in _dealt(parts, h)]
            return pa.record_batch([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "pack"])

        for batch in batches:
            ids = _ids(batch.column(0))
            for lo, _, data, offs in B.text_chunks(batch.column(1), SEGMENT):
                row, at, _, _, h = anchors_of(data, offs, length, k)
                if len(row):
                    held.append((h, ids[lo + row], at))
                    size += len(row)
                if size >= 1 << 19:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _repeated(hot: int):
    """(doc_id, at, hot) of the anchors of one hash part that occur more than once."""

    def run(group: pa.Table) -> pa.Table:
        cols = [_unzip(p.as_py(), "iii") for p in group.column("pack")]
        h, doc, at = (np.concatenate([c[i] for c in cols]) for i in range(3))
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        n = count[inverse]
        keep = n > 1
        return pa.table({"doc_id": pa.array(doc[keep]), "at": pa.array(at[keep]), "hot": pa.array(n[keep] > hot)})

    return run


_WINDOW = "w1 bigint, w2 bigint, doc_id bigint, key bigint, at bigint"


def _wanted(batch: pa.RecordBatch, length: int, k: int):
    """Per chunk: bytes, row offsets, rows and anchors that were found to repeat."""
    ids, keys = _ids(batch.column(0)), batch.column(1).to_numpy()
    lists = batch.column(3).to_pylist()
    for lo, hi, data, offs in B.text_chunks(batch.column(2), SEGMENT):
        row, at, first, last, h = anchors_of(data, offs, length, k)
        want = [np.array(lists[r] or [], dtype=np.int64) for r in range(lo, hi)]
        code = np.concatenate([w + (np.int64(r) << 40) for r, w in enumerate(want)]) if want else np.zeros(0, np.int64)
        pick = np.isin(row * (1 << 40) + at, code)
        yield data, offs, ids[lo:hi], keys[lo:hi], row[pick], at[pick], first[pick], last[pick], h[pick]


def _contexts(parts: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for data, offs, ids, keys, row, at, first, last, h in _wanted(batch, length, k):
                size = last - first + length
                rows = []
                for p, i in _dealt(parts, h):
                    text = data[_spread(offs[row[i]] + first[i], size[i])]
                    rows.append((p, _zip(h[i].view(np.int64), ids[row[i]], keys[row[i]], at[i], first[i], last[i], text)))
                yield pa.record_batch([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "pack"])

    return run


def _earliest(cols: list[np.ndarray]) -> list[np.ndarray]:
    """The earliest place of each digest among rows (w1, w2, doc_id, key, at)."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
    return [c[new] for c in cols]


def _hot_windows(length: int, k: int):
    """Digests (two 64-bit hashes) and earliest places of the windows of hot anchors,
    combined for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            best = [np.zeros(0, np.int64)] * 5
            for data, offs, ids, keys, row, _, first, last, _ in _wanted(batch, length, k):
                if len(row) == 0:
                    continue
                n = last - first + 1
                start, of = _spread(first, n), np.repeat(row, n)
                at = offs[of] + start
                w = [B.span_hash(B.prefix_hash(data, B.byte_table(seed)), at, at + length).view(np.int64) for seed in (11, 13)]
                found = _earliest([*w, ids[of], keys[of], start.astype(np.int64)])
                best = _earliest([np.concatenate(c) for c in zip(best, found)])
            yield pa.record_batch([pa.array(c) for c in best], names=["w1", "w2", "doc_id", "key", "at"])

    return run


def _hot_spans(length: int, k: int):
    """Ranges of the windows of hot anchors but for those that are the earliest of their
    digest (column ``keep`` of the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            kept: dict[tuple, set] = {}
            for doc, own in zip(_ids(batch.column(0)).tolist(), batch.column(4).to_pylist()):
                for x in own or ():
                    kept.setdefault((doc, x["key"]), set()).add(x["at"])
            cols: list[list] = [[], [], [], []]
            for _, _, ids, keys, row, _, first, last, _ in _wanted(batch, length, k):
                for r in np.unique(row).tolist():
                    i = row == r
                    start = _spread(first[i], (last - first + 1)[i])
                    stay = kept.get((int(ids[r]), int(keys[r])))
                    if stay:
                        start = start[~np.isin(start, np.fromiter(stay, np.int64, len(stay)))]
                    if len(start) == 0:
                        continue
                    new = np.flatnonzero(np.append(True, start[1:] > start[:-1] + 1))
                    end = start[np.append(new[1:], len(start)) - 1] + length
                    for c, v in zip(cols, ([ids[r]] * len(new), [keys[r]] * len(new), start[new], end)):
                        c.append(np.asarray(v, dtype=np.int64))
            yield pa.record_batch(
                [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols], names=["doc_id", "key", "start", "stop"]
            )

    return run


def _cut(groups: list[np.ndarray], ctx: dict, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts (contexts, first offset, last offset) small enough for one suffix array: a
    range of offsets is halved, and contexts meet only if they agree on the bytes that
    all windows of the range share."""
    low, high, text, start = ctx["low"], ctx["high"], ctx["text"], ctx["start"]
    work = [(g, int(low[g].min()), int(high[g].max())) for g in groups]
    while work:
        g, a, z = work.pop()
        lo, hi = np.maximum(low[g], a), np.minimum(high[g], z)
        inside = lo <= hi
        g, lo, hi = g[inside], lo[inside], hi[inside]
        if len(g) < 2:
            continue
        if len(g) <= JOINED or a == z:
            yield g, lo, hi
            continue
        mid = (a + z) // 2
        for b, e in ((a, mid), (mid + 1, z)):
            some = g[(low[g] <= e) & (high[g] >= b)]
            core: dict[bytes, list[int]] = {}
            for x in some.tolist():  # bytes [e, b + length) relative to the anchor
                s = start[x] + e - low[x]
                core.setdefault(text[s : s + length - (e - b)].tobytes(), []).append(x)
            work += [(np.array(c), b, e) for c in core.values() if len(c) > 1]


def _later_windows(parts: list[tuple], ctx: dict, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, offset) of every window of the parts that also starts earlier."""
    text, start, low, rank = ctx["text"], ctx["start"], ctx["low"], ctx["rank"]
    parts.sort(key=lambda p: int((p[2] - p[1]).sum()) + length * len(p[0]))
    at = 0
    while at < len(parts):
        batch, total = [], 0
        while at < len(parts) and (not batch or total < BATCH_SYMBOLS):
            batch.append(parts[at])
            total += int((parts[at][2] - parts[at][1]).sum()) + (length + 1) * len(parts[at][0])
            at += 1
        c, lo, hi = (np.concatenate([p[i] for p in batch]) for i in range(3))
        size = hi - lo + length  # bytes of each context, then a separator or the string's end
        string_end = np.cumsum([len(p[0]) for p in batch]) - 1
        symbols = np.ones(int(size.sum()) + len(c), dtype=np.int64)
        place = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        at_text = _spread(place, size)
        source = _spread(start[c] + lo - low[c], size)
        symbols[at_text] = text[source].astype(np.int64) + 2
        symbols[(place + size)[string_end]] = 0
        bounds = np.concatenate([[0], (place + size)[string_end] + 1])
        order = suffix_arrays(symbols, bounds)
        # windows only, in the order of their suffixes
        owner = np.full(len(symbols), -1, np.int64)
        owner[_spread(place, hi - lo + 1)] = np.repeat(np.arange(len(c)), hi - lo + 1)
        order = order[owner[order] >= 0]
        who = owner[order]
        offset = lo[who] + order - place[who]
        same = np.zeros(len(order), dtype=bool)
        near = np.flatnonzero((offset[1:] == offset[:-1]))
        for b in range(0, len(near), 1 << 15):  # neighbours that share all bytes
            i = near[b : b + (1 << 15)]
            window = np.arange(length)
            same[i + 1] = (symbols[order[i][:, None] + window] == symbols[order[i + 1][:, None] + window]).all(axis=1)
        string_of = np.searchsorted(bounds, order, side="right")
        same[1:] &= string_of[1:] == string_of[:-1]
        run = np.cumsum(~same)
        by = np.lexsort((rank[c[who]], run))
        first = np.ones(len(by), dtype=bool)
        first[1:] = run[by][1:] != run[by][:-1]
        later = by[~first]
        yield c[who[later]], offset[later]


def _spans(length: int):
    """Removed ranges of one hash part: (doc_id, key, start, stop)."""

    def run(group: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        cols = [_unzip(p.as_py(), "iiiiiib") for p in group.column("pack")]
        h, doc, key, at, first, last, text = (np.concatenate([c[i] for c in cols]) for i in range(7))
        size = last - first + length
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        # distinct contexts of an anchor: equal bytes at equal offsets
        with np.errstate(over="ignore"):
            digest = np.zeros(len(h), dtype=np.uint64)
            for lo in range(0, len(h), 1 << 14):
                hi = min(lo + (1 << 14), len(h))
                a, z = start[lo], start[hi - 1] + size[hi - 1]
                digest[lo:hi] = B.span_hash(B.prefix_hash(text[a:z]), start[lo:hi] - a, start[lo:hi] - a + size[lo:hi])
            digest = B.mix(digest + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((at, key, doc, digest, h))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (h[order][1:] != h[order][:-1]) | (digest[order][1:] != digest[order][:-1])
        lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        # exactly the same row repeated: as the leader itself
        copy = order[(doc[order] != doc[lead]) | (key[order] != key[lead]) | (at[order] != at[lead])]
        out = [(doc[copy], key[copy], first[copy], last[copy] + length)]
        rep = order[head]
        place = np.empty(len(h), np.int64)
        place[np.lexsort((at, key, doc))] = np.arange(len(h))
        ctx = {"low": (first - at)[rep], "high": (last - at)[rep], "text": text, "start": start[rep], "rank": place[rep]}
        anchor = h[rep]
        edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        groups = [np.arange(a, z) for a, z in zip(edge, np.append(edge[1:], len(anchor))) if z - a > 1]
        found = [f for f in _later_windows(list(_cut(groups, ctx, length)), ctx, length) if len(f[0])]
        if found:
            c, offset = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            order = np.lexsort((offset, c))
            c, offset = c[order], offset[order]
            new = np.ones(len(c), dtype=bool)
            new[1:] = (c[1:] != c[:-1]) | (offset[1:] > offset[:-1] + 1)
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(c)) - 1
            who = rep[c[a]]
            out.append((doc[who], key[who], at[who] + offset[a], at[who] + offset[z] + length))
        d, k, s, e = (np.concatenate([o[i] for o in out]) for i in range(4))
        return pa.table({"doc_id": pa.array(d), "key": pa.array(k), "start": pa.array(s), "stop": pa.array(e)})

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept = [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data, out, merged, at = (text or "").encode(), [], [], 0
            for s in sorted((x["start"], x["stop"]) for x in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
                else:
                    merged.append(s)
            for a, z in merged:
                out.append(data[at:a])
                at = z
            kept.append(b"".join([*out, data[at:]]))
            spans.append([{"start": a, "stop": z} for a, z in merged])
        yield pa.record_batch(
            [batch.column(0), pa.array([len((t or "").encode()) for t in batch.column(1).to_pylist()], pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "removed", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start, stop>>, kept) for each row of
    ``docs(doc_id, text)``; offsets count UTF-8 bytes of the original text."""
    parts = shuffle_partitions(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packs = own.mapInArrow(_emit_anchors(parts, length, k), "part int, pack binary")
    repeated = packs.groupBy("part").applyInArrow(_repeated(hot), "doc_id bigint, at bigint, hot boolean")
    lists = repeated.groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("hot"), F.col("at"))).alias("cool"), F.collect_list(F.when(F.col("hot"), F.col("at"))).alias("hot")
    )
    lists = materialise(lists, "sa-anchors")
    keyed = own.select("doc_id", F.xxhash64("text").alias("key"), "text")
    null = F.lit(int(_NULL)).cast("bigint")
    by_id = F.coalesce(keyed["doc_id"], null)

    def texts(kind: str, keep: DataFrame | None = None) -> DataFrame:
        some = lists.where(F.size(kind) > 0).select(F.col("doc_id").alias("l_id"), kind)
        if keep is None:
            return keyed.join(some.hint("merge"), by_id == some["l_id"]).select("doc_id", "key", "text", kind)
        some = some.join(keep, some["l_id"] == keep["k_id"], "left")
        return keyed.join(some.hint("merge"), by_id == some["l_id"]).select("doc_id", "key", "text", kind, "keep")

    contexts = texts("cool").mapInArrow(_contexts(parts, length, k), "part int, pack binary")
    spans = contexts.groupBy("part").applyInArrow(_spans(length), "doc_id bigint, key bigint, start bigint, stop bigint")
    if not lists.where(F.size("hot") > 0).isEmpty():
        windows = texts("hot").mapInArrow(_hot_windows(length, k), _WINDOW)
        first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "key", "at")).alias("first"))
        keep = first.groupBy(F.col("first.doc_id").alias("k_id")).agg(F.collect_list(F.struct("first.key", "first.at")).alias("keep"))
        hot_texts = texts("hot", keep)
        spans = spans.union(hot_texts.mapInArrow(_hot_spans(length, k), "doc_id bigint, key bigint, start bigint, stop bigint"))
    found = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    found = materialise(found, "sa-spans").select(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key"), "found")
    joined = keyed.join(found.hint("merge"), (by_id == found["s_id"]) & (keyed["key"] == found["s_key"]), "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_remove, "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,stop:bigint>>, kept binary")
