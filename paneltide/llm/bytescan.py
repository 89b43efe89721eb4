"""Vectorised scans over the UTF-8 bytes of Arrow text columns (used inside tasks).

Every helper works on one *chunk*: a run of rows whose texts hold about half a megabyte
together, so memory is bounded whatever the Arrow batch holds. A single text larger
than a chunk forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
U64 = np.uint64
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * _MIX1
    h = h ^ (h >> U64(33))
    h = h * _MIX2
    return h ^ (h >> U64(33))


def byte_table(seed: int) -> np.ndarray:
    """256 fixed pseudo-random odd 64-bit values."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_TABLE = byte_table(7)
_POW: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (grown on demand, one copy a worker)."""
    key = "inv" if inverse else "pow"
    have = _POW.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        base = U64(_BASE_INV if inverse else _BASE)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size > 16 * CHUNK_BYTES:  # one oversized text: do not keep its table
            return have
        _POW[key] = have
    return have[:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of each chunk; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end, data[offs[start] : offs[end]], offs[start : end + 1] - offs[start]
        start = end


def prefix_hash(data: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """S with S[j] - S[i] = base**i * hash(data[i:j]); length len(data) + 1."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(table[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of each byte span (its length is mixed in)."""
    inv = powers(len(prefix), inverse=True)
    raw = (prefix[ends] - prefix[starts]) * inv[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def token_spans(is_token: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of token bytes; runs never cross rows."""
    n = len(is_token)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets[:-1]] = True  # every row begins anew
    prev = np.zeros(n, dtype=bool)
    prev[1:] = is_token[:-1]
    begin = is_token & (~prev | edge[:n])
    nxt = np.zeros(n, dtype=bool)
    nxt[:-1] = is_token[1:]
    stop = is_token & (~nxt | edge[1:])
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


# Fixed byte classes: A-Z to lower case; 0x20 and 0x09-0x0D separate words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``width``-word shingle; a row with fewer words gives its
    whole word sequence as one shingle, a row without words gives none."""
    low = LOWER[data]
    starts, ends, row = token_spans(IS_WORD[low], offsets)
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    words = span_hash(prefix_hash(low), starts, ends)
    rows = len(offsets) - 1
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    acc = np.zeros(len(words), dtype=U64)
    for k in range(width):  # order-sensitive combination of the next ``width`` words
        part = mix(words + U64((k + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        acc[: len(words) - k] += part[k:]
    full = np.arange(len(words)) + width <= (first + counts)[row]
    out_row, out_hash = row[full], mix(acc[full])
    for r in np.flatnonzero((counts > 0) & (counts < width)):  # short rows
        seq = words[first[r] : first[r] + counts[r]]
        h = U64(counts[r])
        for k, w in enumerate(seq):
            h = h + mix(w[None] + U64((k + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))[0]
        out_row = np.append(out_row, r)
        out_hash = np.append(out_hash, mix(np.asarray([h], dtype=U64)))
    return out_row, out_hash


def unique_by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs ordered by row, then value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
