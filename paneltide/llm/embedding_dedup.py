"""Embedding near-dedup (operator 8) with randomised-rotation binary codes.

* Equal vectors of a label are one class with a multiplicity; copies never form pairs.
* Each vector is normalised, padded with zeros to ``BITS`` dimensions and rotated by a
  fixed random orthogonal matrix; its code is the signs of the rotated vector. Stored
  with it is the correction factor ``f = <code, vector>`` of the unit vectors: dividing
  ``<code, query>`` by ``f`` is an unbiased estimate of the inner product, with standard
  error ``sqrt((1 - f^2) / f^2 / (BITS - 1))``.
* Candidates share at least one of the ``BITS / 16`` 16-bit blocks of the code within
  their label. A pair at cosine 0.98 misses a block with probability 0.65, all 32 with
  about 1e-6; a pair is handled in the first block that it shares only.
* Among candidates, pairs whose estimate plus ``SIGMAS`` standard errors stays below the
  threshold are decided by the bound; all others are recomputed exactly in double
  precision, so no link lies below the threshold.

A bucket larger than ``BLOCK`` vectors is cut into blocks and every pair of blocks is a
group of its own, so no task holds a hot bucket; links are counted where they are found
and leave a task as counts and star edges, never as pairs.

Defined cases: a null label, and a vector that is null, empty, zero or has a null or
non-finite component, links with nothing: no links, its own component, kept. Vectors of
different lengths never link. Rows repeated with the same vector and label are copies
(linked); rows that share a vec_id are separate rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import connected_components

BITS = 512
TABLES = BITS // 16
THRESHOLD = 0.98
SIGMAS = 4.0
BLOCK = 1024
ROWS = 4096  # rows of whole groups that a task compares together
DENSE = 64  # a group with more rows is compared by matrix products
PAIRS = 1 << 18
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """The first ``dim`` rows of a fixed random orthogonal matrix (dim x bits)."""
    if dim not in _ROTATIONS:
        bits = max(BITS, dim)
        q, r = np.linalg.qr(np.random.default_rng(20240 + dim).standard_normal((bits, bits)))
        _ROTATIONS[dim] = np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim])
    return _ROTATIONS[dim]


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, signs as +-1, correction factors) of unit vectors."""
    turned = unit @ rotation(unit.shape[1])
    signs = np.where(turned >= 0, 1.0, -1.0)
    return turned, signs, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def block_values(signs: np.ndarray) -> np.ndarray:
    """The 16-bit blocks of each code (the first ``TABLES``)."""
    return np.packbits(signs[:, : TABLES * 16] > 0, axis=1).view(">u2").astype(np.int32)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, class, label, vector, blocks); class is null where nothing can link."""
    for batch in batches:
        ids, labels, column = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        column = column.cast(pa.list_(pa.float64()))
        sizes = np.array(pc.fill_null(pc.list_value_length(column), 0))
        values = np.array(pc.fill_null(pc.list_flatten(column).cast(pa.float64()), np.nan), dtype=np.float64)
        ends = np.cumsum(sizes)
        n = len(labels)
        cls, vec, blk = [None] * n, [None] * n, [None] * n
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == dim)
            x = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                scale = np.abs(x).max(axis=1)
                unit = x / scale[:, None]
                unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
            good = np.isfinite(unit).all(axis=1) & np.isfinite(x).all(axis=1)
            rows, x, unit = rows[good], x[good], unit[good]
            if len(rows):
                values16 = block_values(codes(unit)[1])
                for k, r in enumerate(rows.tolist()):
                    if labels[r] is not None:
                        raw = np.ascontiguousarray(x[k] + 0.0).tobytes()  # -0.0 is 0.0
                        cls[r] = int.from_bytes(hashlib.blake2b(raw + labels[r].encode(), digest_size=8).digest(), "big", signed=True)
                        vec[r], blk[r] = raw, values16[k].tolist()
        yield pa.record_batch(
            [ids, pa.array(cls, pa.int64()), pa.array(labels, pa.string()), pa.array(vec, pa.binary()), pa.array(blk, pa.list_(pa.int32()))],
            names=["vec_id", "class", "label", "vector", "blocks"],
        )


def pairs_of(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i in left, j in right) of rows of ``x`` with cosine >= threshold, and how
    many pairs were recomputed exactly. ``fresh`` (left x right) limits the pairs."""
    with np.errstate(over="ignore"):
        unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    turned, signs, factor = codes(unit)
    bits = turned.shape[1]
    error = np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / (bits - 1))
    least = (threshold - SIGMAS * error - 1e-4) * np.sqrt(bits) * factor  # of <rotated, signs>
    if fresh is None:
        fresh = np.ones((len(left), len(right)), dtype=bool)
    if fresh.sum() * 16 < fresh.size:  # few pairs: one by one
        i, j = np.nonzero(fresh)
        keep = [np.einsum("ij,ij->i", turned[left[i[s]]], signs[right[j[s]]]) >= least[right[j[s]]] for s in _slices(len(i), 1 << 13)]
        keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        i, j = i[keep], j[keep]
    else:
        i, j = np.nonzero((turned[left].astype(np.float32) @ signs[right].T.astype(np.float32) >= least[right].astype(np.float32)) & fresh)
    if len(i) * 16 < fresh.size:
        exact = [np.einsum("ij,ij->i", unit[left[i[s]]], unit[right[j[s]]]) for s in _slices(len(i), 1 << 16)]
        hit = np.concatenate(exact) >= threshold if exact else np.zeros(0, dtype=bool)
    else:
        hit = (unit[left] @ unit[right].T)[i, j] >= threshold
    return left[i[hit]], right[j[hit]], len(i)


def _slices(n: int, step: int) -> list[slice]:
    return [slice(a, min(a + step, n)) for a in range(0, n, step)]


def pairs_listed(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the listed pairs of rows of ``x`` that have cosine >= threshold; decided as
    in :func:`pairs_of`, codes are made once a row."""
    used, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    unit = x[used]
    with np.errstate(over="ignore"):
        unit = unit / np.abs(unit).max(axis=1, keepdims=True)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    turned, signs, factor = codes(unit)
    bits = turned.shape[1]
    error = np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / (bits - 1))
    least = (threshold - SIGMAS * error - 1e-4) * np.sqrt(bits) * factor
    i, j = at[: len(left)], at[len(left) :]
    hit = np.zeros(len(i), dtype=bool)
    for s in _slices(len(i), 1 << 13):
        near = np.flatnonzero(np.einsum("ij,ij->i", turned[i[s]], signs[j[s]]) >= least[j[s]]) + s.start
        hit[near] = np.einsum("ij,ij->i", unit[i[near]], unit[j[near]]) >= threshold
    return left[hit], right[hit]


def _small_pairs(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, partner) lists where row r pairs with rows first[r] .. end[r] - 1, some
    hundred thousand pairs at a time."""
    many = np.maximum(end - first, 0)
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(many[lo:]), PAIRS, side="right")) + lo)
        n = many[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]
        lo = hi


def _links(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    """(class, root, links) of whole groups that lie one after the other. Large groups are
    compared by matrix products, all small ones together pair by pair."""
    cls, side, weight = (rows.column(c).to_numpy() for c in ("class", "side", "m"))
    table = rows.column("table").to_numpy()
    blocks = np.array(rows.column("blocks").to_pylist(), dtype=np.int32)
    vectors = rows.column("vector").to_pylist()
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors)) // 8
    flat = np.frombuffer(b"".join(vectors), dtype=np.float64)
    begin = np.cumsum(sizes) - sizes
    edges = np.append(np.flatnonzero(rows.column("new").to_numpy()), len(cls))
    size = np.diff(edges)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a, z in zip(edges[:-1][size > DENSE].tolist(), edges[1:][size > DENSE].tolist()):
        x, own, t = flat[begin[a] : begin[z - 1] + sizes[z - 1]].reshape(z - a, -1), blocks[a:z], table[a]
        same = (side[a:z] == 2).all()  # one block with itself
        left, right = (np.arange(z - a),) * 2 if same else (np.flatnonzero(side[a:z] == 0), np.flatnonzero(side[a:z] == 1))
        if len(left) and len(right):
            # pairs that share an earlier block are handled there
            fresh = left[:, None] < right[None, :] if same else np.ones((len(left), len(right)), dtype=bool)
            for k in range(t):
                fresh &= own[left, k][:, None] != own[right, k][None, :]
            i, j, _ = pairs_of(x, left, right, threshold, fresh)
            found.append((i + a, j + a))
    # in a small group a row meets the rows after it, or of side 0 those of side 1 (sorted behind)
    group = np.repeat(np.arange(len(size)), size)
    zeros = np.bincount(group, weights=side == 0, minlength=len(size)).astype(np.int64)
    here = np.arange(len(cls))
    first = np.where(side == 2, here + 1, np.where(side == 0, edges[:-1][group] + zeros[group], len(cls)))
    end = np.where(size[group] > DENSE, 0, edges[1:][group])
    for i, j in _small_pairs(first, end):
        earlier = ((blocks[i] == blocks[j]) & (np.arange(TABLES) < table[i][:, None])).any(axis=1)
        i, j = i[~earlier], j[~earlier]
        for dim in np.unique(sizes[i]).tolist():  # the rows of a group have one length
            own = sizes[i] == dim
            used, at = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
            x = flat[begin[used][:, None] + np.arange(dim)]
            li, lj = pairs_listed(x, at[: own.sum()], at[own.sum() :], threshold)
            found.append((used[li], used[lj]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    links = np.bincount(i, weights=weight[j], minlength=len(cls)) + np.bincount(j, weights=weight[i], minlength=len(cls))
    root = here.copy()
    while len(i):  # smallest reachable row, by repeated minimum and pointer jumps
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(links > 0)
    return pa.record_batch([pa.array(cls[at]), pa.array(cls[root[at]]), pa.array(links[at].astype(np.int64))], names=["class", "root", "links"])


def _buckets(threshold: float):
    """Links from rows sorted by group; whole groups of about ``ROWS`` rows at a time."""
    key = ["label", "width", "table", "value", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last, n = None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
            new = np.fromiter((x != y for x, y in zip(keys, [last, *keys])), bool, len(keys))
            rows = pa.Table.from_batches([batch]).append_column("new", pa.array(new))
            at, borders = 0, np.flatnonzero(new)
            while True:  # cut at the first border where enough rows are held
                later = borders[(borders > at) | ((borders == at) & (n > 0))]
                later = later[later - at + n >= ROWS]
                if not len(later):
                    break
                cut = int(later[0])
                held.append(rows.slice(at, cut - at))
                yield _links(pa.concat_tables(held).combine_chunks(), threshold)
                held, n, at = [], 0, cut
            held.append(rows.slice(at))
            n += len(rows) - at
            last = keys[-1] if keys else last
        if n:
            yield _links(pa.concat_tables(held).combine_chunks(), threshold)

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, label, embedding)``."""
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = materialise(
        own.mapInArrow(_prepare, "vec_id bigint, class bigint, label string, vector binary, blocks array<int>"), "emb-rows"
    )
    classes = rows.where("class is not null").groupBy("class").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    whole = rows.where("class is not null").select("class", "label", "vector", "blocks").dropDuplicates(["class"])
    whole = materialise(whole.join(classes, "class"), "emb-classes")
    width = F.length("vector")
    keys = whole.select("class", "label", width.alias("width"), F.posexplode("blocks").alias("table", "value"))
    bucket = ["label", "width", "table", "value"]
    sizes = keys.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.withColumn("cuts", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    member = keys.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int"))
    member = member.withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
    member = member.select(
        "class", *bucket, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.expr("case when own = other then 2 when own < other then 0 else 1 end").alias("side"),
    )
    full = member.join(whole.select("class", "m", "vector", "blocks"), "class")
    full = full.repartition(*bucket, "a", "b").sortWithinPartitions(*bucket, "a", "b", "side")
    found = materialise(full.mapInArrow(_buckets(threshold), "class bigint, root bigint, links bigint"), "emb-links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("class").alias("src"), F.col("root").alias("dst")).distinct())
    known = classes.join(links, "class", "left").join(comp.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "m", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root")
    )
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("class", (F.col("m") - 1 + F.col("links")).alias("n_links"), "component_id")
    out = rows.select("vec_id", "class").join(known, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
