"""Exact n-gram Jaccard join (operator 5): a metric-space join over shingle sets.

A document is its set of distinct word shingles; two documents link when
``100 * |A n B| >= percent * |A u B|``, i.e. when their Jaccard *distance* (a metric)
is at most ``r = 1 - percent/100``. Links are needed up to connectivity: the result
gives each document the smallest doc_id it can reach.

1. **Classes.** Documents with the same set are one class (copies never form pairs).
2. **Pivots and regions.** Almost all texts lie at distance 1 from any other text, so
   text pivots would put everything on every border. The outer pivots are the shingles
   themselves, ranked by rarity (a fixed-size count sketch over all documents, then exact
   counts of the most common shingles of the windows that it gives; ties by hash; any fixed
   rank gives the same result). With ``P_s`` the shingles ranked before
   ``s``, the triangle inequality of the symmetric difference gives
   ``|x n P_s| <= |x - y|`` for the first common shingle ``s`` of a linked pair, so x
   belongs to the regions of its first ``n - ceil(t n) + 1`` shingles: its *window*,
   which replicates it over the borders. Windows are longer by m - 1 shingles, so linked
   sets meet in m regions, and pairs that meet less often are dropped. Inside a region, members whose sizes are more
   than a factor t apart, or whose places of ``s`` add up to too many differing
   shingles, cannot link. The rest of a small region are pairs, kept only if their
   counts in fixed cells of the shingle space (distances to fixed pivots) differ
   by no more than linked sets may; a large region is chained by size. What is connected
   by then is merged, and every link lies inside one merged region.
3. **Region join.** A region that fits a task is joined exactly by document pivots: the
   distances of all members to a pivot decide its links; members whose size or whose
   distance to an earlier pivot differs too much are skipped (triangle inequality);
   pivots are taken until every untested pair is already connected.
4. **Recursion.** A larger region is split: each member's distances to 16 document pivots
   are taken; members linked to pivots are connected through them. The members that are
   not yet connected with the region's main component lead Voronoi cells (nearest pivot);
   every member is copied into the cells whose windows of pivot distances, widened by r,
   it falls in. A cell that fits a task is joined there, its leads against its members; a
   larger one is a region of the next level, split by pivots taken from its own leads,
   until it fits. A cell that pivots no longer make smaller by a quarter (all its texts
   about equally far from each other) is cut by a hash and joined block by block.

Defined cases: null or empty text, or text without words: empty set, linked with
nothing, its own component. Fewer words than the shingle width: one shingle. Rows that
share a doc_id are separate rows (equal texts are one class anyway). A null doc_id
never wins the minimum; a component of null ids has a null component_id. Extra input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import bytescan as B
from .common import connected_components

SKETCH_BITS = 20
SKETCH_PART = 1 << 16
COMMON_BITS = 23
COMMON_MOST = 1 << 20  # shingles whose counts in the first windows are ranked by
COMMON_LEAST = 4
WINDOW_LEVELS = 2  # the counted windows have about a quarter of a text's shingles
REGION_SHINGLES = 1_000_000  # largest region (in shingles) that one task joins
PIVOTS = 16
SHRINK = 0.75  # share of a large region that a cell may hold to be split by pivots again
SMALL_REGION = 64  # rows of a pivot's region that are paired; more are chained
TIMES_SHINGLES = 128  # shingles of a set for one more common shingle in the windows
CELL_SHINGLES = 16  # shingles a cell; the counts in fixed cells bound the difference of sets

_SUMMARY = "doc_id bigint, n bigint, class bigint, cells binary, part int, counts binary"


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, set sizes, rows, distinct shingle hashes by row) by chunk."""
    for lo, hi, data, offs in B.text_chunks(batch.column(batch.schema.get_field_index("text"))):
        row, h = B.unique_by_row(*B.shingle_hashes(data, offs, width))
        yield lo, hi, np.bincount(row, minlength=hi - lo), row, h


def _classes(row: np.ndarray, h: np.ndarray, rows: int, n: np.ndarray) -> np.ndarray:
    """64-bit id of each row's set: sum of mixed hashes, mixed with the size."""
    total = np.zeros(rows, dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    full = n > 0
    if full.any():
        total[full] = np.add.reduceat(B.mix(h + np.uint64(0x5851F42D4C957F2D)), starts[full])
    return B.mix(total + n.astype(np.uint64)).view(np.int64)


def _cells(h: np.ndarray) -> bytes:
    """How many shingles of a set fall in each fixed cell; the number of cells, a power of
    two, follows the size of the set, and a finer division refines a coarser one."""
    k = 16
    while k * CELL_SHINGLES < len(h):
        k *= 2
    count = np.bincount(((h >> np.uint64(20)) & np.uint64(k - 1)).astype(np.int64), minlength=k)
    return np.minimum(count, 65535).astype("<u2").tobytes()


def _summarise(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, n, row, h in _sets(batch, width):
                sketch += np.bincount((h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
                m = hi - lo
                at = np.concatenate([[0], np.cumsum(n)])
                cells = [_cells(h[at[k] : at[k + 1]]) for k in range(m)]
                yield pa.record_batch(
                    [ids.slice(lo, m).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(_classes(row, h, m, n)),
                     pa.array(cells, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    names=["doc_id", "n", "class", "cells", "part", "counts"],
                )
        if sketch.any():
            parts = sketch.reshape(-1, SKETCH_PART)
            k = len(parts)
            yield pa.record_batch(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()),
                 pa.array([p.astype("<u4").tobytes() for p in np.minimum(parts, 2**32 - 1)], pa.binary())],
                names=["doc_id", "n", "class", "cells", "part", "counts"],
            )

    return run


def _add_counts(group: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_PART, dtype=np.int64)
    for c in group.column("counts"):
        total += np.frombuffer(c.as_py(), dtype="<u4")
    total = np.minimum(total, 2**32 - 1).astype("<u4")
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _rarity(summary: DataFrame) -> np.ndarray:
    """Level of every sketch bucket: the bit length of what its count has beyond one and a
    half times the median (4 MB reach the driver, whatever the input). On large tables the
    median is what the rare shingles of a bucket add up to, so only common ones show."""
    rows = (
        summary.where("part is not null").select("part", "counts")
        .groupBy("part").applyInArrow(_add_counts, "part int, counts binary").collect()
    )
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for r in rows:
        out[r["part"] * SKETCH_PART : (r["part"] + 1) * SKETCH_PART] = np.frombuffer(bytes(r["counts"]), dtype="<u4")
    return np.ceil(np.log2(np.maximum(out - 3 * int(np.median(out)) // 2, 0) + 1)).astype(np.uint8)


def _common(windows: DataFrame) -> np.ndarray:
    """Level of every bucket of the shingles that most windows have: up to about COMMON_MOST
    of them, counted exactly by class, in a table of fixed size.

    A sketch of all shingles can't tell a shingle of a thousand texts from a bucket of a
    thousand rare ones; the regions of such shingles would grow with the table and be merged
    to ones that hold unlike texts."""
    counts = windows.select("s", "class").repartition("s").groupBy("s", "class").agg(F.lit(1).alias("one"))
    counts = counts.groupBy("s").count().where(F.col("count") >= COMMON_LEAST)
    level = F.ceil(F.log2(F.col("count") + 1)).cast("int")
    counts = materialise(counts.select("s", level.alias("level")), "jj-common")
    out, total, least = np.zeros(1 << COMMON_BITS, dtype=np.uint8), 0, 64
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > COMMON_MOST:
            break
        least = r["level"]
    found = counts.where(F.col("level") >= least).toArrow()
    at = found.column("s").to_numpy().view(np.uint64) & np.uint64((1 << COMMON_BITS) - 1)
    np.maximum.at(out, at.astype(np.int64), found.column("level").to_numpy().astype(np.uint8) + np.uint8(WINDOW_LEVELS))
    return out


def _times(n: np.ndarray) -> np.ndarray:
    """How many shingles the windows of linked sets have in common: the one that the triangle
    inequality gives, and as many more as the windows are longer for it. Unlike texts that
    share a rare phrase hardly share so many."""
    return 2 + n // TIMES_SHINGLES


def _windows(width: int, percent: int, rarity, common=None, longer: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        rare, more = rarity.value, common.value if common else None
        for batch in batches:
            for lo, hi, n, row, h in _sets(batch, width):
                cls = _classes(row, h, hi - lo, n)
                level = rare[(h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                if more is not None:
                    level = np.maximum(level, more[(h & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)])
                key = (level.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                order = np.lexsort((h, key, row))
                row, h = row[order], h[order]
                at = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n)])[row]
                keep = at < (longer * (n - (n * percent + 99) // 100 + _times(n)))[row]
                row, h, at = row[keep], h[keep], at[keep]
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), pa.array(n[row].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(cls[row])], names=["s", "n", "at", "class"]
                )

    return run


def _meet(percent: int, small: int = SMALL_REGION, held: int = 1 << 16):
    """Members of each pivot's region (rows sorted by pivot and size) that may link.

    Regions of up to ``small`` rows give their pairs of compatible size and place (before a
    pair's common shingle number j all shingles but j - 1 differ), how often they meet and how
    often linked ones do. Larger regions
    are chained by size, which connects all compatible members; so is the part of a
    region that would outgrow ``held`` rows of memory."""

    def edges(s, n, at, c, hot: bool) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], s[1:] != s[:-1]])
        count = np.diff(np.append(np.flatnonzero(new), len(s)))[np.cumsum(new) - 1]
        many = (count > small) | hot
        out = []
        pick = np.flatnonzero(many)
        a, b = pick[:-1], pick[1:]
        ok = (s[a] == s[b]) & (c[a] != c[b]) & (100 * n[a] >= percent * n[b])
        out.append((c[a[ok]], c[b[ok]], np.zeros(ok.sum(), np.int64), True))
        pick = np.flatnonzero((count > 1) & ~many)
        for d in range(1, small):
            a, b = pick[:-d], pick[d:]
            ok = s[a] == s[b]
            if not ok.any():
                break
            ok &= (c[a] != c[b]) & (100 * n[a] >= percent * n[b])
            need = np.minimum(_times(n[a]), (n[b] * percent + 99) // 100)
            ok &= (at[a] + at[b] - 2 * (need - 1)) * (100 + percent) <= (100 - percent) * (n[a] + n[b])
            out.append((c[a[ok]], c[b[ok]], need[ok], False))
        for kind in (True, False):
            e = [np.stack([np.minimum(x, y), np.maximum(x, y), m], axis=1) for x, y, m, k in out if k is kind and len(x)]
            if e:
                e, times = np.unique(np.concatenate(e), axis=0, return_counts=True)
                yield pa.record_batch(
                    [pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1])), pa.array([kind] * len(e)),
                     pa.array(times.astype(np.int32)), pa.array(e[:, 2].astype(np.int32))], names=["src", "dst", "chain", "times", "need"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot = [np.zeros(0, np.int64)] * 4, False
        for batch in batches:
            rows = [np.concatenate([p, batch.column(i).to_numpy().astype(np.int64)]) for i, p in enumerate(rest)]
            s = rows[0]
            if len(s) == 0:
                continue
            # copies of a text are one member
            own = np.concatenate([[True], (s[1:] != s[:-1]) | (rows[3][1:] != rows[3][:-1])])
            rows = [x[own] for x in rows]
            s = rows[0]
            last = int(np.searchsorted(s, s[-1]))  # the last region may go on
            if hot and s[0] != s[-1]:  # the chained region ends here
                end = int(np.searchsorted(s, s[0], side="right"))
                yield from edges(*(x[:end] for x in rows), True)
                rows = [x[end:] for x in rows]
                last, hot = last - end, False
            if last:
                yield from edges(*(x[:last] for x in rows), False)
            rest = [x[last:] for x in rows]
            if len(rest[0]) > held:
                yield from edges(*rest, True)
                rest, hot = [x[-1:] for x in rest], True
        if len(rest[0]):
            yield from edges(*rest, hot)

    return run


def _near_cells(percent: int):
    """Pairs whose counts in the fixed cells allow a link: the counts differ by no more
    than the sets do (triangle inequality of the symmetric difference)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (batch.column(4).to_numpy() + batch.column(5).to_numpy()).tolist()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = (np.frombuffer(v, dtype="<u2").astype(np.int64) for v in (x, y))
                k = min(len(a), len(b))  # the finer counts are added up to the coarser cells
                a, b = (v.reshape(-1, k).sum(axis=0) for v in (a, b))
                if max(a.max(), b.max()) < 65535:
                    keep[i] = np.abs(a - b).sum() * (100 + percent) <= (100 - percent) * n[i]
                else:  # a count at the end of its range says nothing
                    keep[i] = True
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep))

    return run


def _wanted_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(classes, sets, rows) of the texts whose class is the one wanted, by chunk."""
    want = batch.column(batch.schema.get_field_index("want")).to_numpy()
    for lo, hi, n, row, h in _sets(batch, width):
        cls = _classes(row, h, hi - lo, n)
        starts = np.concatenate([[0], np.cumsum(n)])
        keep = np.flatnonzero(cls == want[lo:hi])
        yield cls[keep], [h[starts[k] : starts[k + 1]].astype("<u8").tobytes() for k in keep], keep + lo


class _Union:
    def __init__(self, m: int):
        self.root = np.arange(m)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        r = self.root
        while True:
            n = r[r]
            if (n == r).all():
                self.root = r
                return r
            r = n


def _flatten(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(local shingle numbers, set starts, set sizes)."""
    arrays = [np.frombuffer(b, dtype="<u8") for b in sets]
    n = np.array([len(a) for a in arrays], dtype=np.int64)
    flat = np.unique(np.concatenate(arrays), return_inverse=True)[1]
    return flat, np.concatenate([[0], np.cumsum(n)])[:-1], n


def _overlaps(flat, starts, n, x: int, rows: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Intersection sizes of set ``x`` with the sets ``rows``."""
    own = flat[starts[x] : starts[x] + n[x]]
    mark[own] = 1
    size = n[rows]
    if size.sum() * 2 > len(flat):
        out = np.add.reduceat(mark[flat], starts)[rows]
    else:
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        at = np.repeat(starts[rows] - first, size) + np.arange(size.sum())
        out = np.add.reduceat(mark[flat[at]], first)
    mark[own] = 0
    return out


def join_region(sets: list[bytes], percent: int) -> np.ndarray:
    """Exact component label of each (non-empty) set, by document pivots."""
    m = len(sets)
    flat, starts, n = _flatten(sets)
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    r = 1 - percent / 100
    comp, done = _Union(m), np.zeros(m, dtype=bool)
    seen: list[np.ndarray] = []  # distances to the first pivots, for the triangle windows
    while True:
        lab = comp.labels()
        sizes = np.bincount(lab, minlength=m)
        open_ = np.flatnonzero(~done & (lab != sizes.argmax()))
        if len(open_) == 0 or m == 1:
            return comp.labels()
        # one pivot of every open component a round
        for x in open_[np.unique(lab[open_], return_index=True)[1]]:
            lab = comp.labels()
            cand = (lab != lab[x]) & ~done & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
            first = len(seen) < 4
            if first:
                cand[:] = True
            else:
                for d in seen:
                    cand &= np.abs(d - d[x]) <= r + 1e-9
            done[x] = True
            rows = np.flatnonzero(cand)
            if len(rows) == 0:
                continue
            inter = _overlaps(flat, starts, n, x, rows, mark)
            union = n[x] + n[rows] - inter
            for y in rows[100 * inter >= percent * union]:
                comp.join(x, y)
            if first:
                seen.append(1 - inter / union)


def _join_small(width: int, percent: int):
    """A region's texts reach its task as they are; a set of hashes is about twice as long."""

    def run(group: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        classes, sets = [np.zeros(0, np.int64)], []
        for batch in group.to_batches():
            for cls, h, _ in _wanted_sets(batch, width):
                classes.append(cls)
                sets.extend(h)
        cls = np.concatenate(classes)
        lab = join_region(sets, percent) if sets else np.zeros(0, np.int64)
        return pa.table({"src": pa.array(cls), "dst": pa.array(cls[lab])})

    return run


def _to_pivots(percent: int):
    """Rows of one block with its region's pivots: distances, nearest pivot, links."""

    def run(group: pa.Table) -> pa.Table:
        cls, piv = group.column("class").to_numpy(), group.column("pivot").to_numpy(zero_copy_only=False).astype(bool)
        flat, starts, n = _flatten([v.as_py() for v in group.column("set")])
        mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
        own = np.flatnonzero(~piv)
        pivots = np.flatnonzero(piv)
        pivots = pivots[np.argsort(cls[pivots])]
        dist = np.zeros((len(own), len(pivots)))
        src, dst = [cls[own]], [cls[own]]
        for k, p in enumerate(pivots):
            inter = _overlaps(flat, starts, n, p, own, mark)
            union = n[p] + n[own] - inter
            dist[:, k] = 1 - inter / union
            hit = 100 * inter >= percent * union
            src.append(cls[own][hit])
            dst.append(np.full(hit.sum(), cls[p]))
        region = group.column("region")[0].as_py()
        s, t = np.concatenate(src), np.concatenate(dst)
        e = np.unique(np.stack([s, t], axis=1), axis=0)
        d = {int(c): row.tolist() for c, row in zip(cls[own], dist)}
        first = np.concatenate([[True], e[1:, 0] != e[:-1, 0]])
        return pa.table({
            "region": pa.array([region] * len(e), pa.int64()), "src": pa.array(np.ascontiguousarray(e[:, 0])),
            "dst": pa.array(np.ascontiguousarray(e[:, 1])),
            "dist": pa.array([d[int(c)] if f else None for c, f in zip(e[:, 0], first)], pa.list_(pa.float64())),
        })

    return run


def _join_blocks(percent: int):
    """Open members (side 0) of one block against all members (side 1) of another."""

    def run(group: pa.Table) -> pa.Table:
        cls, side = group.column("class").to_numpy(), group.column("side").to_numpy()
        flat, starts, n = _flatten([v.as_py() for v in group.column("set")])
        mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        other = np.flatnonzero(side == 1)
        for x in np.flatnonzero(side == 0):
            rows = other[100 * np.minimum(n[other], n[x]) >= percent * np.maximum(n[other], n[x])]
            if len(rows):
                inter = _overlaps(flat, starts, n, x, rows, mark)
                hit = rows[100 * inter >= percent * (n[x] + n[rows] - inter)]
                src.append(np.full(len(hit), cls[x]))
                dst.append(cls[hit])
        return pa.table({"src": pa.array(np.concatenate(src)), "dst": pa.array(np.concatenate(dst))})

    return run


def _pivot_distances(members: DataFrame, percent: int, level: int) -> DataFrame:
    """Links of ``members(region, class, set, lead, block, blocks)`` to up to PIVOTS leads of
    their region, and, once a member, its distances to them."""
    pivots = members.where("lead").groupBy("region", F.pmod(F.xxhash64("class", F.lit(level + 1)), F.lit(PIVOTS)).alias("k"))
    pivots = members.join(pivots.agg(F.min("class").alias("class")).select("region", "class"), ["region", "class"])
    spread = pivots.select("region", "class", "set", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(True).alias("pivot"))
    rows = members.select("region", "class", "set", "block", F.lit(False).alias("pivot")).union(spread)
    return rows.groupBy("region", "block").applyInArrow(_to_pivots(percent), "region bigint, src bigint, dst bigint, dist array<double>")


def _open_members(near: DataFrame) -> DataFrame:
    """(region, class, dist, lead): a lead is not connected with its region's main component."""
    linked = connected_components(near.select("src", "dst"))
    comp = near.where("dist is not null").join(linked, F.col("src") == F.col("node")).select("region", F.col("src").alias("class"), "dist", "root")
    main = comp.groupBy("region", "root").count().groupBy("region").agg(F.max(F.struct("count", "root")).getField("root").alias("main"))
    return comp.join(main, "region").select("region", "class", "dist", (F.col("root") != F.col("main")).alias("lead"))


def _voronoi(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """(region, cell, class, n, lead): the Voronoi cells of the leads (as many pivots as
    their sets fill tasks). Every member is copied into each cell whose window of pivot
    distances, widened by r, it falls in; a lead leads in its own cell only."""
    k = members.where("lead").groupBy("region").agg(F.least(F.lit(PIVOTS), F.ceil(F.sum("n") / F.lit(limit // 2))).cast("int").alias("k"))
    own = F.expr("array_position(slice(dist, 1, k), array_min(slice(dist, 1, k)))").cast("int")
    members = members.join(k, "region").withColumn("own", own)
    bounds = lambda f: F.expr(f"array({', '.join(f'{f}(get(dist, {i}))' for i in range(PIVOTS))})")
    windows = members.where("lead").groupBy("region", F.col("own").alias("cell")).agg(bounds("min").alias("low"), bounds("max").alias("high"))
    r = 1 - percent / 100 + 1e-9
    inside = F.expr(f"forall(sequence(0, size(dist) - 1), i -> dist[i] between low[i] - {r} and high[i] + {r})")
    placed = members.join(windows, "region").where(inside)
    return placed.select("region", "cell", "class", "n", (F.col("lead") & (F.col("own") == F.col("cell"))).alias("lead"))


def _join_cells(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the leads of each cell to its members, block by block."""
    full = placed.join(sets, ["region", "class"])
    cols = ["region", "cell", "part", "block", "class", "set"]
    part = F.pmod(F.xxhash64("class", F.lit(0)), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    every = lambda c: F.explode(F.expr(f"sequence(0, {c} - 1)"))
    leads = full.where("lead").withColumn("part", part).withColumn("block", every("blocks")).select(*cols, F.lit(0).alias("side"))
    rest = full.withColumn("block", block).withColumn("part", every("parts")).select(*cols, F.lit(1).alias("side"))
    return leads.union(rest).groupBy(*cols[:4]).applyInArrow(_join_blocks(percent), "src bigint, dst bigint")


def _large_regions(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links (up to connectivity) of the regions that no single task should hold.

    A region is split into cells; a cell that is still too large, but smaller than its
    region by ``SHRINK`` at least, is a region of the next level, with pivots of its own. A
    cell that pivots do not make smaller is joined block by block, every lead against all."""
    half = F.lit(limit // 2)
    members = members.join(members.groupBy("region").agg(F.sum("n").alias("whole")), "region").withColumn("lead", F.lit(True))
    found, level = [], 0
    while True:
        members = members.withColumn("blocks", F.ceil(F.col("whole") / half).cast("int"))
        members = materialise(members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "jj-large")
        near = materialise(_pivot_distances(members, percent, level), "jj-pivots")
        found.append(near.select("src", "dst"))
        if level == 0:
            known = _open_members(near)
            slim = members.select("region", "class", "n").join(known, ["region", "class"])
        else:  # what leads in a cell was settled on the first level
            known = near.where("dist is not null").select("region", F.col("src").alias("class"), "dist")
            slim = members.select("region", "class", "n", "lead").join(known, ["region", "class"])
        placed = materialise(_voronoi(materialise(slim, "jj-slim"), percent, limit), "jj-cells")
        load = placed.groupBy("region", "cell").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("lead"), F.col("n"))).alias("leads"))
        load = load.join(members.select("region", "whole").distinct(), "region")
        again = (F.col("total") > limit) & (F.col("total") <= F.lit(SHRINK) * F.col("whole"))
        load = load.select(
            "region", "cell", "total", again.alias("again"), F.ceil(F.col("leads") / half).cast("int").alias("parts"),
            F.ceil(F.col("total") / half).cast("int").alias("blocks"),
        )
        load = materialise(load, "jj-load")
        sets = members.select("region", "class", "set")
        placed = placed.join(load, ["region", "cell"])
        found.append(_join_cells(placed.where("not again"), sets, percent))
        if load.where("again").isEmpty():
            break
        below = placed.where("again").join(sets, ["region", "class"])
        members = below.select(F.xxhash64("region", "cell").alias("region"), "class", "n", "set", "lead", F.col("total").alias("whole"))
        level += 1
    out = found[0]
    for links in found[1:]:
        out = out.union(links)
    return out


def _with_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            region = batch.column(batch.schema.get_field_index("region"))
            for cls, sets, at in _wanted_sets(batch, width):
                yield pa.record_batch(
                    [region.take(pa.array(at)), pa.array(cls), pa.array([len(h) // 8 for h in sets], pa.int64()), pa.array(sets, pa.binary())],
                    names=["region", "class", "n", "set"],
                )

    return run


def jaccard_components(
    docs: DataFrame, width: int = 5, percent: int = 80, region_shingles: int = REGION_SHINGLES, small_region: int = SMALL_REGION
) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = materialise(own.mapInArrow(_summarise(width), _SUMMARY), "jj-summary")
    rows = summary.where("class is not null").select("doc_id", "n", "class")
    rarity = spark.sparkContext.broadcast(_rarity(summary))
    kinds = "s bigint, n int, at int, class bigint"
    # windows twice as long are counted, so those of texts that are common by half are known
    counted = own.select("text").mapInArrow(_windows(width, percent, rarity, longer=2), kinds)
    common = spark.sparkContext.broadcast(_common(counted))
    windows = own.select("text").mapInArrow(_windows(width, percent, rarity, common), kinds)
    met = windows.repartition("s").sortWithinPartitions("s", "n", "class").mapInArrow(_meet(percent, small_region), "src bigint, dst bigint, chain boolean, times int, need int")
    met = materialise(met, "jj-met")
    cells = summary.where("n > 0").groupBy("class").agg(F.max("n").alias("n"), F.max("cells").alias("cells"))
    left = cells.select(F.col("class").alias("src"), F.col("n").alias("n1"), F.col("cells").alias("c1"))
    right = cells.select(F.col("class").alias("dst"), F.col("n").alias("n2"), F.col("cells").alias("c2"))
    often = met.where("not chain").groupBy("src", "dst").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need")
    pairs = often.select("src", "dst").join(left, "src").join(right, "dst").select("src", "dst", "c1", "c2", "n1", "n2")
    near = pairs.mapInArrow(_near_cells(percent), "src bigint, dst bigint")
    regions = connected_components(near.union(met.where("chain").select("src", "dst")))
    reps = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    wanted = regions.join(reps, regions["node"] == reps["class"]).select(F.col("root").alias("region"), F.col("class").alias("want"), "rep", "n")
    wanted = materialise(wanted, "jj-wanted")
    wanted = wanted.join(wanted.groupBy("region").agg(F.sum("n").alias("total")), "region").drop("n")
    def texts(wanted: DataFrame) -> DataFrame:
        # the same sort-merge join at every size: the wanted texts grow with the corpus
        return own.join(wanted.hint("merge"), own["doc_id"].eqNullSafe(wanted["rep"])).select("region", "want", "text")

    small = texts(wanted.where(F.col("total") <= region_shingles))
    edges = small.groupBy("region").applyInArrow(_join_small(width, percent), "src bigint, dst bigint")
    labels = materialise(edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).distinct(), "jj-labels")
    if not wanted.where(F.col("total") > region_shingles).isEmpty():
        large = texts(wanted.where(F.col("total") > region_shingles))
        large = materialise(large.mapInArrow(_with_sets(width), "region bigint, class bigint, n bigint, set binary"), "jj-members")
        labels = labels.union(connected_components(_large_regions(large.dropDuplicates(["class"]), percent, region_shingles)))
    of_class = rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))
    of_class = of_class.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "least", "n", F.coalesce("root", "class").alias("root")
    )
    comp = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(comp, "root").select("class", "component_id")
    return rows.join(of_class, "class").select(
        "doc_id", F.col("n").alias("n_shingles"), "class",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest (all columns kept;
    of rows repeated under that doc_id, one is kept). Rows with a null doc_id stay."""
    found = materialise(jaccard_components(docs, width, percent).select("doc_id", "component_id"), "jj-found")
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__jj_id")).distinct()
    kept = docs.join(drop, docs["doc_id"] == drop["__jj_id"], "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__jj_id"))
    if again.isEmpty():
        return kept
    again = materialise(again, "jj-again")  # ids of repeated rows: only those texts are compared
    single = kept.join(again, kept["doc_id"] == again["__jj_id"], "left_anti")
    return single.unionByName(kept.join(again, kept["doc_id"] == again["__jj_id"], "left_semi").dropDuplicates(["doc_id"]))
