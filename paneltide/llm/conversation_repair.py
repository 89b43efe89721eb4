"""Conversation structure repair (operator 11) by a run-length dynamic program.

The rows of a conversation, by turn (nulls first; equal turns by role, then by a digest of
the text), must have role initials ``(s?(ua)+)?``. A row's first fault is: blank (no
visible character), duplicate (role and text seen earlier in the conversation) or
truncated (its last visible character is none of ``.!?``). Edits: Keep 0, Rerole to
user/assistant 2, Delete 3 (the only one for blank and duplicate rows), Insert an empty
user/assistant turn 2; a truncated row that stays adds 1. Of the cheapest edit strings the
ASCII-least is the audit.

1. Rows are range-partitioned and sorted by conversation and turn, so a long conversation
   is spread over many tasks; their positions are written with them. Equal rows of a
   batch travel as one row with a number of copies.
2. A row's role and fault form one of nine symbols. Each block of 4,096 positions
   collapses its equal consecutive symbols to runs. The pattern is an automaton of four
   states, so a symbol is a 4 x 4 min-plus transition; a run of n is the product of cached
   binary powers, a block the product of its runs.
3. The matrices of a conversation, one a block, are streamed from its last to its first:
   each block learns the cost of everything after it.
4. Each block unrolls its choices for every entry state: a run is halved down to single
   rows by the cached powers, and at a row the ASCII-least of the edits that keep the
   cost is taken. Halves that were unrolled before (same symbol, length, state and costs)
   come from a cache.
5. Rows and block results meet ordered by position, and the edits are applied as a stream.
   Only here does a conversation pass through one task, in constant memory: the digest of
   its repaired text is one sequential hash.

Defined cases: null role or text counts as one space; null conv_id is a conversation of
its own; a null turn has no part in gaps. An unknown or empty role can be reroled or
deleted, never kept; a role counts by its first letter. Conversations without rows
(:func:`damage` dropped them all) have zeros, an empty audit and the digest of an empty
string. Rows repeated in the input are duplicates of each other. Texts that agree in 128
bits of BLAKE2 are the same. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BLOCK_BITS = 12
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
SPACE = " \t\n\v\f\r"
_FAR = 1 << 40  # more than any conversation costs

# States of (s?(ua)+)?: nothing yet, after s, after u, after a (nothing yet and a accept).
START, S, U, A = range(4)
_NEXT = (U, U, A, U)  # where the only possible new turn leads
_END = (0, 2 * INSERT, INSERT, 0)  # cheapest way to finish after the last row
# Symbols: class of the role initial (s, u, a, other) + 4 if truncated; 8 must be deleted.
_CLASS = {"s": 0, "u": 1, "a": 2}
MUST_DELETE = 8
_KEEP = ({START: S}, {START: U, S: U, A: U}, {U: A}, {})
_LEGAL = {(0, 1), (1, 2), (2, 1)}

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def _row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol != MUST_DELETE:
        cut = CUT if symbol >= 4 else 0
        to = _KEEP[symbol % 4].get(state)
        if to is not None:
            out.append(("K", cut, to))
        out.append(("R", REROLE + cut, _NEXT[state]))
    return out


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(_FAR, *(r[k] + b[k][j] for k in range(4))) for j in range(4)) for r in a)


times = lru_cache(1 << 14)(_times)


@lru_cache(1 << 14)
def after(m: Matrix, v: Vector) -> Vector:
    """Cost to go before a stretch with matrix m, from the cost to go after it."""
    return tuple(min(_FAR, *(m[q][k] + v[k] for k in range(4))) for q in range(4))


IDENTITY: Matrix = tuple(tuple(0 if i == j else _FAR for j in range(4)) for i in range(4))


@lru_cache(None)
def binary_power(symbol: int, k: int) -> Matrix:
    """The transition of 2**k equal rows: any inserts, then the row's edit, 2**k times."""
    if k:
        half = binary_power(symbol, k - 1)
        return _times(half, half)
    m = [[_FAR] * 4 for _ in range(4)]
    for q in range(4):
        state, paid = q, 0
        for _ in range(4):
            for _, cost, to in _row_edits(symbol, state):
                m[q][to] = min(m[q][to], paid + cost)
            state, paid = _NEXT[state], paid + INSERT
    return tuple(map(tuple, m))


def run_matrix(symbol: int, n: int) -> Matrix:
    out, k = IDENTITY, 0
    while n >> k:
        if n >> k & 1:
            out = times(out, binary_power(symbol, k))
        k += 1
    return out


def run_before(symbol: int, n: int, v: Vector) -> Vector:
    k = 0
    while n >> k:
        if n >> k & 1:
            v = after(binary_power(symbol, k), v)
        k += 1
    return v


@lru_cache(1 << 13)
def _unroll(symbol: int, n: int, state: int, v: Vector) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of n equal rows, and the state they end in."""
    if n > 1:
        half = 1 << ((n - 1).bit_length() - 1)
        left, state = unroll(symbol, n - half, state, after(binary_power(symbol, half.bit_length() - 1), v))
        right, state = unroll(symbol, half, state, v)
        return left + right, state
    here, out = after(binary_power(symbol, 0), v), ""
    while True:
        row = [(letter, to) for letter, cost, to in _row_edits(symbol, state) if cost + v[to] == here[state]]
        if row and row[0][0] == "D":
            return out + "D", row[0][1]
        if INSERT + here[_NEXT[state]] == here[state]:
            out, state = out + "I", _NEXT[state]
        else:
            return out + row[0][0], row[0][1]


def unroll(symbol: int, n: int, state: int, v: Vector) -> tuple[str, int]:
    least = min(v)  # equal choices follow from equal differences
    return _unroll(symbol, n, state, tuple(min(_FAR, x - least) if x < _FAR else _FAR for x in v))


def unroll_block(runs: list[tuple[int, int]], v: Vector) -> list[tuple[str, int]]:
    """(edits, exit state) for each entry state, given the cost to go after the block."""
    ends = []
    for symbol, n in reversed(runs):
        ends.append(v)
        v = run_before(symbol, n, v)
    out = []
    for state in range(4):
        if v[state] >= _FAR:
            out.append(("", -1))
            continue
        letters = []
        for (symbol, n), end in zip(runs, reversed(ends)):
            found, state = unroll(symbol, n, state, end)
            letters.append(found)
        out.append(("".join(letters), state))
    return out


# ------------------------------------------------------------------ Spark stages


def damage(conversations: DataFrame) -> DataFrame:
    """Faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text,
    2 removes ``.!?``, 3 repeats it, 4 makes its role user. A dropped row stays as one with
    0 ``copies``, so that its conversation is not lost."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(by <= 1, F.lit("")).when(by == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    return conversations.select(
        "conv_id", "turn", F.when(by == 4, F.lit("user")).otherwise(one("role")).alias("role"), text.alias("text"),
        F.when(by == 0, 0).when(by == 3, 2).otherwise(1).alias("copies"),
    )


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row; digest and kind (b blank, t truncated) of its text."""
    names = ["conv_id", "turn", "role", "digest", "kind", "text", "copies"]
    for batch in batches:
        digests, kinds = [], []
        for text in batch.column(3).to_pylist():
            digests.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            seen = text.rstrip(SPACE)
            kinds.append("" if seen and seen[-1] in ".!?" else "t" if seen else "b")
        rows = pa.table([*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(kinds, pa.string()), *batch.columns[3:]], names=names)
        rows = rows.group_by(names[:5], use_threads=False).aggregate([("text", "first"), ("copies", "sum")])
        yield from rows.rename_columns(names).combine_chunks().to_batches()


_BLOCK = (
    "conv_id bigint, block bigint, symbols array<int>, lengths array<bigint>, matrix array<bigint>, first int, last int, "
    "n_blank bigint, n_duplicate bigint, n_truncated bigint, n_illegal bigint, min_turn bigint, max_turn bigint, n_turns bigint"
)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block from (conv_id, block, pos, turn, initial, kind, again, copies), sorted."""
    names = [f.split()[0] for f in _BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), *[pa.int64()] * 7]
    key, st = None, None
    done: list[tuple] = []

    def close() -> None:
        m = IDENTITY
        for symbol, n in st["runs"]:
            m = times(m, run_matrix(symbol, n))
        done.append((
            *key, [s for s, _ in st["runs"]], [n for _, n in st["runs"]], [x for r in m for x in r], st["first"], st["last"],
            st["b"], st["d"], st["t"], st["illegal"], st["min"], st["max"], st["turns"],
        ))

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)
        done.clear()
        return out

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7)]
        for conv, block, turn, initial, kind, again, copies in zip(*cols):
            if key != (conv, block):
                if key is not None:
                    close()
                key = (conv, block)
                st = {"runs": [], "first": None, "last": None, "b": 0, "d": 0, "t": 0, "illegal": 0, "min": None, "max": None, "turns": 0}
            if copies == 0:
                continue
            c = _CLASS.get(initial, 3)
            if kind == "b":
                st["b"] += copies
                parts = [(MUST_DELETE, copies)]
            elif again:
                st["d"] += copies
                parts = [(MUST_DELETE, copies)]
            else:
                st["t"] += kind == "t"
                st["d"] += copies - 1
                parts = [(c + (4 if kind == "t" else 0), 1), (MUST_DELETE, copies - 1)]
            for symbol, n in parts:
                if n and st["runs"] and st["runs"][-1][0] == symbol:
                    st["runs"][-1] = (symbol, st["runs"][-1][1] + n)
                elif n:
                    st["runs"].append((symbol, n))
            if st["first"] is None:
                st["first"] = c
            elif (st["last"], c) not in _LEGAL:
                st["illegal"] += 1
            st["illegal"] += copies - 1  # no initial may follow itself
            st["last"] = c
            if turn is not None and turn != st["max"]:
                st["turns"] += 1
                st["min"] = turn if st["min"] is None else st["min"]
                st["max"] = turn
        if done:
            yield flush()
    if key is not None:
        close()
        yield flush()


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost to go after each block; the blocks of a conversation come last to first."""
    key, v = None, _END
    for batch in batches:
        out = []
        for i, (conv, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            if i == 0 and key is None or key != (conv,):
                key, v = (conv,), _END
            out.append(v)
            v = after(tuple(tuple(m[4 * q : 4 * q + 4]) for q in range(4)), v)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "block", "ahead"])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exit state, edits and cost to go for each entry state of a block."""
    for batch in batches:
        got = batch.to_pydict()
        audits, exits, costs = [], [], []
        for symbols, lengths, m, v in zip(got["symbols"], got["lengths"], got["matrix"], got["ahead"]):
            found = unroll_block(list(zip(symbols, lengths)), tuple(v))
            audits.append([a for a, _ in found])
            exits.append([e for _, e in found])
            costs.append(after(tuple(tuple(m[4 * q : 4 * q + 4]) for q in range(4)), tuple(v))[START])
        keep = [n for n in batch.schema.names if n not in ("symbols", "lengths", "matrix", "ahead")]
        yield pa.record_batch(
            [*(batch.column(n) for n in keep), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32())), pa.array(costs, pa.int64())],
            names=[*keep, "audits", "exits", "cost"],
        )


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv_id bigint, place bigint, edit string, turn bigint, role string, text string"


class _Conversation:
    """Applies the edits of one conversation while its blocks and rows pass by."""

    def __init__(self, conv_id: int | None, turns: list[tuple] | None):
        self.conv_id, self.turns = conv_id, turns
        self.state, self.place, self.edits, self.at = START, 0, "", 0
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.total = dict.fromkeys(("n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns"), 0)
        self.cost, self.next_state, self.last, self.low, self.high = None, START, None, None, None

    def _put(self, edit: str, turn: int | None, role: str, text: str) -> None:
        if self.place:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if self.turns is not None:
            self.turns.append((self.conv_id, self.place, edit, turn, role, text))
        self.place += 1

    def _new_role(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == U else "assistant"

    def block(self, b: dict) -> None:
        if self.cost is None:
            self.cost = b["cost"]
        self.state = self.next_state
        self.edits, self.at, self.next_state = b["audits"][self.state], 0, b["exits"][self.state]
        self.audit.append(self.edits)
        for name in self.total:
            self.total[name] += b[name]
        if b["first"] is not None:
            self.total["n_illegal"] += self.last is not None and (self.last, b["first"]) not in _LEGAL
            self.last = b["last"]
        if b["min_turn"] is not None:
            self.total["n_turns"] -= b["min_turn"] == self.high
            self.low = b["min_turn"] if self.low is None else self.low
            self.high = b["max_turn"]

    def row(self, turn: int | None, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            while (edit := self.edits[self.at]) == "I":
                self._put("I", None, self._new_role(), "")
                self.at += 1
            self.at += 1
            if edit == "R":
                self._put("R", turn, self._new_role(), text)
            elif edit == "K":
                self.state = _KEEP[_CLASS[role[0]]][self.state]
                self._put("K", turn, role, text)

    def report(self) -> tuple:
        self.state = self.next_state
        while _END[self.state]:
            self.audit.append("I")
            self._put("I", None, self._new_role(), "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.total["n_turns"]
        counts = [self.total[n] for n in ("n_blank", "n_duplicate", "n_truncated", "n_illegal")]
        return (self.conv_id, gaps, *counts, self.cost, "".join(self.audit), self.sha.hexdigest())


def _apply(want_turns: bool):
    """Reports, or repaired turns, from blocks (``kind`` 0) and rows (1) sorted by position."""
    fields = [f.split() for f in (TURNS if want_turns else REPORT).split(", ")]
    kinds = [pa.int64() if k == "bigint" else pa.string() for _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Conversation | None = None
        out: list[tuple] = []
        turns = out if want_turns else None
        parts = ("cost", "audits", "exits", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns", "first", "last", "min_turn", "max_turn")

        def end() -> None:
            report = current.report()
            if not want_turns:
                out.append(report)

        def flush() -> pa.RecordBatch:
            made = pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=[n for n, _ in fields])
            out.clear()
            return made

        for batch in batches:
            got = batch.to_pydict()
            for i, (conv, head) in enumerate(zip(got["conv_id"], got["head"])):
                if current is None or current.conv_id != conv:
                    if current is not None:
                        end()
                    current = _Conversation(conv, turns)
                if head:
                    current.block({p: got[p][i] for p in parts})
                else:
                    current.row(got["turn"][i], got["role"][i], got["text"][i], got["copies"][i])
            if out:
                yield flush()
        if current is not None:
            end()
            if out:
                yield flush()

    return run


def _repair(conversations: DataFrame, copies: str | None, block_bits: int, want_turns: bool) -> DataFrame:
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.col(copies).cast("bigint") if copies else F.lit(1).cast("bigint")
    own = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), one("role").alias("role"), one("text").alias("text"), n.alias("copies"))
    rows = own.mapInArrow(_combine, "conv_id bigint, turn bigint, role string, digest binary, kind string, text string, copies bigint")
    order = ["conv_id", "turn", "role", "digest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    rows = materialise(rows, "cr-rows")
    # duplicates: the first position of each role and text; only those found twice come back
    real = rows.where("copies > 0")
    first = real.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("f_id"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), "first")
    marked = rows.select("conv_id", "pos", "turn", "role", "digest", "kind", "copies").join(
        first, F.col("conv_id").eqNullSafe(F.col("f_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest")), "left"
    )
    marked = marked.select(
        "conv_id", F.shiftright("pos", block_bits).alias("block"), "pos", "turn", F.substring("role", 1, 1).alias("initial"), "kind",
        F.coalesce(F.col("pos") > F.col("first"), F.lit(False)).alias("again"), "copies",
    )
    blocks = marked.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(_collapse, _BLOCK)
    blocks = materialise(blocks, "cr-blocks")
    ahead = blocks.select("conv_id", "block", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    ahead = ahead.mapInArrow(_costs_after, "conv_id bigint, block bigint, ahead array<bigint>")
    ahead = ahead.select(F.col("conv_id").alias("a_id"), F.col("block").alias("a_block"), "ahead")
    joined = blocks.join(ahead, F.col("conv_id").eqNullSafe(F.col("a_id")) & (F.col("block") == F.col("a_block"))).drop("a_id", "a_block")
    left = [f for f in _BLOCK.split(", ") if f.split()[0] not in ("symbols", "lengths", "matrix")]
    heads = joined.mapInArrow(_choices, ", ".join([*left, "audits array<string>", "exits array<int>", "cost bigint"]))
    heads = heads.select(F.lit(True).alias("head"), *heads.columns)
    body = rows.where("copies > 0").select(
        F.lit(False).alias("head"), "conv_id", F.shiftright("pos", block_bits).alias("block"), "pos", "turn", "role", "text", "copies"
    )
    both = heads.unionByName(body, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "block", F.desc("head"), "pos")
    return both.mapInArrow(_apply(want_turns), TURNS if want_turns else REPORT)


def repair_report(conversations: DataFrame, copies: str | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per conv_id of ``conversations(conv_id, turn, role, text)``: gaps in its turn
    numbers, faults, illegal neighbours, cost and letters of the cheapest repair, and the
    digest of the repaired ``role:text`` lines. ``copies`` names a column with the number
    of times a row stands there (0: it only names its conversation)."""
    return _repair(conversations, copies, block_bits, want_turns=False)


def repaired_turns(conversations: DataFrame, copies: str | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit K/R/I, turn, role, text)."""
    return _repair(conversations, copies, block_bits, want_turns=True)
