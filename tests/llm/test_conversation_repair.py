"""Conversation repair against a search over all edits, with tiny blocks as well."""

import hashlib
import heapq
import random
import zlib

import pytest

from paneltide.llm import conversation_repair as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, cost string"
WS = " \t\n\v\f\r"


def damaged(rows):
    """{conv_id: rows after damage in order}"""
    out = {}
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text, *_ in rows:
        mine = out.setdefault(conv, [])
        by = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if by == 0:
            continue
        if by == 1:
            text = ""
        if by == 2:
            text = "".join(c for c in text if c not in ".!?")
        if by == 4:
            role = "user"
        digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
        mine += [((turn is not None, turn), role.encode(), digest, turn, role, text)] * (2 if by == 3 else 1)
    return {c: [r[3:] for r in sorted(v, key=lambda r: ((r[0][0], r[0][1] or 0), r[1], r[2]))] for c, v in out.items()}


def cheapest(rows):
    """Dijkstra over (row, output initials) by (cost, letters): faults, cost, audit, output."""
    faults, seen = [], set()
    for _, role, text in rows:
        visible = text.strip(WS)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    rank = {"u": "a", "a": "u", "s": "u", "": "u"}
    heap, closed = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and (last == "a" or not out):
            return faults, cost, audit, out
        # what comes next depends only on the row and the last initial of the output
        if (i, last) in closed:
            continue
        closed.add((i, last))
        need = rank[last]
        full = {"u": "user", "a": "assistant"}[need]
        heapq.heappush(heap, (cost + 2, audit + "I", i, need, (*out, f"{full}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, need, (*out, f"{full}:{text}")))
                if role[:1] == need or (role[:1] == "s" and not out):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))


def brute(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        faults, cost, audit, done = cheapest(mine)
        turns = {t for t, _, _ in mine if t is not None}
        initials = [r[:1] for _, r, _ in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(done).encode()).hexdigest(),
        )
    return out


def random_rows(seed, n_conv, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n_conv)]:
        turn = rng.randrange(3)
        for _ in range(rng.randrange(longest + 1)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "unknown"])
            text = rng.choice(["Hello.", "Well!", "cut off", "Why? ", "a\tb", "", " \n", None, f"Line {rng.randrange(50)}.", "é."])
            rows.append((conv, rng.choice([turn] * 20 + [None]), role, text, 1, "x"))
            turn += rng.choice([1, 1, 1, 1, 0, 2, 5])
    return rows


def report(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("bits,longest", [(12, 9), (2, 40)])
def test_repair_equals_search(spark, bits, longest):
    rows = random_rows(bits, 150, longest)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert report(C.repair_report(C.damage(df), "copies", block_bits=bits)) == brute(rows)


def test_powers_and_cached_unrolling_equal_row_by_row():
    rng = random.Random(3)
    for _ in range(200):
        runs = [(rng.randrange(9), rng.choice([1, 1, 2, 3, 7, 64, 100])) for _ in range(rng.randrange(1, 7))]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        m = one = C.IDENTITY
        for s, n in runs:
            m = C.times(m, C.run_matrix(s, n))
        for s, n in single:
            one = C.times(one, C.binary_power(s, 0))
        assert m == one
        assert C.unroll_block(runs, C._END) == C.unroll_block(single, C._END)


def test_long_conversation_is_spread_and_exact(spark):
    rows = [(7, i, ["user", "assistant", "assistant"][i % 3], f"T{i % 900}." if i % 5 else "cut", 1, "x") for i in range(3000)]
    rows += [(8, None, "user", "same row", 1, "x")] * 3000
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert report(C.repair_report(C.damage(df), "copies", block_bits=6)) == brute(rows)


def test_repaired_turns_follow_the_pattern(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Go on"), (1, 2, "user", "Go on"), (2, 5, "system", "Be kind."), (3, 0, "user", " "), (4, 0, "system", "A."), (4, 1, "user", "B."), (4, 2, "assistant", "x" * 300_000 + ".")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got = {}
    for r in C.repaired_turns(df).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.edit, r.turn, r.role, r.text[:5]))
    # conversation 1: insert + keep + delete both costs 8, other ways more or the same
    faults, cost, audit, out = cheapest([r[1:] for r in rows if r[0] == 1])
    assert [f"{role}:{text}" for _, _, role, text in got[1]] == list(out)
    assert 2 not in got and 3 not in got  # deleting the only row is cheapest
    assert [e for e, *_ in got[4]] == ["K", "K", "K"]
    again = report(C.repair_report(df))
    assert again[1][5:7] == (cost, audit) and again[2][6] == "D" and again[3][1] == 1


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(C.damage(df), "copies").collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}: ".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, None, None, None, 1, "x")], SCHEMA)
    assert report(C.repair_report(C.damage(df), "copies")) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_on_the_given_table(spark):
    from llm_data import SF_SMALL
    from paneltide.llm import queries as Q

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(Q.op11(spark, SF_SMALL)) == brute(rows)
