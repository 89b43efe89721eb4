"""The filter audit against a brute force that applies every order of filters row by row."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.llm import filter_audit

SCHEMA = "doc_id bigint, text string, source string, n_words string, block int"


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    texts = [(d, t or "", s or "") for d, t, s, *_ in rows]
    fails = []
    for d, t, _ in texts:
        words = t.encode().split()
        fails.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(o is not None and o < d and u == t for o, u, _ in texts),
        })
    out = {}
    for part in {s for _, _, s in texts}:
        mine = [(texts[i][0], fails[i]) for i in range(len(texts)) if texts[i][2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for f in order:
                shapley[f] += sum(x[f] for _, x in left)
                left = [m for m in left if not m[1][f]]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(x[f] for _, x in mine) - len(gone), sum(x[f] and sum(x.values()) == 1 for _, x in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), shapley[f],
                )
    return out


def distinct(n, tag="w"):
    return " ".join(f"{tag}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))


ROWS = [
    (1, distinct(250), "a", "x", 1),
    (2, distinct(250), "a", "x", 1),  # copy
    (2, distinct(250), "b", "x", 1),  # repeated id
    (3, distinct(199), "a", "x", 1),  # one word too few
    (4, distinct(200), "b", "x", 1),
    (5, "same words again " * 100, "a", "x", 1),  # few distinct words
    (6, " ".join([distinct(150), distinct(150)]), "a", "x", 1),  # exactly half
    (7, "LOUD " * 300, None, "x", 1),
    (8, distinct(250, "s") + " 5$", "", "x", 1),
    (9, None, "b", "x", 1),
    (10, "", "b", "x", 1),
    (None, distinct(250), "a", "x", 1),
    (11, "é è " + distinct(250, "ü") + "\x0b\x0c\r\n\tend x", "a", "x", 1),
    (12, distinct(600, "long") + " " + distinct(600, "long"), "c", "x", 1),
    (13, "Ab" * 50 + " " + distinct(220), "a", "x", 1),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 0, 1), (7, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("block_chars", [1, 3000, filter_audit.BLOCK_CHARS])
def test_audit_equals_brute_force(tables, block_chars):
    docs, labels = tables
    flags = filter_audit.failures(filter_audit.csr_shards(docs, block_chars=block_chars))
    got = {(r.part, r.filter_order, r.step): tuple(r[m] for m in filter_audit.MEASURES) for r in filter_audit.audit(flags, labels).collect()}
    assert got == brute(ROWS, LABELS)


def test_shards_hold_one_global_matrix(tables):
    docs, _ = tables
    got = {}
    for r in filter_audit.csr_shards(docs, block_chars=3000).collect():
        indptr, counts, indices = (filter_audit.unpack(c) for c in (r.indptr, r.counts, r.indices))
        for k, row in enumerate(r.rows):
            at = slice(indptr[k], indptr[k + 1])
            got.setdefault((row.doc_id, row.part), []).append(sorted(zip(indices[at].tolist(), counts[at].tolist())))
    # the same words have the same ids in every block, other words have others
    assert got[1, "a"] == got[2, "a"] == got[2, "b"]
    ids = {i for rows in got.values() for row in rows for i, _ in row}
    words = {w for _, t, *_ in ROWS for w in (t or "").encode().split()}
    assert len(ids) == len(words)
    assert got[9, "b"] == got[10, "b"] == [[]]
    assert sum(c for _, c in got[12, "c"][0]) == 1200 and {c for _, c in got[12, "c"][0]} == {2}


def test_packed_numbers_keep_their_values():
    for top in (0, 255, 256, 65536, 1 << 33):
        assert filter_audit.unpack(filter_audit._pack(np.array([0, top]))).tolist() == [0, top]
    assert filter_audit.unpack(filter_audit._pack(np.zeros(0, np.int64))).tolist() == []


def test_empty_table(spark, tables):
    docs, labels = tables
    flags = filter_audit.failures(filter_audit.csr_shards(docs.where(F.lit(False))))
    assert filter_audit.audit(flags, labels).collect() == []
    flags = filter_audit.failures(filter_audit.csr_shards(docs))
    out = filter_audit.audit(flags, labels.limit(0))
    assert out.where("good_lost > 0 or toxic_lost > 0").count() == 0 and out.count() == 600 * 4
