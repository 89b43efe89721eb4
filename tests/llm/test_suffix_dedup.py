import random

import numpy as np
import pytest
from llm_data import SF_SMALL, documents

from paneltide.llm import suffix_dedup as S
from paneltide.llm.suffix_groups import suffix_arrays


def brute(rows, length):
    """{doc_id: (n_bytes, spans, kept)} over rows with distinct ids, null last."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out[doc] = (len(b), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def ours(docs, **kw):
    return {r.doc_id: (r.n_bytes, [(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in S.remove_repeats(docs, **kw).collect()}


def planted(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ß") for _ in range(rnd.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (12, 25, 60, 200)]
    rows = [(i, text(rnd.randrange(5, 60)) + rnd.choice(passages) + text(rnd.randrange(0, 40)) + rnd.choice(passages)[rnd.randrange(30) :]) for i in range(60)]
    rows += [(100, "a" * 700), (101, "ab" * 400), (102, "a" * 99), (103, None), (104, ""), (105, rows[3][1]), (106, "x" + rows[3][1] + "y"), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("kw", [{}, {"hot": 3}, {"hot": 1}])
def test_equals_brute_force(spark, kw):
    rows = planted()
    assert ours(documents(spark, rows), **kw) == brute(rows, 100)


def test_other_lengths(spark):
    rows = planted(2)
    assert ours(documents(spark, rows), length=40, k=12) == brute(rows, 40)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert ours(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 100)


def test_repeated_rows_and_empty_table(spark):
    t = "the same long line of text stands here more than once in the table, and it is longer than a hundred bytes."
    got = S.remove_repeats(documents(spark, [(1, t), (1, t), (2, t)])).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in got) == [(1, len(t)), (1, len(t)), (2, 0)]
    assert S.remove_repeats(documents(spark, [(1, t)]).limit(0)).collect() == []


def test_suffix_arrays_of_many_strings():
    rng = np.random.default_rng(3)
    for _ in range(100):
        strings = [np.append(rng.integers(1, rng.choice([2, 3, 5, 30]) + 1, rng.integers(0, 40)), 0) for _ in range(rng.integers(1, 8))]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        got = suffix_arrays(np.concatenate(strings), bounds)
        for k, s in enumerate(strings):
            want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
            assert (got[bounds[k] : bounds[k + 1]] - bounds[k]).tolist() == want


def test_cut_of_large_groups(spark, monkeypatch):
    """Hundreds of contexts around one common line (more than one suffix array holds)."""
    rnd = random.Random(4)
    line = "one very common line that stands in the middle of hundreds of otherwise quite different texts, word by word; " * 2
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(50, 200))) + line + "".join(rnd.choice("abcdefgh ") for _ in range(80))) for i in range(150)]
    assert ours(documents(spark, rows)) == brute(rows, 100)
