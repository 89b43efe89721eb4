"""Quality rules: base counts by a plain count, distances by hand, verdicts on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from llm_data import SF_SMALL, documents
from pyspark.sql import functions as F

from paneltide.llm import quality_rules as Q
from paneltide.llm import queries


def plain_counts(text):
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("seed", range(30))
def test_base_counts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", "é", " ", " ", " ", "\x1c", "\n", "\t", "#", "<", " a b c ", "\nline\n", "\x0b"]) for _ in range(rng.randrange(200)))
    assert Q.base_counts(text) == plain_counts(text)


def test_repeats_overlap_and_short_texts():
    assert Q.base_counts("a a a a")[4] == 4
    assert Q.base_counts("a b c x a b c")[4] == 6
    assert Q.base_counts("a b c")[4] == Q.base_counts("")[4] == 0
    assert Q.base_counts("\n x \n x\n x \n\n")[3] == 1


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.5, 0.25, 0.25])
    m = (p[0] + q) / 2
    half = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    assert Q.js_distance(p, q)[0] == pytest.approx(math.sqrt((half(p[0]) + half(q)) / 2))
    assert Q.js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == 1
    assert Q.js_distance(np.array([[0.0, 0.0]]), np.array([0.5, 0.5]))[0] == 0


def prose(rng, common, n):
    rare = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    return " ".join(rng.choice(common) if rng.random() < 0.5 else rare[i] for i in range(n)) + "."


EN, DE = ["the", "of", "and", "to", "in"], ["der", "die", "und", "zu", "im"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, EN, 300), "en") for i in range(30)] + [(30 + i, prose(rng, DE, 300), "de") for i in range(30)]
    rows += [
        (100, prose(rng, EN, 300).upper(), "en"), (101, " | ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300)), "en"), (102, prose(rng, DE, 300), "en"),
        (103, prose(rng, DE, 300), None), (104, prose(rng, EN, 300), "xx"), (105, prose(rng, EN, 49), "en"), (106, None, "en"), (107, "", None),
        (108, "word " * 300, "en"), (None, prose(rng, EN, 300), "en"), (109, prose(rng, EN, 60), "en"), (110, prose(rng, EN, 30_000), "en"), (111, "的 " * 3 + "字" * 300_000, "zz"),
    ]
    return documents(spark, rows)


def test_verdicts(corpus):
    ref = Q.fit(corpus, top_words=20)
    assert ref.langs == ["de", "en", "xx"] and set(EN) <= set(ref.words[1]) and np.allclose(ref.shares.sum(axis=1), 1)
    got = {r.doc_id: r for r in Q.judge(corpus, ref).collect()}
    assert len(got) == corpus.count()
    assert all(got[i].kept for i in [*range(60), None, 103, 104, 109, 110])
    for bad in (100, 101, 102):  # capitals; bars and no common word; another language
        assert not got[bad].kept and not got[bad].base_failed
    for failed in (105, 106, 107, 108, 111):
        assert got[failed].base_failed and not got[failed].kept
    assert got[109].word_distance is None and got[106].char_distance is None
    assert got[106].n_words == got[107].n_words == 0


def test_no_reference_and_empty(corpus, spark):
    none = Q.fit(corpus.where(F.lit(False)))
    got = {r.doc_id: r for r in Q.judge(corpus, none).collect()}
    assert none.langs == [] and got[100].kept and not got[105].kept
    assert Q.judge(corpus.where(F.lit(False)), none).collect() == []


def test_reference_counts_do_not_depend_on_the_table_size(corpus, monkeypatch):
    whole = Q.fit(corpus)
    monkeypatch.setattr(Q, "_TABLE_WORDS", 5)
    small = Q.fit(corpus.repartition(7))
    assert whole.words == small.words and np.array_equal(whole.shares, small.shares) and np.array_equal(whole.classes, small.classes)


def test_query_columns_and_base_counts(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op13(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
