import random
import re

import numpy as np
import pytest
from llm_data import SF_SMALL, documents

from paneltide.llm import jaccard_join as J


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)))) for i, r in enumerate(rows))


def ours(docs, width, percent, **kw):
    got = J.jaccard_components(docs, width, percent, **kw).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


def near_copies(seed=5, groups=6, size=25):
    rnd, rows = random.Random(seed), []
    vocab = [f"w{i}" for i in range(400)]
    for g in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([12, 40, 160, 400]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randrange(0, 1 + len(words) // 40)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
    return rows


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "x " * 30000), (8, "X " * 29999), (4, "One two"), (None, "one two"), (9, "one two three"), (10, "ÉÉ one two"), (11, "éé one two")]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_equals_brute_force(spark, width, percent):
    rows = near_copies() + EDGE
    assert ours(documents(spark, rows), width, percent) == brute(rows, width, percent)


def test_large_regions(spark):
    rows = near_copies(seed=9, groups=2, size=60)
    assert ours(documents(spark, rows), 3, 90, region_shingles=400) == brute(rows, 3, 90)


def sliding(seed=4, n=260):
    """Windows of one long text, shifted by 2 to 9 words: near neighbours link up to a shift
    of 5, far ones share nothing, so pivots cut the region smaller level by level."""
    rnd, at, rows = random.Random(seed), 0, []
    for i in range(n):
        rows.append((i * 7 % 1009, " ".join(f"t{k}" for k in range(at, at + 102))))
        at += rnd.randrange(2, 10)
    return rows


@pytest.mark.parametrize("limit,shrink", [(2500, 0.75), (2500, 0.0)])
def test_cells_too_large_are_split_again(spark, monkeypatch, limit, shrink):
    """With a shrink of 0 nothing is split again and the cells are cut by a hash."""
    levels, write = [], J.materialise

    def counted(df, name="table"):
        levels.append(name)
        return write(df, name)

    monkeypatch.setattr(J, "materialise", counted)
    monkeypatch.setattr(J, "SHRINK", shrink)
    rows = sliding()
    assert ours(documents(spark, rows), 3, 90, region_shingles=limit, small_region=2) == brute(rows, 3, 90)
    assert (levels.count("jj-large") > 1) == (shrink > 0)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ours(docs, 3, 90) == brute(rows, 3, 90)


def test_keep_one_and_empty(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand in this text"), (None, "a b c d e f"), (4, None), (3, "other words stand in this text")])
    kept = J.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    empty = J.jaccard_components(docs.limit(0)).collect()
    assert empty == []


def test_common_shingles_do_not_merge_unlike_texts(spark, monkeypatch):
    """150 unlike texts share a passage, in a table whose sketch can't tell its shingles from
    rare ones: no text may reach a region, but for the planted near copy."""
    monkeypatch.setattr(J, "_rarity", lambda summary: np.zeros(1 << J.SKETCH_BITS, np.uint8))
    sizes, write = {}, J.materialise

    def counted(df, name="table"):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(J, "materialise", counted)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(120)) + " " + passage) for i in range(150)]
    rows.append((150, rows[7][1] + " end"))
    assert ours(documents(spark, rows), 5, 80) == brute(rows, 5, 80)
    assert sizes["jj-wanted"] == 2


def test_texts_that_share_one_phrase_are_not_compared(spark, monkeypatch):
    """Every two of 12 texts have a rare phrase of their own in common."""
    sizes, write = {}, J.materialise

    def kept(df, name="table"):
        out = write(df, name)
        sizes[name] = out
        return out

    monkeypatch.setattr(J, "materialise", kept)
    rows = []
    for i in range(12):
        phrases = [f"f{min(i, j)}x{max(i, j)} " * 3 for j in range(12) if j != i]
        rows.append((i, " ".join(f"{p} {' '.join(f'o{i}x{j}x{k}' for k in range(6))}" for j, p in enumerate(phrases))))
    assert ours(documents(spark, rows), 3, 90) == brute(rows, 3, 90)
    often = sizes["jj-met"].where("not chain").groupBy("src", "dst").agg({"times": "sum", "need": "max"})
    assert often.where("`sum(times)` >= `max(need)`").count() == 0
