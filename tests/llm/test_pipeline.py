"""The pipeline on planted documents, compared with brute force over the same texts."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from paneltide.llm import byte_bpe

WORDS = {
    "en": "the of and to in is that it for was on are with as his they at be this from have or by one had not but what all were".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
}


def corpus():
    rnd = random.Random(11)
    own = {k: [f"{rnd.choice(v)}{rnd.choice('abcdeflmnrst')}{rnd.choice(v)}" for _ in range(600)] for k, v in WORDS.items()}
    text = lambda lang, n: " ".join(rnd.choice(WORDS[lang] + own[lang]) for _ in range(n))
    rows, items = [], [(k, text("en", 30)) for k in range(3)] + [(9, None)]
    for d in range(60):
        lang = "de" if d % 4 == 0 else "en"
        rows.append([d, "\n".join(text(lang, 25) for _ in range(4)), lang, "s", 0])
    for d in range(20, 35):  # a line with a changing number in 15 documents
        rows[d][1] += f"\nread {d * 7} more stories of this kind on our page today"
    copies = [[100 + i, rows[3][1] + f" end{i}", "en", "s", 0] for i in range(5)]  # near copies of document 3
    leaks = [[200 + i, text("en", 40) + " " + items[i][1] + " " + text("en", 10), "en", "s", 0] for i in range(3)]
    odd = [[300, None, "en", None, None], [301, "", None, "s", 0], [302, "12 34 +-", "en", "s", 8], [303, rows[5][1], "en", "s", 0], [5, rows[5][1], "en", "s", 0]]
    return rows + copies + leaks + odd, items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, items = corpus()
    base = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score int").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    left = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
        assert docs.columns == list(spark.read.parquet(f"{sf_dir}/documents.parquet").columns), name
        left.append({r.doc_id: r for r in docs.collect()})
    lang, lines, near, clean = left[1:]
    assert set(rows) - set(lang) == {300, 301, 302}
    marked = [d for d in range(20, 35) if "stories of this kind" in lines[d].text]
    assert marked == [20] and lines[21].n_chars == len(lines[21].text) and all(lines[d].text == rows[d].text for d in range(20))
    assert set(lines) - set(near) == {100, 101, 102, 103, 104, 303}
    assert set(near) - set(clean) == {200, 201, 202}
    # what is left is tokenised as the library does
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {r.doc_id: r for r in P.run(spark, sf_dir).collect()}
    assert set(out) == set(clean)
    for d, r in clean.items():
        ids = np.array(enc.encode_ordinary(r.text), dtype="<u4")
        assert out[d].n_tokens == len(ids)
        import hashlib

        assert out[d].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert out[d].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "byte_bpe"]
