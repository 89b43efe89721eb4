"""Language ID, line templates, unit dedup, decontamination and BPE on small tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_data import SF_SMALL, documents
from pyspark.sql import functions as F

from paneltide.llm import byte_bpe, decontaminate, language_id, line_templates, substring_dedup
from paneltide.llm import queries as Q

# ---------------------------------------------------------------- language ID


def brute_counts(rows):
    counts = {}
    for text, lang in rows:
        low = re.sub(r"\n", " ", (text or "").lower())
        import unicodedata

        c = "".join(x if unicodedata.category(x)[0] in "LM" else " " for x in low)
        c = " " + re.sub(" +", " ", c).strip(" ") + " "
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                if c[i] != " " or c[i + n - 1] != " ":
                    counts.setdefault(lang, {}).setdefault(c[i : i + n], 0)
                    counts[lang][c[i : i + n]] += 1
    return counts


def test_ngrams_count_every_gram_of_the_padded_text():
    text = "Ab, ba\tÉ1x"
    row, bucket, has = language_id.ngrams([text, None, "12 3"], 20)
    want = brute_counts([(text, "x")])["x"]
    got = np.bincount(bucket[row == 0], minlength=1 << 20)
    assert sorted(got[got > 0].tolist()) == sorted(want.values())
    assert has.tolist() == [True, False, False]
    assert not (row > 0).any()


def test_language_id_edges_and_extra_columns(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 4)]
    docs = documents(spark, [*rows, (90, None, "en"), (91, "", None), (92, "12 34 !!", "de"), (None, "the dog", None), (93, "the cat " * 50000, None)])
    model = language_id.fit(docs, F.lit(True))
    assert model.langs == ["de", "en", "fr"]
    out = language_id.predict(docs, model, "p", "s")
    assert out.columns == [*docs.columns, "p", "s"]
    got = {r.doc_id: (r.p, r.s) for r in out.collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0)
    assert got[None][0] == got[93][0] == "en" and 0 < got[None][1] <= 1
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {90, 91, 92}
    none = language_id.fit(docs.limit(0), F.lit(True))
    assert {r.p for r in language_id.predict(docs, none, "p", "s").collect()} == {"und"}


def test_held_out_accuracy(spark):
    out = Q.op6(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() > 0


# ------------------------------------------------------------- line templates


def test_templates_generalise_fields_and_keep_the_first(spark):
    body = lambda i: f"document number {chr(97 + i)} has words of its own {chr(97 + i) * 5} here"
    rows = [(i, f"{body(i)}\nposted on {i} May by user{i} in the news section today\n\nOf.") for i in range(12)]
    rows += [(50 + i, f"please read our terms of use {w} before you go on with this") for i, w in enumerate("a b c d e f g h i j k".split())]
    rows += [(80, None), (81, ""), (82, "x " * 20000)]
    docs = documents(spark, rows)
    found = line_templates.recurring_lines(docs)
    out = {r.doc_id: r for r in line_templates.drop_templates(docs, found, "lines", "gone").collect()}
    assert out[0].text == rows[0][1] and out[0].gone == 0
    for i in range(1, 12):
        assert "posted on" not in out[i].text and out[i].gone == 1 and "Of." in out[i].text and body(i) in out[i].text
    assert out[50].gone == 0 and all(out[50 + i].gone == 1 and out[50 + i].text == "" for i in range(1, 11))
    assert out[80].text is None and out[81].text == "" and out[82].text == rows[-1][1]
    assert line_templates.drop_templates(docs, found).columns == docs.columns
    assert line_templates.recurring_lines(docs.limit(0)).collect() == []


def test_a_leaf_keeps_all_its_templates(spark):
    # (fields of its own at 5 and 11) of the 20 tokens of a log line
    log = lambda name, i: f"2024-01-{i} 10:00:{i} INFO worker " + " ".join(f"{name}{chr(97 + i // 26)}{chr(97 + i % 26)}" if k in (5, 11) else f"{name}-{chr(97 + k)}" for k in range(4, 20))
    for counts in ({"big": 60, "small": 40}, {"one": 20, "two": 20, "six": 20, "ten": 20, "few": 9}):
        names = [(n, i) for n, c in counts.items() for i in range(c)]
        # the votes of equal templates are mixed: each wins some positions
        rows = [(d, log(n, i)) for d, (n, i) in enumerate(names)]
        mixed = {w: "acbd"[(k + j) % 4] for j, n in enumerate(counts) for k in range(4, 20) for w in [f"{n}-{chr(97 + k)}"]}
        rows = [(d, " ".join(mixed[w] + w if w in mixed else w for w in t.split(" "))) for d, t in rows]
        docs = documents(spark, rows)
        gone = {r.doc_id for r in line_templates.recurring_lines(docs).collect()}
        firsts = {names.index((n, 0)) for n in counts}
        few = {d for d, (n, _) in enumerate(names) if n == "few"}
        assert gone == set(range(len(rows))) - firsts - few


def test_long_lines_go_from_their_second_document_on(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, short, own = words(60), words(49), [words(80) for _ in range(9)]
    rows = [
        (1, f"{own[0]}\n{passage}\n{passage}"), (2, f"{own[1]}\n{passage}"), (3, f"{passage}\n{own[2]}\n{short}"), (4, f"{own[3]}\n{short}"),
        (5, f"{passage}\n{own[4]}\nand {passage}"),  # one of them stands in a longer line of its own
        (6, passage), (7, f"{own[0]}\n{passage}\nend"),  # copies as a whole
        (8, f"{own[5]}\n{passage} 17"), (9, f"{own[6]}\n{passage} 3x"),  # fields may differ
    ]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.idx) for r in line_templates.recurring_lines(docs).collect()}
    assert got == {(2, 1), (3, 0), (5, 0), (9, 1)}
    assert {(r.doc_id, r.idx) for r in line_templates.recurring_lines(docs, copy_percent=101).collect()} == got | {(6, 0), (7, 0), (7, 1)}


def test_short_lines_recur_but_numbers_do_not(spark):
    rows = [(i, f"words of document {chr(97 + i)} {i * 'x'} alone\nRead more\n{i}\nHaanth.\npage {i}") for i in range(12)]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.idx) for r in line_templates.recurring_lines(docs, min_tokens=1).collect()}
    assert got == {(i, k) for i in range(1, 12) for k in (1, 3, 4)}


def test_templates_with_null_ids_and_repeated_rows(spark):
    line = "this very same line stands in all of the documents"
    rows = [(i, line) for i in range(10)] + [(0, line), (None, line), (None, line)]
    docs = documents(spark, rows)
    out = line_templates.drop_templates(docs, line_templates.recurring_lines(docs)).collect()
    assert sorted((str(r.doc_id), r.text != "") for r in out)[:3] == [("0", True), ("0", True), ("1", False)]
    assert sum(r.text != "" for r in out) == 2


# ----------------------------------------------------------------- unit dedup


def test_units_keep_the_earliest(spark):
    long = "a line of six words or more"
    rows = [(3, f"{long}\nshort one\nown text of the third document here"), (1, f"x\n{long.upper()}  \n{long}"), (2, None), (4, ""), (None, long), (5, long)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in substring_dedup.dedup_units(docs, kinds=("line",)).collect()}
    assert got[1].text == f"x\n{long.upper()}  \n" and [(s.start, s.stop) for s in got[1].removed] == [(32, 59)]
    assert got[3].text == "short one\nown text of the third document here"
    assert got[2].text is None and got[4].text == "" and got[5].text == "" and got[None].text == ""
    assert got[4].n_units == 1 and got[2].n_units == 0
    para = substring_dedup.dedup_units(documents(spark, [(1, f"{long}\n{long}\n\nb"), (2, f"c\n \n{long}\n{long}")]), kinds=("paragraph",))
    assert {r.doc_id: r.text for r in para.collect()} == {1: f"{long}\n{long}\n\nb", 2: "c\n \n"}
    assert substring_dedup.dedup_units(docs.limit(0)).collect() == []


def test_a_passage_inside_longer_lines_goes(spark):
    passage = "the first of the repeated sentences here. and the second one of them follows. a short one. and this is the last sentence of it."
    rows = [(1, f"own words at the start of one {passage} more words of the first"), (2, f"x y z. {passage} other words of the second\nkept."), (3, f"{passage}\nend")]
    got = {r.doc_id: r for r in substring_dedup.dedup_units(documents(spark, rows)).collect()}
    assert got[1].text == rows[0][1]
    assert got[2].text == "x y z. the first of the repeated sentences here. a short one. other words of the second\nkept."
    assert got[3].text == "a short one. end" and got[3].n_units == 5 and got[3].n_removed == 3
    for d, t in rows:  # the spans give back the kept text
        spans, at, out = got[d].removed, 0, ""
        for s in spans:
            out, at = out + t[at : s.start], s.stop
        assert out + t[at:] == got[d].text


# -------------------------------------------------------------- decontamination


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(rnd.choice([5, 9, 14, 25, 40, 80, 300])))) for i in range(40)] + [(90, None), (91, ""), (92, "four words only here")]
    rows = []
    for d in range(200):
        w = words(rnd.randrange(0, 300))
        if d % 3 == 0:
            item = rnd.choice(items[:40])[1].split()
            if d % 2:
                item[rnd.randrange(len(item))] = rnd.choice(vocab)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," if rnd.random() < 0.2 else x for x in item]
        rows.append((d, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "four words only here"), (None, items[20][1]), (303, " ".join(words(30000)) + " " + items[21][1])]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminations(docs, bench).collect()

    norm = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())

    def bag(w):
        out = {}
        for i in range(len(w) - 4):
            k = tuple(w[i : i + 5])
            out[k] = out.get(k, 0) + 1
        return out

    def similarity(a, b):
        weight = lambda k: sum(map(len, k))
        low = sum(min(n, b.get(k, 0)) * weight(k) for k, n in a.items())
        high = sum(n * weight(k) for k, n in a.items()) + sum(n * weight(k) for k, n in b.items()) - low
        return low / high if high else 0

    want = {}
    for d, t in rows:
        w = norm(t)
        places = {}
        for i in range(len(w) - 4):
            places.setdefault(tuple(w[i : i + 5]), []).append(i)
        for k, it in items:
            iw = norm(it)
            own, best = bag(iw), 0
            starts = {p - o for o in range(len(iw) - 4) for p in places.get(tuple(iw[o : o + 5]), ())}
            for s in {s + d for s in starts for d in range(-8, 9)}:
                best = max(best, similarity(own, bag(w[max(s, 0) : max(s, 0) + len(iw) - max(0, -s)])))
            if best >= 0.8:
                want[d, k] = best
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    # brute force tries every alignment, the operator those that a window names
    assert [(r, want[r.doc_id, r.item_id]) for r in got if not 0.8 <= r.similarity <= want[r.doc_id, r.item_id] + 1e-9] == []
    clean = decontaminate.decontaminate(docs, bench)
    bad = {d for d, _ in want}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - bad
    assert decontaminate.contaminations(docs.limit(0), bench).collect() == []
    assert decontaminate.contaminations(docs, bench.limit(0)).collect() == []


def test_hamming_blocks_find_every_print_within_the_radius():
    rng = np.random.default_rng(0)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40))
    index = decontaminate.ItemIndex([(1, text)])
    ((_, (_, _, prints, blocks)),) = index.tables.items()
    for fp in prints.tolist():
        for _ in range(50):
            bits = rng.choice(64, decontaminate.RADIUS, replace=False)
            near = fp
            for b in bits.tolist():
                near ^= 1 << b
            hit = set()
            for b, (ptr, who) in enumerate(blocks):
                v = (near >> (16 * b)) & 0xFFFF
                hit |= {int(prints[k]) for k in who[ptr[v] : ptr[v + 1]]}
            assert fp in hit


# -------------------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_the_library(spark, ranks, monkeypatch):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world's 123\n\n x", "", None, "日本語 и русский   é", "<|endoftext|>", "a" * 5000, "word " * 40000, "\x1c\x85​ \t", "Hello  world's 123\n\n x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (0, texts[0])]
    rows += [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = byte_bpe.encode(documents(spark, rows), ranks, public_tokenizers.PATTERN).collect()
    want = sorted((str(d), np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for d, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert byte_bpe.encode(documents(spark, rows).limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def test_merge_equals_the_rule_and_the_library(ranks):
    import random

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)

    def by_rule(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while word not in ranks:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[word]] if word in ranks else [ranks[p] for p in parts]

    words = [bytes(rnd.choice(b"abeinorst \xc3\xa9\xe6\x97") for _ in range(rnd.randrange(1, 30))) for _ in range(3000)]
    words += [b"a" * n for n in range(1, 70)] + [b"ab" * 40, "éé".encode() * 30, bytes(range(256))]
    for w in words:
        assert byte_bpe.merge_word(w, ranks) == by_rule(w) == enc._core_bpe.encode_single_piece(w)
    long = bytes(rnd.choice(b"abcdefgh") for _ in range(200_000))
    assert byte_bpe.merge_word(long, ranks) == enc._core_bpe.encode_single_piece(long)


def test_many_small_blocks_give_the_same(ranks, monkeypatch):
    """Blocks cut by size and by distinct words hold every text once."""
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 5)
    monkeypatch.setattr(byte_bpe, "PIECE_BYTES", 40)
    texts = [f"some words {i} and more {i * i}" for i in range(30)]
    batch = pa.record_batch([pa.array(range(30), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    passes = [b for want in ("words", "texts") for b in byte_bpe._blocks(public_tokenizers.PATTERN, 3, want)(iter([batch]))]
    rows = pa.Table.from_batches(passes).to_pylist()
    words = {}
    for r in rows:
        if r["part"] is not None:
            for k, w in zip(byte_bpe._unpack(r["locals"]).tolist(), byte_bpe._unpack_words(r["words"])):
                words[r["block"], k] = w
    back = {}
    for r in rows:
        if r["docs"] is not None:
            import struct

            at, pos = 0, byte_bpe._unpack(r["positions"]).tolist()
            for _, doc, n in struct.iter_unpack("<?qI", r["docs"]):
                back[doc] = b"".join(words[r["block"], k] for k in pos[at : at + n]).decode()
                at += n
    assert [back[i] for i in range(30)] == texts


def test_texts_leave_a_block_in_small_batches(ranks, monkeypatch):
    import struct
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "OUT_BYTES", 60)
    docs, none = 9, pa.nulls(1, pa.binary())
    words = pa.record_batch(
        [pa.array([byte_bpe._pack(np.array([1, 0]))]), pa.array([byte_bpe._pack(np.array([1, 2]))]), pa.array([byte_bpe._pack(np.array([5, 6, 7]))]), none, none],
        names=["locals", "sizes", "ids", "docs", "positions"],
    )
    packed = [b"".join(struct.pack("<?qI", True, i, 3) for i in range(docs)), byte_bpe._pack(np.array([0, 1, 0] * docs))]
    texts = pa.record_batch([none, none, none, pa.array(packed[:1]), pa.array(packed[1:])], names=words.schema.names)
    table = SimpleNamespace(value=(np.frombuffer(b"abcdefgh", dtype=np.uint8), np.ones(8, dtype=np.int64)))
    got = list(byte_bpe._assemble(table)(iter([texts, words])))
    assert [b.num_rows for b in got] == [3, 3, 3, 0]
    rows = [r for b in got for r in b.to_pylist()]
    assert rows == [{"doc_id": i, "n_tokens": 5, "ids": np.array([6, 7, 5, 6, 7], dtype="<u4").tobytes(), "decoded": b"ghfgh"} for i in range(docs)]


def test_query_digests(spark, ranks):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in Q.op2(spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = np.array(enc.encode_ordinary(r.text or ""), dtype="<u4")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
