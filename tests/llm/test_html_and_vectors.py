import html
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_data import SF_SMALL
from pyspark.sql import functions as F

from paneltide.llm import embedding_dedup, html_text
from paneltide.llm import queries as Q

# ------------------------------------------------------------------------ HTML


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, host int").repartition(2)


def run(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}


def test_roles_markup_and_references(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';if(a<b){}</script></head><body class='page home'>"
        "<header>Site</header><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><!-- c <p>no</p> -->"
        "<article class=post><header><h1>A &amp; B</h1></header><p>One <b>two</b>\n\t three&nbsp;four<p>5 &lt; 6 <span class='ad'>buy</span>and on"
        "<ul><li>x<li>y</ul><blockquote>q<br>r</blockquote><aside>side</aside><form><p>send</p></form><pre>a  b</pre></i></article>"
        "<section id='comments'><p>Reader says</p></section><footer>&copy; me</footer></body>"
    )
    got = run(spark, [(1, "http://a.com/1", page), (2, None, None), (3, "", ""), (4, "http://[bad", "plain &#233; text"), (5, "http://a.com/2", "<p>cut off <b class='x"), (None, "u", page)])
    assert got[1] == "A & B\nOne two three four\n5 < 6 and on\nx\ny\nq r\na b"
    assert got[2] == got[3] == "" and got[4] == "plain é text" and got[5] == "cut off" and got[None] == got[1]
    assert html_text.extract(pages(spark, [(1, "u", page)]).limit(0)).collect() == []


def test_repeated_branches_without_a_role_go(spark):
    rnd = random.Random(1)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        body = [text(12), text(30)]
        rows.append((i, f"http://h{i % 3}.org/{i}", f"<body><div class='x{i % 3}'>Always the same {i % 2}</div><div class='body'><p>{body[0]}</p><p>{body[1]}</p></div></body>"))
        want[i] = "\n".join(body)
    rows += [(100 + i, "http://h0.org/c", rows[0][2]) for i in range(200)]  # copies say nothing
    got = run(spark, rows)
    assert {k: got[k] for k in want} == want and all(got[100 + i] == want[0] for i in range(200))


def test_importance_is_the_normalised_entropy(spark):
    rows = [(i, "http://one.org/", f"<div class='k'>{'same' if i < 6 else i}</div><p>text {i}</p>") for i in range(10)]
    tree = {r.path: r for r in html_text.style_tree(pages(spark, rows)).collect()}
    k = tree[html_text._id("/div.k")]
    plain = -(0.6 * math.log(0.6) + 4 * 0.1 * math.log(0.1)) / math.log(10)
    assert abs(k.importance - plain) < 1e-9 and k.n == 10
    assert abs(tree[html_text._id("/p")].importance - 1) < 1e-9


def test_whole_table(spark):
    got = {r.page_id: r for r in Q.op1(spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].url == r.url
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert len(got) == len(rows)


# --------------------------------------------------------------------- vectors


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1, None):
        for size in (1, 1, 1, 2, 5, 40):
            base = rng.standard_normal(32)
            for _ in range(size):
                noise = rng.standard_normal(32) * np.linalg.norm(base) / np.sqrt(32) * rng.choice([0.0, 0.05, 0.12, 0.16])
                rows.append((n, [float(x) for x in (base + noise) * rng.uniform(0.1, 9)], label))
                n += 1
    copy = rows[10][1]
    rows += [(1000 + i, copy, rows[10][2]) for i in range(7)] + [(1003, copy, rows[10][2])]
    bad = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 31, [1e308] * 32, [1e-320] * 32]
    return rows + [(2000 + i, v, 1) for i, v in enumerate(bad)] + [(None, copy, 1), (None, None, 1)]


def brute(rows, threshold=0.98):
    n = len(rows)
    good = [v is not None and len(v) > 0 and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def cosine(a, b):
        a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), links[i], str(least.get(find(i)))) for i, r in enumerate(rows))


def test_links_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("class", F.lit("x"))
    got = embedding_dedup.link_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got if r.component_id is not None)
    assert embedding_dedup.link_vectors(df.limit(0)).collect() == []


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    rows = [(i, [float(x) for x in base + rng.standard_normal(64) * 0.1 * rng.choice([0.3, 1.0, 1.3])], 4) for i in range(120)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 25)
    got = embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    exact = [(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows]
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(exact)


def test_recall_of_blocks_and_estimates():
    """At cosine 0.98 at least one block is shared and the bound keeps the pair."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9801 * a + math.sqrt(1 - 0.9801**2) * b
    va, vb = (embedding_dedup.block_values(embedding_dedup.codes(x)[1]) for x in (a, near))
    assert (va == vb).any(axis=1).mean() >= 0.999
    x = np.concatenate([a[:500], near[:500]])
    i, j, _ = embedding_dedup.pairs_of(x, np.arange(500), np.arange(500, 1000), 0.98)
    assert (j - i == 500).sum() >= 499
    turned, signs, factor = embedding_dedup.codes(a)
    estimate = (embedding_dedup.codes(near)[0] * signs).sum(axis=1) / np.sqrt(512) / factor
    assert abs(estimate.mean() - 0.9801) < 0.002  # unbiased


def test_names_that_only_mention_a_role_do_not_remove_a_page():
    text = "<p>main text</p>"
    for html in (
        f'<body class="single-post no-sidebar">{text}</body>', f'<body><div id="main" class="has-ads">{text}</div></body>',
        f'<body><article class="post comments-open">{text}</article></body>', f'<body class="hidden">{text}</body>',
        f'<body><div class="overlay"><main class="search">{text}</main></div></body>', f'<body><div class="menu-open">{text}</div></body>',
    ):
        assert not any(html_text.Page(html).noise), html
    for html in ('<div class="site-footer">x</div>', '<div class="box ad">x</div>', '<div id="left-sidebar-2">x</div>', "<div hidden>x</div>", "<nav>x</nav>"):
        assert html_text.Page(f"<body>{html}</body>").noise[-1], html


@pytest.mark.parametrize("dense,rows,pairs", [(64, 4096, 1 << 18), (1, 1, 3), (1000, 40, 7)])
def test_streamed_buckets_equal_brute_force(monkeypatch, dense, rows, pairs):
    """Groups of all sizes and both shapes, cut over batches in any way."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 16))
    members = []
    for g, size in enumerate([1, 2, 3, 2, 90, 4, 1, 2, 30]):
        cross = g in (3, 5, 8)
        dim = 16 if g != 7 else 8
        for k in range(size):
            v = base[k % 2, :dim] + rng.standard_normal(dim) * 0.02
            blocks = [7] * embedding_dedup.TABLES if (g, k) == (2, 1) else rng.integers(0, 3, embedding_dedup.TABLES).tolist()
            members.append((g, (k * 2 // size) if cross else 2, 1000 * g + k, v, blocks, int(rng.integers(1, 4))))
    table, want = 2, {}
    for x in members:
        for y in members:
            sides = (x[1], y[1]) == (0, 1) or x[1] == y[1] == 2 and x[2] < y[2]
            if x[0] == y[0] and sides and not any(p == q for p, q in zip(x[4][:table], y[4][:table])):
                if x[3] @ y[3] / np.linalg.norm(x[3]) / np.linalg.norm(y[3]) >= 0.98:
                    want[x[2]] = want.get(x[2], 0) + y[5]
                    want[y[2]] = want.get(y[2], 0) + x[5]
    for name, value in (("DENSE", dense), ("ROWS", rows), ("PAIRS", pairs)):
        monkeypatch.setattr(embedding_dedup, name, value)
    whole = pa.table({
        "class": [m[2] for m in members], "label": ["l"] * len(members), "width": [len(m[3]) * 8 for m in members], "table": [table] * len(members),
        "value": [m[0] for m in members], "a": [0] * len(members), "b": [0 if m[1] == 2 else 1 for m in members], "side": [m[1] for m in members],
        "m": [m[5] for m in members], "vector": [m[3].tobytes() for m in members], "blocks": [m[4] for m in members],
    })
    got = {}
    for batch in embedding_dedup._buckets(0.98)(iter(whole.to_batches(max_chunksize=7))):
        for c, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            assert c not in got
            got[c] = n
    assert got == want and len(want) > 60
