"""Hand cases, one per rule (FIXTURES section 4)."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.functions.text import clean_text
from paneltide.operators import panel as P
from paneltide.operators import spatial as SP
from paneltide.operators import transitions as TR
from paneltide.operators.describe import shannon_entropy
from paneltide.operators.ranking import average_rank, percentile_row
from paneltide.operators.validation import fold_plan, ndcg
from paneltide.sources.tables import normalise_nan, resolve_optional


def test_nan_is_missing(spark):
    df = normalise_nan(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "y double"))
    r = df.agg(F.avg("y").alias("m"), F.count("y").alias("n")).first()
    assert r["m"] == 2.0 and r["n"] == 2


def test_lag_by_row_over_year_gap(spark):
    df = spark.createDataFrame([(1, 2007, 5.0), (1, 2009, 7.0)], "entity int, year int, v double")
    out = P.add_lag(df, "v", "v_lag").orderBy("year").collect()
    assert out[1]["v_lag"] == 5.0


def test_first_row_state_flag(spark):
    df = spark.createDataFrame([(1, 2007, 2, 0.0), (1, 2008, 0, 0.0)], "entity int, year int, state int, log_mean_pat double")
    out = P.lags(df).orderBy("year").collect()
    assert [r["high_state_lag"] for r in out] == [0, 1]


def test_within_deviation_null_is_zero(spark):
    df = spark.createDataFrame([(1, 2007, 2.0), (1, 2008, None)], "entity int, year int, x double")
    out = P.group_means(df, ["x"]).orderBy("year").collect()
    assert [r["dm_x"] for r in out] == [0.0, -2.0]


def test_optional_column_absent(spark):
    df = spark.createDataFrame([(1, 2007)], "entity int, year int")
    assert resolve_optional(df, {"oa_share": 0.0}).first()["oa_share"] == 0.0


def _states(spark, states, years):
    return spark.createDataFrame([(1, y, s) for y, s in zip(years, states)], "entity int, year int, state int")


def test_sojourn_censored(spark):
    out = TR.sojourns(_states(spark, [0, 0, 1], [2021, 2022, 2023]), 2023).orderBy("year_start").collect()
    assert [(r.from_state, r.to_state, r.sojourn_len, r.year_start) for r in out] == [(0, 1, 2, 2021), (1, -1, 1, 2023)]


def test_sojourn_cut_by_inactive(spark):
    out = TR.sojourns(_states(spark, [2, -1, 2], [2021, 2022, 2023]), 2023).collect()
    assert [(r.from_state, r.to_state, r.sojourn_len, r.year_start) for r in out] == [(2, -1, 1, 2023)]


def test_transition_bridges_inactive(spark):
    out = TR.transition_counts(_states(spark, [0, -1, 1], [2001, 2002, 2003])).collect()
    assert [(r.s_from, r.s_to, r.n) for r in out] == [(0, 1, 1)]


def test_empty_transition_row(spark):
    counts = spark.createDataFrame([(0, 1, 3)], "s_from int, s_to int, n long")
    m = {(r.s_from, r.s_to): r.p for r in TR.normalise_rows(counts).collect()}
    assert m[(2, 0)] == pytest.approx(1 / 3) and m[(0, 1)] == 1.0


def test_rates_with_prior(spark):
    counts = spark.createDataFrame([(0, 1, 3)], "s_from int, s_to int, n long")
    soj = spark.createDataFrame([(1, 0, 1, 6, 2001)], "entity int, from_state int, to_state int, sojourn_len int, year_start int")
    r = {(x.s_from, x.s_to): x for x in TR.ctmc_rates(counts, soj).collect()}
    assert r[(0, 1)].q_mean == 0.5 and r[(0, 1)].q_sd == 0.25


def _path_weights(spark, n):
    rows = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i + 1, i, 1.0) for i in range(n - 1)]
    return spark.createDataFrame(rows, "i long, j long, w double")


def test_moran_constant(spark):
    y = spark.createDataFrame([(0, 5.0), (1, 5.0), (2, 5.0)], "place long, y double")
    r = SP.morans_test(_path_weights(spark, 3), y, "place", "y", n_perm=9).first()
    assert (r.I, r.E_I, r.z_perm, r.p_perm) == (0.0, -0.5, 0.0, 1.0)


def test_moran_by_hand(spark):
    y = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "place long, y double")
    assert SP.morans_i(_path_weights(spark, 4), y, "place", "y").first().I == pytest.approx(1 / 3)


def test_zero_weight_row_stays_zero(spark):
    w = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (2, 0, 0.0)], "i long, j long, w double")
    out = {(r.i, r.j): r.w for r in SP.row_normalise(w).collect()}
    assert (2, 0) not in out and out[(0, 1)] == 1.0


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "d double")
    e = percentile_row(df, "d", {"e1": 0.2, "e2": 0.4, "e3": 0.6, "e4": 0.8}).first()
    d = F.col("d")
    q = F.when(d <= e.e1, "Q1").when(d <= e.e2, "Q2").when(d <= e.e3, "Q3").when(d <= e.e4, "Q4").otherwise("Q5")
    got = {r.d: r.q for r in df.select("d", q.alias("q")).collect()}
    assert got[1.0] == got[2.0] == "Q1" and got[9.0] == got[10.0] == "Q5"


def test_tied_ranks(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 20, 20, 30])], "id int, x double")
    out = [r.rx for r in average_rank(df, "x", "rx").orderBy("id").collect()]
    assert out == [1.0, 2.5, 2.5, 4.0]


def test_ndcg_tied_predictions(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5), (0, 0.0, 0.5)], "f int, y double, p double")
    r = ndcg(df, "y", "p", ["f"]).first()
    assert r.dcg == pytest.approx((1 + 1 / math.log2(3)) / 2)


def test_alias_priority_and_longest(spark):
    from paneltide.plans.queries_text import alias_match

    texts = spark.createDataFrame([(1, "Work at the University of Chinese Academy of Sciences")], "id int, text string")
    aliases = spark.createDataFrame(
        [("CAS", 1, "chinese academy of sciences"), ("UCAS", 2, "university of chinese academy of sciences")], "entity string, priority int, alias string"
    )
    assert alias_match(texts, aliases, "text", "id", "priority").first().matched == "CAS"
    assert alias_match(texts, aliases, "text", "id", "longest").first().matched == "UCAS"


def test_cleaning_rule(spark):
    df = spark.createDataFrame([("The 5G V2X Model, of LiDAR-2020!",)], "t string")
    assert df.select(clean_text(F.col("t")).alias("c")).first().c == "lidar"


def test_entropy(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "g int, c string")
    assert shannon_entropy(df, ["g"], "c").first().entropy == pytest.approx(math.log(2))


def test_segment_borders(spark):
    segs = {"Pre-BRI": (2007, 2013), "BRI-COVID": (2013, 2020), "Post-COVID": (2020, 2024), "Overall": (2007, 2024)}
    df = spark.createDataFrame([(2013,), (2020,)], "year int")
    got = {(r.year, r.segment) for r in P.segment_expand(df, segs).collect()}
    assert got == {(2013, "BRI-COVID"), (2013, "Overall"), (2020, "Post-COVID"), (2020, "Overall")}


def test_fold_plan():
    plan = fold_plan(list(range(2007, 2024)), 5)
    assert [f["train_end"] for f in plan] == [2009, 2011, 2013, 2015, 2017]
    assert all(f["test_end"] == f["test_start"] for f in plan)


def test_gap_rule_elbow_then_min_k(spark):
    from paneltide.operators.learning import choose_k

    def chosen(gaps, sk, min_k):
        df = spark.createDataFrame([(k, g, sk) for k, g in zip(range(2, 8), gaps)], "k int, gap double, sk double")
        return [r.k for r in choose_k(df, min_k).where("chosen").collect()]

    rising = [0.0, 1.0, 1.5, 1.8, 2.0, 2.1]  # no gap(k) >= gap(k+1) - s(k+1)
    assert chosen(rising, 0.0, 2) == [3]  # elbow: the sharpest fall of the increments
    assert chosen(rising, 0.0, 5) == [5]  # never below min_k
    assert chosen([0.0, 1.0, 1.5, 1.4, 2.0, 2.1], 0.0, 2) == [4]  # first k that the next does not beat
    assert chosen(rising, 0.25, 2) == [5]


def test_reliability_equals_numpy(spark):
    from paneltide.operators.transitions import reliability

    q = np.array([[-1.1, 0.7, 0.4], [0.3, -0.5, 0.2], [0.25, 1.5, -1.75]])
    rows = [("g", i, j, float(q[i, j])) for i in range(3) for j in range(3)]
    r = reliability(spark.createDataFrame(rows, "grp string, s_from int, s_to int, q_mean double")).first()
    values, vectors = np.linalg.eig(q)
    exp = lambda t: (vectors @ np.diag(np.exp(values * t)) @ np.linalg.inv(vectors)).real
    limit = exp(200.0)[0]
    assert np.allclose([r.pi_low, r.pi_medium, r.pi_high], limit, atol=1e-9)
    assert np.allclose(np.array(r.p_annual).reshape(3, 3), exp(1.0), atol=1e-10)
    assert np.allclose(r.transient_high, [exp(15.0 * k / 99)[2, 1:].sum() for k in range(100)], atol=1e-9)
    v = np.linalg.solve(np.eye(3) - 0.9 * exp(1.0), [0.0, 0.5, 1.0])
    assert np.allclose([r.v_low, r.v_medium, r.v_high], v, atol=1e-8)
    assert abs(r.mttf + np.linalg.inv(q[1:, 1:])[1].sum()) < 1e-9 and abs(r.mttr + np.linalg.inv(q[:2, :2])[0].sum()) < 1e-9


def test_document_vectors_equal_numpy_svd(spark):
    from paneltide.operators.learning import tfidf_svd

    rng = np.random.default_rng(0)
    rows = [(d, f"t{t}", int(rng.integers(1, 5))) for d in range(30) for t in rng.choice(25, 6, replace=False) if t % 3 == d % 3 or rng.random() < 0.15]
    got = {r.d: r.doc_vector for r in tfidf_svd(spark.createDataFrame(rows, "d long, term string, n int"), "d", 3, rounds=25).collect()}
    docs, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    tf = np.zeros((len(docs), len(terms)))
    for d, t, n in rows:
        tf[docs.index(d), terms.index(t)] = n
    w = tf * (np.log((1 + len(docs)) / (1 + (tf > 0).sum(axis=0))) + 1)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    mine, want = np.array([got[d] for d in docs]), u[:, :3] * s[:3]
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-4)


def test_clusters_of_many_starts(spark):
    from paneltide.operators.learning import best_fits, kmeans, kmeans_many, nearest_centre

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(i, [float(a), float(b)], i % 2) for i, (a, b) in enumerate(x)], "i long, v array<double>, b int")
    centres = kmeans(df, "i", "v", 3)
    assert np.allclose(sorted(np.round(centres).tolist()), [[0, 0], [0, 5], [5, 0]])
    topics = {r.i: r.topic for r in nearest_centre(df, "v", centres).collect()}
    assert len({topics[i] for i in range(40)}) == len({topics[i] for i in range(40, 80)}) == 1 and len(set(topics.values())) == 3
    fits = [(0, 3), (0, 3), (1, 3), (1, 2)]
    best = best_fits(kmeans_many(df, "i", "v", fits, set_col="b"), fits)
    half = x[::2]
    near = ((half[:, None] - best[0, 3][1]) ** 2).sum(axis=2).min(axis=1).sum()
    assert abs(best[0, 3][0] - near) < 1e-6 and best[1, 2][0] > best[1, 3][0]


def test_cluster_starts_cover_all_rows(spark):
    """Two of 12,000 rows lie far from the rest: they get a centre of their own from every seed. Sets with
    fewer distinct vectors than k repeat centres, missing vectors are left out, the order of rows is no matter."""
    from paneltide.operators.learning import _candidates, kmeans, kmeans_many

    far = F.when(F.col("id").isin(5_001, 11_003), F.lit(100_000.0)).otherwise(0.0)
    df = spark.range(12_000).select("id", F.array(far + F.col("id") % 7, far + F.col("id") % 11).alias("v"))
    for seed in (1, 2, 3):
        centres = kmeans(df, "id", "v", 2, seed=seed, n_init=1)
        assert np.allclose(max(centres.tolist()), [100_000 + (5_001 % 7 + 11_003 % 7) / 2, 100_000 + (5_001 % 11 + 11_003 % 11) / 2])
    rows = df.select(F.lit(-1).alias("s"), F.col("id").alias("i"), "v")
    (x, n), (y, m) = _candidates(rows, {-1: 4}, 7)[-1], _candidates(rows.repartition(5, F.rand(3)), {-1: 4}, 7)[-1]
    assert np.array_equal(x, y) and np.array_equal(n, m) and n.sum() == 12_000 and len(set(map(tuple, x))) == len(x) < 100
    few = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(50)] + [(50, None)], "id long, v array<double>")
    cost, centres = kmeans_many(few, "id", "v", [(-1, 4)])[0]
    assert cost == 0 and {tuple(c) for c in centres} == {(0.0, 1.0), (1.0, 1.0)}
    with pytest.raises(ValueError):
        kmeans(few.where("id > 49"), "id", "v", 2)


def test_club_leftover_unlabelled(spark):
    """Ranked by last value, the top pair passes the log-t test (t > -1.65) and the
    full set does not: a two-member club forms and the single leftover stays
    unlabelled."""
    from paneltide.operators.convergence import form_clubs

    panel = [
        [3.5, 4.6, 5.9, 4.1, 5.8, 6.2, 6.1, 5.0, 7.2, 7.8],
        [10.2, 3.8, 5.2, 10.1, 7.3, 7.3, 5.0, 2.7, 6.3, 6.2],
        [6.6, 4.4, 7.5, 5.0, 7.8, 3.9, 7.8, 6.0, 3.5, 5.4],
    ]
    rows = [(e + 1, 2000 + t, v) for e, series in enumerate(panel) for t, v in enumerate(series)]
    bal = spark.createDataFrame(rows, "entity long, year int, y double")
    clubs = {r.entity: (r.club, r.converging) for r in form_clubs(bal).collect()}
    assert clubs == {1: (1, True), 2: (1, True)}


def test_document_vectors_by_small_blocks(spark, monkeypatch):
    """Many blocks and pieces, a document without an id (it gets a vector but adds nothing to terms), a document with
    no term but null (it only counts): as numpy has it. A round sends a vector a block and term, not one a weight."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    from paneltide.operators import blocks
    from paneltide.operators.learning import tfidf_svd

    rng = np.random.default_rng(3)
    rows = [(f"d{d}", f"t{t}", int(rng.integers(1, 5))) for d in range(60) for t in rng.choice(30, 8, replace=False) if t % 3 == d % 3 or rng.random() < 0.2]
    rows += [(None, "t1", 2), (None, "t2", 1), ("none", None, 3)]
    kinds = StructType([StructField("d", StringType()), StructField("term", StringType()), StructField("n", IntegerType())])
    df = spark.createDataFrame(rows, kinds).repartition(5)
    few = blocks.TfidfBlocks(df, "d", 4, "svd")
    sent = few.state.where("block IS NOT NULL").select("locals").collect()
    pairs = sum(len(blocks._unpack(r.locals)) for r in sent)
    assert few.n_docs == 62 and pairs <= 30 * spark.sparkContext.defaultParallelism < len(rows) * 4
    monkeypatch.setattr(blocks, "BLOCK_TERMS", 5)
    monkeypatch.setattr(blocks, "PIECE_WEIGHTS", 7)
    got = {r.d: r.doc_vector for r in tfidf_svd(df, "d", 3, rounds=20).collect()}
    docs, terms = sorted({r[0] for r in rows if r[0] and r[1]}) + [None], sorted({r[1] for r in rows if r[1]})
    tf = np.zeros((len(docs), len(terms)))
    for d, t, n in rows:
        if t:
            tf[docs.index(d), terms.index(t)] = n
    w = tf * (np.log((1 + 62) / (1 + (tf > 0).sum(axis=0))) + 1)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = np.array([[int(hashlib.md5(f"svd|{t}|{j}".encode()).hexdigest()[:8], 16) / 2**32 - 0.5 for j in range(11)] for t in terms])
    for _ in range(20):
        u = w @ np.linalg.qr(v)[0]
        v = w[:-1].T @ u[:-1]
    left, s, _ = np.linalg.svd(u, full_matrices=False)
    assert set(got) == set(docs)
    assert np.allclose(np.abs([got[d] for d in docs]), np.abs(left[:, :3] * s[:3]), atol=1e-6)


def test_packed_vectors():
    from paneltide.operators import blocks

    x = np.random.default_rng(1).normal(size=(50, 3)) * 10.0 ** np.arange(-20, 30)[:, None]
    y = blocks._unpack(blocks._pack(blocks._rounded(x)), np.float64).reshape(-1, 3)
    assert np.all(np.abs(x - y) <= 1e-12 * np.abs(x)) and len(blocks._unpack(blocks._pack(np.zeros(0, np.int64)))) == 0
    assert np.array_equal(blocks._unpack(blocks._pack(np.arange(-3, 5))), np.arange(-3, 5))


@pytest.mark.parametrize("to_terms", [True, False])
def test_block_product_holds_few_columns(to_terms):
    """Of a block's 18 columns a few are in memory at a time; the product is that of whole matrices."""
    import tracemalloc

    import pyarrow as pa

    from paneltide.operators import blocks

    n_terms, k, parts, rng = 40000, 18, 40, np.random.default_rng(3)
    v, df, turn = blocks._rounded(rng.normal(size=(n_terms, k))), rng.integers(1, 9, n_terms), rng.normal(size=(k, k))
    sizes, idx, n = np.array([30, 0, 50]), rng.permutation(n_terms)[:80], rng.integers(1, 5, 80)
    names = ["block", "part", "locals", "slots", "df", "vectors", "ids", "sizes", "idx", "n"]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), *[pa.binary()] * 3]
    rows = [[7, None, None, None, None, None, [1, 2, 3], *map(blocks._pack, (sizes, idx, n))]]
    owns = np.array_split(rng.permutation(n_terms), parts)
    rows += [[7, i, *map(blocks._pack, (own, np.arange(len(own)), df[own], v[own])), None, None, None, None] for i, own in enumerate(owns)]
    batches = [pa.record_batch([pa.array([x], t) for x, t in zip(r, kinds)], names=names) for r in rows]
    tracemalloc.start()
    got = list(blocks._product(turn, 10, to_terms)(iter(batches)))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    w = np.zeros((2, n_terms))
    for row, at in enumerate((slice(0, 30), slice(30, 80))):
        w[row, idx[at]] = n[at] * (np.log(11.0 / (1.0 + df[idx[at]])) + 1.0)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    u = w @ (v @ turn)
    if to_terms:
        out = np.zeros((n_terms, k))
        for b in got:
            out[owns[b.column("part")[0].as_py()]] = blocks._unpack(b.column("vectors")[0].as_py(), np.float64).reshape(-1, k)
        assert np.allclose(out, w.T @ u, rtol=1e-9, atol=1e-12)
    else:
        assert got[0].column("id").to_pylist() == [1, 3] and np.allclose(got[0].column("u").to_pylist(), u)
    assert held < 1.2 * n_terms * k * 8
