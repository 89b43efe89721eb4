"""Invariants and determinism on the fixture tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from paneltide.operators import spatial as SP
from paneltide.operators import transitions as TR
from paneltide.plans import fixtures
from paneltide.plans.common import prep


def test_transition_rows_sum_to_one(spark):
    m = TR.normalise_rows(TR.transition_counts(fixtures.panel(spark, SF_SMALL)))
    sums = [r.s for r in m.groupBy("s_from").agg(F.sum("p").alias("s")).collect()]
    assert np.allclose(sums, 1.0)


def test_demeaned_sums_to_zero(spark):
    d = prep(spark, SF_SMALL).groupBy("entity").agg(F.sum("tech_prox_fe").alias("s")).collect()
    assert max(abs(r.s) for r in d) < 1e-12


def test_moran_shift_invariant(spark):
    pl = fixtures.places(spark, SF_SMALL)
    w = SP.row_normalise(SP.weights_inverse_distance(pl))
    y = pl.select("place", (F.col("lat") * 0.1 + F.col("lon") * 0.01).alias("y"))
    a = SP.morans_i(w, y, "place", "y").first().I
    b = SP.morans_i(w, y.withColumn("y", F.col("y") + 100.0), "place", "y").first().I
    assert a == pytest.approx(b, rel=1e-9)


def test_chow_scale_invariant(spark):
    from paneltide.operators.inference import chow_tests

    df = prep(spark, SF_SMALL).select("log_mean_pat", "year", "log_n_papers").na.drop()
    a = chow_tests(df, {"e": 1998}, "log_mean_pat", ["year", "log_n_papers"])[0]["f_stat"]
    b = chow_tests(df.withColumn("log_mean_pat", F.col("log_mean_pat") * 7.0), {"e": 1998}, "log_mean_pat", ["year", "log_n_papers"])[0]["f_stat"]
    assert a == pytest.approx(b, rel=1e-7)


def test_bootstrap_draws_sum_to_n(spark):
    boot = TR.bootstrap_matrices(fixtures.panel(spark, SF_SMALL), n_boot=20)
    per_rep = boot.groupBy("rep").agg(F.sum("n").alias("n")).collect()
    total = TR.transition_counts(fixtures.panel(spark, SF_SMALL)).agg(F.sum("n")).first()[0]
    assert len(per_rep) == 20 and all(r.n > 0 for r in per_rep)
    assert abs(np.mean([r.n for r in per_rep]) - total) < total
    # with one transition count of 1 an entity, a replicate's sum is its number of draws
    p = fixtures.panel(spark, SF_SMALL).where("state >= 0")
    first = p.groupBy("entity").agg(F.min("year").alias("year"))
    two = p.join(first, "entity").where((p["year"] - first["year"]).between(0, 1)).select("entity", p["year"], "state")
    n = two.select("entity").distinct().count()
    draws = TR.bootstrap_matrices(two, n_boot=20).groupBy("rep").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in draws} == {n}


@pytest.mark.parametrize("name", ["sigma_segments", "transition_matrix", "ctfidf", "morans_perm"])
def test_determinism_across_partitions(spark, name):
    import __spark_entry__ as E

    q = E.queries()[name]
    results = []
    for parts in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(tuple(r) for r in q(spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_bootstrap_picks_are_not_taken_for_a_small_table(spark):
    picks = TR.bootstrap_picks(spark, 5, 200_000, "boot")
    size = int(str(picks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= 8 * 5 * 200_000  # an exploded sequence counted as a few rows, and was broadcast
    got = TR.bootstrap_picks(spark, 3, 7, "boot").groupBy("rep").agg(F.count("idx").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).collect()
    assert sorted(r.rep for r in got) == [0, 1, 2] and all(r.n == 7 and 0 <= r.lo <= r.hi <= 6 for r in got)
    assert TR.bootstrap_picks(spark, 3, 0, "boot").count() == 0


def test_bootstrap_of_one_entity_repeats_its_matrix(spark):
    p = spark.createDataFrame([(1, 2000, 0), (1, 2001, 1), (1, 2002, 1)], "entity long, year int, state int")
    boot = TR.bootstrap_matrices(p, n_boot=4).where("n > 0").collect()
    assert sorted((r.rep, r.s_from, r.s_to, r.n) for r in boot) == sorted((b, i, 1, 1) for b in range(4) for i in (0, 1))
    assert "Broadcast" not in TR.bootstrap_picks(spark, 4, 1, "boot").join(p.hint("shuffle_hash"), F.col("idx") == F.col("entity"))._jdf.queryExecution().executedPlan().toString()
