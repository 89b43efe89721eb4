"""State-transition and duration operators on an (entity, year, state) panel.

States 0/1/2 (Low/Medium/High), -1 inactive. Every matrix is a long
``(s_from, s_to, ...)`` table; only 3 x 3 algebra per group runs in pandas
(``applyInPandas`` on already aggregated groups).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import md5_uniform
from .ranking import row_number_rank

N_STATES = 3


def state_grid(spark: SparkSession, n_states: int = N_STATES) -> DataFrame:
    cells = [(i, j) for i in range(n_states) for j in range(n_states)]
    return spark.createDataFrame(cells, "s_from int, s_to int")


def transition_pairs(panel: DataFrame, state: str = "state", entity: str = "entity", year: str = "year") -> DataFrame:
    """Consecutive *observed* periods: inactive rows are removed first, so a gap
    (0, -1, 1) still yields one 0 -> 1 transition."""
    w = Window.partitionBy(entity).orderBy(year)
    obs = panel.where(F.col(state) >= 0).select(entity, year, F.col(state).alias("s_from"))
    pairs = obs.withColumn("s_to", F.lead("s_from").over(w)).where(F.col("s_to").isNotNull())
    return pairs.where((F.col("s_from") < N_STATES) & (F.col("s_to") < N_STATES))


def transition_counts(panel: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = list(by or [])
    return transition_pairs(panel).groupBy(*by, "s_from", "s_to").agg(F.count(F.lit(1)).alias("n"))


def normalise_rows(counts: DataFrame, by: list[str] | None = None, n_col: str = "n") -> DataFrame:
    """Full 3 x 3 grid per group; p = n / row sum, an empty row gets 1/3 each."""
    by = list(by or [])
    spark = counts.sparkSession
    grid = _grid_per_group(counts, by) if by else state_grid(spark)
    full = grid.join(counts, [*by, "s_from", "s_to"], "left").withColumn(n_col, F.coalesce(F.col(n_col), F.lit(0)))
    row = F.sum(n_col).over(Window.partitionBy(*by, "s_from"))
    return full.withColumn("row_n", row).withColumn(
        "p", F.when(F.col("row_n") > 0, F.col(n_col) / F.col("row_n")).otherwise(F.lit(1.0 / N_STATES))
    )


def _grid_per_group(counts: DataFrame, by: list[str]) -> DataFrame:
    """(group, s_from, s_to) for every group present, by exploding a literal 3 x 3 array."""
    cells = F.array(*[F.struct(F.lit(i).alias("s_from"), F.lit(j).alias("s_to")) for i in range(N_STATES) for j in range(N_STATES)])
    return counts.select(*by).distinct().select(*by, F.explode(cells).alias("c")).select(*by, "c.s_from", "c.s_to")


def sojourns(panel: DataFrame, year_end: int, state: str = "state", entity: str = "entity", year: str = "year") -> DataFrame:
    """Episodes with right-censoring (gaps-and-islands).

    Islands of equal state per entity (ordered by year). A non-negative island
    followed by another non-negative island is a closed episode (to = next state,
    length = next start - start); followed by an inactive island it is discarded;
    the last island is censored (to = -1, length = year_end - start + 1).
    """
    w = Window.partitionBy(entity).orderBy(year)
    flagged = panel.select(entity, year, F.col(state).alias("_s")).withColumn(
        "_chg", F.when(F.lag("_s").over(w).isNull() | (F.lag("_s").over(w) != F.col("_s")), 1).otherwise(0)
    )
    islands = flagged.withColumn("_isl", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    isl = islands.groupBy(entity, "_isl").agg(F.first("_s").alias("s"), F.min(year).alias("start"))
    wi = Window.partitionBy(entity).orderBy("_isl")
    isl = isl.withColumn("next_s", F.lead("s").over(wi)).withColumn("next_start", F.lead("start").over(wi))
    isl = isl.where(F.col("s") >= 0)
    closed = isl.where(F.col("next_s") >= 0).select(
        entity,
        F.col("s").alias("from_state"),
        F.col("next_s").alias("to_state"),
        (F.col("next_start") - F.col("start")).cast("int").alias("sojourn_len"),
        F.col("start").alias("year_start"),
    )
    censored = isl.where(F.col("next_s").isNull()).select(
        entity,
        F.col("s").alias("from_state"),
        F.lit(-1).alias("to_state"),
        (F.lit(year_end) - F.col("start") + 1).cast("int").alias("sojourn_len"),
        F.col("start").alias("year_start"),
    )
    return closed.unionByName(censored)


def ctmc_rates(counts: DataFrame, soj: DataFrame, by: list[str] | None = None, alpha: float = 1.0, beta: float = 2.0) -> DataFrame:
    """Gamma(alpha, beta) posterior of CTMC rates: q_ij = (alpha + n_ij) / (beta + T_i),
    sd = sqrt(alpha + n_ij) / (beta + T_i); diagonal = -row sum (sd 0)."""
    by = list(by or [])
    expo = soj.where(F.col("from_state").between(0, N_STATES - 1)).groupBy(*by, F.col("from_state").alias("s_from")).agg(
        F.sum("sojourn_len").alias("exposure")
    )
    grid = _grid_per_group(counts.select(*by).unionByName(expo.select(*by)).distinct(), by) if by else state_grid(counts.sparkSession)
    full = grid.join(counts, [*by, "s_from", "s_to"], "left").join(expo, [*by, "s_from"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    t = F.coalesce(F.col("exposure"), F.lit(0)).cast("double")
    off = F.col("s_from") != F.col("s_to")
    full = full.select(
        *by,
        "s_from",
        "s_to",
        n.alias("n"),
        t.alias("exposure"),
        F.when(off, (F.lit(alpha) + n) / (F.lit(beta) + t)).alias("_q"),
        F.when(off, F.sqrt(F.lit(alpha) + n) / (F.lit(beta) + t)).otherwise(F.lit(0.0)).alias("q_sd"),
    )
    row = F.sum("_q").over(Window.partitionBy(*by, "s_from"))
    return full.withColumn("q_mean", F.when(F.col("s_from") != F.col("s_to"), F.col("_q")).otherwise(-row)).drop("_q")


def dirichlet_posterior(counts: DataFrame, by: list[str] | None = None, prior: float = 1.0) -> DataFrame:
    """Dirichlet(prior) posterior of each transition row: mean (n_ij + a) / (n_i + 3a)
    and sd sqrt(a_ij (a0 - a_ij) / (a0^2 (a0 + 1)))."""
    by = list(by or [])
    full = normalise_rows(counts, by)
    a = F.col("n") + F.lit(prior)
    a0 = F.col("row_n") + F.lit(prior * N_STATES)
    return full.select(*by, "s_from", "s_to", "n", (a / a0).alias("p_mean"), F.sqrt(a * (a0 - a) / (a0 * a0 * (a0 + 1))).alias("p_sd"))


def steady_state(matrix: DataFrame, p_col: str, by: list[str] | None = None) -> DataFrame:
    """Stationary vector of each 3 x 3 stochastic matrix from the principal minors of
    I - P (Markov chain tree theorem), as Column expressions on one pivoted row."""
    by = list(by or [])
    wide = matrix.groupBy(*by).agg(
        *[F.max(F.when((F.col("s_from") == i) & (F.col("s_to") == j), F.col(p_col))).alias(f"p{i}{j}") for i in range(3) for j in range(3)]
    )
    p = lambda i, j: F.col(f"p{i}{j}")
    m0 = (1 - p(1, 1)) * (1 - p(2, 2)) - p(1, 2) * p(2, 1)
    m1 = (1 - p(0, 0)) * (1 - p(2, 2)) - p(0, 2) * p(2, 0)
    m2 = (1 - p(0, 0)) * (1 - p(1, 1)) - p(0, 1) * p(1, 0)
    tot = m0 + m1 + m2
    return wide.select(*by, (m0 / tot).alias("pi_low"), (m1 / tot).alias("pi_medium"), (m2 / tot).alias("pi_high"))


# ------------------------------------------------------------------ reliability (3 x 3 per group)
_TERMS = 24  # series terms of a step; a step is a 64th of its time, then squared six times
_SQUARINGS = 6


def _matmul(a, b):
    """Product of two 3 x 3 matrices held as arrays of nine (row by row)."""
    cell = lambda m, r, c: F.get(m, (r * 3 + c).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(8)),
        lambda i: sum((cell(a, F.floor(i / 3), F.lit(k)) * cell(b, F.lit(k), i % 3) for k in range(1, 3)), cell(a, F.floor(i / 3), F.lit(0)) * cell(b, F.lit(0), i % 3)),
    )


def _step_matrix(q, t: float):
    """P(t) = exp(Q t) of a rate matrix (array of nine), as a fold over series terms."""
    identity = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    scaled = F.transform(q, lambda x: x * F.lit(t / 2**_SQUARINGS))
    start = F.struct(identity.alias("sum"), identity.alias("term"))

    def add(acc, k):
        term = F.transform(_matmul(acc["term"], scaled), lambda x: x / k)
        return F.struct(F.zip_with(acc["sum"], term, lambda x, y: x + y).alias("sum"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, add, lambda acc: acc["sum"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(_SQUARINGS)), series, lambda m, _: _matmul(m, m))


def reliability(rates: DataFrame, group_col: str = "grp", horizon: float = 15.0, n_grid: int = 100, rewards=(0.0, 0.5, 1.0), gamma: float = 0.9) -> DataFrame:
    """Per-group reliability summary of a 3-state rate matrix, one row a group, Column
    expressions only.

    The stationary vector comes from the rates' spanning trees, MTTF and MTTR from the
    closed form, the transient probability of Medium or High from High from powers of one
    step matrix, and the discounted state values from solving (I - gamma P) v = r by
    Cramer's rule on the annual matrix P."""
    wide = rates.groupBy(F.col(group_col).cast("string").alias("grp")).agg(
        *[F.max(F.when((F.col("s_from") == i) & (F.col("s_to") == j), F.col("q_mean"))).alias(f"q{i}{j}") for i in range(3) for j in range(3)]
    )
    q = lambda i, j: F.col(f"q{i}{j}")
    trees = [
        q(1, 0) * q(2, 0) + q(1, 2) * q(2, 0) + q(2, 1) * q(1, 0),
        q(0, 1) * q(2, 1) + q(0, 2) * q(2, 1) + q(2, 0) * q(0, 1),
        q(0, 2) * q(1, 2) + q(0, 1) * q(1, 2) + q(1, 0) * q(0, 2),
    ]
    total = trees[0] + trees[1] + trees[2]
    pi = [F.when(total > 0, t / total) for t in trees]
    generator = F.array(*[q(i, j) for i in range(3) for j in range(3)])
    wide = wide.withColumn("_step", _step_matrix(generator, horizon / (n_grid - 1))).withColumn("_year", _step_matrix(generator, 1.0))
    high = lambda m: F.least(F.greatest(F.get(m, F.lit(7)) + F.get(m, F.lit(8)), F.lit(0.0)), F.lit(1.0))
    identity = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    begin = F.struct(identity.alias("m"), F.array(F.lit(1.0)).alias("curve"))

    def walk(acc, _):
        m = _matmul(acc["m"], F.col("_step"))
        return F.struct(m.alias("m"), F.concat(acc["curve"], F.array(high(m))).alias("curve"))

    curve = F.aggregate(F.sequence(F.lit(1), F.lit(n_grid - 1)), begin, walk, lambda acc: acc["curve"])
    # rows of the annual matrix sum to one up to rounding
    share = F.transform(F.col("_year"), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    wide = wide.withColumn("_year", share)
    p = lambda i, j: F.get("_year", F.lit(3 * i + j)) / sum((F.get("_year", F.lit(3 * i + k)) for k in (1, 2)), F.get("_year", F.lit(3 * i)))
    m = [[(F.lit(1.0) if i == j else F.lit(0.0)) - F.lit(gamma) * p(i, j) for j in range(3)] for i in range(3)]

    def det(x):
        return (
            x[0][0] * (x[1][1] * x[2][2] - x[1][2] * x[2][1])
            - x[0][1] * (x[1][0] * x[2][2] - x[1][2] * x[2][0])
            + x[0][2] * (x[1][0] * x[2][1] - x[1][1] * x[2][0])
        )

    reward = [F.lit(float(x)) for x in rewards]
    value = [det([[reward[i] if c == j else m[i][c] for c in range(3)] for i in range(3)]) / det(m) for j in range(3)]
    out = wide.join(closed_form_mttf_mttr(rates.withColumn("grp", F.col(group_col).cast("string")), ["grp"]), "grp")
    return out.select(
        "grp", pi[0].alias("pi_low"), pi[1].alias("pi_medium"), pi[2].alias("pi_high"), pi[2].alias("availability"), "mttf", "mttr",
        curve.alias("transient_high"), F.array(*[p(i, j) for i in range(3) for j in range(3)]).alias("p_annual"),
        value[0].alias("v_low"), value[1].alias("v_medium"), value[2].alias("v_high"),
    )


def closed_form_mttf_mttr(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MTTF/MTTR in closed form from the off-diagonal rates (no matrix inverse)."""
    by = list(by or [])
    wide = rates.groupBy(*by).agg(
        *[F.max(F.when((F.col("s_from") == i) & (F.col("s_to") == j), F.col("q_mean"))).alias(f"q{i}{j}") for i in range(3) for j in range(3) if i != j]
    )
    q = lambda i, j: F.col(f"q{i}{j}")
    mttf = (q(2, 1) + q(1, 0) + q(1, 2)) / ((q(1, 0) + q(1, 2)) * (q(2, 0) + q(2, 1)) - q(1, 2) * q(2, 1))
    mttr = (q(0, 1) + q(1, 0) + q(1, 2)) / ((q(0, 1) + q(0, 2)) * (q(1, 0) + q(1, 2)) - q(0, 1) * q(1, 0))
    return wide.select(*by, mttf.alias("mttf"), mttr.alias("mttr"))


# ------------------------------------------------------------------ robustness
def entity_cell_counts(panel: DataFrame) -> DataFrame:
    return transition_pairs(panel).groupBy("entity", "s_from", "s_to").agg(F.count(F.lit(1)).alias("n"))


def leave_one_out(panel: DataFrame, excluded: DataFrame) -> DataFrame:
    """Transition matrices without each excluded entity: total counts minus the
    entity's own counts (transitions never cross entities), no rescan."""
    ec = entity_cell_counts(panel)
    total = ec.groupBy("s_from", "s_to").agg(F.sum("n").alias("n_total"))
    ex = excluded.select(F.col("entity").alias("excluded"))
    grid = ex.select("excluded", F.explode(F.array(*[F.struct(F.lit(i).alias("s_from"), F.lit(j).alias("s_to")) for i in range(3) for j in range(3)])).alias("c")).select(
        "excluded", "c.s_from", "c.s_to"
    )
    own = ec.join(ex, ec.entity == ex.excluded).select("excluded", "s_from", "s_to", F.col("n").alias("n_own"))
    loo = grid.join(total, ["s_from", "s_to"], "left").join(own, ["excluded", "s_from", "s_to"], "left").select(
        "excluded", "s_from", "s_to", (F.coalesce("n_total", F.lit(0)) - F.coalesce("n_own", F.lit(0))).alias("n")
    )
    mat = normalise_rows(loo, ["excluded"])
    full = normalise_rows(total.withColumnRenamed("n_total", "n")).select("s_from", "s_to", F.col("p").alias("p_full"))
    out = mat.join(full, ["s_from", "s_to"]).withColumn("abs_change", F.abs(F.col("p") - F.col("p_full")))
    return out.withColumn("max_abs_change", F.max("abs_change").over(Window.partitionBy("excluded"))).select(
        "excluded", "s_from", "s_to", "n", "p", "max_abs_change"
    )


def bootstrap_picks(spark: SparkSession, n_boot: int, n: int, salt: str) -> DataFrame:
    """(rep, idx): ``n`` picks of 0 .. n - 1 with replacement for each of ``n_boot``
    replicates; slot s of replicate b picks floor(u * n), u the md5 uniform of (b, s).

    One range over all slots: the planner sees how many rows it has. An exploded sequence is
    taken for a few kilobytes and broadcast, however many entities there are."""
    slots = spark.range(n_boot * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), (F.col("id") % F.lit(max(n, 1))).alias("slot"))
    return slots.select("rep", F.floor(md5_uniform(F.col("rep"), F.col("slot"), salt=salt) * F.lit(n)).cast("bigint").alias("idx"))


def bootstrap_matrices(panel: DataFrame, n_boot: int = 500, salt: str = "boot") -> DataFrame:
    """Entity-cluster bootstrap of the transition matrix.

    Replicate b draws N entities with replacement: slot s picks the entity at
    index floor(u * N), u = md5 uniform of (b, s) -- identical in Spark and SQL and
    under task retries. Entity x cell counts are computed once, *before* the
    replicates are exploded; replicate rows are (b, slot) pairs joined to them.
    """
    spark = panel.sparkSession
    ec = entity_cell_counts(panel)
    ents = panel.where(F.col("state") >= 0).select("entity").distinct()
    idx = row_number_rank(ents.withColumn("_k", F.col("entity").cast("double")), "_k", "entity", "_pos")
    idx = idx.select("entity", (F.col("_pos") - 1).alias("idx"))
    picks = bootstrap_picks(spark, n_boot, ents.count(), salt)
    # one row an entity with its cells in an array, so a pick meets one row; the built side of
    # the join is the entities, and no side is broadcast
    cells = F.struct("s_from", "s_to", "n")
    own = idx.join(ec.groupBy("entity").agg(F.collect_list(cells).alias("cells")), "entity").select("idx", "cells")  # at most 9 a row
    drawn = picks.join(own.hint("shuffle_hash"), "idx").select("rep", F.explode("cells").alias("c"))
    counts = drawn.groupBy("rep", "c.s_from", "c.s_to").agg(F.sum("c.n").alias("n"))
    reps_present = spark.range(n_boot).select(F.col("id").alias("rep"))
    grid = _grid_per_group(reps_present, ["rep"])
    full = grid.join(counts, ["rep", "s_from", "s_to"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return normalise_rows(full, ["rep"])


def percentile_band(boot: DataFrame, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Per-cell percentile envelope over replicates (each cell has n_boot values: a
    bounded group, so the built-in exact ``percentile`` is safe here)."""
    return boot.groupBy("s_from", "s_to").agg(
        F.percentile("p", lo).alias("p_lo"), F.percentile("p", hi).alias("p_hi"), F.avg("p").alias("p_mean")
    )
