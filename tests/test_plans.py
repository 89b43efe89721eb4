"""Physical-plan checks: column pruning and filter pushdown reach the Parquet scan,
and the small dimension of the panel build is broadcast."""

import re

from conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__ as E
from paneltide.plans import fixtures


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schema(plan: str, marker: str) -> set[str]:
    for line in plan.splitlines():
        if "FileScan" in line and marker in line:
            m = re.search(r"FileScan parquet \[([^\]]*)\]", line)  # the scan's output columns
            return {f.split("#")[0] for f in m.group(1).split(",")}
    raise AssertionError(f"no scan of {marker}")


def test_panel_scan_reads_only_used_columns(spark):
    plan = _plan(fixtures.panel_cells(spark, SF_SMALL))
    cols = _read_schema(plan, "lineitem.parquet")
    assert cols == {"l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"}
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_year_filter_is_pushed_down(spark):
    plan = _plan(E.queries()["paper_filter"](spark, SF_SMALL))
    line = next(l for l in plan.splitlines() if "FileScan" in l and "lineitem.parquet" in l)
    assert "GreaterThanOrEqual(l_shipdate" in line and "LessThan(l_shipdate" in line
    assert _read_schema(plan, "lineitem.parquet") == {"l_shipdate", "l_quantity"}


def test_walkforward_fits_read_a_written_table(spark, monkeypatch):
    """A fit has thousands of tasks, and each sends back the counters of all operators of its input's plan."""
    from paneltide.plans import queries_validation as Q

    rows = [(e, y, float(e), float(e + y)) for e in range(12) for y in range(1992, 1999)]
    panel = spark.createDataFrame(rows, f"entity long, year int, x double, {Q.TARGET} double")
    plans = []

    def fit(train, test, features, label):
        plans.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in (train, test))
        return test.withColumn("pred", F.col(features[0]))

    monkeypatch.setattr(Q, "prep", lambda spark, sf: panel)
    monkeypatch.setattr(Q.V, "gbt_predict", fit)
    monkeypatch.setattr(Q, "_WF_MEMO", {})
    preds, folds = Q.walkforward(spark, "none", ["x"], True)
    assert plans and not any("Join" in p or "Aggregate" in p for p in plans)
    want = sum(12 * len([y for y in range(1992, 1999) if f.test_start <= y <= f.test_end]) for f in folds.collect())
    assert preds.count() == want > 0
