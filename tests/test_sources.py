"""Sources and sinks: CSV with BOM, missing inputs, weights round trip, JSON."""

import json
import os
import tempfile

import pytest

from paneltide.sources.sinks import to_json_lines, write_table
from paneltide.sources.tables import MissingInputError, read_panel, read_table, read_weights


def test_missing_input_is_named(spark):
    with pytest.raises(MissingInputError, match="nope"):
        read_table(spark, "/root/testdata/sf0.001", "nope")


def test_panel_csv_with_bom_and_nan(spark):
    d = tempfile.mkdtemp(prefix="pt-csv-", dir="/tmp")
    path = os.path.join(d, "panel.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("entity,year,n_papers,mean_patent_cit\nA,2007,3,NaN\nA,2008,4,2.0\n")
    df = read_panel(spark, path)
    rows = df.orderBy("year").collect()
    assert df.columns[0] == "entity" and rows[0]["mean_patent_cit"] is None and rows[1]["n_papers"] == 4.0


def test_weights_round_trip(spark):
    d = tempfile.mkdtemp(prefix="pt-w-", dir="/tmp")
    w = spark.createDataFrame([("geo", "a", "b", 0.5), ("type", "a", "c", 1.0)], "kind string, i string, j string, w double")
    write_table(w, os.path.join(d, "w"), partition_by=["kind"])
    back = read_weights(spark, os.path.join(d, "w"), ["geo"]).collect()
    assert [(r.i, r.j, r.w) for r in back] == [("a", "b", 0.5)]


def test_json_lines(spark):
    df = spark.createDataFrame([("T0", ["a", "b"], {"d": 0.5})], "topic string, terms array<string>, scores map<string,double>")
    line = to_json_lines(df).first()[0]
    assert json.loads(line) == {"topic": "T0", "terms": ["a", "b"], "scores": {"d": 0.5}}


def test_written_tables_can_be_dropped(spark):
    from paneltide import session

    kept, session._WRITTEN[:] = list(session._WRITTEN), []
    df = session.materialise(spark.range(5), "drop_me")
    path = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert df.count() == 5 and os.path.isdir(path)
    assert session.drop_materialised(spark) == 1 and not os.path.exists(path)
    session._WRITTEN[:] = kept
