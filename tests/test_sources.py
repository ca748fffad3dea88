import gzip
import os

import pytest
from pyspark.sql import functions as F

from sylva.session import scratch_path
from sylva.sources import covtype
from sylva.sources.export import export_csv, read_exported
from sylva.sources.parquet import class_counts, load_views, stage, staged, view_counts, write_read_parquet

from .conftest import SF_SMALL


def _f1_lines():
    lines = []
    for soil in range(1, 41):
        for rep in range(3):
            vals = [2000 + soil * 10 + rep, 10, 5, 100, 20, 300, 200, 220, 150, 900]
            wild = [1 if i == rep % 4 else 0 for i in range(4)]
            flags = [1 if i == soil else 0 for i in range(1, 41)]
            lines.append(",".join(map(str, vals + wild + flags + [soil % 7 + 1])))
    return lines


def _write(tmp_path, lines):
    p = tmp_path / "covtype.data.gz"
    with gzip.open(p, "wt") as f:
        f.write("\n".join(lines) + "\n")
    return str(p)


def test_onehot_ingest_round_trip(spark, tmp_path):
    path = _write(tmp_path, _f1_lines())
    table = covtype.ingest(spark, path, str(tmp_path / "pq"))
    assert table.count() == 120
    got = {r["Soil_Description"]: r["count"] for r in class_counts(table, "Soil_Description").collect()}
    assert set(got) == set(covtype.SOIL_TYPES) and set(got.values()) == {3}
    row = table.filter("Elevation = 2010").first()
    assert row["Soil_Description"] == covtype.SOIL_TYPES[0]


def test_rows_without_exactly_one_flag_are_rejected(spark, tmp_path):
    lines = _f1_lines()
    two = lines[0].split(",")
    two[14] = two[15] = "1"
    none = lines[1].split(",")
    for i in range(14, 54):
        none[i] = "0"
    path = _write(tmp_path, lines + [",".join(two), ",".join(none)])
    good, bad = covtype.decode_onehot(covtype.read_onehot_csv(spark, path), on_bad="split")
    assert good.count() == 120
    assert sorted(r["hot_flags"] for r in bad.collect()) == [0, 2]
    checked = covtype.decode_onehot(covtype.read_onehot_csv(spark, path))
    for action in (checked.collect, checked.count, checked.select("Elevation").collect):
        with pytest.raises(Exception):
            action()


def test_hot_flags_are_those_that_equal_one(spark):
    rows = [(1, -1, 1, 5), (1, 7, 0, 5), (2, -1, 0, 5), (0, 1, 0, None), (0, 1, 0, 5)]
    df = spark.createDataFrame(rows, "a int, b int, c int, x int")
    good, bad = covtype.decode_onehot(df, ["a", "b", "c"], ["A", "B", "C"], "name", on_bad="split")
    assert sorted(r["name"] for r in good.collect()) == ["A", "B"]
    assert sorted(r["hot_flags"] for r in bad.collect()) == [0, 1, 2]


def test_views_stage_and_lookup(spark):
    load_views(spark, {f"{SF_SMALL}/region.parquet": "region_v", f"{SF_SMALL}/nation.parquet": "nation_v"})
    counts = {r["view"]: r["n_rows"] for r in view_counts(spark, ["region_v", "nation_v"]).collect()}
    assert counts == {"region_v": 5, "nation_v": 25}
    stage(spark, "st_region", "SELECT r_regionkey FROM region_v")
    assert staged(spark, "st_region").count() == 5
    assert staged(spark, "no_such_view_x") is None


def test_parquet_round_trip_and_csv_export(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, 2.5)], "c string, x int, d double")
    back = write_read_parquet(df, scratch_path(spark, "rt-test"))
    assert sorted(back.collect()) == sorted(df.collect())
    path = export_csv(df, scratch_path(spark, "csv-test"), single_file=True)
    local = path.removeprefix("file:")
    files = [f for f in os.listdir(local) if f.endswith(".csv")]
    text = open(os.path.join(local, files[0])).read().splitlines()
    assert text[0] == "c,x,d" and "a,1," in text


def test_streaming_labels_equal_batch_labels(spark):
    from sylva.plans import saved
    from sylva.plans.tree import label
    from sylva.registry import QUERIES
    from sylva.sources.staged import st_line
    stream = {(r["cluster_id"], r["y"]): r["n"] for r in QUERIES["st_stream_label_counts"](spark, SF_SMALL).collect()}
    batch = {(r["cluster_id"], r["y"]): r["n"] for r in label(st_line(spark, SF_SMALL), saved.LINE_A).groupBy(
        "cluster_id", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert stream == batch


def test_export_keeps_the_empty_label(spark):
    rows = [("", 1), (None, 2), ("a", None)]
    df = spark.createDataFrame(rows, "cluster_id string, n int")
    path = export_csv(df, scratch_path(spark, "csv-empty"))
    assert {tuple(r) for r in read_exported(spark, path, df.schema).collect()} == set(rows)
