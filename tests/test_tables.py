"""Readers, writers, labels, parameters, reports."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from featherline import schemas, study
from featherline.operators import labels, params, tables
from featherline.sources import readers, sinks
from featherline.sources.inline import rule_table


@pytest.fixture
def folder(tmp_path):
    for tag, name in (("AA1", "AA1_2024-05-23.lux"), ("BB2", "XBB2_2024-05-13.lux")):
        (tmp_path / "light" / tag).mkdir(parents=True)
        text = "Some maker ltd logger\r\nDD/MM/YYYY HH:MM:SS\tlight(lux)\r\n"
        text += "05/03/2024 04:10:00\t3\r\n25/03/2024 04:15:00\t71\r\n"
        (tmp_path / "light" / tag / name).write_bytes(text.encode())
    (tmp_path / "label").mkdir()
    (tmp_path / "label" / "AA1.csv").write_bytes(
        b'"series","timestamp","value","label"\r\n"Set","2021-09-04T04:20:00Z",1010.5,"1"\r\n'
        b'"Rise","2021-09-04T18:45:00Z",435.5,"37-5"\r\n'
    )
    (tmp_path / "label" / "AA1-labeled.csv").write_bytes(
        b"series,timestamp,value,label\nSet,2021-09-04T04:20:00.000Z,1010.5,discard\n"
        b"Rise,2021-09-04T18:45:00.000Z,435.5,37-5\n"
    )
    return tmp_path


def test_light_takes_the_tag_from_the_folder(spark, folder, rows):
    got = rows(readers.read_light(spark, str(folder / "light")), "id", "ts", "lux")
    times = [dt.datetime(2024, 3, 5, 4, 10), dt.datetime(2024, 3, 25, 4, 15)]
    assert got == [("AA1", times[0], 3.0), ("AA1", times[1], 71.0), ("BB2", times[0], 3.0), ("BB2", times[1], 71.0)]


def test_unreadable_light_is_counted(spark, tmp_path):
    (tmp_path / "91D").mkdir()
    (tmp_path / "91D" / "91D.lux").write_text(
        "maker\nDD/MM/YYYY HH:MM:SS\tlight(lux)\n05/03/2024 04:10:00\t3\nnot a row\n06/03/2024 04:10:00\tmany\n\n"
    )
    assert [r.id for r in readers.read_light(spark, str(tmp_path)).collect()] == ["91D"]
    assert [tuple(r) for r in readers.unreadable_light(spark, str(tmp_path)).collect()] == [("91D", 2, "06/03/2024 04:10:00\tmany")]


def test_a_tag_that_looks_like_a_number_stays_text(spark, tmp_path):
    df = spark.createDataFrame([("91D", 1)], "id string, v int")
    sinks.write_results(df, str(tmp_path / "r"))
    assert [tuple(r) for r in readers.read_results(spark, str(tmp_path / "r"), "v int, id string").select("id", "v").collect()] == [("91D", 1)]


def test_exports_in_a_row_keep_other_tags(spark, tmp_path, rows):
    both = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "id string, lat double")
    tags = both.select("id")
    sinks.export_path(both, tags, str(tmp_path / "p"))
    sinks.export_path(both.withColumn("lat", F.col("lat") + 10), tags, str(tmp_path / "p"), only=["A"])
    assert rows(readers.read_results(spark, str(tmp_path / "p"), "lat double, id string"), "id", "lat") == [("A", 11.0), ("B", 2.0)]


def test_columns_are_found_by_header(spark, tmp_path):
    (tmp_path / "acc.csv").write_text("acc5,acc3,date,id,extra\n3,1,2023-08-01T05:00:00Z,A,x\nbad,2,2023-08-01T06:00:00Z,A,x\n")
    got = readers.read_acc(spark, str(tmp_path / "acc.csv")).orderBy("date").collect()
    assert [(r.id, r.acc3, r.acc4, r.acc5) for r in got] == [("A", 1, None, 3), ("A", 2, None, None)]


def test_files_of_one_folder_may_have_different_headers(spark, tmp_path, rows):
    folder = tmp_path / "acc.csv"
    folder.mkdir()
    (folder / "part one.csv").write_text("acc5,acc3,date,id\n3,1,2023-08-01T05:00:00Z,A\n")
    (folder / "part [2]+.csv").write_text("id,date,acc3,acc4\nB,2023-08-01T06:00:00Z,2,7\n")
    (folder / "part3.csv").write_text("id,date,acc3,acc4\nC,2023-08-01T06:00:00Z,4,8\n")
    (folder / "empty.csv").write_text("")
    assert rows(readers.read_acc(spark, str(folder)), "id", "acc3", "acc4", "acc5") == [("A", 1, None, 3), ("B", 2, 7, None), ("C", 4, 8, None)]
    for tag, text in (("A", "x,y\n1,2\n"), ("B", "y,z,x\n3,9,4\n")):
        (tmp_path / "tags" / tag).mkdir(parents=True)
        (tmp_path / "tags" / tag / f"{tag}_acc.csv").write_text(text)
    df = readers.read_union(spark, str(tmp_path / "tags"), "_acc.csv", "x int, y int")
    assert rows(df, "id", "x", "y") == [("A", 1, 2), ("B", 4, 3)]


def test_a_large_light_file_is_read_in_blocks(spark, tmp_path):
    for tag, n in (("A", 3000), ("B", 1), ("C", 500)):
        (tmp_path / tag).mkdir()
        text = "".join(f"05/03/2024 04:{i % 60:02d}:00\t{i}\r\n" for i in range(n))
        (tmp_path / tag / f"{tag}.lux").write_bytes(("maker\r\nDD/MM/YYYY HH:MM:SS\tlight(lux)\r\n" + text).encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "4096")
    spark.conf.set(names[1], "7")
    try:
        df = readers.light_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = df.collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert not [r for r in got if r._corrupt_record is not None]
    for tag, n in (("A", 3000), ("B", 1), ("C", 500)):
        assert sorted(r.lux for r in got if r.id == tag) == [float(i) for i in range(n)]


def test_tags_by_suffix(spark, folder):
    got = readers.read_tags(spark, str(folder / "light"), ".lux").collect()
    assert sorted(r.id for r in got) == ["AA1", "BB2"]


def test_twilight_revisions_and_their_difference(spark, folder):
    df = readers.read_twilight(spark, str(folder / "label"))
    assert df.count() == 4 and {r.id for r in df.collect()} == {"AA1"}
    assert df.select("timestamp").distinct().count() == 2
    diff = labels.label_diff(
        df.where(~F.col("labelled")), df.where("labelled"), ["id", "series", "timestamp"]
    ).collect()
    assert [(r.series, r.label_before, r.label_after, r.change) for r in diff] == [("Set", "1", "discard", "relabelled")]
    parsed = {r.label: (r.stap_id, r.is_flight, r.discarded) for r in labels.with_stap(df).collect()}
    assert parsed == {"1": (1.0, False, False), "37-5": (37.5, True, False), "discard": (None, None, True)}
    assert labels.valid_labels(df).count() == 3


def test_twilight_value_and_normalised_name(spark, folder):
    df = readers.read_twilight(spark, str(folder / "label")).where("not labelled")
    out = labels.normalise_series(labels.with_twilight_value(df.drop("value"), 750.5)).collect()
    got = {r.series: (round(r.value, 6), r.event) for r in out}
    assert got == {"Set": (1010.5, "morning"), "Rise": (435.5, "evening")}


def test_label_text_can_be_read_back(spark, folder, tmp_path):
    df = readers.read_twilight(spark, str(folder / "label")).where("not labelled")
    sinks.write_twilight(df, str(tmp_path / "out"))
    back = readers.read_twilight(spark, str(tmp_path / "out"))
    columns = ["id", "series", "timestamp", "value", "label"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, df.select(columns).collect()))


def test_union_read_skips_absent_files(spark, tmp_path, rows):
    for tag in ("A", "B", "C"):
        (tmp_path / tag).mkdir()
    for tag in ("A", "B"):
        (tmp_path / tag / f"{tag}_acc.csv").write_text("x,y\n1,2\n")
    (tmp_path / "C" / "C_press.csv").write_text("x,y\n9,9\n")
    df = readers.read_union(spark, str(tmp_path), "_acc.csv", "x int, y int")
    assert rows(df, "id", "x", "y") == [("A", 1, 2), ("B", 1, 2)]


def test_hourly_tables_as_text_and_parquet(spark, tmp_path):
    (tmp_path / "acc.csv").write_text(
        "id,date,acc3,acc4,acc5,act_score\nA,2023-08-01T05:00:00Z,1,2,3,26\n"
    )
    df = readers.read_acc(spark, str(tmp_path / "acc.csv"))
    df.write.parquet(str(tmp_path / "acc"))
    back = readers.read_acc(spark, str(tmp_path / "acc")).first()
    assert (back.id, back.date, back.acc5, back.act_score) == ("A", dt.datetime(2023, 8, 1, 5), 3, 26.0)


def test_results_are_split_by_tag_and_pruned(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "id string, v int")
    sinks.write_results(df, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r")).where("id = 'A'")
    assert [r.v for r in back.collect()] == [1]
    assert "PartitionFilters: [isnotnull(id" in back._jdf.queryExecution().executedPlan().toString()


def test_export_reports_tags_without_path(spark, tmp_path):
    paths = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "id string, lat double")
    tags = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    missing = sinks.export_path(paths, tags, str(tmp_path / "p"))
    assert [r.id for r in missing.collect()] == ["C"]
    missing = sinks.export_path(paths, tags, str(tmp_path / "q"), only=["A"])
    assert missing.count() == 0 and spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_package(spark, tmp_path):
    t = [dt.datetime(2023, 8, 1), dt.datetime(2024, 5, 1)]
    df = spark.createDataFrame([("A", t[0]), ("A", t[1])], "id string, date timestamp")
    cover = tables.coverage({"light": df, "pressure": df.where(F.col("date") > t[0])})
    tags, events = sinks.export_tags(cover), sinks.export_observations(cover)
    assert tuple(tags.first()) == ("A", t[0], t[1], 2)
    assert sorted(tuple(r) for r in events.collect()) == [("A", "equipment", t[0]), ("A", "retrieval", t[1])]
    sinks.export_package({"tags": tags, "observations": events}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "observations")).count() == 2


def test_parameters_of_the_study(spark):
    table = rule_table(spark, study.param_rows(), schemas.PARAMS)
    resolved = params.resolve_params(table)
    got = {(r.id, r.key): (r.value, r.overridden) for r in resolved.collect()}
    assert got["AC0", "pressure_map.sd"] == ("0.9", True)
    assert got["DBA", "pressure_map.sd"] == ("0.8", False)
    assert got["AC0", "graph_create.thr_gs"] == ("150", False)
    assert ("default", "graph_create.thr_gs") not in got
    windows = {r.id: (r.crop_start, r.crop_end) for r in params.crop_windows(resolved).collect()}
    assert windows["91A"] == (dt.datetime(2022, 6, 15), dt.datetime(2023, 3, 12)) and len(windows) == 11
    sds = {r.id: r.sd for r in params.number_param(resolved, "pressure_map.sd", "sd").collect()}
    assert (sds["AC4"], sds["ACA"]) == (0.9, 0.8)


def test_column_cleanup(spark):
    df = spark.createDataFrame([(1, None, 2)], "a int, b int, `...3` int")
    assert tables.drop_all_null(tables.drop_unnamed(df)).columns == ["a"]


def test_constraint_report(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "y"), (None, "z")], "id string, kind string")
    tags = spark.createDataFrame([("B",)], "tag string")
    got = {
        r.check: r.n_failed
        for r in tables.check_table(
            df, ["id"], required=["id"], domains={"kind": ["x", "y"]}, references={"id": (tags, "tag")}
        ).collect()
    }
    assert got == {"missing id": 1, "domain kind": 1, "unique id": 1, "reference id": 2}


def test_pooling_weight_is_an_expression(spark):
    df = spark.createDataFrame([(10,)], "n int")
    assert params.weighted(df, "ln(n)/n").first().weight == pytest.approx(0.2302585)
