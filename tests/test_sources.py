"""Sources and sinks on temporary folders."""

import pytest
from pyspark.sql import functions as F

from heliosite.sources import tables as t


def test_csv_round_trip_and_header(spark, tmp_path):
    raw = tmp_path / "a.csv"
    raw.write_bytes("﻿mall_id,name,lat\n1,\"a, \"\"b\"\"\n c\",3.5\n2,,\n3,\"\",nan\n".encode())
    rows = t.read_text_csv(spark, str(raw), required=("mall_id", "lat"))
    assert rows.columns == ["mall_id", "name", "lat"]
    assert [tuple(r) for r in rows.orderBy("mall_id").collect()] == [("1", 'a, "b"\n c', "3.5"), ("2", "", ""), ("3", "", "nan")]
    with pytest.raises(ValueError, match="missing columns: city"):
        t.read_text_csv(spark, str(raw), required=("city",))
    assert t.read_text_csv(spark, str(raw), ["lat", "city"]).columns == ["lat", "city"]
    assert t.read_or_empty(spark, str(tmp_path / "none.csv"), ["x"]).count() == 0
    typed = t.read_typed_csv(spark, str(raw), spark.createDataFrame([], "mall_id long, lat double").schema)
    assert [r.mall_id for r in typed.orderBy("mall_id").collect()] == [1, 2, 3] and typed.where("mall_id = 2").first().lat is None
    t.write_csv(rows, str(tmp_path / "out"), ["name", "extra"])
    back = t.read_text_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["name", "extra"] and back.count() == 3
    with pytest.raises(ValueError, match="unknown columns"):
        t.write_csv(rows, str(tmp_path / "out"), ["name"], strict=True)


def test_runs_and_projection(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id long, name string")
    root = str(tmp_path / "runs")
    t.append_run(df, f"{root}/a", "20240101_000000")
    t.append_run(df, f"{root}/b", "20240101_000000")
    t.append_run(df.withColumn("id", F.lit(2).cast("long")), f"{root}/a", "20240102_000000")
    t.append_run(df.withColumn("id", F.lit(3).cast("long")), f"{root}/a", "20240102_000000")
    t.append_run(df, f"{root}/a", "manual")
    assert {r.id for r in t.latest_run(spark.read.parquet(f"{root}/a")).collect()} == {2, 3}
    assert t.fixed_projection(df, ["name", "x"]).first() == ("", "")
    assert t.with_added_columns(df, {"id": F.lit(9), "n": F.lit(7)}).first() == (1, None, 7)
    found = t.read_where(spark, f"{root}/b", {"id": 1}, ["id"])
    assert found.count() == 1 and "EqualTo(id,1)" in found._jdf.queryExecution().toString()


def test_images_and_paths(spark, tmp_path):
    for name in ("B/7_x.JPG", "a/7_y.jpg", "a/8_z.png", "a/no.txt", "c.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    images = t.list_images(spark, str(tmp_path))
    assert [r.stem for r in images.collect()] == ["7_y", "8_z", "7_x", "c"]
    assert {r.id: r.path.rsplit("/", 1)[1] for r in t.first_image_per_id(images).collect()} == {7: "7_x.JPG", 8: "8_z.png"}
    paths = spark.createDataFrame([("/a/b",), ("c.jpg",), (" ",), (None,), ("s3://x",)], "p string")
    assert [r[0] for r in paths.select(t.resolved_path(F.col("p"), "/root/x/")).collect()] == ["/a/b", "/root/x/c.jpg", "", "", "s3://x"]


def test_settings():
    assert t.merged_config({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"c": 3}, "d": [2]}) == {"a": {"b": 1, "c": 3}, "d": [2]}
    assert t.first_setting({"x": "", "y": 0}, "x", "y", default=5) == 0 and t.first_setting({}, "x", default=5) == 5


def test_checkpoints_of_a_run_are_stored_once(spark, tmp_path):
    from heliosite.sources.commits import Store

    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    assert t.checkpoint_run({"a": df, "b": df.limit(1)}, str(tmp_path), "20240101_000000", 0)
    assert not t.checkpoint_run({"a": df, "b": df}, str(tmp_path), "20240101_000000", 0)
    assert t.checkpoint_run({"a": df}, str(tmp_path), "20240102_000000", 0)
    store = Store(spark, str(tmp_path))
    assert store.read("a").count() == 4 and store.read("b").count() == 1 and t.latest_run(store.read("a")).count() == 2


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "out")
    t.write_csv(spark.createDataFrame([("1", "old")], "id string, name string"), path, ["id", "name"])
    broken = spark.range(3).select(F.col("id"), F.raise_error(F.lit("disk on fire")).cast("string").alias("name"))
    with pytest.raises(Exception, match="disk on fire"):
        t.write_csv(broken, path, ["id", "name"])
    assert [tuple(r) for r in t.read_text_csv(spark, path).collect()] == [("1", "old")] and [p.name for p in tmp_path.iterdir()] == ["out"]
    t.write_csv(spark.createDataFrame([("2", "new")], "id string, name string"), path, ["id", "name"])
    assert [tuple(r) for r in t.read_text_csv(spark, path).collect()] == [("2", "new")] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_columns_of_a_folder_meet_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,name\n1,x\n")
    (tmp_path / "2.csv").write_text("name,id\ny,2\n")
    (tmp_path / "3.csv").write_text("id,extra\n3,z\n")
    (tmp_path / "4.csv").write_text("")
    rows = t.read_text_csv(spark, str(tmp_path))
    assert {tuple(r) for r in rows.select("id", "name", "extra").collect()} == {("1", "x", ""), ("2", "y", ""), ("3", "", "z")}
    with pytest.raises(ValueError, match="missing columns: name"):
        t.read_text_csv(spark, str(tmp_path), required=("name",))


def test_files_that_rows_name(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name in ("x.jpg", "a b/mall_1.jpg"):
        (tmp_path / name).write_bytes(b"")
    rows = [(1, f"{tmp_path}/x.jpg", True), (2, f"file://{tmp_path}/a b/mall_1.jpg", True), (3, f" {tmp_path}/a b/mall_2.jpg ", False), (4, "", False), (5, None, False), (6, " ", False), (7, f"{tmp_path}/none/x.jpg", False), (8, f"{tmp_path}/a b", False), (9, f"{tmp_path}/x.jpg/y.jpg", False), (10, f"{tmp_path}/x.jpg", True), (11, "x.jpg", False)]
    df = spark.createDataFrame([r[:2] for r in rows], "id int, path string")
    got = t.with_existence(df, "path")
    assert {r.id: r.exists for r in got.collect()} == {i: there for i, _, there in rows} and got.columns == ["id", "path", "exists"]
    assert t.with_existence(df.where("false"), "path").count() == 0


def test_columns_that_are_missing(spark):
    from heliosite.operators import reviews

    rows = spark.createDataFrame([(1, 2)], "a int, b int")
    assert reviews.missing_columns(rows, ["c", "a", "Z", "c"]) == ["Z", "c"] and reviews.missing_columns(rows, ["b"]) == []
