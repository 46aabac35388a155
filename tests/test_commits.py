"""Batches of several tables: crashes between tables, retries, readers; and the sink with a manifest."""

import json

import pytest
from pyspark.sql import functions as F

from heliosite.sources import manifest
from heliosite.sources.commits import Store


def failing(df):
    return df.select("id", F.when(F.col("id") >= 0, F.raise_error(F.lit("disk on fire"))).otherwise(F.lit(0)).cast("long").alias("n"))


def test_a_crash_between_tables_shows_none_of_the_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "run"))
    a, b = spark.range(10).withColumn("n", F.lit(1).cast("long")), spark.range(20).withColumn("n", F.lit(2).cast("long"))
    assert store.read("a", "id long, n long").count() == 0
    with pytest.raises(ValueError, match="no batch of a"):
        store.read("a")
    assert store.commit("b1", {"a": a, "b": b})
    with pytest.raises(Exception, match="disk on fire"):
        store.commit("b2", {"a": a, "b": failing(b)})
    other = Store(spark, f"file://{tmp_path}/run/")
    assert other.batches() == ["b1"] and other.read("a").count() == 10 and other.read("b").count() == 20
    assert [x.split("/")[0] for x in store.sweep()] in (["a"], ["a", "b"]) and store.sweep() == []
    assert store.commit("b2", {"a": a, "b": b}) and other.read("a").count() == 20
    assert {(r.batch, r["count"]) for r in other.read("b").groupBy("batch").count().collect()} == {("b1", 20), ("b2", 20)}


def test_a_retry_doubles_nothing(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path)), spark.range(5)
    assert store.commit("20240101_000000-1", {"a": rows}) and not store.commit("20240101_000000-1", {"a": rows})
    assert store.read("a").count() == 5
    for bad in ("", "../x", "_hidden", "a b"):
        with pytest.raises(ValueError, match="not a batch id"):
            store.commit(bad, {"a": rows})


def test_plain_readers_pass_over_batches_and_columns_may_be_added(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit("1", {"a": spark.range(3)})
    store.commit("2", {"a": spark.range(3, 5).withColumn("more", F.lit("x")), "b": spark.range(1)})
    assert {(r.id, r.more) for r in store.read("a").collect()} == {(0, None), (1, None), (2, None), (3, "x"), (4, "x")} and store.read("b").count() == 1
    with pytest.raises(Exception, match="(?i)unable to infer|all paths"):
        spark.read.parquet(str(tmp_path / "a")).count()


def test_manifest_of_what_was_written(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(1000).withColumn("name", F.concat(F.lit("é"), F.col("id").cast("string"))).repartition(4)
    manifest.write_with_manifest(rows, path, source_index="index.csv")
    m = json.loads((tmp_path / "out/manifest.json").read_text())
    assert m["rows"] == 1000 and m["source_index"] == "index.csv" and len(m["files"]) == 4 and sum(f["rows"] for f in m["files"]) == 1000
    assert {r.name for r in spark.read.parquet(*[f"{path}/{f['file']}" for f in m["files"]]).collect()} == {f"é{i}" for i in range(1000)}
    state = lambda: {r.file: r.status for r in manifest.verify(spark, path).collect()}
    assert set(state().values()) == {"ok"}
    first, second = (tmp_path / "out" / f["file"] for f in m["files"][:2])
    raw = bytearray(first.read_bytes())
    raw[len(raw) // 2] ^= 1
    first.write_bytes(bytes(raw))
    second.unlink()
    (tmp_path / "out/stray.parquet").write_bytes(b"x")
    got = state()
    assert got[first.name] == "changed" and got[second.name] == "missing" and got["stray.parquet"] == "added" and sorted(got.values()).count("ok") == 2
    with pytest.raises(Exception, match="holds a table already"):
        manifest.write_with_manifest(rows, path)
    manifest.write_with_manifest(rows.limit(7), path, overwrite=True)
    assert manifest.read_manifest(path)["rows"] == 7 and not first.exists()


def test_a_failed_write_leaves_no_manifest(spark, tmp_path):
    with pytest.raises(Exception, match="disk on fire"):
        manifest.write_with_manifest(failing(spark.range(8).repartition(2)), str(tmp_path / "out"))
    assert manifest.read_manifest(str(tmp_path / "out")) is None
    empty = spark.range(0)
    manifest.write_with_manifest(empty, str(tmp_path / "none"))
    assert manifest.read_manifest(str(tmp_path / "none"))["rows"] == 0 and manifest.verify(spark, str(tmp_path / "none")).count() == 0
