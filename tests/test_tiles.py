"""The tile source: what is opened, missing and broken files, retries, and tasks that fail."""

import os

import pytest

from heliosite.sources import tiles

IMAGE = b"\xff\xd8" + b"pixels" + b"\xff\xd9"


def stored(root, zoom, columns, rows, data=IMAGE):
    for y in rows:
        (root / str(zoom) / str(y)).mkdir(parents=True, exist_ok=True)
        for x in columns:
            (root / str(zoom) / str(y) / f"{x}.jpg").write_bytes(data)


def logging_source(log, faults=None):
    """A source that writes a line for each file it opens, and one whose origin fails as ``faults`` says."""

    class Reader(tiles.TileReader):
        def kept(self, path):
            with open(log, "a") as f:
                f.write(path + "\n")
            return super().kept(path)

        def fetch(self, zoom, x, y):
            if faults is None:
                return super().fetch(zoom, x, y)
            mark = f"{log}.{x}.{y}"
            tries = len(open(mark).read()) if os.path.exists(mark) else 0
            with open(mark, "a") as f:
                f.write(".")
            if tries < faults:
                raise OSError("origin is busy")
            return IMAGE

    class Source(tiles.TileSource):
        @classmethod
        def name(cls):
            return "logged_tiles"

        def reader(self, schema):
            return Reader({k.lower(): v for k, v in self.options.items()})

    return Source


def test_only_matching_tiles_are_opened(spark, tmp_path):
    stored(tmp_path / "t", 6, range(20), range(20))
    log = str(tmp_path / "log")
    rows = tiles.read_tiles(spark, str(tmp_path / "t"), "5,6:0-30:0-19", logging_source(log), tilesPerPartition=7)
    found = rows.where("zoom = 6 and x between 3 and 5 and y in (2, 7) and content is not null")
    assert {(r.zoom, r.x, r.y) for r in found.collect()} == {(6, x, y) for x in (3, 4, 5) for y in (2, 7)}
    opened = open(log).read().split()
    assert sorted(set(opened)) == sorted(f"{tmp_path}/t/6/{y}/{x}.jpg" for x in (3, 4, 5) for y in (2, 7)) and len(opened) == 6
    assert rows.where("zoom = 6 and x > 40").count() == 0 and rows.where("zoom = 7").count() == 0 and len(open(log).read().split()) == 6


def test_every_tile_of_the_extent_is_a_row(spark, tmp_path):
    stored(tmp_path / "t", 3, [0, 1], [2])
    rows = tiles.read_tiles(spark, f"file://{tmp_path}/t", "3:0-9:2-3", tilesPerPartition=3)
    got = {(r.x, r.y): r for r in rows.collect()}
    assert len(got) == 20 and rows.rdd.getNumPartitions() == 7
    assert {k for k, r in got.items() if r.content == IMAGE} == {(0, 2), (1, 2), (8, 2), (9, 2)}  # columns go round at 8
    assert all(r.error == "missing" for r in got.values() if r.content is None)
    with pytest.raises(Exception, match="extent isn't"):
        tiles.read_tiles(spark, str(tmp_path), "3:9-0:2-3").count()
    with pytest.raises(Exception, match="missing options: extent"):
        spark.read.format("heliosite_tiles").option("path", str(tmp_path)).load().count()


def test_broken_files_are_fetched_anew_and_kept(spark, tmp_path):
    stored(tmp_path / "cache", 4, [0], [0], IMAGE[:-2])
    stored(tmp_path / "cache", 4, [1], [0])
    stored(tmp_path / "origin", 4, [0, 2], [0], IMAGE.replace(b"pixels", b"others"))
    rows = tiles.read_tiles(spark, str(tmp_path / "cache"), "4:0-3:0-0", origin=str(tmp_path / "origin"))
    got = {r.x: (r.content, r.error) for r in rows.collect()}
    assert got[1] == (IMAGE, None) and got[0] == got[2] == (IMAGE.replace(b"pixels", b"others"), None) and got[3] == (None, "missing")
    assert sorted(p.name for p in (tmp_path / "cache/4/0").iterdir()) == ["0.jpg", "1.jpg", "2.jpg"]  # no part files
    again = tiles.read_tiles(spark, str(tmp_path / "cache"), "4:0-3:0-0")
    assert {r.x for r in again.where("error is null").collect()} == {0, 1, 2}


def test_a_busy_origin_is_tried_again(spark, tmp_path):
    for faults, ok in ((2, True), (3, False)):
        log = str(tmp_path / f"log{faults}")
        rows = tiles.read_tiles(spark, str(tmp_path / f"cache{faults}"), "4:0-4:0-1", logging_source(log, faults), attempts=3, firstWait=0.01).collect()
        assert len({(r.x, r.y) for r in rows}) == len(rows) == 10
        assert all((r.error is None) == ok for r in rows) and (ok or all("origin is busy" in r.error for r in rows))


def test_each_tile_once_where_tasks_fail(tmp_path):
    """A task that dies halfway is run again; kept tiles aren't fetched twice."""
    stored(tmp_path / "origin", 4, range(6), range(2))
    reader = tiles.TileReader({"path": str(tmp_path / "cache"), "origin": str(tmp_path / "origin"), "extent": "4:0-5:0-1", "tilesperpartition": "4"})
    for strip in reader.partitions():
        half = reader.read(strip)
        next(half)  # and is given up
    opened = []
    reader.fetch = lambda *tile: opened.append(tile)
    rows = [r for strip in reader.partitions() for batch in reader.read(strip) for r in batch.to_pylist()]
    assert len(rows) == 12 and all(r["error"] is None for r in rows) and not opened
