"""Window merges and mosaics against numpy: overlaps, negative places, missing and broken tiles, bands that don't divide."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliosite.functions import text
from heliosite.operators import windows as w


def test_merge_is_the_plain_maximum(spark):
    r, rows, want = np.random.default_rng(3), [], {}
    for _ in range(40):
        image, x0, y0, wide, high = int(r.integers(0, 3)), int(r.integers(-40, 60)), int(r.integers(-5, 30)), int(r.integers(1, 50)), int(r.integers(1, 9))
        values = [None if r.random() < 0.1 else float(r.integers(0, 100)) for _ in range(wide * high)]
        rows.append((image, x0, y0, wide, values))
        for i, v in enumerate(values):
            if v is not None:
                key = image, y0 + i // wide, x0 + i % wide
                want[key] = max(v, want.get(key, v))
    rows += [(9, 0, 0, 4, []), (9, 0, 0, 0, [1.0]), (9, 0, 0, 4, None)]
    df = spark.createDataFrame(rows, "image int, x0 int, y0 int, width int, values array<double>").repartition(5)
    got = {(m.image, m.y, m.x0 + i): v for m in w.max_merged(df, "image", 8).collect() for i, v in enumerate(m["values"]) if v is not None}
    assert got == want
    plan = w.max_merged(df, "image", 8)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "collect" not in plan


def test_gate_keeps_the_best_where_none_is_good(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.5, 2), (1, 0.1, 3), (2, 0.2, 1), (2, 0.3, 3), (2, 0.3, 2), (3, 0.5, 1)], "image int, score double, n int")
    assert {(r.image, r.n) for r in w.gated(df, "image", "score", ["n"], 0.5).collect()} == {(1, 1), (1, 2), (2, 2), (3, 1)}


@pytest.mark.parametrize("band", [1, 7, 64])
def test_mosaic_equals_slicing(spark, band):
    r = np.random.default_rng(4)
    side, across, down = 16, 6, 5
    world = r.integers(0, 256, (down * side, across * side, 3), dtype=np.uint8)
    gone = {(2, 1), (4, 3)}
    tiles = [(x, y, world[y * side : (y + 1) * side, x * side : (x + 1) * side].tobytes()) for x in range(across) for y in range(down) if (x, y) not in gone]
    tiles += [(4, 3, b"short"), (*tiles[0][:2], b"\xff" * (side * side * 3))]  # a broken one, and one that comes twice
    for x, y in gone:
        world[y * side : (y + 1) * side, x * side : (x + 1) * side] = 77
    outside = np.full((down * side + 80, across * side + 80, 3), 77, np.uint8)
    outside[40:-40, 40:-40] = world
    crops = [(i, int(r.integers(-20, 80)), int(r.integers(-20, 70)), int(r.integers(1, 40)), int(r.integers(1, 40))) for i in range(25)] + [(99, 0, 0, 0, 5)]
    got = w.mosaic(spark.createDataFrame(crops, "id int, left int, top int, width int, height int"), spark.createDataFrame(tiles, "tile_x int, tile_y int, pixels binary"), "id", band=band, fill=77, side=side).collect()
    for i, left, top, wide, high in crops[:-1]:
        rows = sorted((b for b in got if b.id == i), key=lambda b: b.y0)
        assert [b.y0 for b in rows] == list(range(0, high, band)) and sum(b.height for b in rows) == high and {b.width for b in rows} == {wide}
        picture = np.frombuffer(b"".join(bytes(b.pixels) for b in rows), np.uint8).reshape(high, wide, 3)
        assert (picture == outside[top + 40 : top + 40 + high, left + 40 : left + 40 + wide]).all()
    assert not any(b.id == 99 for b in got) and any(b.missing for b in got)


def test_bands_are_laid_out_without_a_call_each(spark):
    """Bands whose strips come in several batches, and keys that are null; no group is a Python call of its own."""
    crops = spark.createDataFrame([(None if i == 7 else f"c{i:03}", i % 5 - 2, -3, 9 + i % 3, 11) for i in range(60)], "id string, left int, top int, width int, height int")
    tiles = spark.createDataFrame([(x, y, bytes((x * 50 + y * 20 + k) % 256 for k in range(16))) for x in range(4) for y in range(3) if (x, y) != (1, 1)], "tile_x int, tile_y int, pixels binary")
    made = lambda: w.mosaic(crops, tiles, "id", channels=1, band=4, fill=9, side=4)
    assert "FlatMapGroups" not in made()._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, made().collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, made().collect()), key=str) == whole and len(whole) == 180
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_crop_corner(spark):
    rows = spark.createDataFrame([(1000.0, 700.0, 512), (1000.25, 699.5, 511), (255.5, 0.0, 1)], "x double, y double, size int")
    got = [tuple(r) for r in rows.select(*w.crop_box(F.col("x"), F.col("y"), F.col("size"))).collect()]

    def plain(v, size):
        low = v - size / 2
        tile = low // 256
        return int(tile * 256 + round(low - tile * 256))

    assert got == [(plain(x, s), plain(y, s)) for x, y, s in [(1000.0, 700.0, 512), (1000.25, 699.5, 511), (255.5, 0.0, 1)]]


def test_fingerprint_is_one_for_any_order_of_keys(spark):
    r = random.Random(2)

    def shuffled(value):
        import json

        if isinstance(value, dict):
            items = list(value.items())
            r.shuffle(items)
            return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=r.random() < 0.5)}: {shuffled(v)}" for k, v in items) + "}"
        return "[" + ",".join(map(shuffled, value)) + "]" if isinstance(value, list) else json.dumps(value)

    value = {"b": [1, {"z": None, "é": "x\"\\\n", "a": True}], "a": {"k2": 0.5, "k1": [], "k10": {}}, "": -7}
    rows = [(shuffled(value),) for _ in range(20)] + [(shuffled(value | {"a": 1}),), ("not json",), (None,)]
    got = [x.f for x in spark.createDataFrame(rows, "j string").select(text.json_fingerprint(F.col("j")).alias("f")).collect()]
    assert len(set(got[:20])) == 1 and len(got[0]) == 12 and got[20] != got[0] and got[21:] == [None, None]
