"""Overlapping windows and tiles of images as rows: merges and mosaics in which no whole image meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliosite.functions.geo import TILE

SEGMENT = 32
BAND = 64
CHUNK = 2**22


def gated(windows: DataFrame, image: str, score: str, order: list[str], least: float) -> DataFrame:
    """The windows of ``least`` score; of an image without any, its best one, the first in ``order`` of equal ones."""
    best = F.max(score).over(Window.partitionBy(image))
    first = F.row_number().over(Window.partitionBy(image).orderBy(F.desc(score), *order))
    marked = windows.withColumns({"_best": best, "_first": first})
    return marked.where((F.col(score) >= least) | ((F.col("_best") < least) & (F.col("_first") == 1))).drop("_best", "_first")


def max_merged(windows: DataFrame, image: str, segment: int = SEGMENT) -> DataFrame:
    """(image, y, x0, values): the largest value at each pixel over windows (image, x0, y0, width, values), a row for ``segment`` pixels of an image row.

    A window's rows are cut at multiples of ``segment``, and a segment's pixels are as many maxima of one aggregation, so a task sends one row for each
    segment that it has seen, however many windows cover it. Pixels that no window covers are null; a null value covers nothing.
    """
    rows = windows.where((F.col("width") > 0) & (F.size("values") > 0))
    y = F.explode(F.sequence(F.lit(0), F.ceil(F.size("values") / F.col("width")).cast("int") - 1))
    rows = rows.select(image, F.col("x0").cast("long").alias("left"), F.col("y0").cast("long").alias("top"), F.col("width").cast("int").alias("width"), "values", y.alias("row"))
    rows = rows.select(image, "left", (F.col("top") + F.col("row")).alias("y"), F.slice("values", F.col("row") * F.col("width") + 1, F.col("width")).alias("line"))
    low, high = F.floor(F.col("left") / segment), F.floor((F.col("left") + F.size("line") - 1) / segment)
    parts = rows.select(image, "y", "left", "line", F.explode(F.sequence(low, high)).alias("part"))
    at = (F.col("part") * segment - F.col("left")).cast("int")  # where the segment begins in the line, from 0; before it for the first
    cells = [F.max(F.get("line", at + i)).alias(f"_{i}") for i in range(segment)]
    merged = parts.groupBy(image, "y", "part").agg(*cells)
    return merged.select(image, "y", (F.col("part") * segment).alias("x0"), F.array(*[F.col(f"_{i}") for i in range(segment)]).alias("values"))


def mosaic(crops: DataFrame, tiles: DataFrame, crop: str, channels: int = 3, band: int = BAND, fill: int = 0, side: int = TILE) -> DataFrame:
    """(crop, y0, height, width, missing, pixels) of each ``band`` rows of each crop, cut from ``tiles`` (tile_x, tile_y, pixels).

    ``crops``: left, top, width, height in pixels of the whole map. Each crop asks for the strips of the tiles that cover it: what one tile gives to one
    band, which is all that is shuffled. A band's strips are laid out by their places, so their order doesn't matter. Pixels of a tile that isn't there,
    or isn't of ``side`` x ``side`` x ``channels`` bytes, are ``fill``; ``missing`` counts such tiles in the band. Of tiles that repeat, the one with the smallest bytes counts.
    """
    c = F.col
    boxes = crops.where((c("width") > 0) & (c("height") > 0)).select(crop, *[c(x).cast("long").alias(x) for x in ("left", "top", "width", "height")])
    bands = boxes.select("*", F.explode(F.sequence(F.lit(0), F.floor((c("height") - 1) / band))).alias("band"))
    bands = bands.select(crop, "left", "width", (c("band") * band).alias("y0"), F.least(F.lit(band), c("height") - c("band") * band).cast("int").alias("rows"), (c("top") + c("band") * band).alias("top"))
    tile = lambda at: F.floor(at / side)
    wanted = bands.withColumn("tile_x", F.explode(F.sequence(tile(c("left")), tile(c("left") + c("width") - 1)))).withColumn("tile_y", F.explode(F.sequence(tile(c("top")), tile(c("top") + c("rows") - 1))))
    # not a filter, which would be pushed down to where the pixels' rows repeat
    whole = F.when(F.octet_length("pixels") == side * side * channels, c("pixels"))
    have = tiles.groupBy("tile_x", "tile_y").agg(F.min(whole).alias("pixels"))
    met = wanted.join(have, ["tile_x", "tile_y"], "left")
    # rows of the tile that the band needs, whole; columns are cut where they are laid out
    first = F.greatest(c("top") - c("tile_y") * side, F.lit(0))
    last = F.least(c("top") + c("rows") - c("tile_y") * side, F.lit(side))
    line = side * channels
    strip = F.expr(f"substring(pixels, cast(_first * {line} + 1 as int), cast((_last - _first) * {line} as int))")
    at = (c("tile_y") * side + c("_first") - c("top")).cast("int")
    strips = met.withColumns({"_first": first, "_last": last}).select(crop, "y0", "rows", "width", (c("tile_x") * side - c("left")).alias("x"), at.alias("at"), (c("_last") - c("_first")).cast("int").alias("tall"), strip.alias("strip"))
    key = crops.schema[crop].dataType.simpleString()
    schema = f"`{crop}` {key}, y0 long, height int, width long, missing int, pixels binary"
    laid = lambda batches: _laid(batches, crop, side, channels, fill)
    return strips.repartition(crop, "y0").sortWithinPartitions(crop, "y0").mapInArrow(laid, schema)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """At which rows after the first the value isn't the one before; nulls are alike."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def _laid(batches: Iterator[pa.RecordBatch], crop: str, side: int, channels: int, fill: int) -> Iterator[pa.RecordBatch]:
    """Bands from their strips in order; the last band of a batch waits for what the next one brings."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        starts = np.r_[0, 1 + np.flatnonzero(_changes(table[crop]) | _changes(table["y0"]))]
        yield from _bands(table, starts[:-1], starts[-1], crop, side, channels, fill)
        held = table.slice(starts[-1])
    if held is not None:
        yield from _bands(held, np.array([0]), len(held), crop, side, channels, fill)


def _bands(table: pa.Table, starts: np.ndarray, end: int, crop: str, side: int, channels: int, fill: int) -> Iterator[pa.RecordBatch]:
    """The bands that begin at ``starts``, as many at a time as come to ``CHUNK`` bytes, at least one."""
    ends = np.r_[starts[1:], end].astype(np.int64)
    heads = table.take(pa.array(starts, pa.int64()))
    sizes = heads["rows"].to_numpy().astype(np.int64) * heads["width"].to_numpy() * channels
    i = 0
    while i < len(starts):
        j = i + max(1, int(np.searchsorted(np.cumsum(sizes[i:]), CHUNK, "right")))
        yield _layout(table.slice(starts[i], ends[j - 1] - starts[i]), heads.slice(i, j - i), ends[i:j] - starts[i:j], sizes[i:j], crop, side, channels, fill)
        i = j


def _layout(strips: pa.Table, heads: pa.Table, counts: np.ndarray, sizes: np.ndarray, crop: str, side: int, channels: int, fill: int) -> pa.RecordBatch:
    """Bands side by side in one buffer; lines of strips are copied into it by their places."""
    n, of = len(heads), np.repeat(np.arange(len(heads)), counts)
    begins = np.r_[0, np.cumsum(sizes)]
    out = np.full(begins[-1], fill, np.uint8)
    strip = strips["strip"].combine_chunks().cast(pa.large_binary())
    there = strip.is_valid().to_numpy(zero_copy_only=False)
    missing = np.bincount(of[~there], minlength=n)
    data = np.frombuffer(strip.buffers()[2] or b"", np.uint8)
    offset = np.frombuffer(strip.buffers()[1], np.int64)[strip.offset : strip.offset + len(strip)]
    x, at, tall = (strips[name].to_numpy().astype(np.int64)[there] for name in ("x", "at", "tall"))
    of, offset, wide = of[there], offset[there], heads["width"].to_numpy()
    low, high = np.maximum(x, 0), np.minimum(x + side, wide[of])
    line = _ranges(tall)
    source = np.repeat(offset + (low - x) * channels, tall) + line * (side * channels)
    target = np.repeat(begins[of] + (at * wide[of] + low) * channels, tall) + line * np.repeat(wide[of] * channels, tall)
    length = np.repeat((high - low) * channels, tall)
    byte = _ranges(length)
    out[np.repeat(target, length) + byte] = data[np.repeat(source, length) + byte]
    pixels = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(out)])
    columns = [heads[crop].combine_chunks(), heads["y0"].combine_chunks(), heads["rows"].combine_chunks(), heads["width"].combine_chunks(), pa.array(missing, pa.int32()), pixels]
    return pa.RecordBatch.from_arrays(columns, names=[crop, "y0", "height", "width", "missing", "pixels"])


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length, joined."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def crop_box(x: Column, y: Column, size: Column) -> tuple[Column, Column]:
    """(left, top) of a square crop about a point of the map: the corner is rounded half to even, as an offset into the first tile that it touches."""
    corner = lambda v: F.floor((v - size / 2) / TILE) * TILE + F.bround((v - size / 2) - F.floor((v - size / 2) / TILE) * TILE).cast("long")
    return corner(x), corner(y)

