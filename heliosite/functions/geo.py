"""Map geometry as column expressions (WGS84 degrees, Web-Mercator pixels)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in metres, equatorial metres a pixel at zoom 0, Mercator latitude limit, metres a degree.
EARTH_M = 6371008.8
MPP_ZOOM0 = 156543.03392804097
MAX_LATITUDE = 85.05112878
METRES_A_DEGREE = 111320.0
TILE = 256


def once(value: Column, made) -> Column:
    """``made`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.atan2(F.sqrt(half), F.sqrt(1 - half)) * (2 * EARTH_M)


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """The point on a sphere of radius 1."""
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def metres_per_pixel(lat: Column, zoom: int, zoom0: float = MPP_ZOOM0) -> Column:
    return F.cos(F.radians(lat)) * zoom0 / float(2**zoom)


def to_pixel(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    size = float(TILE * 2**zoom)
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))))
    return (lon + 180.0) / 360.0 * size, (0.5 - F.ln((1 + s) / (1 - s)) / (4 * math.pi)) * size


def from_pixel(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    size = float(TILE * 2**zoom)
    return x / size * 360.0 - 180.0, F.degrees(F.atan(F.sinh((1 - 2 * y / size) * math.pi)))


def from_pixel_clamped(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """The exponential form; latitudes beyond the projection's limit are cut to it."""
    size = float(TILE * 2**zoom)
    lat = 90.0 - F.atan(F.exp((y / size - 0.5) * (2 * math.pi))) * (360.0 / math.pi)
    return x / size * 360.0 - 180.0, F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    radius = 6378137.0
    return F.radians(lon) * radius, F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * radius


def offset_point(lon: Column, lat: Column, dx_m: Column, dy_m: Column) -> tuple[Column, Column]:
    return lon + dx_m / (F.cos(F.radians(lat)) * METRES_A_DEGREE), lat + dy_m / METRES_A_DEGREE


def map_size(lat: Column, radius_m: float, zoom: int, most: int = 4096, least: int = 1024) -> Column:
    """Pixels for a square map of ``radius_m``; the maximum wins over the minimum."""
    wide = F.ceil(2 * radius_m / metres_per_pixel(lat, zoom))
    return F.least(F.greatest(wide, F.lit(least)), F.lit(most)).cast("long")


def area_m2(pixels: Column, mpp: Column) -> Column:
    return pixels * mpp * mpp


def in_box(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Inclusive; null or NaN is outside."""
    return F.coalesce(lon.between(west, east) & lat.between(south, north) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def _wave(x: Column, *terms: tuple[float, float]) -> Column:
    """Sum of amplitude * sin(x * pi * factor)."""
    return sum((F.sin(x * (math.pi * f)) * a for a, f in terms), F.lit(0.0))


def gcj02_to_wgs84(lon: Column, lat: Column) -> tuple[Column, Column]:
    """One inverse step of the datum shift; points outside the shifted region stay."""
    axis, ee = 6378245.0, 0.00669342162296594323  # fixed values of the datum
    x, y = lon - 105.0, lat - 35.0
    shared = _wave(x, (20.0, 6.0), (20.0, 2.0))
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + (shared + _wave(y, (20.0, 1.0), (40.0, 1 / 3), (160.0, 1 / 12), (320.0, 1 / 30))) * 2.0 / 3.0
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + (shared + _wave(x, (20.0, 1.0), (40.0, 1 / 3), (150.0, 1 / 12), (300.0, 1 / 30))) * 2.0 / 3.0
    w = 1 - ee * F.pow(F.sin(F.radians(lat)), 2)
    d_lat = F.degrees(north) * w * F.sqrt(w) / (axis * (1 - ee))
    d_lon = F.degrees(east) * F.sqrt(w) / (axis * F.cos(F.radians(lat)))
    shifted = (lon > 73.66) & (lon < 135.05) & (lat > 3.86) & (lat < 53.55)
    return F.when(shifted, lon - d_lon).otherwise(lon), F.when(shifted, lat - d_lat).otherwise(lat)


def bd09_to_gcj02(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lon - 0.0065, lat - 0.006
    radius = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * math.pi)
    angle = F.atan2(y, x) - 0.000003 * F.cos(x * math.pi)
    return radius * F.cos(angle), radius * F.sin(angle)


def bd09_to_wgs84(lon: Column, lat: Column) -> tuple[Column, Column]:
    return gcj02_to_wgs84(*bd09_to_gcj02(lon, lat))


def window_starts(size: Column, window: int, stride: int) -> Column:
    """Starts of windows along one axis; the last touches the far edge; one at 0 if the axis is no longer than a window."""
    last = (size - window).cast("int")
    return F.when(size <= window, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))


def windows(width: Column, height: Column, window: int, stride: int) -> Column:
    """Array of (x, y): rows from top to bottom, each from left to right."""
    xs, ys = window_starts(width, window, stride), window_starts(height, window, stride)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def _grid(steps: Column, keep) -> Column:
    return F.filter(once(steps, lambda s: F.flatten(F.transform(s, lambda y: F.transform(s, lambda x: F.struct(x.alias("dx"), y.alias("dy")))))), keep)


def _far(p: Column) -> Column:
    return F.sqrt(p["dx"] * p["dx"] + p["dy"] * p["dy"])


def _nearest(offsets: Column, *ties) -> Column:
    """Offsets by distance (to a micrometre, so that equal ones are equal), then ``ties``, dx, dy."""
    keyed = F.transform(offsets, lambda p: F.struct(F.round(_far(p), 6).alias("d"), *[t(p).alias(f"t{i}") for i, t in enumerate(ties)], p["dx"].alias("dx"), p["dy"].alias("dy")))
    return F.transform(F.sort_array(keyed), lambda p: F.struct(p["dx"].alias("dx"), p["dy"].alias("dy"), p["d"].alias("distance")))


def buffer_tiles(radius_m: float, tile_px: int, overlap_px: int, mpp: Column) -> Column:
    """Tile centre offsets in metres whose square can touch the circle, by distance, then dx, dy."""
    stride, half = (tile_px - overlap_px) * mpp, tile_px * mpp / 2
    n = F.ceil((radius_m + half) / stride).cast("int")
    steps = F.transform(F.sequence(-n, n), lambda i: i * stride)
    return _nearest(_grid(steps, lambda p: _far(p) <= radius_m + half * math.sqrt(2)))


def sample_offsets(radius_m: float, most: int) -> Column:
    """The first ``most`` grid offsets within the radius, nearest first."""
    step = max(radius_m / 2, 250.0)
    n = int(radius_m // step)
    steps = F.array(*[F.lit(i * step) for i in range(-n, n + 1)])
    return F.slice(_nearest(_grid(steps, lambda p: _far(p) <= radius_m + 1e-6), lambda p: F.abs(p["dx"]) + F.abs(p["dy"])), 1, max(most, 0))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centroid of an open ring of struct(x, y): the vertex mean if it has under three or no area."""
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.transform(F.arrays_zip(ring.alias("a"), nxt.alias("b")), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]).alias("c")))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / n

    def middle(k: str) -> Column:
        add = lambda es, f: F.aggregate(es, F.lit(0.0), lambda s, e: s + f(e))
        weighed = lambda es, twice: F.when((n < 3) | (F.abs(twice / 2) < 1e-6), mean(k)).otherwise(add(es, lambda e: (e["a"][k] + e["b"][k]) * e["c"]) / (3 * twice))
        return once(edges, lambda es: once(add(es, lambda e: e["c"]), lambda twice: weighed(es, twice)))

    return middle("x"), middle("y")


def tile_cover(lon: Column, lat: Column, size_px: int, zoom: int) -> Column:
    """Array of (tile_x, tile_y) of the map tiles under a square crop around a point; columns wrap, rows beyond the map are cut."""
    x, y = to_pixel(lon, lat, zoom)
    first = lambda v: F.floor((v - size_px / 2) / 256).cast("long")
    last = lambda v: F.floor((v + size_px / 2 - 1) / 256).cast("long")
    columns = F.sequence(first(x), last(x))
    lines = F.sequence(F.greatest(first(y), F.lit(0)), F.least(last(y), F.lit(2**zoom - 1)))
    return F.flatten(F.transform(columns, lambda i: F.transform(lines, lambda j: F.struct(F.pmod(i, F.lit(2**zoom)).alias("tile_x"), j.alias("tile_y")))))


# Boxes (west, south, east, north) of the regions that have one.
REGIONS = {"上海": (120.85, 30.67, 122.15, 31.87), "浙江": (118.0, 27.0, 123.2, 31.6)}


def in_region(lon: Column, lat: Column, region: Column, boxes: dict[str, tuple[float, ...]] = REGIONS) -> Column:
    """Inside the box of a region, whose name may end in its kind; a region without a box holds every point, no region a null one."""
    short = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(region, F.lit(""))), "省$", ""), "市$", "")
    inside = F.lit(True)
    for name, box in boxes.items():
        inside = F.when(short == name, in_box(lon, lat, *[F.lit(x) for x in box])).otherwise(inside)
    return F.when(lon.isNull() | lat.isNull(), F.lit(False)).otherwise(inside)


def needs_repair(lon: Column, lat: Column, box: tuple[float, ...] = REGIONS["上海"]) -> Column:
    """Coordinates as text that can't be read or lie outside ``box``."""
    return ~in_box(lon.try_cast("double"), lat.try_cast("double"), *[F.lit(x) for x in box])


def marker(lon0: Column, lat0: Column, lon: Column, lat: Column, zoom: int, size: int, margin: int) -> Column:
    """struct(x, y, x_pct, y_pct, visible) of a point on a square map around another."""
    (x0, y0), (x1, y1) = to_pixel(lon0, lat0, zoom), to_pixel(lon, lat, zoom)
    x, y = x1 - x0 + size / 2, y1 - y0 + size / 2
    seen = x.between(-margin, size + margin) & y.between(-margin, size + margin)
    return F.struct(x.alias("x"), y.alias("y"), (x / size * 100).alias("x_pct"), (y / size * 100).alias("y_pct"), seen.alias("visible"))


def clicked(lon0: Column, lat0: Column, x: Column, y: Column, zoom: int, size: int) -> tuple[Column, Column]:
    """The point under pixel (x, y) of a square map around (lon0, lat0)."""
    x0, y0 = to_pixel(lon0, lat0, zoom)
    return from_pixel_clamped(x0 + x - size / 2, y0 + y - size / 2, zoom)


def _box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(*[v.cast("int").alias(n) for n, v in (("left", left), ("top", top), ("right", right), ("bottom", bottom))])


def _shorter(width: Column, height: Column, ratio: float) -> Column:
    return F.floor(F.least(width, height) * F.lit(ratio)).cast("int")


def _half(value: Column) -> Column:
    return F.floor(value / 2).cast("int")


def crop_boxes(width: Column, height: Column) -> Column:
    """Seven named boxes: the whole, the middle 70 %, four corners and the middle of 50 %."""

    def cut(name: str, left: Column, top: Column, size: Column) -> Column:
        x, y = F.greatest(F.lit(0), F.least(left, width - 1)), F.greatest(F.lit(0), F.least(top, height - 1))
        return F.struct(F.lit(name).alias("name"), _box(x, y, F.greatest(x + 1, F.least(left + size, width)), F.greatest(y + 1, F.least(top + size, height))).alias("box"))

    large, small, zero = _shorter(width, height, 0.70), _shorter(width, height, 0.50), F.lit(0)
    places = [("top_left", zero, zero), ("top_right", width - small, zero), ("center", _half(width - small), _half(height - small)), ("bottom_left", zero, height - small), ("bottom_right", width - small, height - small)]
    whole = F.struct(F.lit("full").alias("name"), _box(zero, zero, width, height).alias("box"))
    return F.array(whole, cut("center_70", _half(width - large), _half(height - large), large), *[cut(n, x, y, small) for n, x, y in places])


def view_boxes(width: Column, height: Column) -> Column:
    """Seven named boxes: the whole, the middle 80 and 60 %, and four corners of 62 %."""

    def at(name: str, ratio: float, right: float, low: float) -> Column:
        size = _shorter(width, height, ratio)
        left, top = (F.floor((side - size) * share).cast("int") for side, share in ((width, right), (height, low)))
        return F.struct(F.lit(name).alias("name"), _box(left, top, left + size, top + size).alias("box"))

    whole = F.struct(F.lit("full").alias("name"), _box(F.lit(0), F.lit(0), width, height).alias("box"))
    corners = [(f"{v}_{h}", 0.62, float(h == "right"), float(v == "bottom")) for v in ("top", "bottom") for h in ("left", "right")]
    return F.array(whole, at("center_80", 0.80, 0.5, 0.5), at("center_60", 0.60, 0.5, 0.5), *[at(*c) for c in corners])


def center_box(width: Column, height: Column, size: int) -> Column:
    side = F.least(F.lit(size), width, height)
    left, top = _half(width - side), _half(height - side)
    return _box(left, top, left + side, top + side)


def padded_box(left: Column, top: Column, wide: Column, high: Column, width: Column, height: Column, ratio: float = 0.0, pixels: int = 0) -> Column:
    """A box with a margin on each side, cut to the image. ``ratio`` is of the box's own sides; halves go to even numbers."""
    x, y = F.bround(wide * ratio, 0) + pixels, F.bround(high * ratio, 0) + pixels
    zero = F.lit(0)
    return _box(F.greatest(zero, left - x), F.greatest(zero, top - y), F.least(width, left + wide + x), F.least(height, top + high + y))
