"""Bound queries: a screening run that is stopped and resumed, window merges, mosaics, fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from heliosite.operators import screening
from heliosite.plans.bindings import bound, site, table
from heliosite.sources.commits import Store
from heliosite.sources.shared import shared_dir

_DETECTED = """select o_custkey as mall_id, max(o_orderkey) as k, sum(o_orderkey % 997)::bigint as pv_px, floor(sum(o_totalprice) * 2 + 0.25)::bigint as roof_px, count(*) as candidates, max(o_orderkey) % 1500 as self_px from orders group by 1"""
_SITES = "(select c_custkey as id, c_name as name, 30.67::double + ((c_custkey * 104729) % 1200) / 1000.0::double as lat, case c_custkey % 4 when 0 then ' a' when 1 then 'B' when 2 then 'C' else 'A' end as level from customer)"


@bound(f"""with d as ({_DETECTED}), s as (select * from {_SITES} where upper(trim(level)) in ('A', 'B')),
b as (select *, coalesce(k % 13 <> 0, false) as ok, cos(radians(lat)) * 156543.03392804097::double / 262144::double as mpp from s left join d on mall_id = id),
c as (select *, round(roof_px * mpp * mpp, 2) as roof_m2, case when pv_px >= 400 then case when k % 3 = 0 then 'likely_pv' else 'possible_pv' end else 'no_clear_pv' end as pv, self_px / 250000.0::double as cover from b),
e as (select *, (least(1.0::double, roof_m2 / 25000::double) + least(1.0::double, candidates / 10.0::double)) / 2 as score from c)
select id as mall_id, case when ok then 'ok' else 'error' end as image_status, ok::int as downloaded_tile_count, case when ok then roof_m2 end as roof_area_m2_est, case when ok then round(pv_px * mpp * mpp, 2) end as existing_pv_area_m2_est,
case when ok then (pv <> 'no_clear_pv')::int end as existing_pv_tile_count, case when ok then score end as install_condition_score,
case when not ok then 'unknown' when score >= 0.6 and roof_m2 >= 20000 then 'high' when score >= 0.3 and roof_m2 >= 8000 then 'medium' when roof_m2 >= 3000 then 'low' else 'not_obvious' end as install_condition_level,
case when not ok then 'not_checked' when self_px >= 1000 and cover >= 0.001 then 'likely_pv' when self_px >= 500 then 'possible_pv' else 'no_clear_pv' end as self_status,
case when ok then pv else 'not_checked' end as map_status, case when ok then '' when k is null then 'no detection' else 'map was cut off' end as error from e""")
def screening_run(spark, sf_dir):
    """Customers as sites, their orders as recorded detections; the run is stopped after one batch, then resumed in larger ones."""
    k = F.col("id")
    level = F.when(k % 4 == 0, " a").when(k % 4 == 1, "B").when(k % 4 == 2, "C").otherwise("A")
    centers = site(spark, sf_dir).select(k.alias("mall_id"), "name", level.alias("confidence_level"), F.col("lon").alias("center_lon"), F.col("lat").alias("center_lat"), F.lit("official_poi_auto").alias("center_source"))
    of = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("mall_id")).agg(
        F.max("o_orderkey").alias("k"), F.sum(F.col("o_orderkey") % 997).alias("pv_area_px"), F.floor(F.sum("o_totalprice") * 2 + 0.25).alias("roof_area_px"), F.count("*").alias("roof_candidate_count"),
    )
    given = {
        "pv_status": F.when(F.col("k") % 3 == 0, "likely_pv").otherwise("possible_pv"), "self_area_px": F.col("k") % 1500, "self_box_px": F.lit(250_000), "error": F.when(F.col("k") % 13 == 0, "map was cut off"),
        **{c: F.col(c) for c in ("mall_id", "pv_area_px", "roof_area_px", "roof_candidate_count")},
    }
    wanted = spark.createDataFrame([], screening.DETECTION).schema
    detections = of.select([given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    store, p = Store(spark, shared_dir(spark)), screening.ScreenParams("20240101_000000")
    n = centers.count()
    screening.run(store, centers, detections, p, max(1, n // 5), most=1)
    screening.run(store, centers, detections, p, max(1, n // 2))
    out = screening.results(store)
    summary = out["summary"].select("mall_id", "image_status", "downloaded_tile_count", "roof_area_m2_est", "existing_pv_area_m2_est", "existing_pv_tile_count", "install_condition_score", "install_condition_level", "error")
    return summary.join(out["self"].select("mall_id", F.col("pv_status").alias("self_status")), "mall_id").join(out["detail"].select("mall_id", F.col("pv_status").alias("map_status")), "mall_id")


_WINDOWS = "(select l_orderkey as image, (l_linenumber * 5 % 17)::bigint as x0, (l_linenumber * 3 % 7)::bigint as y0, l_partkey, l_suppkey, (l_quantity % 10) / 10.0::double as score, l_linenumber from lineitem)"


@bound(f"""with w as {_WINDOWS}, g as (select *, max(score) over (partition by image) as best, row_number() over (partition by image order by score desc, l_linenumber, l_partkey, l_suppkey) as n from w),
cells as (select image, y0 + i // 8 as y, x0 + i % 8 as x, (l_partkey * (i + 1) + l_suppkey) % 251 / 250.0::double as v from g, range(48) r(i) where score >= 0.45 or (best < 0.45 and n = 1)),
top as (select image, y, x, max(v) as v from cells group by all)
select image, y, x // 4 * 4 as x0, count(*) as covered, sum(v) as total, max(v) as most from top group by all""")
def window_merge(spark, sf_dir):
    """Lines of orders as scored windows of 8 x 6 pixels over an image an order; windows of low score are left out, overlaps keep the largest value."""
    from heliosite.operators import windows

    rows = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    values = F.transform(F.sequence(F.lit(1), F.lit(48)), lambda i: (F.col("l_partkey") * i + F.col("l_suppkey")) % 251 / 250.0)
    made = rows.select(F.col("l_orderkey").alias("image"), (n * 5 % 17).cast("long").alias("x0"), (n * 3 % 7).cast("long").alias("y0"), F.lit(8).alias("width"), (F.col("l_quantity") % 10 / 10.0).alias("score"), "l_linenumber", "l_partkey", "l_suppkey", values.alias("values"))
    merged = windows.max_merged(windows.gated(made, "image", "score", ["l_linenumber", "l_partkey", "l_suppkey"], 0.45), "image", 4)
    there = F.filter("values", lambda v: v.isNotNull())
    return merged.select("image", "y", "x0", F.size(there).cast("long").alias("covered"), F.aggregate(there, F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max(there).alias("most"))


_TILES = "(select distinct p_partkey % 40 as tile_x, p_partkey // 40 % 25 as tile_y from part where p_partkey % 7 <> 3)"


@F.arrow_udf(LongType())
def _weighed(pixels: pa.Array, width: pa.Array) -> pa.Array:
    """Sums of bytes weighted by their row and column."""
    pixels = pixels.cast(pa.large_binary())
    ends = np.frombuffer(pixels.buffers()[1], np.int64)[pixels.offset : pixels.offset + len(pixels) + 1]
    data, lengths = np.frombuffer(pixels.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int64), np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], lengths)
    row, column = np.divmod(place, np.repeat(width.to_numpy(zero_copy_only=False), lengths))
    sums = np.r_[0, np.cumsum(data * (1 + (row * 31 + column) % 17))]
    return pa.array(sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]], pa.int64())


@bound(f"""with crops as (select o_orderkey as id, o_orderkey * 37 % 280 as l, o_custkey * 11 % 170 as t, 5 + o_orderkey % 13 as w, 3 + o_custkey % 9 as h from orders),
px as (select id, l + i % w as x, t + i // w as y, i // w // 4 * 4 as y0, i // w - i // w // 4 * 4 as yy, i % w as xx, h from crops, unnest(range(w * h)) u(i)),
met as (select p.*, case when tile_x is null then 9 else (p.x * 3 + p.y * 5 + p.x // 8 * 31) % 251 end as v, tile_x is null as gone, x // 8 as tx, y // 8 as ty from px p left join {_TILES} on tile_x = x // 8 and tile_y = y // 8)
select id, y0, least(4, h - y0)::int as height, (max(xx) + 1)::bigint as width, count(distinct case when gone then tx * 1000 + ty end)::int as missing, sum(v * (1 + (yy * 31 + xx) % 17))::bigint as total from met group by id, y0, h""")
def tile_mosaic(spark, sf_dir):
    """Orders as crops of a map of small tiles, of which some are missing; bands of four rows, digested by weighted sums of their bytes."""
    from heliosite.operators import windows

    k, m = F.col("o_orderkey"), F.col("o_custkey")
    crops = table(spark, sf_dir, "orders").select(k.alias("id"), (k * 37 % 280).alias("left"), (m * 11 % 170).alias("top"), (5 + k % 13).alias("width"), (3 + m % 9).alias("height"))
    part = F.col("p_partkey")
    places = table(spark, sf_dir, "part").where(part % 7 != 3).select((part % 40).alias("tile_x"), (F.floor(part / 40) % 25).alias("tile_y")).distinct()
    byte = lambda i: ((F.col("tile_x") * 8 + i % 8) * 3 + (F.col("tile_y") * 8 + F.floor(i / 8)) * 5 + F.col("tile_x") * 31) % 251
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))
    bands = windows.mosaic(crops, places.withColumn("pixels", pixels), "id", channels=1, band=4, fill=9, side=8)
    return bands.select("id", "y0", "height", "width", "missing", _weighed("pixels", "width").alias("total"))


@bound("""select event_id, substr(sha1('{"k":' || coalesce(json_extract_string(props, '$.k'), 'null') || ',"of":{"a":[' || event_id || ',"' || event_type || '"],"b":' || (event_id % 2 = 0)::varchar || '},"user":' || user_id || '}'), 1, 12) as fingerprint from events""")
def fingerprints(spark, sf_dir):
    """Nested values whose keys come in two orders and spacings have one fingerprint."""
    from heliosite.functions import text

    k = F.get_json_object("props", "$.k")
    even = (F.col("event_id") % 2 == 0).cast("string")
    one = F.concat(F.lit('{"user": '), "user_id", F.lit(', "of": {"b": '), even, F.lit(', "a": ['), "event_id", F.lit(', "'), "event_type", F.lit('"]}, "k": '), F.coalesce(k, F.lit("null")), F.lit("}"))
    other = F.concat(F.lit('{"k":'), F.coalesce(k, F.lit("null")), F.lit(' , "of":{"a":['), "event_id", F.lit(',"'), "event_type", F.lit('"],"b":'), even, F.lit('},"user":'), "user_id", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", text.json_fingerprint(F.when(F.col("user_id") % 2 == 0, one).otherwise(other)).alias("fingerprint"))
