"""Bound queries: coverage reports, approved centers, tile roll-ups, fallbacks and notes, in the shape that users export."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliosite.functions import text
from heliosite.operators import places, relational, reviews
from heliosite.plans.bindings import SITE, bound, site, table


@bound("""select n_name as province, c_mktsegment as city, count(id) as mall_count, coalesce(sum(has_pv::int), 0)::bigint as suspected_pv_count, round_even(avg(confidence), 3) as avg_confidence, sum(has_pv::int) / count(id)::double as coverage_rate, round_even(sum(has_pv::int) / count(id)::double * 100, 2) as coverage_rate_pct
from (select case when c_custkey % 31 <> 0 then c_custkey end as id, case when c_custkey % 6 = 1 then null else c_nationkey end as nation, case when c_custkey % 17 <> 0 then c_mktsegment end as c_mktsegment, c_acctbal > 0 as has_pv, case when c_custkey % 5 <> 0 then c_acctbal / 10000 end as confidence from customer) left join nation on nation = n_nationkey group by 1, 2""")
def coverage_summary(spark, sf_dir):
    """Two keys, each with nulls: sites whose province isn't known are a group of each city."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 31 != 0, k).alias("id"), F.when(k % 6 != 1, F.col("c_nationkey")).alias("n_nationkey"), F.when(k % 17 != 0, F.col("c_mktsegment")).alias("city"), (F.col("c_acctbal") > 0).alias("has_pv"), F.when(k % 5 != 0, F.col("c_acctbal") / 10000).alias("confidence"),
    )
    named = rows.join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("province")), "n_nationkey", "left")
    return relational.coverage(named, ["province", "city"], "id", "has_pv", "confidence")


_MALLS = f"(select s.id as mall_id, s.name, 'p' || s.grp as province, case when s.id % 3 <> 0 then 'c' || s.provider end as city, (['A', 'B', 'C', null])[s.id % 4 + 1] as confidence_level, case when s.id % 7 <> 0 then s.lon end as lon, case when s.id % 11 <> 0 then s.lat end as lat, 'amap' as selected_provider, s.name || ' x' as selected_poi_name, 'strong' as official_coord_evidence from {SITE} s)"


@bound(f"""with r as (select o_custkey as mall_id, (['A', 'B', 'C', 'D'])[max(o_orderkey) % 4 + 1] as level, case when max(o_orderkey) % 5 <> 0 then max(o_totalprice) end as lon, case when max(o_orderkey) % 9 <> 0 then min(o_totalprice) end as lat, max(o_orderpriority) as reviewer, count(*) as review_round, max(o_orderkey)::varchar as reviewed_at from orders where o_custkey % 3 <> 1 group by 1)
select m.mall_id, name, province, city, coalesce(r.level, m.confidence_level) as confidence_level, case when r.level in ('A', 'B') then r.lon else m.lon end as center_lon, case when r.level in ('A', 'B') then r.lat else m.lat end as center_lat, case when r.level in ('A', 'B') then 'manual_review' else 'official_poi_auto' end as center_source,
reviewer, case when reviewer is not null then 'seen' end as reason, null::varchar as final_polygon_geojson, review_round, reviewed_at, selected_provider, selected_poi_name, official_coord_evidence
from {_MALLS} m left join r using (mall_id) where (r.level in ('A', 'B') and r.lon is not null and r.lat is not null) or (r.mall_id is null and m.confidence_level in ('A', 'B') and m.lon is not null and m.lat is not null)""")
def approved_export(spark, sf_dir):
    k = F.col("id")
    one_of = lambda n, *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))
    malls = site(spark, sf_dir).select(
        k.alias("mall_id"), "name", F.concat(F.lit("p"), F.col("grp").cast("string")).alias("province"), F.when(k % 3 != 0, F.concat(F.lit("c"), F.col("provider").cast("string"))).alias("city"), one_of(k, "A", "B", "C", None).alias("confidence_level"),
        F.when(k % 7 != 0, F.col("lon")).alias("approved_center_lon"), F.when(k % 11 != 0, F.col("lat")).alias("approved_center_lat"), F.lit("amap").alias("selected_provider"), F.concat("name", F.lit(" x")).alias("selected_poi_name"), F.lit("strong").alias("official_coord_evidence"),
    )
    last = F.max("o_orderkey")
    told = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 1").groupBy(F.col("o_custkey").alias("mall_id")).agg(
        one_of(last, "A", "B", "C", "D").alias("decision_level"), F.when(last % 5 != 0, F.max("o_totalprice")).alias("final_lon"), F.when(last % 9 != 0, F.min("o_totalprice")).alias("final_lat"), F.max("o_orderpriority").alias("reviewer"), F.count("*").alias("review_round"), last.cast("string").alias("reviewed_at"),
    )
    return reviews.approved(malls, told.withColumns({"reason": F.lit("seen"), "final_polygon_geojson": F.lit(None).cast("string")}))


@bound("""with t as (select l_orderkey as mall_id, l_tax < 0.06 as ok, l_linenumber % 4 as roof_components, l_extendedprice as roof_area_m2, (['possible_pv', 'no_clear_pv', 'likely_pv'])[l_partkey % 3 + 1] as pv_status, l_discount * 1000 as pv_area_m2, l_returnflag as method from lineitem),
r as (select mall_id, count(*) as tile_count, count(*) filter (ok) as downloaded_tile_count, count(*) filter (ok and roof_components > 0) as roof_candidate_tile_count, coalesce(sum(roof_components) filter (ok), 0)::bigint as roof_candidate_count, coalesce(sum(roof_area_m2) filter (ok), 0.0) as roof_area_m2,
count(*) filter (ok and pv_status <> 'no_clear_pv') as existing_pv_tile_count, coalesce(sum(pv_area_m2) filter (ok), 0.0) as existing_pv_area_m2, coalesce(string_agg(distinct method, '+' order by method) filter (ok), '') as methods from t group by 1),
s as (select *, least(1.0::double, roof_area_m2 / 50000.0::double * 0.75::double + least(roof_candidate_tile_count / tile_count::double, 1.0::double) * 0.25::double) as install_condition_score from r)
select *, case when downloaded_tile_count = 0 then 'unknown' when install_condition_score >= 0.6 and roof_area_m2 >= 20000 then 'high' when install_condition_score >= 0.3 and roof_area_m2 >= 8000 then 'medium' when roof_area_m2 >= 3000 then 'low' else 'not_obvious' end as install_condition_level from s""")
def tile_summary(spark, sf_dir):
    """Lines of orders as tiles, of which some weren't downloaded."""
    line = table(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(F.lit("possible_pv"), F.lit("no_clear_pv"), F.lit("likely_pv")), (F.col("l_partkey") % 3 + 1).cast("int"))
    tiles = line.select(F.col("l_orderkey").alias("mall_id"), (F.col("l_tax") < 0.06).alias("ok"), (F.col("l_linenumber") % 4).alias("roof_components"), F.col("l_extendedprice").alias("roof_area_m2"), status.alias("pv_status"), (F.col("l_discount") * 1000).alias("pv_area_m2"), F.col("l_returnflag").alias("method"))
    return places.rolled_tiles(tiles)


@bound("select what, n, row_number() over (order by n desc, first) as place from (select event_type || user_id % 40 as what, count(*) as n, min(event_id) as first from events group by 1)")
def frequency_in_order(spark, sf_dir):
    """Many kinds are equally frequent; those stand as they were first seen."""
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("what"), "event_id")
    return relational.ranked_frequency(rows, "what", "event_id")


@bound("""with a as (select o_custkey as k, case when count(*) % 2 = 0 then ' ' else 'ok' || count(*) end as image_status, case when count(*) % 3 = 0 then max(o_orderpriority) end as run_id from orders where o_orderstatus = 'O' group by 1),
b as (select o_custkey as k, 'later' || count(*) as image_status, max(o_orderstatus) as run_id from orders where o_orderstatus <> 'O' and o_custkey % 4 <> 0 group by 1)
select c_custkey, coalesce(nullif(trim(a.image_status), ''), nullif(trim(b.image_status), ''), 'missing_pv_output') as image_status, coalesce(nullif(trim(a.run_id), ''), nullif(trim(b.run_id), ''), '') as run_id, a.k is not null or b.k is not null as found from customer left join a on a.k = c_custkey left join b on b.k = c_custkey""")
def two_sided_lookup(spark, sf_dir):
    """A site's status and run from its own result, else from the potential's, column by column."""
    orders, n, key = table(spark, sf_dir, "orders"), F.count("*"), F.col("o_custkey").alias("c_custkey")
    own = orders.where("o_orderstatus = 'O'").groupBy(key).agg(F.when(n % 2 == 0, " ").otherwise(F.concat(F.lit("ok"), n.cast("string"))).alias("image_status"), F.when(n % 3 == 0, F.max("o_orderpriority")).alias("run_id"))
    other = orders.where("o_orderstatus <> 'O' and o_custkey % 4 <> 0").groupBy(key).agg(F.concat(F.lit("later"), n.cast("string")).alias("image_status"), F.max("o_orderstatus").alias("run_id"))
    return reviews.first_filled_of(table(spark, sf_dir, "customer").select("c_custkey"), [own, other], "c_custkey", {"image_status": "missing_pv_output", "run_id": ""})


@bound(f"""with c as (select o_custkey as site_id, o_orderpriority as provider, o_orderkey % 5 as rank, case when o_orderkey % 3 <> 0 then o_totalprice end as lon, case when o_orderkey % 4 <> 0 then o_totalprice / 2 end as lat, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey % 5, o_orderkey) as n from orders where o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0),
s as (select id as site_id, case when id % 4 <> 0 then lon end as lon, case when id % 5 <> 0 then lat end as lat from {SITE})
select site_id, case when (s.lon is null or s.lat is null) and c.lon is not null then c.lon else s.lon end as lon, case when (s.lon is null or s.lat is null) and c.lon is not null then c.lat else s.lat end as lat, (s.lon is null or s.lat is null) and c.lon is not null as derived from s left join c using (site_id) where coalesce(n, 1) = 1""")
def derived_centers(spark, sf_dir):
    k, o = F.col("id"), F.col("o_orderkey")
    rows = site(spark, sf_dir).select(k.alias("site_id"), F.when(k % 4 != 0, F.col("lon")).alias("lon"), F.when(k % 5 != 0, F.col("lat")).alias("lat"))
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site_id"), F.col("o_orderpriority").alias("provider"), (o % 5).alias("rank"), o.alias("seq"), F.when(o % 3 != 0, F.col("o_totalprice")).alias("lon"), F.when(o % 4 != 0, F.col("o_totalprice") / 2).alias("lat"))
    return places.fallback_center(rows, found)


@bound("""with c as (select o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as n, o_orderkey || ':' || coalesce(case when o_orderkey % 3 <> 0 then o_orderstatus end, 'pass') || ' pos=' || 'roof of ' || o_orderpriority || '(' || o_orderkey % 7 || ') neg=' || 'plaza' || '(' || coalesce((case when o_orderkey % 2 = 0 then o_orderkey % 5 end)::varchar, '') || ') d=' as note from orders)
select k, string_agg(note, '; ' order by n) filter (n <= 8) || case when max(n) > 8 then '; ...+' || (max(n) - 8) else '' end as notes from c group by k""")
def component_notes(spark, sf_dir):
    """Orders as roof components of a customer's map; beyond eight they are only counted."""
    o = F.col("o_orderkey")
    component = F.struct(
        o.alias("label_id"), F.when(o % 3 != 0, F.col("o_orderstatus")).alias("decision"), F.concat(F.lit("a satellite image of a commercial or industrial roof of "), "o_orderpriority").alias("positive"), (o % 7).alias("positive_score"),
        F.lit("a top-down image of plaza").alias("negative"), F.when(o % 2 == 0, o % 5).alias("negative_score"), F.lit(None).cast("double").alias("delta"),
    )
    noted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), o, text.component_note(component).alias("note"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "note"))), lambda x: x["note"])
    return noted.groupBy("k").agg(text.capped_notes(ordered).alias("notes"))
