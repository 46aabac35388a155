"""More bound queries: review exports, semantic decisions, detector confidence, tile covers and text keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliosite.functions import decide, geo, text
from heliosite.operators import reviews
from heliosite.plans.bindings import SITE, bound, site, table


@bound("""select c_custkey, coalesce(r.level, a.auto) as confidence_level, case when r.level in ('A', 'B') then r.lon else a.lon end as center_lon, case when r.level in ('A', 'B') then 'manual_review' else 'official_poi_auto' end as center_source
from (select c_custkey, case c_custkey % 4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end as auto, case when c_custkey % 7 <> 0 then c_acctbal end as lon from customer) a
left join (select o_custkey, case max(o_orderkey) % 3 when 0 then 'A' when 1 then 'B' else 'C' end as level, case when max(o_orderkey) % 5 <> 0 then max(o_totalprice) end as lon from orders group by 1) r on r.o_custkey = c_custkey
where (r.level in ('A', 'B') and r.lon is not null) or (r.o_custkey is null and a.auto in ('A', 'B') and a.lon is not null)""")
def approved_centers(spark, sf_dir):
    k = F.col("c_custkey")
    auto = F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "C").otherwise("D")
    sites = table(spark, sf_dir, "customer").select("c_custkey", auto.alias("auto"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("auto_lon"))
    last = F.max("o_orderkey")
    told = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.when(last % 3 == 0, "A").when(last % 3 == 1, "B").otherwise("C").alias("level"), F.when(last % 5 != 0, F.max("o_totalprice")).alias("lon"),
    )
    manual = F.col("level").isin("A", "B")
    both = sites.join(told, "c_custkey", "left").where((manual & F.col("lon").isNotNull()) | (F.col("level").isNull() & F.col("auto").isin("A", "B") & F.col("auto_lon").isNotNull()))
    return both.select("c_custkey", F.coalesce("level", "auto").alias("confidence_level"), F.when(manual, F.col("lon")).otherwise(F.col("auto_lon")).alias("center_lon"), F.when(manual, "manual_review").otherwise("official_poi_auto").alias("center_source"))


@bound("""select o_orderkey from orders r where o_orderstatus in ('O', 'F') and exists (select 1 from customer where c_custkey = o_custkey)
and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = o_orderstatus and l_returnflag = 'R')""")
def not_yet_requeued(spark, sf_dir):
    history = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F")).select("o_orderkey", "o_custkey", "o_orderstatus")
    return reviews.not_yet_archived(rows, history, ["o_orderkey", "o_orderstatus"], known, "o_custkey").select("o_orderkey")


@bound("""select c_custkey, coalesce(nullif(trim(case when c_custkey % 2 = 0 then ' ' else c_mktsegment end), ''), nullif(trim(o.p), ''), 'none') as filled
from customer left join (select o_custkey, max(o_orderpriority) as p from orders group by 1) o on o_custkey = c_custkey""")
def first_filled_lookup(spark, sf_dir):
    priorities = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("p"))
    own = F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").join(priorities, "c_custkey", "left").select("c_custkey", text.first_filled(own, F.col("p"), F.lit("none")).alias("filled"))


@bound("""select event_id, case when trim(f) <> '' then lower(trim(f)) in ('1', 'true', 'yes', 'y') when trim(l) <> '' then upper(trim(l)) in ('A', 'B') else false end as ready
from (select event_id, case event_id % 4 when 0 then ' Yes' when 1 then 'no' when 2 then '' end as f, case event_id % 3 when 0 then ' a ' when 1 then 'C' end as l from events)""")
def analysis_ready(spark, sf_dir):
    k = F.col("event_id")
    flag = F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "no").when(k % 4 == 2, "")
    level = F.when(k % 3 == 0, " a ").when(k % 3 == 1, "C")
    return table(spark, sf_dir, "events").select("event_id", decide.analysis_ready(flag, level).alias("ready"))


@bound("""with e as (select vec_id, list_max(embedding[1:5])::double as p, list_max(embedding[6:14])::double as n, list_sum(list_transform(embedding[1:5], lambda x: exp(x::double))) / list_sum(list_transform(embedding[1:14], lambda x: exp(x::double))) as share from embeddings)
select vec_id, case when p >= -4 and p - n >= 2 then 'pass' when p - n >= 0 then 'review' else 'reject' end as decision, (p - n >= 0.04::double and share >= 0.46::double) as keep from e""")
def semantic_decisions(spark, sf_dir):
    positive, negative = F.slice("embedding", 1, 5), F.slice("embedding", 6, 9)
    top = lambda xs: F.array_max(xs).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", decide.semantic_decision(top(positive), top(negative)).alias("decision"), decide.semantic_keep(top(positive) - top(negative), decide.softmax_share(positive, negative)).alias("keep"),
    )


@bound("""with e as (select event_id, floor(value * 2)::bigint as px, floor(value * 2) / 262144.0::double as cover, event_id % 4 as n, (event_id % 100) / 100.0::double as score from events),
d as (select *, px >= 180 and cover >= 0.001::double and (n >= 2 or cover >= 0.003::double) as has_pv, least(0.98::double, 0.2::double + 0.35::double * least(px / 180.0::double, 1.0::double) + 0.25::double * least(cover / 0.001::double, 1.0::double) + 0.2::double * score) as c from e)
select event_id, has_pv, round(case when has_pv then c else least(c, 0.49::double) end, 9) as confidence from d""")
def detector_confidence(spark, sf_dir):
    k, px = F.col("event_id"), F.floor(F.col("value") * 2)
    has_pv, confidence = decide.pv_decision(px, px / 262144.0, k % 4, (k % 100) / 100.0, 180, 0.001)
    return table(spark, sf_dir, "events").select("event_id", has_pv.alias("has_pv"), F.round(confidence, 9).alias("confidence"))


@bound("""with e as (select event_id, value / 490.02::double as m, ((event_id * 31) % 100) / 100.0::double as n, case event_id % 3 when 0 then 'pass' when 1 then 'review' else 'reject' end as q from events)
select event_id, case when q = 'reject' then 'reject' when m - n >= 0.08::double and m >= 0.55::double and q = 'pass' then 'pass' when m - n >= 0.02::double and m >= 0.5::double then case when q = 'pass' then 'pass' else 'review' end
when m - n >= -0.08::double or m >= 0.4::double then 'review' else 'reject' end as visual from e""")
def visual_consistency(spark, sf_dir):
    k = F.col("event_id")
    quality = F.when(k % 3 == 0, "pass").when(k % 3 == 1, "review").otherwise("reject")
    return table(spark, sf_dir, "events").select("event_id", decide.visual_consistency(F.col("value") / 490.02, ((k * 31) % 100) / 100.0, quality).alias("visual"))


_PX = "((lon + 180) / 360 * 256 * 262144)"
_PY = "((0.5::double - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 * 262144)"


@bound(f"""with b as (select id, floor(({_PX} - 512) / 256)::bigint as x0, floor(({_PX} + 511) / 256)::bigint as x1, greatest(0, floor(({_PY} - 512) / 256)::bigint) as y0, least(262143, floor(({_PY} + 511) / 256)::bigint) as y1 from {SITE})
select id, tile_x, tile_y from (select id, tile_x, unnest(range(y0, y1 + 1)) as tile_y from (select *, unnest(range(x0, x1 + 1)) as tile_x from b))""")
def tile_cover(spark, sf_dir):
    return site(spark, sf_dir).select("id", F.explode(geo.tile_cover(F.col("lon"), F.col("lat"), 1024, 18)).alias("t")).select("id", "t.tile_x", "t.tile_y")


@bound("select c_custkey, case when c_custkey % 2 = 0 then lower(c_name) else lower(c_mktsegment) end as stem from customer")
def mask_stems(spark, sf_dir):
    tail = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("_GT_mask_label"))).otherwise(F.concat("c_mktsegment", F.lit("-mask")))
    # suffixes go in a fixed order: label, mask, gt
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask_stem(tail).alias("stem"))


@bound("select event_id, concat_ws('|', case when contains(event_type, 'c') then 'c' end, case when contains(event_type, 'view') then 'view' end) as hits from events")
def keyword_hits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.keyword_hits(("c", "view"), F.col("event_type")).alias("hits"))


@bound("select coalesce(nullif(p_brand, ''), 'unknown') as brand, count(*) as n, round(sum(coalesce(p_retailprice, 0))::double, 2) as total from part group by 1")
def totals_by_key(spark, sf_dir):
    brand = F.coalesce(F.nullif("p_brand", F.lit("")), F.lit("unknown")).alias("brand")
    return table(spark, sf_dir, "part").groupBy(brand).agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("p_retailprice", F.lit(0))).cast("double"), 2).alias("total")).orderBy("brand")


@bound("""with m as (select * from orders where o_orderstatus = 'F') select 'history' as side, count(*) as n, sum(o_orderkey)::bigint as ids from m
union all select 'current', count(*), sum(o_orderkey)::bigint from orders where o_orderkey not in (select o_orderkey from m)""")
def archive_and_delete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    kept, moved = reviews.moved(orders, F.col("o_orderstatus") == "F")
    count = lambda df, side: df.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids")).select(F.lit(side).alias("side"), "n", "ids")
    return count(moved, "history").unionByName(count(kept, "current"))


@bound("select c_custkey, regexp_replace(lower(concat_ws(' 店-', c_name, c_mktsegment)), '[^0-9a-z一-鿿]+', '', 'g') as key from customer")
def compact_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.compact(F.concat_ws(" 店-", "c_name", "c_mktsegment")).alias("key"))


@bound(r"""select c_custkey, regexp_replace(replace(replace(regexp_replace(concat('上海市', c_name, '（', c_mktsegment, '） 上海店 (B) 2'), '[（(].*?[）)]', '', 'g'), '上海市', ''), '上海', ''), '\s+', '', 'g') as core from customer""")
def core_names(spark, sf_dir):
    name = F.concat(F.lit("上海市"), "c_name", F.lit("（"), "c_mktsegment", F.lit("） 上海店 (B) 2"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.core_name(name).alias("core"))


@bound("select event_id, (event_id % 1000) * (value / 1000) * (value / 1000) as area_m2 from events")
def pixel_areas(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", geo.area_m2(F.col("event_id") % 1000, F.col("value") / 1000).alias("area_m2"))


@bound("""select event_id, case when event_id % 5 < 2 then 'none' when s = 'likely_pv' and components = 0 then 'possible_pv' else s end as status
from (select event_id, case event_id % 3 when 0 then 'likely_pv' when 1 then 'possible_pv' else 'no_pv' end as s, event_id % 4 as components from events)""")
def demoted_status(spark, sf_dir):
    k = F.col("event_id")
    status = decide.demoted(F.when(k % 3 == 0, "likely_pv").when(k % 3 == 1, "possible_pv").otherwise("no_pv"), k % 4)
    # pixels are k % 5, at least 2 of them for a status
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 5 < 2, "none").otherwise(status).alias("status"))


@bound("""select c_custkey, level, (level = 'A' or level = 'B')::int as enters, case when level in ('A', 'B') then c_acctbal end as center_lon, (level <> 'A')::int as review
from (select c_custkey, c_acctbal, case c_custkey % 4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end as level from customer)""")
def resolved_rows(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("level", F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "C").otherwise("D"))
    return reviews.resolved(rows.withColumn("center_lon", F.col("c_acctbal")), "level", ["center_lon"]).select("c_custkey", "level", "enters", "center_lon", "review")


@bound("""with e as (select user_id, event_id, value as pos, (event_id * 31) % 101 as neg from events),
r as (select *, row_number() over (partition by user_id order by pos desc, event_id) as p, row_number() over (partition by user_id order by neg desc, event_id) as n from e)
select user_id, max(case when p = 1 then event_id end) as pos_crop, max(pos) as pos, max(case when n = 1 then event_id end) as neg_crop, max(neg) as neg from r group by 1""")
def crop_posneg_argmax(spark, sf_dir):
    k = F.col("event_id")
    crops = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("pos"), ((k * 31) % 101).alias("neg"))
    return crops.groupBy("user_id").agg(
        F.max_by("event_id", F.struct("pos", -k)).alias("pos_crop"), F.max("pos").alias("pos"), F.max_by("event_id", F.struct("neg", -k)).alias("neg_crop"), F.max("neg").alias("neg"),
    )
