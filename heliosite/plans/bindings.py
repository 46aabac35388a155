"""Queries over the test tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliosite.functions import decide, geo, text
from heliosite.operators import cells
from heliosite.operators import relational as rel

FLAGSHIP = "coverage_by_group"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracle: dict[str, str] = {}

SITE = "(select c_custkey as id, c_name as name, c_nationkey as grp, c_custkey % 3 as provider, c_acctbal as bal, 120.85::double + ((c_custkey * 7919) % 1300) / 1000.0::double as lon, 30.67::double + ((c_custkey * 104729) % 1200) / 1000.0::double as lat from customer)"


def bound(sql: str):
    def register(f):
        _queries[f.__name__], _oracle[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sites: positions by arithmetic on the key."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("grp"), (k % 3).alias("provider"), F.col("c_acctbal").alias("bal"),
        (120.85 + ((k * 7919) % 1300) / 1000.0).alias("lon"), (30.67 + ((k * 104729) % 1200) / 1000.0).alias("lat"),
    )


@bound("select n_name as grp, count(c_custkey) as total, sum((c_acctbal > 0)::int)::bigint as positive, round(sum((c_acctbal > 0)::int) / count(*)::double, 6) as rate from customer join nation on c_nationkey = n_nationkey group by n_name")
def coverage_by_group(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    has_pv = (F.col("c_acctbal") > 0).cast("int")
    return joined.groupBy(F.col("n_name").alias("grp")).agg(F.count("c_custkey").alias("total"), F.sum(has_pv).alias("positive"), F.round(F.sum(has_pv) / F.count("*"), 6).alias("rate")).orderBy(F.desc("rate"), F.desc("total"))


@bound("select count(*) as total, count(*) filter (c_acctbal > 0) as positive, round(count(*) filter (c_acctbal > 0) / count(*)::double, 6) as rate from customer")
def coverage_totals(spark, sf_dir):
    n = F.count("*")
    good = F.count_if(F.col("c_acctbal") > 0)
    return table(spark, sf_dir, "customer").agg(n.alias("total"), good.alias("positive"), F.round(F.when(n > 0, good / n).otherwise(0.0), 6).alias("rate"))


@bound("select event_type, count(*) as n from events group by event_type")
def status_frequency(spark, sf_dir):
    return rel.frequency(table(spark, sf_dir, "events"), "event_type").orderBy(F.desc("n"))


@bound("select d.event_type, coalesce(n, 0) as n from (values ('click'), ('view'), ('missing')) d(event_type) left join (select event_type, count(*) as n from events group by 1) e using (event_type)")
def status_fixed_domain(spark, sf_dir):
    return rel.fixed_domain(table(spark, sf_dir, "events"), "event_type", ["click", "view", "missing"])


@bound("select w as flag, count(*) as n from (select unnest(string_split(text, ' ')) as w from documents) where w in ('the', 'der', 'que', 'la') group by w")
def flag_explode_frequency(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("flag"))
    return words.where(F.col("flag").isin("the", "der", "que", "la")).groupBy("flag").agg(F.count("*").alias("n"))


@bound("""select l_orderkey as mall, count(*) as tiles, count(*) filter (l_quantity > 25) as large, round(sum(l_extendedprice)::double, 2) as area, string_agg(distinct l_returnflag, '|' order by l_returnflag) as methods,
case when count(*) = 0 then 'unknown' when (least(1.0::double, sum(l_extendedprice) / 50000.0) + least(1.0::double, count(*) / 10.0)) / 2 >= 0.6 and sum(l_extendedprice) >= 20000 then 'high' when (least(1.0::double, sum(l_extendedprice) / 50000.0) + least(1.0::double, count(*) / 10.0)) / 2 >= 0.3 and sum(l_extendedprice) >= 8000 then 'medium' when sum(l_extendedprice) >= 3000 then 'low' else 'not_obvious' end as level
from lineitem group by l_orderkey""")
def tile_rollup(spark, sf_dir):
    rolled = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mall")).agg(
        F.count("*").alias("tiles"), F.count_if(F.col("l_quantity") > 25).alias("large"), F.sum("l_extendedprice").alias("raw"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), "|").alias("methods"),
    )
    level = decide.condition_level(decide.roof_score(F.col("raw"), F.col("tiles"), 50_000.0), F.col("raw"), F.col("tiles"))
    return rolled.select("mall", "tiles", "large", F.round(F.col("raw").cast("double"), 2).alias("area"), "methods", level.alias("level"))


@bound(f"select grp, count(distinct provider) as providers, count(*) filter (provider = 0) as p0, count(*) filter (provider = 1) as p1, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat from {SITE} group by grp")
def provider_counts(spark, sf_dir):
    p = F.col("provider")
    return site(spark, sf_dir).groupBy("grp").agg(F.count_distinct("provider").alias("providers"), F.count_if(p == 0).alias("p0"), F.count_if(p == 1).alias("p1"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


@bound(f"select a.id, count(*) as agreeing from {SITE} a join {SITE} b on a.grp = b.grp and a.provider <> b.provider where 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 20000 group by a.id")
def provider_agreement(spark, sf_dir):
    return cells.near_counts(site(spark, sf_dir), "grp", "id", 20_000.0, "provider", "agreeing")


@bound("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by value desc, event_id) as n from events) where n = 1")
def best_candidate(spark, sf_dir):
    return rel.first_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


_SHARE = "list_sum(list_transform(embedding[1:14], lambda x: exp(x::double)))"


@bound(f"select vec_id, list_max(embedding[1:5])::double as positive, list_max(embedding[6:14])::double as negative, round(list_sum(list_transform(embedding[1:5], lambda x: exp(x::double))) / {_SHARE}, 6) as share from embeddings")
def softmax_share(spark, sf_dir):
    logits = F.slice("embedding", 1, 14)
    top = F.array_max(logits).cast("double")
    total = lambda xs: F.aggregate(F.transform(xs, lambda x: F.exp(x.cast("double") - top)), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_max(F.slice("embedding", 1, 5)).cast("double").alias("positive"), F.array_max(F.slice("embedding", 6, 9)).cast("double").alias("negative"), F.round(total(F.slice("embedding", 1, 5)) / total(logits), 6).alias("share"))


@bound("select count(*) as customers, count(distinct o_custkey) as with_orders, (select count(*) from customer where c_custkey not in (select o_custkey from orders)) as without from customer left join orders on c_custkey = o_custkey")
def dashboard_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return rows.agg(F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("customers"), F.count("n").alias("with_orders"), F.count_if(F.col("n").isNull()).alias("without"))


@bound("select distinct c_mktsegment as segment from customer where trim(c_mktsegment) <> ''")
def distinct_nonempty(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).where(F.trim("segment") != "").distinct().orderBy("segment")


@bound("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 16 = 1)")
def not_archived(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderkey % 16 = 1"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@bound("select user_id, event_id, floor(epoch(ts))::bigint as at from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_history(spark, sf_dir):
    return rel.first_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))


@bound("select c_custkey, coalesce(n_name, '') as nation from customer left join nation on c_nationkey = n_nationkey")
def region_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"))


@bound("select doc_id, coalesce(quality, -1) as quality from documents left join labels using (doc_id)")
def prior_quality_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@bound("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id // 4 desc, event_id % 2 desc, event_id desc) as n from events) where n = 1")
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return rel.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id"], F.floor(F.col("event_id") / 4), [F.desc("event_id")])


@bound("with t as (select event_id, user_id, case when event_id % 5 <> 0 then event_type end as kind from events) select event_id from (select *, row_number() over (partition by user_id, kind order by event_id) as n from t) where kind is null or n = 1")
def insert_or_ignore(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"))
    return rel.insert_or_ignore(t, ["user_id", "kind"], [F.asc("event_id")]).select("event_id")


@bound("select l_orderkey, l_linenumber, n from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as n from lineitem) where n <= 3")
def rank_capped(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 3").select("l_orderkey", "l_linenumber", "n")


@bound("select p_partkey, p_retailprice::double as price, row_number() over (order by p_retailprice desc, p_partkey) as place from part order by place limit 20")
def rank_global(spark, sf_dir):
    return rel.top_ranked(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 20, "place").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"), "place")


@bound("with p as (select event_id, user_id from events where event_type = 'click') select event_id, coalesce(lead(event_id) over w, first_value(event_id) over (partition by user_id order by event_id)) as next_id, lag(event_id) over w as previous_id from p window w as (partition by user_id order by event_id)")
def next_pending(spark, sf_dir):
    pending = table(spark, sf_dir, "events").where("event_type = 'click'")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return pending.select("event_id", F.coalesce(F.lead("event_id").over(w), F.first("event_id").over(w)).alias("next_id"), F.lag("event_id").over(w).alias("previous_id"))


@bound("select l_orderkey, l_linenumber, dense_rank() over (partition by l_orderkey order by l_quantity) - 1 as col, dense_rank() over (partition by l_orderkey order by l_extendedprice desc) - 1 as line from lineitem")
def grid_index(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.dense_rank().over(w.orderBy("l_quantity")) - 1).cast("long").alias("col"), (F.dense_rank().over(w.orderBy(F.desc("l_extendedprice"))) - 1).cast("long").alias("line"))


@bound("select event_id from (select event_id, coalesce(max((value > 400)::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as s from events) where s = 0")
def early_stop(spark, sf_dir):
    return rel.early_stop(table(spark, sf_dir, "events"), ["user_id"], [F.asc("event_id")], F.col("value") > 400).select("event_id")


@bound(f"select id, (lon between 121.0 and 121.6 and lat between 31.0 and 31.5) as inside, case grp % 3 when 0 then (lon between 120.85 and 122.15 and lat between 30.67 and 31.87) when 1 then (lon between 118.0 and 123.2 and lat between 27.0 and 31.6) else true end as in_region from {SITE}")
def region_bbox(spark, sf_dir):
    lon, lat, kind = F.col("lon"), F.col("lat"), F.col("grp") % 3
    box = lambda *b: geo.in_box(lon, lat, *[F.lit(x) for x in b])
    region = F.when(kind == 0, box(120.85, 30.67, 122.15, 31.87)).when(kind == 1, box(118.0, 27.0, 123.2, 31.6)).otherwise(F.lit(True))
    return site(spark, sf_dir).select("id", box(121.0, 31.0, 121.6, 31.5).alias("inside"), region.alias("in_region"))


@bound("select p_partkey, concat_ws('; ', case when contains(lower(p_name), 'a') then 'has_a' end, case when p_retailprice > 1500 then 'expensive' end) as reasons, (contains(lower(p_name), 'green') or contains(lower(p_name), 'red')) as hinted from part")
def review_reasons(spark, sf_dir):
    found = text.flags((F.contains(F.lower("p_name"), F.lit("a")), "has_a"), (F.col("p_retailprice") > 1500, "expensive"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "; ").alias("reasons"), text.has_any(F.col("p_name"), ("green", "red")).alias("hinted"))


@bound("select c_custkey, coalesce(trunc(try_cast(replace(c_name, 'Customer#', '') || '.7' as double))::bigint, 0) as number, try_cast(c_mktsegment as double) as bad from customer")
def safe_casts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.to_int(F.concat(F.replace("c_name", F.lit("Customer#"), F.lit("")), F.lit(".7"))).alias("number"), text.to_float(F.col("c_mktsegment")).alias("bad"))


_PLACE = "case c_custkey % 5 when 0 then '上海市购物中心' when 1 then '上海 商业广场（一期）' when 2 then '商商场业 Mall' when 3 then '项目·MAX' else '购物公园' end"


def _without(text_sql: str, tokens: tuple[str, ...]) -> str:
    for token in tokens:
        text_sql = f"replace({text_sql}, '{token}', '')"
    return text_sql


@bound(f"""select c_custkey, {_without('n', text.GENERIC_TOKENS)} as normal, {_without('n', text.RELOCATION_TOKENS)} as relocated
from (select c_custkey, regexp_replace(lower(replace(c_name, '#', ' ') || {_PLACE}), '[\\s·（）]', '', 'g') as n from customer)""")
def name_normalize(spark, sf_dir):
    k = F.col("c_custkey") % 5
    place = F.when(k == 0, "上海市购物中心").when(k == 1, "上海 商业广场（一期）").when(k == 2, "商商场业 Mall").when(k == 3, "项目·MAX").otherwise("购物公园")
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), place)
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_name(name).alias("normal"), text.normalize_name(name, text.RELOCATION_TOKENS).alias("relocated"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substr({0}, i, 2)))"
_CHARS = "list_distinct(string_split({0}, ''))"


@bound(f"""with p as (select p_partkey as k, p_brand as b, replace(replace(replace(replace(lower(p_name), ' ', ''), '#', ''), '-', ''), 'mall', '') as n from (select p_partkey, p_brand, case when p_partkey % 3 = 0 then p_name || ' Mall' else p_name end as p_name from part)),
j as (select x.k as a, y.k as b, x.n as n1, y.n as n2 from p x join p y on x.b = y.b and x.k < y.k)
select a, b, round(case when contains(n1, n2) or contains(n2, n1) then least(1.0::double, 0.72::double + 0.28::double * least(length(n1), length(n2)) / greatest(length(n1), length(n2)))
else 0.78::double * 2 * len(list_intersect({_GRAMS.format('n1')}, {_GRAMS.format('n2')})) / (len({_GRAMS.format('n1')}) + len({_GRAMS.format('n2')})) + 0.22::double * len(list_intersect({_CHARS.format('n1')}, {_CHARS.format('n2')})) / len({_CHARS.format('n1')}) end, 6) as score from j""")
def name_similarity(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" Mall"))).otherwise(F.col("p_name"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.replace(name, F.lit("#"), F.lit("")).alias("name"))
    return rel.similar_names(p, "p_partkey", "p_brand", "name", decimals=6)


@bound(f"""with p as (select p_partkey as k, p_brand as b, replace(replace(replace(replace(lower(p_name), ' ', ''), '#', ''), '-', ''), 'mall', '') as n from (select p_partkey, p_brand, case when p_partkey % 3 = 0 then p_name || ' Mall' else p_name end as p_name from part)),
j as (select x.k as a, y.k as b, x.n as n1, y.n as n2 from p x join p y on x.b = y.b and x.k < y.k)
select * from (select a, b, round(case when contains(n1, n2) or contains(n2, n1) then least(1.0::double, 0.72::double + 0.28::double * least(length(n1), length(n2)) / greatest(length(n1), length(n2)))
else 0.78::double * 2 * len(list_intersect({_GRAMS.format('n1')}, {_GRAMS.format('n2')})) / (len({_GRAMS.format('n1')}) + len({_GRAMS.format('n2')})) + 0.22::double * len(list_intersect({_CHARS.format('n1')}, {_CHARS.format('n2')})) / len({_CHARS.format('n1')}) end, 6) as score from j) where score >= 0.8""")
def similar_name_pairs(spark, sf_dir):
    """The pairs of a brand that score 0.8, through shared bigrams."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" Mall"))).otherwise(F.col("p_name"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.replace(name, F.lit("#"), F.lit("")).alias("name"))
    return cells.similar_above(p, "p_partkey", "p_brand", "name", 0.8, decimals=6)


@bound(f"select id, round(156543.03392804097::double * cos(radians(lat)) / 262144, 9) as mpp, round((lon + 180) / 360 * 256 * 262144, 3) as px, round((0.5::double - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 * 262144, 3) as py, round(lon, 6) as lon, round(lat, 6) as lat from {SITE}")
def pixel_roundtrip(spark, sf_dir):
    s = site(spark, sf_dir).withColumn("mpp", geo.metres_per_pixel(F.col("lat"), 18))
    x, y = geo.to_pixel(F.col("lon"), F.col("lat"), 18)
    lon, lat = geo.from_pixel(x, y, 18)
    return s.select("id", F.round("mpp", 9).alias("mpp"), F.round(x, 3).alias("px"), F.round(y, 3).alias("py"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@bound(f"select id, round(radians(lon) * 6378137.0::double, 3) as x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0::double, 3) as y, least(greatest(ceil(2000 / (156543.03392804097::double * cos(radians(lat)) / 262144))::bigint, 1024), 4096) as size, round(lon + 500 / (111320.0::double * cos(radians(lat))), 8) as east, round(lat + 250 / 111320.0::double, 8) as north from {SITE}")
def web_mercator_offsets(spark, sf_dir):
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    east, north = geo.offset_point(F.col("lon"), F.col("lat"), F.lit(500.0), F.lit(250.0))
    return site(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), geo.map_size(F.col("lat"), 1000.0, 18).alias("size"), F.round(east, 8).alias("east"), F.round(north, 8).alias("north"))


def _gcj_sql(lon: str, lat: str, source: str) -> str:
    x, y = f"({lon} - 105)", f"({lat} - 35)"
    wave = lambda v, *t: " + ".join(f"{a} * sin({v} * pi() * {f})" for a, f in t)
    both = wave(x, (20.0, 6.0), (20.0, 2.0))
    north = f"(-100.0 + 2.0 * {x} + 3.0 * {y} + 0.2 * {y} * {y} + 0.1 * {x} * {y} + 0.2 * sqrt(abs({x})) + ({both} + {wave(y, (20.0, 1.0), (40.0, '(1/3.0::double)'), (160.0, '(1/12.0::double)'), (320.0, '(1/30.0::double)'))}) * 2.0 / 3.0)"
    east = f"(300.0 + {x} + 2.0 * {y} + 0.1 * {x} * {x} + 0.1 * {x} * {y} + 0.1 * sqrt(abs({x})) + ({both} + {wave(x, (20.0, 1.0), (40.0, '(1/3.0::double)'), (150.0, '(1/12.0::double)'), (300.0, '(1/30.0::double)'))}) * 2.0 / 3.0)"
    w = f"(1 - 0.00669342162296594323::double * pow(sin(radians({lat})), 2))"
    return f"select id, round({lon} - {east} * 180 * sqrt({w}) / (6378245.0::double * cos(radians({lat})) * pi()), 6) as wgs_lon, round({lat} - {north} * 180 * {w} * sqrt({w}) / (6378245.0::double * (1 - 0.00669342162296594323::double) * pi()), 6) as wgs_lat from {source}"


@bound(_gcj_sql("lon", "lat", SITE))
def gcj_shift(spark, sf_dir):
    lon, lat = geo.gcj02_to_wgs84(F.col("lon"), F.col("lat"))
    return site(spark, sf_dir).select("id", F.round(lon, 6).alias("wgs_lon"), F.round(lat, 6).alias("wgs_lat"))


_BD = f"(select id, (sqrt(x*x + y*y) - 0.00002 * sin(y * pi())) * cos(atan2(y, x) - 0.000003 * cos(x * pi())) as lon, (sqrt(x*x + y*y) - 0.00002 * sin(y * pi())) * sin(atan2(y, x) - 0.000003 * cos(x * pi())) as lat from (select id, lon - 0.0065::double as x, lat - 0.006::double as y from {SITE}))"


@bound(_gcj_sql("lon", "lat", _BD))
def bd_shift(spark, sf_dir):
    lon, lat = geo.bd09_to_wgs84(F.col("lon"), F.col("lat"))
    return site(spark, sf_dir).select("id", F.round(lon, 6).alias("wgs_lon"), F.round(lat, 6).alias("wgs_lat"))


@bound("with s as (select o_orderkey, 300 + (o_orderkey * 37) % 3000 as w from orders) select o_orderkey, case when w <= 400 then 1 else (w - 400) // 312 + 1 + (case when (w - 400) % 312 > 0 then 1 else 0 end) end as n, case when w <= 400 then 0 else w - 400 end as last from s")
def windows(spark, sf_dir):
    starts = geo.window_starts((300 + (F.col("o_orderkey") * 37) % 3000), 400, 312)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(starts).cast("long").alias("n"), F.element_at(starts, -1).cast("long").alias("last"))


@bound(f"""with m as (select id, 156543.03392804097::double * cos(radians(lat)) / 262144 as mpp from {SITE}), g as (select id, mpp, 640 * mpp as st, 384 * mpp as half from m)
select id, n, i, j from (select id, i, j, row_number() over (partition by id order by round(sqrt(i*i*st*st + j*j*st*st), 6), i, j) as n from g, range(-12, 13) a(i), range(-12, 13) b(j) where abs(i) <= ceil((1000 + half) / st) and abs(j) <= ceil((1000 + half) / st) and sqrt(i*i*st*st + j*j*st*st) <= 1000 + half * sqrt(2))""")
def tile_grid(spark, sf_dir):
    sites = site(spark, sf_dir).select("id", geo.metres_per_pixel(F.col("lat"), 18).alias("mpp"))
    step = lambda tile, k: F.round(tile[k] / (640 * F.col("mpp"))).cast("long").alias
    placed = lambda tile, at: F.struct((at + 1).cast("long").alias("n"), step(tile, "dx")("i"), step(tile, "dy")("j"))
    # sites of one scale have one grid; a plain inline would have its arrays tested for elements at each site, below the distinct
    grids = sites.select("mpp").distinct().select("mpp", F.transform(geo.buffer_tiles(1000.0, 768, 128, F.col("mpp")), placed).alias("tiles"))
    return sites.join(grids, "mpp").select("id", F.inline_outer("tiles"))


@bound(f"""select id, round(lon + case id % 4 when 0 then 0.01::double when 1 then 0.02::double / 3 when 2 then 0.01::double else 0.01::double end, 6) as x,
round(lat + case id % 4 when 0 then 0.005::double when 1 then 0.01::double / 3 when 2 then 0.005::double else 0 end, 6) as y from {SITE}""")
def polygon_centroid(spark, sf_dir):
    """Rectangles, triangles, two vertices, and three on a line."""
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    k, first = F.col("id") % 4, corner(0.0, 0.0)
    ring = (
        F.when(k == 0, F.array(first, corner(0.02, 0.0), corner(0.02, 0.01), corner(0.0, 0.01)))
        .when(k == 1, F.array(first, corner(0.02, 0.0), corner(0.0, 0.01)))
        .when(k == 2, F.array(first, corner(0.02, 0.01)))
        .otherwise(F.array(first, corner(0.01, 0.0), corner(0.02, 0.0)))
    )
    x, y = geo.centroid(ring)
    return site(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@bound("""with e as (select event_id, value / 490.02::double as s, event_id % 3 as agree, event_id % 2 as providers from events),
n as (select *, case when s >= 0.52 then 'strong' when s >= 0.34 then 'medium' else 'weak' end as name from e),
c as (select *, case when agree >= 2 then 'multi_provider_agree' when providers >= 1 and name = 'strong' and s * 100 >= 62 then 'single_provider_strong' else 'weak_or_disputed' end as coord from n),
m as (select *, case event_id % 6 when 0 then 'not_available' when 1 then case when s >= 0.5 then 'candidate_image_mall_like' else 'manual_review_or_not_available' end when 2 then 'old_image_more_mall_like' when 3 then 'not_mall_like_or_unclear' when 4 then 'not_mall_like_or_unclear' else 'manual_review_or_not_available' end as image from c),
i as (select *, case when event_id % 11 = 0 or event_id % 7 = 0 then 'reject_candidate' when name = 'strong' and ((coord = 'multi_provider_agree' and image in ('candidate_image_mall_like', 'not_available')) or (coord = 'single_provider_strong' and image = 'candidate_image_mall_like')) then 'auto_pass' else 'manual_review' end as status from m),
l as (select *, case when status = 'auto_pass' and coord = 'multi_provider_agree' then 'A' when status = 'auto_pass' then 'B' when status = 'manual_review' then 'C' else 'D' end as level from i)
select event_id, name, coord, image, status, level, case level when 'A' then 'approved_auto' when 'B' then 'approved_auto_sample_check' when 'C' then 'needs_manual_review' else 'blocked_unresolved' end as review_status, (level in ('A', 'B'))::int as enters,
case when status = 'reject_candidate' then 'bad_place_or_outside_target_region' else concat_ws('|', 'name_match_' || name, coord, image, case when status = 'manual_review' and image = 'old_image_more_mall_like' and agree < 2 then 'old_image_conflicts_with_official_candidate' end) end as reasons from l""")
def identity_levels(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 490.02).alias("s"))
    e = e.withColumn("name", decide.name_evidence(F.col("s")))
    e = e.withColumn("coord", decide.coordinate_evidence(k % 3, k % 2, F.col("name"), F.col("s") * 100))
    seen = F.element_at(F.array(*[F.lit(x) for x in ("candidate_center_likely_mall", "old_image_more_mall_like", "both_unclear_or_non_mall", "candidate_unclear_no_old_image", "needs_manual_review")]), (k % 6).cast("int"))
    e = e.withColumn("image", decide.image_evidence(F.when(k % 6 != 0, seen), F.col("s")))
    name, coord, image = F.col("name"), F.col("coord"), F.col("image")
    e = e.withColumn("status", decide.identity_status(name, coord, image, k % 11 == 0, k % 7 != 0))
    e = e.withColumn("level", decide.confidence_level(F.col("status"), name, coord, image))
    reasons = F.array_join(decide.identity_reasons(F.col("status"), name, coord, image, k % 3), "|")
    return e.select("event_id", "name", "coord", "image", "status", "level", decide.review_status(F.col("level")).alias("review_status"), decide.enters(F.col("level")).alias("enters"), reasons.alias("reasons"))


@bound("""select event_id, case when value / 490.02::double >= 0.75 then 'likely_pv' when value / 490.02::double >= 0.45 then 'possible_pv' else 'no_clear_pv' end as by_score,
case when event_id % 2 = 0 and value / 490.02::double >= 0.65 then 'likely_pv' when event_id % 2 = 0 or value / 490.02::double >= 0.48 or r >= 0.001::double then 'possible_pv' else 'no_clear_pv' end as by_confidence,
case when value * 4 >= 1200 and r >= 0.003::double then 'likely_pv' when value * 4 >= 400 and r >= 0.001::double then 'possible_pv' else 'no_clear_pv' end as by_pixels,
case when value * 4 >= 1000 and r >= 0.001::double then 'likely_pv' when value * 4 >= 500 then 'possible_pv' else 'no_clear_pv' end as by_mask,
case when value / 10000 >= 0.04::double and r < 0.02::double then 'high' when value / 10000 >= 0.006::double then 'medium' else 'low' end as potential,
case when value / 10000 >= 0.04::double and r < 0.02::double then 'large regular roof candidates and limited existing PV detected' when value / 10000 >= 0.006::double then 'some roof candidates exist; manual review needed' else 'few large regular roof candidates in this crop' end as reason
from (select *, (event_id % 9) / 400.0::double as r from events)""")
def pv_classes(spark, sf_dir):
    share, px, ratio = F.col("value") / 490.02, F.col("value") * 4, (F.col("event_id") % 9) / 400.0
    level = decide.potential(F.col("value") / 10000, ratio)
    return table(spark, sf_dir, "events").select(
        "event_id", decide.pv_by_score(share).alias("by_score"), decide.pv_by_confidence(F.col("event_id") % 2 == 0, share, ratio).alias("by_confidence"),
        decide.pv_by_pixels(px, ratio).alias("by_pixels"), decide.mask_class(px, ratio).alias("by_mask"), level.alias("potential"), decide.potential_reason(level).alias("reason"),
    )


@bound("""with t as (select event_id, case when event_id % 5 <> 0 then value / 490.02::double end as o, case when event_id % 7 <> 0 then ((event_id * 31) % 100) / 100.0::double end as n from events)
select event_id, case when n is null and o >= 0.5 then 'old_image_mall_like_no_candidate' when n is null then 'no_candidate_coordinate' when o is null and n >= 0.5 then 'candidate_center_likely_mall' when o is null then 'candidate_unclear_no_old_image' when n >= 0.5 and n >= o + 0.1::double then 'candidate_center_likely_mall' when o >= 0.5 and o >= n + 0.1::double then 'old_image_more_mall_like' when n < 0.5 and o < 0.5 then 'both_unclear_or_non_mall' else 'needs_manual_review' end as decision,
case when n is null then case when o >= 0.5 then 'medium' else 'high' end when o is null then case when n >= 0.5 then 'high' else 'medium' end when (n >= 0.5 and n >= o + 0.1::double) or (o >= 0.5 and o >= n + 0.1::double) then 'high' else 'medium' end as priority from t""")
def image_decisions(spark, sf_dir):
    k = F.col("event_id")
    old, new = F.when(k % 5 != 0, F.col("value") / 490.02), F.when(k % 7 != 0, ((k * 31) % 100) / 100.0)
    decision = decide.image_decision(old, new)
    return table(spark, sf_dir, "events").select("event_id", decision.alias("decision"), decide.image_priority(decision).alias("priority"))


@bound("select event_id, coalesce(nullif(case when event_id % 4 = 0 then 0.0::double else value end, 0.0), -1.0::double) as center, case when event_id % 3 = 0 then 'second' when event_id % 3 = 1 then 'second; x' else 'y; second' end as reason, greatest(0, 25 - 2 * (event_id % 20)) as provider_score from events")
def center_and_reason(spark, sf_dir):
    k = F.col("event_id")
    reason = F.when(k % 3 == 1, "second; x").when(k % 3 == 2, "y")
    return table(spark, sf_dir, "events").select("event_id", decide.center_default(F.when(k % 4 == 0, 0.0).otherwise(F.col("value")), F.lit(-1.0)).alias("center"), decide.append_once(reason, "second").alias("reason"), decide.provider_score(k % 20 + 1).alias("provider_score"))


@bound("select o_orderkey, floor((row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) - 1) / 12)::bigint as page, row_number() over (partition by o_custkey order by case when o_orderstatus = 'O' then 0 else 1 end, o_orderkey) as place from orders")
def paginate(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    n = F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    first = F.row_number().over(w.orderBy(F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor((n - 1) / 12).alias("page"), first.alias("place"))


@bound("select event_id from events where event_id % 1000 not in (select event_id % 1000 from events where event_type = 'click' and value > 400)")
def resume_pending(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("mall_id", F.col("event_id") % 1000)
    return rel.resume(events, events.where("event_type = 'click' and value > 400"), "mall_id").select("event_id")


@bound("select l_orderkey, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as lines from lineitem where l_returnflag <> 'R' group by l_orderkey")
def ordered_groups(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("lines"))


@bound("select doc_id, status from (select doc_id, status, row_number() over (partition by doc_id order by ord desc) as n from (select doc_id, 'all' as status, 0 as ord from labels union all select doc_id, 'good', 1 from labels where quality = 1 union all select doc_id, 'toxic', 2 from labels where toxic = 1)) where n = 1")
def multi_file_status(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    part = lambda where, status, ord_: labels.where(where).select("doc_id", F.lit(status).alias("status"), F.lit(ord_).alias("ord"))
    return rel.first_per_key(part("true", "all", 0).unionByName(part("quality = 1", "good", 1)).unionByName(part("toxic = 1", "toxic", 2)), ["doc_id"], [F.desc("ord")]).drop("ord")


@bound("select round(sum(l_quantity)::double, 2) as quantity, round(sum(l_extendedprice)::double, 2) as price, round(coalesce(avg(case when l_returnflag = 'R' then l_discount end), 0)::double, 6) as mean from lineitem")
def column_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.sum("l_quantity").cast("double"), 2).alias("quantity"), F.round(F.sum("l_extendedprice").cast("double"), 2).alias("price"), F.round(F.coalesce(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))), F.lit(0.0)).cast("double"), 6).alias("mean"))


@bound("select page_id, left(regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g'), 120) as file, regexp_replace(regexp_replace(lower(url), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from pages")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_file_name(F.col("url")).alias("file"), text.slug(F.col("url"), F.col("page_id")).alias("slug"))


@bound(f"select id, round(lon, 4) as lon, round(lat, 4) as lat from (select id, lon, lat from {SITE})")
def location_split(spark, sf_dir):
    joined = site(spark, sf_dir).select("id", F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("location"))
    return joined.select("id", *[F.round(text.location_part(F.col("location"), i), 4).alias(c) for i, c in enumerate(("lon", "lat"))])


@bound("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'")
def review_results(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@bound("select event_id from events where user_id in (select user_id from events where value > 250) and event_type <> 'click'")
def requeue_update(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.where("event_type <> 'click'").join(events.where("value > 250").select("user_id"), "user_id", "left_semi").select("event_id")


@bound("select c_custkey from customer order by c_custkey limit 25 offset 10")
def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey").offset(10).limit(25)


@bound("select coalesce(case when event_id % 4 = 0 then 'manual' end, event_type) as level, count(*) as n from events group by 1")
def level_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.coalesce(F.when(F.col("event_id") % 4 == 0, "manual"), F.col("event_type")).alias("level")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
