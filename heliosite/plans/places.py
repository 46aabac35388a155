"""Bound queries of the identity, relocation and quality plans, of filters and gates, of text and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliosite.functions import decide, geo, scores, text
from heliosite.operators import cells, places, reviews
from heliosite.operators import relational as rel
from heliosite.plans.bindings import _CHARS, _GRAMS, SITE, _without, bound, site, table


def choice(key, *values):
    """The value at ``key`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def choice_sql(key: str, *values) -> str:
    quoted = ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else str(v) for v in values)
    return f"([{quoted}])[({key}) % {len(values)} + 1]"


def either(flag: str, name: str) -> str:
    return f"case when {flag} then '{name}' end"


# --- candidates: three for each customer, by arithmetic on keys

_CANDIDATES = f"""(select id as site_id, i as seq, (['amap', 'baidu', 'tencent'])[(id + i) % 3 + 1] as provider, i + 1 as rank, 'place ' || (id * 3 + i) as place,
case when (id + 2 * i) % 17 <> 0 then lon + i * (id % 5) * 0.0004::double end as lon, lat, (id * 3 + i) % 11 <> 0 as in_region, ((id * (i + 3)) % 100) / 100.0::double as similarity, ((id * 7 + i * 31) % 97)::double as score, (id + i) % 13 = 0 as bad
from {SITE}, range(3) r(i))"""


def candidates(spark, sf_dir):
    k, i = F.col("id"), F.col("i")
    rows = site(spark, sf_dir).withColumn("i", F.explode(F.array(*[F.lit(x) for x in range(3)])))
    return rows.select(
        k.alias("site_id"), i.alias("seq"), choice(k + i, "amap", "baidu", "tencent").alias("provider"), (i + 1).alias("rank"), F.concat(F.lit("place "), (k * 3 + i).cast("string")).alias("place"),
        F.when((k + 2 * i) % 17 != 0, F.col("lon") + i * (k % 5) * 0.0004).alias("lon"), "lat", ((k * 3 + i) % 11 != 0).alias("in_region"), (((k * (i + 3)) % 100) / 100.0).alias("similarity"), ((k * 7 + i * 31) % 97).cast("double").alias("score"),
        F.when((k + i) % 13 == 0, F.array(F.lit("bad_place_hint"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


_HAVERSINE = "2 * 6371008.8::double * asin(sqrt(pow(sin(radians({d}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({d}.lat)) * pow(sin(radians({d}.lon - {a}.lon) / 2), 2)))"
_VIABLE = f"v as (select * from {_CANDIDATES} where in_region and lon is not null and not bad), b as (select * from (select *, row_number() over (partition by site_id order by score desc, similarity desc, rank, seq) as n from v) where n = 1)"
_MET = f"""w as (select b.site_id, v.provider, v.lon, v.lat, v.provider <> b.provider as other, {_HAVERSINE.format(a='b', d='v')} as d from b join v on v.site_id = b.site_id),
g as (select site_id, count(distinct provider) as providers, count(distinct case when d <= 150 then provider end) as agreeing, min(case when d <= 150 and other then d end) as nearest, avg(case when d <= 150 then lon end) as center_lon, avg(case when d <= 150 then lat end) as center_lat from w group by 1)"""


@bound(f"with {_VIABLE}, {_MET} select site_id, b.provider, b.place, providers, agreeing, round(nearest, 4) as nearest, round(center_lon, 8) as center_lon, round(center_lat, 8) as center_lat from b join g using (site_id)")
def agree_mean_min(spark, sf_dir):
    found = places.agreement_of_best(candidates(spark, sf_dir))
    return found.select("site_id", "provider", "place", "providers", "agreeing", F.round("nearest", 4).alias("nearest"), F.round("center_lon", 8).alias("center_lon"), F.round("center_lat", 8).alias("center_lat"))


_IMAGE = "case when decision is null then 'not_available' when decision = 'candidate_center_likely_mall' and delta >= 0.5::double then 'candidate_image_mall_like' when decision = 'old_image_more_mall_like' then decision when decision in ('both_unclear_or_non_mall', 'candidate_unclear_no_old_image') then 'not_mall_like_or_unclear' else 'manual_review_or_not_available' end"
_SUMMARY = f"""with {_VIABLE}, {_MET},
i as (select id as site_id, name, {choice_sql('id', None, 'candidate_center_likely_mall', 'old_image_more_mall_like', 'both_unclear_or_non_mall', 'needs_manual_review', 'candidate_unclear_no_old_image', None)} as decision, ((id * 37) % 100) / 100.0::double as delta from {SITE}),
e as (select i.site_id, i.name, b.provider, b.place, b.similarity, b.score, coalesce(providers, 0) as providers, coalesce(agreeing, 0) as agreeing, nearest, center_lon, center_lat, {_IMAGE} as image,
case when b.score is null then 'none' when similarity >= 0.52::double then 'strong' when similarity >= 0.34::double then 'medium' else 'weak' end as ne from i left join b using (site_id) left join g using (site_id)),
c as (select *, case when score is null then 'none' when agreeing >= 2 then 'multi_provider_agree' when providers >= 1 and ne = 'strong' and score >= 62 then 'single_provider_strong' else 'weak_or_disputed' end as ce from e),
s as (select *, case when score is null then 'reject_candidate' when ne = 'strong' and ((ce = 'multi_provider_agree' and image in ('candidate_image_mall_like', 'not_available')) or (ce = 'single_provider_strong' and image = 'candidate_image_mall_like')) then 'auto_pass' else 'manual_review' end as status from c),
l as (select *, case when status = 'auto_pass' and ce = 'multi_provider_agree' then 'A' when status = 'auto_pass' then 'B' when status = 'manual_review' then 'C' else 'D' end as level,
case when score is null then 'no_viable_official_poi' else concat_ws('|', 'name_match_' || ne, ce, image, case when status = 'manual_review' and image = 'old_image_more_mall_like' and agreeing < 2 then 'old_image_conflicts_with_official_candidate' end) end as reasons from s)"""


def summary(spark, sf_dir):
    k = F.col("id")
    decision = choice(k, None, "candidate_center_likely_mall", "old_image_more_mall_like", "both_unclear_or_non_mall", "needs_manual_review", "candidate_unclear_no_old_image", None)
    sites = site(spark, sf_dir).select(k.alias("site_id"), "name")
    images = site(spark, sf_dir).select(k.alias("site_id"), decision.alias("decision"), (((k * 37) % 100) / 100.0).alias("delta")).where("decision is not null")
    return places.identity_summary(sites, candidates(spark, sf_dir), images)


@bound(f"{_SUMMARY} select site_id, coalesce(provider, '') as provider, coalesce(place, '') as place, providers, agreeing, round(score, 3) as score, ne as name_evidence, ce as coordinate_evidence, image as image_evidence, status as identity_status, reasons as identity_reasons, level from l")
def identity_summary(spark, sf_dir):
    return summary(spark, sf_dir).select("site_id", "provider", "place", "providers", "agreeing", F.round("score", 3).alias("score"), "name_evidence", "coordinate_evidence", "image_evidence", "identity_status", "identity_reasons", "level")


@bound(f"""{_SUMMARY} select site_id, round(case when level in ('A', 'B') then center_lon end, 8) as center_lon, round(case when level in ('A', 'B') then center_lat end, 8) as center_lat, level, (level in ('A', 'B'))::int as enters,
case when level in ('A', 'B') then 'official_poi_point' else '' end as center_type, coalesce(provider, '') as center_source, case level when 'A' then 'approved_auto' when 'B' then 'approved_auto_sample_check' when 'C' then 'needs_manual_review' else 'blocked_unresolved' end as review_status, (level <> 'A')::int as review_required from l""")
def resolved_centers(spark, sf_dir):
    rows = places.resolved(summary(spark, sf_dir))
    return rows.select("site_id", F.round("center_lon", 8).alias("center_lon"), F.round("center_lat", 8).alias("center_lat"), "level", "enters", "center_type", "center_source", "review_status", "review_required")


# --- scores of names

_PUNCTUATION = r"[\s（）()]"


def _normal(sql: str, tokens=text.GENERIC_TOKENS) -> str:
    return _without(f"regexp_replace(lower({sql}), '{_PUNCTUATION}', '', 'g')", tokens)


def _core(sql: str) -> str:
    return rf"regexp_replace(replace(replace(regexp_replace({sql}, '[（(].*?[）)]', '', 'g'), '上海市', ''), '上海', ''), '\s+', '', 'g')"


def _similar(n1: str, n2: str) -> str:
    dice = f"0.78::double * 2 * len(list_intersect({_GRAMS.format(n1)}, {_GRAMS.format(n2)})) / (len({_GRAMS.format(n1)}) + len({_GRAMS.format(n2)})) + 0.22::double * len(list_intersect({_CHARS.format(n1)}, {_CHARS.format(n2)})) / len({_CHARS.format(n1)})"
    return f"case when {n1} = '' or {n2} = '' then 0.0::double when contains({n1}, {n2}) or contains({n2}, {n1}) then least(1.0::double, 0.72::double + 0.28::double * least(length({n1}), length({n2})) / greatest(length({n1}), length({n2}))) else least(1.0::double, {dice}) end"


def _any(sql: str, hints: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({sql}), '{h.lower()}')" for h in hints) + ")"


_NAMES = ("Plaza Seven", "上海市Harbour（East）", "Zed Mall", "K", "Old Orchard Center", "Mall")
_PLACES = ("Plaza Seven 停车场", "Harbour", "Zed", "orchard centre", "K1", "购物中心", "Old Orchard Center", "harbour F1", "公交 Plaza")
_KINDS = ("购物中心", "餐饮服务", "mall", "", "商业街", "地铁站", "shop")
_WORDS = f"(select c_custkey as k, {choice_sql('c_custkey', *_NAMES)} as name, {choice_sql('c_custkey // 2', *_PLACES)} as place, {choice_sql('c_custkey // 3', *_KINDS)} as kind, c_mktsegment as address, c_custkey % 10 <> 3 as inside, greatest(0, 25 - 2 * (c_custkey % 14))::double as provider from customer)"
_HINTS = scores.Hints()


@bound(f"""with n as (select *, place || ' ' || address || ' ' || kind || ' City ' || 'D' as said, {_core('name')} as core_raw from {_WORDS}),
m as (select *, {_normal('said')} as whole, {_normal('name')} as normal, {_normal('core_raw')} as core, {_normal('place')} as other, regexp_replace(lower(place), '[^0-9a-z一-鿿]+', '', 'g') as short, regexp_replace(lower(name), '[^0-9a-z一-鿿]+', '', 'g') as short_name, regexp_replace(lower(core_raw), '[^0-9a-z一-鿿]+', '', 'g') as short_core from n),
s as (select *, {_similar('normal', 'whole')} as sim, (other <> '' and other in (normal, core)) or (short <> '' and short in (short_name, short_core)) as exact, {_any('kind', _HINTS.main_type)} as main, {_any("(place || ' ' || kind)", _HINTS.bad)} as bad, length(other) <= 2 as generic,
{_any('place', _HINTS.inner_name)} or {_any('kind', _HINTS.inner_type)} as inside_place, {_any("(place || ' ' || kind)", _HINTS.mall)} or {_any('kind', _HINTS.good_type)} as hint from m),
f as (select *, not exact and core <> '' and contains(whole, core) as held, inside_place and not (exact and main) as inner_poi from s),
t as (select *, not exact and not held and sim < 0.25::double as weak from f)
select k, round(sim, 6) as similarity, round(provider + sim * 45 + (case when inside then 15 else -45 end) + (case when exact then 30 when held then 18 when weak then -18 else 0 end) + (case when main then 22 when hint then 10 else 0 end) - (case when inner_poi then 36 else 0 end) - (case when bad then 28 else 0 end) - (case when generic then 8 else 0 end), 9) as score,
concat_ws('|', {either('not inside', 'outside_target_bbox')}, {either('weak', 'weak_name_match')}, {either('main', 'main_mall_type')}, {either('not main and not hint', 'no_mall_hint')}, {either('inner_poi', 'internal_sub_poi')}, {either('bad', 'bad_place_hint')}, {either('generic', 'generic_candidate')}) as flags from t""")
def identity_score(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), choice(k, *_NAMES).alias("name"), choice(F.floor(k / 2), *_PLACES).alias("place"), choice(F.floor(k / 3), *_KINDS).alias("kind"), F.col("c_mktsegment").alias("address"), (k % 10 != 3).alias("inside"), decide.provider_score(k % 14 + 1).alias("provider"))
    rows = rows.withColumns({"city": F.lit("City"), "district": F.lit("D")})
    scored = places.identity_scored(rows, "name", ("place", "address", "kind", "city", "district"), "provider", "inside")
    return scored.select("k", F.round("similarity", 6).alias("similarity"), F.round("score", 9).alias("score"), F.array_join("flags", "|").alias("flags"))


_RH = scores.RelocationHints()
_ADDRESS_KINDS = ("POI", "Locality", "", "StreetName", "poi place")
_CITIES = ("上海市", "", "Hangzhou", "上海")
_MOVES = f"(select c_custkey as k, {choice_sql('c_custkey', *_NAMES)} as name, case when c_custkey % 8 <> 5 then {choice_sql('c_custkey // 2', *_PLACES)} else '' end as place, case when c_custkey % 16 <> 5 then c_mktsegment else '' end as matched, {choice_sql('c_custkey // 3', *_CITIES)} as city, {choice_sql('c_custkey // 5', *_ADDRESS_KINDS)} as ak, c_custkey % 10 <> 3 as inside, ((c_custkey * 13) % 130)::double as provider, ((c_custkey * 29) % 100) / 100.0::double as sim from customer)"


@bound(f"""with n as (select *, place || ' ' || matched || '  ' || city || '  ' || ak || ' ' as said, {_normal(_core('name'), text.RELOCATION_TOKENS)} as core from {_MOVES}),
m as (select *, contains(upper(ak), 'POI') as poi, core <> '' and contains({_normal('said', text.RELOCATION_TOKENS)}, core) as held, {_any('said', _RH.mall)} as mall, {_any('said', _RH.bad)} as bad, place = '' and matched = '' as nameless,
length({_normal("coalesce(nullif(place, ''), matched)", text.RELOCATION_TOKENS)}) <= 2 as generic, city <> '' and city <> '上海市' and not contains(city || ' ' || matched, '上海') as elsewhere from n),
s as (select *, not held and sim < 0.28::double as weak, least(provider, 100.0::double) / 100 * 28 + sim * 42 + (case when inside then 12 else -45 end) + (case when poi then 15 when lower(ak) in ('locality', 'streetname') then -18 else 0 end) - (case when elsewhere then 25 else 0 end) + (case when mall then 8 else 0 end)
+ (case when held then 15 when sim < 0.28::double then -16 else 0 end) - (case when bad then 20 else 0 end) - (case when nameless then 15 else 0 end) - (case when generic then 10 else 0 end) as score from m)
select k, round(score, 3) as score, case when round(score, 9) >= 78 and sim >= 0.38::double and inside and poi then 'high' when round(score, 9) >= 58 and sim >= 0.24::double and inside then 'medium' when round(score, 9) >= 38 and inside then 'low' else 'unresolved' end as confidence,
concat_ws('|', {either('not inside', 'outside_shanghai_bbox')}, case when not poi and ak <> '' then 'addr_type_' || ak end, {either('elsewhere', 'city_not_shanghai')}, {either('not mall', 'no_mall_hint')}, {either('weak', 'weak_name_match')}, {either('bad', 'bad_place_hint')}, {either('nameless', 'blank_name')}, {either('generic', 'generic_candidate')}) as flags from s""")
def relocation_score(spark, sf_dir):
    score, confidence, flags = _relocated()
    return _moves(spark, sf_dir).select("k", score.alias("score"), confidence.alias("confidence"), F.array_join(flags, "|").alias("flags"))


def _moves(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), choice(k, *_NAMES).alias("name"), F.when(k % 8 != 5, choice(F.floor(k / 2), *_PLACES)).otherwise("").alias("place"), F.when(k % 16 != 5, F.col("c_mktsegment")).otherwise("").alias("matched"), choice(F.floor(k / 3), *_CITIES).alias("city"), choice(F.floor(k / 5), *_ADDRESS_KINDS).alias("ak"),
        (k % 10 != 3).alias("inside"), ((k * 13) % 130).cast("double").alias("provider"), (((k * 29) % 100) / 100.0).alias("sim"),
    )


def _relocated():
    c = F.col
    return scores.relocation_score(c("name"), c("provider"), c("sim"), c("place"), c("matched"), F.lit(""), c("city"), F.lit(""), c("ak"), F.lit(""), c("inside"))


@bound("""with e as (select event_id, (['mall', 'station', 'office', 'retail', 'parking'])[event_id % 5 + 1] as kind, (['shop', 'highway', 'building'])[event_id % 3 + 1] as class, case when event_id % 7 <> 0 then ((event_id % 150) / 100.0::double)::varchar else 'x' end as importance from events)
select event_id, round(greatest(0.0::double, least(100.0::double, 45 + 45 * greatest(0.0::double, least(1.0::double, coalesce(try_cast(importance as double), 0.0::double))) + (case when kind in ('mall', 'retail') then 18 when kind in ('station', 'parking') then -22 else 0 end))), 6) as score, case when kind in ('mall', 'retail') or class in ('shop', 'building') then 'POI' else 'OSM' end as kind from e""")
def open_map_score(spark, sf_dir):
    k = F.col("event_id")
    score, kind = scores.open_map_score(choice(k, "mall", "station", "office", "retail", "parking"), choice(k, "shop", "highway", "building"), F.when(k % 7 != 0, ((k % 150) / 100.0).cast("string")).otherwise("x"))
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"), kind.alias("kind"))


_GRADED = ("high", "medium", "low", "unresolved")
_FLAGS = ("", "weak_name_match", "bad_place_hint |no_mall_hint", "no_mall_hint|generic_candidate", "city_not_shanghai_x", "weak_name_match| outside_shanghai_bbox")
_USABLE = f"(select c_custkey as k, {choice_sql('c_custkey', *_GRADED)} as confidence, {choice_sql('c_custkey // 4', *_FLAGS)} as flags, case when c_custkey % 9 <> 4 then '121.5' else '' end as lon from customer)"
_GRADE = "case when confidence in ('high', 'medium') and lon <> '' and not severe then confidence else 'review' end"


def usable(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), choice(k, *_GRADED).alias("confidence"), choice(F.floor(k / 4), *_FLAGS).alias("flags"), F.when(k % 9 != 4, "121.5").otherwise("").alias("lon"))
    said = [F.col("confidence"), F.col("lon"), F.lit("31.2"), F.col("flags")]
    return rows.select("k", "flags", scores.usability(*said).alias("grade"), F.array_join(scores.usability_reasons(*said), "|").alias("reasons"))


@bound(f"""with u as (select *, len(list_intersect(list_transform(string_split(flags, '|'), lambda x: trim(x)), ['outside_shanghai_bbox', 'bad_place_hint', 'city_not_shanghai'])) > 0 as severe from {_USABLE}), g as (select *, {_GRADE} as grade from u)
select k, grade, case grade when 'high' then '' when 'medium' then 'medium_confidence_manual_spot_check' else concat_ws('|', case when confidence in ('low', 'unresolved') then 'confidence_' || confidence end, {either('severe', 'severe_flag')}, case when contains(flags, 'weak_name_match') then 'weak_name_match' end, case when contains(flags, 'generic_candidate') then 'generic_candidate' end, case when lon = '' then 'no_usable_coordinate' end) end as reasons from g""")
def usability_split(spark, sf_dir):
    return usable(spark, sf_dir).drop("flags")


@bound(f"""with u as (select *, len(list_intersect(list_transform(string_split(flags, '|'), lambda x: trim(x)), ['outside_shanghai_bbox', 'bad_place_hint', 'city_not_shanghai'])) > 0 as severe from {_USABLE}) select {_GRADE} as status, count(*) as n, sum(k)::bigint as ids from u group by 1""")
def status_split(spark, sf_dir):
    parts = reviews.split_by(usable(spark, sf_dir), "grade", ["high", "medium", "review"])
    counted = [df.agg(F.count("*").alias("n"), F.sum("k").alias("ids")).where("n > 0").withColumn("status", F.lit(s)) for s, df in parts.items()]
    return reviews.all_columns(*counted)


@bound(f"select k, len(list_intersect(list_transform(string_split(flags, '|'), lambda x: trim(x)), ['outside_shanghai_bbox', 'bad_place_hint', 'city_not_shanghai'])) > 0 as severe, contains(flags, 'weak_name_match') as weak from {_USABLE}")
def flag_overlap(spark, sf_dir):
    return usable(spark, sf_dir).select("k", scores.any_flag(F.col("flags")).alias("severe"), F.contains("flags", F.lit("weak_name_match")).alias("weak"))


@bound(f"""with c as (select c_custkey % 50 as site_id, c_custkey as seq, {choice_sql('c_custkey // 50', *_GRADED[::-1])} as confidence, ((c_custkey * 17) % 90)::double as score, c_acctbal as lon from customer)
select site_id, seq, confidence, case when confidence <> 'unresolved' then lon end as lon from (select *, row_number() over (partition by site_id order by (confidence <> 'unresolved')::int desc, score desc, seq) as n from c) where n = 1""")
def picked_best(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select((k % 50).alias("site_id"), k.alias("seq"), choice(F.floor(k / 50), *_GRADED[::-1]).alias("confidence"), ((k * 17) % 90).cast("double").alias("score"), F.col("c_acctbal").alias("lon"), F.col("c_acctbal").alias("lat"))
    return places.pick_best(rows, ["site_id"], [F.desc("score"), F.asc("seq")]).select("site_id", "seq", "confidence", "lon")


# --- quality of a dataset

_Q = scores.QualityWords()
_LOCATIONS = ("上海市浦东新区", "浙江宁波", "上海 苏州路", "", "Shanghai")
_ANSWERS = ("上海市", "道路一号", "路", "人民广场")
_METRICS = f"(select d.doc_id as k, coalesce(l.quality, 1) = 1 as image, d.doc_id % 12 <> 7 as inside, case when d.doc_id % 9 <> 2 then (60 + d.doc_id % 41)::double end as score, d.doc_id % 6 = 0 as repaired, {choice_sql('d.doc_id', *_LOCATIONS)} as location, {choice_sql('d.doc_id // 3', *_ANSWERS)} as answer, ((d.n_chars * 7) % 60)::double as std, ((d.n_chars * 3) % 100) / 100.0::double as vegetation, case when d.doc_id % 8 <> 1 then ((d.n_chars * 11) % 100) / 100.0::double end as center, ((d.n_chars * 13) % 100) / 1000.0::double as rect from documents d left join labels l using (doc_id))"
_OTHER_CITY = "(" + " or ".join(f"contains(location, '{w}')" for w in _Q.elsewhere) + ")"
_GENERIC = "answer in (" + ", ".join(f"'{w}'" for w in _Q.generic) + ")"


@bound(f"""with m as (select *, score is null or score < 80 as low, not contains(location, '上海') as no_city, {_OTHER_CITY} as other, {_GENERIC} as generic, vegetation > 0.55::double as green, coalesce(center < 0.35::double, false) as middle, rect < 0.015::double as roof from {_METRICS})
select k, concat_ws('；', {either('not image', _Q.missing)}, {either('not inside', _Q.outside)}, {either('low', _Q.low_score)}, {either('repaired', _Q.repaired)}, {either('no_city', _Q.no_city)}, {either('other', _Q.other_city)}, {either('generic', _Q.too_generic)}, {either('std < 18', _Q.flat)}, {either('green', _Q.green)}, {either('middle', _Q.green_center)}, {either('roof', _Q.no_roof)}) as flags,
case when not image or not inside then '剔除' when low or no_city or other or generic or green::int + middle::int + roof::int >= 2 then '需复核' else '通过' end as status from m""")
def quality_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    k, n = F.col("doc_id"), F.col("n_chars")
    flags, status = scores.quality_flags(
        F.coalesce("quality", F.lit(1)) == 1, k % 12 != 7, F.when(k % 9 != 2, (60 + k % 41).cast("double")), k % 6 == 0, choice(k, *_LOCATIONS), choice(F.floor(k / 3), *_ANSWERS),
        ((n * 7) % 60).cast("double"), ((n * 3) % 100) / 100.0, F.when(k % 8 != 1, ((n * 11) % 100) / 100.0), ((n * 13) % 100) / 1000.0,
    )
    return docs.select(k.alias("k"), F.array_join(flags, "；").alias("flags"), status.alias("status"))


# --- filters, gates, errors

@bound("select c_custkey from customer where c_custkey in (3, 5, 8, 13, 21, 34, 55, 89) and c_custkey % 2 = 1")
def id_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_custkey").isin(3, 5, 8, 13, 21, 34, 55, 89) & (F.col("c_custkey") % 2 == 1)).select("c_custkey")


@bound(f"select c_custkey from customer where upper(trim({choice_sql('c_custkey', ' a', 'B ', 'c', '', None)})) in ('A', 'B')")
def level_filter(spark, sf_dir):
    level = choice(F.col("c_custkey"), " a", "B ", "c", "", None)
    return table(spark, sf_dir, "customer").where(F.upper(F.trim(level)).isin("A", "B")).select("c_custkey")


@bound(f"select id, not coalesce(x between 120.85 and 122.15 and y between 30.67 and 31.87 and not isnan(x), false) as repair from (select id, try_cast({choice_sql('id', '121.5', '119', 'abc', '', 'nan', '122.15')} as double) as x, lat as y from {SITE})")
def needs_repair(spark, sf_dir):
    return site(spark, sf_dir).select("id", geo.needs_repair(choice(F.col("id"), "121.5", "119", "abc", "", "nan", "122.15"), F.col("lat").cast("string")).alias("repair"))


_REGION = choice_sql("id", "上海市", "浙江省", "上海", "江苏省", "", "浙江")


@bound(f"select id, case when id % 10 = 4 then false when r in ('上海市', '上海') then lon between 120.85 and 122.15 and lat between 30.67 and 31.87 when r in ('浙江省', '浙江') then lon between 118.0 and 123.2 and lat between 27.0 and 31.6 else true end as inside from (select *, {_REGION} as r from {SITE})")
def region_dispatch(spark, sf_dir):
    lon = F.when(F.col("id") % 10 != 4, F.col("lon"))
    return site(spark, sf_dir).select("id", geo.in_region(lon, F.col("lat"), choice(F.col("id"), "上海市", "浙江省", "上海", "江苏省", "", "浙江")).alias("inside"))


@bound(f"select site_id, seq from {_CANDIDATES} where in_region and lon is not null and not bad")
def viable(spark, sf_dir):
    return places.viable(candidates(spark, sf_dir)).select("site_id", "seq")


@bound("select c_custkey from customer where coalesce(case when c_custkey % 4 <> 0 then c_mktsegment end, '') = 'FURNITURE'")
def province_filter(spark, sf_dir):
    province = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").where(reviews.of_province(province, "FURNITURE") & reviews.of_province(province, "")).select("c_custkey")


_QUEUE = "(select c_custkey as k, c_custkey % 3 as needs, (['A', null, 'C', null])[c_custkey % 4 + 1] as level, (['x.png', '', null])[c_custkey // 3 % 3 + 1] as path from customer)"


@bound(f"""select 'queue' as view, k from {_QUEUE} where needs = 1 union all select 'pending', k from {_QUEUE} where needs = 1 and level is null union all select 'reviewed', k from {_QUEUE} where level is not null union all select 'all', k from {_QUEUE}
union all select 'with_image', k from {_QUEUE} where coalesce(path, '') <> '' union all select 'missing_image', k from {_QUEUE} where coalesce(path, '') = ''""")
def view_predicates(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), (k % 3).alias("needs"), choice(k, "A", None, "C", None).alias("level"), choice(F.floor(k / 3), "x.png", "", None).alias("path"))
    first = {v: reviews.queue_view(v, F.col("needs"), F.col("level")) for v in ("queue", "pending", "reviewed", "all")}
    second = {v: reviews.output_view(v, F.col("level"), F.col("path")) for v in ("with_image", "missing_image")}
    held = F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in (first | second).items()]))
    return rows.select(F.explode(held).alias("view"), "k")


@bound("select event_id, case when event_id % 3 = 0 then value else 0.0 end as result, case when event_id % 3 = 0 then event_type else 'not_processed' end as status, case when event_id % 3 = 0 then '' when event_id % 3 = 1 then 'image_status=failed' else 'missing image_path' end as error from events")
def error_rows(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k, F.col("value").alias("result"), F.col("event_type").alias("status"))
    error = scores.gate_error(choice(k, "ok", "failed", "ok"), choice(k, "a.jpg", "b.jpg", " "))
    return reviews.with_errors(rows, error.isNull(), error, {"result": F.lit(0.0), "status": F.lit("not_processed")})


@bound("select event_id, case when s is null or s <> 'ok' then 'image_status=' || coalesce(s, '') when trim(coalesce(p, '')) = '' then 'missing image_path' end as error from (select event_id, (['ok', 'error', null])[event_id % 3 + 1] as s, (['p', ' ', null, 'q'])[event_id % 4 + 1] as p from events)")
def process_gate(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", scores.gate_error(choice(k, "ok", "error", None), choice(k, "p", " ", None, "q")).alias("error"))


@bound("""select c_custkey, case when l not in ('A', 'B', 'C', 'D') then 'Invalid decision level' when l in ('A', 'B') and lon is null then 'A/B must provide final lon/lat' end as error
from (select c_custkey, upper(trim((['a', ' B', 'C', 'x', 'd '])[c_custkey % 5 + 1])) as l, case when c_custkey % 3 <> 0 then c_acctbal end as lon from customer)""")
def review_validation(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", scores.review_error(choice(k, "a", " B", "C", "x", "d "), F.when(k % 3 != 0, F.col("c_acctbal")), F.lit(31.0)).alias("error"))


@bound("select event_id, case when px >= 250 then s else '' end as status from (select event_id, event_id % 500 as px, (['likely_pv', 'possible_pv', 'no_clear_pv'])[event_id % 3 + 1] as s from events)")
def effective_status(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", scores.effective_status(choice(k, "likely_pv", "possible_pv", "no_clear_pv"), k % 500, 250).alias("status"))


_ASKED = "(select id, case when id % 3 <> 0 then lon end as lon0, lat as lat0, case when id % 5 = 0 then '' else 'q' || (id % 40) end as query from {SITE})".replace("{SITE}", SITE)
_GEO = "(select 'q' || s_suppkey as query, case when s_suppkey % 6 <> 5 then 121.0::double + s_suppkey / 100.0::double end as lon, 31.0::double as lat, (60 + s_suppkey)::double as score, case when s_suppkey % 7 = 6 then 'timeout' end as error from supplier)"


@bound(f"""select id, case when lon0 is not null then lon0 when query <> '' and error is null then lon end as lon, case when lon0 is not null then lat0 when query <> '' and error is null then lat end as lat,
case when lon0 is not null then 'ok' when query = '' or error is not null then 'error' when g is null then 'not_found' when lon is not null then 'ok' else 'error' end as status, case when lon0 is not null then 'input_coordinates' when query = '' then 'none' else 'arcgis' end as source,
case when lon0 is not null then 'used lat/lon from input csv' when query = '' then 'missing query and coordinates' when error is not null then 'geocode failed: ' || error when g is null then 'no geocode candidate' else 'geocoded by ArcGIS World Geocoding' || case when score < 75 then '; low score, needs manual review' else '' end end as reason
from {_ASKED} a left join (select *, 1 as g from {_GEO}) b using (query)""")
def coord_precedence(spark, sf_dir):
    k, s = F.col("id"), F.col("s_suppkey")
    rows = site(spark, sf_dir).select("id", F.when(k % 3 != 0, F.col("lon")).alias("lon"), "lat")
    codes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("q"), s.cast("string")).alias("query"), F.when(s % 6 != 5, 121.0 + s / 100.0).alias("lon"), F.lit(31.0).alias("lat"), (60 + s).cast("double").alias("score"), F.when(s % 7 == 6, "timeout").alias("error"))
    found = places.located(rows, codes, F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("q"), (k % 40).cast("string"))))
    return found.select("id", "lon", "lat", "status", "source", "reason")


@bound(f"""with c as (select id % 200 as k, id // 200 as ask, id % 7 as cand, lon, lat from {SITE}) select k, ask, cand, round(lon, 6) as lon from (select *, row_number() over (partition by k order by ask, cand) as n from c where lon between 121.0 and 121.6 and lat between 31.0 and 31.5) where n = 1""")
def first_in_box(spark, sf_dir):
    rows = site(spark, sf_dir).select((F.col("id") % 200).alias("k"), F.floor(F.col("id") / 200).alias("ask"), (F.col("id") % 7).alias("cand"), "lon", "lat")
    return places.first_inside(rows, ["k"], (121.0, 31.0, 121.6, 31.5), [F.asc("ask"), F.asc("cand")]).select("k", "ask", "cand", F.round("lon", 6).alias("lon"))


@bound(f"""with s as (select id as site_id, case when id % 4 = 0 then null else lon end as lon, lat, case when id % 8 = 0 then '' else (['amap', 'baidu'])[id % 2 + 1] end as provider, case when id % 3 = 0 then 'place ' || (id * 3 + 1) end as place from {SITE}),
c as (select s.site_id, c.lon, c.lat, row_number() over (partition by s.site_id order by (c.provider <> coalesce(s.provider, ''))::int, (c.place <> coalesce(s.place, ''))::int, rank, seq) as n from s join {_CANDIDATES} c using (site_id) where c.lon is not null and s.lon is null and (coalesce(s.provider, '') <> '' or coalesce(s.place, '') <> ''))
select s.site_id, round(coalesce(c.lon, s.lon), 6) as lon, c.lon is not null as filled from s left join (select * from c where n = 1) c using (site_id)""")
def backfill_center(spark, sf_dir):
    k = F.col("id")
    rows = site(spark, sf_dir).select(k.alias("site_id"), F.when(k % 4 != 0, F.col("lon")).alias("lon"), "lat", F.when(k % 8 == 0, "").otherwise(choice(k, "amap", "baidu")).alias("provider"), F.when(k % 3 == 0, F.concat(F.lit("place "), (k * 3 + 1).cast("string"))).alias("place"), F.lit(None).cast("string").alias("address"))
    found = places.backfilled(rows, candidates(spark, sf_dir).withColumn("address", F.lit("x")))
    return found.select("site_id", F.round("lon", 6).alias("lon"), "filled")


# --- the review workflow and keyed tables

_M = "(select c_custkey as mall_id, (c_custkey % 4 = 0)::int as needs_review, (['', null, 'odd', 'x; requires second review'])[c_custkey % 4 + 1] as reason from customer)"
_R = "(select o_custkey as mall_id, (['A', 'B', 'C', 'D'])[o_orderkey % 4 + 1] as level, o_orderkey as reviewed_at from (select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1))"
_H = f"(select mall_id, level, reviewed_at from {_R} where mall_id % 5 = 0 union all select c_custkey, 'C', -1 from customer where c_custkey % 9 = 0)"
_FRESH = f"(select * from {_R} r where level in ('B', 'C', 'D') and not exists (select 1 from {_H} h where h.mall_id = r.mall_id and h.level = r.level and h.reviewed_at = r.reviewed_at))"


def _workflow(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("reviewed_at")
    customers = table(spark, sf_dir, "customer")
    malls = customers.select(k.alias("mall_id"), (k % 4 == 0).cast("int").alias("needs_review"), choice(k, "", None, "odd", "x; requires second review").alias("reason"))
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("mall_id")).agg(F.max("o_orderkey").alias("reviewed_at"))
    done = last.select("mall_id", choice(o, "A", "B", "C", "D").alias("level"), "reviewed_at")
    history = done.where("mall_id % 5 = 0").unionByName(customers.where(k % 9 == 0).select(k.alias("mall_id"), F.lit("C").alias("level"), F.lit(-1).cast("long").alias("reviewed_at")))
    return reviews.requeued(malls, done, history)


@bound(f"""select m.mall_id, case when f.mall_id is not null then 1 else needs_review end as needs_review, case when f.mall_id is null or contains(coalesce(reason, ''), 'requires second review') then reason when coalesce(reason, '') = '' then 'requires second review' else reason || '; requires second review' end as reason
from {_M} m left join (select distinct mall_id from {_FRESH}) f using (mall_id)""")
def requeued_sites(spark, sf_dir):
    return _workflow(spark, sf_dir)[0]


@bound(f"select 'reviews' as side, mall_id, level, reviewed_at from {_R} where level = 'A' union all select 'history', mall_id, level, reviewed_at from {_H} union all select 'history', mall_id, level, reviewed_at from {_FRESH}")
def archive_move(spark, sf_dir):
    _, kept, archived = _workflow(spark, sf_dir)
    return kept.withColumn("side", F.lit("reviews")).unionByName(archived.withColumn("side", F.lit("history")))


_CELLS = "(select event_id, case event_id % 6 when 0 then '' when 1 then 'x' when 2 then (user_id)::varchar || '.0' else ' ' || user_id end as key, value from events)"


@bound(f"select key::bigint as key, event_id, value from (select trim(key) as key, event_id, value, row_number() over (partition by trim(key) order by event_id desc) as n from {_CELLS} where regexp_full_match(trim(key), '[+-]?[0-9]+')) where n = 1")
def keyed_index(spark, sf_dir):
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    key = F.when(k % 6 == 0, "").when(k % 6 == 1, "x").when(k % 6 == 2, F.concat(user, F.lit(".0"))).otherwise(F.concat(F.lit(" "), user))
    return reviews.keyed(table(spark, sf_dir, "events").select("event_id", key.alias("key"), "value"), "key", F.col("event_id"))


@bound("select user_id, event_id from (select *, row_number() over (partition by user_id order by run desc, event_id desc) as n from (select user_id, event_id, event_id % 4 as run from events)) where n = 1")
def keyed_upsert(spark, sf_dir):
    """Runs in turn over one dictionary: of a key, the last run's last row stays."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4).alias("run"))
    now = events.where("run = 0")
    for run in (1, 2, 3):
        now = rel.upsert(now, events.where(F.col("run") == run), ["user_id"], F.col("run"), [F.desc("event_id")])
    return rel.first_per_key(now, ["user_id"], [F.desc("run"), F.desc("event_id")]).select("user_id", "event_id")


@bound("select 'a' as side, event_id from events where value > 250 union all select 'b', event_id from events where event_type = 'click' and value > 200")
def fallback_source(spark, sf_dir):
    """Two whole-table choices: a final table that has rows, and one that has none."""
    events = table(spark, sf_dir, "events")
    some, none, other = events.where("value > 250"), events.where("value < 0"), events.where("event_type = 'click' and value > 200")
    a, b = reviews.final_or_checkpoint(some, other), reviews.final_or_checkpoint(none, other)
    return a.select(F.lit("a").alias("side"), "event_id").unionByName(b.select(F.lit("b").alias("side"), "event_id"))


@bound("select o_orderkey, o_totalprice from orders where o_orderkey = 7 or o_orderkey = 100000000")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(7, 100_000_000)).select("o_orderkey", "o_totalprice")


@bound("select c_custkey as k, case when s.ok then s.bal else c_acctbal end as bal, coalesce(s.ok, false) as reused from customer left join (select s_suppkey as c_custkey, s_acctbal as bal, true as ok from supplier where s_suppkey % 3 <> 0) s using (c_custkey)")
def reuse_existing(spark, sf_dir):
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    earlier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), choice(F.col("s_suppkey"), "error", "ok", "ok").alias("status"))
    return reviews.reused(now, earlier, "k", F.col("status") == "ok", ["bal"])


@bound("select s_suppkey as mall_id, s_name as name, '' as province, '' as image_path from supplier")
def alias_coalesce(spark, sf_dir):
    return reviews.from_aliases(table(spark, sf_dir, "supplier"), {"mall_id": ("mall_id", "s_suppkey"), "name": ("s_name", "name"), "province": ("province",), "image_path": ("image_path", "filename", "file", "image", "image_file")})


@bound("""with i as (select page_id, lower(regexp_extract(url, '([^/]+)$', 1)) as stem from pages), m as (select stem, min(path) as path from (select 'b/' || stem as path, stem from i where page_id % 2 = 0 union all select 'c/' || stem, stem from i where page_id % 3 = 0) group by 1)
select page_id, coalesce(path, '') as mask from i left join m using (stem)""")
def stem_join(spark, sf_dir):
    """Images with the first mask, by path without regard to case, whose stem less its suffixes is theirs; none stays blank."""
    images = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "([^/]+)$", 1)).alias("stem"))
    named = lambda top, tail, rows: rows.select(F.concat(F.lit(top), F.upper("stem"), F.lit(tail)).alias("path"), F.concat("stem", F.lit(tail)).alias("raw"), F.concat(F.lit(top), "stem").alias("shown"))
    files = named("b/", "_mask", images.where("page_id % 2 = 0")).unionByName(named("c/", "-GT", images.where("page_id % 3 = 0")))
    masks = rel.first_per_key(files.withColumn("stem", text.mask_stem(F.col("raw"))), ["stem"], [F.asc(F.lower("path"))]).select("stem", "shown")
    return images.join(masks, "stem", "left").select("page_id", F.coalesce("shown", F.lit("")).alias("mask"))


@bound("select vec_id, i - 1 as place, embedding[i]::double as a, embedding[10 + i]::double as b from embeddings, range(1, 4) r(i)")
def zip_scores(spark, sf_dir):
    pairs = reviews.zipped(F.slice("embedding", 1, 5), F.slice("embedding", 11, 3), "a", "b")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pairs).alias("place", "x")).select("vec_id", F.col("place").cast("long").alias("place"), F.col("x.a").cast("double").alias("a"), F.col("x.b").cast("double").alias("b"))


@bound("select event_id, value, event_type, null::bigint as user_id from events where event_id % 2 = 0 union all select event_id, null, event_type, user_id from events where event_id % 2 = 1")
def schema_union(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return reviews.all_columns(events.where("event_id % 2 = 0").select("event_id", "value", "event_type"), events.where("event_id % 2 = 1").select("event_type", "user_id", "event_id"))


@bound("select event_id, 'review' as part from events where value > 450 union all select event_id, 'reject' from events where event_type = 'error'")
def union_subsets(spark, sf_dir):
    events, part = table(spark, sf_dir, "events"), lambda s: F.lit(s).alias("part")
    return events.where("value > 450").select("event_id", part("review")).unionByName(events.where("event_type = 'error'").select("event_id", part("reject")))


# --- order

@bound("""with p as (select event_id, user_id from events where event_type = 'click') select e.event_id, coalesce((select min(p.event_id) from p where p.user_id = e.user_id and p.event_id > e.event_id), (select min(p.event_id) from p where p.user_id = e.user_id)) as next_id from events e""")
def next_of_any(spark, sf_dir):
    """The next pending row after any row of the queue, pending or not, else the first; one window sees both."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    waiting = F.when(F.col("event_type") == "click", F.col("event_id"))
    after = F.min(waiting).over(w.rowsBetween(1, Window.unboundedFollowing))
    return events.select("event_id", F.coalesce(after, F.min(waiting).over(Window.partitionBy("user_id"))).alias("next_id"))


@bound("select c_custkey as k, row_number() over (order by (o.n is not null)::int, c_custkey) as place from customer left join (select o_custkey as c_custkey, count(*) as n from orders where o_orderkey % 16 = 1 group by 1) o using (c_custkey) order by place limit 500")
def pending_first(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderkey % 16 = 1").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(done, "k", "left")
    return rel.top_ranked(rows, [F.asc(F.when(F.col("n").isNull(), 0).otherwise(1)), F.asc("k")], 500, "place").select("k", "place")


_TEXT_ID = "case event_id % 5 when 0 then 'x' || event_id when 1 then '' else (event_id % 900)::varchar end"


@bound(f"select event_id, row_number() over (partition by user_id order by coalesce(try_cast({_TEXT_ID} as integer), 0), event_id) as by_id, row_number() over (partition by user_id order by coalesce(try_cast(case when event_id % 7 = 0 then '' else value::varchar end as double), -999) desc, event_id) as by_score from events")
def numeric_text_sort(spark, sf_dir):
    from pyspark.sql import Window

    k, w = F.col("event_id"), Window.partitionBy("user_id")
    key = F.when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string"))).when(k % 5 == 1, "").otherwise((k % 900).cast("string"))
    score = F.when(k % 7 == 0, "").otherwise(F.col("value").cast("string"))
    place = lambda *order: F.row_number().over(w.orderBy(*order)).cast("long")
    return table(spark, sf_dir, "events").select("event_id", place(F.asc(text.to_int(key)), F.asc("event_id")).alias("by_id"), place(F.desc(F.coalesce(text.to_float(score), F.lit(-999.0))), F.asc("event_id")).alias("by_score"))


@bound("select user_id, event_id from (select *, row_number() over (partition by user_id order by coalesce(case when event_id % 6 <> 0 then value end, 0) desc, event_id) as n from events) where n = 1")
def best_score(spark, sf_dir):
    score = F.coalesce(F.when(F.col("event_id") % 6 != 0, F.col("value")), F.lit(0.0))
    return rel.first_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc(score), F.asc("event_id")]).select("user_id", "event_id")


@bound("select c_custkey, i as place, w[i] as word from (select c_custkey, string_split(c_name || ' ' || c_mktsegment, ' ') as w from customer), range(1, 5) r(i) where i <= len(w)")
def ordinal_explode(spark, sf_dir):
    words = F.posexplode(F.split(F.concat_ws(" ", "c_name", "c_mktsegment"), " ")).alias("i", "word")
    return table(spark, sf_dir, "customer").select("c_custkey", words).select("c_custkey", (F.col("i") + 1).cast("long").alias("place"), "word")


# --- text and JSON

@bound(rf"""with n as (select c_custkey as k, (['Harbour（East）', '上海市Plaza', ' K  1 ', 'Old (x) 上海 Mall'])[c_custkey % 4 + 1] as name from customer), s as (select k, name, trim(regexp_replace(name, '[（(].*?[）)]', '', 'g')) as stripped from n),
b as (select *, trim(replace(replace(stripped, '上海市', ''), '上海', '')) as bare from s), q as (select k, list_transform([name, stripped, bare, bare || ' 购物中心', bare || ' 商场', bare || ' 广场', bare || ' mall'], lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) as v from b),
u as (select k, list_filter(v, lambda x, i: list_position(v, x) = i) as v from q) select k, array_to_string(v[1:4], '|') as queries from u""")
def query_variants(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.array_join(text.search_queries(choice(k, "Harbour（East）", "上海市Plaza", " K  1 ", "Old (x) 上海 Mall"), 4), "|").alias("queries"))


@bound("""select c_custkey as k, case when trim(l) <> '' then trim(l) else 'City' || c_name end as whole, concat_ws(' ', 'City', nullif(trim(l), ''), c_name) as parts, concat_ws('|', case when contains(l, '上海市') then trim(l) end, '上海市' || c_name, c_name || ' 上海市', '上海市 ' || c_name) as repair
from (select *, ([' 上海市1', '', ' road 2 '])[c_custkey % 3 + 1] as l from customer)""")
def geocode_query(spark, sf_dir):
    k, city, name = F.col("c_custkey"), F.lit("City "), F.col("c_name")
    location = choice(k, " 上海市1", "", " road 2 ")
    return table(spark, sf_dir, "customer").select(k.alias("k"), text.geocode_query(location, city, name).alias("whole"), text.address_query(city, location, name).alias("parts"), F.array_join(text.repair_queries(name, location), "|").alias("repair"))


@bound(r"""select page_id, coalesce(nullif(left(regexp_replace(trim(regexp_replace(u, '[<>:"/\\|?*]', '_', 'g')), '^\.+|\.+$', '', 'g'), 40), ''), 'mall') as cut, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(trim(u), '[\\/:*?"<>|]+', '_', 'g'), '\s+', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g'), 30), ''), 'item') as joined
from (select page_id, case page_id % 5 when 0 then '..' when 1 then ' a : b?.' else url end as u from pages)""")
def file_names(spark, sf_dir):
    name = F.when(F.col("page_id") % 5 == 0, "..").when(F.col("page_id") % 5 == 1, " a : b?.").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.cut_file_name(name, 40).alias("cut"), text.joined_file_name(name, 30).alias("joined"))


@bound("""with s as (select page_id as k, (['上海市$浦东新区$Plaza $K', 'Mall$$Mall$', '$', 'one'])[page_id % 4 + 1] as s from pages) select k, case k % 4 when 0 then 'Plaza 上海市' when 1 then 'Mall 上海市' when 2 then '' else 'one 上海市' end as found, s as payload from s""")
def dollar_split(spark, sf_dir):
    k, raw = F.col("page_id"), choice(F.col("page_id"), "上海市$浦东新区$Plaza $K", "Mall$$Mall$", "$", "one")
    return table(spark, sf_dir, "pages").select(k.alias("k"), F.array_join(text.suggestions(raw), "|").alias("found"), text.jsonp_payload(F.when(k % 2 == 0, F.concat(F.lit(" window.baidu.sug("), raw, F.lit(");"))).otherwise(raw)).alias("payload"))


@bound("""select c_custkey as k, concat_ws('；', case when contains(t, 'internal_sub_poi') then '可能是商场内部店铺/服务点' end, case when contains(t, 'bad_place_hint') then '可能是停车场、入口、交通点或非主体' end, case when contains(t, '停车场') then '停车场点，不宜当作商场中心' end, case when contains(t, '门') or contains(t, '出口') then '门/出入口点，通常偏离主体中心' end, case when contains(t, '地铁') then '靠近地铁相关描述，需确认不是站点' end) as risk
from (select c_custkey, (['internal_sub_poi|x', '', 'bad_place_hint'])[c_custkey % 3 + 1] || ' ' || (['停车场', 'mall', '地铁'])[c_custkey // 3 % 3 + 1] || ' ' || (['东门', '', '出口'])[c_custkey // 9 % 3 + 1] as t from customer)""")
def risk_text(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), text.risk_text(choice(k, "internal_sub_poi|x", None, "bad_place_hint"), choice(F.floor(k / 3), "停车场", "mall", "地铁"), choice(F.floor(k / 9), "东门", "", "出口")).alias("risk"))


@bound(f"""select id, case when id % 6 = 0 then '' else printf('%.4f', bal) end as number, printf('%.3f;%.3f', bal, (id % 7) / 8.0::double) as listed, id || '_' || replace(name, '#', '-') || '_' || printf('%.6f', (id % 50) / 8.0::double) || '_' || printf('%.6f', 1.5::double) || '_z18_64.jpg' as file,
'pv_pixels=' || (id % 90) || '; coverage=' || printf('%.4f', (id % 90) / 8.0::double) || '%; components=' || (id % 3) || '; decision=' || case when id % 2 = 0 then 'suspected_pv' else 'no_pv_or_below_threshold' end as reason, 'geocoded by ArcGIS World Geocoding' || case when id % 100 < 75 then '; low score, needs manual review' else '' end as geocode from {SITE}""")
def format_columns(spark, sf_dir):
    k = F.col("id")
    bal = F.when(k % 6 == 0, F.lit(float("nan"))).otherwise(F.col("bal"))
    return site(spark, sf_dir).select(
        "id", text.fixed_number(bal, 4).alias("number"), text.joined_numbers(F.array(F.col("bal"), (k % 7) / 8.0), 3).alias("listed"), text.crop_file_name(k, F.replace("name", F.lit("#"), F.lit("-")), (k % 50) / 8.0, F.lit(1.5), 64, 18).alias("file"),
        text.detection_reason(k % 90, (k % 90) / 800.0, k % 3, k % 2 == 0).alias("reason"), text.geocode_reason((k % 100).cast("double")).alias("geocode"),
    )


_RAW = """'{"id": "a' || event_id || '", "uid": "b' || event_id || '", "title": "T", "name": "N", "type": "mall", "category": "c", "tag": ' || case when event_id % 2 = 0 then '"shop"' else '""' end || ', "detail_info": {"tag": "inner"}, "area": "E", "adname": "D"}'"""


@bound(f"""select event_id, case event_id % 3 when 1 then 'b' || event_id else 'a' || event_id end as poi_id, (['N', 'N', 'T'])[event_id % 3 + 1] as poi_name, (['D', 'E', ''])[event_id % 3 + 1] as district, case event_id % 3 when 0 then 'mall' when 1 then case when event_id % 2 = 0 then 'shop' else 'inner' end else 'c' end as poi_type, json_extract_string(({_RAW})::json, '$.detail_info.tag') as raw_tag, props->>'$.k' as k from events""")
def json_fields(spark, sf_dir):
    e = F.col("event_id")
    quoted = [F.lit('{"id": "a'), e.cast("string"), F.lit('", "uid": "b'), e.cast("string"), F.lit('", "title": "T", "name": "N", "type": "mall", "category": "c", "tag": '), F.when(e % 2 == 0, '"shop"').otherwise('""'), F.lit(', "detail_info": {"tag": "inner"}, "area": "E", "adname": "D"}')]
    provider, raw = choice(e, "amap", "baidu", "tencent"), F.concat(*quoted)
    kept = F.to_json(F.from_json(raw, "detail_info struct<tag:string>"))  # what is kept of the payload as text
    return table(spark, sf_dir, "events").select("event_id", *[text.payload_field(provider, raw, f).alias(f) for f in ("poi_id", "poi_name", "district", "poi_type")], F.get_json_object(kept, "$.detail_info.tag").alias("raw_tag"), F.get_json_object("props", "$.k").alias("k"))


@bound("select event_id, case event_type when 'click' then 'K' when 'view' then 'V' else '' end as label from events")
def label_map(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.looked_up(F.col("event_type"), {"click": "K", "view": "V"}).alias("label"))


@bound(f"select id, 4 as n, round(lon, 8) as x0, round(lat + 0.01::double, 8) as y2, round(lon + 0.01::double, 6) as cx from {SITE}")
def geojson_roundtrip(spark, sf_dir):
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    rows = site(spark, sf_dir).select("id", text.polygon_json(F.array(corner(0.0, 0.0), corner(0.02, 0.0), corner(0.02, 0.01), corner(0.0, 0.01))).alias("json"))
    # the ring is a column of its own, as plans copy an expression to each place that names it
    rows, ring = rows.select("id", text.polygon_ring(F.col("json")).alias("ring")), F.col("ring")
    return rows.select("id", F.size(ring).alias("n"), F.round(ring[0]["x"], 8).alias("x0"), F.round(ring[2]["y"], 8).alias("y2"), F.round(geo.centroid(ring)[0], 6).alias("cx"))


@bound("select c_custkey, array_to_string(list_distinct(['a']) || case when c_custkey % 2 = 0 then ['b c'] else [] end, '|') as kept from customer")
def unique_list(spark, sf_dir):
    values = F.array(F.lit(" a "), F.lit(""), F.lit("a"), F.when(F.col("c_custkey") % 2 == 0, "b \t c"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.unique_values(values), "|").alias("kept"))


# --- times

@bound("select event_id, ts + interval 12 hours < timestamp '2024-01-15 00:00:00' as expired, strftime(ts, '%Y-%m-%d %H:%M') as label, regexp_full_match(strftime(ts, '%Y%m%d_%H%M%S'), '[0-9]{8}_[0-9]{6}') as is_run from events")
def expiry_filter(spark, sf_dir):
    """Sessions that ended before a fixed instant, and their times as people and run ids write them."""
    until = F.col("ts") + F.make_interval(hours=F.lit(12))
    return table(spark, sf_dir, "events").select("event_id", (until < F.to_timestamp(F.lit("2024-01-15 00:00:00"))).alias("expired"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("label"), F.date_format("ts", "yyyyMMdd_HHmmss").rlike(r"^\d{8}_\d{6}$").alias("is_run"))


@bound("select event_id from events where strftime(ts, '%Y%m%d') = (select max(strftime(ts, '%Y%m%d')) from events where event_id % 2 = 0) and event_id % 2 = 0")
def run_latest(spark, sf_dir):
    from heliosite.sources.tables import latest_run

    run = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd_000000")).otherwise("manual")
    return latest_run(table(spark, sf_dir, "events").withColumn("run_id", run)).select("event_id")


# --- geometry

_AT = "(lon + 180) / 360 * 67108864"
_TO = "(0.5::double - ln((1 + sin(radians({v}))) / (1 - sin(radians({v})))) / (4 * pi())) * 67108864"


@bound(f"""with p as (select a.id as a, b.id as b, (b.lon - a.lon) / 360 * 4194304 + 512 as x, {_TO.format(v='b.lat').replace('67108864', '4194304')} - {_TO.format(v='a.lat').replace('67108864', '4194304')} + 512 as y from {SITE} a join {SITE} b on a.grp = b.grp and a.id < b.id)
select a, b, round(x, 3) as x, round(y / 1024 * 100, 5) as y_pct from p where x between -24 and 1048 and y between -24 and 1048""")
def marker_visible(spark, sf_dir):
    return cells.visible_pairs(site(spark, sf_dir), "grp", "id", 14, 1024, 24).select("a", "b", F.round("m.x", 3).alias("x"), F.round("m.y_pct", 5).alias("y_pct"))


@bound(f"select id, round(lon + (id % 900 - 512) / 67108864.0::double * 360, 7) as lon, round(least(85.05112878::double, 90 - 360 * atan(exp((({_TO.format(v='lat')} + id % 700 - 512) / 67108864 - 0.5::double) * 2 * pi())) / pi()), 7) as lat from {SITE}")
def click_point(spark, sf_dir):
    lon, lat = geo.clicked(F.col("lon"), F.col("lat"), F.col("id") % 900, F.col("id") % 700, 18, 1024)
    return site(spark, sf_dir).select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def _boxes(rows, boxes):
    return rows.select("k", F.explode(boxes).alias("b")).select("k", "b.name", "b.box.*")


_SIZES = "(select o_orderkey as k, 200 + (o_orderkey * 37) % 900 as w, 150 + (o_orderkey * 53) % 700 as h from orders)"
_SIDES = f"(select *, floor(least(w, h) * 0.7::double)::int as s7, floor(least(w, h) * 0.5::double)::int as s5, floor(least(w, h) * 0.8::double)::int as s8, floor(least(w, h) * 0.6::double)::int as s6, floor(least(w, h) * 0.62::double)::int as s2 from {_SIZES})"


def sizes(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), (200 + (k * 37) % 900).cast("int").alias("w"), (150 + (k * 53) % 700).cast("int").alias("h"))


@bound(f"""with a as (select k, w, h, unnest(['full', 'center_70', 'top_left', 'top_right', 'center', 'bottom_left', 'bottom_right']) as name, unnest([0, (w - s7) // 2, 0, w - s5, (w - s5) // 2, 0, w - s5]) as x, unnest([0, (h - s7) // 2, 0, 0, (h - s5) // 2, h - s5, h - s5]) as y, unnest([w, s7, s5, s5, s5, s5, s5]) as sw, unnest([h, s7, s5, s5, s5, s5, s5]) as sh from {_SIDES})
select k, name, x::int as "left", y::int as top, (x + sw)::int as "right", (y + sh)::int as bottom from a""")
def crop_boxes(spark, sf_dir):
    return _boxes(sizes(spark, sf_dir), geo.crop_boxes(F.col("w"), F.col("h")))


@bound(f"""with a as (select k, unnest(['full', 'center_80', 'center_60', 'top_left', 'top_right', 'bottom_left', 'bottom_right']) as name, unnest([0, (w - s8) // 2, (w - s6) // 2, 0, w - s2, 0, w - s2]) as x, unnest([0, (h - s8) // 2, (h - s6) // 2, 0, 0, h - s2, h - s2]) as y, unnest([w, s8, s6, s2, s2, s2, s2]) as sw, unnest([h, s8, s6, s2, s2, s2, s2]) as sh from {_SIDES})
select k, name, x::int as "left", y::int as top, (x + sw)::int as "right", (y + sh)::int as bottom from a""")
def view_boxes(spark, sf_dir):
    return _boxes(sizes(spark, sf_dir), geo.view_boxes(F.col("w"), F.col("h")))


@bound(f"""select k, ((w - least(300, w, h)) // 2)::int as c_left, ((h - least(300, w, h)) // 2 + least(300, w, h))::int as c_bottom, greatest(0, 20 - round_even((k % 61) * 0.25::double, 0))::int as p_left, least(h, 30 + k % 47 + 8)::int as q_bottom from {_SIZES}""")
def padded_boxes(spark, sf_dir):
    k, w, h = F.col("k"), F.col("w"), F.col("h")
    center = geo.center_box(w, h, 300)
    share = geo.padded_box(F.lit(20), F.lit(30), k % 61, k % 47, w, h, ratio=0.25)
    fixed = geo.padded_box(F.lit(20), F.lit(30), k % 61, k % 47, w, h, pixels=8)
    return sizes(spark, sf_dir).select("k", center["left"].alias("c_left"), center["bottom"].alias("c_bottom"), share["left"].alias("p_left"), fixed["bottom"].alias("q_bottom"))


@bound(f"""with v as (select unnest([(0, 0), (500, 0), (-500, 0), (0, 500), (0, -500), (500, 500), (500, -500), (-500, 500), (-500, -500), (1000, 0), (-1000, 0), (0, 1000), (0, -1000)]) as p),
o as (select row_number() over (order by sqrt(p[1]*p[1] + p[2]*p[2]), abs(p[1]) + abs(p[2]), p[1], p[2]) as n, p[1]::double as dx, p[2]::double as dy from v)
select id, n, dx, dy, round(lon + dx / (cos(radians(lat)) * 111320), 9) as lon, round(lat + dy / 111320, 9) as lat from {SITE}, o""")
def sample_offsets(spark, sf_dir):
    """The places to look at about each site."""
    rows = site(spark, sf_dir).select("id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.posexplode(geo.sample_offsets(1000.0, 13)).alias("i", "o"))
    lon, lat = geo.offset_point(F.col("lon0"), F.col("lat0"), F.col("o.dx"), F.col("o.dy"))
    return rows.select("id", (F.col("i") + 1).cast("long").alias("n"), "o.dx", "o.dy", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@bound("with s as (select o_orderkey as k, 300 + (o_orderkey * 37) % 900 as w, 300 + (o_orderkey * 53) % 900 as h from orders), x as (select k, unnest(case when w <= 400 then [0] else list_distinct(range(0, w - 399, 312) || [w - 400]) end) as x, h from s) select k, x::int as x, unnest(case when h <= 400 then [0] else list_distinct(range(0, h - 399, 312) || [h - 400]) end)::int as y from x")
def window_grid(spark, sf_dir):
    k = F.col("o_orderkey")
    grid = geo.windows(300 + (k * 37) % 900, 300 + (k * 53) % 900, 400, 312)
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(grid).alias("p")).select("k", F.col("p.x").cast("int").alias("x"), F.col("p.y").cast("int").alias("y"))


@bound("select l_orderkey, count(*) filter (l_quantity > 25) as on_px, round(count(*) filter (l_quantity > 25) / count(*)::double, 6) as ratio from lineitem group by 1")
def pixel_counts(spark, sf_dir):
    on = F.count_if(F.col("l_quantity") > 25)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(on.alias("on_px"), F.round(on / F.count("*"), 6).alias("ratio"))


# --- recorded scores

@bound("""with e as (select vec_id, vec_id % 25 as site, embedding[1]::double * 4 as pos, embedding[2]::double * 4 as neg, (vec_id * 37) % 900 as px from embeddings), d as (select *, case when pos >= -4 and pos - neg >= 2 then 'pass' when pos - neg >= 0 then 'review' else 'reject' end as decision from e)
select site, count(*) as components, count(*) filter (decision = 'pass') as passed, sum(case when decision = 'pass' then px else 0 end)::bigint as roof_px, string_agg(distinct decision, '|' order by decision) as seen from d group by 1""")
def semantic_rollup(spark, sf_dir):
    """Recorded scores of components, their decisions, and what the accepted ones give a site."""
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select((v % 25).alias("site"), (F.col("embedding")[0].cast("double") * 4).alias("pos"), (F.col("embedding")[1].cast("double") * 4).alias("neg"), ((v * 37) % 900).alias("px"))
    rows = rows.withColumn("decision", decide.semantic_decision(F.col("pos"), F.col("neg")))
    passed = F.col("decision") == "pass"
    return rows.groupBy("site").agg(F.count("*").alias("components"), F.count_if(passed).alias("passed"), F.sum(F.when(passed, F.col("px")).otherwise(0)).alias("roof_px"), F.array_join(F.sort_array(F.collect_set("decision")), "|").alias("seen"))


@bound("""with e as (select event_id, value / 490.02::double as score, event_id % 3 as kept, event_id % 400 as px from events), s as (select *, case when score >= 0.75 then 'likely_pv' when score >= 0.45 then 'possible_pv' else 'no_clear_pv' end as c from e)
select event_id, case when c = 'likely_pv' and kept = 0 then 'possible_pv' else c end as status, case when score >= 0.45 then px else 0 end as area_px from s""")
def gated_scores(spark, sf_dir):
    """Areas are taken only where the score passes the gate; a likely class without a component is only possible."""
    score = F.col("value") / 490.02
    status = decide.demoted(decide.pv_by_score(score), F.col("event_id") % 3)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.when(score >= 0.45, F.col("event_id") % 400).otherwise(0).alias("area_px"))
