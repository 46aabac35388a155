"""Scores of place candidates with the flags that explain them, and the classes drawn from both.

Fixed values: hint words, weights and thresholds equal the recorded ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliosite.functions import text


@dataclass(frozen=True)
class Hints:
    """Words that decide on a candidate's kind."""

    mall: tuple[str, ...] = ("mall", "购物中心", "商场", "商业", "商业中心", "商业综合体", "广场", "百货", "大悦城", "印象城", "万象", "天街", "合生汇", "来福士", "奥特莱斯")
    bad: tuple[str, ...] = ("地铁", "地铁站", "公交", "公交站", "火车站", "高铁站", "车站", "停车场", "路口", "交叉口", "道路", "学校", "医院", "酒店", "公寓", "小区", "餐厅", "咖啡", "麦当劳", "肯德基", "星巴克", "项目部", "施工", "建设中", "地块")
    main_type: tuple[str, ...] = ("商场", "购物中心", "综合商场", "百货", "商业综合体", "奥特莱斯", "购物公园")
    good_type: tuple[str, ...] = ("购物", "商场", "商业", "百货", "购物服务", "综合商场")
    inner_name: tuple[str, ...] = ("停车场", "出口", "入口", "店)", "店）", "打卡点", "警务室", "服务台", "客服中心", "卫生间", "厕所", "电梯", "扶梯", "长梯", "楼", "层", "B1", "B2", "B3", "F1", "F2", "F3", "L1", "L2", "L3")
    inner_type: tuple[str, ...] = ("停车场", "停车场出入口", "餐饮服务", "快餐厅", "中餐厅", "专卖店", "服饰鞋包", "钟表店", "体育休闲服务", "政府机构", "公安警察", "风景名胜", "观景点")


@dataclass(frozen=True)
class RelocationHints:
    mall: tuple[str, ...] = ("mall", "购物中心", "商场", "商业", "商业体", "商业中心", "广场", "百货", "印象城", "万象", "龙湖", "天街", "大悦城", "环宇城", "合生汇", "久光", "汇金", "港汇", "来福士", "大融城", "南丰城", "奥特莱斯")
    bad: tuple[str, ...] = ("地铁站", "地铁", "公交站", "公交", "火车站", "高铁站", "汽车站", "车站", "车库", "停车场", "道路", "路口", "交叉口", "公园", "小区", "公寓", "酒店", "学校", "医院", "农场", "建设中", "施工", "地块", "项目部")
    city: tuple[str, str] = ("上海市", "上海")


def _sum(*terms: tuple[Column, float] | Column) -> Column:
    return sum((F.when(t[0], F.lit(float(t[1]))).otherwise(0.0) if isinstance(t, tuple) else t for t in terms), F.lit(0.0))


def _blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def identity_score(names: dict[str, Column], place: Column, kind: Column, provider: Column, similarity: Column, in_region: Column, hints: Hints = Hints()) -> tuple[Column, Column]:
    """(score, array of flags) of an official candidate; ``provider`` is its share from the rank.

    ``names``: normal forms of the site's name (normal), of its core (core), of the candidate's place (other) and of all it says of itself (whole), and
    compact forms of the place (short), the name (short_name) and its core (short_core), as ``operators.places.identity_scored`` makes them once a row.
    """
    place, kind = _blank(place), _blank(kind)
    both = F.concat_ws(" ", place, kind)
    core, normal, other, whole = (names[c] for c in ("core", "normal", "other", "whole"))
    exact = ((other != "") & ((other == normal) | (other == core))) | ((names["short"] != "") & ((names["short"] == names["short_name"]) | (names["short"] == names["short_core"])))
    held = ~exact & (core != "") & F.contains(whole, core)
    weak = ~exact & ~held & (similarity < 0.25)
    main = text.has_any(kind, hints.main_type)
    hinted = ~main & (text.has_any(both, hints.mall) | text.has_any(kind, hints.good_type))
    inner = (text.has_any(place, hints.inner_name) | text.has_any(kind, hints.inner_type)) & ~(exact & main)
    bad, generic = text.has_any(both, hints.bad), F.length(other) <= 2
    score = _sum(
        provider.cast("double"), similarity * 45.0, (in_region, 15), (~in_region, -45), (exact, 30), (held, 18), (weak, -18), (main, 22), (hinted, 10), (inner, -36), (bad, -28), (generic, -8),
    )
    flags = text.flags(
        (~in_region, "outside_target_bbox"), (weak, "weak_name_match"), (main, "main_mall_type"), (~main & ~hinted, "no_mall_hint"), (inner, "internal_sub_poi"), (bad, "bad_place_hint"), (generic, "generic_candidate"),
    )
    return score, flags


# Kinds of open map data that are places to shop, and those that are stops.
PLACE_KINDS = ("mall", "commercial", "retail", "department_store", "supermarket", "shopping_centre", "marketplace")
STOP_KINDS = ("station", "subway_entrance", "bus_stop", "parking")


def open_map_score(kind: Column, klass: Column, importance: Column) -> tuple[Column, Column]:
    """(score from 0 to 100, "POI" or "OSM") of a candidate of the open map."""
    kind, share = _blank(kind), F.coalesce(text.to_float(importance), F.lit(0.0))
    raw = 45.0 + F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))) * 45.0 + _sum((kind.isin(*PLACE_KINDS), 18), (kind.isin(*STOP_KINDS), -22))
    place = kind.isin(*PLACE_KINDS) | F.coalesce(klass.isin("shop", "amenity", "building"), F.lit(False))
    return F.greatest(F.lit(0.0), F.least(raw, F.lit(100.0))), F.when(place, "POI").otherwise("OSM")


def relocation_score(
    name: Column, provider: Column, similarity: Column, place: Column, matched: Column, address: Column, city: Column, region: Column, address_kind: Column, place_kind: Column, in_box: Column, hints: RelocationHints = RelocationHints(),
) -> tuple[Column, Column, Column]:
    """(score, confidence, array of flags) of a relocation candidate."""
    place, matched, address, city, region, address_kind, place_kind = (_blank(c) for c in (place, matched, address, city, region, address_kind, place_kind))
    said = F.concat_ws(" ", place, matched, address, city, region, address_kind, place_kind)
    core = text.normalize_name(text.core_name(name), text.RELOCATION_TOKENS)
    is_place = F.contains(F.upper(address_kind), F.lit("POI"))
    street = ~is_place & F.lower(address_kind).isin("locality", "streetname", "pointaddress", "streetaddress")
    long_city, short_city = hints.city
    elsewhere = (city != "") & (city != long_city) & ~F.contains(F.concat_ws(" ", city, region, address, matched), F.lit(short_city))
    held = (core != "") & F.contains(text.normalize_name(said, text.RELOCATION_TOKENS), core)
    weak, mall, bad = ~held & (similarity < 0.28), text.has_any(said, hints.mall), text.has_any(said, hints.bad)
    nameless = (place == "") & (matched == "")
    generic = F.length(text.normalize_name(F.coalesce(F.nullif(place, F.lit("")), matched), text.RELOCATION_TOKENS)) <= 2
    score = _sum(
        F.greatest(F.lit(0.0), F.least(provider.cast("double"), F.lit(100.0))) / 100.0 * 28.0, similarity * 42.0, (in_box, 12), (~in_box, -45), (is_place, 15), (street, -18), (elsewhere, -25),
        (mall, 8), (held, 15), (weak, -16), (bad, -20), (nameless, -15), (generic, -10),
    )
    other_kind = F.when(~is_place & (address_kind != ""), F.concat(F.lit("addr_type_"), address_kind))
    flags = F.concat(
        text.flags((~in_box, "outside_shanghai_bbox")), F.array_compact(F.array(other_kind)),
        text.flags((elsewhere, "city_not_shanghai"), (~mall, "no_mall_hint"), (weak, "weak_name_match"), (bad, "bad_place_hint"), (nameless, "blank_name"), (generic, "generic_candidate")),
    )
    confidence = (
        F.when((score >= 78) & (similarity >= 0.38) & in_box & is_place, "high")
        .when((score >= 58) & (similarity >= 0.24) & in_box, "medium")
        .when((score >= 38) & in_box, "low")
        .otherwise("unresolved")
    )
    return F.round(score, 3), confidence, flags


# Flags that bar a relocated center from use.
SEVERE = ("outside_shanghai_bbox", "bad_place_hint", "city_not_shanghai")


def any_flag(flags: Column, wanted: tuple[str, ...] = SEVERE) -> Column:
    """Whether one of the flags of a "a|b" text is ``wanted``: whole names, blanks around them ignored."""
    return F.exists(F.split(_blank(flags), r"\|"), lambda f: F.trim(f).isin(*wanted))


def usability(confidence: Column, lon: Column, lat: Column, flags: Column) -> Column:
    """high, medium or review, from coordinates as text and flags as "a|b"."""
    usable = (_blank(lon) != "") & (_blank(lat) != "") & ~any_flag(flags)
    return F.when(usable & (confidence == "high"), "high").when(usable & (confidence == "medium"), "medium").otherwise("review")


def usability_reasons(confidence: Column, lon: Column, lat: Column, flags: Column) -> Column:
    """Why a row isn't used as it is, in order; empty for a usable one. Weak and generic matches count wherever the text of the flags holds them."""
    grade, missing = usability(confidence, lon, lat, flags), (_blank(lon) == "") | (_blank(lat) == "")
    has = lambda word: F.contains(_blank(flags), F.lit(word))
    listed = F.array_compact(
        F.array(
            F.when(confidence.isin("low", "unresolved"), F.concat(F.lit("confidence_"), confidence)), F.when(any_flag(flags), "severe_flag"),
            F.when(has("weak_name_match"), "weak_name_match"), F.when(has("generic_candidate"), "generic_candidate"), F.when(missing, "no_usable_coordinate"),
        )
    )
    return F.when(grade == "high", F.array().cast("array<string>")).when(grade == "medium", F.array(F.lit("medium_confidence_manual_spot_check"))).otherwise(listed)


@dataclass(frozen=True)
class QualityWords:
    """Names of flags and classes, and the words that a row's addresses are held against."""

    city: str = "上海"
    elsewhere: tuple[str, ...] = ("浙江", "江苏", "舟山", "宿迁", "南宁", "宁波", "苏州", "杭州", "南京", "嘉兴", "湖州", "无锡", "常州")
    generic: tuple[str, ...] = ("中心", "浦东新区", "闵行区", "普陀区", "嘉定区", "上海市", "公交站", "地铁站", "道路", "路")
    missing: str = "图片缺失"
    outside: str = "坐标不在上海范围"
    low_score: str = "地理编码分数低"
    repaired: str = "坐标经过修复"
    no_city: str = "原始地址不含上海"
    other_city: str = "原始地址疑似外地/异常"
    too_generic: str = "地理编码结果过于泛化"
    flat: str = "影像对比度异常低"
    green: str = "绿地占比过高"
    green_center: str = "中心区域非绿地占比低"
    no_roof: str = "缺少大尺度矩形屋顶证据"
    classes: tuple[str, str, str] = ("剔除", "需复核", "通过")


def quality_flags(
    image_exists: Column, in_box: Column, geocode_score: Column, repaired: Column, location: Column, geocode_address: Column, std: Column, vegetation: Column, center: Column, rectangle: Column, words: QualityWords = QualityWords(),
) -> tuple[Column, Column]:
    """(array of flags, class) of a row of the dataset. Numbers are doubles in which null or NaN means unknown; a geocode score that is unknown counts as low."""
    below = lambda v, most: F.coalesce((v < most) & ~F.isnan(v), F.lit(False))
    above = lambda v, least: F.coalesce((v > least) & ~F.isnan(v), F.lit(False))
    location, address = _blank(location), _blank(geocode_address)
    holds = lambda part: F.contains(location, F.lit(part))
    gone, outside = ~F.coalesce(image_exists, F.lit(False)), ~F.coalesce(in_box, F.lit(False))
    low = geocode_score.isNull() | F.isnan(geocode_score) | (geocode_score < 80)
    no_city, other = ~holds(words.city), F.exists(F.array(*[F.lit(w) for w in words.elsewhere]), lambda w: F.contains(location, w))
    generic = address.isin(*words.generic)
    visual = [(above(vegetation, 0.55), words.green), (below(center, 0.35), words.green_center), (below(rectangle, 0.015), words.no_roof)]
    flags = text.flags(
        (gone, words.missing), (outside, words.outside), (low, words.low_score), (F.coalesce(repaired, F.lit(False)), words.repaired), (no_city, words.no_city), (other, words.other_city), (generic, words.too_generic),
        (below(std, 18), words.flat), *visual,
    )
    reject, review, passed = words.classes
    seen = sum((c.cast("int") for c, _ in visual), F.lit(0))
    return flags, F.when(gone | outside, reject).when(low | no_city | other | generic | (seen >= 2), review).otherwise(passed)


def review_error(level: Column, lon: Column, lat: Column, levels: tuple[str, ...] = ("A", "B", "C", "D")) -> Column:
    """What bars a review from being saved; null if nothing does. A and B need both coordinates."""
    level = F.upper(F.trim(_blank(level)))
    return F.when(~level.isin(*levels), "Invalid decision level").when(level.isin("A", "B") & (lon.isNull() | lat.isNull()), "A/B must provide final lon/lat")


def gate_error(status: Column, path: Column) -> Column:
    """Why an image isn't processed; null if it is."""
    return F.when(F.coalesce(status != "ok", F.lit(True)), F.concat(F.lit("image_status="), _blank(status))).when(F.trim(_blank(path)) == "", "missing image_path")


def effective_status(status: Column, pixels: Column, least: int) -> Column:
    """The detector's class where enough pixels stand behind it, else blank."""
    return F.when(pixels >= least, status).otherwise("")
