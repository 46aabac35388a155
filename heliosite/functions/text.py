"""Names, flags and formatted text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliosite.functions.geo import once

# Punctuation dropped from names, and generic tokens removed from them in this order.
NAME_PUNCTUATION = r"(?U)[\s　·•,，.。:：;；!！?？'\"“”‘’()\[\]{}（）【】<>《》/\-|_+&＆]"
GENERIC_TOKENS = ("上海市", "上海", "购物中心", "购物公园", "商场", "商业广场", "商业中心", "商业", "综合体", "广场", "中心", "项目", "一期", "二期", "三期", "mall", "max", "mega")

# The relocation list has the short city name first, so the long one leaves its last character.
RELOCATION_TOKENS = ("上海", "上海市", "购物中心", "购物公园", "商场", "商业广场", "商业中心", "商业", "综合体", "广场", "中心", "项目", "一期", "二期", "三期", "mall", "max", "mega")


def normalize_name(name: Column, tokens: tuple[str, ...] = GENERIC_TOKENS) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), NAME_PUNCTUATION, "")
    for token in tokens:
        out = F.replace(out, F.lit(token), F.lit(""))
    return out


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z一-鿿]+", "")


def core_name(name: Column, cities: tuple[str, ...] = ("上海市", "上海")) -> Column:
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"[（(].*?[）)]", "")
    for city in cities:
        out = F.replace(out, F.lit(city), F.lit(""))
    return F.regexp_replace(out, r"(?U)\s+", "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; one character stands for itself."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, 2))))


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def similarity(a: Column, b: Column, tokens: tuple[str, ...] = GENERIC_TOKENS) -> Column:
    """Containment scores by relative length, else bigram overlap with a share of single characters."""
    n1, n2 = normalize_name(a, tokens), normalize_name(b, tokens)
    grams = [bigrams(normalize_name(n, tokens)) for n in (n1, n2)]
    return similarity_of(n1, n2, F.length(n1), F.length(n2), *grams, characters(n1), characters(n2))


def similarity_of(n1: Column, n2: Column, size1: Column, size2: Column, b1: Column, b2: Column, c1: Column, c2: Column) -> Column:
    """The score of two names from their normal forms, lengths, bigrams and characters."""
    short, long = F.least(size1, size2), F.greatest(size1, size2)
    dice = 2.0 * F.size(F.array_intersect(b1, b2)) / (F.size(b1) + F.size(b2))
    shared = F.size(F.array_intersect(c1, c2)) / F.size(c1)
    mixed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.78 * dice + 0.22 * shared))
    return (
        F.when((n1 == "") | (n2 == ""), F.lit(0.0))
        .when(F.contains(n2, n1) | F.contains(n1, n2), F.least(F.lit(1.0), 0.72 + 0.28 * short / long))
        .when((F.size(b1) == 0) | (F.size(b2) == 0), F.lit(0.0))
        .otherwise(mixed)
    )


def first_filled(*columns: Column) -> Column:
    """First value that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def to_int(text: Column, default: int = 0) -> Column:
    """Lenient: decimals are cut, what can't be read is the default."""
    number = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(default))


def to_float(text: Column) -> Column:
    """Null where it can't be read or isn't a number."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number), number)


def has_any(text: Column, hints: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(h.lower()) for h in hints]), lambda h: F.contains(F.lower(text), h)), F.lit(False))


def flags(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def safe_file_name(text: Column, most: int = 120) -> Column:
    return F.coalesce(F.nullif(F.left(F.trim(F.regexp_replace(text, r"[^0-9A-Za-z一-鿿._-]+", "_")), F.lit(most)), F.lit("")), F.lit("unnamed"))


def slug(text: Column, ordinal: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^0-9a-z一-鿿]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.concat(F.lit("item_"), F.lpad(ordinal.cast("string"), 4, "0")))


def location_part(text: Column, index: int) -> Column:
    """Number ``index`` of a "lon,lat" text."""
    return F.get(F.split(text, ",", 2), F.lit(index)).try_cast("double")


def capped_notes(notes: Column, most: int = 8) -> Column:
    rest = F.size(notes) - most
    return F.array_join(F.when(rest > 0, F.concat(F.slice(notes, 1, most), F.array(F.concat(F.lit("...+"), rest.cast("string"))))).otherwise(notes), "; ")


# Openings of prompts that notes leave out.
PROMPT_OPENINGS = ("a satellite image of ", "a remote sensing image of ", "a top-down image of ", "a commercial or industrial ")


def short_prompt(prompt: Column) -> Column:
    out = F.coalesce(prompt, F.lit(""))
    for opening in PROMPT_OPENINGS:
        out = F.replace(out, F.lit(opening), F.lit(""))
    return out


def component_note(component: Column) -> Column:
    """What was seen of a component: struct(label_id, decision, positive, positive_score, negative, negative_score, delta); a missing decision is a pass."""
    shown = lambda c: F.coalesce(component[c].cast("string"), F.lit(""))
    return F.concat(
        shown("label_id"), F.lit(":"), F.coalesce(component["decision"], F.lit("pass")), F.lit(" pos="), short_prompt(component["positive"]), F.lit("("), shown("positive_score"), F.lit(") neg="), short_prompt(component["negative"]), F.lit("("), shown("negative_score"), F.lit(") d="), shown("delta"),
    )


def mask_stem(stem: Column) -> Column:
    """Lower case, each kind of suffix cut once, in this order."""
    out = F.lower(stem)
    for kind in ("label", "mask", "gt"):
        for mark in "_-":
            out = F.regexp_replace(out, f"{mark}{kind}$", "")
    return out


def keyword_hits(keywords: tuple[str, ...], *columns: Column) -> Column:
    """The keywords that the columns' joined text holds, with pipes between."""
    whole = F.concat_ws(" ", *columns)
    return F.array_join(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(whole, k)), "|")


def unique_values(values: Column) -> Column:
    """Each value with runs of white space as one blank, blank ones dropped, first occurrences kept."""
    clean = F.transform(values, lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"(?U)\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda v: v != ""))


def without_parts(name: Column) -> Column:
    """Without what stands in round brackets of either width."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[（(].*?[）)]", ""))


def search_queries(name: Column, most: int, cities: tuple[str, ...] = ("上海市", "上海"), kinds: tuple[str, ...] = ("购物中心", "商场", "广场", "mall")) -> Column:
    """At most ``most`` spellings of a name to look up: whole, without brackets, without the city, and that with each kind."""
    stripped = without_parts(name)
    bare = stripped
    for city in cities:
        bare = F.replace(bare, F.lit(city), F.lit(""))
    bare = F.trim(bare)
    return F.slice(unique_values(F.array(name, stripped, bare, *[F.concat(bare, F.lit(f" {k}")) for k in kinds])), 1, most)


def repair_queries(name: Column, location: Column, city: str = "上海市") -> Column:
    """The location if it names the city, then the name with the city before or behind it."""
    name, location, here = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(location, F.lit(""))), F.lit(city)
    first = F.when(F.contains(location, here), location)
    return F.array_distinct(F.array_compact(F.array(first, F.concat(here, name), F.concat(name, F.lit(" "), here), F.concat(here, F.lit(" "), name))))


def geocode_query(location: Column, city: Column, name: Column) -> Column:
    """The location, or the city and the name run together."""
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.nullif(part(location), F.lit("")), F.concat(part(city), part(name)))


def address_query(city: Column, address: Column, name: Column) -> Column:
    """The parts that aren't blank, with blanks between."""
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in (city, address, name)]), lambda p: p != ""), " ")


def cut_file_name(text: Column, most: int = 120, fallback: str = "mall") -> Column:
    """Characters that file systems refuse become underscores one by one; blanks, then points are cut at both ends."""
    clean = F.trim(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_"))
    return F.coalesce(F.nullif(F.left(F.regexp_replace(clean, r"^\.+|\.+$", ""), F.lit(most)), F.lit("")), F.lit(fallback))


def joined_file_name(text: Column, most: int = 90, fallback: str = "item") -> Column:
    """Runs of refused characters and of white space become one underscore each; points, underscores and blanks are cut at both ends."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r'[\\/:*?"<>|]+', "_"), r"(?U)\s+", "_")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(clean, r"^[._ ]+|[._ ]+$", ""), F.lit(most)), F.lit("")), F.lit(fallback))


def suggestions(raw: Column, city: str = "上海市", district: str = "区") -> Column:
    """Parts of a "$"-delimited suggestion with the city behind them: not the city, no district, at least two characters."""
    parts = F.filter(F.transform(F.split(raw, r"\$"), lambda p: F.trim(p)), lambda p: (F.length(p) >= 2) & (p != city) & ~F.endswith(p, F.lit(district)))
    return unique_values(F.transform(parts, lambda p: F.concat(p, F.lit(f" {city}"))))


def jsonp_payload(text: Column, call: str = "window.baidu.sug") -> Column:
    """The argument of a JSONP call; other text stays."""
    text = F.trim(text)
    head, tail = f"{call}(", ");"
    return F.when(F.startswith(text, F.lit(head)) & F.endswith(text, F.lit(tail)), F.substring(text, F.lit(len(head) + 1), F.length(text) - len(head) - len(tail))).otherwise(text)


# Marks that a risk text looks for, in this order, with what it then says.
RISKS = (
    (("internal_sub_poi",), "可能是商场内部店铺/服务点"),
    (("bad_place_hint",), "可能是停车场、入口、交通点或非主体"),
    (("停车场",), "停车场点，不宜当作商场中心"),
    (("入口", "出口", "门"), "门/出入口点，通常偏离主体中心"),
    (("地铁",), "靠近地铁相关描述，需确认不是站点"),
    (("办公",), "办公区点，需确认是否代表商场主体"),
)


def risk_text(flags: Column, kind: Column, name: Column, risks=RISKS) -> Column:
    whole = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (flags, kind, name)])
    return F.concat_ws("；", *[F.when(F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(whole, m)), F.lit(said)) for marks, said in risks])


def joined_numbers(values: Column, digits: int = 6, between: str = ";") -> Column:
    """An array of numbers as text with fixed decimals."""
    return F.array_join(F.transform(values, lambda v: F.format_string(f"%.{digits}f", v.cast("double"))), between)


def fixed_number(value: Column, digits: int) -> Column:
    """Text with fixed decimals; null and NaN are empty."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit("")).otherwise(F.format_string(f"%.{digits}f", number))


def crop_file_name(key: Column, name: Column, lon: Column, lat: Column, size: int, zoom: int) -> Column:
    stem = F.concat_ws("_", key.cast("string"), name, fixed_number(lon, 6), fixed_number(lat, 6), F.lit(f"z{zoom}"), F.lit(str(size)))
    return F.concat(cut_file_name(stem), F.lit(".jpg"))


def detection_reason(pixels: Column, coverage: Column, components: Column, has_pv: Column) -> Column:
    said = F.when(has_pv, "decision=suspected_pv").otherwise("decision=no_pv_or_below_threshold")
    return F.concat_ws("; ", F.concat(F.lit("pv_pixels="), pixels.cast("string")), F.concat(F.lit("coverage="), F.format_string("%.4f%%", coverage * 100)), F.concat(F.lit("components="), components.cast("string")), said)


def geocode_reason(score: Column, least: float = 75.0) -> Column:
    return F.concat(F.lit("geocoded by ArcGIS World Geocoding"), F.when(score < least, "; low score, needs manual review").otherwise(""))


# Where each provider's payload keeps the common fields; later paths stand in for blank ones.
PAYLOAD_FIELDS = {
    "amap": {"poi_id": ("id",), "poi_name": ("name",), "address": ("address",), "province": ("pname",), "city": ("cityname",), "district": ("adname",), "poi_type": ("type",)},
    "baidu": {"poi_id": ("uid",), "poi_name": ("name",), "address": ("address",), "province": ("province",), "city": ("city",), "district": ("area",), "poi_type": ("tag", "detail_info.tag")},
    "tencent": {"poi_id": ("id",), "poi_name": ("title",), "address": ("address",), "province": ("province",), "city": ("city",), "district": ("district",), "poi_type": ("category",)},
}


def payload_field(provider: Column, raw: Column, field: str, fields: dict = PAYLOAD_FIELDS) -> Column:
    """One common field of a provider's JSON payload; blank where it is missing. Providers not named are read like the last."""
    read = lambda paths: F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{p}"), F.lit("")) for p in paths], F.lit(""))
    *named, (_, last) = fields.items()
    out = read(last[field])
    for name, paths in reversed(named):
        out = F.when(provider == name, read(paths[field])).otherwise(out)
    return out


def polygon_json(ring: Column) -> Column:
    """GeoJSON of an open ring of struct(x, y): closed, eight decimals; null for fewer than three vertices."""
    points = F.transform(ring, lambda p: F.array(F.round(p["x"], 8), F.round(p["y"], 8)))
    closed = once(points, lambda ps: F.concat(ps, F.slice(ps, 1, 1)))
    return F.when(F.size(ring) >= 3, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))))


def polygon_ring(json: Column) -> Column:
    """The open ring of struct(x, y) of a GeoJSON polygon; a closing vertex goes."""
    outer = F.get(F.from_json(json, "type string, coordinates array<array<array<double>>>")["coordinates"], F.lit(0))
    open_ = lambda o: F.when((F.size(o) > 1) & (F.element_at(o, 1) == F.element_at(o, -1)), F.slice(o, 1, F.size(o) - 1)).otherwise(o)
    return F.transform(once(outer, open_), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def looked_up(key: Column, values: dict[str, str], default: str = "") -> Column:
    """``values`` of a small constant map, else ``default``."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def canonical_json(text: Column) -> Column:
    """JSON text with keys sorted at every depth and no spaces; null where it isn't JSON. Of keys that repeat in an object there is none to choose: null."""
    return F.to_json(F.try_parse_json(text))


def json_fingerprint(text: Column, digits: int = 12) -> Column:
    """First hexadecimal digits of the SHA-1 of the canonical text, the same for any order of keys."""
    return F.left(F.sha1(canonical_json(text).cast("binary")), F.lit(digits))
