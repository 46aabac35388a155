"""Composite plans over tables of sites, their candidates and what was seen of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliosite.functions import decide, geo, scores, text
from heliosite.operators.relational import first_per_key


def viable(candidates: DataFrame) -> DataFrame:
    """Candidates with coordinates, inside the region, and without a flag that names a bad place."""
    return candidates.where(F.col("in_region") & F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "bad_place_hint"))


def agreement_of_best(candidates: DataFrame, radius_m: float = 150.0) -> DataFrame:
    """A row for each site with a viable candidate: its best one, and how far others agree with it.

    Best by score, similarity, rank, then the first seen (``seq``). Rows within ``radius_m`` of it agree, itself included;
    the center is their mean, ``nearest`` the least distance to one of another provider.
    """
    rows = viable(candidates)
    best = first_per_key(rows, ["site_id"], [F.desc("score"), F.desc("similarity"), F.asc("rank"), F.asc("seq")])
    anchor = best.select("site_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.col("provider").alias("provider0"))
    near = rows.select("site_id", "provider", "lon", "lat").join(anchor, "site_id").withColumn("d", geo.haversine_m(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")))
    close = F.col("d") <= radius_m
    met = near.groupBy("site_id").agg(
        F.count_distinct("provider").alias("providers"), F.count_distinct(F.when(close, F.col("provider"))).alias("agreeing"),
        F.min(F.when(close & (F.col("provider") != F.col("provider0")), F.col("d"))).alias("nearest"), F.avg(F.when(close, F.col("lon"))).alias("center_lon"), F.avg(F.when(close, F.col("lat"))).alias("center_lat"),
    )
    return best.drop("lon", "lat").join(met, "site_id")


def identity_summary(sites: DataFrame, candidates: DataFrame, images: DataFrame, radius_m: float = 150.0, strong: float = 0.52, medium: float = 0.34, image_least: float = 0.5) -> DataFrame:
    """A row for each of ``sites`` (site_id, name): its best official candidate, the evidence for it, its level and whether it enters analysis.

    ``candidates``: site_id, seq, provider, rank, place, lon, lat, in_region, similarity, score, flags. ``images``: site_id,
    decision, delta, at most one row a site. A site without a viable candidate is rejected.
    """
    found = agreement_of_best(candidates, radius_m)
    rows = sites.select("site_id", "name").join(found, "site_id", "left").join(images.select("site_id", "decision", "delta"), "site_id", "left")
    none = F.col("score").isNull()
    rows = rows.withColumn("image_evidence", decide.image_evidence(F.col("decision"), F.col("delta"), image_least))
    rows = rows.withColumn("name_evidence", F.when(none, "none").otherwise(decide.name_evidence(F.col("similarity"), strong, medium)))
    rows = rows.withColumn("coordinate_evidence", F.when(none, "none").otherwise(decide.coordinate_evidence(F.col("agreeing"), F.col("providers"), F.col("name_evidence"), F.col("score"))))
    name, coordinates, image = F.col("name_evidence"), F.col("coordinate_evidence"), F.col("image_evidence")
    rows = rows.withColumn("identity_status", decide.identity_status(name, coordinates, image, none, ~none))
    reasons = F.when(none, F.array(F.lit("no_viable_official_poi"))).otherwise(decide.identity_reasons(F.col("identity_status"), name, coordinates, image, F.col("agreeing")))
    rows = rows.withColumn("identity_reasons", F.array_join(reasons, "|")).withColumn("level", decide.confidence_level(F.col("identity_status"), name, coordinates, image))
    return rows.select(
        "site_id", "name", "center_lon", "center_lat", F.coalesce("provider", F.lit("")).alias("provider"), F.coalesce("place", F.lit("")).alias("place"), "similarity", F.coalesce("providers", F.lit(0)).alias("providers"),
        F.coalesce("agreeing", F.lit(0)).alias("agreeing"), "nearest", "score", "name_evidence", "coordinate_evidence", "image_evidence", "identity_status", "identity_reasons", "level",
    )


def resolved(summary: DataFrame) -> DataFrame:
    """What analysis takes from a summary: a center only where the level lets the site enter; only A needs no review."""
    enters = decide.enters(F.col("level"))
    only = lambda c: F.when(enters == 1, F.col(c))
    return summary.select(
        "site_id", "name", only("center_lon").alias("center_lon"), only("center_lat").alias("center_lat"), "level", enters.alias("enters"), "identity_status", F.when(enters == 1, "official_poi_point").otherwise("").alias("center_type"),
        F.col("provider").alias("center_source"), "identity_reasons", decide.review_status(F.col("level")).alias("review_status"), (F.col("level") != "A").cast("int").alias("review_required"),
    )


def pick_best(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best candidate of each key; unresolved ones count only where there are no others, and give no coordinates."""
    best = first_per_key(candidates, keys, [F.desc(F.col("confidence") != "unresolved"), *order])
    usable = F.col("confidence") != "unresolved"
    return best.withColumns({c: F.when(usable, F.col(c)) for c in ("lon", "lat")})


def backfilled(sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """``sites`` (site_id, lon, lat, provider, place, address) with missing coordinates taken from a candidate, where something is known of the one once chosen.

    Candidates of the same provider come first, then of the same place, of the same address, then by rank and seq.
    """
    known = F.concat(*[F.coalesce(c, F.lit("")) for c in ("provider", "place", "address")]) != ""
    wants = sites.where((F.col("lon").isNull() | F.col("lat").isNull()) & known).select("site_id", *[F.coalesce(c, F.lit("")).alias(f"{c}_0") for c in ("provider", "place", "address")])
    rows = candidates.where("lon is not null and lat is not null").join(wants, "site_id")
    unlike = lambda c: F.when(F.col(c) == F.col(f"{c}_0"), 0).otherwise(1)
    best = first_per_key(rows, ["site_id"], [unlike("provider"), unlike("place"), unlike("address"), F.asc_nulls_first("rank"), F.asc("seq")])
    both = sites.join(best.select("site_id", F.col("lon").alias("lon_0"), F.col("lat").alias("lat_0")), "site_id", "left")
    fill = F.col("lon_0").isNotNull()
    return both.withColumns({c: F.when(fill, F.col(f"{c}_0")).otherwise(F.col(c)) for c in ("lon", "lat")}).withColumn("filled", fill).drop("lon_0", "lat_0")


def first_inside(answers: DataFrame, keys: list[str], box: tuple[float, ...], order: list[Column]) -> DataFrame:
    """The first answer of each key, in the order asked, that lies in ``box``."""
    return first_per_key(answers.where(geo.in_box(F.col("lon"), F.col("lat"), *[F.lit(x) for x in box])), keys, order)


def located(rows: DataFrame, geocodes: DataFrame, query: Column, least: float = 75.0) -> DataFrame:
    """Rows with lon, lat, status, source and reason: their own coordinates if both are there, else those of ``geocodes`` (query, lon, lat, score, error; one row a query)."""
    asked = rows.withColumn("query", query)
    found = geocodes.select("query", *[F.col(c).alias(f"geo_{c}") for c in ("lon", "lat", "score", "error")], F.lit(True).alias("answered"))
    both = asked.join(found, "query", "left")
    own, no_query, failed, missed = F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.col("query") == "", F.col("geo_error").isNotNull(), F.col("answered").isNull()
    reached = F.col("geo_lon").isNotNull() & F.col("geo_lat").isNotNull()
    status = F.when(own, "ok").when(no_query | failed, "error").when(missed, "not_found").when(reached, "ok").otherwise("error")
    reason = (
        F.when(own, "used lat/lon from input csv").when(no_query, "missing query and coordinates").when(failed, F.concat(F.lit("geocode failed: "), "geo_error")).when(missed, "no geocode candidate")
        .otherwise(F.concat(F.lit("geocoded by ArcGIS World Geocoding"), F.when(F.col("geo_score") < least, "; low score, needs manual review").otherwise("")))
    )
    source = F.when(own, "input_coordinates").when(no_query, "none").otherwise("arcgis")
    taken = {c: F.when(own, F.col(c)).when(~no_query & ~failed, F.col(f"geo_{c}")) for c in ("lon", "lat")}
    return both.withColumns({"status": status, "source": source, "reason": reason, **taken}).drop("answered", *[f"geo_{c}" for c in ("lon", "lat", "score", "error")])


def identity_scored(rows: DataFrame, name: str, said: tuple[str, ...], provider: str, inside: str, hints: scores.Hints = scores.Hints()) -> DataFrame:
    """``rows`` with similarity, score and flags of an official candidate. ``said``: its place, address, kind, city and district.

    Normal forms are columns of their own before they are compared, so that a row's names are cleaned once each. Scores aren't rounded.
    """
    place, _, kind, *_ = said
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    step = rows.withColumns({"_whole": F.concat_ws(" ", *map(blank, said)), "_core": text.core_name(F.col(name))})
    normal = {"normal": F.col(name), "core": F.col("_core"), "other": blank(place), "whole": F.col("_whole")}
    short = {"short": blank(place), "short_name": F.col(name), "short_core": F.col("_core")}
    step = step.withColumns({f"_{c}1": text.normalize_name(v) for c, v in normal.items()} | {f"_{c}1": text.compact(v) for c, v in short.items()})
    step = step.withColumns({f"_{c}2": text.normalize_name(F.col(f"_{c}1")) for c in ("normal", "whole")})
    step = step.withColumns({f"_{c}3": text.bigrams(F.col(f"_{c}2")) for c in ("normal", "whole")} | {f"_{c}4": text.characters(F.col(f"_{c}1")) for c in ("normal", "whole")})
    n, w = ([F.col(f"_{c}{i}") for i in (1, 3, 4)] for c in ("normal", "whole"))
    step = step.withColumn("similarity", text.similarity_of(n[0], w[0], F.length(n[0]), F.length(w[0]), n[1], w[1], n[2], w[2]))
    names = {c: F.col(f"_{c}1") for c in (*normal, *short)}
    score, flags = scores.identity_score(names, F.col(place), F.col(kind), F.col(provider), F.col("similarity"), F.col(inside), hints)
    return step.select(*rows.columns, "similarity", score.alias("score"), flags.alias("flags"))


def fallback_center(sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """``sites`` (site_id, lon, lat) without coordinates take those of their first candidate, by provider and rank, that has both; ``derived`` says where.

    Candidates: site_id, provider, rank, lon, lat, and ``seq`` for the order of equal ones. A site with one coordinate alone counts as without.
    """
    first = first_per_key(candidates.where("lon is not null and lat is not null"), ["site_id"], [F.asc_nulls_first("provider"), F.asc_nulls_first("rank"), F.asc("seq")])
    both = sites.join(first.select("site_id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), "site_id", "left")
    derived = (F.col("lon").isNull() | F.col("lat").isNull()) & F.col("_lon").isNotNull()
    out = {c: F.when(derived, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("lon", "lat")} | {"derived": derived}
    return both.select(*[c for c in sites.columns if c not in out], *[v.alias(c) for c, v in out.items()])


def rolled_tiles(tiles: DataFrame, area_at: float = 50_000.0) -> DataFrame:
    """A row for each mall_id from its tiles (ok, roof_components, roof_area_m2, pv_status, pv_area_m2, method): planned and downloaded tiles, sums, methods, score, level.

    Tiles that aren't ok are planned only. The score weighs the roof area three to one against the share of planned tiles with a roof; the level is unknown where nothing was downloaded.
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    count, total = lambda c: F.count_if(ok & c), lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0.0))
    rolled = tiles.groupBy("mall_id").agg(
        F.count(F.lit(1)).alias("tile_count"), count(F.lit(True)).alias("downloaded_tile_count"), count(F.col("roof_components") > 0).alias("roof_candidate_tile_count"), total("roof_components").cast("long").alias("roof_candidate_count"), total("roof_area_m2").alias("roof_area_m2"),
        count(F.col("pv_status").isin("possible_pv", "likely_pv")).alias("existing_pv_tile_count"), total("pv_area_m2").alias("existing_pv_area_m2"), F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("method")))), "+").alias("methods"),
    )
    share = F.least(F.col("roof_candidate_tile_count") / F.greatest(F.col("tile_count"), F.lit(1)), F.lit(1.0))
    score = F.least(F.lit(1.0), F.col("roof_area_m2") / area_at * 0.75 + share * 0.25)
    scored = rolled.withColumn("install_condition_score", score)
    return scored.withColumn("install_condition_level", decide.condition_level(F.col("install_condition_score"), F.col("roof_area_m2"), F.col("downloaded_tile_count")))
