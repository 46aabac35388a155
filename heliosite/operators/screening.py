"""The single-map screening of sites as one incremental plan: gate, recorded detections, roll-up, level, resume.

What models see on a site's map comes as a table of recorded detections; everything after them is done here. A run is a
store of batches (``sources.commits``): each takes the next sites that no committed batch has screened well, and its three
tables appear together. A run that is stopped goes on where it was, and ends with the table that an uninterrupted one gives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliosite.functions import decide, geo
from heliosite.operators.ordered import numbered
from heliosite.operators.relational import first_per_key
from heliosite.sources.commits import Store
from heliosite.sources.shared import written

#: Columns of the three result tables.
SELF_COLUMNS = "run_id mall_id name confidence_level center_lon center_lat center_source image_path image_status pv_status pv_confidence pv_area_px pv_area_m2_est pv_coverage component_count mask_path overlay_path reason review_required review_status error method".split()
SUMMARY_COLUMNS = "run_id mall_id name center_lon center_lat buffer_radius_m tile_count downloaded_tile_count roof_candidate_tile_count roof_candidate_count roof_area_m2_est roof_semantic_filter roof_semantic_pass_count roof_semantic_reject_count roof_semantic_review_count existing_pv_tile_count existing_pv_area_m2_est install_condition_score install_condition_level review_required review_status evidence_dir review_mosaic_path method notes image_status error".split()
DETAIL_COLUMNS = "run_id tile_id mall_id name tile_center_lon tile_center_lat offset_x_m offset_y_m distance_to_center_m image_path image_status roof_score roof_candidate_count roof_area_px roof_area_m2_est roof_semantic_filter roof_semantic_pass_count roof_semantic_reject_count roof_semantic_review_count roof_semantic_notes pv_status pv_confidence pv_area_m2_est roof_overlay_path pv_overlay_path error method".split()

#: Recorded for a site: of the whole map, and of the box in its middle (``self_``). ``error`` says why there is nothing.
DETECTION = (
    "mall_id long, image_path string, pv_status string, pv_confidence double, pv_area_px long, roof_area_px long, roof_candidate_count long, "
    "roof_semantic_pass_count long, roof_semantic_reject_count long, roof_semantic_review_count long, roof_semantic_notes string, "
    "self_area_px long, self_box_px long, self_component_count long, mask_path string, overlay_path string, roof_overlay_path string, pv_overlay_path string, review_mosaic_path string, error string"
)


@dataclass(frozen=True)
class ScreenParams:
    run_id: str
    levels: tuple[str, ...] = ("A", "B")
    ids: tuple[int, ...] = ()
    radius_m: int = 1000
    zoom: int = 18
    least_component_px: int = 400
    semantic_filter: str = "on"
    method: str = "single_map"
    evidence_dir: str = ""


def gated(centers: DataFrame, p: ScreenParams) -> DataFrame:
    """The sites to screen: of the wanted levels and ids, with coordinates that are numbers; one row each, the first by its columns."""
    level = F.upper(F.trim(F.coalesce("confidence_level", F.lit(""))))
    number = lambda c: F.col(c).try_cast("double")
    rows = centers.select(
        F.col("mall_id").try_cast("long").alias("mall_id"), F.coalesce(F.nullif("name", F.lit("")), F.lit("mall")).alias("name"), level.alias("confidence_level"), number("center_lon").alias("center_lon"), number("center_lat").alias("center_lat"), F.coalesce("center_source", F.lit("")).alias("center_source"),
    )
    rows = rows.where("mall_id is not null and center_lon is not null and center_lat is not null and not isnan(center_lon) and not isnan(center_lat)")
    if p.levels:
        rows = rows.where(F.col("confidence_level").isin(*p.levels))
    if p.ids:
        rows = rows.where(F.col("mall_id").isin(*p.ids))
    return first_per_key(rows, ["mall_id"], [F.asc(c) for c in rows.columns])


def screened(sites: DataFrame, detections: DataFrame, p: ScreenParams) -> dict[str, DataFrame]:
    """The three tables of some sites. A site without a detection, or with a failed one, gives error rows."""
    both = sites.join(first_per_key(detections, ["mall_id"], [F.asc_nulls_first("error"), *[F.asc(c) for c in detections.columns if c not in ("mall_id", "error")]]), "mall_id", "left")
    error = F.when(F.col("pv_status").isNull() & (F.coalesce("error", F.lit("")) == ""), "no detection").otherwise(F.coalesce("error", F.lit("")))
    both = both.withColumn("error", error).withColumn("ok", F.col("error") == "").withColumn("mpp", geo.metres_per_pixel(F.col("center_lat"), p.zoom))
    if_ok = lambda value, other=None: F.when(F.col("ok"), value).otherwise(F.lit(other))
    area = lambda px: F.round(geo.area_m2(F.col(px), F.col("mpp")), 2)
    roof_m2 = area("roof_area_px")
    score = decide.roof_score(roof_m2, F.col("roof_candidate_count"))
    status = F.when(F.col("pv_area_px") >= p.least_component_px, F.col("pv_status")).otherwise("no_clear_pv")
    coverage = F.when(F.col("self_box_px") > 0, F.col("self_area_px") / F.col("self_box_px")).otherwise(0.0)
    common = {
        "run_id": F.lit(p.run_id), "image_status": if_ok(F.lit("ok"), "error"), "review_required": F.lit(1), "review_status": F.lit("pending"), "method": F.lit(p.method), "roof_semantic_filter": if_ok(F.lit(p.semantic_filter)),
        "roof_area_m2_est": if_ok(roof_m2), **{c: if_ok(F.col(c)) for c in ("image_path", "pv_confidence", "roof_candidate_count", "roof_area_px", "roof_semantic_pass_count", "roof_semantic_reject_count", "roof_semantic_review_count", "roof_semantic_notes", "mask_path", "overlay_path", "roof_overlay_path", "pv_overlay_path", "review_mosaic_path")},
    }
    own = common | {
        "pv_status": if_ok(decide.mask_class(F.col("self_area_px"), coverage), "not_checked"), "pv_area_px": if_ok(F.col("self_area_px")), "pv_area_m2_est": if_ok(area("self_area_px")), "pv_coverage": if_ok(F.round(coverage, 6)),
        "component_count": if_ok(F.col("self_component_count")), "reason": if_ok(F.lit("center of the whole map's mask")),
    }
    summary = common | {
        "buffer_radius_m": F.lit(p.radius_m), "tile_count": F.lit(1), "downloaded_tile_count": F.col("ok").cast("int"), "roof_candidate_tile_count": if_ok((F.col("roof_candidate_count") > 0).cast("int")),
        "existing_pv_tile_count": if_ok(status.isin("possible_pv", "likely_pv").cast("int")), "existing_pv_area_m2_est": if_ok(area("pv_area_px")), "install_condition_score": if_ok(score),
        "install_condition_level": if_ok(decide.condition_level(score, roof_m2, F.lit(1)), "unknown"), "evidence_dir": F.lit(p.evidence_dir), "notes": if_ok(F.lit("one whole map; manual review required"), ""),
    }
    detail = common | {
        "tile_id": F.concat(F.lit("mall_"), F.col("mall_id").cast("string"), F.lit(f"_full_{p.radius_m}m")), "tile_center_lon": F.col("center_lon"), "tile_center_lat": F.col("center_lat"), "offset_x_m": F.lit(0), "offset_y_m": F.lit(0), "distance_to_center_m": F.lit(0),
        "roof_score": if_ok(score), "pv_status": if_ok(status, "not_checked"), "pv_area_m2_est": if_ok(area("pv_area_px")),
    }

    def table(columns: list[str], made: dict[str, Column]) -> DataFrame:
        return both.select([(made[c] if c in made else F.col(c)).alias(c) for c in columns])

    return {"self": table(SELF_COLUMNS, own), "summary": table(SUMMARY_COLUMNS, summary), "detail": table(DETAIL_COLUMNS, detail)}


def run(store: Store, centers: DataFrame, detections: DataFrame, p: ScreenParams, every: int, most: int | None = None) -> int:
    """Screen what the store hasn't screened well yet, ``every`` sites a batch in the order of mall_id; the number of batches committed. ``most``: stop after so many.

    Sites that failed in an earlier call are tried again, once a call.
    """
    done = store.read("summary", "run_id string, mall_id long, image_status string").where(F.col("image_status") == "ok").select("mall_id")
    pending = written(numbered(written(gated(centers, p).join(done, "mall_id", "left_anti")), ["mall_id"]))
    left, first, made = pending.count(), len(store.batches()), 0
    while made * every < left and (most is None or made < most):
        sites = pending.where(F.floor(F.col("idx") / every) == made).drop("idx")
        store.commit(f"{p.run_id}-{first + made:06d}", screened(sites, detections, p))
        made += 1
    return made


def results(store: Store) -> dict[str, DataFrame]:
    """The three tables with the last row of each site."""
    return {name: first_per_key(store.read(name), ["mall_id"], [F.desc("batch")]).drop("batch") for name in ("self", "summary", "detail")}
