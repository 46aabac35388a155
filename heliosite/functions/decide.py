"""Decisions as CASE expressions. Thresholds and names in the defaults and branches equal the recorded ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tiers(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step that ``value`` reaches."""
    out = F.lit(last)
    for least, name in reversed(steps):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


def name_evidence(similarity: Column, strong: float = 0.52, medium: float = 0.34) -> Column:
    return tiers(similarity, [(strong, "strong"), (medium, "medium")], "weak")


def coordinate_evidence(agreeing: Column, providers: Column, evidence: Column, score: Column) -> Column:
    return F.when(agreeing >= 2, "multi_provider_agree").when((providers >= 1) & (evidence == "strong") & (score >= 62), "single_provider_strong").otherwise("weak_or_disputed")


def image_evidence(decision: Column, delta: Column, least: float = 0.5) -> Column:
    return (
        F.when(decision.isNull(), "not_available")
        .when((decision == "candidate_center_likely_mall") & (delta >= least), "candidate_image_mall_like")
        .when(decision == "old_image_more_mall_like", decision)
        .when(decision.isin("both_unclear_or_non_mall", "candidate_unclear_no_old_image"), "not_mall_like_or_unclear")
        .otherwise("manual_review_or_not_available")
    )


def identity_status(name: Column, coordinates: Column, image: Column, bad_place: Column, in_region: Column) -> Column:
    agreed = (coordinates == "multi_provider_agree") & image.isin("candidate_image_mall_like", "not_available")
    alone = (coordinates == "single_provider_strong") & (image == "candidate_image_mall_like")
    return F.when(bad_place | ~in_region, "reject_candidate").when((name == "strong") & (agreed | alone), "auto_pass").otherwise("manual_review")


def confidence_level(status: Column, name: Column, coordinates: Column, image: Column) -> Column:
    best = (name == "strong") & (coordinates == "multi_provider_agree") & image.isin("candidate_image_mall_like", "not_available")
    return F.when((status == "auto_pass") & best, "A").when(status == "auto_pass", "B").when(status == "manual_review", "C").otherwise("D")


def identity_reasons(status: Column, name: Column, coordinates: Column, image: Column, agreeing: Column) -> Column:
    conflict = F.when((status == "manual_review") & (image == "old_image_more_mall_like") & (agreeing < 2), "old_image_conflicts_with_official_candidate")
    listed = F.array_compact(F.array(F.concat(F.lit("name_match_"), name), coordinates, image, conflict))
    return F.when(status == "reject_candidate", F.array(F.lit("bad_place_or_outside_target_region"))).otherwise(listed)


def review_status(level: Column) -> Column:
    return F.when(level == "A", "approved_auto").when(level == "B", "approved_auto_sample_check").when(level == "C", "needs_manual_review").otherwise("blocked_unresolved")


def enters(level: Column) -> Column:
    return level.isin("A", "B").cast("int")


def provider_score(rank: Column) -> Column:
    return F.greatest(F.lit(0), 25 - 2 * (rank - 1))


def pv_by_score(score: Column, possible: float = 0.45, likely: float = 0.75) -> Column:
    return tiers(score, [(likely, "likely_pv"), (possible, "possible_pv")], "no_clear_pv")


def pv_by_confidence(has_pv: Column, confidence: Column, coverage: Column) -> Column:
    return F.when(has_pv & (confidence >= 0.65), "likely_pv").when(has_pv | (confidence >= 0.48) | (coverage >= 0.001), "possible_pv").otherwise("no_clear_pv")


def pv_by_pixels(pixels: Column, ratio: Column, likely: tuple[int, float] = (1200, 0.003), possible: tuple[int, float] = (400, 0.001)) -> Column:
    both = lambda t: (pixels >= t[0]) & (ratio >= t[1])
    return F.when(both(likely), "likely_pv").when(both(possible), "possible_pv").otherwise("no_clear_pv")


def mask_class(pixels: Column, ratio: Column) -> Column:
    return pv_by_pixels(pixels, ratio, (1000, 0.001), (500, float("-inf")))


def demoted(status: Column, components: Column) -> Column:
    return F.when((status == "likely_pv") & (components == 0), "possible_pv").otherwise(status)


def potential(roof_ratio: Column, pv_ratio: Column) -> Column:
    return F.when((roof_ratio >= 0.04) & (pv_ratio < 0.02), "high").otherwise(tiers(roof_ratio, [(0.006, "medium")], "low"))


def potential_reason(level: Column) -> Column:
    return (
        F.when(level == "high", "large regular roof candidates and limited existing PV detected")
        .when(level == "medium", "some roof candidates exist; manual review needed")
        .otherwise("few large regular roof candidates in this crop")
    )


def condition_level(score: Column, area_m2: Column, tiles: Column) -> Column:
    return (
        F.when(tiles == 0, "unknown")
        .when((score >= 0.60) & (area_m2 >= 20_000), "high")
        .when((score >= 0.30) & (area_m2 >= 8_000), "medium")
        .otherwise(tiers(area_m2, [(3_000, "low")], "not_obvious"))
    )


def roof_score(area_m2: Column, components: Column, area_at: float = 25_000.0, components_at: float = 10.0) -> Column:
    """Mean of two shares, each at most 1."""
    return (F.least(F.lit(1.0), area_m2 / area_at) + F.least(F.lit(1.0), components / components_at)) / 2


def image_decision(old: Column, new: Column, passes: float = 0.5, margin: float = 0.1) -> Column:
    return (
        F.when(new.isNull() & (old >= passes), "old_image_mall_like_no_candidate")
        .when(new.isNull(), "no_candidate_coordinate")
        .when(old.isNull() & (new >= passes), "candidate_center_likely_mall")
        .when(old.isNull(), "candidate_unclear_no_old_image")
        .when((new >= passes) & (new >= old + margin), "candidate_center_likely_mall")
        .when((old >= passes) & (old >= new + margin), "old_image_more_mall_like")
        .when((new < passes) & (old < passes), "both_unclear_or_non_mall")
        .otherwise("needs_manual_review")
    )


def image_priority(decision: Column) -> Column:
    return F.when(decision.isin("no_candidate_coordinate", "candidate_center_likely_mall", "old_image_more_mall_like"), "high").otherwise("medium")


def quality_status(flags: Column, hard: tuple[str, ...], risky: tuple[str, ...], visual: tuple[str, ...]) -> Column:
    """reject for a hard flag, review for a risky one or two visual ones, else pass."""
    any_of = lambda names: F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))
    seen = F.size(F.array_intersect(flags, F.array(*[F.lit(n) for n in visual])))
    return F.when(any_of(hard), "reject").when(any_of(risky) | (seen >= 2), "review").otherwise("pass")


def center_default(manual: Column, automatic: Column) -> Column:
    """Zero counts as missing."""
    return F.coalesce(F.nullif(manual, F.lit(0.0)), automatic)


def append_once(reason: Column, note: str) -> Column:
    return F.when(F.coalesce(reason, F.lit("")) == "", F.lit(note)).when(F.contains(reason, F.lit(note)), reason).otherwise(F.concat(reason, F.lit("; "), F.lit(note)))


def analysis_ready(flag: Column, level: Column) -> Column:
    """An explicit flag decides, else levels A and B; false where both are blank."""
    flag, level = F.lower(F.trim(F.coalesce(flag, F.lit("")))), F.upper(F.trim(F.coalesce(level, F.lit(""))))
    return F.when(flag != "", flag.isin("1", "true", "yes", "y")).otherwise(level.isin("A", "B"))


def semantic_decision(positive: Column, negative: Column, least: float = -4.0, passes: float = 2.0, reviews: float = 0.0) -> Column:
    delta = positive - negative
    return F.when((positive >= least) & (delta >= passes), "pass").when(delta >= reviews, "review").otherwise("reject")


def softmax_share(positive: Column, negative: Column) -> Column:
    """The share of the positive logits in the softmax over both arrays."""
    top = F.greatest(F.array_max(positive), F.array_max(negative)).cast("double")
    total = lambda xs: F.aggregate(F.transform(xs, lambda x: F.exp(x.cast("double") - top)), F.lit(0.0), lambda s, x: s + x)
    return total(positive) / (total(positive) + total(negative))


def semantic_keep(delta: Column, share: Column, least_delta: float = 0.04, least_share: float = 0.46) -> Column:
    return (delta >= least_delta) & (share >= least_share)


def pv_decision(pixels: Column, coverage: Column, components: Column, score: Column, least_pixels: int, least_coverage: float) -> tuple[Column, Column]:
    """(has_pv, confidence); the confidence of a negative stays under one half."""
    has_pv = (pixels >= least_pixels) & (coverage >= least_coverage) & ((components >= 2) | (coverage >= least_coverage * 3))
    full = lambda share: F.least(share, F.lit(1.0))
    confidence = F.least(F.lit(0.98), 0.2 + 0.35 * full(pixels / max(least_pixels, 1)) + 0.25 * full(coverage / max(least_coverage, 1e-9)) + 0.2 * score)
    return has_pv, F.when(has_pv, confidence).otherwise(F.least(confidence, F.lit(0.49)))


def visual_consistency(mall: Column, negative: Column, quality: Column) -> Column:
    """pass, review or reject, from image scores and an earlier verdict of the same three names."""
    delta, passed = mall - negative, quality == "pass"
    return (
        F.when(quality == "reject", "reject")
        .when((delta >= 0.08) & (mall >= 0.55) & passed, "pass")
        .when((delta >= 0.02) & (mall >= 0.50), F.when(passed, "pass").otherwise("review"))
        .when((delta >= -0.08) | (mall >= 0.40), "review")
        .otherwise("reject")
    )
