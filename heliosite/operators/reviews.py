"""The review workflow as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliosite.functions import decide, text
from heliosite.operators.relational import first_per_key

SECOND = "requires second review"


def requeued(malls: DataFrame, reviews: DataFrame, history: DataFrame, note: str = SECOND, levels: tuple[str, ...] = ("B", "C", "D")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(malls, reviews, history) after reviews of ``levels`` are archived and withdrawn and their sites queued again.

    ``malls``: mall_id, needs_review, reason. ``reviews`` and ``history``: mall_id, level, reviewed_at. A review that history
    has already isn't archived twice. With nothing to archive, every site that history holds at one of ``levels`` is queued.
    The reason gets ``note`` once. Running it again changes nothing.
    """
    due = reviews.where(F.col("level").isin(*levels))
    fresh = due.join(malls.select("mall_id"), "mall_id", "left_semi").join(history, ["mall_id", "level", "reviewed_at"], "left_anti")
    archived = history.unionByName(fresh.select(*history.columns))
    some = fresh.select("mall_id").distinct().withColumn("source", F.lit(0)).unionByName(history.where(F.col("level").isin(*levels)).select("mall_id").distinct().withColumn("source", F.lit(1)))
    first = some.agg(F.min("source").alias("source"))  # 0 if anything was archived
    queued = some.join(F.broadcast(first), "source").select("mall_id", F.lit(True).alias("again"))
    rows = malls.join(queued, "mall_id", "left")
    again = F.coalesce("again", F.lit(False))
    marked = rows.withColumns({"needs_review": F.when(again, 1).otherwise(F.col("needs_review")), "reason": F.when(again, decide.append_once(F.col("reason"), note)).otherwise(F.col("reason"))}).drop("again")
    return marked.select(*malls.columns), reviews.where(~F.coalesce(F.col("level").isin(*levels), F.lit(False))), archived


def keyed(rows: DataFrame, key: str, seq: Column) -> DataFrame:
    """The last row of each whole-number key; rows whose key isn't one are left out. The key becomes a number."""
    number = F.when(F.trim(key).rlike(r"^[+-]?\d+$"), F.trim(key)).try_cast("bigint")
    numbered = rows.withColumn(key, number).where(F.col(key).isNotNull())
    return first_per_key(numbered, [key], [seq.desc()])


def final_or_checkpoint(final: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """All of ``final``, or all of ``checkpoint`` if that is empty; decided in the plan by one counted row."""
    empty = F.broadcast(final.limit(1).agg((F.count("*") == 0).alias("_empty")))
    stand_in = checkpoint.join(empty, F.col("_empty")).drop("_empty")
    return final.unionByName(stand_in, allowMissingColumns=True)


def with_errors(rows: DataFrame, ok: Column, message: Column, defaults: dict[str, Column]) -> DataFrame:
    """Failed rows stay, with ``defaults`` in place of their results and the message beside."""
    return rows.withColumns({c: F.when(ok, F.col(c)).otherwise(v) for c, v in defaults.items()} | {"error": F.when(ok, "").otherwise(message)})


def reused(rows: DataFrame, earlier: DataFrame, key: str, ok: Column, columns: list[str]) -> DataFrame:
    """``columns`` of an earlier row of the same key where that is ``ok``, else those of ``rows``, with ``reused``."""
    good = first_per_key(earlier.where(ok), [key], [F.asc(c) for c in columns]).select(key, *[F.col(c).alias(f"earlier_{c}") for c in columns], F.lit(True).alias("reused"))
    both = rows.join(good, key, "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    return both.withColumns({c: F.when(F.col("reused"), F.col(f"earlier_{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"earlier_{c}" for c in columns])


def from_aliases(rows: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """A column for each name from the first of its aliases that ``rows`` has, else blank text."""
    have = {a: next((c for c in aliases if c in rows.columns), None) for a, aliases in wanted.items()}
    return rows.select(*[(F.col(c) if c else F.lit("")).alias(a) for a, c in have.items()])


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(rows.columns))


def all_columns(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the union of their columns in first-seen order; what a table lacks is null."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def split_by(rows: DataFrame, status: str, values: list[str]) -> dict[str, DataFrame]:
    """Rows of each status."""
    return {v: rows.where(F.col(status) == v) for v in values}


def zipped(left: Column, right: Column, a: str, b: str) -> Column:
    """Pairs by position, as many as the shorter array has."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, 1, n), lambda x, y: F.struct(x.alias(a), y.alias(b)))


def queue_view(view: str, needs_review: Column, level: Column) -> Column:
    """Whether a site of the first queue belongs to a view; a name that isn't known shows all that need review."""
    needs = F.coalesce(needs_review == 1, F.lit(False))
    return {"pending": needs & level.isNull(), "reviewed": level.isNotNull(), "all": F.lit(True)}.get(view, needs)


def output_view(view: str, level: Column, path: Column) -> Column:
    """Whether an item of the second queue belongs to a view; a name that isn't known shows all."""
    blank = F.coalesce(path, F.lit("")) == ""
    return {"pending": level.isNull(), "reviewed": level.isNotNull(), "with_image": ~blank, "missing_image": blank}.get(view, F.lit(True))


def of_province(province: Column, wanted: str) -> Column:
    """A null province is blank text; no wish is met by all."""
    return F.coalesce(province, F.lit("")) == wanted if wanted else F.lit(True)


#: Columns of the approved centers, in order.
APPROVED_COLUMNS = "mall_id name province city confidence_level center_lon center_lat center_source reviewer reason final_polygon_geojson review_round reviewed_at selected_provider selected_poi_name official_coord_evidence".split()


def approved(malls: DataFrame, reviews: DataFrame) -> DataFrame:
    """The centers that may be analysed: those a review puts at level A or B with both coordinates, and those no review touches whose automatic level and center will do.

    ``malls``: mall_id, name, province, city, confidence_level, approved_center_lon, approved_center_lat, selected_provider, selected_poi_name, official_coord_evidence.
    ``reviews``: mall_id (once), decision_level, final_lon, final_lat, and the reviewer's columns.
    """
    good = lambda level: F.coalesce(F.col(level).isin("A", "B"), F.lit(False))
    told = reviews.select("mall_id", "decision_level", "final_lon", "final_lat", "reviewer", "reason", "final_polygon_geojson", "review_round", "reviewed_at", F.lit(True).alias("_told"))
    both = malls.join(told, "mall_id", "left")
    manual = good("decision_level")
    by_hand = manual & F.col("final_lon").isNotNull() & F.col("final_lat").isNotNull()
    by_rule = F.col("_told").isNull() & good("confidence_level") & F.col("approved_center_lon").isNotNull() & F.col("approved_center_lat").isNotNull()
    made = {
        "confidence_level": F.coalesce("decision_level", "confidence_level"), "center_lon": F.when(manual, F.col("final_lon")).otherwise(F.col("approved_center_lon")),
        "center_lat": F.when(manual, F.col("final_lat")).otherwise(F.col("approved_center_lat")), "center_source": F.when(manual, "manual_review").otherwise("official_poi_auto"),
    }
    return both.where(by_hand | by_rule).select([(made[c] if c in made else F.col(c)).alias(c) for c in APPROVED_COLUMNS])


def first_filled_of(rows: DataFrame, sides: list[DataFrame], key: str, defaults: dict[str, str]) -> DataFrame:
    """``rows`` with each column of ``defaults`` from the first of ``sides`` whose row of the key has it filled, else its default; ``found`` says whether any side has the key.

    Each side has a key once at most; a column that a side lacks isn't filled there.
    """
    out = rows
    for i, side in enumerate(sides):
        out = out.join(side.select(key, F.lit(True).alias(f"_in{i}"), *[F.col(c).alias(f"_{c}{i}") for c in defaults if c in side.columns]), key, "left")
    filled = {c: text.first_filled(*[F.col(f"_{c}{i}") for i, s in enumerate(sides) if c in s.columns], F.lit(d)) for c, d in defaults.items()}
    found = F.coalesce(*[F.col(f"_in{i}") for i in range(len(sides))], F.lit(False))
    return out.select(*rows.columns, *[F.coalesce(v, F.lit("")).alias(c) for c, v in filled.items()], found.alias("found"))


def not_yet_archived(reviews: DataFrame, history: DataFrame, keys: list[str], known: DataFrame | None = None, site: str = "mall_id") -> DataFrame:
    """The reviews that ``history`` doesn't hold under the same ``keys``, of ``known`` sites if those are given. A null key is never held."""
    rows = reviews if known is None else reviews.join(known.select(site), site, "left_semi").select(*reviews.columns)
    return rows.join(history.select(*keys), keys, "left_anti").select(*reviews.columns)


def moved(rows: DataFrame, goes: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that are moved): where ``goes`` is true a row moves, where it is false or null it stays."""
    yes = F.coalesce(goes, F.lit(False))
    return rows.where(~yes), rows.where(yes)


def resolved(rows: DataFrame, level: str, center: list[str]) -> DataFrame:
    """``rows`` with ``enters`` and ``review``: a level that may be analysed keeps its ``center`` columns, another's are null, and all but level A are to be reviewed."""
    enters = decide.enters(F.col(level))
    return rows.withColumns({c: F.when(enters == 1, F.col(c)) for c in center} | {"enters": enters, "review": (F.col(level) != "A").cast("int")})
