"""Tables with declared types, keys, checks and references, and an audit that finds every row that breaks them.

The declarations compile into one plan, in which numbers stand for rules. Each table is read once: a row gives a fact for each rule it breaks by itself (a
type that doesn't hold, a missing value, a failed check), one for each unique key it holds, and one for each reference. Facts of
all tables meet in a single aggregation by (rule, value), which Spark begins in each scan, so a value that a third
of all rows hold is one row of each task: a key that several rows hold is a duplicate, and a reference that no key
answers dangles. Values are compared as text of the declared types.

As in SQL, a unique key or a reference with a null in it breaks nothing; a primary key is also required. A check that comes to null holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")  # types whose texts have no comma
VIOLATION = "table string, rule string, value string, rows long"


@dataclass(frozen=True)
class Table:
    """``columns``: name to SQL type. ``checks``: name to SQL condition. ``references``: own columns to (table, its columns)."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    references: dict[tuple[str, ...], tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    lookups: tuple[str, ...] = ()

    def keys(self) -> list[tuple[str, ...]]:
        return [self.key, *self.unique]

    def typed(self, rows: DataFrame) -> DataFrame:
        """The declared columns under their types; one that ``rows`` lacks, or a value that can't be read, is null."""
        return rows.select([(F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in self.columns.items()])


def _name(columns: tuple[str, ...]) -> str:
    return f"({', '.join(columns)})"


def _value(columns: tuple[str, ...], types: dict[str, str]) -> Column:
    """The columns as one text, null if one of them is."""
    shown = lambda c: F.col(c).try_cast(types[c]).cast("string")
    escaped = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,"))
    parts = [shown(c) if types[c] in _PLAIN else escaped(shown(c)) for c in columns]  # numbers have nothing to escape
    return reduce(lambda a, b: F.concat(a, F.lit(","), b), parts)


def _reference(table: Table, columns: tuple[str, ...], theirs: tuple[str, ...]) -> tuple[str, str, str]:
    return table.name, f"reference {_name(columns)} -> {_name(theirs)}", "reference"


def rules(schema: list[Table]) -> dict[tuple[str, str, str], int]:
    """(table, rule, kind) to the number that stands for it in facts. Kinds: broken, key, reference."""
    found = []
    for t in schema:
        found += [(t.name, f"type {c} {kind}", "broken") for c, kind in t.columns.items()]
        found += [(t.name, f"required {c}", "broken") for c in (*t.key, *t.required)]
        found += [(t.name, f"check {name}", "broken") for name in t.checks]
        found += [(t.name, f"unique {_name(columns)}", "key") for columns in t.keys()]
        found += [_reference(t, columns, theirs) for columns, (_, theirs) in t.references.items()]
    return {rule: i for i, rule in enumerate(dict.fromkeys(found))}


def facts(table: Table, rows: DataFrame, schema: list[Table]) -> DataFrame:
    """(rule, held, value): what the rows of one table say of the numbered rules; ``held`` where a value is there as a key. A key answers each reference that asks for it."""
    number = rules(schema)
    at = lambda rule, held, value, when: F.when(when, F.struct(F.lit(number[rule]).alias("rule"), F.lit(held).alias("held"), value.alias("value")))
    # texts are columns of their own, so that each is made once a row
    texts = {columns: f"_text{i}" for i, columns in enumerate(dict.fromkeys([*table.keys(), *table.references]))}
    rows = rows.withColumns({name: _value(columns, table.columns) for columns, name in texts.items()})
    shown = F.coalesce(F.col(texts[table.key]), F.lit("?"))
    found = []
    for c, t in table.columns.items():
        if c in rows.columns and dict(rows.dtypes)[c] != t:  # a column of that type already has no other value
            found.append(at((table.name, f"type {c} {t}", "broken"), False, shown, F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()))
    present = {c: F.col(c).try_cast(t) if c in rows.columns else F.lit(None) for c, t in table.columns.items()}
    for c in dict.fromkeys([*table.key, *table.required]):
        found.append(at((table.name, f"required {c}", "broken"), False, shown, present[c].isNull()))
    for name, condition in table.checks.items():
        found.append(at((table.name, f"check {name}", "broken"), False, shown, ~F.expr(condition)))
    for columns in dict.fromkeys(table.keys()):
        value = F.col(texts[columns])
        found.append(at((table.name, f"unique {_name(columns)}", "key"), True, value, value.isNotNull()))
        for t in schema:
            for asking, target in t.references.items():
                if target == (table.name, columns):
                    found.append(at(_reference(t, asking, columns), True, value, value.isNotNull()))
    for columns, (_, theirs) in table.references.items():
        value = F.col(texts[columns])
        found.append(at(_reference(table, columns, theirs), False, value, value.isNotNull()))
    return rows.select(F.inline(F.array(*found))).where(F.col("value").isNotNull())


def audit(schema: list[Table], tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, value, rows): a row for each value that breaks a rule, and how many rows hold it. Broken rows are named by their key."""
    named = {t.name: t for t in schema}
    for t in schema:
        for target, theirs in t.references.values():
            if theirs not in named[target].keys():
                raise ValueError(f"{t.name} refers to {target}{_name(theirs)}, which isn't a key")
    every = reduce(DataFrame.unionByName, [facts(t, tables[t.name], schema) for t in schema])
    met = every.groupBy("rule", "value").agg(F.count(F.lit(1)).alias("rows"), F.count_if("held").alias("keys"))
    number = rules(schema)
    of = lambda kind: F.col("rule").isin([i for (_, _, k), i in number.items() if k == kind])
    bad = met.where(F.when(of("key"), F.col("keys") > 1).when(of("reference"), F.col("keys") == 0).otherwise(True))
    name = lambda i: F.element_at(F.array(*[F.lit(rule[i]) for rule in number]), F.col("rule") + 1)
    return bad.select(name(0).alias("table"), name(1).alias("rule"), "value", "rows")


def store(rows: DataFrame, table: Table, name: str, buckets: int, by: tuple[str, ...] | None = None) -> None:
    """A catalog table bucketed and sorted by its key or by a looked-up column, so that a lookup opens one bucket and joins on it don't shuffle."""
    by = by or table.key
    if by != table.key and by not in [(c,) for c in table.lookups]:
        raise ValueError(f"{table.name} declares no lookup by {_name(by)}")
    table.typed(rows).repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).mode("overwrite").saveAsTable(name)


_TEXT, _INT, _REAL = "string", "bigint", "double"


def _typed(integers: str, reals: str, texts: str) -> dict[str, str]:
    return dict.fromkeys(integers.split(), _INT) | dict.fromkeys(reals.split(), _REAL) | dict.fromkeys(texts.split(), _TEXT)


#: The review database's tables, keys, checks and references.
REVIEW_SCHEMA = [
    Table(
        "malls",
        _typed("mall_id can_enter_1km_analysis review_required official_provider_count agreement_provider_count needs_review", "selected_lon_wgs84 selected_lat_wgs84 approved_center_lon approved_center_lat selected_name_similarity agreement_radius_m nearest_provider_distance_m best_identity_score", "name province city source_run_id source_run_dir confidence_level review_status identity_status identity_reasons selected_provider selected_poi_name selected_address selected_poi_type name_evidence official_coord_evidence image_evidence clip_decision suspicious_reason source_csv updated_at"),
        ("mall_id",), ("name",), lookups=("needs_review",),
    ),
    Table("poi_candidates", _typed("id mall_id rank", "wgs84_lon wgs84_lat identity_score name_similarity", "provider query poi_name address province city district poi_type flags source_run_id"), ("id",), ("mall_id",), (("mall_id", "provider", "rank", "poi_name", "wgs84_lon", "wgs84_lat"),), lookups=("mall_id",)),
    Table("reviews", _typed("mall_id review_round", "final_lon final_lat", "reviewer decision_level final_polygon_geojson reason notes reviewed_at"), ("mall_id",), ("reviewer", "decision_level"), checks={"decision_level": "decision_level in ('A', 'B', 'C', 'D')"}, references={("mall_id",): ("malls", ("mall_id",))}, lookups=("decision_level",)),
    Table("review_history", _typed("id mall_id review_round", "final_lon final_lat", "reviewer decision_level final_polygon_geojson reason notes reviewed_at archived_at archive_reason"), ("id",), ("mall_id",), references={("mall_id",): ("malls", ("mall_id",))}),
    Table("pv_review_items", _typed("mall_id roof_candidate_count", "center_lon center_lat pv_confidence pv_area_m2_est roof_area_m2_est", "name province city poi_reviewer poi_reviewed_at pv_run_id pv_run_dir image_status self_image_path self_overlay_path full_raw_path full_annotated_path full_pv_overlay_path full_roof_overlay_path review_mosaic_path pv_status install_condition_level notes updated_at"), ("mall_id",), ("name",), references={("mall_id",): ("malls", ("mall_id",))}, lookups=("province",)),
    Table("pv_reviews", _typed("mall_id", "", "reviewer decision corrected_pv_status corrected_potential_level reason notes reviewed_at"), ("mall_id",), ("reviewer", "decision"), references={("mall_id",): ("pv_review_items", ("mall_id",))}, lookups=("decision",)),
    Table("sessions", _typed("", "", "token username expires_at created_at"), ("token",), ("username", "expires_at")),
]
