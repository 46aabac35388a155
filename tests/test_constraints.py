"""The audit of declared tables: nulls, types, checks, duplicate keys and dangling references, on small rows; bucketed lookups."""

from heliosite.operators import constraints as c

SCHEMA = [
    c.Table("site", {"id": "bigint", "name": "string", "level": "string"}, ("id",), ("name",), checks={"level": "level in ('A', 'B')"}),
    c.Table("spot", {"site": "bigint", "place": "int", "lon": "double"}, ("site", "place"), unique=(("lon",),), references={("site",): ("site", ("id",))}),
]


def found(tables):
    return {(r.table, r.rule, r.value): r.rows for r in c.audit(SCHEMA, tables).collect()}


def test_every_rule(spark):
    site = spark.createDataFrame([("1", "a", "A"), ("1", "b", "B"), ("2", None, None), (None, "c", "C"), ("x", "d", "A")], "id string, name string, level string")
    spot = spark.createDataFrame([(1, 1, 0.5), (1, 1, 1.5), (1, 2, 0.5), (7, 1, None), (7, 2, None), (None, 1, 2.5)], "site long, place int, lon double")
    assert found({"site": site, "spot": spot}) == {
        ("site", "unique (id)", "1"): 2, ("site", "required name", "2"): 1, ("site", "required id", "?"): 2, ("site", "check level", "?"): 1, ("site", "type id bigint", "?"): 1,
        ("spot", "unique (site, place)", "1,1"): 2, ("spot", "unique (lon)", "0.5"): 2, ("spot", "reference (site) -> (id)", "7"): 2, ("spot", "required site", "?"): 1,
    }


def test_nothing_to_find(spark):
    site, spot = spark.createDataFrame([(1, "a", None)], "id long, name string, level string"), spark.createDataFrame([(1, 1, None)], "site long, place int, lon double")
    assert found({"site": site, "spot": spot}) == {} and found({"site": site.where("false"), "spot": spot.where("false")}) == {}


def test_values_with_commas_stay_apart(spark):
    pair = [c.Table("t", {"a": "string", "b": "string"}, ("a", "b"))]
    rows = spark.createDataFrame([("x,y", "z"), ("x", "y,z"), ("x\\", "y"), ("x\\", "y")], "a string, b string")
    assert [(r.rule, r.rows) for r in c.audit(pair, {"t": rows}).collect()] == [("unique (a, b)", 2)]


def test_each_table_is_read_once_and_facts_are_counted_where_they_are_read(spark, tmp_path):
    for name, rows in (("site", [(1, "a", "A")]), ("spot", [(1, 1, 0.5)])):
        spark.createDataFrame(rows, SCHEMA[0 if name == "site" else 1].columns and ", ".join(f"{k} {v}" for k, v in SCHEMA[0 if name == "site" else 1].columns.items())).write.parquet(str(tmp_path / name))
    plan = c.audit(SCHEMA, {n: spark.read.parquet(str(tmp_path / n)) for n in ("site", "spot")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 1 and "partial_count" in plan


def test_lookup_opens_one_bucket(spark):
    rows = spark.createDataFrame([(i, "n", "A") for i in range(100)], "id long, name string, level string")
    c.store(rows, SCHEMA[0], "heliosite_test_site", 8)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a partition for each file that is opened
        assert spark.table("heliosite_test_site").rdd.getNumPartitions() == 8
        look = spark.table("heliosite_test_site").where("id = 42")
        assert [r.id for r in look.collect()] == [42] and look.rdd.getNumPartitions() == 1
        both = spark.table("heliosite_test_site").alias("a").join(spark.table("heliosite_test_site").alias("b").hint("merge"), "id")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 100
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.sql("drop table heliosite_test_site")


def test_facts_are_small(spark):
    """A fact is a number, a flag and a value: rules' names are written where something is found, and no lambda runs over each row."""
    site, spot = spark.createDataFrame([(1, "a,b", "A")], "id long, name string, level string"), spark.createDataFrame([(1, 1, 0.5)], "site long, place int, lon double")
    plan = c.audit(SCHEMA, {"site": site, "spot": spot})._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp" not in plan and plan.count("unique (site, place)") <= 1
