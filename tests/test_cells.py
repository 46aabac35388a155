"""Cell joins and the bigram index against all pairs, and how much they compare."""

import math
import random

import pytest
from pyspark.sql import functions as F

from heliosite.functions import text
from heliosite.operators import cells
from heliosite.operators.relational import similar_names


def metres(a, b):
    (x1, y1), (x2, y2) = ([math.radians(v) for v in p] for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("radius", [150.0, 20_000.0, 3_000_000.0])
def test_near_pairs_are_all_near_pairs(spark, radius):
    r = random.Random(7)
    spread = radius / 111_000 * 3
    rows = []
    for i in range(260):
        lon, lat = r.choice([(121.4, 31.2), (179.9999, 10.0), (-180.0, 10.0), (0.0, 0.0), (30.0, 89.9), (-100.0, -89.99)])
        rows.append((i, r.choice("ab"), (lon + r.uniform(-spread, spread) + 180) % 360 - 180, max(-90.0, min(90.0, lat + r.uniform(-spread, spread)))))
    rows += [(900, "a", None, 1.0), (901, "a", float("nan"), 1.0), (902, None, 121.4, 31.2)]
    got = {(p.id, p.other_id) for p in cells.near_pairs(spark.createDataFrame(rows, "id int, g string, lon double, lat double"), "g", "id", radius).collect()}
    want = {(a[0], b[0]) for a in rows[:260] for b in rows[:260] if a[0] != b[0] and a[1] == b[1] and metres(a[2:], b[2:]) <= radius}
    sure = {(i, j) for i, j in want if abs(metres(rows[i][2:], rows[j][2:]) - radius) > 1e-6 * radius}
    assert sure <= got <= want | {p for p in got if abs(metres(rows[p[0]][2:], rows[p[1]][2:]) - radius) <= 1e-6 * radius} and len(got) > 100


def compared(df):
    """Rows that joins hand on, before the last filter; without adaptive plans."""

    def joins(node):
        children = node.children()
        return ([node] if "Join" in node.nodeName() else []) + [x for i in range(children.size()) for x in joins(children.apply(i))]

    df.collect()
    return sum(int(j.metrics().apply("numOutputRows").value()) for j in joins(df._jdf.queryExecution().executedPlan()))


def test_what_is_compared_grows_with_the_rows(spark):
    """One group of constant density: four times the rows, about four times the pairs that meet."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = []
        for n in (500, 2000):
            r = random.Random(1)
            side = math.sqrt(n / 500) * 0.5
            rows = [(i, "g", 100 + r.uniform(0, side), 10 + r.uniform(0, side)) for i in range(n)]
            made.append(compared(cells.near_pairs(spark.createDataFrame(rows, "id int, g string, lon double, lat double"), "g", "id", 2000.0)))
        assert made[1] < 6 * made[0] and made[1] < 2000 * 60
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8, 0.95])
def test_names_above_a_score(spark, least):
    r = random.Random(3)
    words = ["north", "plaza", "riverside", "city", "mall", "广场", "一", "k", "old orchard"]
    rows = [(i, r.choice("xy"), " ".join(r.choice(words) for _ in range(r.randint(0, 3))) + r.choice(["", "", "s", str(i % 3)])) for i in range(90)] + [(200, "x", None), (201, "x", ""), (202, "x", "a"), (203, "x", "banana"), (204, "y", "aa"), (205, None, "plaza")]
    df = spark.createDataFrame(rows, "k int, g string, name string")
    want = {(p.a, p.b): p.score for p in similar_names(df, "k", "g", "name").where(F.col("score") >= least).collect()}
    got = {(p.a, p.b): p.score for p in cells.similar_above(df, "k", "g", "name", least).collect()}
    assert got == want and len(want) > 3


def test_a_score_that_any_pair_may_reach_is_refused(spark):
    with pytest.raises(ValueError, match="all pairs"):
        cells.similar_above(spark.createDataFrame([(1, "g", "n")], "k int, g string, name string"), "k", "g", "name", 0.2)


def copied(spark):
    """600 rows of a group under eight names, half of them under one."""
    names = ["north plaza", "north plazas", "riverside", "river", "old orchard", "old orchards", "city"]
    return spark.createDataFrame([(i, "g", "north plaza mall" if i % 2 else names[i // 2 % 7]) for i in range(600)], "k int, g string, name string")


def scored(df):
    a, b = df.toDF("a", "g", "n1"), df.toDF("b", "g2", "n2")
    return {(p.a, p.b): p.score for p in a.join(b, F.expr("g = g2 and a < b")).select("a", "b", text.similarity(F.col("n1"), F.col("n2")).alias("score")).collect()}


def test_copies_of_names_are_scored_once(spark):
    df = copied(spark)
    assert {(p.a, p.b): p.score for p in similar_names(df, "k", "g", "name").collect()} == scored(df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert compared(similar_names(df, "k", "g", "name")) < 5_000 < 600 * 599 / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def nodes(node):
    children = node.children()
    return [node] + [x for i in range(children.size()) for x in nodes(children.apply(i))]


def test_pairs_of_names_come_out_once_and_few_at_a_time(spark):
    """What is put out is hardly more than what stays, and no generated stage holds all that comes of a row of the join."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = similar_names(copied(spark), "k", "g", "name")
        pairs = len(df.collect())
        plan = nodes(df._jdf.queryExecution().executedPlan())
        out = [int(n.metrics().apply("numOutputRows").value()) for n in plan if "Generate" in n.nodeName()]
        assert pairs == 600 * 599 / 2 and pairs <= out[0] < 1.3 * pairs
        assert pairs / (16 * 256) < out[2] < 600
        below = [n.nodeName() for n in plan]
        assert "InputAdapter" in below[below.index("Generate") : below.index("ShuffledHashJoin")]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pairs_of_names_leave_out_equal_keys_and_nulls(spark):
    rows = [("b", "g", "north plaza"), ("a", "g", "north plazas"), ("a", "g", "river"), ("a", "g", "river"), ("c", "g", "north plaza"), ("c", "g", ""), ("d", "h", None), ("e", "h", "old"), (None, "g", "river"), ("f", None, "river")]
    df = spark.createDataFrame(rows, "k string, g string, name string")
    a, b = df.toDF("a", "g", "n1"), df.toDF("b", "g2", "n2")
    want = sorted(tuple(p) for p in a.join(b, F.expr("g = g2 and a < b")).select("a", "b", text.similarity(F.col("n1"), F.col("n2")).alias("score")).collect())
    assert sorted(tuple(p) for p in similar_names(df, "k", "g", "name").collect()) == want and len(want) > 8


def test_copies_of_names_meet_once(spark):
    df = copied(spark)
    assert {(p.a, p.b): p.score for p in cells.similar_above(df, "k", "g", "name", 0.8).collect()} == {p: s for p, s in scored(df).items() if s >= 0.8}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert compared(cells.similar_above(df, "k", "g", "name", 0.8)) < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_of_one_place_are_compared_once(spark):
    places = [(i % 3, 100 + i * 0.05, 10.0) for i in range(12)]
    rows = [(i, "g", *places[i % 12]) for i in range(480)] + [(900, "g", None, 100.0, 10.0), (901, "g", 1, None, 10.0), (902, None, 1, 100.0, 10.0), (903, "h", 1, 100.0, 10.0)]
    df = spark.createDataFrame(rows, "id int, g string, kind int, lon double, lat double")
    want = {a[0]: n for a in rows[:480] if (n := sum(a[2] != b[2] and metres(a[3:], b[3:]) <= 20_000 for b in rows[:480]))}
    assert {r.id: r.n for r in cells.near_counts(df, "g", "id", 20_000.0, "kind").collect()} == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert compared(cells.near_counts(df, "g", "id", 20_000.0, "kind")) < 1_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
