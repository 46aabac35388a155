"""Numbering, circuit breakers and progress against plain Python, with a hot key, nulls, ties and small blocks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from heliosite.operators import ordered


@pytest.fixture(scope="module")
def calls():
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i // 2, i, r.choice(["bad", "bad", "ok", "none"])) for i in range(600)]
    r.shuffle(rows)
    return rows


def test_numbers_follow_the_order_in_every_group(spark, calls):
    df = spark.createDataFrame(calls, "k string, t long, id long, what string").repartition(7)
    got = ordered.numbered(df, [F.desc("t"), "id"], "k", "place").collect()
    assert len(got) == len(calls)
    for key in ("hot", "a", "b", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: (-r.t, r.id))
        assert [r.place for r in own] == list(range(len(own)))
    whole = ordered.numbered(df, ["t", "id"]).collect()
    assert [r.idx for r in sorted(whole, key=lambda r: (r.t, r.id))] == list(range(len(calls)))
    assert ordered.numbered(df.where("false"), ["t"], "k").count() == 0
    tied = ordered.numbered(df.withColumn("t", F.lit(1)), ["t"]).collect()
    assert sorted(r.idx for r in tied) == list(range(len(calls)))


@pytest.mark.parametrize(("most", "block"), [(1, 8), (3, 8), (3, 3), (4, 64)])
def test_breaker_by_plain_python(spark, calls, most, block):
    df = spark.createDataFrame(calls, "k string, t long, id long, what string").repartition(5)
    got = {r.id: r.state for r in ordered.breaker(df, "k", ["t", "id"], F.col("what") == "bad", F.col("what") == "ok", most, block).collect()}
    fails, given_up, want = {}, set(), {}
    for k, _, i, what in sorted(calls, key=lambda x: (x[1], x[2])):
        want[i] = "open" if k in given_up else "closed"
        if k not in given_up:
            fails[k] = fails.get(k, 0) + 1 if what == "bad" else 0 if what == "ok" else fails.get(k, 0)
            if fails[k] >= most:
                given_up.add(k)
    assert got == want and set(want.values()) == {"open", "closed"}
    assert ordered.breaker(df.where("false"), "k", ["t"], F.col("what") == "bad", F.col("what") == "ok", 2).count() == 0


def test_progress_by_plain_python(spark, calls):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=7 * t), i) for k, t, i, _ in calls]
    got = {r.id: r for r in ordered.progress(spark.createDataFrame(rows, "k string, t timestamp, id long"), "k", "t", 60).collect()}
    for key in ("hot", "a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for n, (_, t, i) in enumerate(own, 1):
            each = (t - own[0][1]).total_seconds() / n
            assert got[i].done == n and got[i].s_each == pytest.approx(each) and got[i].s_left == pytest.approx(each * (len(own) - n))
            assert got[i].recent == sum(t - datetime.timedelta(seconds=60) <= x[1] <= t for x in own)
