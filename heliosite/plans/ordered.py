"""Bound queries: sorts, circuit breakers and progress over tables whose keys may be of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliosite.operators import ordered
from heliosite.plans.bindings import bound, table

MOST = 3


@bound(f"""with recursive calls as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as place,
  case event_type when 'error' then 1 when 'view' then null else 0 end as bad from events),
walk as (select user_id, event_id, place, false as given_up, coalesce(bad, 0) as fails from calls where place = 1
  union all select c.user_id, c.event_id, c.place, w.given_up or w.fails >= {MOST}, case when c.bad = 1 then w.fails + 1 when c.bad = 0 and w.fails < {MOST} then 0 else w.fails end
  from walk w join calls c on c.user_id = w.user_id and c.place = w.place + 1)
select user_id, event_id, case when given_up then 'open' else 'closed' end as state from walk""")
def circuit_breaker(spark, sf_dir):
    """Events as calls to providers: errors are refusals, views tell nothing, all else succeeds."""
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    kind = F.col("event_type")
    return ordered.breaker(calls, "user_id", ["ts", "event_id"], kind == "error", ~kind.isin("error", "view"), MOST).select("user_id", "event_id", "state")


@bound("""with e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as done, count(*) over (partition by user_id) as n, min(epoch_us(ts)) over (partition by user_id) as t0,
  count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) as recent from events)
select user_id, event_id, done, recent, (t - t0)::double / 1e6::double / done as s_each, (t - t0)::double / 1e6::double / done * (n - done) as s_left from e""")
def running_progress(spark, sf_dir):
    """Events as finished items of a user: rate so far, time left, items of the last day."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return ordered.progress(events, "user_id", "ts", 86_400).select("user_id", "event_id", "done", "recent", "s_each", "s_left")


@bound("select n_name as grp, c_custkey, row_number() over (partition by n_regionkey order by n_name, c_acctbal desc, c_custkey) as place from customer join nation on c_nationkey = n_nationkey")
def mixed_sort(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    placed = ordered.numbered(rows.select(F.col("n_name").alias("grp"), "c_custkey", "c_acctbal", "n_regionkey"), ["grp", F.desc("c_acctbal"), "c_custkey"], "n_regionkey", "place")
    return placed.select("grp", "c_custkey", (F.col("place") + 1).alias("place"))
