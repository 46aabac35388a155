"""Bound query: the review database's declarations held against seven tables made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliosite.operators import constraints
from heliosite.plans.bindings import bound, table

#: The seven tables as SQL that Spark and the counterpart both read, with keys, values and references that are broken here and there.
TABLES = {
    "malls": "select case when c_custkey % 97 = 0 then c_custkey - 1 when c_custkey % 89 = 0 then null else c_custkey end as mall_id, case when c_custkey % 50 <> 0 then c_name end as name from customer",
    "poi_candidates": "select l_orderkey * 8 + l_linenumber as id, case when l_orderkey % 700 <> 0 then l_suppkey end as mall_id, l_returnflag as provider, l_linenumber as rank, l_linestatus as poi_name, cast(l_quantity as double) as wgs84_lon, cast(l_discount as double) as wgs84_lat from lineitem",
    "reviews": "select o_orderkey % 4000 as mall_id, case when o_orderkey % 501 <> 0 then o_orderpriority end as reviewer, case o_orderkey % 9 when 0 then 'E' when 1 then null when 2 then 'B' else 'A' end as decision_level from orders",
    "review_history": "select o_orderkey as id, case when o_orderkey % 77 = 0 then o_custkey + 1000000 else o_custkey end as mall_id from orders",
    "pv_review_items": "select cast(s_suppkey * 3 as varchar(20)) as mall_id, case when s_suppkey % 9 <> 0 then s_name end as name from supplier union all select 'x', 'no number' from region",
    "pv_reviews": "select p_partkey as mall_id, p_brand as reviewer, case when p_partkey % 11 <> 0 then p_brand end as decision from part",
    "sessions": "select cast(user_id * 1000 + event_id % 500 as varchar(20)) as token, event_type as username, case when event_id % 333 <> 0 then cast(event_id as varchar(20)) end as expires_at from events",
}


def _counterpart() -> str:
    made = {k: v for k, v in TABLES.items()}
    made["pv_review_items"] = f"select try_cast(mall_id as bigint) as mall_id, mall_id as raw, name from ({TABLES['pv_review_items']})"
    out = ["select 'pv_review_items' as \"table\", 'type mall_id bigint' as rule, '?' as value, count(*) as rows from pv_review_items where raw is not null and mall_id is null having count(*) > 0"]
    for t in constraints.REVIEW_SCHEMA:
        key = t.key[0]
        for c in dict.fromkeys([*t.key, *t.required]):
            out.append(f"select '{t.name}', 'required {c}', coalesce({key}::varchar, '?'), count(*) from {t.name} where {c} is null group by all")
        for name, condition in t.checks.items():
            out.append(f"select '{t.name}', 'check {name}', coalesce({key}::varchar, '?'), count(*) from {t.name} where not ({condition}) group by all")
        for columns in t.keys():
            value = " || ',' || ".join(f"{c}::varchar" for c in columns)
            out.append(f"select '{t.name}', 'unique ({', '.join(columns)})', {value}, count(*) from {t.name} where {value} is not null group by all having count(*) > 1")
        for columns, (target, theirs) in t.references.items():
            out.append(f"select '{t.name}', 'reference ({columns[0]}) -> ({theirs[0]})', {columns[0]}::varchar, count(*) from {t.name} where {columns[0]} is not null and {columns[0]} not in (select {theirs[0]} from {target} where {theirs[0]} is not null) group by all")
    return f"with {', '.join(f'{k} as ({v})' for k, v in made.items())} {' union all '.join(out)}"


def review_tables(spark, sf_dir):
    for name in ("customer", "lineitem", "orders", "supplier", "region", "part", "events"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"heliosite_{name}")
    out = {}
    for name, sql in TABLES.items():
        for source in ("customer", "lineitem", "orders", "supplier", "region", "part", "events"):
            sql = sql.replace(f"from {source}", f"from heliosite_{source}")
        out[name] = spark.sql(sql)
    return out


@bound(_counterpart())
def constraint_audit(spark, sf_dir):
    return constraints.audit(constraints.REVIEW_SCHEMA, review_tables(spark, sf_dir)).select("table", "rule", "value", F.col("rows"))
