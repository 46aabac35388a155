"""Bound queries: recorded model scores in both forms, best views, redacted parameters, evidence under named settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliosite import settings
from heliosite.operators import scoring
from heliosite.plans.bindings import bound, table

LABELS = tuple(f"for {i}" for i in range(5)) + tuple(f"against {i}" for i in range(7))
_SHARE = "list_sum(list_transform({0}, lambda v: exp(v - list_max(x))))"


def _views(form: str) -> str:
    return f"""with e as (select vec_id % 60 as site, vec_id as view, list_transform(embedding[1:12], lambda v: {form}) as x from embeddings),
s as (select site, view, list_max(x[1:5]) as positive, 'for ' || (list_position(x[1:5], list_max(x[1:5])) - 1) as positive_label, list_max(x[6:12]) as negative, 'against ' || (list_position(x[6:12], list_max(x[6:12])) - 1) as negative_label, list_max(x[1:5]) - list_max(x[6:12]) as delta, {_SHARE.format('x[1:5]')} / {_SHARE.format('x')} as share from e),
r as (select *, row_number() over (partition by site order by delta desc, view) as n, avg(delta) over (partition by site) as mean_delta, count(*) over (partition by site) as views from s)
select site, view as best_view, positive, positive_label, negative, negative_label, delta, share, mean_delta, views from r where n = 1"""


def _scored(spark, sf_dir, scores):
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select((v % 60).alias("site"), v.alias("view"), scoring.prompt_scores(scores(F.slice("embedding", 1, 12)), LABELS, 5).alias("score"))
    return scoring.best_views(rows, "site", "view")


@bound(_views("v::double * 4"))
def logit_views(spark, sf_dir):
    return _scored(spark, sf_dir, lambda x: F.transform(x, lambda v: v.cast("double") * 4))


@bound(_views("1 / (1 + exp(-v::double))"))
def probability_views(spark, sf_dir):
    return _scored(spark, sf_dir, scoring.probabilities)


@bound("""select event_id, case when event_id % 3 = 0 then 'city=a' else 'city=b' end || '&' || (['ak', 'Key', 'SIG', 'signature', 'monkey'])[event_id % 5 + 1] || '=' || case when event_id % 5 = 4 then event_type else '***' end as shown from events""")
def redacted_requests(spark, sf_dir):
    """Events as requests: a parameter that names a secret in any case is masked, one that only contains such a name isn't."""
    k = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("ak", "Key", "SIG", "signature", "monkey")]), (k % 5 + 1).cast("int"))
    params = settings.redacted(F.create_map(F.lit("city"), F.when(k % 3 == 0, "a").otherwise("b"), name, F.col("event_type")))
    entries = F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(entries, "&").alias("shown"))


@bound("""select event_id, n as name, case when a >= 2 then 'multi_provider_agree' when a >= 1 and n = 'strong' and value / 5 >= 62 then 'single_provider_strong' else 'weak_or_disputed' end as coordinates,
case when event_id % 5 = 4 then 'not_available' when event_id % 5 = 0 and event_id % 11 / 10.0::double >= 0.7::double then 'candidate_image_mall_like' when event_id % 5 = 1 then 'old_image_more_mall_like' when event_id % 5 = 2 then 'not_mall_like_or_unclear' else 'manual_review_or_not_available' end as image
from (select *, event_id % 3 as a, case when event_id % 101 / 100.0::double >= 0.6::double then 'strong' when event_id % 101 / 100.0::double >= 0.34::double then 'medium' else 'weak' end as n from events)""")
def evidence_settings(spark, sf_dir):
    """Evidence under settings that a configuration changes in part."""
    k = F.col("event_id")
    p = settings.IdentityParams.from_config({"name_strong": 0.6, "image_least": 0.7})
    decision = F.when(k % 5 == 0, "candidate_center_likely_mall").when(k % 5 == 1, "old_image_more_mall_like").when(k % 5 == 2, "both_unclear_or_non_mall").when(k % 5 == 3, "else")
    name, coordinates, image = p.evidence(k % 101 / 100.0, k % 3, k % 3, F.col("value") / 5, decision, k % 11 / 10.0)
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"), coordinates.alias("coordinates"), image.alias("image"))
