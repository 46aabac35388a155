"""Named settings, stamps and recorded scores at their edges."""

import pytest
from pyspark.sql import functions as F

from heliosite import settings
from heliosite.operators import scoring


def test_settings_come_from_configuration():
    p = settings.IdentityParams.from_config({"name_strong": 0.6})
    assert p.name_strong == 0.6 and p.name_medium == 0.34 and settings.TilingParams().overlap_px == 128 and settings.ScorerParams().likely == 0.75
    with pytest.raises(ValueError, match="not settings of TilingParams: radius"):
        settings.TilingParams.from_config({"radius": 3})


def test_stamps(spark):
    rows = spark.createDataFrame([(1, None), (2, "2020-01-01 00:00:00")], "id int, at string").select("id", F.col("at").cast("timestamp").alias("updated_at"))
    fresh, kept = settings.stamped(rows).collect(), {r.id: r.updated_at for r in settings.stamped(rows, keep=True).collect()}
    assert len({r.updated_at for r in fresh}) == 1 and fresh[0].updated_at.year >= 2024 and kept[2].year == 2020 and kept[1].year >= 2024
    assert settings.stamped(rows.drop("updated_at"), keep=True).columns == ["id", "updated_at"]


def test_secrets_are_masked(spark):
    got = spark.createDataFrame([({"KEY": "a", "q": "b", "sk": None},), (None,), ({},)], "p map<string,string>").select(settings.redacted(F.col("p")).alias("p")).collect()
    assert [r.p for r in got] == [{"KEY": "***", "q": "b", "sk": "***"}, None, {}]


def test_scores_of_prompts(spark):
    labels = ("a", "b", "c")
    rows = spark.createDataFrame([(1, 1, [2.0, 2.0, 1.0]), (1, 0, [0.0, 3.0, 2.0]), (1, 2, [1.0, None, 0.0]), (1, 3, [1.0]), (2, 0, None)], "k int, view int, x array<double>")
    scored = rows.withColumn("score", scoring.prompt_scores(F.col("x"), labels, 2))
    first = scored.where("view = 1").first().score
    assert (first.positive_label, first.negative_label, first.delta) == ("a", "c", 1.0) and first.share == pytest.approx(0.8447, abs=1e-4)
    best = scoring.best_views(scored, "k", "view").collect()
    assert [(r.k, r.best_view, r.views, r.mean_delta) for r in best] == [(1, 0, 2, 1.0)]
    assert scored.where("view >= 2 or k = 2").where("score is not null").count() == 0
    assert spark.range(1).select(scoring.probabilities(F.array(F.lit(0.0), F.lit(800.0), F.lit(-800.0)))).first()[0] == [0.5, 1.0, 0.0]
    with pytest.raises(ValueError, match="for and against"):
        scoring.prompt_scores(F.col("x"), labels, 3)
