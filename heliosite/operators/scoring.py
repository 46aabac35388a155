"""What image-and-text models have recorded for views of a site: best prompts, shares, decisions, the best view. No model runs here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt_scores(scores: Column, labels: tuple[str, ...], positives: int) -> Column:
    """struct(positive, positive_label, negative, negative_label, delta, share) of one view's score for each of ``labels``, the ``positives`` first ones for.

    The best prompt of either side is the first of equal ones. ``share`` is what the positive prompts have of the softmax over all, which only logits give
    a meaning; probabilities, each by itself, are compared through ``delta``. Null without a score for each label, or with a null among them.
    """
    if not 0 < positives < len(labels):
        raise ValueError("labels for and against are needed")
    whole = (F.size(scores) == len(labels)) & ~F.exists(scores, lambda x: x.isNull())
    x = F.transform(scores, lambda v: v.cast("double"))
    good, bad = F.slice(x, 1, positives), F.slice(x, positives + 1, len(labels) - positives)
    top = F.array_max(x)
    total = lambda xs: F.aggregate(F.transform(xs, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    name = lambda side, first, n: F.element_at(F.array(*[F.lit(v) for v in labels[first : first + n]]), F.array_position(side, F.array_max(side)).cast("int"))
    return F.when(
        whole,
        F.struct(
            F.array_max(good).alias("positive"), name(good, 0, positives).alias("positive_label"), F.array_max(bad).alias("negative"), name(bad, positives, len(labels) - positives).alias("negative_label"),
            (F.array_max(good) - F.array_max(bad)).alias("delta"), (total(good) / (total(good) + total(bad))).alias("share"),
        ),
    )


def probabilities(logits: Column) -> Column:
    """Each logit's own probability, as models give it that judge a prompt by itself."""
    return F.transform(logits, lambda v: 1 / (1 + F.exp(-v.cast("double"))))


def best_views(views: DataFrame, key: str, place: str, score: str = "score") -> DataFrame:
    """A row for each ``key``: its view of largest delta, the first by ``place`` of equal ones, with that view's score, the mean delta and the number of views that have one."""
    told = views.where(F.col(score).isNotNull())
    delta = F.col(score)["delta"]
    best = told.groupBy(key).agg(F.max_by(F.struct(F.col(place).alias("place"), F.col(score).alias("score")), F.struct(delta, -F.col(place))).alias("_best"), F.avg(delta).alias("mean_delta"), F.count(F.lit(1)).alias("views"))
    return best.select(key, F.col("_best.place").alias("best_view"), "_best.score.*", "mean_delta", "views")
