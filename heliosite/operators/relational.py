"""Table operators: latest rows, upserts, queues, ordered analytics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliosite.functions import text


def spare(*tables: DataFrame) -> str:
    """A column name that none of ``tables`` has."""
    taken = {c.lower() for df in tables for c in df.columns}
    return next(name for i in range(len(taken) + 1) if (name := f"_h{i}") not in taken)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in a total order."""
    n = spare(df)
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column, ties: list[Column] | None = None) -> DataFrame:
    """Rows of both, where the last in ``order`` wins for a key, of equal ones a new one, of those the first by ``ties``."""
    side = spare(old, new)
    both = old.withColumn(side, F.lit(0)).unionByName(new.withColumn(side, F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, keys, [order.desc(), F.desc(side), *(ties or [])]).drop(side)


def insert_or_ignore(df: DataFrame, unique: list[str], order: list[Column]) -> DataFrame:
    """The first row of each tuple; a tuple with a null is never a duplicate."""
    whole = reduce(and_, [F.col(c).isNotNull() for c in unique])
    return first_per_key(df.where(whole), unique, order).unionByName(df.where(~whole))


def frequency(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def fixed_domain(df: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Counts over ``domain``, zeros included. The domain is a literal list."""
    rows = df.sparkSession.createDataFrame([(d,) for d in domain], f"{key} string")
    return rows.join(frequency(df, key), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def resume(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return source.join(done.select(key).distinct(), key, "left_anti")


def early_stop(df: DataFrame, keys: list[str], order: list[Column], stop: Column) -> DataFrame:
    """Rows of each key up to and with the first at which ``stop`` holds."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stopped = spare(df)
    return df.withColumn(stopped, F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0))).where(F.col(stopped) == 0).drop(stopped)


def top_ranked(df: DataFrame, order: list[Column], most: int, place: str) -> DataFrame:
    """The first ``most`` rows of a total order with their ordinals from 1; only those rows meet in one task."""
    return df.orderBy(*order).limit(most).withColumn(place, F.row_number().over(Window.orderBy(*order)).cast("long"))


def key_blocks(rows: DataFrame, by: list[str], key: str, most: int = 256) -> DataFrame:
    """(``by``, block, keys): the keys of equal rows in about ``most`` to a block, so that what equal rows share is done once a pair of blocks.

    Rows with a null go. Only values of more rows than ``most`` meet their counts, in a join that splits or ships them; no value is one task.
    """
    n = spare(rows)
    whole = rows.where(reduce(and_, [F.col(c).isNotNull() for c in (*by, key)]))
    large = whole.groupBy(*by).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > most)
    dealt = whole.join(large, by, "left").withColumn("block", F.pmod(F.xxhash64(key), F.coalesce(F.floor(F.col(n) / most) + 1, F.lit(1))))
    return dealt.groupBy(*by, "block").agg(F.collect_list(key).alias("keys"))


def spread(rows: DataFrame, *by: str, each: int = 2) -> DataFrame:
    """Few rows that each give many, dealt out to as many tasks as are configured, or ``each`` a core, which adaptive plans would bring together for their small size."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), each * spark.sparkContext.defaultParallelism), *by)


def paired_keys(pairs: DataFrame, *kept: str) -> DataFrame:
    """(a, b, ``kept``) for each a of ``keys1`` before each b of ``keys2``."""
    firsts = pairs.select("keys2", *kept, F.explode("keys1").alias("a"))
    return firsts.select("a", F.explode("keys2").alias("b"), *kept).where("a < b")


def crossed_keys(pairs: DataFrame, most: int = 16) -> DataFrame:
    """(a, b, score): the keys of each two blocks, the lesser one first, with ``score12`` if it is of ``keys1`` and with ``score21`` if it is of ``keys2``.

    Two blocks come once and not in both orders, so no pair is made to be thrown away, other than where a block meets itself (``same``). Rows are put out from
    ``most`` keys of the first block at a time: a function of arrays ends a generated stage, which would hold all that comes of one of the join's rows.
    """
    k = F.col("keys1")
    last = F.least(F.size(k), (F.col("part") + 1) * most) - 1
    parts = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size(k) - 1) / most).cast("int"))))
    parts = parts.select("keys2", "score12", "score21", "same", F.transform(F.sequence(F.col("part") * most, last), lambda i: F.get(k, i)).alias("keys1"))
    firsts = parts.select("keys2", "score12", "score21", "same", F.explode("keys1").alias("x"))
    both = firsts.select("x", F.explode("keys2").alias("y"), "score12", "score21", "same").where("x < y or (x > y and not same)")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("score12")).otherwise(F.col("score21")).alias("score"))


def similar_names(df: DataFrame, key: str, group: str, name: str, tokens: tuple[str, ...] = text.GENERIC_TOKENS, salts: int = 32, decimals: int | None = None) -> DataFrame:
    """(a, b, score): name similarity of each pair of rows in a group, a before b; rounded if ``decimals`` are given.

    Rows of a group whose names come to the same stand in blocks of keys, and two blocks are scored once in each order, so a pair of such rows costs no more
    than putting it out. What a name gives by itself is computed once a block, before the exchange. All pairs of a group are what is asked for; ``salts``
    parts of each group's left side spread a large one over tasks.
    """
    normal = text.normalize_name(F.col(name), tokens)
    names = df.select(F.col(key).alias("k"), F.col(group).alias("g"), normal.alias("n")).where(F.col("g").isNotNull())
    # in order, so that which of two keys is the lesser changes once a run
    once = key_blocks(names, ["g", "n"], "k").select("g", "n", "block", F.sort_array("keys").alias("keys"), F.length("n").alias("size"), text.bigrams(text.normalize_name(F.col("n"), tokens)).alias("bi"), text.characters(F.col("n")).alias("ch"))
    side = lambda rows, i: rows.select("g", "salt", *[F.col(c).alias(f"{c}{i}") for c in ("keys", "n", "block", "size", "bi", "ch")])
    left = side(spread(once.withColumn("salt", F.pmod(F.xxhash64("n", "block"), F.lit(salts)).cast("int")), "g", "salt", each=8), 1)
    right = side(spread(once.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "g", "salt", each=8), 2)
    pairs = left.hint("shuffle_hash").join(right, ["g", "salt"]).where("n1 < n2 or (n1 = n2 and block1 <= block2)")

    def score(i: int, j: int) -> Column:
        out = text.similarity_of(*[F.col(f"{c}{at}") for c in ("n", "size", "bi", "ch") for at in (i, j)])
        return (out if decimals is None else F.round(out, decimals)).alias(f"score{i}{j}")

    return crossed_keys(pairs.select("keys1", "keys2", score(1, 2), score(2, 1), F.expr("n1 = n2 and block1 = block2").alias("same")))


def coverage(df: DataFrame, groups: list[str], ident: str, flag: str, confidence: str) -> DataFrame:
    """Per group: rows with an id, those flagged, their rate and percentage, the mean confidence; the highest rate first. A null is a group of its own.

    Percentages have two decimals and means three, ties to even; a group without ids has no rate.
    """
    n, hits = F.count(ident), F.sum(F.col(flag).cast("long"))
    rolled = df.groupBy(*groups).agg(n.alias("mall_count"), F.coalesce(hits, F.lit(0)).alias("suspected_pv_count"), F.bround(F.avg(confidence), 3).alias("avg_confidence"))
    rate = F.when(F.col("mall_count") > 0, F.col("suspected_pv_count") / F.col("mall_count"))
    return rolled.withColumn("coverage_rate", rate).withColumn("coverage_rate_pct", F.bround(F.col("coverage_rate") * 100, 2)).orderBy(F.desc_nulls_last("coverage_rate"), F.desc("mall_count"))


def ranked_frequency(df: DataFrame, key: str, seen: str) -> DataFrame:
    """(key, n, place): counts with their places from 1, the most frequent first; equal ones as they were first seen, by the order of ``seen``."""
    from heliosite.operators.ordered import numbered
    from heliosite.sources.shared import written

    counts = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("_first")))
    return numbered(counts, [F.desc("n"), "_first"], None, "place").select(key, "n", (F.col("place") + 1).alias("place"))
