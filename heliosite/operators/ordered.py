"""Ordered analytics that no key is too large for: numbering, runs of outcomes, progress over time.

Rows of a group are numbered over sorted ranges, and what looks at neighbours works in blocks of numbers or of time, each
with a copy of what it needs from the block before. A group of any size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliosite.operators.relational import spare
from heliosite.sources.shared import written

BLOCK = 1 << 12


def numbered(rows: DataFrame, order: list[str | Column], group: str | None = None, name: str = "idx") -> DataFrame:
    """``rows`` with ``name``, from 0 in ``order`` (nulls first) within each value of ``group``; a null is a value of its own.

    Spark deals the rows by ranges of (group, order) and sorts each range; a range numbers its own rows. What stands
    before a range is added from counts by range and group: at most one group goes on from one range into the next, so
    the table of what to add holds a row for each range at most and is shipped whole. Rows equal in ``order`` are
    numbered in any order. ``rows`` is read twice, so it should be a table.
    """
    names = rows.columns
    value = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")) if group else F.lit("")
    dealt = rows.withColumn("_group", value).repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(at)
            new = np.zeros(n, bool)
            new[0] = True
            new[1:] = pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            idx = np.arange(n) - first
            if column[0].as_py() == last:
                idx[first == 0] += seen
            last, seen = column[n - 1].as_py(), int(idx[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(idx)], names=[*names, "_group", "_part", "_idx"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    local = written(dealt.mapInArrow(run, f"{fields}, _part int, _idx long"))
    before = F.sum("n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = local.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("n")).select("_group", "_part", before.alias("_before")).where("_before > 0")
    both = local.join(F.broadcast(ahead), ["_group", "_part"], "left")
    return both.select(*names, (F.col("_idx") + F.coalesce("_before", F.lit(0))).alias(name))


def _with_tails(rows: DataFrame, block: Column, tail: Column) -> DataFrame:
    """``rows`` with the number of their block and whether they are its own; those in ``tail`` stand in the next one too."""
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    return rows.withColumn("_at", F.explode(F.when(tail, F.array(own, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(own)))).select(*rows.columns, "_at.block", "_at.own")


def breaker(calls: DataFrame, key: str, order: list[str], failed: Column, good: Column, most: int, block: int = BLOCK) -> DataFrame:
    """``calls`` with ``state``: closed where the call is made, open where its key has been given up before.

    A key is given up at the call that makes ``most`` failures in a row. A good call begins anew; one that is neither failed nor good counts
    for nothing. Nothing is tried again once a key is open.
    """
    if not 1 <= most <= block:
        raise ValueError(f"most must be between 1 and {block}")
    outcome = F.when(failed, 1).when(good, 0)
    place, telling = spare(calls), f"{spare(calls)}_n"
    rows = numbered(calls, order, key, place)
    runs = numbered(written(rows.select(key, place, outcome.alias("_bad")).where("_bad is not null")), [place], key, telling)
    at = F.col(telling)
    parts = _with_tails(runs, F.floor(at / block), at % block > block - most)
    frame = Window.partitionBy(key, "block").orderBy(telling).rowsBetween(1 - most, 0)
    bad = parts.withColumn("_run", F.sum("_bad").over(frame)).where((F.col("_run") == most) & F.col("own"))
    opened = bad.groupBy(F.col(key).alias("_key")).agg(F.min(place).alias("_opened"))
    both = rows.join(opened, F.col(key).eqNullSafe(F.col("_key")), "left")
    return both.withColumn("state", F.when(F.col(place) > F.col("_opened"), "open").otherwise("closed")).drop("_key", "_opened", place)


def progress(done: DataFrame, key: str, time: str, span_s: int) -> DataFrame:
    """``done`` with what a key has done so far, its seconds an item, the seconds left for all its rows, and the items of the last ``span_s`` seconds, as at each row.

    ``time`` is a timestamp; rows of one moment are numbered in the order of the other columns, and share their recent count.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    whole = done.groupBy(F.col(key).alias("_key")).agg(F.min(micros).alias("_start"), F.count(F.lit(1)).alias("_all"))
    rows = numbered(done, [time, *[c for c in done.columns if c not in (key, time)]], key, "done").withColumn("done", F.col("done") + 1)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    span = span_s * 1_000_000
    parts = _with_tails(rows, F.floor(t / span), F.lit(True)).withColumn("_t", t)
    recent = F.count(F.lit(1)).over(Window.partitionBy(key, "block").orderBy("_t").rangeBetween(-span, 0))
    near = parts.withColumn("recent", recent).where("own").drop("block", "own")
    each = (F.col("_t") - F.col("_start")) / 1e6 / F.col("done")
    both = near.join(whole, F.col(key).eqNullSafe(F.col("_key")))
    return both.withColumns({"s_each": each, "s_left": each * (F.col("_all") - F.col("done"))}).drop("_t", "_key", "_start", "_all")
