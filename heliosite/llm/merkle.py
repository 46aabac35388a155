"""Merkle manifest of a table: a digest a row, a tree over each group's rows, a tree over the groups, and proofs.

Window-based levels: nodes are partitioned by group and parent index, and a list over the full ordered frame gives both
what the parent is hashed from and each node's siblings. A run's first node stands for it, so parents are unique before
the next level. A group whose first run is one node is done; the node is its subroot. No group is gathered anywhere: rows are
numbered over sorted ranges (``operators.ordered``), a window holds ``fanout`` rows, and levels shrink by that factor. Proofs come
down from the root level by level: a node's proof is its own siblings, then its parent's proof.

Defined results: a null field is hashed as ``-``, any other as byte count, colon, value, so null, empty and shifted
values differ; rows with a null group form a group of their own, the first; a null key sorts first; rows that share a
key stand in the order of their leaves, each with its own place and proof; equal rows give equal leaves at different
places. A table of one row has the leaf as subroot and root and an empty proof. An empty table gives an empty result. Texts are
hashed whole. Columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliosite.operators.ordered import numbered
from heliosite.llm.storage import persisted

FANOUT = 8
STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """How a leaf takes a value in: ``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def preimage(values: Sequence[Column]) -> Column:
    return F.concat(*[field(v) for v in values])


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes (g, idx, digest, ...) with parent, the parent's run, and whether the node is its group's only one."""
    frame = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = nodes.withColumn("parent", F.floor(F.col("idx") / fanout)).withColumn("run", F.collect_list("digest").over(frame))
    return run.withColumn("alone", (F.col("parent") == 0) & (F.size("run") == 1))


def _parents(level: DataFrame, fanout: int) -> DataFrame:
    first = level.where((F.col("idx") % fanout == 0) & ~F.col("alone"))
    return first.select("g", F.col("parent").alias("idx"), digest(F.array_join("run", "")).alias("digest"))


def trees(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """(levels of (g, idx, digest), the nodes' own first, and (g, top, height) of each group). ``nodes`` is read more than once."""
    levels, tops = [nodes], []
    left = (nodes.agg(F.max("idx")).first()[0] or 0) + 1
    while True:
        level = _level(levels[-1], fanout)
        tops.append(level.where("alone").select("g", F.col("digest").alias("top"), F.lit(len(tops)).alias("height")))
        if left == 1:
            break
        left = -(-left // fanout)
        levels.append(persisted(_parents(level, fanout)))
    out = tops[0]
    for x in tops[1:]:
        out = out.unionByName(x)
    return levels, persisted(out)


def proofs(levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes of the lowest level with the columns of ``above`` (g, height, steps, ...), ``steps`` led by what lies on the way to their group's top."""
    carried = [c for c in above.columns if c not in ("g", "height", "steps")]
    down = None
    for height in reversed(range(len(levels))):
        upper = above.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("parent"), *carried, "steps")
        if down is not None:
            upper = upper.unionByName(down.select("g", F.col("idx").alias("parent"), *carried, "steps"))
        pos = (F.col("idx") % fanout).cast("int")
        sides = F.struct(F.array_join(F.slice("run", 1, pos), "").alias("left"), F.array_join(F.slice("run", pos + 2, fanout), "").alias("right"))
        own = F.when(F.col("alone"), F.array().cast(STEPS)).otherwise(F.array(sides))
        level = _level(levels[height], fanout)
        down = level.withColumn("own", own).drop("run", "alone").join(upper, ["g", "parent"]).withColumn("steps", F.concat("own", "steps")).drop("own", "parent")
    return down


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda at, step: digest(step["left"], at, step["right"]))


def proof_digest(steps: Column) -> Column:
    return digest(F.array_join(F.transform(steps, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), altered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """(key, group, leaf, altered, subroot, root, steps) of each row. ``steps``: what stands left and right of the way from leaf to root.

    ``altered``: the leaf's preimage in a changed table, hashed in the same scan, to be checked against the proof; null where nothing changed.
    """
    leaf = digest(preimage([F.col(c) for c in fields]))
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null first
    changed = F.lit(None).cast("string") if altered is None else F.sha2(altered.cast("binary"), 256)
    leaves = persisted(docs.select(F.col(key).alias("_key"), F.col(group).alias("_value"), g.alias("g"), leaf.alias("digest"), changed.alias("altered")))
    levels, tops = trees(numbered(leaves, ["_key", "digest", "altered"], "g"), fanout)
    groups = numbered(tops.select(F.col("g").alias("of"), "height", F.col("top").alias("digest"), F.lit("").alias("g")), ["of"])
    upper, root = trees(groups, fanout)
    root = root.select("g", "height", F.col("top").alias("root"), F.array().cast(STEPS).alias("steps"))
    upper = proofs(upper, root, fanout).select(F.col("of").alias("g"), "height", F.col("digest").alias("subroot"), "root", "steps")
    return proofs(levels, persisted(upper), fanout).select(F.col("_key").alias(key), F.col("_value").alias(group), F.col("digest").alias("leaf"), "altered", "subroot", "root", "steps")
