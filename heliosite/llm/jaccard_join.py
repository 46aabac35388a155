"""Exact Jaccard self-join of word n-gram sets through prefix trees, and the groups that its links form.

Two sets of size m <= n reach ``percent`` only if they share ceil(percent * (n + m) / (100 + percent)) members. So, in any
order that all sets follow, the first ``prefix_length`` - 1 + k members of both hold k common ones.

1. Every text gives its set's name, size and first prefix, for k = ``asked`` (a tenth of the set), in an order by hash with
   common n-grams last (``COMMON`` of them, the most frequent of a sixteenth of the documents; this first order changes
   costs only). A member that one prefix alone holds leads nowhere; the sets that hold k others are in play. Equal sets are one vertex.
2. The sets in play are counted against each other: members that one of them alone holds can't be shared and are dropped,
   the others stand in the global order, rarest first, by their counts over all sets in play. A set that keeps fewer than
   ``percent`` of its members goes.
3. The prefixes under this order give one row for each member: behind it, ``a`` members' worth of partner size can still
   reach ``percent`` if it is the first that a pair shares. Rows whose member holds no partner of fitting size in another component go.
4. Rounds of hubs: a member's bearer with most shared members is its hub (a random one in later rounds), each other bearer
   takes the hub that most of its members name, and hub and guests meet in a prefix tree: the guests' ordered sets stand
   in a trie, the hub runs down it once, overlaps so far are shared by all guests below, and a branch is left when what
   remains can't reach the overlap asked for. Links make components. Rounds go on while a tenth of what they try links.
5. What then still spans components meets member by member: bearers outside a member's largest component run down tries
   of its bearers, from the shared member on. Pairs within a component can't change it. Nothing is capped, so no link
   between components is lost.

A trie holds at most about ``GUESTS`` sets and ``TRIE`` members; larger groups are split into salted ones. Pairs exist only
inside tasks; links are all that comes out. Hashes have 64 bits; sets are equal if the sums of their mixed hashes are.

Defined results: null or white texts have no set, link with nothing and keep their own id; fewer words than ``n`` make
one n-gram of all; rows that share a doc_id are in one group and each gives a row; a row without a doc_id links with nothing
and has a null component_id; an empty table gives an empty result; texts of any length are taken whole; equal texts are
one vertex, so ties can't arise. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliosite.llm.components import components
from heliosite.llm.marks import Marks
from heliosite.llm.storage import discarded, persisted, shuffles_dropped
from heliosite.llm.texts import buffers, mix, sequences, slices, trimmed, word_hashes

COMMON = 1 << 16
GUESTS = 256
TRIE = 1 << 21


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of each row in rising order, members before each row)."""
    words, firsts = word_hashes(data, offsets)
    grams, firsts = sequences(words, firsts, n)
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    by = np.lexsort((grams, row))
    grams, row = grams[by], row[by]
    keep = np.concatenate([[True], (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])]) if len(grams) else np.zeros(0, bool)
    grams, row = grams[keep], row[keep]
    return grams, np.searchsorted(row, np.arange(len(firsts)))


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size - -(-size * percent // 100) + 1


def asked(size: np.ndarray) -> np.ndarray:
    """How many members of its first prefix a set must share to be in play; the more, the longer the prefix and the fewer the sets."""
    return -(-size // 10)


def lists(members: np.ndarray, firsts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(members.view(np.int64)))


def _sets(docs: DataFrame, n: int, schema: str, emit, marks=None) -> DataFrame:
    """``emit(ids, members, firsts)`` gives the columns for a run of rows of (doc_id, text), of those in ``marks`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if marks is not None:
                batch = batch.filter(pa.array(Marks.has(marks.value, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))))
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0)
            for first, last in slices(offsets, 1 << 20):
                low, high = offsets[first], offsets[last]
                columns = emit(ids[first:last], *gram_sets(data[low:high], offsets[first : last + 1] - low, n))
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))

    return docs.select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(trimmed(run), schema)


def name_of(members: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A name for each row's set, whatever the order of its members."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members))])
    return mix(sums[firsts[1:]] - sums[firsts[:-1]] + np.diff(firsts).astype(np.uint64)).view(np.int64)


class Trie:
    """Sets in one global order, as their lexical list: what one shares with the one before it is the branch it leaves from."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """``sets``: numbers of the members that others may share, in order; ``sizes``: of the whole sets."""
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        self.sets, self.sizes, self.shared = sets, sizes, []
        before = np.zeros(0, np.int64)
        for i in self.order:
            m = min(len(before), len(sets[i]))
            same = before[:m] == sets[i][:m]
            self.shared.append(m if same.all() else int(np.argmin(same)))
            before = sets[i]

    def reached(self, present: np.ndarray, size: int, percent: int, wanted: np.ndarray) -> Iterator[int]:
        """Numbers of the ``wanted`` sets that reach ``percent`` with the set of ``size`` members whose numbers are ``present``. ``wanted`` may change meanwhile."""
        counted, dead, branch = np.zeros(1, np.int64), -1, 0
        for i, shared in zip(self.order, self.shared, strict=True):
            branch = min(branch, shared)
            if not wanted[i]:
                continue
            own = self.sets[i]
            need = -(-percent * (size + int(self.sizes[i])) // (100 + percent))
            if 0 <= dead <= branch and counted[dead] + len(own) - dead < need:
                continue
            counted = np.concatenate([counted[: branch + 1], counted[branch] + np.cumsum(present[own[branch:]])])
            low = np.flatnonzero(counted + np.arange(len(own), -1, -1) < need)
            dead, branch = (int(low[0]) if len(low) else -1), len(own)
            if counted[-1] >= need:
                yield i


def numbered(members: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each array with numbers in place of hashes, and how many there are."""
    each, at = np.unique(np.concatenate([np.zeros(0, np.int64), *members]), return_inverse=True)
    return np.split(at, np.cumsum([len(m) for m in members])[:-1]), len(each)


def _parts(rows: int | str, members: str) -> F.Column:
    """Into how many tries ``rows`` sets of ``members`` members together go."""
    return F.greatest(F.ceil(F.col(rows) / GUESTS), F.ceil(F.col(members) / TRIE)).cast("int")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, guest) of ``pairs`` (hub, guest, s: members of the guest) whose ``sets`` (h, n, members) reach ``percent``."""
    parts = pairs.groupBy("hub").agg(F.count("*").alias("k"), F.sum("s").alias("t")).select("hub", _parts("k", "t").alias("parts"))
    salted = pairs.join(parts, "hub").withColumn("salt", F.pmod(F.xxhash64("guest"), F.col("parts")).cast("int"))
    guests = salted.select("hub", "salt", F.col("guest").alias("h")).join(sets, "h")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).withColumn("h", F.col("hub")).join(sets, "h")

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        codes, many = numbered([np.asarray(m, np.int64) for m in group["members"]])
        names, sizes = group["h"].to_numpy(), group["n"].to_numpy()
        own = int(np.flatnonzero(names == keys[0])[0])
        present = np.zeros(many, bool)
        present[codes[own]] = True
        others = np.flatnonzero(names != keys[0])
        trie = Trie([codes[i] for i in others], sizes[others])
        good = [names[others[i]] for i in trie.reached(present, int(sizes[own]), percent, np.ones(len(others), bool))]
        return pd.DataFrame({"hub": [keys[0]] * len(good), "guest": good}).astype("int64")

    return guests.unionByName(hubs).groupBy("hub", "salt").applyInPandas(run, "hub long, guest long")


def _common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``COMMON`` frequent n-grams (rising) and their ranks, from a sixteenth of the documents. The order that they give changes costs, not results."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0)
    often = _sets(part, n, "member long", lambda ids, members, firsts: {"member": members.view(np.int64)}).groupBy("member").count().where("count >= 4")
    with shuffles_dropped(docs.sparkSession):
        names = np.array([r["member"] for r in often.orderBy(F.desc("count"), "member").limit(COMMON).collect()], np.int64).view(np.uint64)
    by = np.argsort(names)
    return names[by], (len(names) - np.arange(len(names)))[by]


def _prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n, h, prefix) of every row, written once."""
    order = docs.sparkSession.sparkContext.broadcast(_common(docs, n))

    def emit(ids, members, firsts):
        common, rank = order.value
        size = np.diff(firsts)
        names = name_of(members, firsts)
        if len(common):
            at = np.minimum(np.searchsorted(common, members), len(common) - 1)
            late = np.flatnonzero(common[at] == members)
            if len(late):
                place = np.zeros(len(members), np.int64)
                place[late] = rank[at[late]]
                members = members[np.lexsort((members, place, np.repeat(np.arange(len(size)), size)))]
        length = np.where(size > 0, np.minimum(prefix_length(size, percent) - 1 + asked(size), size), 0)
        ends = np.concatenate([[0], np.cumsum(length)])
        take = np.repeat(firsts[:-1] - ends[:-1], length) + np.arange(ends[-1])
        return {"doc_id": ids, "n": size.astype(np.int32), "h": names, "prefix": lists(members[take], ends)}

    return persisted(_sets(docs, n, "doc_id long, n int, h long, prefix array<long>", emit))


def _in_play(docs: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """(h, n, members): the whole sets whose first prefix holds as many members of other sets' prefixes as ``asked``."""
    ship = docs.sparkSession.sparkContext.broadcast
    rows = heads.where("n > 0 and doc_id is not null")
    held = rows.select("h", F.explode("prefix").alias("member")).groupBy("member").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    with shuffles_dropped(docs.sparkSession):
        met = ship(Marks.of(held.where("low <> high").select(F.col("member").alias("h"))))

    def bearing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            hit = np.concatenate([[0], np.cumsum(Marks.has(met.value, column.flatten().to_numpy().view(np.uint64)))])
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            size = batch.column(2).to_numpy().astype(np.int64)
            yield batch.select([0, 1]).filter(pa.array(hit[ends[1:]] - hit[ends[:-1]] >= asked(size)))

    wanted = rows.select("doc_id", "h", "n", "prefix").mapInArrow(trimmed(bearing), "doc_id long, h long").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    with shuffles_dropped(docs.sparkSession):
        marks = ship(Marks.of(wanted.select(F.xxhash64("doc_id").alias("h"))))
    return persisted(_sets(docs.where("doc_id is not null"), n, "h long, n int, members array<long>", lambda ids, members, firsts: {"h": name_of(members, firsts), "n": np.diff(firsts).astype(np.int32), "members": lists(members, firsts)}, marks))


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(h, n, members): the members that other sets hold too, rarest first, where they are enough to reach ``percent``."""
    single = sets.where("n > 0").select("h", F.explode("members").alias("member"))
    counts = persisted(single.groupBy("member").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("df")).where("low <> high").select("member", "df"))
    marks = sets.sparkSession.sparkContext.broadcast(Marks.of(counts.select(F.col("member").alias("h"))))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each member that other sets may hold; members that none holds aren't shuffled with their sets."""
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            members = batch.column(2).flatten().to_numpy()
            keep = Marks.has(marks.value, members.view(np.uint64))
            row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(members[keep])], names=["h", "n", "member"])

    each = sets.where("n > 0").select("h", "n", "members").mapInArrow(trimmed(shared), "h long, n int, member long")
    each = each.join(counts, "member").groupBy("h", "n").agg(F.sort_array(F.collect_set(F.struct("df", "member"))).alias("x"))
    ordered = persisted(each.where(F.size("x") * 100 >= F.col("n") * percent).select("h", "n", F.col("x.member").alias("members")))
    discarded(counts)
    return ordered


def _pruned(rows: DataFrame, times: int = 2) -> DataFrame:
    """Rows (member, h, n, a, c, ...) without those whose member holds no bearer of fitting size or no second component."""
    for _ in range(times):
        fits = rows.groupBy("member").agg(F.min("n").alias("_lo"), F.max("a").alias("_hi"), F.min("c").alias("_c0"), F.max("c").alias("_c1")).where("_c0 <> _c1")
        rows = rows.join(fits, "member").where("a >= _lo and n <= _hi").drop("_lo", "_hi", "_c0", "_c1")
    return rows


def _rest(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, guest): for bearers outside their member's largest component, a link to each other component that they link with behind the member."""
    shares = rows.groupBy("member", "c").agg(F.count("*").alias("k"), F.sum("s").alias("t"))
    most = shares.groupBy("member").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k"), F.sum("t").alias("t"))
    side = rows.join(most.select("member", F.col("top.c").alias("most"), _parts("k", "t").alias("parts")), "member").withColumn("runs", F.col("c") != F.col("most"))
    fits = side.where("runs").groupBy("member").agg(F.min("n").alias("lo"), F.max("a").alias("hi"))
    side = persisted(side.join(fits, "member").where("a >= lo and n <= hi").drop("lo", "hi", "most"))
    salt = F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")
    standing = side.withColumn("salt", salt).withColumn("probe", F.lit(False))
    running = side.where("runs").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("probe", F.lit(True))
    both = standing.unionByName(running).join(sets.select("h", "members"), "h")
    both = both.select("member", "salt", "probe", "runs", "h", "n", "a", "c", F.slice("members", F.col("pos") + 1, F.size("members")).alias("members"))

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        codes, many = numbered([np.asarray(m, np.int64) for m in group["members"]])
        h, n, a, c, probe, runs = (group[x].to_numpy() for x in ("h", "n", "a", "c", "probe", "runs"))
        stand, hubs, guests = np.flatnonzero(~probe), [], []
        trie = Trie([codes[i] for i in stand], n[stand])
        for x in np.flatnonzero(probe):
            wanted = (c[stand] != c[x]) & (n[stand] <= a[x]) & (a[stand] >= n[x]) & (~runs[stand] | (h[stand] > h[x]))
            if wanted.any():
                present = np.zeros(many, bool)
                present[codes[x]] = True
                for i in trie.reached(present, int(n[x]), percent, wanted):
                    hubs.append(h[x])
                    guests.append(h[stand[i]])
                    wanted &= c[stand] != c[stand[i]]
        return pd.DataFrame({"hub": hubs, "guest": guests}).astype("int64")

    return both.groupBy("member", "salt").applyInPandas(run, "hub long, guest long")


def links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, links): (doc_id, n, h) of each row of ``docs``, h naming its set, and (hub, guest) pairs of sets whose components are those of all links."""
    docs = docs.select("doc_id", "text")
    first = _prefixes(docs, n, percent)
    whole = _in_play(docs, first, n)
    heads = persisted(first.select("doc_id", "n", "h"))
    discarded(first)
    sets = _ordered(whole, percent)
    discarded(whole)
    behind = f"cast(floor((s - pos) * {100 + percent} / {percent}) as long) - n"
    prefix = F.slice("members", 1, F.size("members") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    rows = sets.select("h", "n", F.size("members").alias("s"), F.posexplode(prefix).alias("pos", "member")).withColumn("a", F.expr(behind))
    rows, found, turn = persisted(_pruned(rows.withColumn("c", F.col("h")))), None, 0
    while True:
        best = F.col("s") / F.col("n") if turn == 0 else F.lit(0.0)
        hub = F.max(F.struct(best.alias("q"), F.xxhash64("h", F.lit(turn)).alias("x"), "h", "n", "a", "c")).alias("hub")
        offers = rows.join(rows.groupBy("member").agg(hub), "member").where("c <> hub.c and n <= hub.a and hub.n <= a")
        counts = offers.groupBy(F.col("h").alias("guest"), "s", F.col("hub.h").alias("hub")).agg(F.count("*").alias("k"))
        chosen = persisted(counts.groupBy("guest", "s").agg(F.max(F.struct("k", "hub")).alias("x")).select("x.hub", "guest", "s"))
        new = persisted(verified(chosen, sets, percent))
        tried, linked = chosen.count(), new.count()
        found = new if found is None else found.unionByName(new)
        discarded(chosen)
        if linked:
            labels = components(found, "hub", "guest")
            now = rows.drop("c").join(labels, rows.h == labels.node, "left").withColumn("c", F.coalesce("component", "h")).drop("node", "component")
            before, rows = rows, persisted(_pruned(now))
            discarded(before, labels)
        turn += 1
        if linked * 10 <= tried:
            break
    found = persisted(found.unionByName(_rest(rows, sets, percent)))
    discarded(rows, sets)
    return heads, found


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of whole texts, a row for each row of ``docs``; component_id is the smallest doc_id that links lead to."""
    heads, found = links(docs, n, percent)
    rows = heads.where("n > 0 and doc_id is not null")
    again = rows.groupBy("doc_id").agg(F.min("h").alias("hub"), F.max("h").alias("most")).where("hub <> most").select("doc_id", "hub")
    same_id = rows.join(again, "doc_id").select("hub", F.col("h").alias("guest"))
    labels = components(found.unionByName(same_id), "hub", "guest")
    in_group = rows.join(labels, rows.h == labels.node, "left").select("doc_id", "n", F.coalesce("component", "h").alias("c"))
    least = in_group.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    grouped = in_group.join(least, "c").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = heads.where("n = 0 or doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, and of rows that share it the one with the smallest text. Rows without an id stay."""
    found = persisted(groups(docs, n, percent))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    marks = docs.sparkSession.sparkContext.broadcast(Marks.of(gone.select(F.xxhash64("_gone").alias("h"))))

    def part(marked: bool) -> DataFrame:
        """Rows whose id may be one to go, or those whose id surely isn't."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = Marks.has(marks.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64))
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(hit == marked))

        rows = docs.where("doc_id is not null")
        return rows.select(*rows.columns, F.xxhash64("doc_id").alias("_mark")).mapInArrow(trimmed(run), docs.schema)

    doubtful = part(True)
    named = part(False).unionByName(doubtful.join(gone, doubtful["doc_id"] == gone["_gone"], "left_anti"))
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        named = named.select(F.struct("*").alias("_kept"), place.alias("_place")).where("_place = 1").select("_kept.*")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
