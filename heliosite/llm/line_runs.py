"""Removal of lines that several documents hold, by levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased. One scan writes (key hash, document) for all
keys of ``shortest`` code points, dealt to batches of documents. Then, batch by batch,

1. the batch's keys are summed up to (hash, documents, largest document);
2. they merge-anti-join the runs: keys that a run has settled, with ``least`` documents and a largest document that the
   batch doesn't exceed, have nothing to add. Very frequent ones (``HEAVY`` documents of a batch) still add their count;
3. what is left is the batch's own run, a table sorted by hash in as many buckets as a shuffle has partitions. Batches are
   dealt out alike, so the merge join reads runs without a shuffle. ``FANOUT`` runs of a level are compacted into one of the next.

All runs together then give the keys that ``least`` documents hold, and the document that keeps each. A line goes where a
document holds such a key without being its keeper. ``LineRuns`` can also be fed batch after batch on its own: a document counts
once in a batch, and mustn't come again in a later one; retried batches are told by their name.

Hashes have 64 bits. Keys of at least a ``SHARE``-th of all (key, document) pairs, of which there can't be more than ``SHARE``,
are shipped to the scan that drops lines, so the frequent ones are never joined. For the others, pairs meet keys in a
join, and only texts that may lose such a line, as a bitmap of fixed size tells, are shuffled to meet their hashes.

Defined results: null or empty text is one empty line and keeps the digest of no bytes; keys below ``shortest`` code points
never go; rows that share a doc_id count as one document, each giving its own result; rows without a doc_id count
together as one, the smallest; a line that a document repeats is kept or lost with all its copies there; texts and
lines of any length are taken whole; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliosite.llm.marks import Marks
from heliosite.llm.storage import delete_folder, discarded, persisted, shared_dir, shuffles_dropped
from heliosite.llm.texts import LOWER, WHITE, buffers, prefix_hash, slices, span_hash, trimmed

SHORTEST = 20
LEAST = 3
FANOUT = 4
HEAVY = 10_000
BATCHES = 6
SHARE = 1 << 16
NO_ID = -(1 << 63)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all lines of a buffer of rows, in order; an empty row is one empty line."""
    feeds = np.flatnonzero(data == 0x0A)
    row = np.searchsorted(offsets, feeds, "right") - 1
    rows = np.concatenate([np.arange(len(offsets) - 1), row])
    start = np.concatenate([offsets[:-1], feeds + 1])
    by = np.lexsort((start, rows))
    rows, start = rows[by], start[by]
    last = np.append(rows[1:] != rows[:-1], True)[: len(rows)]
    end = np.where(last, offsets[1:][rows], np.append(start[1:], 0)[: len(start)] - 1)
    return rows, start, end


def line_keys(data: np.ndarray, offsets: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """(row, start, end, hash of the key, whether the key is long enough) of all lines."""
    row, start, end = lines_of(data, offsets)
    if not len(data):
        return row, start, end, np.zeros(len(row), np.uint64), np.zeros(len(row), bool)
    ink = np.flatnonzero(~WHITE[data])
    low, high = np.searchsorted(ink, start), np.searchsorted(ink, end)
    some = low < high
    first = np.where(some, np.append(ink, 0)[low], start)
    last = np.where(some, np.append(ink, 0)[high - 1] + 1, start)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return row, start, end, span_hash(prefix_hash(LOWER[data]), first, last), points[last] - points[first] >= shortest


def keys(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(h, doc): the distinct keys of each row of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for first, last in slices(offsets):
                at = offsets[first : last + 1]
                row, _, _, h, long = line_keys(data[at[0] : at[-1]], at - at[0], shortest)
                row, h = row[long], h[long]
                by = np.lexsort((h, row))
                row, h = row[by], h[by]
                new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[first + row[new]])], names=["h", "doc"])

    return docs.select("doc", "text").mapInArrow(trimmed(run), "h long, doc long")


class LineRuns:
    """Levelled sorted runs of (h, n, top): documents that hold a key, and the largest of them."""

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]  # names of bucketed tables and their folders
        self.taken: set[str] = set()

    def _write(self, rows: DataFrame, level: int) -> None:
        """``rows`` come dealt out by h, as from a grouping: each bucket is one task's."""
        name, folder = f"heliosite_run_{uuid.uuid4().hex}", shared_dir(self.spark)
        with shuffles_dropped(self.spark):
            rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", folder).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, folder))

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, folder in runs:
            self.spark.sql(f"drop table {name}")
            delete_folder(self.spark, folder)

    def add(self, batch: DataFrame, name: str | None = None) -> None:
        """Take in a batch of (h, doc), each pair once; a batch whose ``name`` was taken before is left out."""
        if name is not None and name in self.taken:
            return
        new = batch.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("top"))
        for table, _ in (run for runs in self.levels for run in runs):
            settled = self.spark.table(table).where(F.col("n") >= self.least).select(F.col("h").alias("_h"), F.col("top").alias("_top"))
            new = new.join(settled.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("top") <= F.col("_top")) & (F.col("n") < HEAVY), "left_anti")
        self._write(new, 0)
        self.taken |= {name} - {None}
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._write(self._merged(runs), level + 1)
            self._drop(runs)
            level += 1

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        # read as plain files: a union of bucketed columnar scans claims their buckets, but doesn't bring them together
        rows = self.spark.read.schema("h long, n long, top long").parquet(*[folder for _, folder in runs])
        return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def common(self) -> DataFrame:
        """(h, n, top) of the keys that ``least`` documents hold; n is at least their number, or that which settled them."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "h long, n long, top long")
        return self._merged(runs).where(F.col("n") >= self.least)

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]


def dealt(docs: DataFrame, batches: int = BATCHES) -> list[tuple[int | None, int | None]]:
    """Ranges (from, below) of ``doc`` with about as many rows each, the largest first."""
    shares = [i / batches for i in range(1, batches)]
    edges = sorted({int(x) for x in docs.approxQuantile("doc", shares, 0.01)}) if shares else []
    return list(zip([None, *edges], [*edges, None], strict=True))[::-1]


class Shipped:
    """Frequent keys with their keepers, looked up by hash."""

    def __init__(self, rows: list):
        self.h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
        by = np.argsort(self.h)
        self.h, self.top = self.h[by], np.array([r["top"] for r in rows], np.int64)[by]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is here, and its keeper."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return self.h[at] == h, self.top[at]


def frequent(common: DataFrame, pairs: int) -> tuple[DataFrame, Shipped]:
    """(the other keys, those of at least a ``SHARE``-th of the pairs)."""
    least = -(-pairs // SHARE)
    return common.where(F.col("n") < least), Shipped(common.where(F.col("n") >= least).select("h", "top").collect())


def common_lines(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """((h, doc) of all keys, (h, n, top) of those that ``least`` documents of (doc, text) hold), both written."""
    each = keys(docs, shortest)
    if docs.groupBy("doc").count().where("count > 1").limit(1).count():
        each = each.distinct()
    held = persisted(each)
    runs = LineRuns(docs.sparkSession, least)
    for i, (low, high) in enumerate(dealt(docs, batches)):
        part = held if low is None else held.where(F.col("doc") >= low)
        runs.add(part if high is None else part.where(F.col("doc") < high), str(i))
    common = persisted(runs.common())
    runs.close()
    return held, common


def _losses(held: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc, hs): the ``rare`` keys (h, n, top) whose lines a document loses."""
    marks = held.sparkSession.sparkContext.broadcast(Marks.of(rare.select("h")))

    def near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.filter(pa.array(Marks.has(marks.value, batch.column(0).to_numpy().view(np.uint64))))

    met = held.mapInArrow(trimmed(near), held.schema).join(rare, "h").where(F.col("doc") != F.col("top"))
    return met.groupBy("doc").agg(F.collect_list("h").alias("hs"))


def _kept(raw: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    return raw if not gone.any() else b"\n".join(raw[a:b] for a, b in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True))


SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def drop_lines(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row, and with ``with_text`` the text that stays, ``kept``."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    held, common = common_lines(rows, least, shortest, batches)
    rare, often = frequent(common, held.count())
    losses = persisted(_losses(held, rare))
    discarded(held, common)
    ship = docs.sparkSession.sparkContext.broadcast
    shipped, touched = ship(often), ship(Marks.of(losses.select(F.xxhash64("doc").alias("h"))))
    schema = SCHEMA + (", kept string" if with_text else "")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 5 if with_text else 4]

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"][: len(kinds)])

    def results(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, own: list | None = None) -> list[tuple]:
        row, start, end, h, long = line_keys(data, offsets, shortest)
        known, top = shipped.value.find(h)
        gone = long & known & (top != ids[row])
        firsts, out = np.searchsorted(row, np.arange(len(ids) + 1)), []
        for i, doc in enumerate(ids.tolist()):
            a, b = firsts[i], firsts[i + 1]
            lost = gone[a:b] | (long[a:b] & np.isin(h[a:b], np.array(own[i], np.int64).view(np.uint64))) if own and own[i] else gone[a:b]
            kept = _kept(data[offsets[i] : offsets[i + 1]].tobytes(), start[a:b] - offsets[i], end[a:b] - offsets[i], lost)
            out.append((doc, int(b - a), int(lost.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        return out

    def scan(waiting: bool):
        """Rows that surely lose no rare key, done; or the others, packed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shrink = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                batch = batch.filter(pa.array(Marks.has(touched.value, batch.column(2).to_numpy().view(np.uint64)) == waiting))
                data, offsets = buffers(batch.column(1))
                ids = batch.column(0).to_numpy()
                for first, last in slices(offsets):
                    at = offsets[first : last + 1]
                    if waiting:
                        packed = [shrink.compress(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[first:last]), pa.array(packed, pa.binary())], names=["doc", "packed"])
                    else:
                        yield made(results(ids[first:last], data[at[0] : at[-1]], at - at[0]))

        return trimmed(run)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                raw = np.frombuffer(unzip.decompress(r["packed"]), np.uint8)
                yield made(results(np.array([r["doc"]], np.int64), raw, np.array([0, len(raw)]), [r["hs"]]))

    scanned = rows.select("doc", "text", F.xxhash64("doc").alias("mark"))
    alone = scanned.mapInArrow(scan(False), schema)
    met = scanned.mapInArrow(scan(True), "doc long, packed binary").join(losses, "doc", "left").mapInArrow(trimmed(cut), schema)
    return alone.unionByName(met).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
