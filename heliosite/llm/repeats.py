"""Removal of byte strings that occur earlier in the corpus, by minimiser fingerprints in place of prefix doubling.

A byte goes if it lies in a ``length``-byte string that also starts earlier: in a row of smaller doc_id, or before it in
the same row. Instead of prefix doubling, minimisers are fingerprinted. Doubling names the positions by the ``k`` bytes
after them, and renames those that share a name by more bytes until a name is unique or ``length`` bytes are named. Here

1. names are 64-bit hashes of the named bytes, equal for equal bytes in every task, where a suffix array has dense ranks
   from a global sort; the pair (name at p, name at p + k) needs no second row, as the worker reads both from the text.
2. round one names ``k`` bytes at anchors only: in each ``length``-byte window, the leftmost position whose k-byte hash
   is smallest. Equal windows choose equal anchors, so a window repeats only if its anchor's name does. Spark counts the
   anchors of each name; unique ones drop out.
3. round two names all the bytes of the windows that chose the anchor. Each bearer but the first of equal bytes is a
   repeat in all its windows and needs no further round. The first ones go on where their anchor's name has others.
4. what goes on is named anew by the bytes that neighbouring windows share (``STEP`` starts, 85 of 100 bytes): unique ones
   drop out, and those that agree on all bytes are resolved as in round two.
5. what is left, at the edges of repeated passages, is named window by window by its ``length`` bytes, which is the
   threshold; the earliest bearer stays and the others are repeats. Rounds that see only the first of equal runs lose
   nothing, as whatever repeats a later one repeats the first.

Between rounds a bitmap of fixed size tells the scan which names and places go on, so that only those rows, and only texts that lose
bytes, are shuffled; what it lets through in error is dropped by the exact step after it. The first round's name and
the last are independent hashes, together 128 bits.

Defined results: null text is empty (n_bytes 0, the digest of no bytes); texts shorter than ``length`` never repeat;
rows that share a doc_id are one document, made of their different texts in order; a null doc_id counts as the smallest.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliosite.llm.marks import Marks
from heliosite.llm.storage import discarded, persisted, shuffles_dropped
from heliosite.llm.texts import buffers, mix, prefix_hash, slices, span_hash, trimmed

LENGTH = 100
ANCHOR = 32
BLOCK = 1 << 15
ROWS = 1 << 17
STEP = 16
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(row, anchor position, first window, last window, name, name of all its windows' bytes) over a buffer of rows; positions in the buffer."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(data)
    if n < length:
        return none
    sums = prefix_hash(data)
    at = np.arange(n - k + 1)
    name = span_hash(sums, at, at + k)
    # the smallest hash, then the leftmost, of each run of w positions; 24 bits hold a position in the buffer
    w = length - k + 1
    key = (name & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    blocks = -(-len(key) // w) + 1
    padded = np.full(blocks * w, _FAR)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    windows = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    if not len(windows):
        return none
    least = np.minimum(behind[windows], ahead[windows + w - 1])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    low, high, anchor, row = windows[new], windows[np.append(new[1:], len(windows)) - 1], anchor[new], row[new]
    whole = span_hash(sums, low, high + length) ^ mix((anchor - low).astype(np.uint64))
    return row, anchor, low, high, name[anchor], whole


def blocks_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before it in its row, buffer, offsets) of pieces of at most ``most`` bytes that hold each window once."""
    for first, last in slices(offsets, most):
        low, high = offsets[first], offsets[last]
        if high - low <= 2 * most:
            yield first, 0, data[low:high], offsets[first : last + 1] - low
        else:
            for start in range(0, max(1, int(high - low) - length + 1), most):
                part = data[low + start : min(high, low + start + most + length - 1)]
                yield first, start, part, np.array([0, len(part)])


def _scan(docs: DataFrame, length: int, k: int, schema: str, emit) -> DataFrame:
    """``emit(ids, skipped, offsets, data, anchors)`` on each block of the texts; yields record batches of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, skipped, part, at in blocks_of(data, offsets, length):
                found = anchors(part, at, length, k)
                if len(found[0]):
                    held.append(emit(ids[first:], skipped, at, part, found))
                    rows += len(next(iter(held[-1].values())))
                if rows >= ROWS:
                    yield joined(held)
                    held, rows = [], 0
        if rows:
            yield joined(held)

    def joined(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in held])) for c in held[0]], names=list(held[0]))

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def _blocks(part: np.ndarray, found: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, ...]:
    """As ``anchors``, but a row for each run of windows whose distance to the anchor falls in one block of ``STEP``; named by the bytes that they share."""
    row, anchor, low, high, name, _ = found
    sums, out = prefix_hash(part), []
    for j, near in enumerate(range(0, length, STEP)):
        most, least = np.minimum(anchor - low, near + STEP - 1), np.maximum(anchor - high, near)
        at = np.flatnonzero(most >= least)
        if len(at):
            a, first, last = anchor[at], anchor[at] - most[at], anchor[at] - least[at]
            core = span_hash(sums, a - near, a - near - STEP + 1 + length)
            whole = span_hash(sums, first, last + length) ^ mix(most[at].astype(np.uint64))
            out.append((row[at], a, first, last, mix(core + mix(name[at] + np.uint64(j + 1))), whole))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else found


def _windows(part: np.ndarray, found: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, ...]:
    """A row for each window, named by all its bytes and by what it stood under."""
    row, anchor, low, high, name, _ = found
    size = high - low + 1
    start = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    own = span_hash(prefix_hash(part), start, start + length)
    return np.repeat(row, size), np.repeat(anchor, size), start, start, mix(own + np.repeat(name, size)), own


def _place(ids: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A hash of a run's document and first window."""
    return mix(mix(ids.astype(np.int64).view(np.uint64)) + low.astype(np.int64).view(np.uint64))


def _by_name(marks):
    def kept(ids, skipped, at, part, found):
        keep = Marks.has(marks.value, mix(found[4]))
        return tuple(x[keep] for x in found)

    return kept


def _by_place(marks):
    def kept(ids, skipped, at, part, found):
        keep = Marks.has(marks.value, _place(ids[found[0]], skipped + found[2] - at[found[0]]))
        return tuple(x[keep] for x in found)

    return kept


def _split(f, length: int):
    return lambda ids, skipped, at, part, found: f(part, found, length)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, low = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(_place(ids, low).view(np.int64))], names=["h"])


class _Level:
    """One round: rows of windows that share a name, from a scan whose ``steps`` leave out what earlier rounds settled."""

    def __init__(self, docs: DataFrame, length: int, k: int, steps: list):
        self.args, self.steps = (docs, length, k), steps

    def _found(self):
        steps = self.steps

        def narrowed(ids, skipped, at, part, found):
            for step in steps:
                found = step(ids, skipped, at, part, found)
            return found

        return narrowed

    def shared(self):
        """Marks of the names that more than one row bears."""
        narrowed = self._found()
        docs = self.args[0]
        names = _scan(*self.args, "h long", lambda *block: {"h": mix(narrowed(*block)[4]).view(np.int64)})  # anchors have small hashes: mixed, they fill the bitmap evenly
        with shuffles_dropped(docs.sparkSession):
            return docs.sparkSession.sparkContext.broadcast(Marks.of(names.groupBy("h").count().where("count > 1")))

    def resolve(self, further: bool = True) -> tuple[DataFrame, object]:
        """(doc_id, low, high) of the rows that agree with an earlier one on all bytes, and marks of the places of those that agree with none before, but bear a name with others."""
        narrowed = self._found()

        def bearers(ids, skipped, at, part, found):
            row, _, low, high, name, whole = narrowed(ids, skipped, at, part, found)
            return {"name": name.view(np.int64), "whole": whole.view(np.int64), "doc_id": ids[row], "low": skipped + low - at[row], "more": (high - low).astype(np.int32)}

        rows = persisted(_scan(*self.args, "name long, whole long, doc_id long, low long, more int", bearers))
        kinds = persisted(rows.groupBy("name", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "low")).alias("first")))
        copies = kinds.where("n > 1").select("name", "whole", "first")
        repeats = persisted(rows.join(copies, ["name", "whole"]).where(F.struct("doc_id", "low") != F.col("first")).select("doc_id", "low", (F.col("low") + F.col("more")).alias("high")))
        marks = None
        if further:
            several = kinds.groupBy("name").agg(F.min("whole").alias("least"), F.max("whole").alias("most")).where("least <> most").select("name")
            places = kinds.join(several, "name").select("first.doc_id", "first.low").mapInArrow(_placed, "h long")
            with shuffles_dropped(rows.sparkSession):
                marks = rows.sparkSession.sparkContext.broadcast(Marks.of(places))
        discarded(rows, kinds)
        return repeats, marks


def repeated_windows(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(doc_id, low, high): every window start in low..high repeats an earlier one. ``docs`` has unique ids and is read in each round."""
    steps = [_by_name(_Level(docs, length, k, []).shared())]
    found, disputed = _Level(docs, length, k, steps).resolve()
    # windows of one anchor that start within STEP bytes share a core: all but STEP - 1 of their bytes
    steps = [*steps, _by_place(disputed), _split(_blocks, length)]
    steps = [*steps, _by_name(_Level(docs, length, k, steps).shared())]
    found_cores, disputed = _Level(docs, length, k, steps).resolve()
    steps = [*steps, _by_place(disputed), _split(_windows, length)]
    found_windows, _ = _Level(docs, length, k, steps).resolve(further=False)
    return found.unionByName(found_cores).unionByName(found_windows)


def merged(low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs [start, end) covered by windows low..high."""
    by = np.argsort(low, kind="stable")
    start, end = low[by], np.maximum.accumulate(high[by] + length)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.append(new[1:], len(start)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with ``with_text`` the removed runs and the bytes that stay."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = persisted(docs.groupBy("doc_id").agg(F.concat_ws("", F.array_sort(F.collect_set("text"))).alias("text")))
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    found = repeated_windows(docs, length, k)
    runs = persisted(found.groupBy("doc_id").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")))
    discarded(found)
    touched = spark.sparkContext.broadcast(Marks.of(runs.select(F.xxhash64("doc_id").alias("h"))))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            near = Marks.has(touched.value, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            raw = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([shrink.compress(x) if m or with_text else None for x, m in zip(raw, near, strict=True)], pa.binary())],
                names=["doc_id", "n_bytes", "digest", "packed"],
            )

    whole = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(split, "doc_id long, n_bytes long, digest string, packed binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start:long,end:long>>, kept binary" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["low"] is None:
                    kept = unzip.decompress(r["packed"]) if with_text else b""
                    rows.append((r["doc_id"], r["n_bytes"], 0, 0, r["digest"], [], kept))
                    continue
                start, end = merged(np.array(r["low"], np.int64), np.array(r["high"], np.int64), length)
                raw = unzip.decompress(r["packed"])
                kept = b"".join(raw[a:b] for a, b in zip([0, *end], [*start, len(raw)], strict=True))
                rows.append((r["doc_id"], r["n_bytes"], int((end - start).sum()), len(start), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)], kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 7 if with_text else 5]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(columns, kinds, names, strict=False)], names=names)

    out = whole.join(runs, "doc_id", "left").mapInArrow(cut, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63))))
