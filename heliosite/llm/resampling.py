"""Importance resampling towards a target: hashed n-gram gains of whole texts, Gumbel keys, a top share without replacement.

Each task writes its words as numbers, and sorts the word positions as a suffix array, to the depth of the longest
n-gram, as features end there and no sequence crosses a text. Neighbours' common prefixes cut the array into runs: a run
of positions that agree on n words is one n-gram with all its occurrences there. A run is hashed once (the CRC-32 of its UTF-8
bytes, put together from those of its words), and its bucket is scattered back to the occurrences, from which counts and
scores are taken. Both scans are read again from the table; counts by bucket are all that leaves the first one.

Gains are whole numbers per bucket, so a table of ``buckets`` numbers is shipped. Ranks come from numbering over sorted ranges.

Defined results: null, empty and wordless texts have no features and weight 0; rows that share a doc_id are drawn each by
itself, with the same noise; a null doc_id takes its noise from the empty string and stands first in ties; with an empty target
or an empty corpus the gains follow from zero counts; an empty table gives an empty result. Texts of any length are
taken whole, in blocks of ``WORDS`` words. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliosite.operators.ordered import numbered
from heliosite.llm.storage import persisted
from heliosite.llm.texts import LOWER, buffers, prefix_hash, slices, span_hash, trimmed

BUCKETS = 10_000
WORDS = 1 << 17
INK = np.zeros(256, bool)  # digits, letters once lower-cased, and every byte of a character beyond ASCII
INK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)  # linear part of one byte
SHORT = 32


def _zeros_after() -> np.ndarray:
    """[k, b, v]: what byte b of a CRC, having value v, becomes when 2**k zero bytes follow."""
    out = np.zeros((40, 4, 256), np.uint32)
    for b in range(4):
        v = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
        out[0, b] = _CRC[v & 255] ^ (v >> np.uint32(8))
    for k in range(1, 40):
        for b in range(4):
            v = out[k - 1, b]
            out[k, b] = out[k - 1, 0][v & 255] ^ out[k - 1, 1][(v >> 8) & 255] ^ out[k - 1, 2][(v >> 16) & 255] ^ out[k - 1, 3][v >> 24]
    return out


_ZEROS = _zeros_after()


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row from their own CRC-32s and the second one's number of bytes."""
    out = first.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        t, on = _ZEROS[k], (length >> k) & 1 > 0
        v = out[on]
        out[on] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
    return out ^ second


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end]."""
    out, size = np.full(len(start), 0xFFFFFFFF, np.uint32), end - start
    for j in range(min(SHORT, int(size.max(initial=0)))):
        live = np.flatnonzero(size > j)
        c = out[live]
        out[live] = _CRC[(c ^ data[start[live] + j]) & 255] ^ (c >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a lower-cased buffer; a row's end ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = INK[data]
    open_, shut = ink.copy(), ink.copy()
    open_[1:] &= ~ink[:-1]
    shut[:-1] &= ~ink[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    open_[edge] = ink[edge]
    shut[edge - 1] = ink[edge - 1]
    return np.flatnonzero(open_), np.flatnonzero(shut) + 1


def suffix_array(ids: np.ndarray, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions sorted by the ``depth`` ids from there on, words that each shares with the one before it). A row's end sorts before any word."""
    n = len(ids)
    ahead = np.zeros((depth, n), np.int64)
    for k in range(depth):
        same = row[: n - k] == row[k:]
        ahead[k, : n - k] = np.where(same, ids[k:] + 1, 0)
    bits = int(ids.max(initial=0) + 1).bit_length()
    if bits * depth < 64:  # all in one number
        key = ahead[0].copy()
        for k in range(1, depth):
            key = (key << bits) | ahead[k]
        order = np.argsort(key)
    else:
        order = np.lexsort(ahead[::-1])
    lcp = np.zeros(n, np.int64)
    agree = np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        x = ahead[k][order]
        agree &= (x[1:] == x[:-1]) & (x[1:] > 0)
        lcp[1:] += agree
    return order, lcp


def buckets_of(data: np.ndarray, offsets: np.ndarray, depth: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each word, [n - 1, word] bucket of the n words from there on, -1 beyond the row), for blocks of words.

    ``data`` as from ``buffers``. Blocks overlap by depth - 1 words, which only give the ends of n-grams.
    """
    data = LOWER[data]
    start, end = words_of(data, offsets)
    rows = np.searchsorted(offsets, start, "right") - 1
    for first in range(0, len(start), WORDS):
        last = min(first + WORDS, len(start))
        s, e, row = (x[first : min(last + depth - 1, len(start))] for x in (start, end, rows))
        low = s[0]
        part, s, e = data[low : e[-1]], s - low, e - low
        _, one, ids = np.unique(span_hash(prefix_hash(part), s, e), return_index=True, return_inverse=True)
        crc = crcs(part, s[one], e[one])[ids]
        size = e - s
        spaced = crc_joined(np.full(len(one), zlib.crc32(b" "), np.uint32), crc[one], size[one])[ids]  # a space, then the word
        order, lcp = suffix_array(ids, row, depth)
        out = np.full((depth, len(s)), -1, np.int32)
        run, whole = crc, np.ones(len(s), bool)
        for n in range(1, depth + 1):
            if n > 1:
                whole[len(s) - n + 1 :] = False
                whole[: len(s) - n + 1] &= row[: len(s) - n + 1] == row[n - 1 :]
            head = np.flatnonzero(lcp < n)  # each begins a run of equal n-grams
            at = order[head]
            own = np.zeros(len(at), np.uint32)
            live = whole[at]
            own[live] = run[at[live]] if n == 1 else crc_joined(run[at[live]], spaced[at[live] + n - 1], size[at[live] + n - 1] + 1)
            each = np.repeat(own, np.diff(np.append(head, len(order))))
            run = np.zeros(len(s), np.uint32)
            run[order] = each
            out[n - 1][whole] = (run % np.uint32(buckets))[whole]
        yield row[: last - first], out[:, : last - first]


def counts(texts: DataFrame, depth: int = 3, buckets: int = BUCKETS) -> np.ndarray:
    """Features of column ``text`` by bucket, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for first, last in slices(offsets):
                for _, found in buckets_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], depth, buckets):
                    total += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(trimmed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of each bucket's log ratio of smoothed shares, target over source."""
    b, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, depth: int = 3) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of gains over each row's features."""
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.append(table.value, 0)  # -1 finds the last
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            out = np.zeros((3, batch.num_rows), np.int64)
            for first, last in slices(offsets):
                for row, found in buckets_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], depth, len(value) - 1):
                    at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    sums = [np.ones(len(row), np.int64), (found >= 0).sum(0), value[found].sum(0)]
                    out[:, first + row[at]] += np.stack([np.add.reduceat(x, at) for x in sums])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, depth: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): of the rows with ``least_words``, ``percent`` have a rank, the highest scores first."""
    gain = gains(counts(docs, depth, buckets), counts(target, depth, buckets))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))
    scored = persisted(weighted(docs, gain, depth).withColumn("score", F.col("weight") + noise).withColumn("_low", -F.col("score")))
    in_play = scored.where(F.col("n_words") >= least_words)
    most = in_play.count() * percent // 100
    ranked = numbered(in_play, ["_low", "doc_id"]).withColumn("rank", F.when(F.col("idx") < most, F.col("idx") + 1)).drop("idx")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_low")
