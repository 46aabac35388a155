"""Interpolated modified Kneser-Ney word model of order two or three, counted in Spark and scored from memory-mapped hash arrays.

Counting. Tasks send blocks of locally summed (previous word, word) pairs to shards; a block holds each word's hash once
and numbers in its place. A shard is chosen by the previous word, but by the pair for the few most common ones, so
no word makes a shard large. A shard sums its pairs, writes them as a sorted hash array to the shared folder and passes
on, for each word, its count and its number of distinct predecessors, and for each predecessor how many words follow it
once, twice or more. Shards of words sum these and write the vocabulary in the same form. Only totals reach the driver.

Tasks take a segment of shards in turn, one in memory at a time, and put their arrays behind one another, so that a batch looks its keys up in a few large files, however many shards there are.

Scoring. Workers map the files and look whole batches up: P(w | v) = max(c(vw) - D, 0) / c(v) + g(v) P(w), where P(w)
comes from distinct predecessors, discounted likewise and interpolated with 1 / (V + 1).

Order three. Blocks hold triples, dealt by their middle word, so that a shard sees all that follows two words and all that
precedes a pair. Triples keep their counts; a pair counts its distinct predecessors instead, or its occurrences where it
begins a text, which has nothing before it. Two words before a third are kept beside their triples, with their occurrences
and how many words follow them once, twice or more; only for the common middle words, whose triples are dealt by their
last two words, they go to shards of their own to be summed.
P(w | u, v) = max(c(uvw) - D, 0) / c(uv) + g(uv) P(w | v).

Tokens: words of non-white characters with A-Z lower-cased, then one end. Defined results: null text is empty (one token);
with nothing to learn from, every probability is 1 / (V + 1) = 1; repeated rows count and are scored as often as they
occur; a null doc_id counts as empty text for the fold; an empty table gives an empty result; texts of any length are
scored whole. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliosite.llm.storage import delete_folder, discarded, local_file, open_filesystem, persisted, read_file, shared_dir, shuffles_dropped, write_file
from heliosite.llm.texts import HashIndex, buffers, give_back, mix, slices, trimmed, word_hashes

START, END = np.uint64(0x5AFE57A27), np.uint64(0xE0D0FD0C)
NONE = np.uint64(0)
LOW32, LOW48 = np.uint64((1 << 32) - 1), np.uint64((1 << 48) - 1)
FLUSH = 1 << 22
SEGMENT, LEAST_SEGMENTS = 256, 12
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays behind a JSON head, aligned so that they can be mapped."""
    head = json.dumps([[k, v.dtype.str, len(v)] for k, v in arrays.items()]).encode()
    head += b" " * (-(len(head) + 8) % 16)
    return b"".join([len(head).to_bytes(8, "little"), head, *(b for v in arrays.values() for b in (v.tobytes(), b"\0" * (-v.nbytes % 16)))])


def from_bytes(data) -> dict[str, np.ndarray]:
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    at = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, kind, n in json.loads(raw[8:at].tobytes()):
        size = np.dtype(kind).itemsize * n
        out[name] = raw[at : at + size].view(kind)
        at += size + -size % 16
    return out


def pair_key(word: np.ndarray, before48: np.ndarray) -> np.ndarray:
    return mix(word * np.uint64(0x9E3779B97F4A7C15) + before48)


def context_key(before48: np.ndarray, second48: np.ndarray) -> np.ndarray:
    return mix(before48 * np.uint64(0xD6E8FEB86659FD93) + second48)


def triple_key(word: np.ndarray, before48: np.ndarray, second48: np.ndarray) -> np.ndarray:
    return mix(pair_key(word, before48) * np.uint64(0x9E3779B97F4A7C15) + second48)


def low48(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def from_low48(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x) // 6, 8), np.uint8)
    wide[:, :6] = x.reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rising keys, where each stood, where each run of equal ones starts), without the stable sort of ``np.unique``."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key, order, np.flatnonzero(new)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each key rising, where one of its equals stands, the group of every element)."""
    key, order, starts = in_order(key)
    at = np.empty(len(key), np.int64)
    at[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    return key[starts], order[starts], at


def pair_array(key: np.ndarray, n: np.ndarray, **more: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hash array: leading bits select a bucket, 32 more are stored, counts in a byte with the larger ones apart."""
    bits = max(0, int(len(key)).bit_length() - 2)
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    columns = {}
    for name, x in {"n": n, **more}.items():
        big = np.flatnonzero(x >= 255)
        columns |= {name: np.minimum(x, 255).astype(np.uint8), "big" if name == "n" else f"{name}_big": big.astype(np.uint32), f"{'big' if name == 'n' else f'{name}_big'}_n": x[big].astype(np.int64)}
    return {
        "directory": np.append(np.searchsorted(key, edges), len(key)).astype(np.uint32), "rest": ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32),
        **columns,
    }


class SegmentWriter:
    """Puts the arrays of consecutive shards behind one another, a file for each column, and says where each shard's begin. One shard is held at a time."""

    def __init__(self, name: str):
        self.name, self.outs, self.kinds, self.starts, self.rows, self.places = name, {}, {}, [], 0, 0
        self.files, self.at = open_filesystem(name)
        self.mine = uuid.uuid4().hex  # another attempt of the task writes files of its own
        self.files.create_dir(os.path.dirname(self.at), recursive=True)

    def add(self, place: int, arrays: dict[str, np.ndarray]) -> None:
        """``place``: the shard's number in the segment, rising; those left out have nothing."""
        self.starts += [(-1, 0)] * (place - len(self.starts))
        self.starts.append((self.places, len(arrays["directory"]).bit_length() - 1 if len(arrays["directory"]) > 2 else 0))
        for column, x in arrays.items():
            if column == "directory" or column.endswith("big"):
                x = x + np.uint32(self.rows)
            if column not in self.outs:
                self.outs[column], self.kinds[column] = self.files.open_output_stream(f"{self.at}.{column}.{self.mine}"), x.dtype.str
            self.outs[column].write(x.tobytes())
        self.rows, self.places = self.rows + len(arrays["rest"]), self.places + len(arrays["directory"])

    def close(self) -> None:
        for column, out in self.outs.items():
            out.close()
            self.files.move(f"{self.at}.{column}.{self.mine}", f"{self.at}.{column}")
        write_file(self.name, json.dumps({"starts": self.starts, "columns": self.kinds}).encode())


class Segment:
    """The sorted hash arrays of up to ``SEGMENT`` shards, mapped, looked up in one go."""

    def __init__(self, name: str, shards: int):
        try:
            head = json.loads(read_file(name))
        except FileNotFoundError:  # nothing fell to its shards
            head = {"starts": [], "columns": {}}
        starts = [*head["starts"], *[(-1, 0)] * (shards - len(head["starts"]))]
        self.first, self.bits = (np.array(x, kind) for x, kind in zip(zip(*starts, strict=True), (np.int64, np.uint64), strict=True))
        self.shift = np.uint64(64) - self.bits  # numpy shifts by 64 to 0
        self.columns = {}
        for column, kind in head["columns"].items():
            path = local_file(f"{name}.{column}")
            self.columns[column] = np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.zeros(0, kind)

    def look_up(self, shard: np.ndarray, key: np.ndarray, names: list[str]) -> np.ndarray:
        """``names`` of each key of its shard, zeros where it is absent."""
        c = self.columns
        out = np.zeros((len(names), len(key)), np.int64)
        if "rest" not in c:
            return out
        first = self.first[shard]
        bucket = (key >> self.shift[shard]).view(np.int64) + first
        at, stop = c["directory"][bucket].astype(np.int64), c["directory"][bucket + 1].astype(np.int64)
        live = np.flatnonzero((first >= 0) & (at < stop))
        at, stop, rest = at[live], stop[live], (key[live] << self.bits[shard[live]] >> np.uint64(32)).astype(np.uint32)
        have = c["rest"][at]
        hit = have == rest
        go = np.flatnonzero((have < rest) & (at + 1 < stop))
        while len(go):
            at[go] += 1
            next_at, sought = at[go], rest[go]
            have = c["rest"][next_at]
            hit[go] = have == sought
            go = go[(have < sought) & (next_at + 1 < stop[go])]
        at, live = at[hit], live[hit]
        for i, name in enumerate(names):
            n = c[name][at].astype(np.int64)
            big = np.flatnonzero(n == 255)
            if len(big):
                of = "big" if name == "n" else f"{name}_big"
                n[big] = c[f"{of}_n"][np.searchsorted(c[of], at[big])]
            out[i, live] = n
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before it, tokens before each row): every row's words, then END; the first follows START."""
    words, firsts = word_hashes(data, offsets)
    ends = firsts[1:] + np.arange(len(firsts) - 1)
    token = np.empty(len(words) + len(firsts) - 1, np.uint64)
    is_word = np.ones(len(token), bool)
    is_word[ends] = False
    token[is_word], token[ends] = words, END
    first = np.concatenate([[0], ends + 1])
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = START
    return token, before, first


def second_before(before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token two before each; NONE for a row's first."""
    out = np.empty_like(before)
    out[1:] = before[:-1]
    out[first[:-1]] = NONE
    return out


def is_in(word: np.ndarray, common: np.ndarray) -> np.ndarray:
    return common[np.minimum(np.searchsorted(common, word), len(common) - 1)] == word if len(common) else np.zeros(len(word), bool)


def shard_of(word: np.ndarray, key: np.ndarray, shards: int, common: np.ndarray) -> np.ndarray:
    """By the word, or by the key where the word is common."""
    return by_low_bits(np.where(is_in(word, common), key, word), shards)


def by_low_bits(x: np.ndarray, shards: int) -> np.ndarray:
    """A shard from the low 32 bits: the leading ones choose buckets, of which a shard dealt by them too would fill but a few."""
    return ((x & LOW32) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def discounts(counts_of_counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    n = [counts_of_counts.get(i, 0) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    return [min(float(i), max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.0 for i in (1, 2, 3)]


@dataclass
class Model:
    folder: str
    shards: int
    word_shards: int
    common: np.ndarray
    tokens: int
    words: int
    pairs: int
    documents: int
    pair_discounts: list[float]
    word_discounts: list[float]
    word_classes: list[int]
    start_classes: list[int]
    width: int
    order: int = 2
    triple_discounts: list[float] | None = None


def fit(train: DataFrame, shard_bytes: int = 8 << 20, sample_bytes: int = 16 << 20, order: int = 2, rounds: int = 2) -> Model:
    """Count every token of ``train`` (a column ``text``). The sample only finds the common words to spread.

    ``rounds``: the text is read so many times, each for its own part of the shards, so that only that part of the blocks is on disk at once.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = train.sparkSession
    folder = shared_dir(spark)
    texts = train.select("text")
    size, documents = (x or 0 for x in texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first())
    shards = max(8, -(-size // shard_bytes))
    word_shards = max(8, -(-size // (4 * shard_bytes)))
    width = max(1, min(SEGMENT, shards // LEAST_SEGMENTS))  # shards of a segment
    segments = -(-shards // width)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = np.unique(tokens(*buffers(batch.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < min(1.0, sample_bytes / max(size, 1)) * (1 << 20))
    often = sample.mapInArrow(seen, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word with a quarter of an average shard (about six bytes a word) is spread; so is the start, which is in every text
    names = [r["word"] for r in often.where(F.col("n") > max(100.0, total / (24 * shards))).orderBy(F.desc("n"), "word").limit(1 << 16).collect()]
    common = np.unique(np.append(np.array(names, np.int64).view(np.uint64), START))
    shared = spark.sparkContext.broadcast(common)

    def blocks_of(turn: int):
        """Blocks for the shards of one round; a task holds only what belongs to it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shrink = zstandard.ZstdCompressor(level=1)
            held: list[tuple[np.ndarray, ...]] = []
            count = 0

            def flushed() -> pa.RecordBatch:
                shard, key, word, before, *second = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()  # else all is held twice
                key, order, starts = in_order(mix(key * np.uint64(0x9E3779B97F4A7C15) + second[0]) if second else key)
                first, n = order[starts], np.diff(np.append(starts, len(key)))
                del key, order, starts
                shard, word, before, second = shard[first], word[first], before[first], [x[first] for x in second]
                by = np.argsort(shard.astype(np.uint64) << np.uint64(40) | before >> np.uint64(24))
                word, before, second, n, shard = word[by], before[by], [x[by] for x in second], n[by], shard[by]
                edges = np.flatnonzero(np.diff(shard)) + 1
                rows = []
                for a, b in zip([0, *edges], [*edges, len(word)], strict=True):
                    starts = np.flatnonzero(np.concatenate([[True], before[a + 1 : b] != before[a : b - 1]]))
                    each, at = np.unique(np.concatenate([before[a:b][starts], word[a:b], *(x[a:b] for x in second)]), return_inverse=True)
                    at = at.astype(np.uint16 if len(each) <= 1 << 16 else np.uint32)
                    k, m = len(starts), b - a
                    part = {"each": each, "before": at[:k], "runs": np.diff(np.append(starts, m)).astype(np.uint32), "word": at[k : k + m], "second": at[k + m :], "n": n[a:b].astype(np.uint32)}
                    rows.append((int(shard[a]), shrink.compress(to_bytes(part))))
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])

            for batch in batches:
                data, offsets = buffers(batch.column(0))
                for first, last in slices(offsets, 1 << 18):
                    low, high = offsets[first], offsets[last]
                    word, before, at = tokens(data[low:high], offsets[first : last + 1] - low)
                    key = pair_key(word, before & LOW48)
                    shard = shard_of(before, key, shards, shared.value)
                    own = np.flatnonzero(shard // width % rounds == turn)
                    if len(own):
                        held.append(tuple(x[own] for x in (shard, key, word, before, second_before(before, at))[: order + 2]))
                        count += len(own)
                    if count >= FLUSH // (order - 1):
                        yield flushed()
                        held, count = [], 0
                        give_back()
            if count:
                yield flushed()

        return trimmed(run)

    def one_shard(number: int, blocks: list[bytes], store) -> list[tuple[int, bytes]]:
        """Sum a shard's blocks, ``store`` its arrays and pass on what others sum up."""
        unzip, shrink = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        parts = [from_bytes(unzip.decompress(b)) for b in blocks]
        word, n = (np.concatenate(x) for x in ([p["each"][p["word"]] for p in parts], [p["n"] for p in parts]))
        middle = np.concatenate([np.repeat(p["each"][p["before"]], p["runs"]) for p in parts])
        before = middle & LOW48
        contexts: dict[str, np.ndarray] = {}
        totals: dict[str, int] = {}
        if order == 3:
            second = np.concatenate([p["each"][p["second"]] for p in parts]) & LOW48
            del parts
            key, first, at = grouped(triple_key(word, before, second))
            n = np.bincount(at, n).astype(np.int64)
            word, before, second, middle = word[first], before[first], second[first], middle[first]
            whole = second != NONE
            store("triples", pair_array(key[whole], n[whole]))
            totals |= {f"t{i}": (n[whole] == i).sum() for i in (1, 2, 3, 4)}
            spread = is_in(middle, shared.value)
            for hot in (False, True):
                own = np.flatnonzero(whole & (spread == hot))
                m = n[own]
                context, by = np.unique(context_key(before[own], second[own]), return_inverse=True)
                columns = {"n": np.bincount(by, m, len(context)), **{f"f{i}": np.bincount(by, (m == i) if i < 3 else (m >= 3), len(context)) for i in (1, 2, 3)}}
                if hot:
                    contexts = {"context2": context, **{c: v.astype(np.uint32) for c, v in columns.items()}}
                else:
                    store("contexts", pair_array(context, **{c: v.astype(np.int64) for c, v in columns.items()}))
            del second, at, by, own, middle
        key, first, at = grouped(pair_key(word, before))
        occurs = np.bincount(at, n).astype(np.int64)
        n = np.where(before[first] == (START & LOW48), occurs, np.bincount(at)) if order == 3 else occurs
        word, before = word[first], before[first]
        store("pairs", pair_array(key, n))
        each, at = np.unique(word, return_inverse=True)
        rows = []
        totals |= {"n": occurs.sum(), "pairs": len(n), **{f"p{i}": (n == i).sum() for i in (1, 2, 3, 4)}}
        totals |= {f"s{i}": ((before == (START & LOW48)) & ((n == i) if i < 3 else (n >= 3))).sum() for i in (1, 2, 3)}
        rows.append((-1, json.dumps({k: int(v) for k, v in totals.items()}).encode()))
        context, by = np.unique(before, return_inverse=True)
        follow = np.stack([np.bincount(by, m, len(context)) for m in ((n == 1), (n == 2), (n >= 3))]).astype(np.uint32)
        columns = {"word": each, "n": np.bincount(at, occurs).astype(np.uint64), "kinds": np.bincount(at).astype(np.uint32)}
        for names, part_of in ((columns, word_shard(columns["word"], word_shards)), ({"context": context, "f1": follow[0], "f2": follow[1], "f3": follow[2], "after": np.bincount(by, n, len(context)).astype(np.uint64)}, word_shard(context, word_shards)), *([(contexts, -2 - by_low_bits(contexts["context2"], shards))] if len(contexts.get("context2", ())) else [])):
            in_turn = np.argsort(part_of, kind="stable")
            present, edges = np.unique(part_of[in_turn], return_index=True)
            edges = np.append(edges, len(part_of))
            for i, s in enumerate(present.tolist()):
                pick = in_turn[edges[i] : edges[i + 1]]
                small = {k: low48(v[pick]) if k == "context" else v[pick] for k, v in names.items()}
                rows.append((s, shrink.compress(to_bytes(small))))
        return rows

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shard after shard of sorted blocks; the arrays of a segment's shards go behind one another."""
        writers: dict[str, tuple[int, SegmentWriter]] = {}
        number, blocks = -1, []

        def store(kind: str, arrays: dict[str, np.ndarray]) -> None:
            segment = number // width
            if kind not in writers or writers[kind][0] != segment:
                if kind in writers:
                    writers[kind][1].close()
                writers[kind] = (segment, SegmentWriter(f"{folder}/{kind}-{segment:07d}"))
            writers[kind][1].add(number % width, arrays)

        def made() -> pa.RecordBatch:
            rows = one_shard(number, blocks, store)
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])

        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != number:
                    if blocks:
                        yield made()
                    number, blocks = shard, []
                blocks.append(block.as_buffer().to_pybytes())
        if blocks:
            yield made()
        for _, writer in writers.values():
            writer.close()


    # written, so that the blocks' shuffle files go before the next shuffle
    def counted(turn: int) -> DataFrame:
        dealt = texts.mapInArrow(blocks_of(turn), "shard int, block binary").repartitionById(-(-segments // rounds), F.floor(F.col("shard") / (width * rounds)).cast("int"))  # a segment, a task
        held = spark.conf.get(BATCH_BYTES)
        spark.conf.set(BATCH_BYTES, str(8 << 20))  # blocks come a few at a time, not all of a segment's
        try:
            return persisted(dealt.sortWithinPartitions("shard").mapInArrow(trimmed(summed), "shard int, block binary"))
        finally:
            spark.conf.set(BATCH_BYTES, held)

    parts = [counted(turn) for turn in range(rounds)]
    passed = reduce(DataFrame.unionByName, parts)

    def words(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if keys[0] == -1:
            tops = pd.DataFrame([json.loads(b) for b in group["block"]]).sum()
            return pd.DataFrame({"totals": [json.dumps({k: int(v) for k, v in tops.items()})]})
        unzip = zstandard.ZstdDecompressor()
        parts = [from_bytes(unzip.decompress(b)) for b in group["block"]]
        if keys[0] < -1:
            key, at = np.unique(np.concatenate([p["context2"] for p in parts]), return_inverse=True)
            columns = {c: np.bincount(at, np.concatenate([p[c] for p in parts])).astype(np.int64) for c in ("n", "f1", "f2", "f3")}
            write_file(f"{folder}/parts-spread/{-2 - int(keys[0]):07d}", to_bytes(pair_array(key, **columns)))
            return pd.DataFrame({"totals": ["{}"]})
        own, other = [p for p in parts if "word" in p], [p for p in parts if "context" in p]
        word, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p["word"] for p in own)]), return_inverse=True)
        n, kinds = (np.bincount(at, np.concatenate([[], *(p[c] for p in own)]), len(word)).astype(np.int64) for c in ("n", "kinds"))
        context = from_low48(np.concatenate([np.zeros(0, np.uint8), *(p["context"] for p in other)]))
        by = np.argsort(word & LOW48)
        low = (word & LOW48)[by]
        row = np.minimum(np.searchsorted(low, context), max(0, len(low) - 1))
        known = (low[row] == context) if len(low) else np.zeros(len(context), bool)
        follow = [np.bincount(by[row[known]], np.concatenate([[], *(p[c] for p in other)])[known], len(word)).astype(np.int64) for c in ("f1", "f2", "f3", "after")]
        after = follow.pop()
        write_file(f"{folder}/words-{int(keys[0]):07d}", to_bytes({"word": word, "n": n, "kinds": kinds.astype(np.uint32), "after": after, **{f"f{i + 1}": f.astype(np.uint32) for i, f in enumerate(follow)}}))
        return pd.DataFrame({"totals": [json.dumps({"words": len(word), "k3plus": int((kinds >= 3).sum()), **{f"k{i}": int((kinds == i).sum()) for i in (1, 2, 3, 4)}})]})

    top: dict[str, int] = {}
    made = passed.repartition(word_shards, "shard").groupBy("shard").applyInPandas(words, "totals string")
    # a few counters from each shard of words, summed by Spark
    names = ["n", "pairs", "p1", "p2", "p3", "p4", "s1", "s2", "s3", "words", "k1", "k2", "k3", "k4", "k3plus", "t1", "t2", "t3", "t4"]
    with shuffles_dropped(spark):
        top = made.select([F.get_json_object("totals", f"$.{c}").cast("long").alias(c) for c in names]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first().asDict()
    discarded(*parts)
    if order == 3:

        def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The spread contexts, summed shard by shard, as segments."""
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    writer = SegmentWriter(f"{folder}/spread-{i:07d}")
                    for shard in range(i * width, min(shards, (i + 1) * width)):
                        with suppress(FileNotFoundError):  # a shard that got nothing
                            writer.add(shard % width, from_bytes(read_file(f"{folder}/parts-spread/{shard:07d}")))
                    writer.close()
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64())], names=["id"])

        spark.range(0, segments, 1, segments).mapInArrow(trimmed(joining), "id long").count()
        delete_folder(spark, f"{folder}/parts-spread")
    return Model(
        folder, shards, word_shards, common, top["n"], top["words"], top["pairs"], documents,
        discounts({i: top[f"p{i}"] for i in (1, 2, 3, 4)}), discounts({i: top[f"k{i}"] for i in (1, 2, 3, 4)}),
        [top["k1"], top["k2"], top["k3plus"]], [top["s1"], top["s2"], top["s3"]], width, order, discounts({i: top[f"t{i}"] for i in (1, 2, 3, 4)}),
    )


def word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    """By the low 48 bits, which contexts keep."""
    return ((word & LOW48) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % shards


class Reader:
    """A worker's view of the files, mapped on first use."""

    def __init__(self, model: Model):
        self.model, self.stores, self.words = model, {}, {}

    def _map(self, name: str) -> dict[str, np.ndarray]:
        try:
            return from_bytes(np.asarray(np.memmap(local_file(f"{self.model.folder}/{name}"), np.uint8, "r")))
        except FileNotFoundError:  # a shard that got nothing
            return {}

    def look_up(self, kind: str, shard: np.ndarray, key: np.ndarray, names: list[str]) -> np.ndarray:
        """``names`` of each key, whose shard is given; a call for each segment of shards, in the order of its files."""
        out = np.empty((len(names), len(key)), np.int64)
        width = self.model.width
        order = np.argsort(shard.astype(np.uint64) << np.uint64(32) | key >> np.uint64(32))
        shard, key = shard[order], key[order]
        segment = shard // width
        edges = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b:
                i = int(segment[a])
                if (kind, i) not in self.stores:
                    self.stores[kind, i] = Segment(f"{self.model.folder}/{kind}-{i:07d}", width)
                out[:, order[a:b]] = self.stores[kind, i].look_up(shard[a:b] - i * width, key[a:b], names)
        return out

    def word_store(self, s: int) -> tuple[HashIndex, dict[str, np.ndarray]] | None:
        if s not in self.words:
            arrays = self._map(f"words-{s:07d}")
            self.words[s] = (HashIndex(arrays["word"]), arrays) if arrays else None
        return self.words[s]

    def look_up_words(self, word: np.ndarray) -> dict[str, np.ndarray]:
        out = {c: np.zeros(len(word), np.int64) for c in ("n", "kinds", "f1", "f2", "f3", "after")}
        for s, at in _by_shard(word_shard(word, self.model.word_shards)):
            if (store := self.word_store(s)) is not None:
                row = store[0].find(word[at])
                hit = row >= 0
                for c, v in out.items():
                    v[at[hit]] = store[1][c][row[hit]]
        return out

    def scores(self, token: np.ndarray, before: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of each token in training, log10 of its base probability, log10 of the model's)."""
        m = self.model
        each, at = np.unique(np.append(token, START), return_inverse=True)
        found = self.look_up_words(each)
        w = {c: found[c][at[:-1]] for c in ("n", "kinds")}
        v = {"n": found["after"], **{c: found[c] for c in ("f1", "f2", "f3")}}  # occurrences at order two, as no text ends but in END
        start = at[-1]
        v["n"][start] = m.documents
        for i in (1, 2, 3):
            v[f"f{i}"][start] = m.start_classes[i - 1]
        at = np.where(before == START, start, np.append(start, at[:-2]))  # what stands before is the token before, or the start
        v = {c: x[at] for c, x in v.items()}
        base = np.log10((w["n"] + 1) / (m.tokens + m.words + 1))
        d = np.array([0.0, *m.word_discounts])
        kept = np.maximum(w["kinds"] - d[np.minimum(w["kinds"], 3)], 0)
        lower = (kept + (np.dot(m.word_discounts, m.word_classes)) / (m.words + 1)) / m.pairs if m.pairs else np.full(len(token), 1 / (m.words + 1))
        low = before & LOW48
        key = pair_key(token, low)
        n = np.zeros(len(token), np.int64)
        known = np.flatnonzero((w["n"] > 0) & (v["n"] > 0))
        n[known] = self.look_up("pairs", shard_of(before[known], key[known], m.shards, m.common), key[known], ["n"])[0]
        d = np.array([0.0, *m.pair_discounts])
        total = np.maximum(v["n"], 1)
        left = sum(m.pair_discounts[i] * v[f"f{i + 1}"] for i in range(3)) / total
        p = np.where(v["n"] > 0, np.maximum(n - d[np.minimum(n, 3)], 0) / total + np.where((v["f1"] + v["f2"] + v["f3"]) > 0, left, 1.0) * lower, lower)
        if m.order == 3:
            p = self.with_second(token, before, second & LOW48, known[n[known] > 0], p)
        return w["n"], base, np.log10(np.maximum(p, 1e-300))


    def with_second(self, token: np.ndarray, before: np.ndarray, second: np.ndarray, pairs: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Order three above ``p`` of order two. ``pairs``: where the last two tokens are a pair of training."""
        m, low = self.model, before & LOW48
        whole = np.flatnonzero(second != NONE)
        context, first, at = grouped(context_key(low[whole], second[whole]))
        middle = before[whole][first]
        found = np.zeros((4, len(context)), np.int64)
        spread = is_in(middle, m.common)
        for kind, own, shard in (("contexts", np.flatnonzero(~spread), shard_of(middle, context, m.shards, m.common)), ("spread", np.flatnonzero(spread), by_low_bits(context, m.shards))):
            found[:, own] = self.look_up(kind, shard[own], context[own], ["n", "f1", "f2", "f3"])
        after = np.zeros((4, len(token)), np.int64)
        after[:, whole] = found[:, at]
        pairs = pairs[after[0, pairs] > 0]
        n = np.zeros(len(token), np.int64)
        key = triple_key(token[pairs], low[pairs], second[pairs])
        n[pairs] = self.look_up("triples", shard_of(before[pairs], pair_key(token[pairs], low[pairs]), m.shards, m.common), key, ["n"])[0]
        d, total = np.array([0.0, *m.triple_discounts]), np.maximum(after[0], 1)
        left = sum(m.triple_discounts[i] * after[i + 1] for i in range(3)) / total
        return np.where(after[0] > 0, np.maximum(n - d[np.minimum(n, 3)], 0) / total + left * p, p)


_readers: dict[str, Reader] = {}


def reader_of(model: Model) -> Reader:
    """The worker process's reader of a model, which serves many tasks."""
    if model.folder not in _readers:
        _readers.clear()
        _readers[model.folder] = Reader(model)
    return _readers[model.folder]


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")  # short ones are sorted by radix
    edges = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, edges):
        if len(at):
            yield int(shard[at[0]]), at


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of whole texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(shipped.value)
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for first, last in slices(offsets, 1 << 21):
                low, high = offsets[first], offsets[last]
                token, before, at = tokens(data[low:high], offsets[first : last + 1] - low)
                n, base, model_score = reader.scores(token, before, second_before(before, at))
                count = np.diff(at)
                sums = [np.add.reduceat(x, at[:-1]) for x in ((n > 0).astype(np.int64), base, model_score)]
                columns = [batch.column(0)[first:last], batch.column(1)[first:last], pa.array(count.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(last - first, reader.model.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10.0 ** np.minimum(-sums[2] / count, 300))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(trimmed(run), schema)


def fit_and_score(docs: DataFrame, held_out: Column, shard_bytes: int = 8 << 20, order: int = 2) -> DataFrame:
    """Learn from the rows where ``held_out`` is false, score all."""
    folded = docs.select("doc_id", held_out.alias("held_out"), "text")
    return score(folded, fit(folded.where(~F.col("held_out")), shard_bytes, order=order))
