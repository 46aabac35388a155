"""Best-fit packing of tokenised documents into fixed-length sequences, large items matched first.

Documents become byte-level BPE ids and a closing id 0. One longer than ``capacity`` is cut from its end into whole
sequences, so only its first piece may be shorter. Pieces above a third of the capacity go at most two to a sequence:
the longest left takes the longest other that still fits. Smaller ones then follow in falling length, each into the
tightest gap that holds it.

Only the number of pieces of each length decides the plan, so the plan is made from at most ``capacity`` counts and
handles all equal pieces of equal gaps in one step; its size doesn't depend on the number of documents. Spark then ranks
the pieces of each length over sorted ranges, so that a common length is spread, and looks their places up.

Defined results: null text is empty and gives one piece of length 1; repeated rows are packed as often as they occur;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from heliosite.llm.storage import persisted
from heliosite.operators.ordered import numbered

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Beyond these characters, Unicode versions of the two tokenizer libraries could differ.
_PLAIN = regex.compile(r"[^\x00-ɏ]")


class Encoder:
    """Ids as the ``tokenizers`` file gives them; plain Latin text takes the rank file of the same vocabulary, which is faster."""

    def __init__(self, json_file: str, rank_file: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_file)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if rank_file:
            import base64

            import public_tokenizers
            import tiktoken

            with open(rank_file, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _PLAIN.search(text) and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array([*ids, 0], "<u4")


@functools.cache
def encoder(json_file: str, rank_file: str | None) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(json_file, rank_file)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of n ids: only the first may be shorter than ``capacity`` when there are several."""
    first = n % capacity or capacity
    return [0, *range(min(first, n), n, capacity)]


def pieces(docs: DataFrame, files: tuple[str, str | None] | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; ``ids`` too if asked for."""
    files = files or default_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                at = cuts(len(ids), capacity)
                for piece, (start, end) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                    part = ids[start:end]
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[pd.DataFrame, int]:
    """(slots, number of sequences) for ``counts[length]`` pieces of each length.

    A slot places ``n`` pieces of one length from rank ``first`` on: ``each`` to a sequence from ``sequence`` on, at ``offset``.
    """
    left = counts.astype(np.int64).copy()
    slots, bins = [], 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(length: int, n: int, each: int, sequence: int, offset: int) -> None:
        slots.append((length, int(counts[length] - left[length]), n, each, sequence, offset))
        left[length] -= n

    for a in range(capacity, capacity // 3, -1):
        while left[a]:
            b = min(a, capacity - a)
            while 3 * b > capacity and (not left[b] or (b == a and left[a] < 2)):
                b -= 1
            if 3 * b <= capacity:
                n, gap = int(left[a]), capacity - a
                put(a, n, 1, bins, 0)
            elif b == a:
                n, gap = int(left[a] // 2), capacity - 2 * a
                put(a, 2 * n, 2, bins, 0)
            else:
                n, gap = int(min(left[a], left[b])), capacity - a - b
                put(a, n, 1, bins, 0)
                put(b, n, 1, bins, a)
            gaps[gap].append((bins, n))
            bins += n
    for s in range(capacity // 3, 0, -1):
        gap = s
        while left[s]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                first, n = bins, int(-(-left[s] // (capacity // s)))
                bins += n
                gap = capacity
            else:
                first, n = gaps[gap].pop()
            each = gap // s
            full = int(min(n, left[s] // each))
            if full:
                put(s, full * each, each, first, capacity - gap)
                gaps[gap - each * s].append((first, full))
            rest = n - full
            if rest and left[s]:
                k = int(left[s])
                put(s, k, k, first + full, capacity - gap)
                gaps[gap - k * s].append((first + full, 1))
                full, rest = full + 1, rest - 1
            if rest:
                gaps[gap].append((first + full, rest))
    out = pd.DataFrame(slots, columns=["length", "first", "n", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)
    return out, bins


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (piece rows) with sequence_id and offset. ``cut`` is read twice: give a written table."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most capacity rows
        counts[row["length"]] = row["count"]
    slots, _ = plan(counts, capacity)
    base = np.concatenate([[0], np.cumsum(counts)])[:-1]
    starts = (base[slots.length.to_numpy(int)] + slots["first"].to_numpy(int)) if len(slots) else np.zeros(0, np.int64)
    shipped = cut.sparkSession.sparkContext.broadcast((base, starts, {c: slots[c].to_numpy(np.int64) for c in slots}))
    columns = cut.columns
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    # most pieces of long texts have the same length, so the places of a length are numbered over ranges
    ranked = numbered(cut, ["doc_id", "piece", "start", "ids_crc32"], "length", "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, starts, slot = shipped.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            nth = base[length] + rank
            at = np.searchsorted(starts, nth, "right") - 1
            inside = nth - starts[at]
            each = slot["each"][at]
            places = [pa.array(slot["sequence"][at] + inside // each), pa.array(slot["offset"][at] + inside % each * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *places], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, files: tuple[str, str | None] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return place(persisted(pieces(docs, files, capacity)), capacity)


def packed_sequences(docs: DataFrame, files: tuple[str, str | None] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences themselves. A group holds at most ``capacity`` ids."""
    parts = place(persisted(pieces(docs, files, capacity, with_ids=True)), capacity)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return parts.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
