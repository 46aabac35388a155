"""Benchmark decontamination over templates, which also catches questions asked again with other numbers or names.

A text becomes tokens: runs of letters and digits, lower-cased; scripts written without spaces give a token for each
character. Numbers, units of measure and names (capitalised inside a
sentence, but not in capitals throughout) become typed placeholders, runs of one type being one. Windows of ``WINDOW`` template tokens of the documents
are hash-joined with those of the benchmark; an item with fewer tokens has one window of all. A window that begins with a
name or unit also stands with that word as a literal, since an item's first word is never a name. A match counts if at least
half its window is literal and its slots have the item's own values, or else are consistent: over all matches of an item
at one place with other values, one value of the item always stands for one value in the document, and different ones
for different ones. Beside that, windows of ``WINDOW`` tokens as they stand, or all of a shorter item's, are joined as
they are, whatever their number and types; they count where the templates of the item and document don't match. A run of slots at the item's edge isn't compared where it goes on in the document past that edge.

The benchmark's window hashes go to the workers as a sorted array if there are at most ``MOST_SHIPPED`` (32 MB), so that
only matching windows are shuffled; beyond that, all windows go through the shuffle join.

Defined results: null or wordless texts and items match nothing; items of fewer than ``LEAST``
template tokens match only word for word, down to a single word, but ``clean`` drops no document for items of fewer than
``LEAST_EVIDENCE`` tokens; repeated
rows of a doc_id give one row for each item, as do repeated items; rows without doc_id or item_id give none; an empty
table on either side gives an empty result; texts of any length are taken whole. Other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliosite.llm.storage import persisted
from heliosite.llm.texts import LOWER, HashIndex, buffers, mix, powers, prefix_hash, slices, span_hash

WINDOW, LEAST, MOST_SHIPPED = 13, 6, 1 << 22
LEAST_EVIDENCE = 5
UNITS = "mm cm m km g kg mg t l ml s min h hr hrs hour hours day days week weeks year years month months second seconds minute minutes meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres percent dollar dollars euro euros cent cents degree degrees mph kmh watt watts volt volts".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))
AS_IT_STANDS = np.uint64(0xA5175A9D5)
_ALNUM, _DIGIT, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(4))
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_UPPER_OR_DIGIT = _UPPER | _DIGIT
# Thai, Lao, Tibetan, Myanmar, Khmer, Tai, kana, bopomofo and Han
UNSPACED = ((0x0E00, 0x10A0), (0x1780, 0x1800), (0x1950, 0x19E0), (0x1A20, 0x1AB0), (0x3005, 0x3130), (0x31A0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA4D0), (0xA9E0, 0xAA00), (0xAA60, 0xAAE0), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x1AFF0, 0x1B170), (0x20000, 0x40000))
_STOP[[ord(c) for c in ".!?:\n"]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data, end = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(w) for w in raw])
    return np.sort(span_hash(prefix_hash(data), end - [len(w) for w in raw], end))


_UNITS = _hash_words(UNITS)


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the accented capitals of Latin-1 (lead byte C3) in lower case."""
    out = LOWER[data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[accented] += 0x20
    return out


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point below 0x40000: 0 separates, 1 is part of a word, 2 is a token alone."""
    out = np.zeros(0x40000, np.uint8)
    out[:0x20000] = [unicodedata.category(chr(c))[0] in "LMN" for c in range(0x20000)]
    out[0x20000:] = 1
    for low, high in UNSPACED:
        out[low:high] *= 2
    return out


def inked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of letters and digits, first bytes of characters that are tokens alone) of UTF-8."""
    ink, alone = _ALNUM[data], np.zeros(len(data), bool)
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        lead = data[at].astype(np.int64)
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for j in (1, 2, 3):
            code = np.where(size > j, (code << 6) | (data[np.minimum(at + j, len(data) - 1)] & 0x3F), code)
        kind = _kinds()[np.minimum(code, 0x3FFFF)]
        for j in range(4):
            ink[np.minimum(at + j, len(data) - 1)[(size > j) & (kind > 0)]] = True
        alone[at[kind == 2]] = True
    return ink, alone


@dataclass
class Tokens:
    """Words of some rows, and their template tokens; firsts: how many come before each row."""

    value: np.ndarray
    firsts: np.ndarray
    soft: np.ndarray
    """names and units"""
    kind: np.ndarray
    run: np.ndarray
    """template token of each word"""
    token: np.ndarray
    folded: np.ndarray
    """a literal is its own value; values of a run are folded into one"""
    length: np.ndarray
    token_firsts: np.ndarray
    start: np.ndarray
    """first word of each template token"""


def _sums(value: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers(len(value) + 1)[0][: len(value)])])


def _spans(sums: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hash of ``size`` values from each start: depends on these values and their number only."""
    return mix((sums[start + size] - sums[start]) * powers(len(sums))[1][start] + np.asarray(size).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def templates(data: np.ndarray, offsets: np.ndarray) -> Tokens | None:
    """Tokens of UTF-8 rows; None where there is no word."""
    n = len(data)
    ink, alone = inked(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    if alone.any():  # such a character begins a token, and so does what follows it
        opened = alone.copy()
        at = np.flatnonzero(alone)
        beyond = at + 2 + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        opened[beyond[beyond < n]] = True
        before &= ~opened
        after[:-1] &= ~opened[1:]
    start, end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    if not len(start):
        return None
    value = span_hash(prefix_hash(lowered(data)), start, end)
    digits, stops, caps = (np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)]) for t in (_DIGIT, _STOP, _UPPER_OR_DIGIT))
    row = np.searchsorted(offsets, start, "right") - 1
    opens = np.concatenate([[True], (row[1:] != row[:-1]) | (stops[start[1:]] > stops[end[:-1]])])
    number = digits[end] > digits[start]
    unit = _UNITS[np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)] == value
    unit[1:] &= number[:-1] & (row[1:] == row[:-1])
    unit[0] = False
    name = _UPPER[data[start]] & (caps[end] - caps[start] < end - start) & ~opens & ~number & ~unit
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    first = np.concatenate([[True], (token[1:] != token[:-1]) | (token[1:] > 3) | (row[1:] != row[:-1])])
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(token)))
    folded = value[at]
    runs = np.flatnonzero(length > 1)
    folded[runs] = _spans(_sums(value), at[runs], length[runs])
    rows = np.arange(len(offsets))
    return Tokens(value, np.searchsorted(row, rows), name | unit, token, np.cumsum(first) - 1, token[at], folded, length, np.searchsorted(row[at], rows), at)


def places(firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of each run of ``size`` tokens."""
    counts = np.maximum(np.diff(firsts) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def literals(t: Tokens, sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place in the row) of each run of ``size`` words as they stand."""
    row, place = places(t.firsts, size)
    return mix(_spans(sums, t.firsts[row] + place, size) ^ AS_IT_STANDS), row, place


def _hash(token: np.ndarray, at: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
    for j in range(size):
        h = (h ^ token[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def windows(token: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place in the row) of each run of ``size`` template tokens with at least half of them literal."""
    row, place = places(firsts, size)
    at = firsts[row] + place
    literal = np.concatenate([[0], np.cumsum(token > 3)])
    fit = 2 * (literal[at + size] - literal[at]) >= size
    at, row, place = at[fit], row[fit], place[fit]
    return mix(_hash(token, at, size, np.full(len(at), size, np.uint64))), row, place


def opened_windows(t: Tokens, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place, first word, words left in its run) of each run of ``size`` template tokens where the first is a name or unit as a literal.

    A rest of that word's run stands as a run of its own. The place is counted back from the tokens after the run.
    """
    word = np.flatnonzero(t.soft)
    run = t.run[word]
    rest = t.start[run] + t.length[run] - word - 1
    row = np.searchsorted(t.firsts, word, "right") - 1
    has = (rest > 0).astype(np.int64)
    more = size - 1 - has
    literal = np.concatenate([[0], np.cumsum(t.token > 3)])
    fit = run + 1 + more <= t.token_firsts[row + 1]
    word, run, rest, row, has, more = (x[fit] for x in (word, run, rest, row, has, more))
    fit = 2 * (1 + literal[run + 1 + more] - literal[run + 1]) >= size
    word, run, rest, row, has = (x[fit] for x in (word, run, rest, row, has))
    h = np.full(len(word), size, np.uint64)
    h = _hash(t.value, word, 1, h)
    for left in (0, 1):
        pick = np.flatnonzero(has == left)
        part = h[pick]
        if left:
            part = _hash(t.kind, word[pick] + 1, 1, part)
        h[pick] = _hash(t.token, run[pick] + 1, size - 1 - left, part)
    return mix(h), row, run - t.token_firsts[row] - has, word, rest


def _rows(texts: DataFrame, ident: str, sizes: list[int], words: list[int], index=None, only_short: bool = False) -> DataFrame:
    """(ident, h, place, kinds, vals, edges, ends): windows of every size of ``texts``, those in ``index`` only if there is one.

    edges: lengths of the runs of the first and the last token; ends: whether these are the row's first and last.
    Windows of ``words`` sizes hold words as they stand, and no lists; their place is counted in words.
    ``only_short``: sizes below ``WINDOW`` only for rows of just that many tokens, as benchmark items have them.
    """
    names = [ident, "h", "place", "kinds", "vals", "edges", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)

            def made(row: np.ndarray, h: np.ndarray, place: np.ndarray, lists: list[np.ndarray]) -> pa.RecordBatch:
                columns = [pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in lists]
                return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32)), *columns], names=names)

            def kept(h: np.ndarray, of: np.ndarray) -> np.ndarray:
                return of & (index.value.find(h) >= 0) if index is not None else of

            for low, high in slices(offsets, 1 << 18):
                a, b = offsets[low], offsets[high]
                t = templates(data[a:b], offsets[low : high + 1] - a)
                if t is None:
                    continue
                firsts = t.token_firsts
                for size in sizes:
                    h, row, place = windows(t.token, firsts, size)
                    keep = kept(h, np.diff(firsts)[row] == size if only_short and size < WINDOW else np.ones(len(h), bool))
                    h, row, place = h[keep], row[keep], place[keep]
                    if len(h):
                        at = (firsts[row] + place)[:, None] + np.arange(size)
                        ends = np.stack([place == 0, at[:, -1] + 1 == firsts[row + 1]], axis=1)
                        yield made(low + row, h, place, [np.minimum(t.token[at], 4).astype(np.int8), t.folded[at].view(np.int64), t.length[at[:, [0, -1]]].astype(np.int32), ends])
                    if only_short and size < WINDOW:
                        continue
                    h, row, place, word, rest = opened_windows(t, size)
                    keep = np.flatnonzero(kept(h, np.ones(len(h), bool)))
                    h, row, place, word, rest = (x[keep] for x in (h, row, place, word, rest))
                    if len(h):
                        at = (firsts[row] + place)[:, None] + np.arange(size)
                        at[:, 0] = t.run[word]
                        kinds, vals, length = np.minimum(t.token[at], 4).astype(np.int8), t.folded[at], t.length[at[:, [0, -1]]].astype(np.int32)
                        kinds[:, 0], vals[:, 0], length[:, 0] = 4, t.value[word], 1
                        split = np.flatnonzero(rest > 0)
                        kinds[split, 1] = t.kind[word[split] + 1]
                        vals[split, 1] = np.where(rest[split] > 1, _spans(_sums(t.value), word[split] + 1, rest[split]), t.value[word[split] + 1])
                        ends = np.stack([np.zeros(len(h), bool), at[:, -1] + 1 == firsts[row + 1]], axis=1)
                        yield made(low + row, h, place, [kinds, vals.view(np.int64), length, ends])
                sums = _sums(t.value)
                for size in words:
                    h, row, place = literals(t, sums, size)
                    keep = kept(h, np.diff(t.firsts)[row] == size if only_short and size < WINDOW else np.ones(len(h), bool))
                    if keep.any():
                        none = [np.zeros((int(keep.sum()), 0), kind) for kind in (np.int8, np.int64, np.int32, bool)]
                        yield made(low + row[keep], h[keep], place[keep], none)

    return texts.select(ident, "text").mapInArrow(run, f"{ident} long, h long, place int, kinds array<tinyint>, vals array<long>, edges array<int>, ends array<boolean>")


def _judge(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One item at one place of one document: its windows with its own values, and those with others if their slots agree over all of these."""
    there, back, own, other, agree = {}, {}, set(), set(), True
    for place, kinds, a, b, item_edges, edges, ends in zip(*(group[c] for c in ("place", "kinds", "item_vals", "vals", "item_edges", "edges", "item_ends")), strict=True):
        low, high = (int(end and here > item) for end, here, item in zip(ends, edges, item_edges, strict=True))
        slots = [(kind, x, y) for kind, x, y in zip(kinds, a, b, strict=True) if kind < 4] if not low and not high else [(kinds[i], a[i], b[i]) for i in range(low, len(kinds) - high) if kinds[i] < 4]
        if all(x == y for _, x, y in slots):
            own.add(place)
            continue
        other.add(place)
        for kind, x, y in slots:
            agree &= there.setdefault((kind, x), y) == y and back.setdefault((kind, y), x) == x
    places = own | other if agree else own
    rows = [(keys[0], keys[1], min(places), len(places), not (agree and other))] if places else []
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "place", "n_windows", "exact"]).astype({"doc_id": "int64", "item_id": "int64", "place": "int32", "n_windows": "int64", "exact": "bool"})


def contaminated(docs: DataFrame, benchmark: DataFrame, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """(doc_id, item_id, n_places, n_windows, exact) of each document and item that share a passage; exact: with the item's own values throughout."""
    spark = docs.sparkSession
    found = _rows(benchmark.where("item_id is not null"), "item_id", list(range(LEAST, WINDOW + 1)), list(range(1, WINDOW + 1)), only_short=True)
    items = persisted(found.withColumn("words", (F.size("kinds") == 0)).withColumnsRenamed({c: f"item_{c}" for c in ("place", "vals", "edges", "ends")}))
    sizes = [r[0] for r in items.where("not words").select(F.size("kinds")).distinct().orderBy(F.size("kinds")).collect()]
    schema = "doc_id long, item_id long, n_places long, n_windows long, exact boolean"
    if items.isEmpty():
        return spark.createDataFrame([], schema)
    names = items.select("h").distinct()
    index = None
    if names.count() <= most_shipped:
        index = spark.sparkContext.broadcast(HashIndex(np.sort(names.toArrow().column("h").to_numpy().view(np.uint64))))
    hits = _rows(docs.where("doc_id is not null"), "doc_id", sizes, _word_sizes(benchmark), index).drop("ends")
    met = persisted(hits.join(items.drop("kinds"), "h").withColumn("shift", F.col("place") - F.col("item_place")))
    judged = met.where("not words").groupBy("doc_id", "item_id", "shift").applyInPandas(_judge, "doc_id long, item_id long, place int, n_windows long, exact boolean")
    alike = judged.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_places"), F.sum("n_windows").alias("n_windows"), F.bool_and("exact").alias("exact"))
    same = met.where("words").groupBy("doc_id", "item_id", "shift").agg(F.count_distinct("place").alias("n")).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_places"), F.sum("n").alias("n_windows"), F.lit(True).alias("exact"))
    both = alike.withColumn("rank", F.lit(0)).unionByName(same.withColumn("rank", F.lit(1))).groupBy("doc_id", "item_id")
    return both.agg(F.min_by(F.struct("n_places", "n_windows", "exact"), "rank").alias("of")).select("doc_id", "item_id", "of.*")


def _word_sizes(benchmark: DataFrame) -> list[int]:
    """Sizes of the windows of words that stand as they are: up to ``WINDOW``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = templates(*buffers(batch.column(0)))
            if t is not None:
                sizes = np.unique(np.minimum(np.diff(t.firsts), WINDOW))
                yield pa.RecordBatch.from_arrays([pa.array(sizes[sizes > 0].astype(np.int32))], names=["size"])

    return sorted(r[0] for r in benchmark.where("item_id is not null").select("text").mapInArrow(run, "size int").distinct().collect())


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens): of the longest text of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = templates(*buffers(batch.column(1)))
            sizes = np.diff(t.firsts) if t is not None else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64))], names=["item_id", "tokens"])

    rows = benchmark.where("item_id is not null").select("item_id", "text").mapInArrow(run, "item_id long, tokens long")
    return rows.groupBy("item_id").agg(F.max("tokens").alias("tokens"))


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_EVIDENCE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; rows without an id are judged under a hash of their text.

    ``least_words``: an item of fewer tokens says too little to drop a document that holds it (``contaminated`` still reports it); 1 lets every item count.
    """
    ident = F.coalesce(docs["doc_id"], F.xxhash64(docs["text"]))
    telling = item_tokens(benchmark).where(F.col("tokens") >= least_words)
    found = contaminated(docs.select(ident.alias("doc_id"), "text"), benchmark).join(telling, "item_id", "left_semi")
    found = found.select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(found, ident == F.col("_hit"), "left_anti").select(*docs.columns)
