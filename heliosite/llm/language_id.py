"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``order`` with symbol counts. A symbol unseen in a context costs that
context's escape (method C: d / (n + d)) and is coded in the next shorter one, at last uniformly over 256 bytes. The
statistics are frozen after training, so the cost of a byte depends on the last ``order`` bytes alone: every gram that
occurs in training has its exact code length for all languages in one table row, and other grams add up escapes on the
way to a shorter gram that has one. The language with the shortest code for the whole text wins.

Defined results: null text or text without a letter gives ``und`` with score 0; with no training rows every text gives
``und``; ties go to the language that sorts first. Repeated rows are each predicted; an empty table gives an empty result;
texts of any length are read whole, in blocks; other columns are carried along, those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from heliosite.llm.texts import HashIndex, mix, trimmed

UNDETERMINED = "und"
BLOCK, AHEAD = 4096, 32
LETTER = regex.compile(r"\p{L}")


def prepared(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, each text after ``order`` line ends; starts and ends of the texts."""
    pad = b"\n" * order
    raw = [(t or "").lower().encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes + order) - sizes
    return np.frombuffer(pad + pad.join(raw), np.uint8), starts, starts + sizes


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each position from ``order`` on, the byte (lowest) and the ``order`` bytes before it, as one integer."""
    n = len(data) - order
    key = np.zeros(max(0, n), np.uint64)
    for k in range(order + 1):
        key = (key << np.uint64(8)) | data[k : k + len(key)].astype(np.uint64)
    return key


def shorter(key: np.ndarray, order: int) -> np.ndarray:
    return key & np.uint64((1 << (8 * (order + 1))) - 1)


@dataclass
class ContextTrees:
    """Frozen statistics of all languages; ``codes`` and ``escapes`` hold bits, one column a language."""

    languages: list[str]
    order: int
    dense: np.ndarray
    indexes: list[HashIndex]
    codes: list[np.ndarray]
    contexts: list[HashIndex]
    escapes: list[np.ndarray]

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram under each language."""
        row = self.indexes[self.order].find(mix(key))
        out = self.codes[self.order].take(row, axis=0, mode="clip")
        left = np.flatnonzero(row < 0)
        out[left] = 0
        for k in range(self.order, 1, -1):
            if not len(left):
                return out
            gram = shorter(key[left], k)
            if k < self.order:
                row = self.indexes[k].find(mix(gram))
                hit = row >= 0
                out[left[hit]] += self.codes[k][row[hit]]
                left, gram = left[~hit], gram[~hit]
            row = self.contexts[k].find(mix(gram >> np.uint64(8)))
            hit = row >= 0
            out[left[hit]] += self.escapes[k][row[hit]]
        out[left] += self.dense[shorter(key[left], 1).astype(np.int64)]
        return out


def blocks(labelled: DataFrame) -> DataFrame:
    """(lang, before, block, u): the texts in blocks of ``BLOCK`` bytes with up to ``AHEAD`` bytes before each; u: a hash of these, from 0 to 2**30 - 1."""
    raw = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / BLOCK).cast("int"))

    def cut(i):
        ahead = F.when(i == 0, F.lit(0)).otherwise(F.lit(AHEAD))
        return F.struct(F.substring(raw, i * BLOCK + 1 - ahead, ahead).alias("before"), F.substring(raw, i * BLOCK + 1, F.lit(BLOCK)).alias("block"))

    parts = labelled.where(F.octet_length("text") > 0).select("lang", F.explode(F.transform(starts, cut)).alias("of")).select("lang", "of.*")
    return parts.withColumn("u", F.pmod(F.xxhash64("lang", "before", "block"), F.lit(1 << 30)))


def count_grams(labelled: DataFrame, order: int) -> DataFrame:
    """(lang, k, gram, n) of a table of (lang, before, block): counted per batch in numpy, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            ahead, texts = ([x.decode(errors="ignore") for x in batch.column(c).to_pylist()] for c in ("before", "block"))
            for lang in sorted(set(langs)):
                own = [i for i, x in enumerate(langs) if x == lang]
                data, starts, ends = prepared([ahead[i] + texts[i] for i in own], order)
                starts = starts + [len(ahead[i].lower().encode()) for i in own]
                inside = np.zeros(len(data) + 1, np.int32)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                key = grams(data, order)[np.cumsum(inside)[order:-1] > 0]
                for k in range(order + 1):
                    gram, n = np.unique(shorter(key, k), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "gram", "n"])

    return labelled.select("lang", "before", "block").mapInArrow(run, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, order: int = 3, bytes_per_language: int = 1 << 20) -> ContextTrees:
    """Train on (lang, text) rows. About ``bytes_per_language`` of each language's distinct blocks of text, chosen by a hash of the block, bound the sample and so the model.

    Copies count once. Each language gives its block of the smallest hash at least; on average, 256 of them or all.
    """
    parts = blocks(labelled.where("lang is not null and text is not null").select("lang", "text"))
    each = parts.groupBy("lang", F.xxhash64("lang", "before", "block").alias("h")).agg(F.first("u").alias("u"), F.first(F.octet_length("block")).alias("n"))
    size = {r["lang"]: (r["n"], r["u"]) for r in each.groupBy("lang").agg(F.sum("n").alias("n"), F.min("u").alias("u")).collect()}
    languages = sorted(size)
    if not languages:
        return ContextTrees([], order, np.zeros((0, 0)), [], [], [], [])
    below_u = {k: max(int((1 << 30) * min(1.0, bytes_per_language / n)), u + 1) for k, (n, u) in size.items()}
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, below_u[k])]), F.col("lang"))
    sample = parts.where(F.col("u") < share).select("lang", "before", "block").distinct()
    rows = count_grams(sample, order).toPandas()
    column = {lang: i for i, lang in enumerate(languages)}
    L = len(languages)
    indexes, codes, contexts, escapes = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
    below = np.full((1, L), 8.0)
    below_keys = np.zeros(1, np.uint64)
    dense = np.zeros((65536, L), np.float32)
    for k in range(order + 1):
        part = rows[rows.k == k]
        keys, at = np.unique(part.gram.to_numpy().view(np.uint64), return_inverse=True)
        count = np.zeros((len(keys), L))
        np.add.at(count, (at, part.lang.map(column).to_numpy(int)), part.n.to_numpy())
        context, first = np.unique(keys >> np.uint64(8), return_index=True)
        n, d = np.add.reduceat(count, first), np.add.reduceat((count > 0).astype(float), first)
        escape = np.where(n > 0, np.log2(np.maximum(n + d, 1)) - np.log2(np.maximum(d, 1)), 0.0)
        of = np.searchsorted(context, keys >> np.uint64(8))
        rest = below[np.zeros(len(keys), int) if k == 0 else np.searchsorted(below_keys, shorter(keys, k - 1))]
        code = np.where(count > 0, np.log2(np.maximum(n + d, 1))[of] - np.log2(np.maximum(count, 1)), escape[of] + rest)
        if k == 0:
            flat = np.tile(escape[0] + 8.0, (256, 1))
            flat[keys.astype(int)] = code
        elif k == 1:
            dense = np.tile(flat, (256, 1)).reshape(256, 256, L)
            dense[context.astype(int)] += escape[:, None, :]
            dense = dense.reshape(65536, L)
            dense[keys.astype(int)] = code
        else:
            for store, values, names in ((indexes, code, keys), (contexts, escape, context)):
                hashed = mix(names)
                by = np.argsort(hashed)
                store[k] = HashIndex(hashed[by])
                (codes if store is indexes else escapes)[k] = values[by].astype(np.float32)
        below, below_keys = code, keys
    return ContextTrees(languages, order, dense.astype(np.float32), indexes, codes, contexts, escapes)


def code_lengths(model: ContextTrees, texts: list[str | None], most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each whole text under each language, and its number of bytes. Long texts go through in blocks."""
    total, size = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        upto, room = at + 1, most - len(texts[at] or "")
        while upto < len(texts) and room > len(texts[upto] or ""):
            room -= len(texts[upto] or "")
            upto += 1
        data, starts, ends = prepared(texts[at:upto], model.order)
        sums = np.zeros(len(model.languages))
        marks = np.empty((2, upto - at, len(model.languages)))
        edges = np.stack([starts, ends]) - model.order
        for low in range(0, max(1, len(data) - model.order), most):
            block = data[low : low + most + model.order]
            run = np.vstack([sums, sums + np.cumsum(model.bits(grams(block, model.order)), axis=0, dtype=np.float64)])
            for which in (0, 1):
                here = np.flatnonzero((edges[which] >= low) & (edges[which] < low + len(run)))
                marks[which, here] = run[edges[which][here] - low]
            sums = run[-1]
        total[at:upto], size[at:upto] = marks[1] - marks[0], ends - starts
        at = upto
    return total, size


def predict(docs: DataFrame, model: ContextTrees, evidence: int = 48) -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte from whole texts.

    score: posterior of the winner under a uniform prior, with the evidence of at most ``evidence`` mean bytes, so that it stays comparable between short and long texts.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    if not model.languages:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.select(*keep).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped.value
        names = np.array(trees.languages, object)
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            texts = batch.column("text").to_pylist()
            total, size = code_lengths(trees, texts)
            mean = total / np.maximum(size, 1)[:, None]
            gain = (mean.min(axis=1, keepdims=True) - mean) * np.minimum(size, evidence)[:, None]
            score = 1 / np.exp2(gain).sum(axis=1)
            lettered = np.array([t is not None and LETTER.search(t) is not None for t in texts], bool)
            best = names[mean.argmin(axis=1)]
            extra = [pa.array(np.where(lettered, best, UNDETERMINED).tolist(), pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(mean.min(axis=1), mask=~lettered)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte"])

    return docs.select(*keep).mapInArrow(trimmed(run), schema)


def held_out(doc_id: str = "doc_id", parts: int = 4):
    """crc32 of the id as text modulo ``parts`` is 2; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == 2


def accepted(docs: DataFrame, model: ContextTrees, most_bits: float = 8.0, slack_bytes: int = 16) -> DataFrame:
    """Rows of ``docs`` that the method doesn't reject; same columns.

    Rejected: an undetermined language, or a code longer than ``most_bits`` a byte over the text and ``slack_bytes`` more, that is, text that no learned language predicts better than plain bytes.
    """
    if not model.languages:
        return docs.where("false")
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                texts = part.column(at).to_pylist()
                total, size = code_lengths(shipped.value, texts)
                lettered = np.array([t is not None and LETTER.search(t) is not None for t in texts], bool)
                yield part.filter(pa.array(lettered & (total.min(axis=1) <= most_bits * (size + slack_bytes))))

    return docs.mapInArrow(trimmed(run), docs.schema)
