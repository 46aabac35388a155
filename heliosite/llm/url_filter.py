"""URL filter: listed rules first, else naive Bayes over segmented host words and path tokens.

Host labels such as ``cheappillsonline`` are split by unigram Viterbi. Word frequencies come from the visible text of all
pages; each distinct label's substrings are joined with them, and the best split of a label is found from its own matches.
Words are found up to ``LONGEST_WORD`` letters, which is the most that a label of a host may have.
Multinomial naive Bayes learns from the pages that a rule decides. Tokens fall into ``BUCKETS`` hash buckets, so its
tables have a fixed size whatever the corpus, and are counted over all those pages. Labels of the rules' own hosts (such as
``com``) aren't tokens: they would only say which rule decided, and all pages that none decides would fall to one side.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and gets the method's verdict for
no tokens, which is the prior's; without any page that a rule decides, the verdict is allow, and so it is where both
classes are equally likely. Null html has no words; urls and pages of any length are taken whole. Rows stay apart even if
they repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliosite.llm.storage import persisted

BUCKETS = 1 << 18
LONGEST_WORD = 63
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, its verdict): the longest that fits the host or a parent of it and begins the path; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


#: Scripts, styles, comments and tags. What isn't closed runs to the end, and a tag ends at the next ``<``, so that no byte is passed over more than twice.
MARKUP = r"(?is)<(script|style)\b.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+(?:>|\z)"


def page_words(pages: DataFrame) -> DataFrame:
    """(word, n) over the text of all pages, without scripts, styles, comments and tags."""
    bare = F.regexp_replace("html", MARKUP, " ")
    return pages.select(F.explode(F.split(F.lower(bare), r"[^\p{L}]+")).alias("word")).where(f"length(word) between 1 and {LONGEST_WORD}").groupBy("word").agg(F.count("*").alias("n"))


def segment(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, parts): the most probable split of each ``label``, an unknown stretch of m characters costing as a word of frequency 10**(1-m)."""
    total = float(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1)
    starts = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("at"))
    spans = starts.select("label", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("label") - F.col("at") + 1))).alias("size"))
    known = spans.withColumn("word", F.substring("label", F.col("at"), F.col("size"))).join(words, "word")
    matches = known.groupBy("label").agg(F.collect_list(F.struct((F.col("at") - 1).alias("at"), "size", F.log10(F.col("n") / total).alias("cost"))).alias("matches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [split(label, matches or [], total) for label, matches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["label", "parts"])

    return labels.join(matches, "label", "left").select("label", "matches").mapInArrow(run, "label string, parts array<string>")


def split(label: str, matches: list[dict], total: float) -> list[str]:
    """Viterbi over ``label``: ``matches`` are its known words as {at, size, cost}."""
    n = len(label)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    from_: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for m in matches:
        from_[m["at"]].append((m["size"], m["cost"]))
    for at in range(n):
        for size in range(1, min(LONGEST_WORD, n - at) + 1):
            from_[at].append((size, 1 - size - math.log10(total)))
        for size, cost in from_[at]:
            if best[at] + cost > best[at + size]:
                best[at + size], back[at + size] = best[at] + cost, at
    parts, end = [], n
    while end:
        parts.append(label[back[end] : end])
        end = back[end]
    return parts[::-1]


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for every row of ``pages``; block_score is the method's log odds."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "listed": verdict})
    hosts = persisted(urls.select("host").distinct())
    own = sorted({label for _, text in rules for label in text.partition("/")[0].split(".")})
    pieces = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("place", "label")).where((F.col("label") != "") & ~F.col("label").isin(own))
    split_labels = segment(pieces.select("label").distinct(), page_words(pages))
    host_words = persisted(
        pieces.join(split_labels, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "parts"))), lambda x: x["parts"])).alias("words"))
    )
    path_words = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    named = F.transform(path_words, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"^\p{N}+$", "0")))
    tokens = F.concat(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x)), named)
    whole = persisted(urls.join(host_words, "host", "left").withColumn("tokens", F.transform(tokens, bucket)).drop("words"))
    taught = whole.where("listed is not null")
    prior = {r["listed"]: r["n"] for r in taught.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    counts = np.ones((2, BUCKETS))
    for r in taught.select("listed", F.explode("tokens").alias("b")).groupBy("listed", "b").count().collect():  # at most 2 * BUCKETS rows
        counts[int(r["listed"] == "block"), r["b"]] += r["count"]
    odds = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    first = math.log((prior.get("block", 0) + 1e-9) / (prior.get("allow", 0) + 1e-9)) if prior else -1.0
    shipped = pages.sparkSession.sparkContext.broadcast((odds if prior else np.zeros(BUCKETS), first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, first = shipped.value
        for batch in batches:
            tokens = batch.column("tokens")
            flat, at = tokens.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            sums = np.concatenate([[0.0], np.cumsum(odds[flat])])
            score = first + sums[at[1:]] - sums[at[:-1]]
            method = pa.array(np.where(score > 0, "block", "allow").tolist(), pa.string())
            verdict = pa.compute.coalesce(batch.column("listed"), method)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), verdict, pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "block_score"])

    return whole.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, block_score double")
