"""Merkle manifests, importance resampling and line removal: against plain Python, on odd input, and at the edges of their blocks and batches."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heliosite.llm import line_runs, merkle, queries, resampling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("h", "n", "top", "doc", "g", "idx", "digest", "run", "parent", "steps", "root", "leaf", "altered", "score", "weight", "rank", "bucket", "_key", "_group", "_part", "_idx", "place")
LONG = "Long line of many words " * 60_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\n", None, "", 3), (4, "Tie AB\nshared line of twenty points", "de", "x", 6), (4, "Tie AB\nshared line of twenty points", "de", "x", 6), (5, "SHARED LINE of twenty points \n\nend", "en", "x", 12), (6, "other\r\n  shared line of twenty points\n", "en", None, 13),
    (None, "no id at all\nshared line of twenty points", "en", None, 12), (None, "no id either", "fr", None, 12), (7, "\u0000\U0001f600 ٣ É 1b", "", "x", 4), (8, LONG, "en", "x", len(LONG)), (9, "shared line of twenty points", "zz", "y", 1), (9, "a different text of the same id", "zz", "y", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(digests):
    """(root, proof of each as [(left, right)...]) of one tree of eight."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(proofs):
            run = level[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]
            p.append(("".join(run[: at[i] % 8]), "".join(run[at[i] % 8 + 1 :])))
            at[i] //= 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], proofs


def plain_manifest(rows):
    leaves = {}
    for doc_id, text, lang, source, n in rows:
        leaf = sha("".join(map(field, (doc_id, source, lang, n, text))))
        leaves.setdefault(b"" if lang is None else b"=" + lang.encode(), []).append((doc_id is not None, doc_id or 0, leaf, lang))
    groups = {g: sorted(v) for g, v in sorted(leaves.items())}
    trees = {g: plain_tree([x[2] for x in v]) for g, v in groups.items()}
    root, upper = plain_tree([t[0] for t in trees.values()])
    out = []
    for (g, v), above in zip(groups.items(), upper, strict=True):
        for (known, doc_id, leaf, lang), proof in zip(v, trees[g][1], strict=True):
            out.append((doc_id if known else None, leaf, trees[g][0], root, [*proof, *above]))
    return out


def shown(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("many", [1, 2, 8, 9, 64, 65, 600])
def test_manifest_by_plain_python(spark, many):
    r = random.Random(many)
    rows = [(i * 3, f"text {i}", r.choice(["en", "en", "en", "é", "", None]), r.choice(["a", None]), i) for i in range(many)]
    r.shuffle(rows)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert shown((x.doc_id, x.leaf, x.subroot, x.root, [(s.left, s.right) for s in x.steps]) for x in got) == shown(plain_manifest(rows))


def test_manifest_of_odd_rows(docs, empty):
    got = merkle.manifest(docs).collect()
    assert shown((x.doc_id, x.leaf, x.subroot, x.root, [(s.left, s.right) for s in x.steps]) for x in got) == shown(plain_manifest(ROWS))
    assert merkle.manifest(empty).count() == 0
    alone = merkle.manifest(docs.where("doc_id = 8")).first()
    assert alone.leaf == alone.subroot == alone.root and alone.steps == []


def test_proofs_hold_for_the_row_only(spark, docs):
    changed = F.when(F.col("doc_id").isin(5, 8), merkle.preimage([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.upper("text")]))
    got = merkle.manifest(docs, altered=changed).select("doc_id", "root", merkle.folded(F.coalesce("altered", "leaf"), F.col("steps")).alias("to"), merkle.proof_digest(F.col("steps")).alias("proof"), "steps").collect()
    assert all((x.to == x.root) == (x.doc_id not in (5, 8)) for x in got)
    assert all(x.proof == sha("".join(s.left + s.right for s in x.steps)) for x in got)


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    return words, [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(rows, target, percent=5, least=20):
    s, t = (Counter(zlib.crc32(f) % 10000 for x in texts for f in features(x)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, (doc_id, text, *_) in enumerate(rows):
        words, feats = features(text)
        weight = sum(gain(zlib.crc32(f) % 10000) for f in feats)
        h = int(sha(f"42:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, len(words), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    ranks = {x[5]: n for n, x in enumerate(able[: len(able) * percent // 100], 1)}
    return [(*x[:5], ranks.get(x[5])) for x in out]


def test_resampling_by_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = resampling.resample(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert shown(tuple(x) for x in got.collect()) == shown(plain_resample(rows, target))


def test_resampling_of_odd_rows(spark, docs, empty):
    target = spark.createDataFrame([("Shared line",), (None,), ("",)], "text string").withColumn("h", F.lit(1))
    got = [tuple(x) for x in resampling.resample(docs, target, percent=50, least_words=2).collect()]
    want = plain_resample(ROWS, ["Shared line", None, ""], 50, 2)
    assert shown(x[:5] for x in got) == shown(x[:5] for x in want) and sorted(x[5] for x in got if x[5]) == sorted(x[5] for x in want if x[5])
    assert {x[0] for x in got if x[5]} == {x[0] for x in want if x[5]}
    assert resampling.resample(empty, target).count() == 0 and resampling.resample(docs, target.where("false")).count() == len(ROWS)


def test_buckets_where_blocks_meet(monkeypatch):
    """Blocks of a few words, words longer than the table of short ones, rows that end within a block."""
    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "bb", "Été", "x" * 70, "7"]) for _ in range(r.randint(0, 30))) for _ in range(20)] + ["", "!!", "z" * 5000]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for size in (1, 3, 7, 1 << 17):
        monkeypatch.setattr(resampling, "WORDS", size)
        got = [Counter() for _ in texts]
        for row, found in resampling.buckets_of(data, offsets, 3, 997):
            for i, column in zip(row.tolist(), found.T.tolist(), strict=True):
                got[i].update(b for b in column if b >= 0)
        assert got == [Counter(zlib.crc32(f) % 997 for f in features(t)[1]) for t in texts]


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(5)
    for depth, kinds in ((3, 4), (3, 1 << 40), (5, 2)):
        ids, row = r.integers(0, kinds, 200), np.sort(r.integers(0, 9, 200))
        order, lcp = resampling.suffix_array(ids, row, depth)
        suffix = [tuple(ids[i : i + depth][row[i : i + depth] == row[i]].tolist()) for i in range(200)]
        inorder = [suffix[i] for i in order]
        assert inorder == sorted(inorder) and sorted(order) == list(range(200))
        for k in range(1, 200):
            a, b = inorder[k - 1], inorder[k]
            assert lcp[k] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_joined_checksums():
    r = random.Random(1)
    pairs = [(r.randbytes(r.randint(0, 9)), r.randbytes(r.choice([0, 1, 5, 64, 3000]))) for _ in range(50)]
    first, second = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    assert resampling.crc_joined(first, second, np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def plain_lines(rows, least=3, shortest=20):
    of, white = {}, " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(white).encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).decode()
    ident = lambda d: -1 if d is None else d
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                of.setdefault(key(line), set()).add(ident(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(of.get(key(x), ())) < least or max(of[key(x)]) == ident(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def made_lines(seed, many=150):
    r = random.Random(seed)
    common = [f"Line number {i} which several documents hold é{i}" for i in range(40)]
    vary = lambda x: r.choice([x, x.upper(), f"  {x}\t", f"{x}\r", x + "\x0b"])
    rows = []
    for i in range(many):
        lines = [r.choice([vary(r.choice(common)), f"own line of document {i} with {r.random()}", "short", "", "HOT LINE in every second document"]) for _ in range(r.randint(0, 9))]
        rows.append((i * 7 % many, "\n".join([*lines, *["hot line in every second document"] * (i % 2)]), "en", None, 0))
    return rows


@pytest.mark.parametrize(("share", "batches"), [(1 << 16, 6), (4, 6), (1, 1), (0, 9)])
def test_lines_by_plain_python(spark, monkeypatch, share, batches):
    """Frequent keys shipped or joined, few batches or many: the same lines go."""
    monkeypatch.setattr(line_runs, "SHARE", share or 1)
    if not share:
        monkeypatch.setattr(line_runs, "frequent", lambda common, pairs: (common, line_runs.Shipped([])))
    rows = made_lines(share)
    got = line_runs.drop_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), batches=batches, with_text=True).collect()
    assert shown(tuple(x)[:4] for x in got) == shown(plain_lines(rows)) and all(sha(x.kept) == x.kept_sha256 for x in got)
    assert sum(x.n_dropped for x in got) > 100


def test_lines_of_odd_rows(docs, empty):
    got = line_runs.drop_lines(docs)
    assert shown(tuple(x) for x in got.collect()) == shown(plain_lines(ROWS)) and got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert line_runs.drop_lines(empty).count() == 0


def test_runs_are_levelled_and_settled_keys_add_nothing(spark):
    runs = line_runs.LineRuns(spark, least=3, fanout=3)
    pair = lambda rows: spark.createDataFrame(rows, "h long, doc long")
    runs.add(pair([(1, 100), (1, 99), (1, 98), (2, 100)]), "a")
    runs.add(pair([(1, 50), (2, 50), (3, 50)]), "b")
    runs.add(pair([(9, 1)]), "b")  # taken before
    second = spark.table(runs.levels[0][1][0]).collect()
    assert {r.h for r in second} == {2, 3}  # 1 is settled
    runs.add(pair([(1, 200), (2, 49)]), "c")  # a larger document isn't settled
    assert [len(x) for x in runs.levels] == [0, 1]
    merged = spark.table(runs.levels[1][0][0])
    assert {(r.h, r.n, r.top) for r in merged.collect()} == {(1, 4, 200), (2, 3, 100), (3, 1, 50)}
    runs.add(pair([(3, 10), (3, 11)]), "d")
    assert {(r.h, r.n, r.top) for r in runs.common().collect()} == {(1, 4, 200), (2, 3, 100), (3, 3, 50)}
    plan = spark.createDataFrame([(1,)], "h long").join(merged.hint("merge"), "h", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # the run is read as it lies
    names = [name for level in runs.levels for name, _ in level]
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert set(columns) == set(got.columns)
    assert shown(tuple(x[c] for c in sorted(columns)) for x in got.collect()) == shown(tuple(x[columns.index(c)] for c in sorted(columns)) for x in want.fetchall())
