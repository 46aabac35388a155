"""Odd input for every corpus operator and pipeline stage: nulls, blanks, very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliosite.llm import chat, decontamination, jaccard_join, kneser_ney, language_id, packing, pii, repeats, transport, url_filter
from tests.llm.test_corpus import brute_groups, brute_repeats, brute_spans

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
r = random.Random(9)
LONG = " ".join(r.choice(["alpha", "beta", "gamma", "Él", "7"]) + "".join(chr(97 + int(c)) for c in str(r.randint(0, 60_000))) for _ in range(130_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (4, LONG, "en", "a", len(LONG)), (5, LONG[:400_000], "en", "b", 400_000),
    (6, "one two three four five six", "en", None, 27), (7, "one two three four five six", "de", None, 27), (8, "tie ab", "de", "x", 6), (8, "tie ab", "de", "x", 6), (9, "first of two", "en", "x", 12), (9, "second of two", "en", "x", 13), (None, "no id at all", "en", None, 12), (10, "\u0000\U0001f600 ٣", "fr", "x", 4),
]
CLASH = ("h", "n", "c", "u", "v", "member", "name", "low", "salt", "score", "piece", "length", "place", "node", "_row", "_kept", "held_out")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def joined_by_id(rows):
    """Rows that share an id are one document for repeats: their different texts in order."""
    out = {}
    for doc_id, text, *_ in rows:
        out.setdefault(doc_id, set())
        if text is not None:
            out[doc_id].add(text)
    return [(k, "".join(sorted(v))) for k, v in out.items()]


def test_language(spark, docs, empty):
    model = language_id.fit(docs)
    got = language_id.predict(docs, model)
    rows = got.collect()
    assert len(rows) == len(ROWS) and set(docs.columns) - {"score"} <= set(got.columns)
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x.lang_pred)
    assert by[1] == by[2] == by[3] == ["und"] and by[4] == ["en"] and by[6] == by[7] and len(set(by[8])) == 1
    assert language_id.predict(empty, model).count() == 0 and language_id.fit(empty).languages == []
    tie = language_id.fit(spark.createDataFrame([("b", "xyz xyz"), ("a", "xyz xyz")], "lang string, text string"))
    assert language_id.predict(docs.where("doc_id = 6"), tie).first().lang_pred == "a"


def test_urls(spark):
    page = "page_id long, url string, html string"
    rows = [(1, None, None), (2, "", ""), (3, "://", "<title></title>"), (4, "http://" + "ab" * 500 + ".com/" + "x" * 9000, "<title>ab abab</title>"), (5, "http://x.net/es/a", "<title>x</title>"), (5, "http://x.net/es/a", "<title>x</title>"), (None, "http://q.org/#", "q"), (6, "http://a.b.net/fr/", None)]
    pages = spark.createDataFrame(rows, page).withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "label", "word", "n")})
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows) and {x.verdict for x in got} <= {"allow", "block"}
    assert [(x.host, x.path, x.rule) for x in got if x.page_id in (1, 2, 3)] == [("", "", None)] * 3
    assert [x.verdict for x in got if x.page_id == 5] == ["block"] * 2
    assert url_filter.judge(spark.createDataFrame([], page)).count() == 0
    alone = url_filter.judge(spark.createDataFrame([(1, "http://q.org/", "q")], page)).first()
    assert alone.verdict == "allow"


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    assert max(x.length for x in got) <= 2048 and sum(x.doc_id == 8 for x in got) == 2 and sum(x.doc_id is None for x in got) == 1
    places = sorted((x.sequence_id, x.offset, x.length) for x in got)
    for (s, o, n), (t, p, _) in zip(places, places[1:], strict=False):
        assert p == (o + n if s == t else 0)
    assert {x.length for x in got if x.doc_id in (1, 2)} == {1}
    assert packing.pack(empty).count() == 0


def test_repeats(docs, empty):
    short = [x for x in ROWS if x[1] is None or len(x[1]) < 500_000]
    got = {x[0]: tuple(x)[1:] for x in repeats.remove_repeats(docs.where("doc_id is null or doc_id <> 4")).collect()}
    want = brute_repeats([(k if k is not None else -1, v) for k, v in joined_by_id(short)])
    assert {k if k is not None else -1: v for k, v in got.items()} == want
    whole = {x[0]: tuple(x)[1:] for x in repeats.remove_repeats(docs).collect()}
    assert whole[5][:2] == (len(LONG[:400_000].encode()), len(LONG[:400_000].encode())) and whole[4][1] == 0
    assert repeats.remove_repeats(empty).count() == 0


def test_kneser_ney(docs, empty):
    got = kneser_ney.fit_and_score(docs, language_id.held_out(parts=7), order=3).collect()
    assert len(got) == len(ROWS) and {x.n_tokens for x in got if x.doc_id in (1, 2, 3)} == {1}
    assert all(x.score <= 0 and x.base_score <= 0 for x in got)
    assert len({(x.score, x.n_tokens) for x in got if x.doc_id == 8}) == 1
    assert next(x for x in got if x.doc_id == 4).n_tokens == len(LONG.split()) + 1
    assert kneser_ney.fit_and_score(empty, language_id.held_out(parts=7)).count() == 0


def test_jaccard(docs, empty):
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_shingles, x.component_id) for x in jaccard_join.groups(docs).collect())
    assert len(got) == len(ROWS)
    by = {(d, n): c for _, d, n, c in got}
    assert by[6, 2] == by[7, 2] == 6 and by[1, 0] == 1 and by[8, 1] == 8 and by[9, 1] == 9 and got[-1] == (True, 0, 1, None)
    assert {c for (d, _), c in by.items() if d in (4, 5)} == {4, 5}
    assert jaccard_join.groups(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    texts = {x.doc_id: x.text for x in kept.collect()}
    assert set(texts) == {None, 1, 2, 3, 4, 5, 6, 8, 9, 10} and texts[9] == "first of two" and kept.count() == 10
    assert jaccard_join.keep_one(empty).count() == 0


def test_jaccard_of_long_near_copies(spark):
    """Copies of a long text with some words changed, of every size ratio about the threshold, and exact copies beside them."""
    words = [f"w{r.randint(0, 10**6)}" for _ in range(3000)]
    rows = [(i, " ".join(words[: 3000 - 60 * i])) for i in range(20)]
    for i in range(20, 60):
        changed = list(words)
        for _ in range(r.choice([5, 40, 55, 60, 66, 70, 75])):
            changed[r.randrange(3000)] = f"x{i}-{r.randint(0, 9)}"
        rows.append((i, " ".join(changed)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 3)]
    got = {x[0]: tuple(x)[1:] for x in jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_groups(rows)


def test_tries_against_sets():
    import numpy as np

    for _ in range(30):
        many = r.randint(3, 40)
        sets = [np.array(sorted(r.sample(range(many), r.randint(1, many)))) for _ in range(r.randint(1, 25))]
        sizes = np.array([len(s) + r.randint(0, 3) for s in sets])
        hub = set(r.sample(range(many), r.randint(1, many)))
        size = len(hub) + r.randint(0, 3)
        present = np.zeros(many, bool)
        present[list(hub)] = True
        wanted = np.array([r.random() < 0.8 for _ in sets])
        want = {i for i, s in enumerate(sets) if wanted[i] and 100 * len(hub & set(s.tolist())) >= 80 * (size + int(sizes[i]) - len(hub & set(s.tolist())))}
        assert set(jaccard_join.Trie(sets, sizes).reached(present, size, 80, wanted)) == want


def test_chat(spark):
    turns = "conv_id long, turn long, role string, text string"
    rows = [(1, 1, "user", None), (1, 1, "user", "tie"), (1, 2, "assistant", ""), (2, 0, None, "x"), (2, 0, None, "x"), (None, 1, "user", "no id"), (3, None, "assistant", LONG)]
    df = spark.createDataFrame(rows, turns).withColumns({c: F.lit(1) for c in ("fragment", "parts", "loss_start", "type")})
    got = {x.conv_id: x for x in chat.digests(chat.format_turns(chat.as_parts(df))).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 3, 2: 2, None: 1, 3: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nuser\ntie\nassistant\n\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\nx\n\nx\n").hexdigest() and got[3].loss_chars == len(LONG)
    assert chat.digests(chat.format_turns(chat.as_parts(spark.createDataFrame([], turns)))).count() == 0


def test_transport(spark, docs, empty):
    got = transport.features(transport.store(docs)).collect()
    assert len(got) == len(ROWS)
    for x in got:
        text = next((t for i, t, *_ in ROWS if i == x.doc_id and len((t or "").encode()) == x.n_bytes), None)
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (x.payload_sha256, x.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert transport.features(transport.store(empty)).count() == 0


def test_damaged_media(spark):
    """Media that hold no stream, or a broken one, give null features and the bytes that can be read."""
    whole = transport.mux(bytes(576 * 3))
    rows = [(1, 0, b""), (2, 5, None), (3, 5, b"short"), (4, 5, bytes(188 * 3)), (5, 5, whole[188:]), (6, 5, whole[:-50]), (7, 576 * 3, whole)]
    got = {x.doc_id: x for x in transport.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert set(got) == set(range(1, 8)) and got[7].payload_bytes == 576 * 3
    assert all(got[i].payload_bytes == 0 for i in (1, 2, 3, 4))


def test_pii(spark, docs, empty):
    field = pii.fit(pii.examples(spark))
    got = pii.find(docs, field).collect()
    assert len(got) == len(ROWS)
    for x in got:
        if x.doc_id in (6, 7, 8):
            assert x.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert len({x.spans for x in got if x.doc_id == 8}) == 1
    base = pii.joined(brute_spans(LONG[:400_000]))
    assert next(x for x in got if x.doc_id == 5).base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert pii.find(empty, field).count() == 0
    hidden = pii.redact(docs, field)
    assert hidden.columns == docs.columns and hidden.count() == len(ROWS) and pii.redact(empty, field).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "tie ab"), (4, LONG[:2000])], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs, items.withColumns({c: F.lit(1) for c in ("h", "place", "doc_id")})).collect()}
    assert got == {(6, 1), (7, 1), (4, 4), (5, 4)}
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.contaminated(docs, items.where("false")).count() == 0
    assert decontamination.clean(empty, items).count() == 0


def test_stages(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        got = stage(spark, docs.where("doc_id is null or doc_id <> 4"), SF)
        assert got.count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).columns == docs.columns
