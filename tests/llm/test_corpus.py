"""Each corpus operator against a brute-force version on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliosite.llm import chat, decontamination, jaccard_join, kneser_ney, language_id, packing, pii, repeats, transport, url_filter
from heliosite.llm.components import components

DOCS = "/root/testdata/sf0.001/documents.parquet"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows, odd ones, and columns with clashing names."""
    odd = spark.createDataFrame([(90001, None), (90002, ""), (90003, "  \n"), (90004, "x" * 700), (90005, "é日本 1 <|endoftext|>")], "doc_id long, text string")
    return spark.read.parquet(DOCS).select("doc_id", "text").unionByName(odd).withColumns({"h": F.lit("clash"), "n": F.lit(1), "c": F.lit(None).cast("int")})


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


EMPTY = "doc_id long, text string"


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("out", language_id.held_out())
    model = language_id.fit(d.where("not out"))
    got = language_id.predict(d, model).where("out").select("lang", "lang_pred", "score").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_codes_match_recursion(spark):
    texts = ["abab aba", "abba", "xyz xyx"]
    model = language_id.fit(spark.createDataFrame([("p", texts[0]), ("p", texts[1]), ("q", texts[2])], "lang string, text string"), order=3)
    count = {lang: Counter() for lang in "pq"}
    for lang, t in zip("ppq", texts, strict=True):
        raw = b"\n\n\n" + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                count[lang][raw[i - k : i], raw[i]] += 1

    def bits(lang, context, symbol):
        seen = {s: c for (x, s), c in count[lang].items() if x == context}
        n, d = sum(seen.values()), len(seen)
        if symbol in seen:
            return math.log2((n + d) / seen[symbol])
        escape = math.log2((n + d) / d) if d else 0.0
        return escape + (bits(lang, context[1:], symbol) if context else 8.0)

    text = "aby xab"
    raw = b"\n\n\n" + text.encode()
    total, size = language_id.code_lengths(model, [text, None])
    for j, lang in enumerate(model.languages):
        assert total[0, j] == pytest.approx(sum(bits(lang, raw[i - 3 : i], raw[i]) for i in range(3, len(raw))), rel=1e-5)
    assert size.tolist() == [len(text), 0] and total[1].tolist() == [0.0, 0.0]


def test_language_sample_of_copies_and_long_rows(spark):
    r = random.Random(4)
    made = lambda letters, n: "".join(r.choice(letters) + r.choice(["", "", " "]) for _ in range(n))
    hot, other = made("abc", 1000), [made("defgh", 700) for _ in range(150)]
    rows = [("copied", hot)] * 4000 + [("copied", t) for t in other] + [("long", made("klmnó", 150_000)) for _ in range(2)]
    sample = {"copied": [*other, hot], "long": [t for lang, t in rows if lang == "long"]}
    most = 1 << 16
    labelled = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    model = language_id.fit(labelled, bytes_per_language=most)
    assert model.languages == ["copied", "long"]
    got = language_id.predict(spark.createDataFrame([(made("defgh", 60), "copied"), (made("klmnó", 60), "long")], "text string, want string"), model).collect()
    assert all(x.lang_pred == x.want and x.bits_per_byte < 5 for x in got)
    parts = language_id.blocks(labelled).where("lang = 'long'")
    texts = b"".join(x.block for x in parts.collect())
    assert len(texts) == sum(len(t.encode()) for t in sample["long"])
    whole = language_id.fit(spark.createDataFrame([("x", sample["long"][0])], "lang string, text string"))
    counts = language_id.count_grams(language_id.blocks(spark.createDataFrame([("x", sample["long"][0])], "lang string, text string")), 3)
    assert whole.languages == ["x"] and counts.where("k = 0").agg(F.sum("n")).first()[0] > len(sample["long"][0].encode()) - 200
    chosen = language_id.fit(spark.createDataFrame([(lang, t) for lang in "pq" for t in ([hot] * 50 if lang == "p" else sample["long"])], "lang string, text string"), bytes_per_language=1)
    assert chosen.dense.min(axis=0).max() < 8


def test_language_defined_results(spark):
    d = docs_of(spark, [(1, None), (2, "12 %"), (3, "abc")])
    model = language_id.fit(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in language_id.predict(d, model).collect()} == {"und"}
    taught = language_id.fit(spark.createDataFrame([("x", "abc abc")], "lang string, text string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(d, taught).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("x", 1.0)}
    assert language_id.predict(spark.createDataFrame([], EMPTY), taught).count() == 0


def test_url_rules_and_split(spark):
    urls = ["http://a.COM/x", "https://www.example.com/en/1?x", "http://example.com/en/", "http://b.net/es/", "nothing", None, "http://z.org/q", "http://example.com"]
    pages = spark.createDataFrame([(i, u, "<title>spam farm</title>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == ("net/es/", "block") and got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None) and got[6][2] is None and got[7][1:3] == ("", None)
    assert len(got) == len(urls)
    parts = url_filter.segment(spark.createDataFrame([("spamfarm",), ("zzz",)], "label string"), url_filter.page_words(pages))
    assert {r.label: r.parts for r in parts.collect()}["spamfarm"] == ["spam", "farm"]


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    got = packing.pack(docs).toPandas()
    tokenizer = Tokenizer.from_file(packing.default_files()[0])
    want = {}
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = packing.cuts(len(ids))
        for piece, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
            want[doc_id, piece] = (a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    ordered = got.sort_values(["sequence_id", "offset"])
    sums = ordered.groupby("sequence_id").length
    assert ((sums.cumsum() - ordered.length) == ordered.offset).all() and sums.sum().max() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) + 2
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0


def test_packing_plan_is_best_fit():
    r = random.Random(5)
    lengths = [r.choice([2048, 1400, 700, 683, 682, 300, 7, 1]) for _ in range(500)]
    import numpy as np

    slots, bins = packing.plan(np.bincount(lengths, minlength=2049))
    assert slots.n.sum() == 500 and bins >= -(-sum(lengths) // 2048)
    gaps, large = [], sorted((x for x in lengths if 3 * x > 2048), reverse=True)
    while large:
        a = large.pop(0)
        b = next((x for x in large if x <= 2048 - a), None)
        if b:
            large.remove(b)
        gaps.append(2048 - a - (b or 0))
    for x in sorted((x for x in lengths if 3 * x <= 2048), reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(2048 - x)
        else:
            gaps[gaps.index(fit)] -= x
    assert bins == len(gaps)


def brute_repeats(rows, size=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = [0] * len(raw)
        for p in range(len(raw) - size + 1):
            if raw[p : p + size] in seen:
                gone[p : p + size] = [1] * size
            seen.add(raw[p : p + size])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc_id] = (len(raw), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs, rows):
    r = random.Random(1)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(90, 300))) for _ in range(6)]
    made = [(95000 + i, "".join(r.choice(passages)[r.randint(0, 60) :] + "".join(r.choice("xyz ") for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 4)))) for i in range(40)]
    made += [(96000, "ab" * 200), (96001, "ab" * 120), (96002, "a" * 99), (96003, "a" * 350)]
    got = {x[0]: tuple(x)[1:] for x in repeats.remove_repeats(docs.select("doc_id", "text").unionByName(docs_of(spark, made))).collect()}
    assert got == brute_repeats(rows + made)
    assert repeats.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0


def test_kneser_ney(spark, docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall((t or "").encode().lower()), "end"]
    uni, pairs, after = Counter(), Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            before = "start"
            for w in tokens(text):
                uni[w] += 1
                pairs[before, w] += 1
                after[before] += 1
                before = w
    kinds, follow = Counter(w for _, w in pairs), {}
    for (v, _), n in pairs.items():
        follow.setdefault(v, [0, 0, 0])[min(n, 3) - 1] += 1
    D, d = kneser_ney.discounts(Counter(pairs.values())), kneser_ney.discounts(Counter(kinds.values()))
    classes = Counter(min(k, 3) for k in kinds.values())
    N, V = sum(uni.values()), len(uni)

    def p(v, w):
        low = (max(kinds[w] - [0, *d][min(kinds[w], 3)], 0) + sum(d[i] * classes[i + 1] for i in range(3)) / (V + 1)) / len(pairs)
        if not after[v]:
            return low
        return max(pairs[v, w] - [0, *D][min(pairs[v, w], 3)], 0) / after[v] + sum(x * y for x, y in zip(D, follow[v], strict=True)) / after[v] * low

    some = sorted(uni, key=str)[:5]
    assert all(sum(p(v, w) for w in uni) + p(v, "new") == pytest.approx(1, abs=1e-6) for v in ["start", *some])
    got = {r.doc_id: r for r in kneser_ney.fit_and_score(docs, language_id.held_out(parts=7), 1 << 17).collect()}
    for doc_id, text in rows:
        words, r = tokens(text), got[doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(doc_id), len(words), sum(uni[w] > 0 for w in words), N)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (N + V + 1)) for w in words))
        assert r.score == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip(["start", *words], words, strict=False)))


def test_kneser_ney_of_order_three(spark, docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall((t or "").encode().lower()), "end"]
    uni, triples, starts = Counter(), Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            words = ["start", *tokens(text)]
            uni.update(words[1:])
            starts[words[1]] += 1
            triples.update(zip(words, words[1:], words[2:], strict=False))
    pairs = Counter((v, w) for _, v, w in triples) + Counter({("start", w): n for w, n in starts.items()})
    kinds, N, V = Counter(w for _, w in pairs), sum(uni.values()), len(uni)

    def level(counts):
        D, after = kneser_ney.discounts(Counter(counts.values())), {}
        for (*c, _), n in counts.items():
            x = after.setdefault(tuple(c), [0, 0.0])
            x[0], x[1] = x[0] + n, x[1] + D[min(n, 3) - 1]
        return lambda gram, lower: max(counts[gram] - [0, *D][min(counts[gram], 3)], 0) / after[gram[:-1]][0] + after[gram[:-1]][1] / after[gram[:-1]][0] * lower if gram[:-1] in after else lower

    three, two = level(triples), level(pairs)
    one = level(Counter({(w,): n for w, n in kinds.items()}))
    p2 = lambda v, w: two((v, w), one((w,), 1 / (V + 1)))
    p = lambda u, v, w: p2(v, w) if u is None else three((u, v, w), p2(v, w))
    u, v, _ = max(triples, key=triples.get)
    assert sum(p(u, v, w) for w in uni) + p(u, v, "new") == pytest.approx(1, abs=1e-6)
    got = {r.doc_id: r for r in kneser_ney.fit_and_score(docs, language_id.held_out(parts=7), 1 << 17, order=3).collect()}
    for doc_id, text in rows:
        words = [None, "start", *tokens(text)]
        assert (got[doc_id].train_tokens, got[doc_id].n_tokens) == (N, len(words) - 2)
        assert got[doc_id].score == pytest.approx(sum(math.log10(p(*g)) for g in zip(words, words[1:], words[2:], strict=False)))


def test_kneser_ney_shards_fill_their_buckets():
    """Keys dealt by themselves, as those after a common word are, spread over their shard's buckets: a look-up walks along one."""
    common = np.array([kneser_ney.START], np.uint64)
    key = kneser_ney.mix(np.arange(200_000, dtype=np.uint64))
    for shard in (kneser_ney.shard_of(np.full(len(key), kneser_ney.START), key, 64, common), kneser_ney.by_low_bits(key, 64)):
        assert np.bincount(shard, minlength=64).min() > 2_000
        held = kneser_ney.pair_array(np.sort(key[shard == 9]), np.ones((shard == 9).sum(), np.int64))
        assert np.diff(held["directory"].astype(np.int64)).max() < 32


def brute_groups(rows):
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets[doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, t in sets.items():
            if i < j and s and 100 * len(s & t) >= 80 * len(s | t) and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard_groups(spark, docs, rows):
    r = random.Random(3)
    made = []
    for _ in range(8):
        base = [f"w{r.randint(0, 60)}" for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.choice([1, 4, 20])):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"w{r.randint(0, 60)}"
            made.append((91000 + len(made) * 7 % 501, " ".join(copy)))
    got = {x[0]: tuple(x)[1:] for x in jaccard_join.groups(docs.select("doc_id", "text").unionByName(docs_of(spark, made))).collect()}
    assert got == brute_groups(rows + made)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 101: 50}


def test_chat_round_trip(spark):
    for text in ["a", "<s>", "\\<s>", "<\\s>", "</s>[INST] ok [/INST]", "<|end|>|>", "\\\\[INST]", "<<s>", "[[/INST]", " [/INST]", "|\\>", ""]:
        for role in ["user", "assistant", "system", "a|>b", "", "\\"]:
            assert chat.read_turn(chat.write_turn(role, [{"text": text}])[0]) == (role, text)
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "i.png", "width": 57, "height": 28}, {"type": "audio", "ref": "a", "seconds": 2.0}, {"type": "document", "ref": "d", "pages": 2}]
    fragment, start, end, attached = chat.write_turn("assistant", parts)
    assert fragment[start:end] == "see <|image:0|><|audio:1|><|document:2|>" and [a["tokens"] for a in attached] == [3, 25, 1024]
    turns = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None)]
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.as_parts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb</s>\n").hexdigest() and got[1].loss_sha256 == hashlib.sha256(b"b</s>").hexdigest() and got[1].loss_chars == 5
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[2].loss_chars == 0


def test_transport_stream(spark, docs, rows):
    for n in [1, 2, 3, 63, 64, 65, 128, 129]:
        raw = random.Random(n).randbytes(transport.FRAME * n)
        media = transport.mux(raw)
        s = transport.demux(media)
        assert (s.payload, s.lost, all(s.random_access)) == (raw, 0, True) and s.times == [k * 64 * 3600 for k in range(-(-n // 64))]
        if len(media) > 188 * 6:
            assert transport.demux(media[: 188 * 3] + media[188 * 4 :]).lost == 1
    got = {r.doc_id: r for r in transport.features(transport.store(docs)).collect()}
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return pii.in_order(out)


def test_pii(spark, docs, rows):
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice("a1.@+- 2(9") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    field = pii.fit(pii.examples(spark))
    held = pii.sentences(200, 99)
    labels = pii.viterbi(field, [field.emissions([w for w, _ in s]) for s in held])
    right = sum(pii.LABELS[a] == b for s, path in zip(held, labels, strict=True) for (_, b), a in zip(s, path, strict=True))
    assert right / sum(map(len, held)) > 0.97
    got = {x.doc_id: x for x in pii.find(docs, field).collect()}
    for doc_id, text in rows:
        want = brute_spans(text or "")
        assert got[doc_id].base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[doc_id].spans.split(","))
    assert "phone" in pii.find(docs_of(spark, [(1, "call (743) 555-3824 now")]), field).first().spans
    assert pii.redact(docs_of(spark, [(1, "to a@b.co!")]), field).first().text == "to [EMAIL]!"


def test_decontamination(spark):
    words = "the train from the north station leaves at 9 with Anna and reaches the coast after 45 minutes while the slow boat needs 9 hours to cross"
    items = spark.createDataFrame([(1, words), (2, None), (3, "too short"), (4, "only six plain words are here")], "item_id long, text string")
    again = words.replace("9", "7").replace("45", "12").replace("Anna", "Boris")
    mixed = again.replace("needs 7", "needs 8")
    rows = [(1, f"Some text. {words}. End"), (2, again), (3, mixed), (4, "nothing alike at all in this one"), (5, None), (6, ""), (7, "say only six plain words are here ok"), (8, words[: len(words) // 4])]
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.contaminated(docs_of(spark, rows), items).collect()}
    assert got == {(1, 1): True, (2, 1): False, (7, 4): True}
    assert got == {(r.doc_id, r.item_id): r.exact for r in decontamination.contaminated(docs_of(spark, rows), items, most_shipped=0).collect()}
    assert decontamination.clean(docs_of(spark, rows), items).count() == 5
    assert decontamination.contaminated(docs_of(spark, rows), items.where("false")).count() == 0


def test_decontamination_keeps_own_values(spark):
    words = "the train from the north station leaves at 9 with Anna and reaches the coast after 45 minutes while the slow boat needs 9 hours to cross"
    ends = "the old keeper saw that Anna had left the harbour long before the storm came and so nobody there could help Anna"
    starts = "9 boats left the small harbour before noon and the keeper counted that only 9 of them came back at night"
    items = spark.createDataFrame([(1, words), (2, ends), (3, starts)], "item_id long, text string")
    rows = [(1, words.replace("needs 9", "needs 8")), (2, f"{ends} Smith, they said"), (3, f"in 1999 {starts}"), (4, words.replace("at 9", "at 7").replace("needs 9", "needs 8"))]
    rows += [(5, words.replace("at 9", "at 7").replace("45", "7").replace("needs 9", "needs 7"))]
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.contaminated(docs_of(spark, rows), items).collect()}
    assert got == {(1, 1): False, (2, 2): True, (3, 3): True, (4, 1): True}


def test_decontamination_word_for_word(spark):
    titled = "The Quick Brown Fox Jumps Over The Lazy Dog Near The Old River Bank Today"
    han, boat = "小明有十七个苹果，他又买了二十三个。一共有多少？", "What did the small boat carry to shore"
    items = spark.createDataFrame([(1, "What is 17 times 23?"), (2, titled), (3, han), (4, boat), (5, "Did Anna carry the small boat back to shore before 9"), (6, "?!")], "item_id long, text string")
    rows = [(1, "so what is 17 times 23 then"), (2, f"he read {titled} aloud"), (3, f"他说：「{han}」然后走了"), (4, f'she asked "{boat}" and left'), (5, "so Clara Did Boris carry the small boat back to shore before 7 or later")]
    rows += [(6, "what is 17 times 24"), (7, "小明有十七个梨，他又买了三个。"), (8, "what does the small boat carry to shore")]
    for most in (1 << 22, 0):
        got = {(r.doc_id, r.item_id): r.exact for r in decontamination.contaminated(docs_of(spark, rows), items, most_shipped=most).collect()}
        assert got == {(1, 1): True, (2, 2): True, (3, 3): True, (4, 4): True, (5, 5): False}


def test_single_words_are_reported_but_drop_nothing(spark):
    items = spark.createDataFrame([(1, "la"), (2, "the quick brown fox jumps"), (3, None)], "item_id long, text string")
    docs = docs_of(spark, [(1, "tra la la"), (2, "so the quick brown fox jumps again"), (3, "nothing here"), (4, None)])
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()} == {(1, 1), (2, 2)}
    assert {r.doc_id for r in decontamination.clean(docs, items).collect()} == {1, 3, 4}
    assert {r.doc_id for r in decontamination.clean(docs, items, least_words=1).collect()} == {3, 4}


def test_transport_streams_made_elsewhere():
    """A second copy of each packet, and a program table that takes several packets and shares one with the next section."""
    payload = transport.payload_of(bytes(range(256)) * 40)
    media = transport.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    doubled = transport.demux(b"".join(p for p in packets for _ in range(2)))
    assert doubled.payload == payload and doubled.lost == 0
    thrice = transport.demux(b"".join(p for p in packets for _ in range(3)))
    assert thrice.lost > 0
    # 80 programs; the map of the second stands first among those that count, as number 0 names the network
    body = bytes([0, 0, 0xE0, 16]) + b"".join(bytes([0, n, 0xE0 | 0x100 >> 8, 0]) for n in range(1, 81))
    descriptors = bytes([5, 200, *range(200)])
    program = bytes([0xE0 | 0x101 >> 8, 1, 0xF0, len(descriptors)]) + descriptors + bytes([6, 0xE1, 1, 0xF0, 0])

    def packed(pid, sections):
        data, out, counter = b"\0" + b"".join(sections), [], 0
        while data:
            part, data = data[:184], data[184:]
            out.append(bytes([0x47, (0x40 if not out else 0) | pid >> 8, pid & 255, 0x10 | counter]) + part.ljust(184, b"\xff"))
            counter += 1
        return out

    long = [*packed(0, [transport._section(0, 1, body)]), *packed(0x100, [transport._section(2, 1, program), transport._section(2, 2, program)]), *packets[2:]]
    assert len(long) > len(packets) + 2 and transport.demux(b"".join(long)).payload == payload
    broken = [p if i != 1 else p[:50] + bytes([p[50] ^ 1]) + p[51:] for i, p in enumerate(long)]
    assert transport.demux(b"".join(broken)).payload == b""


def test_obfuscated_forms_by_kind(spark):
    """Recall of each form on sentences that the training code doesn't make, and words that only look alike."""
    r = random.Random(11)
    model = pii.fit(pii.examples(spark))
    names = "anna bob carol.k dieter_9 e-v".split()
    made = {
        "at in brackets": lambda i: f"{r.choice(names)}{i} [at] shop{i % 7} [dot] com", "at in parentheses": lambda i: f"{r.choice(names)}{'9' * (i % 7)} (at) mail (dot) org", "no spaces": lambda i: f"c{10 ** (i % 7)}[at]d{i}.com",
        "ip in brackets": lambda i: f"10[.]{i % 200}[.]3[.]{i % 90}", "phone with dots": lambda i: f"555.{100 + i % 800}.{1000 + i * 7}",
    }
    recall = {}
    for form, of in made.items():
        texts = [f"please {r.choice(['contact', 'write to', 'reach'])} {of(i)} before {r.choice(['noon', 'friday'])}" for i in range(200)]
        spans = [set(a) - set(b) for b, a in pii.all_spans(texts, model)]
        recall[form] = sum(any(t[a:b] in t and len(t[a:b]) > 8 for _, a, b in s) for t, s in zip(texts, spans, strict=True)) / len(texts)
    plain = [f"{x} {i}" for i in range(40) for x in ("meet at dot com station", f"room {i}(at) floor", f"version 3.{i}.1 released", f"on 2024-0{i % 9 + 1}-11 at noon", f"item c{i * 997} costs ${i}.50")]
    wrong = sum(len(set(a) - set(b)) for b, a in pii.all_spans(plain, model))
    print("recall", recall, "false", wrong, "of", len(plain))
    assert min(recall.values()) > 0.8 and wrong <= len(plain) // 50


def test_added_spans_outside_patterns():
    r = random.Random(4)
    for _ in range(200):
        spans, taken = ([("k", a, a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(r.randint(0, 8)))] for _ in range(2))
        assert pii._outside(spans, taken) == [s for s in spans if not any(s[1] < b and a < s[2] for _, a, b in taken)]
