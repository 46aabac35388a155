"""URL filter, decontamination, chat, and the field of personal data against plain Python."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliosite.llm import chat, decontamination, pii, url_filter

SF = "/root/testdata/sf0.001"


def plain_split(label, count, total):
    """The best split by trying every last word."""
    best = {0: (0.0, [])}
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - url_filter.LONGEST_WORD), end):
            word = label[start:end]
            cost = math.log10(count[word] / total) if count[word] else 1 - len(word) - math.log10(total)
            options.append((best[start][0] + cost, [*best[start][1], word]))
        best[end] = max(options, key=lambda x: x[0])
    return best[len(label)]


def test_urls_by_plain_python(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.collect()
    bare = [re.sub(r"(?is)<(script|style)\b.*?(</\1\s*>|\Z)|<!--.*?(-->|\Z)|<[^<>]*(>|\Z)", " ", r.html or "") for r in rows]
    words = Counter(w for t in bare for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) <= url_filter.LONGEST_WORD)
    assert {r.word: r.n for r in url_filter.page_words(pages).collect()} == words
    total = sum(words.values())
    upper = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    seen, taught, parts_of = [], defaultdict(Counter), {}
    bucket = {}
    for r in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].translate(upper), m[2]) if m else ("", "")
        rule = None
        for what, text in url_filter.RULES:
            of, rest = text.split("/", 1)
            if (host == of or host.endswith(f".{of}")) and path.startswith(f"/{rest}") and (rule is None or len(text) > len(rule[1])):
                rule = (what, text)
        tokens = []
        for label in re.findall(r"[^\W\d_]+", host):
            if label in {"com", "example", "www", "net"}:
                continue
            if label not in parts_of:
                parts_of[label] = plain_split(label, words, total)
            tokens += [f"h:{w}" for w in parts_of[label][1]]
        tokens += [f"p:{0 if re.fullmatch(r'[0-9]+', w) else w}" for w in re.findall(r"[^\W_]+", path.lower())]
        seen.append((r.page_id, host, path, rule, tokens))
        if rule:
            taught[rule[0]].update(tokens)
    every = sorted({t for *_, tokens in seen for t in tokens})
    for row in spark.createDataFrame([(t,) for t in every], "t string").select("t", url_filter.bucket(F.col("t")).alias("b")).collect():
        bucket[row.t] = row.b
    count = {v: Counter() for v in ("allow", "block")}
    for verdict, tokens in taught.items():
        for t, n in tokens.items():
            count[verdict][bucket[t]] += n
    prior = Counter(rule[0] for *_, rule, _ in seen if rule)
    size = {v: sum(c.values()) + url_filter.BUCKETS for v, c in count.items()}
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(seen) and prior["allow"] and prior["block"]
    split = {r.label: r.parts for r in url_filter.segment(spark.createDataFrame([(k,) for k in parts_of], "label string"), url_filter.page_words(pages)).collect()}
    for label, (score, _) in parts_of.items():  # equal up to ties
        assert sum(math.log10(words[w] / total) if words[w] else 1 - len(w) - math.log10(total) for w in split[label]) == pytest.approx(score)
    for page_id, host, path, rule, tokens in seen:
        x = got[page_id]
        assert (x.host, x.path, x.rule) == (host, path, rule and rule[1])
        if all(parts_of[w][1] == split[w] for w in re.findall(r"[^\W\d_]+", host) if w in split):
            odds = math.log(prior["block"] / prior["allow"]) + sum(math.log((count["block"][bucket[t]] + 1) / size["block"]) - math.log((count["allow"][bucket[t]] + 1) / size["allow"]) for t in tokens)
            assert x.block_score == pytest.approx(odds, abs=1e-6)
            assert x.verdict == (rule[0] if rule else "block" if odds > 0 else "allow")


def test_urls_held_out(spark):
    """Pages that a rule decides, judged by the method alone after learning from pages of other hosts: a fifth of the hosts at a time."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    ruled = url_filter.judge(pages).where("rule is not null").select("page_id", F.col("verdict").alias("want"), F.abs(F.hash("host") % 5).alias("part"))
    marked = pages.join(ruled, "page_id", "left").cache()
    right = {"allow": [], "block": []}
    for part in range(5):
        hide = F.regexp_replace("url", r"\.(com|net)(?=[/?#]|$)", ".zz")
        hidden = marked.select("page_id", F.when(F.col("part") == part, hide).otherwise(F.col("url")).alias("url"), "html")
        for r in url_filter.judge(hidden).where("rule is null").join(ruled.where(F.col("part") == part), "page_id").collect():
            right[r.want].append(r.verdict == r.want)
    balanced = sum(sum(x) / len(x) for x in right.values()) / 2  # one answer for all gives 0.5
    print("balanced accuracy", balanced, {k: (len(v), sum(v) / len(v)) for k, v in right.items()})
    assert balanced > 0.65 and min(sum(x) / len(x) for x in right.values()) > 0.4


def test_urls_undecided_get_both_verdicts(spark):
    got = url_filter.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is null").groupBy("verdict").count().collect()
    assert len(got) == 2 and min(r["count"] for r in got) > 50


@pytest.mark.parametrize("piece", ["<", "<!--", "<script ", "<script>", "</script ", "<a href='", "<style", "> <"])
def test_markup_is_linear(spark, piece):
    """A megabyte of openings that nothing closes."""
    page = "start " + piece * (1_000_000 // len(piece)) + " end"
    began = time.time()
    url_filter.page_words(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert time.time() - began < 20


WORD = re.compile(r"[a-z0-9]+")


def test_decontamination_word_runs_by_plain_python(spark):
    """Texts of small letters only, where template and word windows are the same: any 13 words in a row of an item, or all of a shorter one."""
    r = random.Random(4)
    vocabulary = [w for w in ("".join(p) for p in itertools.product("bdfg", "aeiou", "lnpr")) if w not in decontamination.UNITS]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 8, 13, 30])))) for i in range(25)]
    docs = []
    for d in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        if d % 2:
            own = items[r.randrange(25)][1].split()
            a = r.choice([0, 0, r.randrange(len(own))])
            words[5:5] = own[a : a + r.choice([2, 12, 13, 20, 40])]
        docs.append((d, " ".join(words)))

    def runs(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    want = set()
    for i, text in items:
        own = WORD.findall(text)
        n = min(13, len(own))
        want |= {(d, i) for d, t in docs if runs(WORD.findall(t), n) & runs(own, n)}
    for most in (1 << 22, 0):
        got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_shipped=most)
        assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    assert len(want) > 20


def test_decontamination_templates_by_plain_python(spark):
    """Numbers replaced one for one, or not: the slots of an item's single window decide."""
    r = random.Random(8)
    base = "the old ferry with {} seats crosses the wide bay {} times while the new one needs {} minutes each".split()
    items, docs = [(0, " ".join(base).format(3, 5, 3))], []
    for d in range(60):
        docs.append((d, "so " + " ".join(base).format(*(r.choice([3, 5, 7, 9]) for _ in range(3))) + " they say"))

    def agrees(text):
        own, other = re.findall(r"\d+", items[0][1]), re.findall(r"\d+", text)
        good = own == other
        there, back = {}, {}
        return good or all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(own, other, strict=True))

    got = {x.doc_id for x in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sure = {d for d, t in docs if agrees(t)}
    assert sure <= got and len(sure) > 5
    for d in got - sure:  # a window may lie clear of the value that doesn't agree
        own, other = re.findall(r"\d+", items[0][1]), re.findall(r"\d+", docs[d][1])
        assert any(agrees_part(own[a : a + 2], other[a : a + 2]) for a in (0, 1))


def agrees_part(own, other):
    return own == other


def test_chat_table_by_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = {}
    for x in sorted(rows, key=lambda x: (x.conv_id, x.turn)):
        turns = want.setdefault(x.conv_id, [0, "", ""])
        turns[0] += 1
        turns[1] += f"{x.role}\n{x.text or ''}\n"
        turns[2] += (x.text or "") if x.role == "assistant" else ""
    got = chat.digests(chat.format_turns(chat.as_parts(spark.createDataFrame(rows))), in_order=True).collect()
    assert len(got) == len(want)
    for x in got:
        n, turns, loss = want[x.conv_id]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (n, hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_typed_parts(spark):
    part = lambda **x: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    rows = [
        (1, 1, "user", [part(type="text", text="see <s> "), part(type="image", ref="i.png", width=57, height=28)]),
        (1, 2, "assistant", [part(type="audio", ref="a", seconds=2.0), part(text="heard"), part(type="document", ref="d", pages=2)]),
        (1, 3, "tool", [part(type="image", ref="j", width=1, height=1)]), (2, 1, "user", []), (2, 2, "assistant", None), (2, 3, "user", [part(type="image", ref="k")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").repartition(3)
    got = chat.format_turns(df)
    by = {(x.conv_id, x.turn): x for x in got.collect()}
    whole = "".join(by[1, t].fragment for t in (1, 2, 3))
    assert whole == "<s>[INST] see <\\s> <|image:0|> [/INST]<|assistant|><|audio:1|>heard<|document:2|></s><|role:tool|><|image:3|><|end|>"
    assert whole[by[1, 2].loss_start : by[1, 2].loss_end] == "<|audio:1|>heard<|document:2|>"
    assert [(a.number, a.kind, a.ref, a.tokens) for t in (1, 2, 3) for a in by[1, t].attachments] == [(0, "image", "i.png", 3), (1, "audio", "a", 25), (2, "document", "d", 1024), (3, "image", "j", 1)]
    assert [by[1, t].expanded_tokens for t in (1, 2, 3)] == [3, 1049, 1] and by[2, 3].attachments[0].number == 0
    read = {x.conv_id: x for x in chat.digests(got).collect()}
    assert (read[1].n_turns, read[2].n_turns, read[2].loss_chars) == (3, 3, 0) and read[1].loss_chars == len("<|audio:1|>heard<|document:2|>")


def test_viterbi_by_enumeration():
    r = np.random.default_rng(2)
    n = len(pii.LABELS)
    model = pii.Field({}, np.zeros((0, n)), r.normal(size=(n, n)), r.normal(size=n))
    for size in (1, 2, 3, 4):
        e = r.normal(size=(size, n))

        def score(path, e=e):
            return model.first[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product(range(n), repeat=size), key=score)
        (got,) = pii.viterbi(model, [e])
        assert score(tuple(got)) == pytest.approx(score(best))


def test_added_spans_on_other_sentences(spark):
    """Recall of the field on forms that no pattern finds, in sentences that its own maker doesn't write."""
    r = random.Random(6)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    octet = lambda: str(r.randint(1, 254))
    forms = {
        "email": lambda: f"{r.choice(['anna', 'joe.b', 'k7'])} {r.choice(['[at]', '(at)'])} {r.choice(['mail', 'web'])} {r.choice(['[dot]', '(dot)'])} {r.choice(['com', 'org'])}",
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}/{d(7)}"]),
        "ip": lambda: f"{octet()}[.]{octet()}[.]{octet()}[.]{octet()}",
    }
    frames = ["After lunch she wrote down {} on the back of a receipt.", "Ask for {} if nobody answers", "{} was what the note said", "They told me: {}, nothing else", "please use {} from now on"]
    field = pii.fit(pii.examples(spark))
    for kind, make in forms.items():
        hit = 0
        for _ in range(60):
            said = make()
            text = r.choice(frames).format(said)
            at = text.index(said)
            found = [s for s in pii.all_spans([text], field)[0][1] if s[0] == kind and s[1] < at + len(said) and s[2] > at]
            hit += bool(found)
        assert hit >= (20 if kind == "email" else 36), (kind, hit)
    clean = ["In 1984 the 12 boats left at 7:30 and 45 came back", "Version 3.14.15 of chapter 9 costs 1200 euros", "Rooms 101-104 hold 20 to 25 guests each"]
    assert all(not spans for _, spans in pii.all_spans(clean, field))
