"""Personal data: four patterns, and a linear-chain conditional random field over word shapes for what they miss.

The field labels white-separated words B/I/O for e-mail, IP, card and phone. It is trained by gradient ascent from a
small table of labelled sentences (``examples``) and sees stretches of text around words with a digit or an at sign; none
of the four kinds is without one. Batches of stretches are decoded by Viterbi in numpy. A decoded span is added if it
keeps its kind's rule (Luhn for cards, parts up to 255, digits of a phone, an address shape) and meets no other span;
spans of the patterns always stay.

Positions are code points, ends exclusive. Defined results: null text is empty and has no span; rows stay apart even if
they repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
REACH = 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The pattern for ``ip``; possessive repeats and the look-behind only save hopeless starts within one run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[\[(]at[\])]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that don't overlap in it, without those that break the kind's rule."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shape(word: str) -> str:
    """Runs of digits with their length up to 5, of letters without; other characters as they are."""
    out, i = [], 0
    while i < len(word):
        c, j = word[i], i
        if "0" <= c <= "9":
            while j < len(word) and "0" <= word[j] <= "9":
                j += 1
            out.append(f"9{min(j - i, 5)}")
        elif c.isalpha():
            while j < len(word) and word[j].isalpha():
                j += 1
            out.append("A" if c.isupper() else "a")
        else:
            j = i + 1
            out.append(c)
        i = j
    return "".join(out)


def coarse(word: str) -> str:
    """The shape without the lengths of its runs of digits, and letters with digits behind them as letters."""
    return re.sub(r"a9", "a", re.sub(r"9[1-5]", "9", shape(word)))


_CUES = frozenset("at dot call phone tel mobile fax email mail e-mail contact card visa number ip host server address ping [at] (at) [dot] (dot)".split())


def features(words: list[str], i: int) -> list[str]:
    def at(j: int, kind: str) -> str:
        if not 0 <= j < len(words):
            return f"{kind}=#"
        if kind[0] == "s":
            return f"{kind}={shape(words[j])}"
        low = words[j].lower().strip(".,:;")
        return f"{kind}={low if low in _CUES else '-'}"

    word = words[i]
    n = sum("0" <= c <= "9" for c in word)
    return ["1", at(i, "s0"), at(i - 1, "s-1"), at(i + 1, "s+1"), at(i, "w0"), at(i - 1, "w-1"), at(i + 1, "w+1"), f"n={min(n, 20)}", f"@={'@' in word}", f".={min(word.count('.'), 4)}", f"+={word[:1] == '+'}", f"(={word[:1] == '('}", f"c={coarse(word)}"]


@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for i in range(len(words)):
            out[i] = self.weights[[k for f in features(words, i) if (k := self.names.get(f)) is not None]].sum(axis=0)
        return out


def sentences(n: int = 400, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The labelled table's rows: sentences of (word, label), made from a fixed seed."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9)))

    def card() -> str:
        d = r.choice("3456") + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def entity() -> tuple[str, list[str]]:
        kind = r.choice(KINDS)
        if kind == "email":
            user, host, top = word() + r.choice(["", num(r.randint(1, 7))]), word() + r.choice(["", "", num(r.randint(1, 5))]), r.choice(["com", "org", "net", "de"])
            return kind, r.choice([[f"{user}@{host}.{top}"], [user, "[at]", host, "[dot]", top], [user, "(at)", host, "(dot)", top], [f"{user}[at]{host}.{top}"], [f"{user}(at){host}.{top}"], [user, "@", f"{host}.{top}"]])
        if kind == "ip":
            p = [str(r.randint(0, 255)) for _ in range(4)]
            return kind, r.choice([[".".join(p)], ["[.]".join(p)], ["(.)".join(p)]])
        if kind == "card":
            d = card()
            four = [d[i : i + 4] for i in range(0, 16, 4)]
            return kind, r.choice([[d], four, ["-".join(four)], [".".join(four)], ["/".join(four)]])
        a, b, c = num(3), num(3), num(4)
        return kind, r.choice([[f"+{num(1)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"00{num(2)}", a, b, c], [f"+{num(2)}", a, f"{b}{c}"]])

    def other() -> list[str]:
        return r.choice([
            [f"{num(4)}-0{r.randint(1, 9)}-{r.randint(10, 28)}"], [f"{r.randint(0, 23)}:{num(2)}"], [f"${num(2)}.{num(2)}"], [num(r.randint(1, 12))], [f"v{num(1)}.{num(1)}.{num(1)}"], [f"{num(2)}%"],
            [f"{num(1)},{num(3)}"], ["token", "=", f'"{num(2)}{word()}{num(4)}{word()}{num(3)}"'], [f"{word()}{num(r.randint(1, 7))}"], [f"({num(4)})"], [f"{num(2)}/{num(2)}/{num(4)}"], ["@", word()], [f"@{word()}"], [f"{num(1)}.{num(2)}"],
            [num(3), num(2)], [f"{num(3)}-{num(4)}"], [f"#{num(3)}"], [f"http://{word()}.com/{num(3)}"], [f"{word()}@{word()}"], [num(2), num(2), num(2)], [f"{num(16)}{r.choice('abc')}"],
        ])

    out = []
    for _ in range(n):
        row: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 3)):
            row += [(r.choice([word(), word().title(), r.choice(sorted(_CUES))]), "O") for _ in range(r.randint(1, 4))]
            if r.random() < 0.55:
                kind, parts = entity()
                if r.random() < 0.3:
                    parts = [*parts[:-1], parts[-1] + r.choice(".,;")]
                row += [(p, f"{'I' if i else 'B'}-{kind}") for i, p in enumerate(parts)]
            else:
                row += [(p, "O") for p in other()]
        row += [(word(), "O") for _ in range(r.randint(0, 3))]
        out.append(row)
    return out


def examples(spark: SparkSession, n: int = 400) -> DataFrame:
    """The small labelled table: (sentence, words, labels)."""
    rows = [(i, [w for w, _ in s], [t for _, t in s]) for i, s in enumerate(sentences(n))]
    return spark.createDataFrame(rows, "sentence int, words array<string>, labels array<string>")


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(table: DataFrame, rounds: int = 120, rate: float = 0.5, decay: float = 1e-3, most_rows: int = 5000) -> Field:
    """Maximum likelihood from at most ``most_rows`` labelled sentences (a parameter, as the table is small by design)."""
    rows = table.orderBy("sentence").limit(most_rows).collect()
    names: dict[str, int] = {}
    sent = [[[names.setdefault(f, len(names)) for f in features(r["words"], i)] for i in range(len(r["words"]))] for r in rows]
    L, T, F_ = len(LABELS), max((len(s) for s in sent), default=1), len(sent[0][0]) if sent else 1
    ids = np.zeros((len(sent), T, F_), np.int64)
    gold, mask = np.zeros((len(sent), T), np.int64), np.zeros((len(sent), T), bool)
    for i, (s, r) in enumerate(zip(sent, rows, strict=True)):
        ids[i, : len(s)], gold[i, : len(s)], mask[i, : len(s)] = s, [LABELS.index(t) for t in r["labels"]], True
    model = Field(names, np.zeros((max(1, len(names)), L)), np.zeros((L, L)), np.zeros(L))
    seen = [np.full_like(x, 1e-8) for x in (model.weights, model.moves, model.first)]
    n = np.arange(len(sent))
    for _ in range(rounds if sent else 0):
        e = model.weights[ids].sum(axis=2)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = model.first + e[:, 0]
        for t in range(1, T):
            forward[:, t] = np.where(mask[:, t, None], _logsum(forward[:, t - 1, :, None] + model.moves, 1) + e[:, t], forward[:, t - 1])
        for t in range(T - 2, -1, -1):
            step = _logsum(model.moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = _logsum(forward[:, -1], 1)
        p = np.where(mask[..., None], np.exp(forward + backward - total[:, None, None]), 0)
        truth = np.eye(L)[gold] * mask[..., None]
        gap = truth - p
        g_weights = np.zeros_like(model.weights)
        for f in range(F_):
            np.add.at(g_weights, ids[:, :, f], gap)
        g_moves = np.zeros((L, L))
        for t in range(1, T):
            live = mask[:, t]
            both = np.exp(forward[live, t - 1, :, None] + model.moves + (e[live, t] + backward[live, t])[:, None, :] - total[live, None, None])
            np.add.at(g_moves, (gold[live, t - 1], gold[live, t]), 1)
            g_moves -= both.sum(axis=0)
        g_first = gap[n, 0].sum(axis=0)
        for x, g, s in ((model.weights, g_weights, seen[0]), (model.moves, g_moves, seen[1]), (model.first, g_first, seen[2])):
            g = g - decay * len(sent) * x / 10
            s += g * g
            x += rate * g / np.sqrt(s)
    return model


def viterbi(model: Field, emissions: list[np.ndarray], cells: int = 1 << 20) -> list[np.ndarray]:
    """Best labels of each stretch; stretches of like length are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
    order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
    while order:
        longest = len(emissions[order[-1]])
        take = order[-max(1, cells // (longest * len(LABELS))) :]
        del order[-len(take) :]
        size = np.array([len(emissions[i]) for i in take])
        e = np.zeros((len(take), longest, len(LABELS)))
        for k, i in enumerate(take):
            e[k, : size[k]] = emissions[i]
        back = np.zeros((longest, len(take), len(LABELS)), np.int8)
        best = model.first + e[:, 0]
        keep = np.tile(np.arange(len(LABELS), dtype=np.int8), (len(take), 1))
        for t in range(1, longest):
            step = best[:, :, None] + model.moves
            live = (t < size)[:, None]
            back[t] = np.where(live, step.argmax(axis=1), keep)
            best = np.where(live, step.max(axis=1) + e[:, t], best)
        path = np.zeros((len(take), longest), np.int64)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(take))
        for t in range(longest - 1, 0, -1):
            path[:, t - 1] = back[t, rows, path[:, t]]
        for k, i in enumerate(take):
            out[i] = path[k, : size[k]]
    return out


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Word bounds around hints, ``REACH`` words to each side; near ones are one stretch."""
    out: list[list[tuple[int, int]]] = []
    end_seen = -1
    for m in _HINT.finditer(text):
        if m.start() < end_seen:
            continue
        a = m.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        while b < len(text) and not text[b].isspace():
            b += 1
        end_seen = b
        left, at = [], a
        floor = out[-1][-1][1] if out else 0
        while len(left) < REACH and at > floor:
            at -= 1
            while at >= floor and text[at].isspace():
                at -= 1
            if at < floor:
                break
            stop = at + 1
            while at > floor and not text[at - 1].isspace():
                at -= 1
            left.append((at, stop))
        own = [*reversed(left), (a, b)]
        if out and a < floor:  # within the words to the right of the last hint
            own = []
        right = [(w.start(), w.end()) for _, w in zip(range(REACH), _WORD.finditer(text, b), strict=False)]
        if out and (a < floor or len(left) < REACH or (left and left[-1][0] <= floor)):
            last = out[-1]
            for w in [*own, *right]:
                if w[0] >= last[-1][1]:
                    last.append(w)
        else:
            out.append([*own, *right])
    return out


_EDGE = ".,;:!?\"'<>{}"


def spans_of(text: str, words: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Decoded spans, without punctuation at their ends, that keep their kind's rule."""
    out, i = [], 0
    while i < len(words):
        name = LABELS[labels[i]]
        if name == "O":
            i += 1
            continue
        j = i + 1
        while j < len(words) and LABELS[labels[j]] == f"I-{name[2:]}":
            j += 1
        start, end = words[i][0], words[j - 1][1]
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while start < end and text[start] in _EDGE:
            start += 1
        if plausible(name[2:], text[start:end]):
            out.append((name[2:], start, end))
        i = j
    return out


def plausible(kind: str, text: str) -> bool:
    d = _digits(text)
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z]", text)
    if kind == "ip":
        parts = re.split(r"\[\.\]|\(\.\)|\.", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[:4]) <= 255 for p in parts)
    if kind == "phone":
        return 10 <= len(d) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9().\x20/-]*[0-9]", text) is not None and re.search(r"[-.()\x20/]", text) is not None
    return re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]+)+", text) is not None


def all_spans(texts: list[str], model: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(pattern spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    where, found, cache = [], [], {}
    for i, text in enumerate(texts):
        for words in stretches(text):
            tokens = [text[a:b] for a, b in words]
            where.append((i, words))
            key = tuple(tokens)
            if key not in cache:
                cache[key] = model.emissions(tokens)
            found.append(cache[key])
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, words), labels in zip(where, viterbi(model, found), strict=True):
        added[i] += spans_of(texts[i], words, labels)
    out = []
    for own, more in zip(base, added, strict=True):
        free = _outside(more, own) if more else []
        out.append((own, in_order([*own, *free])))
    return out


def _outside(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The ``spans`` that overlap none of ``taken``."""
    starts, ends = [], []
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [s for s in spans if not ((i := bisect.bisect_right(ends, s[1])) < len(starts) and starts[i] < s[2])]


def find(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the counts are those of the patterns."""
    import hashlib

    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = all_spans([t or "" for t in part.column(1).to_pylist()], shipped.value)
                counts = [pa.array([sum(s[0] == k for s in own) for own, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([joined(a) for _, a in found], pa.string()), pa.array([len(a) - len(o) for o, a in found], pa.int64())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; overlapping spans become one. ``n_chars``, where present, follows the text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for kind, a, b in spans:
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = part.column(columns.index("text")).to_pylist()
                new = [None if t is None else clean(t, spans) for t, (_, spans) in zip(texts, all_spans([t or "" for t in texts], shipped.value), strict=True)]
                arrays = list(part.columns)
                arrays[columns.index("text")] = pa.array(new, pa.string())
                if "n_chars" in columns:
                    at = columns.index("n_chars")
                    arrays[at] = pa.array([old if t is None else len(t) for t, old in zip(new, arrays[at].to_pylist(), strict=True)], arrays[at].type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, docs.schema)
