"""Chat formatting with typed content parts.

``Flattener`` visits a turn's parts in order: text is escaped, and each image, audio or document becomes a placeholder
``<|kind:i|>``, numbered through its conversation, its reference and the number of tokens it stands for once expanded
being recorded. ``format_turns`` writes the conversation turn by turn: fragments in order are its text, and the loss mask
lies at offsets of the whole conversation. ``Parser`` is the inverse: it reads that text in pieces of any size and finds
the turns by the template's marks alone.

Inside texts a backslash is doubled and control strings get a backslash after their first character, so that what looks
like a control string in the output is one.

Defined results: null text or role is empty; rows of equal (conversation, turn) follow each other by role and parts,
nulls first, and repeated rows are turns like others; a null conversation or turn counts as one and sorts first; a text
of any length is one turn; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"\\|<(?=/?s>|\|)|\[(?=/?INST\])|\|(?=>)")
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visitor over content parts, dictionaries with ``type`` and what the type needs."""

    patch: int = 28
    audio_tokens_per_second: float = 12.5
    tokens_per_page: int = 512
    first: int = 0
    """number of the first attachment"""
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    text_chars: int = 0

    def visit(self, parts: list[dict] | None) -> Flattener:
        for part in parts or []:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_text)(part)
        return self

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.text_chars += len(text)
        self.out.append(escape(text))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<|{kind}:{self.first + len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})

    def visit_image(self, part: dict) -> None:
        across, down = (-(-int(part.get(k) or self.patch) // self.patch) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round(float(part.get("seconds") or 0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, int(part.get("pages") or 1) * self.tokens_per_page)


def write_turn(role: str, parts: list[dict], first: int = 0) -> tuple[str, int, int, list[dict]]:
    """(fragment, start and end of the loss mask in it, attachments numbered from ``first``)."""
    seen = Flattener(first=first).visit(parts)
    text = "".join(seen.out)
    if role == "user":
        return f"<s>[INST] {text} [/INST]", 0, 0, seen.attachments
    if role == "assistant":
        head = "<|assistant|>"
        return f"{head}{text}</s>", len(head), len(head) + len(text), seen.attachments
    return f"<|role:{escape(role)}|>{text}<|end|>", 0, 0, seen.attachments


#: How a turn begins, whose it is, and how it ends.
MARKS = (("<s>[INST] ", "user", " [/INST]"), ("<|assistant|>", "assistant", "</s>"))


class Parser:
    """Reads a conversation in pieces; keeps only the turn that isn't complete yet."""

    def __init__(self) -> None:
        self.held, self.start = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, where the text starts and ends in the conversation) of each turn that ``piece`` completes; placeholders stay as they are."""
        self.held += piece
        at = 0
        while (turn := self._turn(at)) is not None:
            role, low, high, upto = turn
            yield role, unescape(self.held[low:high]), self.start + low, self.start + high
            at = upto
        self.held, self.start = self.held[at:], self.start + at

    def _turn(self, at: int) -> tuple[str, int, int, int] | None:
        for head, role, tail in MARKS:
            if self.held.startswith(head, at):
                low = at + len(head)
                break
        else:
            close = self.held.find("|>", at) if self.held.startswith("<|role:", at) else -1
            if close < 0:
                return None
            role, low, tail = unescape(self.held[at + len("<|role:") : close]), close + 2, "<|end|>"
        high = self.held.find(tail, low)
        return None if high < 0 else (role, low, high, high + len(tail))


def read_turn(fragment: str) -> tuple[str, str]:
    """(role, text) of one turn."""
    ((role, text, _, _),) = Parser().feed(fragment)
    return role, text


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, place, start, fragment, loss_start, loss_end, attachments, expanded_tokens) of (conv_id, turn, role, parts).

    place: order in the conversation; start, loss_start and loss_end: characters of the conversation before them. Rows
    come out in order, a conversation in one partition, from one exchange; a conversation is never held whole.
    """
    schema = "conv_id long, turn long, place long, start long, fragment string, loss_start long, loss_end long, attachments array<struct<number:int,kind:string,ref:string,tokens:int>>, expanded_tokens long"
    attachment = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(attachment), pa.int64()]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, place, chars, number = object(), 0, 0, 0
        for batch in batches:
            rows = []
            for conv, turn, role, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != conversation:
                    conversation, place, chars, number = conv, 0, 0, 0
                fragment, low, high, attached = write_turn(role or "", parts, number)
                rows.append((conv, turn, place, chars, fragment, chars + low, chars + high, [{"number": number + i, **a} for i, a in enumerate(attached)], sum(a["tokens"] for a in attached)))
                place, chars, number = place + 1, chars + len(fragment), number + len(attached)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    in_turn = turns.select("conv_id", "turn", "role", "parts").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    return in_turn.mapInArrow(run, schema)


def as_parts(turns: DataFrame) -> DataFrame:
    """Plain texts as one text part each."""
    part = F.struct(F.lit("text").alias("type"), "text", *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return turns.select("conv_id", "turn", "role", F.array(part.cast(PART)).alias("parts"))


def digests(fragments: DataFrame, in_order: bool = False) -> DataFrame:
    """A row for each conversation, read back from its text.

    The parser gets the text in pieces cut without regard to turns; digests are updated as turns complete, so that a
    conversation of any length takes little memory. ``in_order``: rows come straight from ``format_turns``.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [f.split()[0] for f in schema.split(", ")]
    piece = 1 << 16

    class Reading:
        def __init__(self, conv) -> None:
            self.conv, self.parser, self.waiting, self.size, self.n = conv, Parser(), [], 0, 0
            self.chars, self.loss_chars, self.turns, self.loss, self.masks = 0, 0, hashlib.sha256(), hashlib.sha256(), []

        def add(self, fragment: str, low: int, high: int) -> None:
            self.waiting.append(fragment)
            self.size += len(fragment)
            self.chars += len(fragment)
            if high > low:
                self.masks.append((low, high))
            if self.size >= piece:
                self.read(whole=False)

        def read(self, whole: bool) -> None:
            text = "".join(self.waiting)
            upto = len(text) if whole else len(text) // piece * piece
            for at in range(0, upto, piece):
                for role, said, low, high in self.parser.feed(text[at : min(at + piece, upto)]):
                    self.n += 1
                    self.turns.update(f"{role}\n{said}\n".encode())
                    if self.masks and self.masks[0] == (low, high):  # the mask covers this turn's text
                        self.masks.pop(0)
                        self.loss.update(said.encode())
                        self.loss_chars += len(said)
            self.waiting, self.size = [text[upto:]], len(text) - upto

        def row(self) -> tuple:
            self.read(whole=True)
            if self.parser.held or self.masks:
                raise ValueError(f"conversation {self.conv}: text or mask that belongs to no turn")
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(columns)], names=names)

        for batch in batches:
            for conv, fragment, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Reading(conv)
                now.add(fragment, low, high)
            if len(done) > 1000:
                yield flush()
        if now is not None:
            done.append(now.row())
        if done:
            yield flush()

    rows = fragments if in_order else fragments.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.select("conv_id", "fragment", "loss_start", "loss_end").mapInArrow(run, schema)
