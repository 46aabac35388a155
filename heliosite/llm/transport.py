"""MPEG transport streams: elementary packets in 188-byte packets with program tables, and back.

``mux`` writes a program association table, a program map table and packetised elementary stream (PES) packets of up to
``FRAMES`` frames; each begins at a random-access point with clock reference and presentation time. ``demux`` finds the
stream through the tables, checks the continuity counters, reassembles the packets and lists their times and which of
them are random-access points.

Defined results: null text is empty; any payload is padded with bytes 255 to a positive multiple of ``FRAME``. Equal
texts give equal bytes. Rows stay apart even if they repeat; an empty table gives an empty result; other columns are ignored.
In streams made elsewhere, a packet sent twice counts once, as the standard allows one copy, and tables may take many packets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FRAME = 576
FRAMES = 64
PACKET, BODY = 188, 184
PAT_PID, PMT_PID, ES_PID = 0, 0x100, 0x101
#: Presentation units (90 kHz) of a frame: 40 ms.
TICKS = 3600
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06


def mpeg_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    size = len(body) + 9
    head = bytes([table, 0xB0 | size >> 8, size & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + mpeg_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8).copy()


PAT = _table_packet(PAT_PID, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
PMT = _table_packet(PMT_PID, _section(2, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])))


def _pes(payload: bytes, pts: int) -> bytes:
    size = len(payload) + 8
    time = bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 255, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 255, 0x01 | (pts << 1) & 0xFE])
    return bytes([0, 0, 1, PRIVATE_STREAM, size >> 8, size & 255, 0x84, 0x80, 5]) + time + payload


def mux(payload: bytes) -> bytes:
    """``payload``, a multiple of ``FRAME`` bytes, as a transport stream."""
    out = [PAT, PMT]
    counter = 0
    for first in range(0, len(payload), FRAME * FRAMES):
        pts = first // FRAME * TICKS
        data = np.frombuffer(_pes(payload[first : first + FRAME * FRAMES], pts), np.uint8)
        n = 1 + max(0, -(-(len(data) - (BODY - 8)) // BODY))
        stuffing = BODY * n - 8 - len(data)
        packets = np.full((n, PACKET), 255, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        field = np.zeros(n, np.int64)  # bytes of adaptation field, its length byte included
        field[-1] = stuffing
        field[0] += 8
        packets[field > 0, 3] |= 0x20
        packets[field > 0, 4] = field[field > 0] - 1
        packets[field > 1, 5] = 0
        packets[0, 5] = 0x50
        packets[0, 6:12] = [pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, 0]
        room = np.arange(PACKET) >= 4 + field[:, None]
        packets[room] = data
        out.append(packets.ravel())
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    payload: bytes
    times: list[int]
    random_access: list[bool]
    lost: int
    packets: int


def _first_copies(packets: np.ndarray) -> np.ndarray:
    """Packets of one PID without the second copies that the standard allows: a packet with payload sent again right after, all bytes but its clock alike."""
    if len(packets) < 2:
        return packets
    same = packets[1:] == packets[:-1]
    clocked = (packets[1:, 3] & 0x20 > 0) & (packets[1:, 4] >= 7) & (packets[1:, 5] & 0x10 > 0)
    same[clocked, 6:12] = True
    again = np.append(False, same.all(axis=1) & (packets[1:, 3] & 0x10 > 0))
    again[1:] &= ~again[:-1]  # a third one isn't legal
    return packets[~again]


def _sections(packets: np.ndarray, pid: int, pids: np.ndarray) -> Iterator[bytes]:
    """Whole sections of a table, however many packets one takes or shares; those whose CRC fails are left out."""
    held = None  # bytes of a section that isn't whole yet
    for packet in _first_copies(packets[pids == pid]):
        if not packet[3] & 0x10:
            continue
        body = packet[4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0) :].tobytes()
        if packet[1] & 0x40 and body:  # a section begins here; what stands before it ends the last one
            yield from _whole((held or b"") + body[1 : 1 + body[0]])[0]
            held = body[1 + body[0] :]
        elif held is not None:
            held += body
        if held is not None:
            found, held = _whole(held)
            yield from found


def _whole(held: bytes) -> tuple[list[bytes], bytes]:
    """(the complete sections at the start of ``held``, what is left); stuffing ends it."""
    found = []
    while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 15) << 8 | held[2])):
        if size >= 16 and mpeg_crc(held[:size]) == 0:
            found.append(held[:size])
        held = held[size:]
    return found, b"" if held[:1] == b"\xff" else held


def demux(media: bytes) -> Stream:
    """The first elementary stream of the first program. Packets whose continuity counter breaks the run are counted as lost."""
    packets = np.frombuffer(media, np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    packets = packets[(packets[:, 0] == 0x47) & (packets[:, 1] & 0x80 == 0)]
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    es = -1
    for pat in _sections(packets, PAT_PID, pids):
        programs = [(pat[i + 2] & 31) << 8 | pat[i + 3] for i in range(8, len(pat) - 4, 4) if pat[i] or pat[i + 1]]  # number 0 names the network
        if not programs:
            continue
        pmt_pid = programs[0]
        for pmt in _sections(packets, pmt_pid, pids):
            at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
            es = (pmt[at + 1] & 31) << 8 | pmt[at + 2]
            break
        break
    own = _first_copies(packets[pids == es])
    counter = own[:, 3] & 15
    carries = own[:, 3] & 0x10 > 0
    lost = int(((counter[1:].astype(int) - counter[:-1]) % 16 != carries[1:]).sum())
    field = np.where(own[:, 3] & 0x20 > 0, own[:, 4].astype(np.int64) + 1, 0)
    field[~carries] = BODY
    body = own[np.arange(PACKET) >= 4 + field[:, None]]
    ends = np.cumsum(BODY - field)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    access = (own[starts, 3] & 0x20 > 0) & (own[starts, 4] > 0) & (own[starts, 5] & 0x40 > 0)
    bounds = [*(ends[starts] - (BODY - field[starts])).tolist(), len(body)]
    parts, times = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        pes = body[a:b].tobytes()
        if len(pes) < 14 or pes[:3] != b"\0\0\1" or len(pes) < 9 + pes[8]:
            lost += 1  # cut off within its header
            continue
        size = pes[4] << 8 | pes[5]
        parts.append(pes[9 + pes[8] : 6 + size])
        times.append((pes[9] & 0x0E) << 29 | pes[10] << 22 | (pes[11] & 0xFE) << 14 | pes[12] << 7 | pes[13] >> 1 if pes[7] & 0x80 else -1)
    return Stream(b"".join(parts), times, access.tolist(), lost, len(packets))


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a transport stream in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, text in enumerate(batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                held.append((i, len(raw), mux(payload_of(raw))))
                size += len(raw)
                if size > 1 << 23 or i + 1 == batch.num_rows:
                    rows, sizes, media = zip(*held, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[rows[0] : rows[-1] + 1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    held, size = [], 0

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: digests, and packets, lost ones, PES packets, times and random-access points.

    Null media count as no bytes. Media without a program, or cut off, give what can be read: an empty payload and null times if that is nothing.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, first_pts long, last_pts long, random_access_points long"
    kinds = [pa.string() if i in (3, 6, 7) else pa.int64() for i in range(11)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = media.as_buffer().to_pybytes() if media.is_valid else b""
                s = demux(raw)
                points, first, last = sum(s.random_access), *((s.times[0], s.times[-1]) if s.times else (None, None))
                feature = f"packets={s.packets};lost={s.lost};pes={len(s.times)};pts={first}-{last};access={points}"
                rows.append((doc_id, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, first, last, points))
            columns = list(zip(*rows, strict=True)) or [[]] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
