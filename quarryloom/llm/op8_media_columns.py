"""MPEG transport streams as media columns.

``mux`` stores a payload per row as a transport stream: program tables (PAT, PMT) at each random-access point, the
payload in PES packets with time stamps, continuity counters for each PID. ``demux`` reads such a column back: it
parses the program tables, checks their CRC and the continuity counters, reassembles the elementary packets, and
returns the payload, the time stamps and the random-access points. Both work row by row inside their partition
(no shuffle) on arrays of whole 188-byte packets.

Null text counts as empty (a payload of 192 spaces). Equal texts give equal streams. Rows keep no other columns.
A stream that doesn't parse, whatever is damaged in it, gives a null payload and the reason. A text of any length is one
stream; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

# fixed values of the container format
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID, PROGRAM = 188, 0x47, 0x0000, 0x1000, 0x0100, 0x06, 0xBD, 1
CLOCK = 90_000
#: payload bytes in a PES packet, its duration, PES packets between random-access points
UNIT, UNIT_TICKS, GROUP = 48 * 192, CLOCK // 25, 8
PAD_TO, PAD = 192, 32


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def section(table_id: int, key: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, key >> 8, key & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, sec: bytes) -> np.ndarray:
    data = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + sec
    return np.frombuffer(data.ljust(PACKET, b"\xff"), np.uint8)


PAT = table_packet(PAT_PID, section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = table_packet(PMT_PID, section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 1 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 1 | (pts << 1) & 0xFE])


def unstamp(b) -> int:
    return (int(b[0]) >> 1 & 7) << 30 | int(b[1]) << 22 | (int(b[2]) >> 1) << 15 | int(b[3]) << 7 | int(b[4]) >> 1


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload; the same bytes for the same payload."""
    parts: list[np.ndarray] = []
    counter, tables = 0, 0
    for k, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        body = payload[at : at + UNIT]
        pts = k * UNIT_TICKS
        rap = k % GROUP == 0
        if rap:
            for p in (PAT, PMT):
                own = p.copy()
                own[3] |= tables & 15
                parts.append(own[None])
            tables += 1
        pes = np.frombuffer(b"\0\0\1" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(pts) + body, np.uint8)
        lead = 8 if rap else 0  # an adaptation field with the clock
        n = -(-(len(pes) + lead) // 184)
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        fill = n * 184 - len(pes) - lead  # stuffing, in the last packet's adaptation field
        start = np.full(n, 4)
        if rap:
            base = pts
            out[0, 3] |= 0x20
            out[0, 4:12] = [7, 0x50, base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0]
            start[0] = 12
        if fill:
            last = n - 1
            out[last, 3] |= 0x20
            if start[last] > 4:  # it has a field already: lengthen it
                out[last, 4] += fill
            else:
                out[last, 4] = fill - 1
                if fill > 1:
                    out[last, 5] = 0
            start[last] += fill
        out[np.arange(PACKET) >= start[:, None]] = pes
        parts.append(out)
    return np.concatenate(parts).tobytes()


class Broken(ValueError):
    pass


def read_section(packet: np.ndarray, table_id: int) -> bytes:
    at = 5 + int(packet[4])
    if at + 3 > PACKET or packet[3] & 0x30 != 0x10:
        raise Broken("bad table")
    size = 3 + ((int(packet[at + 1]) & 0x0F) << 8 | int(packet[at + 2]))
    sec = packet[at : at + size].tobytes()
    if sec[0] != table_id or len(sec) != size or size < 12:
        raise Broken("bad table")
    return sec


_SEEN: dict[bytes, bool] = {}


def checked(sec: bytes) -> bytes:
    if sec not in _SEEN:
        if len(_SEEN) > 64:
            _SEEN.clear()
        _SEEN[sec] = crc32_mpeg(sec) == 0
    if not _SEEN[sec]:
        raise Broken("table crc")
    return sec


def demux(media: bytes) -> tuple[bytes, dict]:
    """(payload, facts) of a stream: program, streams, PES count, time stamps, random-access points (pts, packet)."""
    if not media or len(media) % PACKET:
        raise Broken("not whole packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise Broken("sync byte")
    pid = (p[:, 1] & 0x1F).astype(np.int32) << 8 | p[:, 2]
    tables = np.flatnonzero(pid == PAT_PID)
    if not len(tables):
        raise Broken("no program table")
    programs = {}
    for i in tables:
        sec = checked(read_section(p[i], 0))
        for j in range(8, len(sec) - 4, 4):
            programs[int.from_bytes(sec[j : j + 2], "big")] = int.from_bytes(sec[j + 2 : j + 4], "big") & 0x1FFF
    if not programs:
        raise Broken("no program")
    program, map_pid = min(programs.items())
    streams = {}
    for i in np.flatnonzero(pid == map_pid):
        sec = checked(read_section(p[i], 2))
        j = 12 + (int.from_bytes(sec[10:12], "big") & 0xFFF)
        while j < len(sec) - 4:
            streams[int.from_bytes(sec[j + 1 : j + 3], "big") & 0x1FFF] = sec[j]
            j += 5 + (int.from_bytes(sec[j + 3 : j + 5], "big") & 0xFFF)
    if not streams:
        raise Broken("no elementary stream")
    es = min(streams)
    own = np.flatnonzero(pid == es)
    q = p[own]
    for each in (q, p[tables], p[pid == map_pid]):
        if (np.diff(each[:, 3] & 15) % 16 != 1).any() or (len(each) and each[0, 3] & 15):
            raise Broken("continuity counter")
    extra = (q[:, 3] & 0x20) > 0
    start = np.where(extra, 5 + q[:, 4].astype(np.int64), 4)
    flags = np.where(extra & (q[:, 4] > 0), q[:, 5], 0)
    if (start > PACKET).any() or not (q[:, 3] & 0x10).all():
        raise Broken("adaptation field")
    held = PACKET - start
    data = q[np.arange(PACKET) >= start[:, None]]
    first = np.flatnonzero(q[:, 1] & 0x40)
    if not len(first) or first[0]:
        raise Broken("no unit start")
    at = np.concatenate([[0], np.cumsum(held)])
    ends = np.append(at[first[1:]], at[-1])
    out, stamps, points = [], [], []
    for i, a, b in zip(first.tolist(), at[first].tolist(), ends.tolist(), strict=True):
        head = data[a : a + 14]
        if len(head) < 14 or head[:3].tolist() != [0, 0, 1] or (int(head[4]) << 8 | int(head[5])) != b - a - 6 or not head[7] & 0x80:
            raise Broken("elementary packet")
        if 9 + int(head[8]) > b - a or head[8] < 5:
            raise Broken("elementary packet")
        stamps.append(unstamp(head[9:14]))
        if flags[i] & 0x40:
            points.append((stamps[-1], int(own[i])))
        out.append(data[a + 9 + int(head[8]) : b])
    return b"".join(x.tobytes() for x in out), {"program": program, "stream": es, "kind": streams[es], "packets": len(p), "stamps": stamps, "points": points}


def padded(text: bytes) -> bytes:
    return text.ljust(max(PAD_TO, -(-len(text) // PAD_TO) * PAD_TO), bytes([PAD]))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in text_slices(batch):
                data = raw.tobytes()
                media = [mux(padded(data[a:b])) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, payload binary, media binary, program int, stream int, kind int, packets int, time_stamps array<long>, access_points array<struct<pts:long,packet:int>>, problem string"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read(stored: DataFrame, digests_only: bool = False) -> DataFrame:
    """A media column read back: payload, tables, time stamps and random-access points, or only their digests."""

    def one(doc_id, n, media):
        try:
            payload, x = demux(media or b"")
            problem = None
        except Broken as e:
            payload, x, problem = None, {}, str(e)
        if not digests_only:
            return (doc_id, n, payload, media, x.get("program"), x.get("stream"), x.get("kind"), x.get("packets"), x.get("stamps", []), [{"pts": a, "packet": b} for a, b in x.get("points", [])], problem)
        if problem:
            return (doc_id, n, None, None, None, len(media or b""), hashlib.sha256(media or b"").hexdigest(), f"broken: {problem}")
        feature = f"program={x['program']} pid={x['stream']} type={x['kind']} packets={x['packets']} units={len(x['stamps'])} pts={x['stamps'][0]}..{x['stamps'][-1]} access={len(x['points'])}@{x['points'][-1][1] if x['points'] else '-'}"
        return (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)

    schema = DIGEST if digests_only else READ
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<struct<pts:long,packet:int>>": pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int32())]))}
    fields = [x.split(" ", 1) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                rows = [one(d, n, m.as_py()) for d, n, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    return stored.select("doc_id", "n_bytes", F.col("media").cast("binary").alias("media")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(store(table(spark, sf_dir, "documents")), digests_only=True)
