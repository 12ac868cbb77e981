"""Media columns: MPEG transport streams.

`store_streams` wraps bytes in a transport stream (program association and map tables, elementary packets with
presentation times, a clock reference and a random-access mark on every sixteenth access unit); `read_streams`
parses stored streams: program tables with their checksums, continuity counters, reassembled elementary packets,
timestamps and random-access points. Both are one narrow pass, so a lost executor costs its own partitions only.

Defined cases: null media gives null results, an empty stream has no packets, bytes without a sync byte are
skipped to the next one and counted, repeated packets are counted and dropped, a counter gap is counted and the
unit that it cuts is marked incomplete. Null text is stored as empty text; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm.shared import table

PACKET = 188
UNIT = 576  #: payloads are padded to a multiple of this
ACCESS_UNIT = 8 * UNIT  #: bytes of one elementary packet
TICKS = 3600  #: of the 90 kHz clock from one access unit to the next
ACCESS_EVERY = 16  #: access units from one random-access point to the next
PMT_PID, STREAM_PID, PRIVATE_DATA = 0x1000, 0x101, 0x06


@lru_cache(4096)
def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its checksum."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return (x := head + body) + section_crc(x).to_bytes(4, "big")


@lru_cache(64)
def _table_packet(pid: int, counter: int) -> bytes:
    if pid:
        body = bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0, PRIVATE_DATA, 0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0])
        section = _section(2, 1, body)
    else:
        section = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | (ticks >> 29 & 14) | 1, ticks >> 22 & 255, (ticks >> 14 & 254) | 1, ticks >> 7 & 255, (ticks << 1 & 254) | 1])


_HEAD = [bytes([0x47, STREAM_PID >> 8, STREAM_PID & 255, 0x10 | c]) for c in range(16)]


def mux(payload: bytes) -> bytes:
    """A single-program transport stream that carries payload as private data, one elementary packet for each access unit."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        unit, ticks = payload[at : at + ACCESS_UNIT], (k + 1) * TICKS & 0x1FFFFFFFF
        pes = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, ticks) + unit
        extra = b""
        if k % ACCESS_EVERY == 0:
            out += _table_packet(0, tables), _table_packet(PMT_PID, tables)
            tables = (tables + 1) & 15
            base = ticks - TICKS
            extra = bytes([0x50, base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0])
        start, left = 0x40, 0
        while left < len(pes):
            room = 184 - (len(extra) + 1 if extra else 0)
            body = pes[left : left + room]
            if extra or len(body) < room:
                size = 183 - len(body)
                flags = (extra or b"\x00") if size else b""
                out += bytes([0x47, start | STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter, size]), flags.ljust(size, b"\xff"), body
            elif start:
                out += bytes([0x47, start | STREAM_PID >> 8, STREAM_PID & 255, 0x10 | counter]), body
            else:
                out += _HEAD[counter], body
            counter, left, start, extra = (counter + 1) & 15, left + len(body), 0, b""
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet."""

    pid: int
    packet: int  #: where it begins, in packets
    access: bool = False
    pts: int | None = None
    dts: int | None = None
    parts: list = field(default_factory=list)
    data: bytes = b""
    whole: bool = True


@dataclass
class Stream:
    packets: int = 0
    skipped: int = 0
    gaps: int = 0
    repeats: int = 0
    bad_sections: int = 0
    programs: dict = field(default_factory=dict)
    streams: dict = field(default_factory=dict)
    clocks: int = 0
    units: list = field(default_factory=list)

    def payload(self) -> bytes:
        return b"".join(u.data for u in self.units)


def _ticks(x: bytes) -> int:
    return (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1


def _close(unit: Unit) -> None:
    pes = b"".join(unit.parts)
    unit.parts = []
    if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
        unit.whole = False
        return
    size, flags, head = int.from_bytes(pes[4:6], "big"), pes[7] >> 6, pes[8]
    if flags & 2 and len(pes) >= 14:
        unit.pts = _ticks(pes[9:14])
        unit.dts = _ticks(pes[14:19]) if flags == 3 and len(pes) >= 19 else unit.pts
    end = 6 + size if size else len(pes)
    unit.whole &= len(pes) >= end
    unit.data = pes[9 + head : end]


def _tables(out: Stream, pid: int, data: bytes) -> None:
    section = data[1 + data[0] :] if data else b""
    if len(section) < 12:
        return
    section = section[: 3 + ((section[1] & 15) << 8 | section[2])]
    if section_crc(section):
        out.bad_sections += 1
    elif section[0] == 0 and pid == 0:
        out.programs |= {section[i] << 8 | section[i + 1]: (section[i + 2] & 31) << 8 | section[i + 3] for i in range(8, len(section) - 4, 4) if section[i] or section[i + 1]}
    elif section[0] == 2:
        i = 12 + ((section[10] & 15) << 8 | section[11])
        while i + 5 <= len(section) - 4:
            out.streams[(section[i + 1] & 31) << 8 | section[i + 2]] = section[i]
            i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])


def demux(stream: bytes) -> Stream:
    out = Stream()
    counters: dict[int, int] = {}
    running: dict[int, Unit] = {}
    maps: set[int] = set()
    at, end = 0, len(stream) - PACKET
    while at <= end:
        if stream[at] != 0x47:
            nxt = stream.find(b"\x47", at)
            nxt = nxt if nxt >= 0 else len(stream)
            out.skipped += nxt - at
            at = nxt
            continue
        b1, control = stream[at + 1], stream[at + 3]
        pid, number = (b1 & 31) << 8 | stream[at + 2], out.packets
        out.packets += 1
        begin, stop, access = at + 4, at + PACKET, False
        if control & 0x20:
            size = stream[begin]
            if size:
                access = bool(stream[begin + 1] & 0x40)
                out.clocks += stream[begin + 1] >> 4 & 1
            begin += 1 + size
        at = stop
        if b1 & 0x80 or pid == 0x1FFF or not control & 0x10:
            continue
        before, now = counters.get(pid), control & 15
        counters[pid] = now
        if before is not None and now != (before + 1) & 15:
            if now == before:
                out.repeats += 1
                continue
            out.gaps += 1
            if pid in running:
                running[pid].whole = False
        if pid == 0 or pid in maps:
            if b1 & 0x40:
                _tables(out, pid, stream[begin:stop])
                maps.update(out.programs.values())
        elif pid in out.streams:
            if b1 & 0x40:
                if pid in running:
                    _close(running[pid])
                out.units.append(u := Unit(pid, number, access))
                running[pid] = u
                u.parts.append(stream[begin:stop])
            elif pid in running:
                running[pid].parts.append(stream[begin:stop])
    out.skipped += len(stream) - at
    for u in running.values():
        _close(u)
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\xff")


def store_streams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded, as a transport stream. Other columns of docs are left out."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                both = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([mux(x) for _, x in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


SUMMARY = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, access_points array<struct<pts:long,packet:long>>"


def summary(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 8
    s = demux(media)
    data, points = s.payload(), [{"pts": u.pts, "packet": u.packet} for u in s.units if u.access]
    pts = [u.pts for u in s.units]
    feature = ";".join(
        f"{k}={v}"
        for k, v in (("programs", len(s.programs)), ("streams", ",".join(f"{p}:{t}" for p, t in sorted(s.streams.items()))), ("packets", s.packets), ("units", len(s.units)), ("broken", sum(not u.whole for u in s.units)), ("gaps", s.gaps), ("repeats", s.repeats), ("bad_sections", s.bad_sections), ("skipped", s.skipped), ("clocks", s.clocks), ("access_points", len(points)), ("first_pts", pts[0] if pts else ""), ("last_pts", pts[-1] if pts else ""))
    )
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, pts, points


def read_streams(stored: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and what each stored stream holds: digests of the reassembled payload and of the stored form, table and counter findings, presentation times of the access units, random-access points."""
    rows = stored.select(*keep, F.col(media).alias("media"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))]
        names = [x.split()[0] for x in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "access_points")]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [summary(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(keep))), *(pa.array([f[j] for f in found], t) for j, t in enumerate(types))], [*keep, *names])

    return rows.mapInArrow(run, f"{kinds}, {SUMMARY}")


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_streams(store_streams(table(spark, sf_dir, "documents")), keep=("doc_id", "n_bytes"))
