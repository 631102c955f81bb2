"""Operator 6: media columns of MPEG transport streams.

A payload of 8-bit samples is cut into access units. Each unit is an elementary packet (PES) with a time stamp, and is
dealt over transport packets of 188 bytes with continuity counters; the first one of each RANDOM_EVERY units is marked as
a random-access point and carries a clock reference. A program association table and a program map table come first.

The reader trusts none of that: it parses both tables and their checksums, checks the continuity counter of each packet,
reassembles the elementary packets and collects time stamps and random-access points.

Edge cases: a null text is an empty payload, padded like any other to a positive multiple of 64 bytes; equal texts give
equal streams; a stream with a lost, repeated or damaged packet raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, pieces, stored

# Fixed values of the transport-stream format.
PACKET, SYNC, PAT_PID, STREAM_PRIVATE, STREAM_TYPE_PRIVATE, CLOCK = 188, 0x47, 0x0000, 0xBD, 0x06, 90_000
PMT_PID, MEDIA_PID, PROGRAM = 0x0100, 0x0101, 1
UNIT_BYTES, RANDOM_EVERY, SAMPLES_PER_SECOND = 4096, 4, 8000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def table_crc(data: bytes) -> int:
    """The 32-bit check value of program tables."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    data = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    data += table_crc(data).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + data).ljust(PACKET, b"\xff")


_TABLES = _section(PAT_PID, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _section(
    PMT_PID, 2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE_PRIVATE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _stamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, (t >> 14) & 0xFE | 1, (t >> 7) & 0xFF, (t << 1) & 0xFE | 1])


def encode_stream(payload: bytes) -> bytes:
    """A transport stream of one program with the payload as its only elementary stream."""
    out, counter = [_TABLES], 0
    for number, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        when = at * CLOCK // SAMPLES_PER_SECOND
        pes = b"\x00\x00\x01" + bytes([STREAM_PRIVATE]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(when) + unit
        field = b""
        if number % RANDOM_EVERY == 0:  # random access, and the clock: 33 bits, 6 reserved ones, an extension of 0
            field = b"\x07\x50" + ((when << 15) | 0x7E00).to_bytes(6, "big")
        rest = len(pes) - (184 - len(field))
        full, tail = divmod(max(rest, 0), 184)
        n = 1 + full + (tail > 0)
        grid = np.full((n, PACKET), 0xFF, np.uint8)
        grid[:, 0] = SYNC
        grid[:, 1], grid[:, 2] = MEDIA_PID >> 8, MEDIA_PID & 0xFF
        grid[0, 1] |= 0x40
        grid[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        data = np.frombuffer(pes, np.uint8)
        first = min(len(pes), 184 - len(field))
        for row, length, own in ((0, first, field), *([(n - 1, tail, b"")] if tail else [])):
            spare = 184 - length - len(own)
            if own or spare:
                grid[row, 3] |= 0x20
                if not own:
                    own = bytes([spare - 1]) + (b"\x00" if spare > 1 else b"")
                else:
                    own = bytes([own[0] + spare]) + own[1:]
                grid[row, 4 : 4 + len(own)] = np.frombuffer(own, np.uint8)
            chunk = data[:length] if row == 0 else data[len(pes) - tail :]
            grid[row, PACKET - length :] = chunk
        if full:
            grid[1 : 1 + full, 4:] = data[first : first + 184 * full].reshape(full, 184)
        out.append(grid.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    stamps: list[int]
    random_points: list[int]  # packet numbers
    packets: int


def _tables(grid: np.ndarray, pids: np.ndarray, pid: int, table_id: int) -> bytes:
    rows = np.flatnonzero((pids == pid) & (grid[:, 1] & 0x40 > 0))
    if not len(rows):
        raise ValueError("a program table is missing")
    data = grid[rows[0], 5 + int(grid[rows[0], 4]) :].tobytes()
    length = int.from_bytes(data[1:3], "big") & 0x0FFF
    section = data[: 3 + length]
    if section[0] != table_id or table_crc(section) != 0:
        raise ValueError("a program table is damaged")
    return section[8:-4]


def decode_stream(stream: bytes) -> Stream:
    """Parse and check a whole stream."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole packets")
    grid = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise ValueError("a packet is out of step")
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    programs = _tables(grid, pids, PAT_PID, 0)
    maps = {int.from_bytes(programs[i : i + 2], "big"): int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(programs), 4)}
    body = _tables(grid, pids, maps[min(k for k in maps if k)], 2)
    at = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
    media = int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF
    rows = np.flatnonzero(pids == media)
    own = grid[rows]
    control = own[:, 3] >> 4 & 3
    counters = own[:, 3] & 15
    carries = control & 1 > 0
    expected = np.cumsum(carries) - 1
    if ((counters - expected) & 15)[carries].any():
        raise ValueError("a continuity counter is wrong")
    begins = np.where(control & 2 > 0, 5 + own[:, 4].astype(np.int64), 4)
    points = rows[(control & 2 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)]
    starts = np.flatnonzero(own[:, 1] & 0x40)
    units, stamps = [], []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
        if (begins[a + 1 : b - 1] == 4).all():  # only the first and the last packet of a unit have other fields
            middle = own[a + 1 : b - 1, 4:].tobytes()
        else:
            middle = b"".join(own[i, begins[i] :].tobytes() for i in range(a + 1, b - 1))
        pes = own[a, begins[a] :].tobytes() + middle + (own[b - 1, begins[b - 1] :].tobytes() if b - a > 1 else b"")
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) != size + 6:
            raise ValueError("an elementary packet is damaged")
        if pes[7] & 0x80:
            s = pes[9:14]
            stamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | (s[2] >> 1) << 15 | s[3] << 7 | s[4] >> 1)
        units.append(pes[9 + pes[8] :])
    return Stream(b"".join(units), stamps, points.tolist(), len(grid))


def to_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a binary column ``media`` with each whole text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = bytes_of(part, "text")
                media = [encode_stream(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")) for t in texts]
                yield pa.record_batch([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(stream: Stream) -> str:
    """Units, duration in clock ticks, random-access points, and mean, deviation and roughness of the samples."""
    samples = np.frombuffer(stream.payload, np.uint8).astype(np.float64)
    rough = float(np.abs(np.diff(samples)).mean()) if len(samples) > 1 else 0.0
    last = stream.stamps[-1] if stream.stamps else 0
    return f"units={len(stream.stamps)};last={last};random={len(stream.random_points)};mean={samples.mean():.4f};std={samples.std():.4f};rough={rough:.4f}"


def read_media(media: DataFrame) -> DataFrame:
    """Decode the column ``media``: payload size and digests, a feature, and what to seek by; doc_id and n_bytes stay.

    ``stamps`` are the units' time stamps in clock ticks, ``random_points`` the numbers of the packets to start reading from.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "random_points"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "media"):
                rows = []
                for raw in part.column("media").to_pylist():
                    s = decode_stream(raw)
                    rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s), s.stamps, s.random_points))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, random_points array<long>")


def op6_query(documents: DataFrame) -> DataFrame:
    return read_media(stored(to_media(documents), "media", compression="zstd")).drop("stamps", "random_points")
