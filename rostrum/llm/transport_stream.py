"""Media columns: payloads in MPEG transport streams, and what is read back.

``to_stream`` writes a payload as one program with one elementary stream of private
data: program tables first and again every ``TABLES_EVERY`` elementary packets, a
time stamp on every elementary packet, and a random-access mark on every
``ACCESS_EVERY``-th. ``read_stream`` finds the stream through the tables (checking
their CRC), checks continuity counters, reassembles the elementary packets, and
returns time stamps and random-access points with the places they belong to.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rostrum.llm.common import id_and_text

PACKET = 188
UNIT = 64
PES_BYTES = 16_384
ACCESS_EVERY = 4
TABLES_EVERY = 32
TICKS = 3_600  # of 90 kHz between elementary packets
PROGRAM, TABLE_PID, DATA_PID, PRIVATE_DATA, STREAM_ID = 1, 0x100, 0x101, 0x06, 0xBD


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


@functools.lru_cache(maxsize=64)
def table_crc(section: bytes) -> int:
    """CRC of program tables; 0 over a section that ends in its own."""
    c = 0xFFFFFFFF
    for byte in section:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[c >> 24 ^ byte]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + table_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


PAT = _section(0, 1, bytes([0, PROGRAM, 0xE0 | TABLE_PID >> 8, TABLE_PID & 255]))
PMT = _section(2, PROGRAM, bytes([
    0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0,
    PRIVATE_DATA, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))


def _stamp(ticks: int) -> bytes:
    t = ticks % (1 << 33)
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, 1 | t >> 14 & 254, t >> 7 & 255,
                  1 | t << 1 & 254])


def _elementary(data: bytes, number: int, counter: int) -> np.ndarray:
    """Transport packets of one elementary packet."""
    pes = (b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big")
           + b"\x84\x80\x05" + _stamp(number * TICKS) + data)
    access = number % ACCESS_EVERY == 0
    first = PACKET - 4 - (2 if access else 0)  # payload of the first packet
    rest = max(0, len(pes) - first)
    n = 1 + -(-rest // (PACKET - 4))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    start = np.full(n, 4)
    if access:
        out[0, 3] |= 0x20
        out[0, 4:6] = 1, 0x40
        start[0] = 6
    spare = int((PACKET - start).sum()) - len(pes)
    if spare:  # stuffing in the adaptation field of the last packet
        at = int(start[-1])
        length = at - 5 + spare if at > 4 else spare - 1
        out[-1, 3] |= 0x20
        out[-1, 4] = length
        if length and at == 4:
            out[-1, 5] = 0
        start[-1] = at + spare
    out[np.arange(PACKET) >= start[:, None]] = np.frombuffer(pes, np.uint8)
    return out


def to_stream(payload: bytes) -> bytes:
    out, tables, counter = [], 0, 0
    for number, at in enumerate(range(0, max(1, len(payload)), PES_BYTES)):
        if number % TABLES_EVERY == 0:
            out += [_table_packet(0, PAT, tables), _table_packet(TABLE_PID, PMT, tables)]
            tables += 1
        packets = _elementary(payload[at:at + PES_BYTES], number, counter)
        counter += len(packets)
        out.append(packets.tobytes())
    return b"".join(out)


class Stream(NamedTuple):
    payload: bytes
    stamps: list[int]  # of the elementary packets, at 90 kHz
    places: list[int]  # of their data in the payload
    access: list[int]  # numbers of those with a random-access mark
    packets: int
    programs: int
    stream_type: int
    losses: int  # breaks of a continuity counter, and elementary packets left out


def _tables(packets: np.ndarray, pid: np.ndarray, begin: np.ndarray, wanted: int,
            table: int) -> list[bytes]:
    """Sections of a table with a right CRC, each once."""
    out = []
    for i in np.flatnonzero((pid == wanted) & (packets[:, 1] & 0x40 > 0)):
        data = packets[i, begin[i]:].tobytes()
        data = data[1 + data[0]:] if data else b""
        length = 3 + ((data[1] & 15) << 8 | data[2]) if len(data) > 2 else 0
        section = data[:length]
        if length > 8 and len(section) == length and section[0] == table \
                and section not in out and table_crc(section) == 0:
            out.append(section)
    return out


def read_stream(stored: bytes) -> Stream:
    """A stream that breaks off, has no tables or misses packets gives what can be read."""
    whole = len(stored) // PACKET
    packets = np.frombuffer(stored, np.uint8, whole * PACKET).reshape(-1, PACKET)
    packets = packets[packets[:, 0] == 0x47]
    b = packets.astype(np.int64)
    pid = (b[:, 1] & 0x1F) << 8 | b[:, 2]
    field = b[:, 3] & 0x20 > 0
    begin = np.minimum(4 + np.where(field, 1 + b[:, 4], 0), PACKET)
    carries = b[:, 3] & 0x10 > 0
    maps = [int.from_bytes(s[i + 2:i + 4], "big") & 0x1FFF
            for s in _tables(packets, pid, begin, 0, 0) for i in range(8, len(s) - 4, 4)
            if s[i] << 8 | s[i + 1]]
    data_pid, kind = -1, -1
    for m in dict.fromkeys(maps):
        for s in _tables(packets, pid, begin, m, 2):
            i = 12 + ((s[10] & 15) << 8 | s[11])
            if i + 5 <= len(s) - 4 and data_pid < 0:
                kind, data_pid = s[i], (s[i + 1] & 31) << 8 | s[i + 2]
    losses = whole * PACKET != len(stored)
    mine = np.flatnonzero((pid == data_pid) & carries)
    counter = b[mine, 3] & 15
    again = np.diff(counter, prepend=counter[:1] - 1) & 15 == 0  # sent twice, as is allowed
    mine, counter = mine[~again], counter[~again]
    broken = np.diff(counter, prepend=counter[:1] - 1) & 15 != 1
    losses += int(broken.sum())
    starts = np.flatnonzero(b[mine, 1] & 0x40)
    payload, stamps, places, access, length = [], [], [], [], 0
    size = PACKET - begin[mine]
    held = packets[mine][np.arange(PACKET) >= begin[mine][:, None]].tobytes()
    edge = np.concatenate([[0], np.cumsum(size)])
    for s, e in zip(starts, [*starts[1:], len(mine)]):
        pes = held[edge[s]:edge[e]]
        head = 9 + pes[8] if len(pes) > 13 else 0
        end = 6 + int.from_bytes(pes[4:6], "big")
        if broken[s + 1:e].any() or pes[:3] != b"\0\0\1" or not head or len(pes) < end:
            losses += 1
            continue
        if pes[7] & 0x80:
            t = pes[9:14]
            stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15
                          | t[3] << 7 | t[4] >> 1)
        else:
            stamps.append(-1)
        i = mine[s]
        if field[i] and b[i, 4] and b[i, 5] & 0x40:
            access.append(len(stamps) - 1)
        places.append(length)
        payload.append(pes[head:end])
        length += len(payload[-1])
    return Stream(b"".join(payload), stamps, places, access, whole, len(maps), kind, int(losses))


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``UNIT``."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 200):
            batch = whole.slice(start, 200)
            texts = pc.cast(pc.fill_null(batch.column("text"), ""), pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()),
                 pa.array([to_stream(padded(t)) for t in texts], pa.binary())],
                names=["doc_id", "n_bytes", "stream"])


def streams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, stream``: each text as a transport stream. A null text is
    empty; other columns are ignored."""
    return id_and_text(docs, doc_id, text).mapInArrow(
        _write, "doc_id long, n_bytes long, stream binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 200):
            batch = whole.slice(start, 200)
            found = [read_stream(s or b"") for s in batch.column("stream").to_pylist()]
            columns = list(zip(*found)) or [[]] * 8
            kinds = [pa.binary(), *[pa.list_(pa.int64())] * 3, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=[*batch.schema.names, *Stream._fields])


def read_back(stored: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, stream`` with what ``read_stream`` finds in each stream."""
    return stored.mapInArrow(_read, (
        "doc_id long, n_bytes long, stream binary, payload binary, stamps array<long>, "
        "places array<long>, access array<long>, packets long, programs long, "
        "stream_type long, losses long"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.select(["payload", "stream", "stamps", "access", "packets", "programs",
                               "losses"]).to_pylist():
            data, stored, stamps = r["payload"], r["stream"], r["stamps"]
            feature = (f"programs={r['programs']};packets={r['packets']};pes={len(stamps)};"
                       f"pts={stamps[0] if stamps else -1}-{stamps[-1] if stamps else -1};"
                       f"access={len(r['access'])};losses={r['losses']}")
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]),
                         len(stored), hashlib.sha256(stored).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"),
             *[pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
                   "media_bytes", "media_sha256", "feature"])


def digests(read: DataFrame) -> DataFrame:
    """Sizes and hashes of what was read back and of the stored form, and a feature
    string of its tables, packets, time stamps and random-access points."""
    return read.mapInArrow(_digest, (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, "
        "tail_crc32 long, media_bytes long, media_sha256 string, feature string"))
