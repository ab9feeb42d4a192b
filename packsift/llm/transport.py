"""Media columns: MPEG transport streams.

``mux`` packs bytes as one elementary stream: a program association table, a program map table, and one elementary
packet (PES) per access unit of ``UNIT`` bytes, each with a presentation timestamp; the first transport packet of a unit
carries a clock reference, and every ``KEY_EVERY`` th unit is marked as a random-access point.

``demux`` reads any stream of 188-byte packets: it parses the program tables, checks continuity counters per PID,
reassembles the elementary packets, and gives the bytes with timestamps and random-access points. Damage is counted, never
fatal: breaks of the counters, packets that repeat one byte for byte, packets marked as damaged, units of another size than they
say, and bytes in no packet. A stray byte costs the packet it is in; reading goes on at the next two sync bytes a packet apart. Tables
may take several packets.

``stored`` writes a media column: the streams go to a table in the shared folder and are read back from there.

Nulls and empty texts are stored as one block of spaces. Very long texts are one stream each; all work is by row. A null id stays,
repeated rows are rows, further columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged_path
from .shared import chunks

PACKET, SYNC, PMT_PID, MEDIA_PID, STREAM_TYPE, STREAM_ID = 188, 0x47, 0x100, 0x101, 0x06, 0xBD
BLOCK, UNIT, KEY_EVERY, TICKS = 192, 192 * 16, 8, 3600  # bytes, bytes, units, 90 kHz ticks per unit


@functools.lru_cache(4096)
def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _units(data: np.ndarray, first: int) -> np.ndarray:
    """Transport packets, as (unit, packet, byte), of access units of one size; ``first`` is the number of the first."""
    count, size = data.shape
    number = first + np.arange(count)
    pts = number * TICKS
    pes = np.zeros((count, 14 + size), np.uint8)
    pes[:, :9] = [0, 0, 1, STREAM_ID, (size + 8) >> 8, (size + 8) & 255, 0x84, 0x80, 5]
    for k, value in enumerate([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1]):
        pes[:, 9 + k] = value
    pes[:, 14:] = data
    length = 14 + size
    room = 176  # of the first packet, behind its clock reference
    packets = 1 + max(0, -(-(length - room) // 184))
    out = np.full((count, packets, PACKET), 255, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255, 0x10
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] = 0x30
    field = 7 if length >= room else 7 + room - length
    out[:, 0, 4] = field
    out[:, 0, 5] = 0x10 | np.where(number % KEY_EVERY == 0, 0x40, 0)
    for k, value in enumerate([pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, 0 * pts]):
        out[:, 0, 6 + k] = value
    head = min(length, room)
    out[:, 0, PACKET - head:] = pes[:, :head]
    rest = length - head
    whole = rest // 184
    if whole:
        out[:, 1:1 + whole, 4:] = pes[:, head:head + 184 * whole].reshape(count, whole, 184)
    tail = rest - 184 * whole
    if tail:
        out[:, -1, 3] = 0x30
        out[:, -1, 4] = 183 - tail
        if tail < 183:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - tail:] = pes[:, length - tail:]
    return out


def mux(data: bytes) -> bytes:
    """A transport stream of the bytes."""
    data = np.frombuffer(data, np.uint8)
    whole = len(data) // UNIT
    parts = []
    if whole:
        parts.append(_units(data[:whole * UNIT].reshape(whole, UNIT), 0).reshape(-1, PACKET))
    if len(data) % UNIT:
        parts.append(_units(data[whole * UNIT:].reshape(1, -1), whole).reshape(-1, PACKET))
    packets = np.concatenate(parts) if parts else np.zeros((0, PACKET), np.uint8)
    packets[:, 3] |= (np.arange(len(packets)) & 15).astype(np.uint8)
    return TABLES + packets.tobytes()


def _payload_starts(packets: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins; 188 if it has none."""
    control = packets[:, 3] >> 4 & 3
    start = np.where(control == 1, 4, np.where(control == 3, 5 + packets[:, 4].astype(int), PACKET))
    return np.minimum(start, PACKET)


def _sections(packets: np.ndarray, starts: np.ndarray, table: int) -> list[bytes]:
    """Intact sections of a table id from the packets of one PID. A section may take several packets, a packet hold several."""
    out, held = [], b""

    def take(data: bytes) -> bytes:
        """Sections at the front of the bytes; what is left of them."""
        while len(data) >= 3 and data[0] != 0xFF:
            size = ((data[1] << 8 | data[2]) & 0xFFF) + 3
            if len(data) < size:
                return data
            if size >= 12 and data[0] == table and crc_mpeg(data[:size]) == 0:
                out.append(data[:size])
            data = data[size:]
        return data if len(data) < 3 and data[:1] != b"\xff" else b""

    last = None
    for packet, start in zip(packets, starts):
        if start >= PACKET:
            continue
        counter = int(packet[3]) & 15
        if last is not None and counter == last:  # sent twice
            continue
        if last is not None and counter != last + 1 & 15:
            held = b""  # the rest of a section is lost
        last, data = counter, packet[start:].tobytes()
        if packet[1] & 0x40:
            pointer = 1 + data[0]
            if held:
                take(held + data[1:pointer])
            held = take(data[pointer:])
        elif held:
            held = take(held + data)
    return out


def packets_of(raw: np.ndarray) -> tuple[np.ndarray, int]:
    """The packets of a stream, and how many bytes are in none. Where the pattern of sync bytes breaks, the next place with two of them begins anew."""
    parts, at, skipped = [], 0, 0
    synced = lambda p: raw[p] == SYNC and (p + PACKET >= len(raw) or raw[p + PACKET] == SYNC)
    while at + PACKET <= len(raw):
        if not synced(at):
            window = np.flatnonzero(raw[at + 1:at + 1 + 64 * PACKET] == SYNC) + at + 1
            found = next((int(p) for p in window if p + PACKET <= len(raw) and synced(p)), min(at + 1 + 64 * PACKET, len(raw)))
            skipped += found - at
            at = found
            continue
        grid = raw[at:at + (len(raw) - at) // PACKET * PACKET].reshape(-1, PACKET)
        lost = np.flatnonzero(grid[:, 0] != SYNC)
        count = int(lost[0]) if len(lost) else len(grid)
        parts.append(grid[:count])
        at += count * PACKET
    packets = np.concatenate(parts) if parts else np.zeros((0, PACKET), np.uint8)
    return packets, skipped + len(raw) - at


def _repeats(own: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Which packets repeat the one before: the same counter and, but for the clock reference, the same bytes."""
    same = np.concatenate([[False], step == 0])
    for i in np.flatnonzero(same):
        a, b = own[i - 1].copy(), own[i].copy()
        for x in (a, b):
            if x[3] & 0x20 and x[4] >= 7 and x[5] & 0x10:
                x[6:12] = 0
        same[i] = (a == b).all()
    return same


def demux(stream: bytes) -> dict:
    """data, pids, units, pts, keys (random-access units), lost (continuity errors), repeated, damaged (packets that say so),
    short (units with more or fewer bytes than they say) and skipped (bytes in no packet)."""
    packets, skipped = packets_of(np.frombuffer(stream, np.uint8))
    broken = packets[:, 1] & 0x80 > 0
    packets = packets[~broken]
    pid = (packets[:, 1].astype(int) & 31) << 8 | packets[:, 2]
    starts = _payload_starts(packets)
    out = {"data": b"", "pids": [], "units": 0, "pts": [], "keys": [], "lost": 0, "repeated": 0, "short": 0, "damaged": int(broken.sum()), "skipped": skipped}
    maps = {int.from_bytes(s[i + 2:i + 4], "big") & 0x1FFF for s in _sections(packets[pid == 0], starts[pid == 0], 0) for i in range(8, len(s) - 4, 4) if s[i:i + 2] != b"\0\0"}
    streams = []
    for m in sorted(maps):
        for s in _sections(packets[pid == m], starts[pid == m], 2):
            at = 12 + ((s[10] & 15) << 8 | s[11])
            while at + 5 <= len(s) - 4:
                streams.append((int.from_bytes(s[at + 1:at + 3], "big") & 0x1FFF, s[at]))
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
    parts = []
    for stream_pid, kind in dict.fromkeys(streams):
        out["pids"].append((stream_pid, kind))
        own, start = packets[pid == stream_pid], starts[pid == stream_pid]
        own, start = own[start < PACKET], start[start < PACKET]
        if not len(own):
            continue
        counter = own[:, 3].astype(int) & 15
        step = np.diff(counter) & 15
        same = _repeats(own, step)  # a packet may be sent twice
        flagged = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x80 > 0)  # a discontinuity that is announced
        out["repeated"] += int(same.sum())
        out["lost"] += int(((step != 1) & ~same[1:] & ~flagged[1:]).sum())
        own, start = own[~same], start[~same]
        opens = own[:, 1] & 0x40 > 0
        key = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        flat = own[np.arange(PACKET) >= start[:, None]]
        ends = np.concatenate([[0], np.cumsum(PACKET - start)])
        first = np.flatnonzero(opens)
        for a, b in zip(first, [*first[1:], len(own)]):
            pes = flat[ends[a]:ends[b]]
            if len(pes) < 9 or pes[0] or pes[1] or pes[2] != 1:
                out["lost"] += 1
                continue
            size = int(pes[4]) << 8 | int(pes[5])
            if pes[7] & 0x80 and len(pes) >= 14:
                p = pes[9:14].astype(int)
                out["pts"].append(int((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1))
            if key[a]:
                out["keys"].append(out["units"])
            out["units"] += 1
            out["short"] += bool(size) and len(pes) != size + 6
            parts.append(pes[9 + pes[8]:size + 6 if size else None].tobytes())
    return out | {"data": b"".join(parts)}


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of each document, read back from the table in the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches, "text"):
            sizes, media = [], []
            for text in batch["text"].to_pylist():
                data = (text or "").encode()
                sizes.append(len(data))
                media.append(mux(data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b" ")))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    path = staged_path(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def features(media: DataFrame) -> DataFrame:
    """Checks and features of stored streams: what a reader gets from the bytes alone. ``timestamps`` has the presentation time of
    each unit that tells it (90 kHz), ``key_units`` the numbers of the random-access units."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for value in batch["media"]:
                stream = value.as_py()
                x = demux(stream)
                data = x["data"]
                feature = (f"streams={','.join(f'{p:x}:{k:x}' for p, k in x['pids'])};units={x['units']};pts={x['pts'][0]}-{x['pts'][-1]};"
                           f"keys={len(x['keys'])};lost={x['lost']};repeated={x['repeated']}" if x["pts"] else "streams=;units=0")
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature,
                             x["pts"], x["keys"], x["short"] + x["damaged"], x["skipped"]))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "key_units", "damaged", "skipped"]
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
                                 "timestamps array<long>, key_units array<long>, damaged long, skipped long")


def points(media: DataFrame) -> DataFrame:
    """One row per access unit that is a random-access point: doc_id, unit and pts, for seeking."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [(i, k, x["pts"][k]) for i, s in enumerate(batch["media"].to_pylist()) for x in [demux(s)] for k in x["keys"] if k < len(x["pts"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "unit", "pts"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, unit long, pts long")


def roundtrip(docs: DataFrame) -> DataFrame:
    return features(stored(docs).select("doc_id", "n_bytes", F.col("media")))
