"""Packets from capture files, read in byte ranges that begin at record headers.

A classic capture has no marks between its records, so a range doesn't tell
where its first record begins. Every range follows the chains of headers that
may begin in its first bytes and tells where each one leaves it; chains from
wrong places die or run into the right one. Walking once from range to range,
from the file's true first record, then gives each range its true start. A
range with a header that can't be read ends the file there.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Magic numbers of the classic format (microseconds, nanoseconds) and of blocks, link and protocol numbers.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
BLOCKS, INTERFACE, SIMPLE, ENHANCED = b"\x0a\x0d\x0d\x0a", 1, 3, 6
ETHERNET, RAW_IP = 1, 101
IPV4, IPV6, VLAN = 0x0800, 0x86DD, (0x8100, 0x88A8)
ICMP, TCP, UDP, ICMP6 = 1, 6, 17, 58
EXTENSIONS = (0, 43, 60)
MOST_BYTES, RECORD_HEAD = 262_144, 16
#: Seconds that two neighbouring records of a chain may lie apart.
MOST_APART = 10 * 365 * 86400
SCHEMA = "file string, row long, ts timestamp, src string, dst string, sport int, dport int, proto string, size int, ttl int, window int, seq long, flags int"


def opened(path: str):
    """The file, in whatever store pyarrow knows for its path, and its size."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner), store.get_file_info(inner).size


class Layout:
    """What a file's head says: byte order, parts of a microsecond, link type, and where records begin."""

    def __init__(self, head: bytes):
        self.blocks = head[:4] == BLOCKS
        if self.blocks:
            self.order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            self.first, self.per_micro, self.link = 0, 1, ETHERNET
            at = 0
            while at + 12 <= len(head):
                kind, size = struct.unpack_from(self.order + "II", head, at)
                if kind == INTERFACE:
                    self.link = struct.unpack_from(self.order + "H", head, at + 8)[0]
                    self._resolution(head[at + 16 : at + size - 4])
                elif kind in (SIMPLE, ENHANCED) or size < 12:
                    break
                at += size
        else:
            self.order, self.per_micro = MAGIC[head[:4]]
            self.link, self.first = struct.unpack_from(self.order + "I", head, 20)[0] & 0xFFFF, 24

    def _resolution(self, options: bytes) -> None:
        at = 0
        while at + 4 <= len(options):
            code, size = struct.unpack_from(self.order + "HH", options, at)
            if code == 0:
                return
            if code == 9 and size == 1:
                power = options[at + 4]
                if power not in (6, 9):
                    raise ValueError("times are read in micro- or nanoseconds")
                self.per_micro = 10 ** (power - 6)
            at += 4 + (size + 3) // 4 * 4

    def step(self, data: memoryview, at: int) -> int:
        """Bytes of the record at ``at``, 0 if there is none that can be read."""
        if self.blocks:
            if at + 12 > len(data):
                return 0
            size = struct.unpack_from(self.order + "I", data, at + 4)[0]
            whole = 12 <= size <= MOST_BYTES + 64 and size % 4 == 0 and at + size <= len(data)
            return size if whole and data[at + size - 4 : at + size] == data[at + 4 : at + 8] else 0
        if at + RECORD_HEAD > len(data):
            return 0
        _, part, held, whole = struct.unpack_from(self.order + "IIII", data, at)
        fits = part < 1_000_000 * self.per_micro and held <= MOST_BYTES and held <= max(whole, held) and at + RECORD_HEAD + held <= len(data)
        return RECORD_HEAD + held if fits else 0

    def near(self, data: memoryview, at: int, after: int) -> bool:
        """Whether the records at two places may follow each other in time."""
        if self.blocks or after + RECORD_HEAD > len(data):
            return True
        a, b = (struct.unpack_from(self.order + "I", data, k)[0] for k in (at, after))
        return abs(a - b) <= MOST_APART

    def record(self, data: memoryview, at: int) -> tuple[int, int, int] | None:
        """Microseconds, and where the record's bytes begin and end; None if it is no packet."""
        if not self.blocks:
            seconds, part, held, _ = struct.unpack_from(self.order + "IIII", data, at)
            return seconds * 1_000_000 + part // self.per_micro, at + RECORD_HEAD, at + RECORD_HEAD + held
        kind = struct.unpack_from(self.order + "I", data, at)[0]
        if kind != ENHANCED:
            return None
        high, low, held, _ = struct.unpack_from(self.order + "IIII", data, at + 12)
        return ((high << 32) | low) // self.per_micro, at + 28, at + 28 + held


def chains(layout: Layout, data: bytes, length: int) -> dict[int, int]:
    """For each place of the first bytes at which a record may begin, where its chain of records leaves the first ``length`` bytes.

    ``data`` goes beyond ``length`` by as much as a record may be long.
    """
    view, leaves = memoryview(data), {}
    for start in range(min(length, MOST_BYTES + RECORD_HEAD + 64)):
        at, passed = start, []
        while at < length and at not in leaves:
            size = layout.step(view, at)
            if not size or not layout.near(view, at, at + size):
                break
            passed.append(at)
            at += size
        end = leaves.get(at, at if at >= length else -1)
        for k in [*passed, start]:
            leaves.setdefault(k, end)
    return {k: v for k, v in leaves.items() if v >= 0}


class Fields:
    """Numbers at places of many frames in one buffer, most significant byte first; beyond a frame's end they are 0 and it counts as short."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        self.short = np.zeros(len(starts), bool)

    def number(self, at: np.ndarray, size: int, need: np.ndarray) -> np.ndarray:
        there = at + size <= self.ends
        self.short |= need & ~there
        places = np.where(there, at, 0)
        out = np.zeros(len(at), np.int64)
        for k in range(size):
            out = (out << 8) | self.data[np.minimum(places + k, max(len(self.data) - 1, 0))]
        return np.where(there, out, 0)

    def address(self, at: np.ndarray, size: int, use: np.ndarray, out: np.ndarray) -> None:
        rows = np.flatnonzero(use & (at + size <= self.ends))
        if len(rows):
            raw = self.data[at[rows, None] + np.arange(size)]
            distinct, place = np.unique(raw, axis=0, return_inverse=True)
            out[rows] = np.array([str(ipaddress.ip_address(x.tobytes())) for x in distinct], object)[place.ravel()]


def parsed(data: bytes, records: list[tuple[int, int, int]], link: int) -> dict[str, np.ndarray]:
    """Columns of the records that hold IP packets, and ``kept``: their places among the records.

    Other frames and those too short for their IP header are passed over.
    Without a whole header of TCP or UDP, and in later fragments, a packet has
    no ports and its protocol is the number.
    """
    times, starts, ends = (np.array(x, np.int64) for x in (zip(*records, strict=True) if records else ((), (), ())))
    f = Fields(np.frombuffer(data, np.uint8), starts, ends)
    always = np.ones(len(starts), bool)
    at = starts.copy()
    if link == ETHERNET:
        kind = f.number(at + 12, 2, always)
        at += 14
        for _ in range(2):
            tagged = np.isin(kind, VLAN)
            kind = np.where(tagged, f.number(at + 2, 2, tagged), kind)
            at += 4 * tagged
    else:
        kind = np.where(f.number(at, 1, always) >> 4 == 6, IPV6, IPV4)
    version = f.number(at, 1, always) >> 4
    four, six = (kind == IPV4) & (version == 4), (kind == IPV6) & (version == 6)
    head = np.where(four, (f.number(at, 1, four) & 15) * 4, 40)
    ip = (four & (head >= 20) | six) & (at + head <= ends) & ~f.short
    ttl = np.where(four, f.number(at + 8, 1, four), f.number(at + 7, 1, six))
    number = np.where(four, f.number(at + 9, 1, four), f.number(at + 6, 1, six))
    later = four & (f.number(at + 6, 2, four) & 0x1FFF > 0)
    src, dst = np.full(len(at), None, object), np.full(len(at), None, object)
    f.address(at + 12, 4, ip & four, src)
    f.address(at + 16, 4, ip & four, dst)
    f.address(at + 8, 16, ip & six, src)
    f.address(at + 24, 16, ip & six, dst)
    body = at + head
    for _ in range(4):
        more = ip & six & np.isin(number, EXTENSIONS) & (body + 8 <= ends)
        size = (f.number(body + 1, 1, more) + 1) * 8
        number, body = np.where(more, f.number(body, 1, more), number), body + np.where(more, size, 0)
    tcp, udp = (ip & ~later & (number == n) & (body + size <= ends) for n, size in ((TCP, 20), (UDP, 8)))
    icmp = ip & ~later & ((number == ICMP) | (number == ICMP6)) & (body + 4 <= ends)
    ports = tcp | udp
    value = lambda off, size, use: np.where(use, f.number(body + off, size, use), 0)
    proto = np.where(tcp, "tcp", np.where(udp, "udp", np.where(icmp, "icmp", number.astype(str)))).astype(object)
    columns = {"ts": times, "src": src, "dst": dst, "sport": value(0, 2, ports), "dport": value(2, 2, ports), "proto": proto, "size": ends - starts, "ttl": ttl, "window": value(14, 2, tcp), "seq": value(4, 4, tcp), "flags": value(13, 1, tcp) & 0x3F}
    return {k: v[ip] for k, v in columns.items()} | {"kept": np.flatnonzero(ip)}


def _head(path: str) -> Layout:
    file, _ = opened(path)
    with file:
        head = file.read(1 << 16)
    if head[:4] != BLOCKS and head[:4] not in MAGIC or len(head) < 24:
        raise ValueError(f"{path} is no capture")
    return Layout(head)


def read_packets(spark: SparkSession, paths: list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """A row for each IP packet of the files: SCHEMA. ``row`` is the record's place in the file, which orders packets of one time.

    Frames that are no IP packets or can't be read are passed over; so is what
    comes after a record that was cut off. A file without records gives no rows, what
    is no capture is an error.
    Interfaces declared after a block file's first packet are an error.
    """
    splits, first = [], {}
    for path in paths:
        file, size = opened(path)
        file.close()
        first[path] = _head(path).first
        splits += [(path, k, at, min(at + split_bytes, size), size) for k, at in enumerate(range(0, size, split_bytes))]
    if not splits:
        return spark.createDataFrame([], SCHEMA)
    dealt = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(len(rows), "path", "at")

    def bytes_of(path: str, start: int, stop: int) -> bytes:
        file, _ = opened(path)
        with file:
            file.seek(start)
            return file.read(stop - start)

    def leaving(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, part, at, stop, size in frame.itertuples(index=False):
                layout = _head(path)
                found = chains(layout, bytes_of(path, at, min(stop + MOST_BYTES + RECORD_HEAD + 64, size)), stop - at) if stop < size else {}
                yield pd.DataFrame([(path, part, at, stop, size, [at + k for k in found], [at + v for v in found.values()])], columns=["path", "part", "at", "stop", "size", "starts", "ends"])

    schema = "path string, part int, at long, stop long, size long"
    told = dealt(splits, schema).mapInPandas(leaving, f"{schema}, starts array<long>, ends array<long>")
    true, where = [], {}
    for r in told.orderBy("path", "part").toLocalIterator():  # a row for each range; what a row lists is bounded by the longest record
        at = where.get(r.path, first[r.path] if r.part == 0 else None)
        where[r.path] = at
        if at is None or at >= r.stop:
            continue
        true.append((r.path, at, r.stop, r.size))
        where[r.path] = dict(zip(r.starts, r.ends, strict=True)).get(at)
    if not true:
        return spark.createDataFrame([], SCHEMA)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, stop, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                layout = _head(path)
                data = bytes_of(path, at, min(stop + MOST_BYTES + RECORD_HEAD + 64, size))
                view, places, records, here, seen = memoryview(data), [], [], 0, False
                while at + here < stop and (step := layout.step(view, here)):
                    if layout.blocks and struct.unpack_from(layout.order + "I", view, here)[0] == INTERFACE and (seen or at > 1 << 16):
                        raise ValueError(f"{path} declares an interface after its first packet")
                    if found := layout.record(view, here):
                        seen = True
                        records.append(found)
                        places.append(at + here)
                    here += step
                for k in range(0, len(records), 20_000):
                    own = parsed(data, records[k : k + 20_000], layout.link)
                    n = len(own["kept"])
                    columns = [pa.array([path] * n, pa.string()), pa.array(np.array(places[k : k + 20_000], np.int64)[own["kept"]])]
                    columns += [pa.array(own["ts"], pa.timestamp("us", tz="UTC")), *(pa.array(own[c], pa.string()) for c in ("src", "dst")), *(pa.array(own[c], pa.int32()) for c in ("sport", "dport")), pa.array(own["proto"], pa.string())]
                    columns += [*(pa.array(own[c], pa.int32()) for c in ("size", "ttl", "window")), pa.array(own["seq"], pa.int64()), pa.array(own["flags"], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return dealt(true, "path string, at long, stop long, size long").mapInArrow(work, SCHEMA)
