"""MDF 4 files: decoded channels to samples, raw bus groups to frames, and a plain writer.

A file is read by one task: blocks are followed in memory and every channel becomes a numpy array. Supported are
sorted and unsorted groups of fixed-length records, plain, listed and zipped data, whole and bit-packed integers,
floats, texts and byte arrays, values of variable length in data blocks of their own, and the linear, rational, table
and text conversions. read_warnings() tells what can't be read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import signal_key


class MdfError(ValueError):
    """A file that is no readable MDF 4."""


#: Groups of raw frames, and whether they hold data bytes.
BUS_GROUPS = {"CAN_DataFrame": True, "LIN_Frame": True, "CAN_RemoteFrame": False, "CAN_ErrorFrame": False}
#: Conversions that physical() knows: none, linear, rational, tables with and without interpolation, texts by value and by range.
KNOWN_CONVERSIONS = {0, 1, 2, 4, 5, 7, 8}


@dataclass
class Channel:
    name: str
    unit: str
    kind: int
    data_type: int
    bit_offset: int
    byte_offset: int
    bits: int
    conversion: dict | None
    parts: list[Channel] = field(default_factory=list)
    data: int = 0  # where values of variable length stand


@dataclass
class Group:
    name: str
    record_id: int
    cycles: int
    size: int
    channels: list[Channel]
    flags: int = 0


class Reader:
    def __init__(self, data: bytes):
        if data[:3] != b"MDF" or not data[8:9] == b"4":
            raise MdfError("not an MDF 4 file")
        self.data = data
        self.warnings: list[str] = []

    def _block(self, at: int, kind: bytes) -> tuple[tuple[int, ...], int, int]:
        """(links, start of the data part, end) of a block; raises where it isn't whole."""
        if at <= 0 or at + 24 > len(self.data):
            raise MdfError(f"a link points out of the file: {at}")
        sign, _, length, n = struct.unpack_from("<4sIQQ", self.data, at)
        if sign[2:] not in kind.split(b"|") or at + length > len(self.data) or 24 + 8 * n > length:
            raise MdfError(f"damaged block at byte {at}")
        return struct.unpack_from(f"<{n}q", self.data, at + 24), at + 24 + 8 * n, at + length

    def _kind(self, at: int) -> bytes:
        return self.data[at + 2 : at + 4]

    def text(self, at: int) -> str:
        if not at:
            return ""
        _, start, end = self._block(at, b"TX|MD")
        raw = self.data[start:end].split(b"\0", 1)[0].decode("utf-8", "replace")
        if self._kind(at) == b"MD" and "<TX>" in raw:
            raw = raw.split("<TX>", 1)[1].split("</TX>", 1)[0]
        return raw.strip()

    def _data(self, at: int) -> Iterator[bytes]:
        if not at:
            return
        kind = self._kind(at)
        if kind in (b"DT", b"SD", b"RD"):
            _, start, end = self._block(at, kind)
            yield self.data[start:end]
        elif kind == b"DZ":
            _, start, end = self._block(at, kind)
            _, method, _, columns, whole, size = struct.unpack_from("<2sBBIQQ", self.data, start)
            raw = zlib.decompress(self.data[start + 24 : start + 24 + size])
            if method == 1 and columns > 1:
                rows = whole // columns
                body = np.frombuffer(raw[: rows * columns], np.uint8).reshape(columns, rows).T
                raw = body.tobytes() + raw[rows * columns :]
            yield raw
        elif kind == b"HL":
            links, _, _ = self._block(at, kind)
            yield from self._data(links[0])
        elif kind == b"DL":
            while at:
                links, _, _ = self._block(at, kind)
                for part in links[1:]:
                    yield from self._data(part)
                at = links[0]
        else:
            raise MdfError(f"unknown data block at byte {at}")

    def _conversion(self, at: int) -> dict | None:
        if not at:
            return None
        links, start, _ = self._block(at, b"CC")
        kind, _, _, refs, n = struct.unpack_from("<BBHHH", self.data, start)
        values = struct.unpack_from(f"<{n}d", self.data, start + 24)
        texts = [self.text(x) if x and self._kind(x) in (b"TX", b"MD") else None for x in links[4 : 4 + refs]] if kind in (7, 8) else []
        return {"kind": kind, "values": values, "texts": texts, "unit": self.text(links[1])}

    def _channels(self, at: int) -> list[Channel]:
        out = []
        while at:
            links, start, _ = self._block(at, b"CN")
            kind, _, data_type, bit, byte, bits = struct.unpack_from("<BBBBII", self.data, start)
            conversion = self._conversion(links[4])
            parts = self._channels(links[1]) if links[1] and self._kind(links[1]) == b"CN" else []
            out.append(Channel(self.text(links[2]), self.text(links[6]) or (conversion or {}).get("unit", ""), kind, data_type, bit, byte, bits, conversion, parts, links[5]))
            at = links[0]
        return out

    def column(self, group: Group, c: Channel, records: np.ndarray):
        """raw_values of a channel, also of variable length; a channel that can't be read gives None and a warning."""
        try:
            raw = self._variable(c, records) if c.kind == 1 else None if c.parts and c.data_type < 10 else raw_values(c, records)
        except (MdfError, struct.error, zlib.error) as e:
            raw = self.warnings.append(str(e))
        if raw is None:
            self.warnings.append(f"{group.name}: channel {c.name} can't be read")
        elif c.conversion and c.conversion["kind"] not in KNOWN_CONVERSIONS:
            self.warnings.append(f"{group.name}: channel {c.name} is raw, its conversion {c.conversion['kind']} isn't known")
        return raw

    def _variable(self, c: Channel, records: np.ndarray) -> list | None:
        """The values that a channel's records point to: each is its length and its bytes."""
        if not c.data or self._kind(c.data) == b"CG":
            return None
        starts = raw_values(Channel(c.name, "", 0, 0, c.bit_offset, c.byte_offset, c.bits, None, []), records)
        stream = b"".join(self._data(c.data))
        sizes = [struct.unpack_from("<I", stream, int(s))[0] for s in starts]
        values = [stream[int(s) + 4 : int(s) + 4 + n] for s, n in zip(starts, sizes, strict=True)]
        return values if c.data_type not in (6, 7) else [v.split(b"\0", 1)[0].decode("latin-1" if c.data_type == 6 else "utf-8", "replace").strip() for v in values]

    def groups(self, records: bool = True) -> Iterator[tuple[Group, np.ndarray | None]]:
        """(group, records as bytes, one row each, or None without them). A damaged part ends the reading with a warning."""
        try:
            at = self._block(64, b"HD")[0][0]
            while at:
                links, start, _ = self._block(at, b"DG")
                id_size, found, cg = self.data[start], [], links[1]
                while cg:
                    cl, cs, _ = self._block(cg, b"CG")
                    record_id, cycles, flags, _, _, size, invalid = struct.unpack_from("<QQHHIII", self.data, cs)
                    name = self.text(cl[2]) or (self.text(self._block(cl[3], b"SI")[0][0]) if cl[3] else "")
                    found.append(Group(name, record_id, cycles, size + invalid, self._channels(cl[1]), flags))
                    cg = cl[0]
                if records:
                    yield from self._records(found, id_size, b"".join(self._data(links[2])))
                else:
                    yield from ((g, None) for g in found)
                at = links[0]
        except (MdfError, struct.error, zlib.error) as e:
            self.warnings.append(str(e))

    def _records(self, groups: list[Group], id_size: int, stream: bytes) -> Iterator[tuple[Group, np.ndarray]]:
        if len(groups) == 1:
            g = groups[0]
            wide = g.size + id_size
            n = min(g.cycles, len(stream) // wide) if wide else 0
            if n < g.cycles:
                self.warnings.append(f"{g.name}: {g.cycles - n} records are missing")
            yield g, np.frombuffer(stream, np.uint8, n * wide).reshape(n, wide)[:, id_size:]
            return
        if any(g.flags & 1 for g in groups):
            self.warnings.append("records of variable length are not read")
            return
        by_id, places, at = {g.record_id: g for g in groups}, {g.record_id: [] for g in groups}, 0
        while at + id_size <= len(stream):
            number = int.from_bytes(stream[at : at + id_size], "little")
            if number not in by_id:
                self.warnings.append(f"unknown record at byte {at}")
                break
            if at + id_size + by_id[number].size > len(stream):
                break
            places[number].append(at + id_size)
            at += id_size + by_id[number].size
        flat = np.frombuffer(stream, np.uint8)
        for number, g in by_id.items():
            starts = np.array(places[number], dtype=np.int64)
            yield g, flat[starts[:, None] + np.arange(g.size)] if len(starts) else np.empty((0, g.size), np.uint8)


def raw_values(c: Channel, records: np.ndarray):
    """The channel's raw column: integers, floats, or a list of texts or bytes; None where it can't be read."""
    size = (c.bit_offset + c.bits + 7) // 8
    part = records[:, c.byte_offset : c.byte_offset + size]
    if c.kind == 1 or part.shape[1] < size:
        return None
    if c.kind in (3, 6):
        return np.arange(len(records), dtype=np.int64)
    if c.data_type in (4, 5):
        kind = {2: "f2", 4: "f4", 8: "f8"}.get(size)
        return None if kind is None else np.ascontiguousarray(part).view(("<" if c.data_type == 4 else ">") + kind).ravel().astype(np.float64)
    if c.data_type in (6, 7):
        return [bytes(r).split(b"\0", 1)[0].decode("latin-1" if c.data_type == 6 else "utf-8", "replace").strip() for r in part]
    if c.data_type > 3:
        return [bytes(r) for r in part]
    if size > 8:
        return None
    ordered = part if c.data_type in (0, 2) else part[:, ::-1]
    padded = np.zeros((len(part), 8), np.uint8)
    padded[:, :size] = ordered
    value = padded.view("<u8").ravel() >> np.uint64(c.bit_offset)
    if c.bits < 64:
        value &= np.uint64((1 << c.bits) - 1)
    if c.data_type in (2, 3):
        shift = np.int64(64 - c.bits)
        return (value.astype(np.int64) << shift) >> shift
    return value


def physical(c: Channel, raw) -> tuple[np.ndarray, list | None]:
    """(values, labels or None). Texts are numbered 0, 1, ... and become labels."""
    if isinstance(raw, list):
        texts = [x.hex() if isinstance(x, bytes) else x for x in raw]
        return np.arange(len(texts), dtype=np.float64), texts
    x, cc = np.asarray(raw).astype(np.float64), c.conversion
    if not cc or cc["kind"] == 0:
        return x, None
    v = cc["values"]
    with np.errstate(all="ignore"):
        if cc["kind"] == 1:
            return x * v[1] + v[0], None
        if cc["kind"] == 2:
            return (v[0] * x * x + v[1] * x + v[2]) / (v[3] * x * x + v[4] * x + v[5]), None
        if cc["kind"] in (4, 5) and len(v) >= 4:
            keys, values = np.array(v[0::2]), np.array(v[1::2])
            if cc["kind"] == 4:
                return np.interp(x, keys, values), None
            right = np.clip(np.searchsorted(keys, x), 1, len(keys) - 1)
            return values[np.where(x - keys[right - 1] <= keys[right] - x, right - 1, right)], None
    if cc["kind"] == 7:
        table = dict(zip(v, cc["texts"], strict=False))
        return x, [table.get(k) for k in x.tolist()]
    if cc["kind"] == 8:
        spans = list(zip(v[0::2], v[1::2], cc["texts"], strict=False))
        return x, [next((t for a, b, t in spans if a <= k <= b), None) for k in x.tolist()]
    return x, None


def _times(group: Group, records: np.ndarray) -> np.ndarray | None:
    master = next((c for c in group.channels if c.kind in (2, 3)), None)
    raw = raw_values(master, records) if master else None
    return None if raw is None or isinstance(raw, list) else physical(master, raw)[0]


_SAMPLES = [("message", pa.string()), ("signal", pa.string()), ("unit", pa.string()), ("seq", pa.int64()), ("t_s", pa.float64()), ("value", pa.float64()), ("label", pa.string())]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """samples of every decoded channel; a group's name is the message, its channel number is unknown."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                reader = Reader(content.as_py())
                for k, (group, records) in enumerate(reader.groups()):
                    times = _times(group, records)
                    if times is None or not len(times):
                        continue
                    for c in group.channels:
                        if c.kind in (2, 3) or c.name.partition(".")[0] in BUS_GROUPS or (raw := reader.column(group, c, records)) is None:
                            continue
                        values, labels = physical(c, raw)
                        n = len(values)
                        columns = [[group.name or f"Group {k}"] * n, [c.name] * n, [c.unit] * n, np.arange(n), times, values, labels or [None] * n]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, _SAMPLES, strict=True)], names=[name for name, _ in _SAMPLES])

    got = _files(spark, path).mapInArrow(run, "message string, signal string, unit string, seq long, t_s double, value double, label string")
    none = F.lit(None).cast("int")
    return got.select(signal_key(F.lit("CAN"), none, F.col("message"), F.col("signal")).alias("signal_key"), F.lit("CAN").alias("bus"), none.alias("channel"), "message", F.lit(0).cast("long").alias("message_id"), "signal", "unit", "seq", "t_s", "value", "label")


_FRAMES = [("t_s", pa.float64()), ("bus", pa.string()), ("channel", pa.int32()), ("arb_id", pa.int64()), ("is_extended", pa.bool_()), ("is_fd", pa.bool_()), ("is_error", pa.bool_()), ("is_remote", pa.bool_()), ("is_brs", pa.bool_()), ("dlc", pa.int32()), ("direction", pa.string()), ("payload", pa.binary())]


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """frames of raw bus groups (BUS_GROUPS: data, error and remote frames), in time order; times since the first."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                parts = []
                reader = Reader(content.as_py())
                for group, records in reader.groups():
                    times = _times(group, records)
                    flat = {c.name: c for top in group.channels for c in (top, *top.parts)}
                    base = next((b for b, has_data in BUS_GROUPS.items() if any(n.startswith(f"{b}.") for n in flat) and (not has_data or {f"{b}.ID", f"{b}.DataBytes"} <= flat.keys())), None)
                    if times is None or base is None or not len(times):
                        continue
                    error, remote = base == "CAN_ErrorFrame", base == "CAN_RemoteFrame"
                    get = lambda name, otherwise=0: np.asarray(raw_values(flat[f"{base}.{name}"], records)).astype(np.int64) if f"{base}.{name}" in flat else np.full(len(records), otherwise)  # noqa: B023, E731
                    length = get("DataLength") if f"{base}.DataLength" in flat else get("DLC")
                    data = reader.column(group, flat[f"{base}.DataBytes"], records) if BUS_GROUPS[base] else [b""] * len(times)
                    if data is None:
                        continue
                    ident, way = get("ID"), get("Dir")
                    fd = get("EDL") != 0
                    extended = get("IDE") != 0 if f"{base}.IDE" in flat else ident > 0x7FF
                    parts.append((times, ["CAN" if base[0] == "C" else "LIN"] * len(times), get("BusChannel", 1), ident & 0x1FFFFFFF, extended, fd, np.full(len(times), error), np.full(len(times), remote), get("BRS") != 0, np.where(error, 0, length), np.where(way == 1, "Tx", "Rx"), [d[:n] for d, n in zip(data, length.tolist(), strict=True)]))
                if not parts:
                    continue
                joined = [np.concatenate([np.asarray(p[k]) for p in parts]) if k < 11 else [x for p in parts for x in p[11]] for k in range(12)]
                order = np.argsort(joined[0], kind="stable")
                joined[0] = joined[0] - joined[0][order[0]]
                columns = [x[order] if k < 11 else [x[i] for i in order] for k, x in enumerate(joined)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(order))), *[pa.array(x, t) for x, (_, t) in zip(columns, _FRAMES, strict=True)]], names=["frame_idx", *[n for n, _ in _FRAMES]])

    return _files(spark, path).mapInArrow(run, "frame_idx long, t_s double, bus string, channel int, arb_id long, is_extended boolean, is_fd boolean, is_error boolean, is_remote boolean, is_brs boolean, dlc int, direction string, payload binary")


def content(data: bytes) -> dict[str, bool]:
    """What a file holds: raw_can, raw_lin, decoded; records aren't read."""
    found = {"raw_can": False, "raw_lin": False, "decoded": False}
    for group, _ in Reader(data).groups(records=False):
        names = {c.name.partition(".")[0] for c in group.channels if c.kind not in (2, 3)}
        found["raw_can"] |= "CAN_DataFrame" in names
        found["raw_lin"] |= "LIN_Frame" in names
        found["decoded"] |= bool(names - BUS_GROUPS.keys())
    return found


def contents(spark: SparkSession, path: str) -> dict[str, bool]:
    """content() over all files of the path."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_pylist([content(data.as_py())])

    kinds = ("raw_can", "raw_lin", "decoded")
    row = _files(spark, path).mapInArrow(run, ", ".join(f"{k} boolean" for k in kinds)).agg(*[F.bool_or(k).alias(k) for k in kinds]).first()
    return {k: bool(row[k]) for k in kinds}


def read_warnings(spark: SparkSession, path: str) -> DataFrame:
    """(warning) of the files: damaged parts, and channels or conversions that can't be read."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                reader = Reader(data.as_py())
                for group, records in reader.groups():
                    for c in group.channels:
                        for part in (c, *c.parts):
                            if part.kind not in (2, 3) and not part.parts:
                                reader.column(group, part, records)
                yield pa.RecordBatch.from_arrays([pa.array(reader.warnings, pa.string())], names=["warning"])

    return _files(spark, path).mapInArrow(run, "warning string")


class Writer:
    """A plain MDF 4.10 file: one group per message, times and doubles, labels as value-to-text."""

    def __init__(self):
        self.body = bytearray(b"MDF     4.10    tracewrt".ljust(28, b"\0") + struct.pack("<H", 410)).ljust(64, b"\0")
        self.first = 0
        self.last: int | None = None
        self._put(b"HD", (0,) * 6, struct.pack("<QhhBBBB", 0, 0, 0, 0, 0, 0, 0) + bytes(16))

    def _put(self, kind: bytes, links: tuple[int, ...], data: bytes) -> int:
        self.body += b"\0" * (-len(self.body) % 8)
        at = len(self.body)
        self.body += struct.pack("<4sIQQ", b"##" + kind, 0, 24 + 8 * len(links) + len(data), len(links)) + struct.pack(f"<{len(links)}q", *links) + data
        return at

    def _text(self, text: str) -> int:
        raw = text.encode() + b"\0"
        return self._put(b"TX", (), raw + b"\0" * (-len(raw) % 8)) if text else 0

    def group(self, name: str, times: np.ndarray, signals: list[tuple[str, str, np.ndarray, dict[float, str]]], packed: bool = True) -> None:
        """signals: (name, unit, values, {value: label})."""
        table = np.column_stack([times, *[v for _, _, v, _ in signals]]).astype("<f8").tobytes()
        nxt = 0
        for k in range(len(signals), -1, -1):
            label, unit, labels = (signals[k - 1][0], signals[k - 1][1], signals[k - 1][3]) if k else ("t", "s", {})
            cc = 0
            if labels:
                refs = [self._text(t) for t in labels.values()]
                cc = self._put(b"CC", (0, 0, 0, 0, *refs, 0), struct.pack("<BBHHHdd", 7, 0, 0, len(refs) + 1, len(refs), 0, 0) + struct.pack(f"<{len(refs)}d", *labels))
            nxt = self._put(b"CN", (nxt, 0, self._text(label), 0, cc, 0, self._text(unit), 0), struct.pack("<BBBBIIIIBBH", 0 if k else 2, 0 if k else 1, 4, 0, 8 * k, 64, 0, 0, 0, 0, 0) + bytes(48))
        size = 8 * (len(signals) + 1)
        cg = self._put(b"CG", (0, nxt, self._text(name), 0, 0, 0), struct.pack("<QQHHIII", 0, len(times), 0, 0, 0, size, 0))
        if packed:
            squeezed = zlib.compress(np.frombuffer(table, np.uint8).reshape(-1, size).T.tobytes())
            data = self._put(b"DZ", (), struct.pack("<2sBBIQQ", b"DT", 1, 0, size, len(table), len(squeezed)) + squeezed)
        else:
            data = self._put(b"DT", (), table)
        dg = self._put(b"DG", (0, cg, data, 0), bytes(8))
        struct.pack_into("<q", self.body, 64 + 24 if self.last is None else self.last + 24, dg)
        self.last = dg

    def save(self, path: str) -> None:
        with open(path, "wb") as out:
            out.write(self.body)


def write_samples(samples: DataFrame, path: str) -> None:
    """An MDF 4 file of decoded samples, a group per message and signal; signals pass through the driver one by one."""
    writer = Writer()
    keys = samples.select("signal_key", "message", "signal", "unit").distinct().orderBy("signal_key").collect()  # the signals' names
    for k in keys:
        rows = samples.where(F.col("signal_key") == k["signal_key"]).orderBy("t_s", "seq").select("t_s", "value", "label").toPandas()
        labels = {float(v): t for v, t in zip(rows["value"], rows["label"], strict=True) if t}
        writer.group(k["message"], rows["t_s"].to_numpy(float), [(k["signal"], k["unit"] or "", rows["value"].to_numpy(float), labels)])
    writer.save(path)
