"""Message databases: DBC and LDF text to the tables db_messages, db_signals and db_choices."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


#: Longer ranges of multiplexer values are kept as ranges.
LISTED = 256


class DatabaseError(ValueError):
    """A database that can't be read."""


@dataclass
class Signal:
    name: str
    start: int
    length: int
    big_endian: bool = False
    signed: bool = False
    is_float: bool = False
    scale: float = 1.0
    offset: float = 0.0
    unit: str = ""
    is_mux: bool = False
    mux_signal: str | None = None
    mux_ids: list[int] = field(default_factory=list)
    mux_ranges: list[tuple[int, int]] = field(default_factory=list)  # first and last value, beside mux_ids
    choices: dict[int, str] = field(default_factory=dict)

    @property
    def first_bit(self) -> int:
        """The place of the most significant bit in a big-endian bit stream."""
        return 8 * (self.start // 8) + 7 - self.start % 8

    @property
    def bytes_needed(self) -> int:
        return ((self.first_bit if self.big_endian else self.start) + self.length + 7) // 8


@dataclass
class Message:
    frame_id: int
    name: str
    length: int
    extended: bool = False
    signals: list[Signal] = field(default_factory=list)

    def signal(self, name: str) -> Signal | None:
        return next((s for s in self.signals if s.name == name), None)


@dataclass
class Database:
    messages: list[Message]
    bus: str = "CAN"
    warnings: list[str] = field(default_factory=list)


_MESSAGE = re.compile(r"^BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)")
_SIGNAL = re.compile(r"^SG_\s+(\w+)\s*(M|m\d+M?)?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(\s*([^,\s]+)\s*,\s*([^)\s]+)\s*\)\s*\[[^\]]*\]\s*\"([^\"]*)\"")
_CHOICE = re.compile(r"(-?\d+)\s+\"([^\"]*)\"")


def parse_dbc(text: str) -> Database:
    """Messages, signals, multiplexers (extended ones too), float types and value tables."""
    messages: dict[int, Message] = {}
    warnings: list[str] = []
    current: Message | None = None
    joined = re.sub(r"\r\n?", "\n", text)
    for line in joined.split("\n"):
        line = line.strip()
        if m := _MESSAGE.match(line):
            number = int(m[1])
            current = Message(number & 0x1FFFFFFF, m[2], int(m[3]), bool(number & 0x80000000))
            messages[number] = current
        elif line.startswith("SG_ ") and current is not None:
            if not (m := _SIGNAL.match(line)):
                warnings.append(f"unreadable signal: {line[:80]}")
                continue
            mark = m[2] or ""
            s = Signal(m[1], int(m[3]), int(m[4]), m[5] == "0", m[6] == "-", scale=float(m[7]) or 1.0, offset=float(m[8]), unit=m[9], is_mux=mark.endswith("M"))
            if mark.startswith("m"):
                s.mux_ids = [int(re.sub(r"\D", "", mark))]
            current.signals.append(s)
        elif line and not line.startswith("SG_"):
            current = None if not line.startswith(("BO_", "SG_")) else current
    for message in messages.values():
        root = next((s.name for s in message.signals if s.is_mux and not s.mux_ids), None)
        for s in message.signals:
            if s.mux_ids:
                s.mux_signal = root
    for m in re.finditer(r"^SG_MUL_VAL_\s+(\d+)\s+(\w+)\s+(\w+)\s+([^;]*);", joined, re.MULTILINE):
        message = messages.get(int(m[1]))
        if message and (s := message.signal(m[2])):
            s.mux_signal = m[3]
            spans = [(int(a), int(b)) for a, b in re.findall(r"(\d+)\s*-\s*(\d+)", m[4])]
            s.mux_ids = [v for a, b in spans if b - a < LISTED for v in range(a, b + 1)]
            s.mux_ranges = [(a, b) for a, b in spans if b - a >= LISTED]
    for m in re.finditer(r"^SIG_VALTYPE_\s+(\d+)\s+(\w+)\s*:?\s*([123])", joined, re.MULTILINE):
        message = messages.get(int(m[1]))
        if message and (s := message.signal(m[2])):
            s.is_float = m[3] in "12"
    for m in re.finditer(r"^VAL_\s+(\d+)\s+(\w+)\s+((?:-?\d+\s+\"[^\"]*\"\s*)*);", joined, re.MULTILINE):
        message = messages.get(int(m[1]))
        if message and (s := message.signal(m[2])):
            s.choices = {int(a): b for a, b in _CHOICE.findall(m[3])}
    if not messages:
        raise DatabaseError("the database holds no messages")
    return Database([m for m in messages.values() if m.name != "VECTOR__INDEPENDENT_SIG_MSG"], "CAN", warnings)


def _block(text: str, name: str) -> str:
    """The body of a braced section of an LDF."""
    if not (m := re.search(rf"\b{name}\s*\{{", text)):
        return ""
    depth, at = 1, m.end()
    while at < len(text) and depth:
        depth += {"{": 1, "}": -1}.get(text[at], 0)
        at += 1
    return text[m.end() : at - 1]


def parse_ldf(text: str) -> Database:
    """Frames, signals and encodings; all fields are little-endian. Every frame and signal must survive."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.DOTALL)
    sizes = {m[1]: int(m[2]) for m in re.finditer(r"(\w+)\s*:\s*(\d+)\s*,", _block(text, "Signals"))}
    encodings: dict[str, tuple[float, float, str, dict[int, str]]] = {}
    for m in re.finditer(r"(\w+)\s*\{([^}]*)\}", _block(text, "Signal_encoding_types")):
        scale, offset, unit, labels = 1.0, 0.0, "", {}
        for line in m[2].split(";"):
            parts = [p.strip() for p in line.split(",")]
            if parts[0] == "physical_value" and len(parts) >= 5:
                scale, offset = float(parts[3]) or 1.0, float(parts[4])
                unit = parts[5].strip('"') if len(parts) > 5 else ""
            elif parts[0] == "logical_value" and len(parts) >= 3:
                labels[int(parts[1], 0)] = parts[2].strip('"')
        encodings[m[1]] = (scale, offset, unit, labels)
    of_signal = {s.strip(): m[1] for m in re.finditer(r"(\w+)\s*:\s*([^;]*);", _block(text, "Signal_representation")) for s in m[2].split(",")}
    messages, used = [], set()
    for m in re.finditer(r"(\w+)\s*:\s*(0x[0-9A-Fa-f]+|\d+)\s*,\s*\w+\s*,\s*(\d+)\s*\{([^}]*)\}", _block(text, "Frames")):
        message = Message(int(m[2], 0), m[1], int(m[3]))
        for s in re.finditer(r"(\w+)\s*,\s*(\d+)\s*;", m[4]):
            if s[1] not in sizes:
                raise DatabaseError(f"frame {m[1]} holds an unknown signal: {s[1]}")
            scale, offset, unit, labels = encodings.get(of_signal.get(s[1], ""), (1.0, 0.0, "", {}))
            message.signals.append(Signal(s[1], int(s[2]), sizes[s[1]], scale=scale, offset=offset, unit=unit, choices=dict(labels)))
            used.add(s[1])
        messages.append(message)
    if not messages:
        raise DatabaseError("the LDF holds no frames")
    return Database(messages, "LIN")


def load_database(path: str) -> Database:
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in (".dbc", ".ldf"):
        raise DatabaseError(f"unsupported database format: {suffix or path}")
    with open(path, "rb") as source:
        data = source.read()
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    return parse_ldf(text) if suffix == ".ldf" else parse_dbc(text)


def pgn_of(frame_id: int) -> int:
    """The parameter group without data-page bits: PDU 1 formats carry a destination that is not part of it."""
    kind, specific = frame_id >> 16 & 0xFF, frame_id >> 8 & 0xFF
    return kind << 8 if kind < 240 else kind << 8 | specific


_BIT_FIELD = "struct<first:int,length:int,big:boolean,signed:boolean,needed:int,ids:array<bigint>,ranges:array<struct<low:bigint,high:bigint>>>"
MESSAGES = "db_id string, frame_id long, is_extended boolean, name string, length int, pgn int, sa int, ord int"
SIGNALS = f"db_id string, ord int, frame_id long, message string, message_length int, signal string, place int, start_bit int, first int, length int, big boolean, signed boolean, is_float boolean, scale double, offset double, unit string, needed int, mux_signal string, mux_ids array<bigint>, branches array<{_BIT_FIELD}>, choices map<bigint,string>"


def _branches(message: Message, signal: Signal) -> list[tuple]:
    """The multiplexers above a signal, outermost last, with the values that open its branch."""
    out, seen = [], set()
    while (signal.mux_ids or signal.mux_ranges) and signal.mux_signal and signal.mux_signal not in seen:
        seen.add(signal.mux_signal)
        mux = message.signal(signal.mux_signal)
        if mux is None:
            break
        out.append((mux.first_bit if mux.big_endian else mux.start, mux.length, mux.big_endian, mux.signed, mux.bytes_needed, signal.mux_ids, signal.mux_ranges))
        signal = mux
    return out


def tables(spark: SparkSession, databases: dict[str, Database]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """db_messages, db_signals, db_choices of named databases."""
    messages, signals, choices = [], [], []
    for db, database in databases.items():
        for ord_, m in enumerate(database.messages):
            wide = m.extended or m.frame_id > 0x7FF
            messages.append((db, m.frame_id, wide, m.name, m.length, pgn_of(m.frame_id) if wide else None, m.frame_id & 255 if wide else None, ord_))
            for place, s in enumerate(m.signals):
                signals.append((db, ord_, m.frame_id, m.name, m.length, s.name, place, s.start, s.first_bit if s.big_endian else s.start, s.length, s.big_endian, s.signed, s.is_float, s.scale, s.offset,
                                s.unit, s.bytes_needed, s.mux_signal, s.mux_ids, _branches(m, s), s.choices))
                choices += [(db, m.name, s.name, raw, label) for raw, label in s.choices.items()]
    return (spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(choices, "db_id string, message string, signal string, raw long, label string"))


def channel_config(spark: SparkSession, chosen: dict[tuple[str, int], str]) -> DataFrame:
    """(bus, channel, db_id); channel 0 stands for every channel of its bus."""
    return spark.createDataFrame([(bus, number, db) for (bus, number), db in chosen.items()], "bus string, channel int, db_id string")


def compatibility_warning(path: str, bus: str) -> str | None:
    ldf = path.lower().endswith(".ldf")
    if ldf and bus == "CAN":
        return "An LDF describes a LIN cluster; it can't decode CAN frames"
    if not ldf and bus == "LIN":
        return "A CAN database is assigned to a LIN channel"
    return None
