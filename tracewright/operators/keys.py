"""Bus identities, signal keys and their order; target schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATED = "Generate Signals"
TIME = "Time"
UNKNOWN_CHANNEL = 255

FRAMES = "frame_idx long, t_s double, bus string, channel int, arb_id long, is_extended boolean, is_fd boolean, is_error boolean, is_remote boolean, is_brs boolean, dlc int, direction string, payload binary"
SAMPLES = "signal_key string, bus string, channel int, message string, message_id long, signal string, unit string, seq long, t_s double, value double, label string"
BUS_STATUS = "t_s double, channel int, kind string, values map<string,string>"

#: Bits of the frame flags.
FLAGS = {"extended": 1, "fd": 2, "decoded": 4, "lin": 8, "error": 16, "remote": 32, "brs": 64}


def channel_prefix(bus: Column, channel: Column) -> Column:
    """CH1, LIN1, CH?, LIN?."""
    return F.concat(F.when(bus == "LIN", F.lit("LIN")).otherwise(F.lit("CH")), F.coalesce(channel.cast("string"), F.lit("?")))


def channel_label(bus: Column, channel: Column) -> Column:
    """CAN 1, LIN 2, CAN ?, for people."""
    return F.concat_ws(" ", F.coalesce(bus, F.lit("CAN")), F.coalesce(channel.cast("string"), F.lit("?")))


def signal_key(bus: Column, channel: Column, message: Column, signal: Column) -> Column:
    return F.concat_ws("::", channel_prefix(bus, channel), message, signal)


def generated_key(name: str) -> str:
    return f"CH?::{GENERATED}::{name}"


def channel_order(bus: Column, channel: Column) -> list[Column]:
    """CAN before LIN, numbers in order, unknown last."""
    return [F.when(bus == "LIN", 1).otherwise(0), F.coalesce(channel, F.lit(1 << 30))]


def known_channel(number: Column) -> Column:
    """A channel outside 0..254 is unknown."""
    return F.when(number.between(0, UNKNOWN_CHANNEL - 1), number.cast("int"))


def flags(*, extended: Column, fd: Column, lin: Column, error: Column, remote: Column, brs: Column) -> Column:
    parts = {"extended": extended, "fd": fd, "lin": lin, "error": error, "remote": remote, "brs": brs}
    total = F.lit(0)
    for name, column in parts.items():
        total = total + F.when(column, FLAGS[name]).otherwise(0)
    return total


def encode_channel_key(bus: str, number: int) -> str:
    return f"{bus}:{number}"


def decode_channel_key(text: str) -> tuple[str, int] | None:
    """'LIN:1' or a bare '1' (CAN); None where it is neither."""
    bus, colon, number = text.rpartition(":")
    bus = bus.strip().upper() if colon else "CAN"
    try:
        value = int(number)
    except ValueError:
        return None
    return (bus, value) if bus in ("CAN", "LIN") and value >= 0 else None


def seconds_from_first(t: str = "ts", order: str = "event_id", micros: bool = True) -> str:
    """SQL of t in seconds since the first row in file order, given that first value as base_us."""
    return f"(unix_micros(cast({t} as timestamp)) - base_us) / 1e6D" if micros else f"{t} - base"
