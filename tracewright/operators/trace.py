"""Trace operators over frames: search, previous frame of the same kind, differences, paging, rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import channel_label

#: A display may search data bytes only in stores of at most so many frames; a page and its step.
DATA_SEARCH_FRAMES, PAGE, PAGE_STEP = 500_000, 5_000, 1_000
KIND = ("arb_id", "channel", "bus", "is_extended", "is_error", "is_remote")
PADDED_BYTES = 64


def frame_text(frame_name: Column) -> Column:
    """'can <channel or ?> <id> <name> <direction> <dlc>', lower case."""
    return F.lower(F.concat_ws(" ", F.lower(F.coalesce("bus", F.lit("CAN"))), F.coalesce(F.col("channel").cast("string"), F.lit("?")), F.hex("arb_id"), F.coalesce(frame_name, F.lit("")), F.col("direction"), F.col("dlc").cast("string")))


def _identifier_needle(needle: str) -> str | None:
    """The hexadecimal digits asked for, without leading zeros or x; None where it can't be an identifier."""
    digits = needle.lower().lstrip("0x") or "0"
    return digits if re.fullmatch(r"[0-9a-f]{1,8}", digits) else None


def field_match(needle: str, exact_id_known: Column, with_data: Column) -> Column:
    """Any field of a frame answers the needle: identifier, name, direction, time, data bytes."""
    low = needle.strip().lower()
    out = F.instr(F.lower(F.coalesce("name", F.lit(""))), low) > 0
    if (digits := _identifier_needle(low)) is not None:
        own = F.lower(F.hex("arb_id"))
        out = out | F.when(exact_id_known, own == digits).otherwise(F.instr(own, low.removeprefix("0x")) > 0)
    if low in "rx":
        out = out | (F.col("direction") == "Rx")
    if low in "tx":
        out = out | (F.col("direction") == "Tx")
    try:
        out = out | (F.abs(F.col("t_s") - F.lit(float(low))) < 0.001)
    except ValueError:
        pass
    data = re.sub(r"\s+", "", low)
    if data and len(data) % 2 == 0 and re.fullmatch(r"[0-9a-f]+", data):
        padded = F.lower(F.rpad(F.hex("payload"), 2 * PADDED_BYTES, "0"))
        places = F.filter(F.sequence(F.lit(1), F.lit(max(1, 2 * PADDED_BYTES - len(data) + 1)), F.lit(2)), lambda i: F.substring(padded, i, len(data)) == data)
        out = out | (with_data & (F.instr(padded, data) > 0) & (F.size(places) > 0))
    return F.coalesce(out, F.lit(False))


def search(frames: DataFrame, needle: str = "", bus: str | None = None, channel: int | None = None, data_limit: int | None = None) -> DataFrame:
    """Frames that answer the needle and the channel filter, in the input's columns.

    Fields are asked first; only if no frame of the whole store (whatever its channel) answers by a field, the
    needle is looked for in the frames' text. That and the presence of the identifier are one aggregate row. With
    `data_limit` (for display), data bytes of stores of more frames are not looked at.
    """
    frames = frames if "name" in frames.columns else frames.withColumn("name", F.lit(None).cast("string"))
    columns = frames.columns
    out = frames
    if needle.strip():
        digits = _identifier_needle(needle.strip())
        with_data = F.lit(data_limit is None or frames.count() <= data_limit)
        # one pass: whether the identifier is there, and whether any field answers if it is and if it isn't
        matches = {known: field_match(needle, F.lit(known), with_data) for known in (True, False)}
        ever = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
        present = frames.agg(ever(F.lower(F.hex("arb_id")) == F.lit(digits)).alias("id"), *[ever(m).alias(f"any_{known}") for known, m in matches.items()]).first()
        known = bool(present["id"])
        out = frames.where(matches[known] if present[f"any_{known}"] else F.instr(frame_text(F.col("name")), needle.strip().lower()) > 0)
    if bus is not None:
        out = out.where(F.col("bus") == bus)
    if channel is not None:
        out = out.where(F.col("channel") == channel)
    return out.select(*columns)


def with_previous(frames: DataFrame) -> DataFrame:
    """Adds prev_idx, prev_t_s, prev_payload of the previous frame with the same identifier, channel and kind."""
    w = Window.partitionBy(*KIND).orderBy("frame_idx")
    return frames.select("*", F.lag("frame_idx").over(w).alias("prev_idx"), F.lag("t_s").over(w).alias("prev_t_s"), F.lag("payload").over(w).alias("prev_payload"))


def differences(frames: DataFrame) -> DataFrame:
    """with_previous plus delta_s (NULL for the first) and changed array<boolean>, one per data byte.

    Call it on all frames and filter afterwards: the previous frame doesn't depend on what is shown.
    """
    p = with_previous(frames)
    n = F.least(F.octet_length("payload"), F.lit(PADDED_BYTES))
    byte = lambda c, i: F.substring(F.hex(c), 2 * i + 1, 2)
    changed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i >= F.octet_length("prev_payload")) | (byte(F.col("payload"), i) != byte(F.col("prev_payload"), i)))
    none = F.array().cast("array<boolean>")
    flags = F.when((n == 0) | F.coalesce("is_remote", F.lit(False)), none).when(F.col("prev_idx").isNull(), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(False))).otherwise(changed)
    return p.withColumn("delta_s", F.col("t_s") - F.col("prev_t_s")).withColumn("changed", flags)


def page(frames: DataFrame, first: int = 0, size: int = PAGE) -> DataFrame:
    """Rows first .. first + size - 1 in frame order."""
    return frames.orderBy("frame_idx").offset(first).limit(size)


def window_of(frames: DataFrame, indices: list[int]) -> DataFrame:
    """Frames by index; those out of range are left out."""
    return frames.where(F.col("frame_idx").isin(list(indices)))


def first_at_or_after(frames: DataFrame, t: float) -> DataFrame:
    return frames.where(F.col("t_s") >= t).agg(F.min("frame_idx").alias("frame_idx"))


def last_at_or_before(frames: DataFrame, t: float) -> DataFrame:
    return frames.where(F.col("t_s") <= t).agg(F.max("frame_idx").alias("frame_idx"))


def in_time_order(frames: DataFrame) -> DataFrame:
    return frames.orderBy("t_s", "frame_idx")


def render(differing: DataFrame) -> DataFrame:
    """Text columns of a trace row from differences() with name and, if known, matched."""
    name = F.coalesce("name", F.when(F.col("matched"), F.lit("(decoded)")).otherwise(F.lit("(unmatched)"))) if "matched" in differing.columns else F.coalesce("name", F.lit("(unmatched)"))
    spaced = F.rtrim(F.regexp_replace(F.hex("payload"), "(..)", "$1 "))
    return differing.select(
        "frame_idx", F.format_string("%.6f", "t_s").alias("time"), F.when(F.col("delta_s").isNotNull(), F.format_string("%.3f", F.col("delta_s") * 1000)).otherwise("").alias("delta_ms"),
        channel_label(F.col("bus"), F.col("channel")).alias("bus"), F.concat(F.lit("0x"), F.hex("arb_id")).alias("id"), name.alias("name"), "direction", "dlc", spaced.alias("data"),
    )


def first_ids(frames: DataFrame, n: int = 20) -> DataFrame:
    """'CH1 | 0x100 | DLC=8 | Rx' of the first n identifiers seen."""
    first = frames.groupBy("bus", "channel", "arb_id").agg(F.min_by(F.struct("dlc", "direction"), "frame_idx").alias("s"), F.min("frame_idx").alias("frame_idx"))
    prefix = F.concat(F.when(F.col("bus") == "LIN", "LIN").otherwise("CH"), F.coalesce(F.col("channel").cast("string"), F.lit("?")))
    text = F.concat_ws(" | ", prefix, F.concat(F.lit("0x"), F.hex("arb_id")), F.concat(F.lit("DLC="), F.col("s.dlc").cast("string")), F.col("s.direction"))
    return first.orderBy("frame_idx").limit(n).select("frame_idx", text.alias("text"))


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("bus", "channel").agg(F.count(F.lit(1)).alias("n"))


def kinds(frames: DataFrame) -> DataFrame:
    return frames.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first_idx"))


def prescan(frames: DataFrame, limit: int = 50_000) -> DataFrame:
    """(bus, channel, ids, lengths) of the first frames; lengths maps a LIN identifier to its last frame's length."""
    head = frames.where(F.col("frame_idx") < limit).groupBy("bus", "channel", "arb_id").agg(F.max_by("dlc", "frame_idx").alias("dlc"))
    return head.groupBy("bus", "channel").agg(
        F.sort_array(F.collect_set("arb_id")).alias("ids"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("bus") == "LIN", F.struct("arb_id", "dlc"))))).alias("lengths"),
    )
