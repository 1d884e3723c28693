"""Frames to signal samples: database lookup, bit fields, multiplexers, scaling, labels.

The databases are small driver-side tables, so both joins are broadcast; frames are never shuffled by the
decode. Every signal goes through one expression whose layout comes from the database row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bits
from .keys import signal_key

MOST_WORDS = 8


def pgn(arb_id: Column) -> Column:
    kind = F.shiftright(arb_id, 16).bitwiseAND(F.lit(255).cast("bigint"))
    specific = F.shiftright(arb_id, 8).bitwiseAND(F.lit(255).cast("bigint"))
    return F.when(kind < 240, F.shiftleft(kind, 8)).otherwise(F.shiftleft(kind, 8).bitwiseOR(specific))


def sender(arb_id: Column) -> Column:
    return arb_id.bitwiseAND(F.lit(255).cast("bigint"))


def extended(frames: DataFrame) -> Column:
    """Whether a frame has a 29-bit identifier: marked so, or too large for 11 bits."""
    marked = F.coalesce("is_extended", F.lit(False)) if "is_extended" in frames.columns else F.lit(False)
    return marked | (F.col("arb_id") > 0x7FF)


def decodable(frames: DataFrame) -> DataFrame:
    return frames.where(~F.coalesce("is_error", F.lit(False)) & ~F.coalesce("is_remote", F.lit(False)))


def candidates(frames: DataFrame, messages: DataFrame, config: DataFrame) -> DataFrame:
    """(bus, channel, arb_id, is_extended, db_id, ord, name, length, rank): the messages of each distinct identifier, best first.

    A channel's own database counts, else its bus's. Exact identifiers of the same kind come first; those of an
    extended one's parameter group follow, with the sender if the group stands under several senders.
    """
    ids = decodable(frames).select("bus", "channel", "arb_id", extended(frames).alias("_ext")).distinct()
    own = config.where("channel > 0").select(F.col("bus").alias("_b"), F.col("channel").alias("_c"), F.col("db_id").alias("_own"))
    whole = config.where("channel = 0").select(F.col("bus").alias("_wb"), F.col("db_id").alias("_whole"))
    ids = ids.join(F.broadcast(own), (F.col("bus") == F.col("_b")) & (F.col("channel") == F.col("_c")), "left").join(F.broadcast(whole), F.col("bus") == F.col("_wb"), "left")
    ids = ids.select("bus", "channel", "arb_id", F.coalesce("_own", "_whole").alias("_db"), "_ext", pgn(F.col("arb_id")).cast("int").alias("_pgn"), sender(F.col("arb_id")).cast("int").alias("_sa"))
    senders = messages.where("is_extended").groupBy(F.col("db_id").alias("_sdb"), F.col("pgn").alias("_spgn")).agg(F.count_distinct("sa").alias("senders"))
    known = messages.join(F.broadcast(senders), (F.col("db_id") == F.col("_sdb")) & (F.col("pgn") == F.col("_spgn")), "left").drop("_sdb", "_spgn")
    exact = (F.col("frame_id") == F.col("arb_id")) & (F.col("is_extended") == F.col("_ext"))
    group = F.col("_ext") & (F.col("arb_id") > 0x7FF) & F.col("is_extended") & (F.col("frame_id") > 0x7FF) & (F.col("pgn") == F.col("_pgn")) & ((F.col("senders") <= 1) | (F.col("sa") == F.col("_sa")))
    found = ids.join(F.broadcast(known), (F.col("_db") == F.col("db_id")) & (exact | group))
    found = found.withColumn("_far", F.when(exact, 0).otherwise(1))
    rank = F.row_number().over(Window.partitionBy("bus", "channel", "arb_id", "_ext").orderBy("_far", "ord"))
    return found.select("bus", "channel", "arb_id", F.col("_ext").alias("is_extended"), "db_id", "ord", "name", "length", rank.alias("rank"))


def named(resolved: DataFrame) -> DataFrame:
    """resolved with message: the name, and [SA 0xNN] where extended identifiers of several senders share it."""
    several = F.size(F.collect_set(F.when(F.col("is_extended"), sender(F.col("arb_id")))).over(Window.partitionBy("bus", "channel", "db_id", "ord"))) > 1
    split = several & F.col("is_extended")
    return resolved.withColumn("message", F.when(split, F.format_string("%s [SA 0x%02X]", "name", sender(F.col("arb_id")))).otherwise(F.col("name"))).withColumn("split", split)


def bind(frames: DataFrame, messages: DataFrame, config: DataFrame) -> DataFrame:
    """frames with their message (db_id, ord, message, message_id, message_length); unmatched ones have NULLs."""
    found = named(candidates(frames, messages, config).where("rank = 1")).select(
        F.col("bus").alias("_b"), F.col("channel").alias("_c"), F.col("arb_id").alias("_a"), F.col("is_extended").alias("_x"), "db_id", "ord", "message", F.col("length").alias("message_length"),
    )
    on = (F.col("bus") == F.col("_b")) & F.col("channel").eqNullSafe(F.col("_c")) & (F.col("arb_id") == F.col("_a")) & (extended(frames) == F.col("_x"))
    return frames.join(F.broadcast(found), on, "left").drop("_b", "_c", "_a", "_x")


def raw_to_physical(raw: Column, length: Column, signed: Column, is_float: Column, scale: Column, offset: Column) -> Column:
    number = F.when(is_float, bits.float_of_bits(raw, length)).when(~signed & (length == 64), bits.unsigned_double(raw)).otherwise(raw.cast("double"))
    return F.when((scale == 1) & (offset == 0), number).otherwise(number * scale + offset) + F.lit(0.0)


def decode(frames: DataFrame, messages: DataFrame, signals: DataFrame, config: DataFrame, words: int = MOST_WORDS) -> DataFrame:
    """samples of frames. `words` is the number of 8-byte words that the databases' messages need (8 always suffices).

    A signal needs all its bytes in the frame, and every multiplexer above it present and open; a frame longer than
    its message counts up to the message's length. Signals without a value give no sample.
    """
    bound = bind(decodable(frames), messages, config).where("ord is not null")
    bound = bound.withColumn("_size", F.least(F.octet_length("payload"), F.col("message_length")))
    prepared = bits.with_words(bound, "payload", words).select("frame_idx", "t_s", "bus", "channel", "arb_id", "direction", "message", "_size", "_le", "_be", F.col("db_id").alias("_db"), F.col("ord").alias("_ord"))
    s = signals.select("db_id", "ord", "signal", "place", "first", F.col("length").alias("len"), "big", "signed", "is_float", "scale", "offset", "unit", "needed", "branches", "choices")
    rows = prepared.join(F.broadcast(s), (F.col("_db") == F.col("db_id")) & (F.col("_ord") == F.col("ord")))
    inside = bits.field_sql("_le", "_be", "b.first", "b.length", "b.big", "b.signed")
    rows = rows.where(F.expr(f"_size >= needed and (size(branches) = 0 or forall(branches, b -> _size >= b.needed and (array_contains(b.ids, {inside}) or exists(b.ranges, r -> {inside} between r.low and r.high))))"))
    rows = rows.withColumn("raw", F.expr(bits.field_sql("_le", "_be", "first", "len", "big", "signed")))
    value = raw_to_physical(F.col("raw"), F.col("len"), F.col("signed"), F.col("is_float"), F.col("scale"), F.col("offset"))
    label = F.when(~F.col("is_float") & (F.size("choices") > 0), F.try_element_at("choices", F.col("raw")))
    out = rows.select(
        signal_key(F.col("bus"), F.col("channel"), F.col("message"), F.col("signal")).alias("signal_key"), "bus", "channel", "message", F.col("arb_id").alias("message_id"), "signal", "unit",
        (F.col("frame_idx")).alias("seq"), "t_s", value.alias("value"), label.alias("label"), "raw",
    )
    return out.where(~F.isnan("value"))


def words_needed(databases) -> int:
    longest = max((m.length for d in databases for m in d.messages), default=8)
    return max(1, min(MOST_WORDS, (longest + 7) // 8))


def from_first(frames: DataFrame) -> DataFrame:
    """Times in seconds since the first frame in file order."""
    first = frames.agg(F.min_by("t_s", "frame_idx").alias("_t0"))
    return frames.join(F.broadcast(first)).withColumn("t_s", F.col("t_s") - F.col("_t0")).drop("_t0")


def decode_frame(frames: DataFrame, frame_idx: int, messages: DataFrame, signals: DataFrame, config: DataFrame) -> DataFrame:
    """Samples of one frame by its first candidate message that gives any."""
    one = frames.where(F.col("frame_idx") == frame_idx)
    for row in candidates(one, messages, config).orderBy("rank").collect():  # of one identifier
        chosen = messages.where((F.col("db_id") == row["db_id"]) & (F.col("ord") == row["ord"]))
        found = decode(one, chosen, signals, config)
        if found.limit(1).count():
            return found
    return decode(one, messages.limit(0), signals, config)


def physical_to_label(value: Column, scale: Column, offset: Column, choices: Column) -> Column:
    """The label of a physical value: '' for NaN, NULL where it is no whole raw step or has no label."""
    raw = (value - offset) / scale
    near = F.rint(raw)
    whole = (F.abs(raw - near) <= F.lit(1e-6) * F.greatest(F.lit(1.0), F.abs(near))) & (F.abs(near) < F.lit(2.0**62))
    key = F.when(whole, near.cast("bigint"))
    return F.when(F.isnan(value), F.lit("")).otherwise(F.get(F.filter(F.map_entries(choices), lambda e: e["key"] == key), 0)["value"])


def short_frames(bound: DataFrame) -> DataFrame:
    """Per message: frames shorter than it."""
    return bound.where("ord is not null").groupBy("message").agg(F.count_if(F.octet_length("payload") < F.col("message_length")).alias("n_short")).where("n_short > 0")


def counters(bound: DataFrame) -> DataFrame:
    """One row: total, error, remote, decoded and unmatched frames."""
    special = F.coalesce("is_error", F.lit(False)) | F.coalesce("is_remote", F.lit(False))
    return bound.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("is_error", F.lit(False))).alias("errors"), F.count_if(F.coalesce("is_remote", F.lit(False))).alias("remotes"),
        F.count_if(F.col("ord").isNotNull() & ~special).alias("decoded"), F.count_if(F.col("ord").isNull() & ~special).alias("unmatched"),
    )


def message_hits(bound: DataFrame) -> DataFrame:
    return bound.where("ord is not null").groupBy("bus", "channel", "message").agg(F.count(F.lit(1)).alias("n"))


def match_scores(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """(db_id, bus, channel, ids, hits, percent): how many of a channel's identifiers a database knows.

    Exact identifiers count first, then parameter groups of the rest; on LIN the frame length must be equal too.
    """
    ids = decodable(frames).withColumn("_ext", extended(frames)).groupBy("bus", "channel", "arb_id", "_ext").agg(F.max_by("dlc", "frame_idx").alias("dlc"))
    total = ids.groupBy("bus", "channel").agg(F.count(F.lit(1)).alias("ids"))
    ids = ids.withColumn("_p", F.when(F.col("arb_id") > 0x7FF, pgn(F.col("arb_id"))))
    exact = (F.col("frame_id") == F.col("arb_id")) & (F.col("is_extended") == F.col("_ext")) & ((F.col("bus") != "LIN") | (F.col("dlc") == F.col("length")))
    group = F.col("is_extended") & (F.col("frame_id") > 0x7FF) & (F.col("pgn") == F.col("_p")) & (F.col("bus") != "LIN")
    hits = ids.join(F.broadcast(messages), exact | group).groupBy("db_id", "bus", "channel").agg(F.count_distinct("arb_id", "_ext").alias("hits"))
    t = total.select(F.col("bus").alias("_b"), F.col("channel").alias("_c"), "ids")
    return hits.join(t, (F.col("bus") == F.col("_b")) & F.col("channel").eqNullSafe(F.col("_c"))).select("db_id", "bus", "channel", "ids", "hits", (100.0 * F.col("hits") / F.col("ids")).alias("percent"))
