"""View transforms of series: segment breaks, step points, peaks; raw values and properties of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bits

#: Fixed value: a display may leave series of more samples without corners.
STEP_POINTS = 100_000


def _w():
    return Window.partitionBy("signal_key").orderBy("seq")


def segments(samples: DataFrame) -> DataFrame:
    """samples with drawn: the line to the next sample is drawn iff both are finite and time doesn't go back."""
    fine = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    nxt, nt = F.lead("value").over(_w()), F.lead("t_s").over(_w())
    return samples.withColumn("drawn", F.coalesce(fine(F.col("value")) & fine(nxt) & (nt >= F.col("t_s")), F.lit(False)))


def step_points(samples: DataFrame, most: int | None = None) -> DataFrame:
    """Vertices of the step curves (2n - 1 of n samples); with `most` (for display), longer series stay as they are."""
    rows = samples.withColumn("_next", F.lead("t_s").over(_w()))
    has_corner = F.col("_next").isNotNull()
    if most is not None:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("signal_key")))
        has_corner = has_corner & (F.col("_n") <= most)
    own = F.struct(F.lit(0).alias("corner"), F.col("t_s").alias("t_s"))
    corner = F.struct(F.lit(1).alias("corner"), F.col("_next").alias("t_s"))
    points = F.when(has_corner, F.array(own, corner)).otherwise(F.array(own))
    return rows.withColumn("_p", F.explode(points)).select("signal_key", "seq", "_p.corner", "_p.t_s", "value")


def peaks(samples: DataFrame, start: float, end: float, buckets: int) -> DataFrame:
    """Smallest and largest value in each of equal slices of a view."""
    inside = samples.where(F.col("t_s").between(F.lit(float(start)), F.lit(float(end))) & ~F.isnan("value"))
    k = F.least(F.floor((F.col("t_s") - start) / ((end - start) / buckets)), F.lit(buckets - 1)).cast("int")
    return inside.groupBy("signal_key", k.alias("bucket")).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))


def raw_hex(value: Column, scale: Column, offset: Column, length: Column, signed: Column, is_float: Column) -> Column:
    """0x... of a physical value's raw bits; '' where it is no raw step or out of range."""
    raw = (value - offset) / scale
    near = F.rint(raw)
    whole = ~F.isnan(value) & (F.abs(raw - near) <= F.lit(1e-6) * F.greatest(F.lit(1.0), F.abs(near))) & (F.abs(near) < F.lit(2.0**64))
    low = F.when(signed, -F.pow(F.lit(2.0), (length - 1).cast("double"))).otherwise(F.lit(0.0))
    high = F.pow(F.lit(2.0), F.when(signed, length - 1).otherwise(length).cast("double")) - 1
    held = F.when(whole & near.between(low, high), near)
    number = F.when(held >= 2.0**63, held - 2.0**64).otherwise(held).cast("bigint")  # the same 64 bits
    mask = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (64 - length).cast("int"))
    digits = F.ceil(length / 4).cast("int")
    text = F.concat(F.lit("0x"), F.lpad(F.hex(number.bitwiseAND(mask)), digits, "0"))
    fine = ~F.isnan(value) & (F.abs(value) < float("inf"))
    pattern = F.when(fine, bits.bits_of_float(raw, length))
    floating = F.concat(F.lit("0x"), F.lpad(F.hex(pattern), digits, "0"))
    return F.coalesce(F.when(is_float, floating).when(number.isNotNull(), text), F.lit(""))


def plain_hex(value: Column) -> Column:
    """0x... of a whole value of a signal without a definition; '' for any other."""
    size = F.abs(value)
    whole = ~F.isnan(value) & (size < float("inf")) & (F.rint(value) == value)
    # beyond 2^60 the 53 bits of the value stand before a whole number of zero digits and up to three zero bits
    digits = F.greatest(F.ceil((F.floor(F.log2(F.greatest(size, F.lit(1.0)))) - 58) / 4), F.lit(0)).cast("int")
    head = (size / F.pow(F.lit(16.0), digits.cast("double"))).cast("bigint")
    return F.when(whole, F.concat(F.when(value < 0, "-0x").otherwise("0x"), F.hex(head), F.repeat(F.lit("0"), digits))).otherwise("")


def raw_range(length: Column, signed: Column) -> tuple[Column, Column]:
    high = F.pow(F.lit(2.0), F.when(signed, length - 1).otherwise(length).cast("double")) - 1
    return F.when(signed, -high - 1).otherwise(F.lit(0.0)), high


def signal_properties(signals: DataFrame, db_id: str, message: str, signal: str) -> DataFrame:
    """(item, value) rows of a signal's definition; a [SA 0x..] ending of the message doesn't count."""
    plain = message.split(" [SA 0x")[0]
    row = signals.where((F.col("db_id") == db_id) & (F.col("message") == plain) & (F.col("signal") == signal))
    low, high = raw_range(F.col("length"), F.col("signed"))
    text = lambda c: c.cast("string")
    items = {
        "Message": F.col("message"), "ID": F.concat(F.lit("0x"), F.hex("frame_id")), "Start bit": text(F.col("start_bit")), "Length": text(F.col("length")),
        "Byte order": F.when(F.col("big"), "Motorola").otherwise("Intel"), "Type": F.when(F.col("is_float"), "float").when(F.col("signed"), "signed").otherwise("unsigned"),
        "Factor": text(F.col("scale")), "Offset": text(F.col("offset")), "Unit": F.col("unit"), "Raw minimum": text(low), "Raw maximum": text(high),
        "Multiplexer": F.coalesce("mux_signal", F.lit("")), "Labels": text(F.size("choices")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in items.items()])
    return row.select(F.explode(pairs).alias("p")).select("p.item", "p.value")


def value_table(signals: DataFrame, db_id: str, message: str, signal: str) -> DataFrame:
    row = signals.where((F.col("db_id") == db_id) & (F.col("message") == message) & (F.col("signal") == signal))
    return row.select("scale", "offset", F.explode("choices").alias("raw", "label")).select("raw", (F.col("raw") * F.col("scale") + F.col("offset")).alias("physical"), "label").orderBy("raw")

