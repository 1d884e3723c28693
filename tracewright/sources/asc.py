"""ASC text logs: classic CAN, CAN FD, LIN, error frames, statistics and controller status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import known_channel
from .text import dense_index, head, hex_bytes, hexadecimal, number, read_lines, whole

_DIRECTIONS = ("rx", "tx", "txrq")


def _direction(token: Column) -> Column:
    return F.when(F.lower(token) == "rx", "Rx").when(F.lower(token).isin("tx", "txrq"), "Tx").otherwise("Unknown")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = read_lines(spark, path).select("file", "line_no", F.col("value").alias("line"), F.split(F.trim("value"), "\\s+").alias("t"))
    return lines.withColumn("t_s", number(F.get("t", 0))).where("t_s is not null and size(t) >= 2")


def _base(spark: SparkSession, path: str) -> int:
    for line in head(spark, path):
        if line.lower().startswith("base "):
            return 10 if line.split()[1].lower() == "dec" else 16
    return 16


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """frames in file order. Lines that are none (header, triggers, comments, status) are left out."""
    base = _base(spark, path)
    ident = hexadecimal if base == 16 else whole
    t = F.col("t")
    at = lambda k: F.get(t, k)
    lower = F.transform(t, F.lower)
    dir_at = F.array_min(F.filter(F.array(*[F.nullif(F.array_position(lower, d), F.lit(0)) for d in _DIRECTIONS]), lambda x: x.isNotNull())).cast("int") - 1
    # working columns are named step by step, so that each is computed once per line
    lines = _lines(spark, path).where(~(F.col("line").contains("Statistic:") | F.col("line").contains("Status:")))
    lines = lines.select("file", "line_no", "t_s", "t", dir_at.alias("d"), (F.upper(at(1)) == "CANFD").alias("fd"), F.array_contains(t, "ErrorFrame").alias("err"), at(1).rlike("^(?i)(li|lin|l[0-9]+)$").alias("lin"))
    d, fd, error, lin = F.col("d"), F.col("fd"), F.col("err"), F.col("lin")
    # classic: time channel id dir d|r dlc bytes; FD: time CANFD channel dir id [name] brs esi dlc length bytes
    named = F.when(at(5).rlike("^[01]$") & at(6).rlike("^[01]$"), 0).otherwise(1)
    lines = lines.withColumns({
        "id": F.when(fd, at(4)).when(lin, F.get(t, d - 1)).otherwise(at(2)), "named": named, "remote": F.coalesce(~fd & ~lin & ~error & (F.lower(F.get(t, d + 1)) == "r"), F.lit(False)),
        "_ch": F.when(lin, F.coalesce(whole(F.regexp_replace(at(1), "[^0-9]", "")), F.lit(1))).when(fd, whole(at(2))).otherwise(whole(at(1))),
    })
    named, remote = F.col("named"), F.col("remote")
    lines = lines.withColumns({
        "number": ident(F.regexp_replace("id", "[xX]$", "")), "ext": F.lower("id").endswith("x") & ~lin & ~error,
        "asked": F.when(fd, whole(F.get(t, 8 + named))).when(lin, whole(F.get(t, d + 1))).otherwise(hexadecimal(F.get(t, d + 2))), "start": F.when(fd, 9 + named).when(lin, d + 2).otherwise(d + 3),
    })
    lines = lines.withColumn("size", F.when(error | remote, F.lit(0)).otherwise(F.least("asked", F.lit(64))).cast("int"))
    rows = lines.select(
        "file", "line_no", "t_s", F.when(lin, "LIN").otherwise("CAN").alias("bus"), "_ch", error.alias("is_error"),
        F.when(error, F.lit(0)).when(lin, F.col("number").bitwiseAND(F.lit(0x3F).cast("bigint"))).otherwise(F.col("number")).alias("arb_id"), F.coalesce("ext", F.lit(False)).alias("is_extended"), (fd & ~error).alias("is_fd"),
        remote.alias("is_remote"), F.coalesce(fd & ~error & (F.get(t, 5 + named) == "1"), F.lit(False)).alias("is_brs"),
        F.when(remote, F.coalesce(F.least("asked", F.lit(15)), F.lit(0)).cast("int")).otherwise(F.col("size")).alias("dlc"),
        F.when(d.isNotNull(), _direction(F.get(t, d))).otherwise("Unknown").alias("direction"),
        hex_bytes(F.when(F.col("size") > 0, F.slice(t, F.col("start") + 1, F.greatest("size", F.lit(0)))).otherwise(F.slice(t, 1, 0))).alias("payload"),
    )
    whole_payload = F.col("is_error") | F.col("is_remote") | (F.octet_length("payload") == F.col("dlc"))
    good = rows.where("_ch is not null and arb_id is not null and payload is not null and dlc is not null and dlc >= 0").where(whole_payload).where((F.col("bus") == "CAN") | (F.col("dlc") <= 8))
    return dense_index(good).select("frame_idx", "t_s", "bus", known_channel(F.col("_ch")).alias("channel"), F.col("arb_id").cast("long").alias("arb_id"), "is_extended", "is_fd", "is_error", "is_remote", "is_brs", "dlc", "direction", "payload")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """bus_status of Statistic: and Status: lines."""
    lines = _lines(spark, path)
    channel = F.coalesce(whole(F.get("t", 1)), whole(F.get("t", 2)))
    words = F.split(F.trim(F.regexp_extract("line", "Statistic:\\s*(.*)$", 1)), "\\s+")
    pairs = F.map_from_arrays(
        F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 2).cast("int") - 1), lambda i: words[2 * i]),
        F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 2).cast("int") - 1), lambda i: words[2 * i + 1]),
    )
    statistics = lines.where(F.col("line").contains("Statistic:") & (F.size(words) >= 2)).select("t_s", channel.cast("int").alias("channel"), F.lit("statistics").alias("kind"), pairs.alias("values"))
    tec, rec = F.regexp_extract("line", "(?i)TxErr:\\s*(\\d+)", 1), F.regexp_extract("line", "(?i)RxErr:\\s*(\\d+)", 1)
    state = F.lower(F.regexp_extract("line", "(?i)(bus off|error passive|error active|warning)", 1))
    controller = lines.where(F.col("line").contains("Status:")).select("t_s", channel.cast("int").alias("channel"), F.lit("controller").alias("kind"), F.map_from_arrays(F.array(F.lit("state"), F.lit("tec"), F.lit("rec")), F.array(state, tec, rec)).alias("values"))
    return statistics.unionByName(controller)


def controller_state(tec: Column, rec: Column) -> Column:
    worst = F.greatest(tec, rec)
    return F.when(worst >= 256, "bus off").when(worst >= 128, "error passive").when(worst >= 96, "warning").otherwise("error active")
