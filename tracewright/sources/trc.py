"""TRC text logs, versions 1.0 to 3.0."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import known_channel
from .asc import controller_state
from .text import dense_index, head, hex_bytes, hexadecimal, number, read_lines, whole

#: The format's versions, its day zero, and its FD length table.
VERSIONS = ("1.0", "1.1", "1.2", "1.3", "2.0", "2.1", "3.0")
DAY_ZERO = datetime.datetime(1899, 12, 30)
FD_LENGTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)
PROBE = 20


class TrcError(ValueError):
    """A file that is no readable TRC log."""


def header(spark: SparkSession, path: str) -> dict:
    """version, start (datetime or None), columns."""
    lines = head(spark, path, 200)
    words = {m[1].upper(): m[2].strip() for x in lines if (m := re.match(r"^;\$(\w+)=(.*)$", x.strip()))}
    version = words.get("FILEVERSION", "1.0")
    if version not in VERSIONS:
        raise TrcError(f"unsupported TRC version: {version}")
    columns = tuple(c.strip() for c in words.get("COLUMNS", "N,O,T,I,d,l,D" if version == "2.0" else "N,O,T,B,I,d,R,L,D").split(","))
    try:
        start = DAY_ZERO + datetime.timedelta(days=float(words["STARTTIME"])) if "STARTTIME" in words else None
    except ValueError:
        start = None
    data = [x for x in lines if x.strip() and not x.lstrip().startswith(";")][:PROBE]
    looks = r"^\s*\d+\)\s+-?[\d.]+\s" if version < "2" else r"^\s*(\d+\s+)?-?[\d.]+\s+[A-Z]{2}\b"
    if data and not any(re.match(looks, x) for x in data):
        raise TrcError("none of the first lines is a trace line")
    return {"version": version, "start": start, "columns": columns}


def _direction(token: Column) -> Column:
    return F.when(token == "Rx", "Rx").when(token == "Tx", "Tx").otherwise("Unknown")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """One row per data line: kind, time, channel and the fields of frames."""
    info = header(spark, path)
    lines = read_lines(spark, path).where(~F.ltrim("value").startswith(";") & (F.trim("value") != ""))
    lines = lines.select("file", "line_no", F.col("value").alias("line"), F.split(F.trim("value"), "\\s+").alias("t"))
    t = F.col("t")
    at = lambda k: F.get(t, k)
    if info["version"] < "2":
        v = info["version"]
        has_type, has_bus, spare = v >= "1.1", v >= "1.2", v >= "1.3"
        i = 2 + has_bus + has_type
        n = i + 1 + spare
        rest = F.slice(t, n + 2, 4096)
        kind = at(i - 1) if has_type else F.lit("")
        event = F.when((kind == "Warng") | (F.lit(not has_type) & (at(i) == "FFFFFFFF")), "ST").when((kind == "Error") | (F.lit(not has_type) & (F.get(rest, 0) == "ERROR")), "ER").when(F.get(rest, 0) == "RTR", "RR")
        event = event.when(kind.isin("Rx", "Tx") | F.lit(not has_type), "DT").otherwise("??")
        return lines.where(at(0).endswith(")")).select(
            "file", "line_no", "line", (number(at(1)) / 1000).alias("t_s"), event.alias("kind"), (whole(at(2)) if has_bus else F.lit(1)).alias("_ch"), at(i).alias("_id"),
            whole(at(n)).alias("_len"), (_direction(kind) if has_type else F.lit("Unknown")).alias("direction"), F.when(F.get(rest, 0) == "ERROR", F.slice(rest, 2, 4096)).otherwise(rest).alias("_rest"), F.lit(True).alias("_v1"),
        )
    where = {c: k for k, c in enumerate(info["columns"])}
    kind, data_at = at(where["T"]), where["D"]
    fd = kind.isin("FD", "FB", "FE", "BI")
    if "l" in where:
        length = whole(at(where["l"]))
    else:
        code = whole(at(where["L"]))
        length = F.when(fd, F.get(F.array(*map(F.lit, FD_LENGTHS)), F.least(code, F.lit(15)).cast("int")).cast("bigint")).otherwise(code)
    channel = F.when(at(where["B"]).rlike("^[0-9]+$"), whole(at(where["B"]))) if "B" in where else F.lit(1)
    return lines.select(
        "file", "line_no", "line", (number(at(where["O"])) / 1000).alias("t_s"), kind.alias("kind"), channel.cast("bigint").alias("_ch"), at(where["I"]).alias("_id"), length.alias("_len"),
        _direction(at(where["d"])).alias("direction"), F.slice(t, data_at + 1, 4096).alias("_rest"), F.lit(False).alias("_v1"),
    )


_FRAMES = ("DT", "FD", "FB", "FE", "BI", "RR", "ER")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """frames in file order; times are seconds since the first frame."""
    rows = _parsed(spark, path).where(F.col("kind").isin(*_FRAMES) & F.col("t_s").isNotNull())
    error, remote = F.col("kind") == "ER", F.col("kind") == "RR"
    error_data = F.when(F.col("_v1"), F.col("_rest")).otherwise(F.slice("_rest", F.greatest(F.size("_rest") - 4, F.lit(1)), 5))
    rows = rows.withColumns({
        "size": F.when(error, 0).when(remote, F.least("_len", F.lit(15))).otherwise(F.col("_len")).cast("int"), "arb_id": F.when(error, F.lit(0).cast("bigint")).otherwise(hexadecimal(F.col("_id"))),
        "sent": F.when(error, F.when(F.col("_v1"), F.get(error_data, 0)).otherwise(F.get(error_data, 1))),
    })
    bytes_ = F.when(error | remote | (F.col("size") == 0), F.slice("_rest", 1, 0)).otherwise(F.slice("_rest", 1, F.greatest("size", F.lit(0))))
    out = rows.select(
        "file", "line_no", "t_s", F.coalesce("_ch", F.lit(1)).alias("_ch"), "arb_id", (~error & ((F.length("_id") == 8) | (F.col("arb_id") > 0x7FF))).alias("is_extended"), F.col("kind").isin("FD", "FB", "FE", "BI").alias("is_fd"), error.alias("is_error"),
        remote.alias("is_remote"), F.col("kind").isin("FB", "BI").alias("is_brs"), F.col("size").alias("dlc"), F.when(error & (F.col("direction") == "Unknown"), F.when(F.col("sent") == "00", "Tx").otherwise("Rx")).otherwise(F.col("direction")).alias("direction"), hex_bytes(bytes_).alias("payload"),
    )
    out = out.where("arb_id is not null and payload is not null and dlc between 0 and 64").where(F.col("is_error") | F.col("is_remote") | (F.octet_length("payload") == F.col("dlc")))
    out = dense_index(out)
    first = out.agg(F.min_by("t_s", "frame_idx").alias("_t0"))
    return out.join(F.broadcast(first)).select(
        "frame_idx", (F.col("t_s") - F.col("_t0")).alias("t_s"), F.lit("CAN").alias("bus"), known_channel(F.col("_ch")).alias("channel"), "arb_id", "is_extended", "is_fd", "is_error", "is_remote", "is_brs", "dlc", "direction", "payload",
    )


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """bus_status: controller states, error counters and overloads; times as in the file."""
    rows = _parsed(spark, path).where(F.col("kind").isin("ST", "EC", "OF"))
    code = hexadecimal(F.array_join(F.filter("_rest", lambda x: x.rlike("^[0-9A-Fa-f]{2}$")), ""))
    bit = lambda mask: code.bitwiseAND(F.lit(mask)) != 0
    state = F.when(bit(0x10), "bus off").when(bit(0x40000), "error passive").when(bit(0x8), "warning").otherwise("error active")
    rec, tec = F.conv(F.element_at("_rest", -2), 16, 10).cast("int"), F.conv(F.element_at("_rest", -1), 16, 10).cast("int")
    counters = F.create_map(F.lit("tec"), tec.cast("string"), F.lit("rec"), rec.cast("string"), F.lit("state"), controller_state(tec, rec))
    values = F.when(F.col("kind") == "ST", F.create_map(F.lit("state"), state)).when(F.col("kind") == "EC", counters).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("t_s", F.col("_ch").cast("int").alias("channel"), F.when(F.col("kind") == "OF", "overload").otherwise("controller").alias("kind"), values.alias("values"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(t_s, channel, text) of the user's events; other lines aren't parsed."""
    rows = read_lines(spark, path).where(F.col("value").contains(" EV "))
    m = lambda k: F.regexp_extract("value", r"^\s*(?:\d+\s+)?(-?[\d.]+)\s+EV\s+(?:(\d+|-)\s+)?(.*)$", k)
    return rows.select((number(m(1)) / 1000).alias("t_s"), whole(m(2)).cast("int").alias("channel"), F.trim(m(3)).alias("text")).where("t_s is not null")


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """(reason, n) of lines that are no rows of the other tables."""
    kinds = _parsed(spark, path)
    reason = F.when(F.col("kind") == "XL", "CAN XL frames").when(F.col("kind").isin("PE", "EN"), "CAN XL errors").when(F.col("kind").isin(*_FRAMES) & (F.col("_len") > 64), "longer than 64 bytes")
    reason = reason.when(~F.col("kind").isin(*_FRAMES, "ST", "EC", "OF", "EV") | F.col("t_s").isNull(), "unreadable")
    return kinds.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
