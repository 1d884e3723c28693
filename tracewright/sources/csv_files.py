"""CSV recordings: narrow and wide signal tables, and raw CAN frames."""

from __future__ import annotations

import csv
import string
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import known_channel, signal_key
from .text import dense_index, head, hexadecimal, number, read_lines, whole

#: Headings that tell the layouts apart.
NARROW = {"channel", "message_name", "signal_name", "timestamp", "value"}
RAW = {"timestampepoch", "buschannel", "id", "databytes"}
TIME = {"t", "time", "timestamp", "timestamps"}
#: Delimiters, the earlier ones preferred.
DELIMITERS = ";,\t"
_KEPT = set(string.ascii_lowercase + string.digits)


class CsvError(ValueError):
    """A CSV file whose layout isn't known."""


def plain_heading(text: str) -> str:
    """The heading's ASCII letters and digits, in lower case."""
    return "".join(filter(_KEPT.__contains__, text.lower()))


def bracketed(heading: str) -> tuple[str, list[str]]:
    """The heading without its bracketed parts, and what stands in them; either kind of bracket closes either."""
    rest, inside, at = "", [], 0
    while at < len(heading):
        ends = [e for e in (heading.find(c, at) for c in "])") if e >= 0] if heading[at] in "[(" else []
        if ends:
            inside.append(heading[at + 1 : min(ends)])
            at = min(ends) + 1
        else:
            rest, at = rest + heading[at], at + 1
    return rest, inside


def _is_time(heading: str) -> bool:
    name, bracket, unit = heading.strip().partition("[")
    return name.rstrip().lower() in TIME and (not bracket or unit.endswith("]"))


#: Each layout and what its headings have, in the order in which they are tried.
LAYOUTS = {
    "raw": lambda row: RAW.issubset(map(plain_heading, row)),
    "narrow": lambda row: NARROW.issubset(c.strip().lower() for c in row),
    "wide": lambda row: len(row) > 1 and _is_time(row[0]),
    "unknown": lambda row: True,
}


def sniff(spark: SparkSession, path: str) -> tuple[str, str, list[str]]:
    """(a key of LAYOUTS, delimiter, headings) by the first line that isn't blank."""
    lines = [x for x in head(spark, path) if not x.isspace() and x]
    counts = Counter(lines[0] if lines else "")
    delimiter = max(DELIMITERS, key=counts.__getitem__)
    headings = next(csv.reader(lines[:1], delimiter=delimiter), [])
    return next(layout for layout, fits in LAYOUTS.items() if fits(headings)), delimiter, headings


def _rows(spark: SparkSession, path: str, delimiter: str, headings: list[str]) -> DataFrame:
    """(file, line_no, c: array of cells) of the data rows; quoted cells are unquoted."""
    lines = read_lines(spark, path).where(F.trim("value") != "")
    first = lines.groupBy("file").agg(F.min("line_no").alias("_first")).withColumnRenamed("file", "_f")
    body = lines.join(F.broadcast(first), F.col("file") == F.col("_f")).where(F.col("line_no") > F.col("_first"))
    schema = ", ".join(f"`{k}` string" for k in range(len(headings)))
    parsed = F.from_csv("value", schema, {"sep": delimiter, "mode": "PERMISSIVE", "quote": '"', "escape": '"'})
    return body.select("file", "line_no", parsed.alias("_p")).select("file", "line_no", F.array(*[F.col("_p")[str(k)] for k in range(len(headings))]).alias("c"))


def read_narrow(spark: SparkSession, path: str) -> DataFrame:
    """samples: a text value falls back to raw_value and becomes the label; unreadable rows are left out."""
    kind, delimiter, headings = sniff(spark, path)
    if kind != "narrow":
        raise CsvError(f"not a narrow signal table: {path}")
    at = {h.strip().lower(): k for k, h in enumerate(headings)}
    cell = lambda name: F.trim(F.get("c", at[name])) if name in at else F.lit(None).cast("string")
    value = number(cell("value"))
    rows = _rows(spark, path, delimiter, headings).select(
        F.col("line_no").alias("seq"), known_channel(whole(cell("channel"))).alias("channel"), cell("message_name").alias("message"),
        F.coalesce(whole(cell("message_id")), hexadecimal(cell("message_id")), F.lit(0)).alias("message_id"), cell("signal_name").alias("signal"), F.coalesce(cell("unit"), F.lit("")).alias("unit"),
        number(cell("timestamp")).alias("t_s"), F.coalesce(value, number(cell("raw_value"))).alias("value"), F.when(value.isNull() & (cell("value") != ""), cell("value")).alias("label"),
    )
    return _finished(rows.where("t_s is not null and value is not null and signal <> ''"))


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """samples: the first column is the time, the unit stands in brackets in the heading, empty cells are no samples."""
    kind, delimiter, headings = sniff(spark, path)
    if kind != "wide":
        raise CsvError(f"not a wide signal table: {path}")
    parts = [bracketed(h) for h in headings]
    names = [name.strip() or h.strip() for h, (name, _) in zip(headings, parts, strict=True)]
    units = [inside[0].strip() if inside else "" for _, inside in parts]
    rows = _rows(spark, path, delimiter, headings).withColumn("t_s", number(F.trim(F.get("c", 0)))).where("t_s is not null")
    cells = F.array(*[F.struct(F.lit(names[k]).alias("signal"), F.lit(units[k]).alias("unit"), F.trim(F.get("c", k)).alias("cell")) for k in range(1, len(headings))])
    long = rows.select("line_no", "t_s", F.explode(cells).alias("s")).where(F.coalesce("s.cell", F.lit("")) != "")
    value = number(F.col("s.cell"))
    return _finished(long.select(
        F.col("line_no").alias("seq"), F.lit(None).cast("int").alias("channel"), F.lit("CSV").alias("message"), F.lit(0).cast("long").alias("message_id"), F.col("s.signal").alias("signal"), F.col("s.unit").alias("unit"),
        "t_s", F.coalesce(value, F.lit(float("nan"))).alias("value"), F.when(value.isNull(), F.col("s.cell")).alias("label"),
    ))


def _finished(rows: DataFrame) -> DataFrame:
    key = signal_key(F.lit("CAN"), F.col("channel"), F.col("message"), F.col("signal"))
    return rows.select(key.alias("signal_key"), F.lit("CAN").alias("bus"), "channel", "message", "message_id", "signal", "unit", "seq", "t_s", "value", "label")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """frames: unreadable rows are left out; absent columns follow from identifier and length."""
    kind, delimiter, headings = sniff(spark, path)
    if kind != "raw":
        raise CsvError(f"not a raw CAN table: {path}")
    at = {plain_heading(h): k for k, h in enumerate(headings)}
    cell = lambda name: F.trim(F.get("c", at[name])) if name in at else F.lit(None).cast("string")
    data = F.regexp_replace(F.regexp_replace(F.coalesce(cell("databytes"), F.lit("")), " ", ""), "^0[xX]", "")
    rows = _rows(spark, path, delimiter, headings).select(
        "file", "line_no", number(cell("timestampepoch")).alias("t_s"), whole(cell("buschannel")).alias("_ch"), hexadecimal(cell("id")).alias("arb_id"),
        F.when(data.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(data)).alias("_all"), whole(cell("datalength")).alias("_len"),
        *[whole(cell(n)).alias(f"_{n}") for n in ("ide", "edl", "brs", "rtr")], F.lower(cell("dir")).alias("_dir"),
    ).where("t_s is not null and _ch is not null and arb_id is not null and _all is not null")
    size = F.least(F.greatest(F.coalesce("_len", F.octet_length("_all")), F.lit(0)), F.octet_length("_all"), F.lit(64)).cast("int")
    direction = F.when(F.col("_dir").isin("0", "rx"), "Rx").when(F.col("_dir").isin("1", "tx"), "Tx").otherwise("Unknown")
    return dense_index(rows).select(
        "frame_idx", "t_s", F.lit("CAN").alias("bus"), known_channel(F.col("_ch")).alias("channel"), "arb_id", F.coalesce(F.col("_ide") != 0, F.col("arb_id") > 0x7FF).alias("is_extended"),
        F.coalesce(F.col("_edl") != 0, size > 8).alias("is_fd"), F.lit(False).alias("is_error"), F.coalesce(F.col("_rtr") != 0, F.lit(False)).alias("is_remote"),
        F.coalesce(F.col("_brs") != 0, F.lit(False)).alias("is_brs"), size.alias("dlc"), direction.alias("direction"), F.expr("substring(_all, 1, cast(least(greatest(coalesce(_len, octet_length(_all)), 0), octet_length(_all), 64) as int))").alias("payload"),
    )
