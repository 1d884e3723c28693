"""Lines of text files with their place in the file, read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): line_no counts from 0 in file order.

    Splits are read in parallel; a line's number is its place in its split plus the lines of the splits before.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    inner = Window.partitionBy("file", "_block").orderBy("_id")
    counts = raw.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))  # one row per split
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = raw.withColumn("_k", F.row_number().over(inner) - 1).join(F.broadcast(starts), (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return joined.select("file", (F.col("_start") + F.col("_k")).alias("line_no"), F.regexp_replace("value", "^\\ufeff|\\r$", "").alias("value"))


def number(token: Column) -> Column:
    return token.try_cast("double")


def whole(token: Column) -> Column:
    return token.try_cast("bigint")


def hexadecimal(token: Column) -> Column:
    """A number of up to 15 hex digits, NULL if it isn't one."""
    plain = F.regexp_replace(token, "^0[xX]", "")
    return F.when(plain.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(plain, 16, 10).cast("bigint"))


def hex_bytes(tokens: Column) -> Column:
    """Binary of an array of two-digit hex tokens, NULL if any is none."""
    good = F.forall(tokens, lambda x: x.rlike("^[0-9A-Fa-f]{2}$"))
    return F.when(good, F.unhex(F.array_join(tokens, "")))


def dense_index(frame: DataFrame, order: str = "line_no") -> DataFrame:
    """frame with frame_idx counting rows by `order` over all files, without one task sorting everything.

    Rows are counted per range of `order`; a row's index is its rank in its range after the rows before.
    """
    sliced = frame.withColumn("_slice", F.floor(F.col(order) / 100_000))
    counts = sliced.groupBy("file", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file", "_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per 100,000 lines
    starts = counts.select(F.col("file").alias("_f"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = sliced.withColumn("_k", F.row_number().over(Window.partitionBy("file", "_slice").orderBy(order)) - 1)
    joined = ranked.join(F.broadcast(starts), (F.col("file") == F.col("_f")) & (F.col("_slice") == F.col("_s")))
    return joined.withColumn("frame_idx", (F.col("_start") + F.col("_k")).cast("long")).drop("_slice", "_k", "_f", "_s", "_start")


def head(spark: SparkSession, path: str, lines: int = 64) -> list[str]:
    """The first lines, through Spark's reader so that any store works."""
    got = spark.read.text(path).limit(lines).collect()
    return [r["value"].lstrip("﻿").rstrip("\r") for r in got]
