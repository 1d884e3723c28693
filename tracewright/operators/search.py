"""Name search and selection lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pattern(text: str, whole: bool) -> str:
    body = "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\^$.|()\[\]{}+])", r"\\\1", c) for c in text)
    return f"(?is)^{body}$" if whole else f"(?is){body}"


def search_names(signals: DataFrame, needle: str, column: str = "signal") -> DataFrame:
    """Rows whose name holds the needle anywhere: * is any run, ? one character, case is ignored."""
    return signals.where(F.col(column).rlike(_pattern(needle, False))) if needle else signals


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(entry) of a list file: # starts a comment, blank lines don't count."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\\ufeff", "")).alias("entry"))
    return lines.where((F.col("entry") != "") & ~F.col("entry").startswith("#"))


def save_selection(path: str, names: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.write("".join(f"{n}\n" for n in names))


def select_names(signals: DataFrame, entries: list[str], column: str = "signal") -> tuple[DataFrame, DataFrame]:
    """(picked rows, entries without a hit): whole names in either case, wildcards with * or ?."""
    spark = signals.sparkSession
    asked = spark.createDataFrame([(e, _pattern(e, True)) for e in entries], "entry string, pattern string")
    names = signals.select(F.col(column).alias("_name")).distinct()
    hits = names.join(F.broadcast(asked), F.expr("_name rlike pattern"))
    picked = signals.join(hits.select("_name").distinct(), F.col(column) == F.col("_name"), "left_semi")
    return picked, asked.join(hits.select(F.col("entry").alias("_e")).distinct(), F.col("entry") == F.col("_e"), "left_anti").select("entry")
