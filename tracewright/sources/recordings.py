"""One door to all formats, and the configuration files beside them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.keys import decode_channel_key, encode_channel_key
from . import asc, blf, csv_files, mdf, trc
from .databases import DatabaseError

FRAME_FORMATS = (".asc", ".trc", ".blf")
MDF_FORMATS = (".mf4", ".mdf")
UNSUPPORTED = {".arxml": "ARXML"}


class UnsupportedFormat(ValueError):
    """A recording that no reader here takes."""


@dataclass(frozen=True)
class Recording:
    """Either frames or samples of a file."""

    kind: str
    frames: DataFrame | None = None
    samples: DataFrame | None = None
    status: DataFrame | None = None
    warnings: DataFrame | None = None


def suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def database_required(spark: SparkSession, path: str) -> bool:
    if suffix(path) in MDF_FORMATS:
        has = mdf.contents(spark, path)
        return has["raw_can"] or has["raw_lin"]
    return suffix(path) in FRAME_FORMATS or (suffix(path) == ".csv" and csv_files.sniff(spark, path)[0] == "raw")


def read_recording(spark: SparkSession, path: str, databases: dict[tuple[str, int], str] | None = None) -> Recording:
    """Frames or samples by suffix and content; raises where a needed database is missing or of the wrong bus."""
    kind = suffix(path)
    if kind in UNSUPPORTED:
        raise UnsupportedFormat(f"{UNSUPPORTED[kind]} files are not supported: export the recording as BLF, ASC, TRC or CSV")
    if kind not in (*FRAME_FORMATS, *MDF_FORMATS, ".csv"):
        raise UnsupportedFormat(f"Unsupported file format: {kind or path}")
    if databases is not None and database_required(spark, path):
        if not databases:
            raise DatabaseError("A message database is needed to decode raw frames")
        if kind in (".trc", ".csv") and any(suffix(p) == ".ldf" for p in databases.values()):
            raise DatabaseError("This format holds CAN frames only; an LDF can't decode them")
    if kind == ".asc":
        return Recording("frames", frames=asc.read_frames(spark, path), status=asc.read_status(spark, path))
    if kind == ".trc":
        return Recording("frames", frames=trc.read_frames(spark, path), status=trc.read_status(spark, path))
    if kind == ".blf":
        return Recording("frames", frames=blf.require_frames(blf.read_frames(spark, path)), warnings=blf.read_warnings(spark, path))
    if kind in MDF_FORMATS:
        frames, samples = mdf.read_frames(spark, path), mdf.read_samples(spark, path)
        has, warnings = mdf.contents(spark, path), mdf.read_warnings(spark, path)
        if has["raw_can"] or has["raw_lin"]:
            return Recording("frames", frames=frames, samples=samples if has["decoded"] else None, warnings=warnings)
        return Recording("samples", samples=samples, warnings=warnings)
    layout = csv_files.sniff(spark, path)[0]
    if layout == "raw":
        return Recording("frames", frames=csv_files.read_raw(spark, path))
    if layout in ("narrow", "wide"):
        return Recording("samples", samples=(csv_files.read_narrow if layout == "narrow" else csv_files.read_wide)(spark, path))
    raise csv_files.CsvError(f"Cannot determine the columns of {os.path.basename(path)}")


def read_channel_config(path: str) -> dict[tuple[str, int], str]:
    """{(bus, channel): database path}; a bare number is a CAN channel, unusable keys are skipped."""
    with open(path, encoding="utf-8") as source:
        body = json.load(source)
    found = body.get("channels", {}) if isinstance(body, dict) else {}
    out = {}
    for key, value in found.items() if isinstance(found, dict) else ():
        place = decode_channel_key(str(key))
        if place and isinstance(value, str) and value:
            out[place] = value
    return out


def save_channel_config(path: str, config: dict[tuple[str, int], str]) -> None:
    body = {"type": "channel-config", "version": 3, "channels": {encode_channel_key(*k): v for k, v in sorted(config.items())}}
    with open(path, "w", encoding="utf-8") as out:
        json.dump(body, out, ensure_ascii=False, indent=2)


def measurement_info(spark: SparkSession, path: str) -> DataFrame:
    """(item, value) facts of a file's header; the events of a TRC file are read_status of its reader."""
    rows = [("File", os.path.basename(path)), ("Format", suffix(path).lstrip(".").upper())]
    if suffix(path) == ".trc":
        info = trc.header(spark, path)
        rows += [("Version", info["version"]), ("Start", info["start"].isoformat(sep=" ") if info["start"] else "")]
    if suffix(path) == ".csv":
        layout, delimiter, headings = csv_files.sniff(spark, path)
        rows += [("Layout", layout), ("Delimiter", delimiter), ("Columns", str(len(headings)))]
    return spark.createDataFrame(rows, "item string, value string")
