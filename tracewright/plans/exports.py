"""Wide exports, the table view and conversion jobs."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align
from ..sources.trc import FD_LENGTHS

#: Rows that a worksheet holds, and that a displayed table view holds at most.
EXCEL_ROWS, TABLE_ROWS = 1_048_575, 5_000_000
TIME_NAMES = ("time", "t", "timestamps")


@dataclass(frozen=True)
class Timebase:
    """The grid of an export: a reference signal's times or a recurrence in seconds, just one of them."""

    reference: str | None = None
    recurrence_s: float | None = None

    def grid(self, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
        if (self.reference is None) == (self.recurrence_s is None):
            raise ValueError("Choose either a reference signal or a recurrence")
        if self.reference is not None:
            return align.reference_grid(samples, self.reference)
        bounds = align.time_bounds(samples.where(F.col("signal_key").isin(list(keys))))
        if bounds is None:
            raise ValueError("The signals have no samples")
        return align.regular_grid(samples.sparkSession, *bounds, self.recurrence_s)

    def rows(self, samples: DataFrame, keys: Sequence[str]) -> int:
        """The grid's length, without building it for a recurrence."""
        if self.recurrence_s is not None and self.reference is None:
            bounds = align.time_bounds(samples.where(F.col("signal_key").isin(list(keys))))
            return 0 if bounds is None else align.grid_steps(*bounds, self.recurrence_s) + 1
        return self.grid(samples, keys).count()


def general_format(value: Column, digits: int = 6) -> Column:
    """C's %.6g: so many significant digits, without trailing zeros; an exponent below 1e-4 and from 1e6 on."""
    text = F.format_string(f"%.{digits - 1}e", value)
    power = F.regexp_extract(text, "e([+-]\\d+)$", 1).cast("int")
    bare = lambda t: F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), "\\.$", "")).otherwise(t)
    out = F.concat(bare(F.regexp_extract(text, "^([^e]*)e", 1)), F.regexp_extract(text, "(e[+-]\\d+)$", 1))
    for k in range(-4, digits):
        out = F.when(power == k, bare(F.format_string(f"%.{digits - 1 - k}f", value))).otherwise(out)
    return F.when(value == 0, F.lit("0")).otherwise(out)


@dataclass(frozen=True)
class UnionTimes:
    """The grid of all the signals' times."""

    def grid(self, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
        return align.union_grid(samples, keys)


def _headings(keys: Sequence[str]) -> list[str]:
    """The signal's name, or the whole key where two signals share a name."""
    names = [k.rpartition("::")[2] for k in keys]
    return [k if names.count(n) > 1 else n for k, n in zip(keys, names, strict=True)]


def wide_table(samples: DataFrame, keys: Sequence[str], timebase: Timebase | UnionTimes) -> DataFrame:
    """Time and a text column per signal: the label, else the number; NULL before the first sample."""
    label = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")) if "label" in samples.columns else F.lit(None)
    shown = F.coalesce(label, F.when(~F.isnan("value"), F.col("value").cast("string")))
    table = align.on_grid(samples, keys, timebase.grid(samples, keys), shown)
    return table.select(F.col("t_s").alias("Time"), *[F.col(f"`{k}`").alias(h) for k, h in zip(keys, _headings(keys), strict=True)])


def export_csv(samples: DataFrame, keys: Sequence[str], timebase: Timebase, path: str, single: bool = False) -> None:
    """CSV parts in time order with a heading; `single` makes one file, for small exports only."""
    table = wide_table(samples, keys, timebase).orderBy("Time")
    (table.coalesce(1) if single else table).write.option("emptyValue", "").option("nullValue", "").csv(path, header=True)


def export_parquet(samples: DataFrame, path: str) -> None:
    """One dataset partition per message, labels and markers included as columns."""
    samples.write.partitionBy("message").parquet(path)


def table_view(samples: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """Rows of the union of times, formatted; with `most` (for display, say TABLE_ROWS), the first `most` of them."""
    chosen = samples.where(F.col("signal_key").isin(list(keys)))
    label = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")) if "label" in samples.columns else F.lit(None)
    shown = F.coalesce(label, F.when(~F.isnan("value"), general_format(F.col("value"))))
    table = align.on_grid(chosen, keys, align.union_grid(chosen), shown).orderBy("t_s")
    table = table if most is None else table.limit(most)
    return table.select(F.format_string("%.6f", "t_s").alias("Time"), *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k) for k in keys])


@dataclass(frozen=True)
class ConvertJob:
    """Join, cut, keep and resample recordings of one family, then write."""

    inputs: tuple[str, ...]
    output: str
    start: float | None = None
    end: float | None = None
    keep: tuple[str, ...] | None = None
    raster: float | None = None

    #: Families of suffixes and what each can be written as.
    RAW = (".asc", ".blf", ".trc")
    RAW_OUT = (".asc", ".trc", ".csv", ".parquet")
    DECODED_OUT = (".csv", ".parquet", ".mf4")

    def validate(self) -> None:
        suffix = lambda p: os.path.splitext(p)[1].lower()
        if not self.inputs:
            raise ValueError("Choose at least one input")
        raw = [suffix(p) in self.RAW for p in self.inputs]
        if any(raw) and (not all(raw) or len({suffix(p) for p in self.inputs}) > 1):
            raise ValueError("All inputs must be of one format")
        if suffix(self.output) not in (self.RAW_OUT if any(raw) else (*self.DECODED_OUT, *self.RAW_OUT)):
            raise ValueError(f"Unsupported output format: {suffix(self.output)}")
        if os.path.abspath(self.output) in map(os.path.abspath, self.inputs):
            raise ValueError("The output would overwrite an input")
        if self.start is not None and self.end is not None and not self.end > self.start:
            raise ValueError("The end must be after the start")
        if self.raster is not None and not (math.isfinite(self.raster) and self.raster > 0):
            raise ValueError("The raster must be positive")
        if any(raw) and (self.keep or self.raster):
            raise ValueError("Signals can't be kept or resampled in raw recordings")


def run_job(spark: SparkSession, job: ConvertJob) -> None:
    """Read a job's inputs, convert and write them; a job that can't be done, or fails, leaves no output."""
    from ..sources.recordings import read_recording

    job.validate()
    parts = [read_recording(spark, p) for p in job.inputs]
    if len({p.kind for p in parts}) > 1:
        raise ValueError("All inputs must be raw, or all decoded")
    kind = os.path.splitext(job.output)[1].lower()
    if parts[0].kind == "frames":
        if job.keep or job.raster:
            raise ValueError("Signals can't be kept or resampled in raw recordings")
        convert_frames([p.frames for p in parts], job.output, job.start, job.end)
        return
    samples = convert_samples([p.samples for p in parts], job.keep, job.start, job.end, job.raster)
    if kind == ".parquet":
        write_safely(samples, job.output)
    elif kind == ".csv":
        keys = [r["signal_key"] for r in samples.select("signal_key").distinct().orderBy("signal_key").collect()]  # a recording's signals
        write_safely(wide_table(samples, keys, UnionTimes()).orderBy("Time"), job.output, "csv", header=True, emptyValue="", nullValue="")
    elif kind == ".mf4":
        write_beside(lambda path: mdf_samples(samples, path), job.output)
    else:
        raise ValueError(f"Unsupported output format: {kind}")


def mdf_samples(samples: DataFrame, path: str) -> None:
    from ..sources.mdf import write_samples

    named = samples if "message" in samples.columns else samples.select("*", F.split("signal_key", "::")[1].alias("message"), F.element_at(F.split("signal_key", "::"), -1).alias("signal"), F.lit("").alias("unit"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("label"))
    write_samples(named, path)


def write_beside(write, path: str) -> None:
    """write(a path beside the target), then rename; for sinks that are one local file."""
    beside = f"{path}.part-{uuid.uuid4().hex[:8]}"
    try:
        write(beside)
        os.replace(beside, path)
    except BaseException:
        if os.path.exists(beside):
            os.remove(beside)
        raise


def join_frames(parts: Sequence[DataFrame]) -> DataFrame:
    """Recordings one after the other: frame_idx is order by (file, frame), times as recorded."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("file_ord", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def cut_frames(joined: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """start <= t - (the first frame's t) <= end, the offset made the time."""
    first = joined.agg(F.min_by("t_s", F.struct("file_ord", "frame_idx")).alias("_t0"))
    out = joined.join(F.broadcast(first)).withColumn("t_s", F.col("t_s") - F.col("_t0")).drop("_t0")
    if start is not None:
        out = out.where(F.col("t_s") >= F.lit(float(start)))
    return out if end is None else out.where(F.col("t_s") <= F.lit(float(end)))


def list_signals(signals: DataFrame) -> DataFrame:
    """Signals that can be kept: time channels are none."""
    return signals.where(~F.lower("signal").isin(*TIME_NAMES)).select("signal_key", "message", "signal", "unit").distinct()


def convert_samples(parts: Sequence[DataFrame], keep: Sequence[str] | None = None, start: float | None = None, end: float | None = None, raster: float | None = None) -> DataFrame:
    """Concatenate, keep, cut, resample: in this order."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    if keep is not None:
        out = out.where(F.col("signal_key").isin(list(keep)))
    if start is not None:
        out = out.where(F.col("t_s") >= F.lit(float(start)))
    if end is not None:
        out = out.where(F.col("t_s") <= F.lit(float(end)))
    if raster is None:
        return out
    keys = [r["signal_key"] for r in out.select("signal_key").distinct().orderBy("signal_key").collect()]  # a recording's signals
    if not keys:
        return out
    table = align.on_grid(out, keys, Timebase(recurrence_s=raster).grid(out, keys))
    pairs = F.array(*[F.struct(F.lit(k).alias("signal_key"), F.col(f"`{k}`").alias("value")) for k in keys])
    return table.select("t_s", F.explode(pairs).alias("p")).select("p.signal_key", "t_s", "p.value").where("value is not null")


def renumber_for_mf4(frames: DataFrame) -> DataFrame:
    """0-based channels made 1-based."""
    return frames.withColumn("channel", F.col("channel") + 1)


def write_safely(frame: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Write beside the target and rename, so that a failure leaves nothing half done."""
    spark: SparkSession = frame.sparkSession
    beside = f"{path.rstrip('/')}.part-{uuid.uuid4().hex[:8]}"
    files = spark._jvm.org.apache.hadoop.fs.Path
    fs = files(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        frame.write.options(**options).format(kind).save(beside)
        fs.delete(files(path), True)
        if not fs.rename(files(beside), files(path)):
            raise OSError(f"could not move the result to {path}")
    except BaseException:
        fs.delete(files(beside), True)
        raise


def write_raw_csv(frames: DataFrame, path: str) -> None:
    """Frames as the raw CAN table that read_raw() takes."""
    number = lambda c: F.col(c).cast("int").cast("string")
    table = frames.orderBy("frame_idx").select(
        F.col("t_s").alias("TimestampEpoch"), F.col("channel").alias("BusChannel"), F.hex("arb_id").alias("ID"), number("is_extended").alias("IDE"), F.col("dlc").alias("DLC"), F.octet_length("payload").alias("DataLength"),
        F.col("direction").alias("Dir"), number("is_fd").alias("EDL"), number("is_brs").alias("BRS"), F.lit("0").alias("ESI"), number("is_remote").alias("RTR"), F.hex("payload").alias("DataBytes"),
    )
    write_safely(table, path, "csv", sep=";", header=True)


def asc_lines(frames: DataFrame) -> DataFrame:
    """(frame_idx, value): a text log line per frame, without the header."""
    data = F.rtrim(F.regexp_replace(F.hex("payload"), "(..)", "$1 "))
    ident = F.concat(F.hex("arb_id"), F.when(F.col("is_extended"), "x").otherwise(""))
    head = F.format_string("%11.6f", "t_s")
    way = F.when(F.col("direction") == "Tx", "Tx").otherwise("Rx")
    channel = F.coalesce(F.col("channel").cast("string"), F.lit("1"))
    flag = lambda c: F.when(F.col(c), "1").otherwise("0")
    line = (
        F.when(F.col("is_error"), F.concat_ws(" ", head, channel, F.lit("ErrorFrame")))
        .when(F.col("bus") == "LIN", F.concat_ws(" ", head, F.concat(F.lit("L"), channel), F.hex("arb_id"), way, F.col("dlc").cast("string"), data))
        .when(F.col("is_remote"), F.concat_ws(" ", head, channel, ident, way, F.lit("r"), F.lower(F.hex("dlc"))))
        .when(F.col("is_fd"), F.concat_ws(" ", head, F.lit("CANFD"), channel, way, ident, flag("is_brs"), F.lit("0"), F.lower(F.hex("dlc")), F.octet_length("payload").cast("string"), data))
        .otherwise(F.concat_ws(" ", head, channel, ident, way, F.lit("d"), F.lower(F.hex("dlc")), data))
    )
    return frames.select("frame_idx", line.alias("value"))


def write_asc(frames: DataFrame, path: str) -> None:
    """One text log in frame order. Formats that are one file are written by one task, which streams the sorted rows."""
    spark = frames.sparkSession
    header = ["date Mon Jan 1 00:00:00 2024", "base hex  timestamps absolute", "internal events logged"]
    lines = spark.createDataFrame([(k - len(header), h) for k, h in enumerate(header)], "frame_idx long, value string").unionByName(asc_lines(frames))
    write_safely(lines.orderBy("frame_idx").coalesce(1).select("value"), path, "text")


def write_trc(frames: DataFrame, path: str) -> None:
    """One trace text of version 2.1 in frame order, times in milliseconds; written by one task, which streams the sorted rows."""
    header = [";$FILEVERSION=2.1", ";$STARTTIME=45292.0", ";$COLUMNS=N,O,T,B,I,d,R,L,D"]
    way = F.when(F.col("direction") == "Tx", "Tx").otherwise("Rx")
    size = F.octet_length("payload")
    code = F.coalesce(*[F.when(size <= n, F.lit(k)) for k, n in enumerate(FD_LENGTHS)])
    kind = F.when(F.col("is_error"), "ER").when(F.col("is_remote"), "RR").when(F.col("is_fd") & F.col("is_brs"), "FB").when(F.col("is_fd"), "FD").otherwise("DT")
    ident = F.when(F.col("is_extended"), F.lpad(F.hex("arb_id"), 8, "0")).otherwise(F.lpad(F.hex("arb_id"), 4, "0"))
    data = F.rtrim(F.regexp_replace(F.hex("payload"), "(..)", "$1 "))
    line = F.concat_ws(" ", (F.col("frame_idx") + 1).cast("string"), F.format_string("%.6f", F.col("t_s") * 1000), kind, F.coalesce(F.col("channel").cast("string"), F.lit("1")), ident, way, F.lit("-"), F.when(F.col("is_fd"), code).otherwise(F.col("dlc")).cast("string"), data)
    lines = frames.sparkSession.createDataFrame([(k - len(header), h) for k, h in enumerate(header)], "frame_idx long, value string").unionByName(frames.select("frame_idx", line.alias("value")))
    write_safely(lines.orderBy("frame_idx").coalesce(1).select("value"), path, "text")


def export_excel(table: DataFrame, path: str, most: int = EXCEL_ROWS) -> int:
    """A worksheet with a frozen heading and the first `most` rows of `table`, streamed through the driver; rows written."""
    import zipfile
    from xml.sax.saxutils import escape

    def cell(x) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x):
            return f"<c><v>{x!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    row = lambda cells: f"<row>{''.join(map(cell, cells))}</row>"
    space, office = "http://schemas.openxmlformats.org", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("[Content_Types].xml", f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{office}.worksheet+xml"/></Types>')
        out.writestr("_rels/.rels", f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name="Export" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with out.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{row(table.columns)}'.encode())
            for record in table.limit(most).toLocalIterator():
                sheet.write(row(record).encode())
                n += 1
            sheet.write(b"</sheetData></worksheet>")
    return n


def convert_frames(parts: Sequence[DataFrame], output: str, start: float | None = None, end: float | None = None) -> None:
    """Join and cut recordings, then write them as a text log, a trace, a raw table or Parquet by the output's suffix."""
    joined = cut_frames(join_frames(parts), start, end)
    ordered = joined.withColumn("frame_idx", F.col("file_ord").cast("long") * F.lit(1 << 40) + F.col("frame_idx")).drop("file_ord")
    kind = os.path.splitext(output)[1].lower()
    if kind == ".asc":
        write_asc(ordered, output)
    elif kind == ".trc":
        write_trc(ordered, output)
    elif kind == ".csv":
        write_raw_csv(ordered, output)
    elif kind == ".parquet":
        write_safely(ordered, output)
    else:
        raise ValueError(f"Unsupported output format: {kind}")
