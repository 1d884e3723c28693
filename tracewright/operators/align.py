"""Zero-order-hold alignment, grids and nearest-sample lookups.

The hold is one sort in time, in two passes: inside time buckets by a window, and across buckets by a table of
one row per bucket. Buckets hold about equal numbers of rows, and there are more of them for more rows. No task ever sorts a whole recording, and nothing is compared pairwise.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .keys import TIME

#: Buckets at least, rows in a bucket at most (but for one cell's), and the cells of which buckets are made.
BUCKETS, BUCKET_ROWS, CELLS = 256, 1_000_000, 16_384


@dataclass(frozen=True)
class Slices:
    """Time buckets of about equal row counts: equal cells from `low` on, and the bucket of each."""

    low: float
    width: float
    bucket_of: tuple[int, ...]

    def column(self, time: str) -> Column:
        """The bucket of a row; rows beyond the range fall into the outer ones."""
        if len(self.bucket_of) == 1:
            return F.lit(0)
        cell = F.floor((F.col(time) - F.lit(self.low)) / F.lit(self.width))
        cell = F.greatest(F.least(cell, F.lit(len(self.bucket_of) - 1)), F.lit(0)).cast("int")
        return F.get(F.from_json(F.lit(json.dumps(self.bucket_of)), "array<int>"), cell)


def slices(frame: DataFrame, time: str = "t_s", buckets: int = BUCKETS, rows: int = BUCKET_ROWS) -> Slices:
    """Slices by the rows of frame: their time range first, then a count of each cell (CELLS rows at most are gathered)."""
    fine = frame.where(~F.isnan(time)).select(F.col(time).alias("_t"))
    low, high, n = fine.agg(F.min("_t"), F.max("_t"), F.count(F.lit(1))).first()
    if low is None or not high > low:
        return Slices(0.0, 1.0, (0,))
    cells = CELLS if n > buckets * 64 else buckets
    cut = Slices(float(low), (high - low) / cells, tuple(range(cells)))
    if cells == buckets:
        return cut
    cell = F.greatest(F.least(F.floor((F.col("_t") - F.lit(cut.low)) / F.lit(cut.width)), F.lit(cells - 1)), F.lit(0)).cast("int")
    counts = {r["cell"]: r["n"] for r in fine.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    most, bucket, held, out = min(rows, -(-n // buckets)), 0, 0, []
    for k in range(cells):
        if held and held + counts.get(k, 0) > most:
            bucket, held = bucket + 1, 0
        held += counts.get(k, 0)
        out.append(bucket)
    return Slices(cut.low, cut.width, tuple(out))


def hold(frame: DataFrame, columns: Sequence[str], time: str = "t_s", then: Sequence[str] = (), by: Sequence[str] = (), buckets: int = BUCKETS, cut: Slices | None = None) -> DataFrame:
    """frame with each of `columns` replaced by its last non-NULL value at or before the row.

    `cut` are the buckets, say by the rows that an expensive frame is made of; any buckets give the same result.
    Rows are ordered by time, then `then`; `by` names keys (say, of recordings) that are held apart. NaN is a value
    and is held; rows before the first value stay NULL.
    """
    order = [time, *then]
    sliced = frame.withColumn("_bucket", (cut or slices(frame, time, buckets)).column(time))
    up_to = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = sliced.groupBy(*by, "_bucket").agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_l{k}") for k, c in enumerate(columns)])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carried = last.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_bucket").alias("_b"), *[F.last(f"_l{k}", True).over(before).alias(f"_c{k}") for k in range(len(columns))])
    on = F.col("_bucket") == F.col("_b")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    carried = carried if by else F.broadcast(carried)  # without keys a row for each bucket, CELLS at most
    joined = sliced.join(carried, on, "left")
    kept = [c for c in frame.columns if c not in columns]
    return joined.select(*kept, *[F.coalesce(F.last(F.col(c), True).over(up_to), F.col(f"_c{k}.v")).alias(c) for k, c in enumerate(columns)])


def as_of(queries: DataFrame, source: DataFrame, value: str = "value", at: str = "q", time: str = "t_s", seq: str = "seq", by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """queries with `value`: source's last one at or before `at` (NULL if there is none). At equal times the last in seq counts."""
    names = [c for c in queries.columns if c not in by]
    row = F.struct(*[F.col(c) for c in names])
    left = queries.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_seq"), row.alias("_row"), F.lit(None).cast(source.schema[value].dataType).alias("_value"))
    right = source.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(seq).cast("long").alias("_seq"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    held = hold(left.unionByName(right), ["_value"], "_t", ["_side", "_seq"], by, buckets).where("_side = 1")
    return held.select(*by, *[F.col("_row")[c].alias(c) for c in names], F.col("_value").alias(value))


def with_time_signal(samples: DataFrame, references: Sequence[str]) -> DataFrame:
    """samples of the references, with the time signal (value = time) on the others' times if it is referenced."""
    if TIME not in references:
        return samples.where(F.col("signal_key").isin(list(references)))
    others = [r for r in references if r != TIME]
    own = samples.where(F.col("signal_key").isin(others)) if others else samples
    time = own.select("t_s").distinct().select(F.lit(TIME).alias("signal_key"), F.lit(0).cast("long").alias("seq"), "t_s", F.col("t_s").alias("value"))
    base = own.select("signal_key", F.col("seq").cast("long"), "t_s", "value")
    return base.unionByName(time) if others else time


def wide(samples: DataFrame, keys: Sequence[str], values: Sequence[str] = ("value",), by: Sequence[str] = ()) -> DataFrame:
    """One row per time with a struct column s0, s1, ... for each key; the last sample in seq counts at equal times."""
    picked = [F.max_by(F.when(F.col("signal_key") == k, F.struct(*[F.col(v).alias(v) for v in values])), F.when(F.col("signal_key") == k, F.col("seq"))).alias(f"s{i}") for i, k in enumerate(keys)]
    return samples.where(F.col("signal_key").isin(list(keys))).groupBy(*by, "t_s").agg(*picked)


def aligned(samples: DataFrame, keys: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """(t_s, s0, s1, ...): every key's held value on the union of their times, from the latest first sample on."""
    held = hold(wide(samples, keys, by=by), [f"s{i}" for i in range(len(keys))], by=by, buckets=buckets, cut=slices(samples.where(F.col("signal_key").isin(list(keys))), buckets=buckets))
    for i in range(len(keys)):
        held = held.where(F.col(f"s{i}").isNotNull())
    return held.select(*by, "t_s", *[F.col(f"s{i}.value").alias(f"s{i}") for i in range(len(keys))])


def union_grid(samples: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    chosen = samples if keys is None else samples.where(F.col("signal_key").isin(list(keys)))
    return chosen.select("t_s").distinct()


def reference_grid(samples: DataFrame, key: str) -> DataFrame:
    """Exactly the key's times, equal ones kept."""
    return samples.where(F.col("signal_key") == key).select("t_s")


def grid_steps(first: float, last: float, step: float) -> int:
    """Whole steps from first to last; a ratio within 1e-12 of a whole number is that number."""
    if not (math.isfinite(step) and step > 0):
        raise ValueError("The recurrence must be a positive number of seconds")
    ratio = (last - first) / step
    near = round(ratio)
    return int(near) if abs(ratio - near) <= 1e-12 * max(1.0, abs(ratio)) else int(math.floor(ratio))


def regular_grid(spark: SparkSession, first: float, last: float, step: float) -> DataFrame:
    n = grid_steps(first, last, step)
    return spark.range(n + 1).select((F.lit(float(first)) + F.col("id") * F.lit(float(step))).alias("t_s"))


def time_bounds(samples: DataFrame):
    """(first, last) over all series, or None."""
    row = samples.agg(F.min("t_s"), F.max("t_s")).first()
    return None if row[0] is None else (row[0], row[1])


def on_grid(samples: DataFrame, keys: Sequence[str], grid: DataFrame, value: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The grid's rows with one column per key: the held value (or `value`, say a label if any), NULL before its first sample."""
    shown = samples.withColumn("_shown", F.col("value") if value is None else value)
    table = wide(shown, keys, ["_shown"]).withColumn("_n", F.lit(0).cast("long"))
    points = grid.groupBy(F.col("t_s")).agg(F.count(F.lit(1)).alias("_n"))
    both = table.unionByName(points, allowMissingColumns=True)
    held = hold(both, [f"s{i}" for i in range(len(keys))], then=["_n"], buckets=buckets, cut=slices(samples.where(F.col("signal_key").isin(list(keys))), buckets=buckets)).where("_n > 0")
    rows = held.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return rows.select("t_s", *[F.col(f"s{i}._shown").alias(k) for i, k in enumerate(keys)])


def nearest(samples: DataFrame, at: float) -> DataFrame:
    """Per signal the sample nearest in time: of two equally near the later one, beyond the ends the end sample."""
    nearer = F.struct((-F.abs(F.col("t_s") - F.lit(float(at)))).alias("d"), F.col("t_s"), F.col("seq"))
    label = F.col("label") if "label" in samples.columns else F.lit(None).cast("string")
    best = samples.groupBy("signal_key").agg(F.max_by(F.struct("t_s", "value", label.alias("label")), nearer).alias("s"))
    return best.select("signal_key", "s.t_s", "s.value", "s.label")


def cursor_difference(samples: DataFrame, first: float, second: float) -> DataFrame:
    """Per signal the values at two cursors and their difference; NULL where either is a text."""
    a = nearest(samples, first).select("signal_key", F.col("value").alias("value_1"), F.col("label").alias("label_1"))
    b = nearest(samples, second).select(F.col("signal_key").alias("_k"), F.col("value").alias("value_2"), F.col("label").alias("label_2"))
    text = (F.coalesce("label_1", F.lit("")) != "") | (F.coalesce("label_2", F.lit("")) != "")
    return a.join(b, F.col("signal_key") == F.col("_k")).select("signal_key", "value_1", "value_2", F.when(~text, F.col("value_2") - F.col("value_1")).alias("difference"))
