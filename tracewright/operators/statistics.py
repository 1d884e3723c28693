"""Range statistics, fits and other aggregates over samples, for all signals at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shown_as_number() -> Column:
    return F.coalesce("label", F.lit("")) == ""


def range_statistics(samples: DataFrame, start: float, end: float, hold: bool = False, skip_text: bool = True) -> DataFrame:
    """Per signal min, max, mean, population std, rms and samples in [start, end]; NaN and labelled samples are skipped.

    With hold, a signal without samples there takes its latest one before start (std 0, samples 0). Others are absent.
    """
    usable = samples.where(~F.isnan("value"))
    if skip_text and "label" in samples.columns:
        usable = usable.where(shown_as_number())
    v, inside = F.col("value"), F.col("t_s").between(F.lit(float(start)), F.lit(float(end)))
    x = F.when(inside, v)
    before = F.col("t_s") < F.lit(float(start))
    held = F.max_by(F.when(before, v), F.when(before, F.struct(F.col("t_s"), (-F.col("seq")).alias("s"))))
    out = usable.where(F.col("t_s") <= F.lit(float(end))).groupBy("signal_key").agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sqrt(F.avg(x * x)).alias("rms"), F.count(x).alias("samples"), held.alias("_held")
    )
    if not hold:
        return out.where("samples > 0").drop("_held")
    filled = {c: F.when(F.col("samples") > 0, F.col(c)).otherwise(F.col("_held")) for c in ("min", "max", "mean")}
    filled["std"] = F.when(F.col("samples") > 0, F.col("std")).otherwise(F.lit(0.0))
    filled["rms"] = F.when(F.col("samples") > 0, F.col("rms")).otherwise(F.abs("_held"))
    return out.where("samples > 0 or _held is not null").select("signal_key", *[c.alias(n) for n, c in filled.items()], "samples")


def statistics_range(visible: tuple[float, float], cursors: tuple[float | None, float | None] = (None, None)) -> tuple[float, float]:
    """Between the cursors if both are on, else what is visible."""
    a, b = cursors
    return visible if a is None or b is None else (min(a, b), max(a, b))


def value_range(samples: DataFrame) -> DataFrame:
    return samples.where(~F.isnan("value")).groupBy("signal_key").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def fit_range(samples: DataFrame, start: float, end: float) -> DataFrame:
    """The value range of a window with 5 % room: 5 % of the value if it is one value, 1 if that is zero."""
    r = value_range(samples.where(F.col("t_s").between(F.lit(float(start)), F.lit(float(end)))))
    span = F.col("max") - F.col("min")
    pad = F.when(span > 0, span * 0.05).when(F.col("max") == 0, F.lit(1.0)).otherwise(F.abs("max") * 0.05)
    return r.select("signal_key", (F.col("min") - pad).alias("low"), (F.col("max") + pad).alias("high"))


def typical_recurrence(samples: DataFrame) -> DataFrame:
    """Per signal the median of the positive steps in time."""
    step = F.col("t_s") - F.lag("t_s").over(Window.partitionBy("signal_key").orderBy("t_s", "seq"))
    steps = samples.select("signal_key", step.alias("d")).where((F.col("d") > 0) & (F.col("d") < float("inf")))
    return steps.groupBy("signal_key").agg(F.median("d").alias("recurrence_s"))


def latest(samples: DataFrame) -> DataFrame:
    """Per signal its last sample in store order, as shown: the label, else the number, else ''."""
    last = samples.groupBy("signal_key").agg(F.max_by(F.struct("value", "label"), "seq").alias("s"))
    return last.select("signal_key", display(F.col("s.value"), F.col("s.label")).alias("shown"))


def display(value: Column, label: Column) -> Column:
    return F.coalesce(F.when(label != "", label), F.when(~F.isnan(value), value.cast("string")), F.lit(""))


def signal_tree(samples: DataFrame) -> DataFrame:
    """channel, message and its sorted signals; unknown channels last."""
    tree = samples.groupBy("bus", "channel", "message").agg(F.sort_array(F.collect_set("signal")).alias("signals"))
    return tree.orderBy(F.when(F.col("bus") == "LIN", 1).otherwise(0), F.coalesce("channel", F.lit(1 << 30)), "message")


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("signal_key").agg(F.count(F.lit(1)).alias("n"), F.min("t_s").alias("first_s"), F.max("t_s").alias("last_s"))
