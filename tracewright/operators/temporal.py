"""Temporal functions on a source's own samples, in (time, seq) order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.formula import TemporalCall


def _order(by: Sequence[str]):
    return Window.partitionBy(*by, "signal_key").orderBy("t_s", "seq")


def sample_column(call: TemporalCall, by: Sequence[str] = ()) -> Column:
    """The call's value at each sample. integral gives a struct (area, value, t_s) to finish on the grid."""
    w = _order(by)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    v, t = F.col("value"), F.col("t_s")
    bad = (~ieee.finite(v)).cast("int")
    name, nan = call.function, F.lit(ieee.NAN)
    if name == "lag":
        n = int(call.arguments[0])
        return F.coalesce(F.lag(v, n).over(w), nan) if n else v
    if name in ("rolling_sum", "rolling_mean"):
        n = int(call.arguments[0])
        last = w.rowsBetween(-(n - 1), 0)
        total = F.sum(F.when(ieee.finite(v), v).otherwise(0.0)).over(last)
        whole = (F.count(F.lit(1)).over(last) == n) & (F.sum(bad).over(last) == 0)
        return F.when(whole, total / n if name == "rolling_mean" else total).otherwise(nan)
    if name == "derivative":
        return F.coalesce(ieee.divide(v - F.lag(v).over(w), t - F.lag(t).over(w)), nan)
    poisoned = F.max(bad).over(so_far) > 0
    if name == "diag":
        inc, dec = call.arguments
        raw = F.sum(F.when(ieee.truth(v), F.lit(inc)).otherwise(F.lit(-dec))).over(so_far)
        return F.when(poisoned, nan).otherwise(raw)  # the floor needs a second window: see add_calls
    if name == "integral":
        area = F.coalesce(F.sum(F.col("_step")).over(so_far), F.lit(0.0))
        return F.struct(F.when(poisoned, nan).otherwise(area).alias("area"), v.alias("value"), t.alias("t_s"))
    raise ValueError(f"not a sample function: {name}")


def add_calls(samples: DataFrame, calls: Sequence[TemporalCall], by: Sequence[str] = ()) -> DataFrame:
    """samples with a column f0, f1, ... for each call but delay; one sort serves all."""
    w = _order(by)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if any(c.function == "integral" for c in calls):
        # a non-finite value must not spoil what follows by itself; poisoning is explicit
        area = F.lag("value").over(w) * (F.col("t_s") - F.lag("t_s").over(w))
        samples = samples.withColumn("_step", F.when(ieee.finite(area), area).otherwise(F.lit(0.0)))
    for k, call in enumerate(calls):
        if call.function != "delay":
            samples = samples.withColumn(f"f{k}", sample_column(call, by))
            if call.function == "diag":
                floor = F.min(F.when(ieee.finite(F.col(f"f{k}")), F.col(f"f{k}"))).over(so_far)
                samples = samples.withColumn(f"f{k}", F.col(f"f{k}") - F.least(F.coalesce(floor, F.lit(0.0)), F.lit(0.0)))
    return samples.drop("_step")


def finish_integral(held: Column, grid: Column, last: Column) -> Column:
    """The area up to the grid time: nothing is added after the last sample."""
    return held["area"] + held["value"] * (F.least(grid, last) - held["t_s"])
