"""The trace as a stream: the previous frame of each kind is kept as state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trace import KIND

_OUT = "frame_idx long, t_s double, bus string, channel int, arb_id long, prev_idx long, delta_s double"
_STATE = "frame_idx long, t_s double"


def streaming_differences(frames: DataFrame) -> DataFrame:
    """frame_idx, t_s, identity, prev_idx and delta_s of streamed frames; equals the batch form on ordered input."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("frame_idx")
        before_idx = [known[0], *rows["frame_idx"].iloc[:-1]]
        before_t = [known[1], *rows["t_s"].iloc[:-1]]
        state.update((int(rows["frame_idx"].iloc[-1]), float(rows["t_s"].iloc[-1])))
        out = rows[["frame_idx", "t_s", "bus", "channel", "arb_id"]].copy()
        out["prev_idx"] = pd.array(before_idx, dtype="Int64")
        out["delta_s"] = [t - b if b is not None else None for t, b in zip(rows["t_s"], before_t, strict=True)]
        yield out

    narrow = frames.select("frame_idx", "t_s", *KIND)
    return narrow.groupBy(*KIND).applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(frames: DataFrame, seconds: int = 10, late: str = "30 seconds") -> DataFrame:
    """Frames per channel in tumbling windows of recording time, with a watermark for late files."""
    timed = frames.withColumn("ts", F.timestamp_micros((F.col("t_s") * 1e6).cast("long"))).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{seconds} seconds"), "bus", "channel").agg(F.count(F.lit(1)).alias("n"))
