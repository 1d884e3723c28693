import os
import shutil

from tracewright.operators import trace
from tracewright.operators.keys import FRAMES
from tracewright.streaming.trace import streaming_differences, windowed_counts


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, k / 10, "CAN", 1 + k % 2, 0x100 + k % 3, False, False, k % 7 == 0, False, False, 1, "Rx", bytearray([k % 4])) for k in range(60)]
    staged, source = str(tmp_path / "staged"), str(tmp_path / "in")
    os.makedirs(source)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(source)
    query = streaming_differences(stream).writeStream.format("memory").queryName("diffs").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    counted = windowed_counts(spark.readStream.schema(FRAMES).parquet(source), 2).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "check2")).start()
    try:
        for k in range(3):
            spark.createDataFrame(rows[20 * k : 20 * k + 20], FRAMES).coalesce(1).write.mode("overwrite").parquet(staged)
            for name in os.listdir(staged):
                if name.endswith(".parquet"):
                    shutil.move(os.path.join(staged, name), os.path.join(source, f"{k}-{name}"))
            query.processAllAvailable()
        counted.processAllAvailable()
    finally:
        query.stop()
        counted.stop()
    got = {r["frame_idx"]: (r["prev_idx"], r["delta_s"]) for r in spark.table("diffs").collect()}
    want = {r["frame_idx"]: (r["prev_idx"], r["delta_s"]) for r in trace.differences(spark.createDataFrame(rows, FRAMES)).collect()}
    assert got == want
    assert sum(r["n"] for r in spark.table("counts").collect()) == 60
