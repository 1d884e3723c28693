import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def samples(spark):
    """Makes samples from key=(times, values[, labels])."""

    def make(**series):
        rows = []
        for key, (times, values, *labels) in series.items():
            names = labels[0] if labels else [None] * len(times)
            rows += [(key, k, float(t), float(v), n) for k, (t, v, n) in enumerate(zip(times, values, names, strict=True))]
        return spark.createDataFrame(rows, "signal_key string, seq long, t_s double, value double, label string")

    return make
