"""Shared plumbing of the llm operators: durable intermediates and small helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Numeric version of "this row is trained on": crc32(doc_id as text) mod FOLDS is not HELD_OUT.
FOLDS, HELD_OUT = 5, 0

#: Keys are hot with a HOT_KEYS-th of all rows, and HOT_ROWS at least.
HOT_KEYS, HOT_ROWS = 10_000, 32


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; set here only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tracewright-")  # a single machine: removed when Python ends
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str = "t", **options: str) -> tuple[DataFrame, str]:
    """Write df as Parquet under the shared folder and read it back.

    The table cuts the lineage: a lost executor re-reads files instead of replaying the plan.
    Returns the reread frame and the path, for drop_table(); options go to the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tw-{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Delete tables that materialize() wrote, once nothing lazy reads them any more."""
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def split_join(rows: DataFrame, table: DataFrame, keys: dict[str, str], many: str, total: int) -> DataFrame:
    """rows left-joined with table by keys (column of rows -> column of table); table has one row a key.

    `many` tells how many of the `total` rows have the key. The keys with a HOT_KEYS-th of all rows or more, of which
    there are HOT_KEYS at most, are joined by broadcast, so that no key's rows are met in one task. Keys of rows are
    not null.
    """
    from functools import reduce

    from pyspark.sql import functions as F

    bound = max(HOT_ROWS, total // HOT_KEYS + 1)
    hot = table.where(F.col(many) >= bound)
    same = lambda names: reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in names.items()])
    marks = hot.select(*[F.col(b).alias(f"_hot_{b}") for b in keys.values()])
    usual = rows.join(F.broadcast(marks), same({a: f"_hot_{b}" for a, b in keys.items()}), "left_anti")
    usual = usual.join(table.where(F.col(many) < bound), same(keys), "left")
    return usual.unionByName(rows.join(F.broadcast(hot), same(keys)))


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input cannot clash with working ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[c] for c in columns])


def train_fold(doc_id) -> "object":
    """Column: true for rows that a model may learn from."""
    from pyspark.sql import functions as F

    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != HELD_OUT
