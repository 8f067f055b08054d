"""Helpers shared by the operators: words as columns, shared folders, results written once."""

from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\u000b\f\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of ``text`` in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP, -1))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none (tests) gets a temporary one, kept in its settings.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='redpen-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: a lost executor costs no upstream work."""
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what ``written`` wrote for these frames, once nothing reads it any more, in whatever store it lies."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished jobs now.

    It removes them once the driver's JVM has collected what refers to them, which may be
    long after a large shuffle has been read.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def of_worker(key: Hashable, make: Callable):
    """What ``make`` gives, made once per worker process, which serves many tasks.

    A worker holds one such thing: that of an earlier operation, in whose place it comes, is let go first.
    """
    held = sys.__dict__.setdefault("_redpen_held", {})
    if key not in held:
        held.clear()
        gc.collect()
        held[key] = make()
    return held[key]
