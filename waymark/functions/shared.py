"""The folder that driver and executors share, and settling frames there."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows that may be sent to the driver and all executors at once.
SENT = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A folder of our own is made only where the setting is absent and the whole of Spark
    runs on this machine; elsewhere the absence is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if not named and not current:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        named = "file://" + tempfile.mkdtemp(prefix="waymark-")
    if current is None:
        sc.setCheckpointDir(named)
    return (named or current).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own under the shared folder."""
    return f"{shared_dir(spark)}/waymark-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage there.

    Spark removes the files when the frame is no longer referenced (where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unsent(df: DataFrame, large: bool | None = None) -> DataFrame:
    """``df`` so that no join sends it whole to the driver and all executors, if it has more than ``SENT`` rows.

    Spark guesses the size of a settled frame from the table it began with. What was read
    from generated or packed text, or exploded, is far larger than that.
    """
    if large is None:
        large = df.count() > SENT
    return df.hint("merge") if large else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in a store that Spark reaches."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove shuffle files that no frame refers to any more.

    Its cleaner learns of them when the driver's heap is collected, which may be long
    after. Python's references are let go by a thread of their own, so the heap is
    collected once more a moment later.
    """
    gc.collect()
    for _ in range(2):
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made and run in here lose their shuffle files as soon as they have run, so run each once only.

    Unlike ``release`` this doesn't wait for the driver's heap to be collected.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a worker makes of them stays small too."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
