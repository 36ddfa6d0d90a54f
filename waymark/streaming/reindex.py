"""Reading a tree again as it changes: a file stream of code, each batch parsed and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.plans.tables import read_tables
from waymark.sources.files import CODE_EXTENSIONS, from_contents

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def changes(spark: SparkSession, root: str) -> DataFrame:
    """New files under a folder, as a stream of binary files. Spark's file source takes a path once for a checkpoint."""
    glob = "*{" + ",".join(CODE_EXTENSIONS) + "}"
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)


NAMES = ("statements", "uses", "flows", "problems")


def follow(stream: DataFrame, out: str, checkpoint: str, root: str = "") -> StreamingQuery:
    """Write statements, uses, flows and problems of each batch under ``out``; a batch that is run again replaces its own files.

    Files are decoded, judged and named, relative to ``root``, as in a tree that is read
    at once. Each batch also lists the files it read, by which ``current`` knows what is
    out of date.
    """

    def batch(files: DataFrame, number: int) -> None:
        tree = from_contents(files.select("path", "length", "content"), root)
        tables = read_tables(tree)
        frames = {name: getattr(tables, name) for name in NAMES}
        frames["files"] = tables.files.select("file").unionByName(tree.unread.select("file"))
        for name, df in frames.items():
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Rows of ``name`` as they are now: of each file those of the last batch that read it."""
    last = spark.read.parquet(f"{out}/files").groupBy("file").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{name}").join(last, ["file", "batch"], "left_semi")
