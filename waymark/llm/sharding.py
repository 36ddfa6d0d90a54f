"""Dealing rows to shards by jump consistent hashing.

A key's shard is found from the key and the number of shards alone: a generator seeded with
the key jumps from one shard to the next it would move to as shards are appended, until it
jumps past the last one. There is no table of the ring, and with one shard more a row
either stays or goes to the new shard. Keys are hashed to 64 bits first, so neighbouring
keys and keys of any type spread alike.

Slots number the rows of a shard without gaps. Rows are settled with their shard, counted
by partition and shard, and numbered where they lie; the numbers before a partition are
sums of those counts. No shard is ever brought together, however many rows share a key.

Nulls: rows without a key share one shard; a null text has no bytes. Repeated rows get a
slot each. An empty table gives an empty result. Other columns are left out by ``assign``,
``with_shard`` and ``write_shards`` keep them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from waymark.llm.common import documents, joined_small, settle

SHARDS = 24
#: The multiplier of the published generator.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, from 0 to ``shards`` - 1."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), dtype=np.int64)
    next_ = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = next_[moving]
        state[moving] = state[moving] * STEP + np.uint64(1)
        high = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        next_[moving] = ((at[moving] + 1) * (float(1 << 31) / high)).astype(np.int64)
        moving = moving[next_[moving] < shards]
    return at.astype(np.int32)


def shard_of(shards: int, *keys: Column | str) -> Column:
    """The shard (int) of rows with these keys."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf("int")
    def found(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(), shards))

    return found(F.xxhash64(*keys))


def with_shard(rows: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """``rows`` with their shard."""
    return rows.withColumn("shard", shard_of(shards, key))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", tasks: int = 1) -> None:
    """Parquet files in a folder for each shard; ``tasks`` write each one, rows dealt to them by their place in the input."""
    dealt = with_shard(rows, shards, key).withColumn("__task", F.pmod(F.monotonically_increasing_id(), F.lit(tasks)))
    dealt.repartition(shards * tasks, "shard", "__task").drop("__task").write.partitionBy("shard").parquet(path)


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """Settled ``rows`` with slot: each group's rows counted from 0, without gaps."""
    part = F.spark_partition_id().alias("__part")
    counts = rows.groupBy(part, group).agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select("__part", group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[object, int] = {}
        for b in batches:
            keys = b[group].to_numpy(zero_copy_only=False)
            place = np.empty(len(keys), dtype=np.int64)
            for k in np.unique(keys).tolist():
                at = np.flatnonzero(keys == k)
                place[at] = seen.get(k, 0) + np.arange(len(at))
                seen[k] = seen.get(k, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(keys), part, dtype=np.int32)), pa.array(place)], [*b.schema.names, "__part", "__place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(run, f"{kinds}, __part int, __place bigint")
    return joined_small(placed, starts, ["__part", group], "inner").select(*rows.columns, (F.col("__start") + F.col("__place")).alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law (key), shard, slot and grown_shard, the shard if there were one more."""
    keyed = documents(docs.withColumn("__key", F.xxhash64(key)), "__key")
    text = F.col("text").cast("binary")
    sized = keyed.select(
        "doc_id", (F.octet_length("text") + F.lit(8)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(shards, "__key").alias("shard"), shard_of(shards + 1, "__key").alias("grown_shard"),
    )
    return numbered(settle(sized), "shard")
