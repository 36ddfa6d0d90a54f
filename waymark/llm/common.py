"""Shared pieces: shared-folder checkpoints, document columns, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.shared import release, remove, settle, shared_dir, shared_path, shuffles_removed, slices  # noqa: F401  the operators take them from here
from waymark.operators.components import components  # noqa: F401

#: Rows of statistics that a join may send whole to every executor.
SMALL = 10_000


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id (bigint), text (null becomes empty) and the columns named; the rest is left out."""
    return df.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def joined_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join with a settled table of statistics, sent to every executor if it has at most ``SMALL`` rows.

    Beyond that both sides are shuffled, and adaptive execution splits hot keys.
    """
    return left.join(F.broadcast(right) if right.count() <= SMALL else right, on, how)


def may_have(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``df`` with maybe (boolean): false only where ``column`` is no key of ``keys``.

    A filter of 2**25 bits, 4 MiB whatever the data, is sent to all executors. Rows that
    it clears need no shuffle to find out that they have no partner; where keys are so
    many that it fills up, it clears few rows, and a join decides all the same.
    """
    at = F.pmod(F.xxhash64(column), F.lit(1 << 25))
    bits = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    found = df.join(F.broadcast(bits), F.bitmap_bucket_number(at) == F.col("__bucket"), "left")
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
    return found.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("__bucket", "__bits")
