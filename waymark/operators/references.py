"""Programs that run SQL kept in files of its own: which files those are, and which aren't there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _path(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"\\", "/"), r"^(\./|/)+", ""))


def _base(name: Column) -> Column:
    return F.regexp_extract(_path(name), r"([^/]*)$", 1)


def _ends(path: Column) -> Column:
    """A path and all it goes on with after a slash: a/b/c, b/c, c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def sql_files(refs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of refs (file, ref, line): found has run, the files whose path ends in the name, else those with its last part.

    Both are joins on equal text, so that a last part that many files share (main.sql)
    only meets the names that no path ends in.
    """
    there = files.select(F.col("file").alias("run"), _path(F.col("file")).alias("path"))
    asked = refs.select("file", "ref", "line", _path(F.col("ref")).alias("asked")).where("asked <> ''")
    ends = there.select("run", F.explode(_ends(F.col("path"))).alias("asked"))
    exact = asked.join(ends, "asked").where("run <> file").select("file", "ref", "line", "run", F.lit("path").alias("by"))
    left = asked.join(exact.select("file", "ref").distinct(), ["file", "ref"], "left_anti").withColumn("base", _base(F.col("asked"))).where("base <> ''")
    rest = left.join(there.withColumn("base", _base(F.col("path"))), "base").where("run <> file").select("file", "ref", "line", "run", F.lit("name").alias("by"))
    found = exact.unionByName(rest).distinct()
    return found, refs.join(found.select("file", "ref").distinct(), ["file", "ref"], "left_anti")
