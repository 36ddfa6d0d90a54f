"""Table names as column expressions: which names can mean one table.

A name is its last two parts; case doesn't count, nor does a partition mark at the end.
A dataset can only rule a match out, and only if both sides state one. Names that begin
with # belong to one file and match themselves alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a run, a day or a place at the end of a table's name.
RUN_WORDS = (
    "DATE DT DS DS_NODASH RUN_DATE RUNDATE RUN_DT LOAD_DATE LOADDATE LOAD_DT EXECUTION_DATE EXEC_DATE NEXT_DS PREV_DS "
    "PARTITION_DATE PARTITION_DT PARTITIONDATE TABLE_SUFFIX SUFFIX SHARD YYYYMMDD YYYYMM YYYY_MM_DD RUN_ID RUNID BATCH_ID "
    "BATCHID RUN_TS SNAPSHOT_DATE SNAPSHOT_DT AS_OF ASOF AS_OF_DATE TIMESTAMP TS ENV ENVIRONMENT"
).split()
SHARD_ENDING = r"_([0-9]{8}|[0-9]{6}|[0-9]{4}_[0-9]{2}_[0-9]{2}|[0-9]{8}_[0-9]{2,6}|[0-9]{8}T[0-9]{6})$"


def canonical(name: Column) -> Column:
    """dataset.table of a dotted name in any quotes."""
    bare = F.regexp_replace(F.regexp_replace(name, "[`\"\\[\\]]", ""), r"\$[0-9]+$", "")
    parts = F.split(F.regexp_replace(bare, ":", "."), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")


def short(name: Column) -> Column:
    """The table's own name in upper case."""
    return F.upper(F.regexp_replace(F.regexp_extract(name, r"([^.]*)$", 1), r"\$[0-9]+$", ""))


def dataset(name: Column) -> Column:
    """The part before the table's own name in upper case; empty if none is stated."""
    return F.upper(F.regexp_extract(name, r"([^.]*)\.[^.]*$", 1))


def ordered_distinct(items: Column) -> Column:
    """An array's items in their order, of those that differ in case only the first."""
    upper = F.transform(items, F.upper)
    return F.filter(items, lambda x, k: F.array_position(upper, F.upper(x)) == k + 1)


def is_fenced(name: Column) -> Column:
    return name.startswith("#")


def same_table(a: Column, b: Column) -> Column:
    """Whether two names can mean one table."""
    loose = (short(a) == short(b)) & ((dataset(a) == "") | (dataset(b) == "") | (dataset(a) == dataset(b)))
    return F.when(is_fenced(a) | is_fenced(b), F.upper(a) == F.upper(b)).otherwise(loose)


def wildcard(pattern: Column, name: Column) -> Column:
    """How a pattern ending in * covers a name: shard, family (all but the separator), both or nothing."""
    stem = F.regexp_replace(short(pattern), r"\*$", "")
    root = F.regexp_replace(stem, "_+$", "")
    there = (dataset(pattern) == "") | (dataset(name) == "") | (dataset(pattern) == dataset(name))
    shard = F.startswith(short(name), stem) & (F.length(short(name)) > F.length(stem))
    bare = (stem == "") & (dataset(pattern) != "") & (dataset(pattern) == dataset(name))
    family = (root != "") & (short(name) == root)
    return (
        F.when(~pattern.endswith("*") | ~there, "")
        .when(stem == "", F.when(bare, "shard").otherwise(""))
        .when(shard & family, "both")
        .when(shard, "shard")
        .when(family, "family")
        .otherwise("")
    )


def is_metadata(name: Column) -> Column:
    return F.upper(name).rlike(r"(^|\.)INFORMATION_SCHEMA(\.|$)") | F.upper(name).rlike(r"(^|`)REGION-")


def family(name: Column) -> Column:
    """struct(family, how) of a name with a shard's or placeholder's ending; empty strings otherwise."""
    bare = short(name)
    base = F.regexp_replace(bare, SHARD_ENDING, "")
    parts = F.split(bare, "_")
    n = F.size(parts)
    words = F.array(*map(F.lit, RUN_WORDS))

    def tail(k: int) -> Column:
        return F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), "_")

    def head(k: int) -> Column:
        return F.array_join(F.slice(parts, 1, F.greatest(n - k, F.lit(0))), "_")

    def found(k: int) -> Column:
        return (n > k) & F.array_contains(words, tail(k))

    shard = (base != bare) & (base != "")
    what = F.when(shard, base).when(found(2), head(2)).when(found(1), head(1)).otherwise("")
    how = F.when(shard, "shard").when(found(2) | found(1), "placeholder").otherwise("")
    return F.struct(what.alias("family"), how.alias("how"))


def node_kind(name: Column, published: Column) -> Column:
    up = F.upper(name)
    return F.when(published, "Prod").when(up.startswith("TEMP") | up.contains("_TEMP"), "Temp").when(up.contains("_ODL"), "ODL").otherwise("ETL")


def suffix_verdict(suffix: Column, conditions: Column) -> Column:
    """reads, maybe or excluded, for a shard's suffix and array<struct<op, value>> of conditions that must all hold; the op ? says nothing."""

    def holds(c: Column) -> Column:
        op, value = c["op"], c["value"]
        return (
            F.when(op == "=", suffix == value)
            .when(op.isin("<>", "!="), suffix != value)
            .when(op == "<", suffix < value)
            .when(op == "<=", suffix <= value)
            .when(op == ">", suffix > value)
            .when(op == ">=", suffix >= value)
            .when(op == "IN", F.array_contains(F.split(value, ","), suffix))
            .otherwise(True)
        )

    open_ = F.exists(conditions, lambda c: c["op"] == "?")
    return F.when(~F.forall(conditions, holds), "excluded").when(open_, "maybe").otherwise("reads")
