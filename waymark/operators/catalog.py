"""What columns tables have: stated ones first, then those that a query gives, then those that stars pass on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import names
from waymark.functions.shared import SENT, settle, unsent
from waymark.plans.tables import Tables


def build_catalog(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(catalog, gaps): catalog (table, key, pos, column, type, file, derived); gaps (table, file) can't be filled in.

    Stated column lists win over those read off a query; of equals the first file does.
    Tables built by a star get the columns of the tables it covers, but only once all of
    those are known; each round makes at least one more table known, and the loop ends
    when none does. Chains of tables that each take all columns of one other are made one
    step first, however long they are.
    """
    stated = t.columns.where("name <> ''").withColumn("key", names.short(F.col("target")))
    stated = stated.withColumn("derived", F.col("type") == "").withColumn("ord", F.monotonically_increasing_id())
    first = Window.partitionBy("key").orderBy("derived", "file", "stmt")
    chosen = stated.withColumn("winner", F.first(F.struct("stmt", "derived")).over(first)).where("winner.stmt = stmt and winner.derived = derived")
    listed = chosen.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("ord")) - 1)
    known = settle(listed.select(F.col("target").alias("table"), "key", "pos", F.col("name").alias("column"), "type", "file", "derived"))
    stars = settle(t.flows.where("column = '*' and out = '*' and temp = false").select("stmt", "file", "target", F.col("t_short").alias("key"), F.col("s_short").alias("source"), "without"))
    named = settle(t.flows.where("(column <> '*' or out <> '*') and how <> 'carried' and not contains(out, '.')").select("stmt", F.col("out").alias("column")).distinct())
    large = known.count() + named.count() + stars.count() > SENT
    known, named, stars = (unsent(df, large) for df in (known, named, stars))
    every_star = stars
    stars, named = _contracted(stars, named, known)
    rounds = 0
    while True:
        rounds += 1
        have = unsent(known.select("key").distinct(), large)
        open_ = stars.join(have, "key", "left_anti")
        missing = open_.join(have, open_["source"] == have["key"], "left_anti").select("stmt").distinct()
        ready = open_.join(missing, "stmt", "left_anti")
        source = unsent(known.select(F.col("key").alias("source"), "pos", "column", "type"), large)
        passed = ready.join(source, "source").where(~F.array_contains(F.split("without", ","), F.upper("column")))
        extra = ready.select("stmt", "file", "target", "key").distinct().join(named, "stmt").withColumn("type", F.lit(""))
        rows = passed.select("stmt", "file", "target", "key", "pos", "column", "type").unionByName(extra)
        one = Window.partitionBy("key").orderBy("stmt")
        rows = rows.withColumn("winner", F.first("stmt").over(one)).where("winner = stmt")
        rows = rows.groupBy("key", "target", "file", "column").agg(F.min("pos").alias("at"), F.max("type").alias("type"))
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("at", "column")) - 1)
        new = settle(rows.select(F.col("target").alias("table"), "key", "pos", "column", "type", "file", F.lit(True).alias("derived")))
        if new.isEmpty():
            break
        known = known.unionByName(new)
        if rounds % 8 == 0:  # plans stay short
            known = settle(known)
    have = unsent(known.select("key").distinct(), large)
    gaps = every_star.join(have, "key", "left_anti").select(F.col("target").alias("table"), "file").distinct()
    return unsent(known, large), gaps


def _contracted(stars: DataFrame, named: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stars, named) with each chain of single stars as one star over its first table; named (stmt, column, pos) says what is listed beside it.

    Pointer doubling: each round a table's step and the step of the table it leads to
    become one, so a chain takes as many rounds as its length has binary digits. What the
    steps leave out unites; columns that a table lists itself are passed on unless a later
    step leaves them out, those of earlier tables before those of later ones.
    """
    last = 1_000_000
    one = stars.groupBy("key").agg(F.count("*").alias("n")).where("n = 1").select("key").join(known.select("key"), "key", "left_anti")
    links = settle(stars.where("key <> source").join(one, "key").select("stmt", "file", "target", "key", "source", F.filter(F.split("without", ","), lambda c: c != "").alias("gone"), F.lit(1).alias("depth")))
    n = links.count()
    listed = named.withColumn("pos", F.lit(last))
    if not n:
        return stars, listed
    chained = links.select("stmt")
    extra = settle(links.select("stmt", "key").join(named, "stmt").select("key", "column", F.lit(0).alias("level")))
    for _ in range(n.bit_length()):
        onward = links.select(F.col("key").alias("source"), F.col("source").alias("first"), F.col("gone").alias("more"), F.col("depth").alias("further"))
        joined = settle(links.join(onward, "source", "left"))
        if joined.where("first is not null").isEmpty():
            break
        passed = joined.where("first is not null").select("key", "source", "gone", "depth").join(extra.select(F.col("key").alias("source"), "column", "level"), "source")
        passed = passed.where(~F.array_contains("gone", F.upper("column"))).select("key", "column", (F.col("level") + F.col("depth")).alias("level"))
        extra = settle(extra.unionByName(passed).groupBy("key", "column").agg(F.min("level").alias("level")))
        links = joined.select(
            "stmt", "file", "target", "key", F.coalesce("first", "source").alias("source"),
            F.when(F.col("first").isNull(), F.col("gone")).otherwise(F.array_union("gone", F.coalesce("more", F.array().cast("array<string>")))).alias("gone"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"),
        )
    rest = stars.join(chained, "stmt", "left_anti")
    short = links.select(*(F.array_join("gone", ",").alias("without") if c == "without" else F.col(c) for c in stars.columns))
    listed = listed.join(chained, "stmt", "left_anti").unionByName(extra.join(links.select("key", "stmt"), "key").select("stmt", "column", (F.lit(last) - F.col("level")).alias("pos")))
    return settle(rest.unionByName(short)), settle(listed)


def carriers(catalog: DataFrame) -> DataFrame:
    """(column, tables): how many tables have a column of each name."""
    return catalog.groupBy(F.upper("column").alias("column")).agg(F.count_distinct("key").alias("tables"))


def ambiguous(t: Tables) -> DataFrame:
    """(key, datasets, spellings): names that stand for more than one table, or are written in more than one way."""
    seen = t.uses.select(F.col("table").alias("name")).unionByName(t.statements.where("target <> ''").select(F.col("target").alias("name")))
    seen = seen.where(~names.is_fenced(F.col("name"))).distinct()
    told = seen.groupBy(names.short(F.col("name")).alias("key")).agg(
        F.array_sort(F.collect_set(F.when(names.dataset(F.col("name")) != "", names.dataset(F.col("name"))))).alias("datasets"),
        F.max(names.dataset(F.col("name")) == "").alias("bare"),
        F.array_sort(F.collect_set(F.regexp_extract("name", r"([^.]*)$", 1))).alias("spellings"),
    )
    return told.withColumn("ambiguous", (F.size("datasets") > 1) | (F.size("datasets") == 1) & F.col("bare"))


def rebuilt(t: Tables) -> DataFrame:
    """(key, files): tables that more than one file creates."""
    made = t.statements.where("kind like 'CREATE %' and not temp and target <> ''")
    return made.groupBy(F.col("t_short").alias("key")).agg(F.array_sort(F.collect_set("file")).alias("files")).where("size(files) > 1")
