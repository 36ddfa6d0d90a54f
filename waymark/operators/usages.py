"""What a use of a column means: labels, priorities, what a change breaks, and how bad that is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of use, the most telling first, and how each is called.
LABELS = {
    "ranking": "Ranking", "dedup_key": "Dedup key", "layout": "Partition or cluster key", "filter": "Filter", "join_key": "Join key",
    "transform": "Transform", "aggregation": "Aggregation", "sort": "Sort order", "pivoted": "Named in PIVOT", "excluded": "Named in EXCEPT",
    "renamed": "Renamed by ALTER TABLE", "dropped": "Dropped by ALTER TABLE", "retyped": "Changed by ALTER TABLE", "select": "Select",
    "star": "Carried by SELECT *",
}
PRIORITY = {k: n for n, k in enumerate(LABELS)}
_NAMED = {"filter", "join_key", "ranking", "dedup_key", "transform", "aggregation", "sort", "excluded", "pivoted", "layout", "select", "renamed", "retyped"}
#: The uses that each kind of change breaks.
BREAKS = {
    "removal": _NAMED,
    "rename": _NAMED,
    "value_change": {"filter", "join_key", "transform"},
    "type_change": {"filter", "join_key", "transform", "pivoted", "layout", "retyped"},
    "unknown": {"filter", "join_key", "ranking", "dedup_key", "transform", "sort", "pivoted", "layout", "renamed", "retyped"},
}
TABLE_BREAKS = {"removal", "rename", "unknown"}
NO_LOCAL_FIX = {"ranking", "dedup_key"}
CHANGES = tuple(BREAKS)


def priority(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])[kind], F.lit(len(PRIORITY)))


def label(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])[kind], kind)


def breaks(kind: Column, change: str) -> Column:
    return kind.isin(*BREAKS[change])


def no_local_fix(kind: Column, change: str) -> Column:
    return kind.isin(*NO_LOCAL_FIX) & F.lit(change in ("removal", "rename"))


def best(uses: DataFrame, *by: str) -> DataFrame:
    """One use of each kind for each ``by``: certain before uncertain, with a detail before without, then by line."""
    order = Window.partitionBy(*by, "kind").orderBy(F.desc("certain"), (F.col("detail") == ""), "line", "detail", "alias")
    return uses.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def primary(uses: DataFrame, *by: str) -> DataFrame:
    """The use that heads each ``by``, with the kinds of all of them."""
    order = Window.partitionBy(*by).orderBy(priority(F.col("kind")), F.desc("certain"), "line")
    every = Window.partitionBy(*by)
    told = best(uses, *by).withColumn("__n", F.row_number().over(order)).withColumn("kinds", F.array_sort(F.collect_set("kind").over(every)))
    return told.where("__n = 1").drop("__n")


#: How a sentence about a use goes, by change; our own words.
_SAYS = {
    "filter": "filters on {c}{d}", "join_key": "joins on {c}", "ranking": "ranks rows by {c}, so it decides which row wins",
    "dedup_key": "keeps one row for each {c} or its extreme", "layout": "lays its table out by {c}", "transform": "computes with {c}{d}",
    "aggregation": "groups by {c}", "sort": "sorts by {c}", "pivoted": "turns {c} between rows and columns", "excluded": "names {c} to leave it out",
    "renamed": "renames {c} itself", "dropped": "drops {c} itself", "retyped": "alters {c} itself", "select": "takes {c} over as it is", "star": "takes every column over, {c} among them",
}
_THEN = {
    "removal": {True: "It fails once the column is gone.", False: "It goes on working."},
    "rename": {True: "It fails until it uses the new name.", False: "It goes on working."},
    "value_change": {True: "It gives other rows or values without an error.", False: "New values pass through."},
    "type_change": {True: "It may fail or compare differently.", False: "The new type passes through."},
    "unknown": {True: "It may break; the notice doesn't say how the column changes.", False: "It most likely goes on working."},
}


def sentence(kind: Column, column: Column, detail: Column, breaking: Column, change: str) -> Column:
    said = F.create_map(*[F.lit(x) for p in _SAYS.items() for x in p])[kind]
    shown = F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise("")
    text = F.replace(F.replace(said, F.lit("{c}"), column), F.lit("{d}"), shown)
    return F.concat(F.lit("The statement "), text, F.lit(". "), F.when(breaking, _THEN[change][True]).otherwise(_THEN[change][False]))


#: Words that mark the line a use stands on.
MARKERS = {
    "filter": ("WHERE", "AND ", "OR ", "HAVING"), "join_key": ("JOIN", " ON "), "ranking": ("ORDER BY", "OVER", "ROW_NUMBER", "RANK"),
    "aggregation": ("GROUP BY",), "dedup_key": ("MAX(", "MIN(", "GROUP BY"), "transform": ("SUBSTR", "CAST", "TRIM", "UPPER", "LOWER", "COALESCE", "CONCAT", "("),
    "excluded": ("EXCEPT", "SELECT"), "pivoted": ("UNPIVOT", "PIVOT", " FOR ", " IN ("), "layout": ("PARTITION BY", "CLUSTER BY"), "sort": ("ORDER BY",),
    "renamed": ("RENAME COLUMN", "RENAME", "ALTER"), "dropped": ("DROP COLUMN", "DROP", "ALTER"), "retyped": ("ALTER COLUMN", "SET DATA TYPE", "ALTER"),
    "select": ("SELECT", " AS "), "star": ("SELECT *", "SELECT"),
}


def snippet(text: Column, line: Column, around: int = 2) -> Column:
    """The lines about a 0-based line as array<struct<line, text, hit>>, lines counted from 1."""
    lines = F.split(text, "\n", -1)
    first = F.greatest(line - around, F.lit(0))
    near = F.slice(lines, first + 1, F.lit(2 * around + 1) - F.greatest(F.lit(around) - line, F.lit(0)))
    return F.transform(near, lambda x, i: F.struct((first + i + 1).alias("line"), x.alias("text"), (first + i == line).alias("hit")))


def locate(text: Column, column: Column, kind: Column, start: Column, end: Column) -> Column:
    """0-based line in start..end that the use of a column stands on: lines with the name score 1, and 2 for each marker; the first best one."""
    marks = F.create_map(*[x for k, ms in MARKERS.items() for x in (F.lit(k), F.array(*map(F.lit, ms)))])[kind]
    name = F.concat(F.lit(" "), F.upper(column), F.lit(" "))
    lines = F.slice(F.split(F.upper(text), "\n", -1), start + 1, F.greatest(end - start + 1, F.lit(1)))

    def score(line: Column, words: Column) -> Column:
        padded = F.concat(F.lit(" "), F.regexp_replace(line, r"[^\p{L}\p{N}_]", " "), F.lit(" "))
        hits = F.aggregate(words, F.lit(0), lambda a, m: a + F.when(line.contains(m), 2).otherwise(0))
        return F.when(padded.contains(name), 1 + hits).otherwise(0)

    def place(scores: Column) -> Column:
        top = F.array_max(scores)
        return F.when(top > 0, start + F.array_position(scores, top).cast("int") - 1).otherwise(start)

    return _once(_once(marks, lambda words: F.transform(lines, lambda x: score(x, words))), place)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]
