"""Which texts name what: an index from words to files and lines, and joins with it.

A word is a run of letters, digits and underscores, in upper case. A name is looked up by
its first word and, if it is more than that, held against the text around it; so any
number of names is a join, and no pattern of all names is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.shared import settle

WORD = r"([\p{L}\p{N}_]+)"


def words_of(text: Column) -> Column:
    """The words of a text, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.upper))


def first_word(name: Column) -> Column:
    return F.upper(F.regexp_extract(name, WORD, 1))


def whole(names: Column) -> Column:
    """A pattern for any of an array of names, whole, the longest first; case doesn't count."""
    longest = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(longest, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E")))
    return F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}_])"))


def naming(rows: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """``rows`` with name, once for each of ``names`` (name) that their ``text`` has as whole words; case doesn't count."""
    wanted = names.select("name").distinct().withColumn("__word", first_word(F.col("name"))).where("__word <> ''")
    hit = rows.withColumn("__word", F.explode(words_of(F.col(text)))).join(wanted, "__word")
    alone = F.upper("name") == F.col("__word")
    return hit.where(alone | F.regexp_like(text, whole(F.array("name")))).drop("__word")


def index(files: DataFrame) -> DataFrame:
    """(word, file, lines) of (file, text): written once, then only joined."""
    lines = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    each = lines.select("file", (F.col("at") + 1).alias("line_no"), F.explode(words_of(F.col("line"))).alias("word"))
    return settle(each.groupBy("word", "file").agg(F.array_sort(F.collect_list("line_no")).alias("lines")))


def lines_naming(found: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """(file, line_no, line, name) for each line of an index' files with one of ``names`` (name); name is the first on the line."""
    wanted = names.select("name").distinct().withColumn("word", first_word(F.col("name"))).where("word <> ''")
    by_line = found.join(wanted, "word").select("file", F.explode("lines").alias("line_no"), "name")
    by_line = by_line.groupBy("file", "line_no").agg(F.array_sort(F.collect_set("name")).alias("names"))
    by_file = by_line.groupBy("file").agg(F.collect_list(F.struct("line_no", "names")).alias("places"))
    texts = by_file.join(files.select("file", F.split("text", "\n", -1).alias("__lines")), "file")
    each = texts.select("file", "__lines", F.explode("places").alias("p")).select("file", "p.line_no", F.element_at("__lines", F.col("p.line_no")).alias("line"), "p.names")
    told = each.withColumn("name", F.lower(F.regexp_substr("line", whole(F.col("names")))))
    return told.where("name is not null").select("file", "line_no", "line", "name")
