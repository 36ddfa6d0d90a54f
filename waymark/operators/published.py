"""The list of published tables: reading a pasted one, matching names against it, checking it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import names
from waymark.operators.words import naming

_HEADINGS = {"TABLE", "TABLES", "TABLE NAME", "TABLE_NAME", "NAME", "PUBLISHED", "PUBLISHED TABLES", "PRODUCTION", "PRODUCTION TABLES", "DATASET", "PROJECT", "OWNER", "DESCRIPTION", "SCHEMA"}
_NAME = re.compile(r"^[A-Za-z_][\w$\-]*(?:[.:][\w$\-*]+)*\*?$")


@dataclass
class Rule:
    """Entries (given, kind, key): kind is name, glob or suffix. same holds pairs that are spelled apart but name one table."""

    entries: list[tuple[str, str, str]] = field(default_factory=list)
    duplicates: list[str] = field(default_factory=list)
    same: list[tuple[str, str]] = field(default_factory=list)
    rejected: list[str] = field(default_factory=list)


def _tidy(cell: str) -> str:
    cell = re.sub(r"^\s*(?:[-*•–]|\d+[.)])\s+", "", cell.strip())
    cell = cell.strip("`\"'[]() \t").rstrip(",;.")
    cell = re.sub(r"\s*[(\[].*$", "", cell)
    return cell.strip("`\"' ")


def _columns(lines: list[str]) -> list[list[str]]:
    """Cells of each line: by tab, bar, semicolon or comma, whichever parts the lines alike."""
    for mark in ("\t", "|", ";", ","):
        cut = [[c for c in (x.strip("|").split(mark) if mark == "|" else x.split(mark))] for x in lines]
        widths = {len(c) for c in cut}
        if max(widths) > 1 and len(widths) <= 2 and mark != ",":
            return cut
        if mark == "," and max(widths) > 1:
            named = all(_NAME.match(_tidy(c)) or not c.strip() for row in cut for c in row)
            return [[c] for row in cut for c in row] if named and len(lines) == 1 else cut
    return [[x] for x in lines]


def _pick(rows: list[list[str]]) -> int:
    """The column that holds the tables: one whose heading says so, else the one that looks most like names."""
    for k, head in enumerate(rows[0] if rows else []):
        if re.search(r"\btable", head, re.IGNORECASE):
            return k
    width = max(map(len, rows), default=1)
    score = [0] * width
    for row in rows:
        for k, cell in enumerate(row):
            c = _tidy(cell)
            score[k] += 3 if _NAME.match(c) and ("." in c or "_" in c) else 1 if _NAME.match(c) else 0
    return max(range(width), key=lambda k: (score[k], -k))


def parse_rule(text: str) -> Rule:
    """Reads a list as people paste it: one to a line, bulleted, a table with columns, or after commas."""
    rule = Rule()
    lines = [x for x in text.replace("\r", "").split("\n") if x.strip() and not re.fullmatch(r"[\s|:\-+=]+", x)]
    if not lines:
        return rule
    rows = _columns(lines)
    column = _pick(rows)
    seen: dict[tuple[str, str], str] = {}
    for row in rows:
        cell = _tidy(row[column]) if column < len(row) else ""
        for given in cell.split() if cell and all(_NAME.match(x) or x[:1] in "*_" for x in cell.split()) else [cell]:
            if not given:
                continue
            bare = re.sub(r"\$\d+$", "", re.split(r"[.:]", given)[-1]).upper()
            if given.upper() in _HEADINGS:
                continue
            kind = "glob" if "*" in bare or "?" in bare else "suffix" if bare.startswith("_") else "name" if _NAME.match(given) else ""
            if not kind:
                rule.rejected.append(given)
            elif (kind, bare) in seen:
                rule.duplicates.append(given)
                if seen[kind, bare].upper() != given.upper():
                    rule.same.append((seen[kind, bare], given))
            else:
                seen[kind, bare] = given
                rule.entries.append((given, kind, bare))
    return rule


def match(rule: Rule, table: Column) -> Column:
    """name, glob, suffix, shard or placeholder for a published table; empty for others."""
    bare = names.short(table)
    kin = names.family(table)
    exact = [k for _, kind, k in rule.entries if kind == "name"]
    how = F.when(bare.isin(*exact), "name") if exact else F.when(F.lit(False), "name")
    # one pattern for all entries of a kind, however long the list
    globs = "|".join("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in key) for _, kind, key in rule.entries if kind == "glob")
    suffixes = "|".join(re.escape(key) for _, kind, key in rule.entries if kind == "suffix")
    if globs:
        how = how.when(bare.rlike(f"^(?:{globs})$"), "glob")
    if suffixes:
        how = how.when(bare.rlike(f"(?:{suffixes})$"), "suffix")
    if exact:
        how = how.when((kin["family"] != "") & kin["family"].isin(*exact), kin["how"])
    return how.otherwise("")


def check(rule: Rule, tables: DataFrame, files: DataFrame) -> DataFrame:
    """(given, kind, key, found, how, mentions) of each entry: known tables first, then the text of files."""
    spark = tables.sparkSession
    entries = spark.createDataFrame(rule.entries or [("", "", "")], "given string, kind string, key string").where("key <> ''")
    known = tables.select(names.short(F.col("table")).alias("key"), names.family(F.col("table")).alias("kin")).distinct()
    exact = known.select("key").distinct().withColumn("exact", F.lit(True))
    kin = known.where("kin.family <> ''").select(F.col("kin.family").alias("key"), F.col("kin.how").alias("kin_how")).groupBy("key").agg(F.min("kin_how").alias("kin_how"))
    told = entries.join(exact, "key", "left").join(kin, "key", "left")
    told = told.withColumn("how", F.when(F.col("exact"), "name").otherwise(F.coalesce("kin_how", F.lit(""))))
    unseen = told.where("how = '' and kind = 'name'").select(F.col("key").alias("name"))
    hits = naming(files.select("file", "text"), "text", unseen)
    counted = hits.groupBy(F.col("name").alias("key")).agg(F.count_distinct("file").alias("mentions"))
    return told.join(counted, "key", "left").select("given", "kind", "key", (F.col("how") != "").alias("found"), "how", F.coalesce("mentions", F.lit(0)).alias("mentions"))
