"""What an answer says in words, from its few aggregates: a summary and a reply."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.engine import Scan

SHOWN = 6
RISKS = {
    "none": "Nothing uses it, and everything relevant could be read.", "low": "It is used, and what uses it goes on working.",
    "medium": "Something breaks, and can be changed here.", "high": "Something breaks that can't be repaired here: the rows kept or the order depend on it.",
    "unknown": "Nothing was found, but not everything could be read.",
}


def listed(items: list[str], most: int = SHOWN, total: int = 0) -> str:
    """a, b and c; or the first ones and how many more, where ``total`` counts those that aren't given too."""
    total = max(total, len(items))
    if total > most:
        return ", ".join(items[:most]) + f" and {total - len(items[:most])} more"
    return items[0] if len(items) == 1 else ", ".join(items[:-1]) + f" and {items[-1]}" if items else "none"


def plural(n: int, one: str, more: str | None = None) -> str:
    return f"{n} {one if n == 1 else more or one + 's'}"


def summarise(scan: Scan) -> dict:
    """headline, points, actions: what was found, in the order that matters."""
    s = scan.stats
    prods = [r["prod"] for r in scan.groups.select("prod").limit(SHOWN).collect()]
    points, actions = [], []
    missing = [r["root"] for r in scan.attributes.where("not found").select("root").collect()]
    if prods:
        total = scan.groups.count()
        points.append(f"{plural(total, 'published table')} affected: {listed(prods, total=total)}.")
    elif s["tablesReached"]:
        points.append(f"It reaches {plural(s['tablesReached'], 'table')}, none of them published.")
    else:
        points.append("It reaches no table.")
    if s["breakingUsages"]:
        points.append(f"{plural(s['breakingUsages'], 'use')} in {plural(s['filesWithImpact'], 'file')} would break.")
        rows = scan.findings.where("breaking").orderBy("hop", "file", "line").select("file", "line", "label", "column").limit(SHOWN).collect()
        actions += [f"Change {r['file']}:{r['line']} ({r['label'].lower()} on {r['column']})." for r in rows]
    if s["productionStopsLoading"]:
        points.append(f"{plural(s['productionStopsLoading'], 'further published table')} would stop being refreshed.")
    if s["feedsBroken"]:
        points.append(f"{plural(s['feedsBroken'], 'delivery', 'deliveries')} would break.")
    if missing:
        points.append(f"No use was found of {listed(missing)}.")
    for gap in scan.coverage["gaps"][:SHOWN]:
        points.append(f"Not seen: {gap['count']} {gap['what']}.")
    if not scan.coverage["complete"]:
        files = [r["file"] for r in scan.mentions.select("file").limit(SHOWN).collect()]
        if files:
            actions.append(f"Look through {listed(files)} by hand.")
    return {"headline": f"Risk: {scan.risk}. {RISKS[scan.risk]}", "points": points[: 2 * SHOWN], "actions": actions[:SHOWN]}


def reply(scan: Scan, to: str = "", subject: str = "") -> str:
    """A letter back to whoever announced the change."""
    said = summarise(scan)
    lines = [f"Dear {to}," if to else "Hello,", "", f"we looked at what your change{f' ({subject})' if subject else ''} does to us.", "", said["headline"]]
    lines += [f"- {p}" for p in said["points"]]
    if scan.findings.where("no_local_fix").limit(1).count():
        lines += ["", "Some of it decides which rows are kept. We need a replacement for the column from you before it goes."]
    if said["actions"]:
        lines += ["", "What we will do:", *(f"- {a}" for a in said["actions"])]
    return "\n".join([*lines, "", "Regards"])


def to_json(scan: Scan):
    """The findings as one JSON text each."""
    return scan.findings.select(F.to_json(F.struct("*")).alias("finding"))


def document(scan: Scan) -> DataFrame:
    """(part, json): the whole answer as JSON texts, one for each row of each part, and one for its head.

    Each part is a frame of its own and stays one, so an answer of any size is written as
    it is; a reader takes the parts it shows.
    """
    spark = scan.findings.sparkSession
    head = {
        "risk": scan.risk, "stats": scan.stats, "coverage": scan.coverage, "warnings": scan.warnings, "maxHops": scan.max_hops, "change": scan.change,
        "asked": [f"{a.table}.{c}" for a in scan.asks for c in a.columns] + [a.table for a in scan.asks if a.whole], "filesScanned": scan.repo.tables.files.count(),
    }
    parts = {
        "attributes": scan.attributes, "groups": scan.groups, "rows": scan.rows, "other": scan.other, "reached": scan.reached, "branches": scan.branches, "checkByHand": scan.by_hand,
        "mentionsOnly": scan.mentions, "cutShort": scan.cut, "notes": scan.notes, "stopsLoading": scan.stops, "referencedHere": scan.references, "feeds": scan.feeds,
        "fileTypesUnopened": scan.repo.summary().where("what <> 'read'"), "missingFiles": scan.repo.sql_files()[1],
    }
    rows = [df.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("json")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows, spark.createDataFrame([("head", json.dumps(head))], "part string, json string"))
