"""From files to flat tables of statements, uses, flows, columns and gaps.

Files are read on executors, each on its own; everything that crosses files afterwards is
a join. ``Tables`` holds one frame for each kind of row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import names
from waymark.functions.shared import settle, slices, unsent
from waymark.functions.sqltext import export_uri, fill_placeholders, renderings, rescue, split_statements, templating, unwrap_blocks
from waymark.plans.reader import VARIABLES, Statement, Unread, canonical, read_statement
from waymark.sources.extract import PLAIN, blocks, more_than_taken, sql_files, written_tables
from waymark.sources.files import Tree

_USE = pa.struct([("table", pa.string()), ("column", pa.string()), ("kind", pa.string()), ("alias", pa.string()), ("detail", pa.string()), ("certain", pa.bool_()), ("via_star", pa.bool_()), ("line", pa.int32())])
_FLOW = pa.struct([("table", pa.string()), ("column", pa.string()), ("out", pa.string()), ("how", pa.string()), ("without", pa.string()), ("certain", pa.bool_()), ("star", pa.bool_())])
_PAIR = pa.struct([("name", pa.string()), ("type", pa.string())])
_MENTION = pa.struct([("table", pa.string()), ("column", pa.string())])
_SHARD = pa.struct([("table", pa.string()), ("op", pa.string()), ("value", pa.string())])
_STATEMENT = pa.struct([
    ("no", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("line_end", pa.int32()), ("sql", pa.string()), ("target", pa.string()),
    ("temp", pa.bool_()), ("copied", pa.string()), ("named_by", pa.string()), ("as_text", pa.bool_()), ("export_uri", pa.string()),
    ("star_note", pa.string()), ("opaque", pa.bool_()), ("defines", pa.string()), ("sources", pa.list_(pa.string())), ("calls", pa.list_(pa.string())),
    ("literals", pa.list_(pa.string())), ("variables", pa.list_(pa.string())), ("joins", pa.list_(pa.string())), ("metadata", pa.bool_()),
    ("uses", pa.list_(_USE)), ("flows", pa.list_(_FLOW)), ("columns", pa.list_(_PAIR)), ("mentions", pa.list_(_MENTION)), ("shards", pa.list_(_SHARD)),
])
_PROBLEM = pa.struct([("line", pa.int32()), ("message", pa.string()), ("snippet", pa.string()), ("hint", pa.string())])
_REF = pa.struct([("ref", pa.string()), ("line", pa.int32())])
_OUT = pa.schema([("file", pa.string()), ("statements", pa.list_(_STATEMENT)), ("problems", pa.list_(_PROBLEM)), ("refs", pa.list_(_REF)), ("writes", pa.list_(pa.string()))])
LONGEST_OPAQUE = 8000
#: How a problem begins that is about names no rule of the reader took; the rest of the statement was read.
UNREAD = "a clause isn't understood:"
#: Bytes of code that one task reads.
PARTITION = 4 << 20


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return f"struct<{', '.join(f'`{f.name}`: {_ddl(f.type)}' for f in kind)}>"
    return {"string": "string", "bool": "boolean", "int32": "int"}[str(kind)]


def _fence(file: str, name: str) -> str:
    return f"#{file.upper().replace('.', '_')}.{name.rsplit('.', 1)[-1]}"


def _as_row(s: Statement, no: int, line: int, sql: str) -> dict:
    return {
        "no": no, "kind": s.kind, "line": line, "line_end": line + sql.count("\n"), "sql": sql, "target": s.target, "temp": s.temp,
        "copied": s.copied, "named_by": "", "as_text": s.as_text, "export_uri": s.export, "star_note": s.star_note, "opaque": s.opaque, "defines": s.defines,
        "sources": list(s.sources), "calls": s.calls, "literals": s.literals, "variables": s.variables, "joins": s.joins, "metadata": s.metadata,
        "uses": [dict(zip(("table", "column", "kind", "alias", "detail", "certain", "via_star", "line"), u)) for u in s.uses if u[0]],
        "flows": [dict(zip(("table", "column", "out", "how", "without", "certain", "star"), f)) for f in s.flows if f[0]],
        "columns": [{"name": n, "type": t} for n, t in s.columns], "mentions": [{"table": t, "column": c} for t, c in s.mentions],
        "shards": [{"table": t, "op": o, "value": v} for t, o, v in s.shards],
    }


_OTHERWISE = re.compile(r"\{%-?\s*(?:else|elif)\b")


def _statements(text: str, offset: int, hint: str) -> Iterator[tuple[int, dict, dict | None]]:
    """(0-based line, row, problem or None) of each statement of a text."""
    filled, holes = fill_placeholders(text)
    for sql, line in split_statements(rescue(unwrap_blocks(filled))):
        at = offset + line
        try:
            s = read_statement(sql, at - (sql[: len(sql) - len(sql.lstrip())].count("\n")), set(holes))
        except Unread as e:
            yield at, _as_row(Statement(kind="UNREAD", opaque=True), 0, at, sql.strip()), {"line": e.line + 1, "message": e.message, "snippet": sql.strip()[:200], "hint": hint}
            continue
        s.export = export_uri(sql)
        problem = None
        if s.unread:
            names_ = ", ".join(dict.fromkeys(n for n, _ in s.unread))
            problem = {"line": s.unread[0][1] + 1, "message": f"{UNREAD} {names_}", "snippet": sql.strip()[:200], "hint": hint}
        yield at, _as_row(s, 0, at, sql.strip()), problem


def _read_block(text: str, offset: int, out: list[dict], problems: list[dict]) -> None:
    """Rows and problems of a block. If it doesn't read as it is, or shows one thing or another, its if-blocks are rendered
    one arm at a time; a statement stays a problem unless what starts on its line reads in some rendering."""
    hint = templating(text)
    found = list(_statements(text, offset, hint))
    if "{%" in text and (_OTHERWISE.search(text) or any(problem for _, _, problem in found)):
        rendered = [x for way in renderings(text) if way != text for x in _statements(way, offset, hint)]
        if any(not problem for _, _, problem in rendered):
            read = {at for at, _, problem in rendered if not problem}
            kept: dict[tuple[int, str], tuple[int, dict, dict | None]] = {}
            for at, row, problem in rendered:
                if not problem or at not in read:
                    kept.setdefault((at, "" if problem else " ".join(row["sql"].split())), (at, row, problem))
            found = [kept[k] for k in sorted(kept)]
    out += [row for _, row, _ in found]
    problems += [problem for _, _, problem in found if problem]


def read_file(file: str, ext: str, text: str) -> dict:
    """All rows of one file."""
    taken = blocks(text, ext)
    rows: list[dict] = []
    problems: list[dict] = []
    for sql, offset in taken:
        _read_block(sql, offset, rows, problems)
    if more_than_taken(text, ext, taken):
        problems.append({"line": 1, "message": "more SQL is written here than could be taken out", "snippet": "", "hint": templating(text)})
    writes = written_tables(text, ext)
    queries = [r for r in rows if r["kind"] == "SELECT" and not r["target"]]
    if ext not in PLAIN:
        for r in queries:
            if len(writes) == 1:
                r["target"], r["named_by"] = canonical([writes[0]]), "program"
            elif writes:
                r["named_by"] = "several"
    elif queries and len(queries) == len(rows) and len({r["line"] for r in rows}) == 1:  # one query, in as many renderings as it has
        stem = re.sub(r"\.[^/]*$", "", file.rsplit("/", 1)[-1])
        for r in queries:
            r["target"], r["named_by"] = stem, "file"
    # temporary tables and script variables are this file's own
    own = {r["target"].rsplit(".", 1)[-1].upper(): _fence(file, r["target"]) for r in rows if r["temp"] and r["target"]}
    variables = {v.upper(): own[VARIABLES.upper()] for r in rows for v in r["variables"]}

    def fenced(name: str) -> str:
        return own.get(name.upper(), name) if "." not in name or name.upper().startswith("_SESSION.") else name

    for no, r in enumerate(rows):
        r["no"] = no
        r["target"] = fenced(r["target"].removeprefix("_SESSION."))
        for part in ("sources", "joins"):
            r[part] = [fenced(s.removeprefix("_SESSION.")) for s in r[part]]
        for part in ("uses", "flows"):
            for u in r[part]:
                u["table"] = fenced(u["table"].removeprefix("_SESSION."))
        if r["kind"] in ("DECLARE", "SET"):
            continue
        for name, table in variables.items():
            if re.search(rf"(?<![\w.@]){re.escape(name)}(?![\w.(])", r["sql"], re.IGNORECASE):
                column = name.lower()
                r["sources"].append(table)
                r["uses"] = [u for u in r["uses"] if u["column"].upper() != name]
                r["uses"].append({"table": table, "column": column, "kind": "filter", "alias": "", "detail": "script variable", "certain": True, "via_star": False, "line": r["line"]})
                r["flows"] = [f for f in r["flows"] if f["column"].upper() != name]
                r["flows"].append({"table": table, "column": column, "out": column, "how": "carried", "without": "", "certain": False, "star": False})
    for r in rows:
        if r["opaque"]:
            r["sql"] = r["sql"][:LONGEST_OPAQUE]
    refs = [{"ref": ref, "line": line} for ref, line in sql_files(text, ext)]
    return {"file": file, "statements": rows, "problems": problems, "refs": refs, "writes": writes}


def by_file(problems: DataFrame) -> DataFrame:
    """(file, line, message, snippet, hint, places): one entry for each file, its first problem, with how many there are."""
    first = F.min_by(F.struct("line", "message", "snippet", "hint"), F.struct("line", "message"))
    return problems.groupBy("file").agg(first.alias("x"), F.count("*").alias("places")).select("file", "x.*", "places")


@dataclass(frozen=True)
class Tables:
    files: DataFrame
    unread: DataFrame
    statements: DataFrame
    uses: DataFrame
    flows: DataFrame
    columns: DataFrame
    mentions: DataFrame
    shards: DataFrame
    problems: DataFrame
    refs: DataFrame
    calls: DataFrame

    def problems_by_file(self) -> DataFrame:
        return by_file(self.problems)


def read_tables(tree: Tree, partitions: int | None = None) -> Tables:
    """Read every file of a tree once, and settle what it gave."""
    spark = tree.files.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            rows = [read_file(f, e, t) for f, e, t in zip(b["file"].to_pylist(), b["ext"].to_pylist(), b["text"].to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, _OUT)

    schema = ", ".join(f"{f.name} {_ddl(f.type)}" for f in _OUT)
    files = settle(tree.files)
    size = files.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    large = size > PARTITION
    files = unsent(files, large)
    if not partitions:
        partitions = max(spark.sparkContext.defaultParallelism, size // PARTITION + 1)
    spread = files.select("file", "ext", "text").repartition(partitions)
    parsed = unsent(settle(spread.mapInArrow(run, schema)), large)
    flat = parsed.select("file", F.explode("statements").alias("s")).select(F.concat_ws("#", "file", "s.no").alias("stmt"), "file", "s.*")

    def exploded(what: str, *keep: str) -> DataFrame:
        return flat.select("stmt", "file", *keep, F.explode(what).alias("x")).select("stmt", "file", *keep, "x.*")

    def keyed(df: DataFrame, column: str, prefix: str) -> DataFrame:
        t = F.col(column)
        return df.withColumns({f"{prefix}_short": names.short(t), f"{prefix}_ds": F.when(names.is_fenced(t), F.upper(t)).otherwise(names.dataset(t))})

    shards = exploded("shards")
    told = settle(shards.groupBy("stmt", "table").agg(F.collect_list(F.struct("op", "value")).alias("conditions")))
    some = not told.isEmpty()

    def pruned(df: DataFrame) -> DataFrame:
        """With the literal conditions on the shards that a statement reads, for wildcard tables."""
        if some:
            return df.join(told, ["stmt", "table"], "left").select(*df.columns, "conditions")
        return df.withColumn("conditions", F.lit(None).cast(told.schema["conditions"].dataType))

    statements = keyed(flat.drop("uses", "flows", "columns", "mentions", "shards"), "target", "t")
    flows = exploded("flows", F.col("target"), F.col("temp"), F.col("copied")).where("target <> ''")
    return Tables(
        files=files, unread=tree.unread, statements=statements,
        uses=pruned(keyed(exploded("uses"), "table", "s")),
        flows=pruned(keyed(keyed(flows, "table", "s"), "target", "t")),
        columns=exploded("columns", F.col("target"), F.col("kind")).where("target <> ''"),
        mentions=exploded("mentions"), shards=shards,
        problems=parsed.select("file", F.explode("problems").alias("x")).select("file", "x.*"),
        refs=parsed.select("file", F.explode("refs").alias("x")).select("file", "x.*"),
        calls=flat.select("file", F.explode("calls").alias("called")).unionByName(flat.where("defines <> ''").select("file", F.concat(F.lit("="), "defines").alias("called"))),
    )
