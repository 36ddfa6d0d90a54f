"""Change notices: mail files and pasted text, and what they ask about."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import names, text

SCHEMA = "subject string, body string, from_name string, from_email string, sent string, attachments array<string>, source_kind string"
_HEADER = re.compile(r"^[>\s]*(From|Sent|Date|To|Cc|Subject)\s*:\s*(.*)$", re.IGNORECASE)
_TEAM = re.compile(r"\b(team|support|platform|data|group|desk|office|department|services?|operations|engineering|no-?reply)\b", re.IGNORECASE)
_FORWARD = re.compile(r"^-{2,}\s*(Original|Forwarded) Message\s*-{2,}|^Begin forwarded message:", re.IGNORECASE | re.MULTILINE)
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+")


def read_mail(raw: bytes) -> dict:
    """A .eml file: plain text first, else HTML as it is; attachments by name."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    plain, html, files = "", "", []
    for part in m.walk():
        if part.get_filename():
            files.append(part.get_filename())
        elif part.get_content_type() == "text/plain" and not plain:
            plain = part.get_content()
        elif part.get_content_type() == "text/html" and not html:
            html = part.get_content()
    name, address = email.utils.parseaddr(str(m["From"] or ""))
    sent = email.utils.parsedate_to_datetime(str(m["Date"])).date().isoformat() if m["Date"] else ""
    return {"subject": str(m["Subject"] or ""), "body": plain or html, "from_name": name, "from_email": address, "sent": sent, "attachments": files, "source_kind": "eml" if plain or not html else "eml-html"}


def read_pasted(pasted: str) -> dict:
    """Text as copied from a mail program: header lines at the top are taken off."""
    head: dict[str, str] = {}
    lines = pasted.replace("\r", "").split("\n")
    at = 0
    while at < len(lines) and (not lines[at].strip() or _HEADER.match(lines[at])):
        if m := _HEADER.match(lines[at]):
            head.setdefault(m[1].lower(), m[2].strip())
        at += 1
        if head and at < len(lines) and not lines[at].strip():
            break
    name, address = email.utils.parseaddr(head.get("from", ""))
    return {"subject": head.get("subject", ""), "body": "\n".join(lines[at:]).strip(), "from_name": name, "from_email": address, "sent": head.get("sent", head.get("date", "")), "attachments": [], "source_kind": "pasted"}


def read_upload(name: str, raw: bytes) -> dict:
    """A mail file by its ending, anything else as pasted text."""
    return read_mail(raw) if name.lower().endswith(".eml") else read_pasted(raw.decode("utf-8", errors="replace"))


def signature(body: str) -> tuple[str, str]:
    """(person, team) who sign a text, from its last eight lines, the lowest first."""
    lines = [x.strip(" ,;-–*\t") for x in _FORWARD.split(body)[0].strip().split("\n") if x.strip()]
    person = team = ""
    for x in reversed(lines[-8:]):
        if re.match(r"(?i)(kind |best |many )?(regards|thanks|thank you|cheers|sincerely)\b", x):
            break
        if len(x) > 60 or _ADDRESS.search(x) or re.search(r"[.!?:]$|https?:|\d{4,}", x):
            continue
        if _TEAM.search(x):
            team = team or x
        elif re.fullmatch(r"[^\W\d_][\w'’.-]*(?: [^\W\d_][\w'’.-]*){1,3}", x) and x.istitle():
            person = x
    return person, team


def enrich(notice: dict) -> dict:
    """Fills in who sent a notice: its envelope, then a forwarded header, then how it is signed."""
    out = dict(notice)
    body = out["body"] or ""
    forwarded = _FORWARD.search(body)
    if forwarded:
        inner = read_pasted(body[forwarded.end() :])
        for k in ("from_name", "from_email", "sent"):
            out[k] = inner[k] or out[k]
        out["subject"] = out["subject"] or inner["subject"]
    person, team = signature(body)
    out["from_name"] = out["from_name"] or person
    out["team"] = team or (out["from_name"] if _TEAM.search(out["from_name"] or "") else "")
    domain = (out["from_email"] or "").rpartition("@")[2]
    out["source_system"] = out["team"] or domain.split(".")[0]
    return out


def read_mails(spark: SparkSession, path: str) -> DataFrame:
    """(file, ...) of every .eml file under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"file": p, **enrich(read_mail(c))} for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist())]
            kinds = [("file", pa.string()), *((c.split()[0], pa.list_(pa.string()) if "array" in c else pa.string()) for c in SCHEMA.split(", ")), ("team", pa.string()), ("source_system", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True).load(path)
    return raw.select("path", "content").mapInArrow(run, f"file string, {SCHEMA}, team string, source_system string")


def extract(notices: DataFrame, catalog: DataFrame) -> DataFrame:
    """file, change, effective, summary, asks (table, columns, whole): what each notice is about, by the tables and columns there are.

    ``notices`` has file, subject and body. Words are looked up among table names first,
    then among the columns of the tables found, so a column of another table isn't taken.
    """
    both = F.concat_ws("\n", "subject", F.when(F.col("body").rlike("(?i)<(html|table|p|div)[ >]"), text.strip_html(F.col("body"))).otherwise(F.col("body")))
    told = notices.select("file", both.alias("text"))
    words = told.select("file", "text", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z][A-Za-z0-9_]*)\b"), F.lit(1)), F.upper))).alias("word"))
    tables = catalog.groupBy("key").agg(F.min("table").alias("table"))
    named = words.join(tables, words["word"] == tables["key"]).select("file", "text", "key", "table")
    columns = catalog.select("key", F.upper("column").alias("word"), "column").distinct()
    hits = named.join(columns, "key").join(words.select("file", "word"), ["file", "word"]).groupBy("file", "key").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    none = F.array().cast("array<string>")
    asks = named.join(hits, ["file", "key"], "left").select(
        "file", F.struct("table", F.coalesce("columns", none).alias("columns"), (text.whole_table(F.col("text"), names.short(F.col("table"))) | F.col("columns").isNull()).alias("whole")).alias("ask")
    )
    grouped = asks.groupBy("file").agg(F.array_sort(F.collect_set("ask")).alias("asks"))
    out = told.join(grouped, "file", "left")
    return out.select(
        "file", text.change_kind(F.col("text")).alias("change"), text.parse_date(F.col("text")).alias("effective"),
        text.first_sentence(F.col("text")).alias("summary"), F.coalesce("asks", F.array().cast("array<struct<table: string, columns: array<string>, whole: boolean>>")).alias("asks"),
    )
