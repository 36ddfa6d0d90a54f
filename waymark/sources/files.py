"""Reading a tree of code: which files are opened, how they are decoded, and what was left out and why.

The tree, or an archive of it, is one scan of binary files; everything about a path is a
column expression, and only the bytes go through Arrow to be decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.shared import slices
from waymark.sources.archives import members

#: Extensions that are opened, those known to hold no code, folders passed by, template endings.
CODE_EXTENSIONS = (".sql", ".sqlx", ".ddl", ".hql", ".py", ".scala", ".java", ".sh", ".xml", ".yaml", ".yml")
NOT_CODE = (
    ".md", ".markdown", ".rst", ".txt", ".adoc", ".pdf", ".doc", ".docx", ".odt", ".rtf", ".tex", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".bmp", ".tif", ".tiff", ".psd",
    ".css", ".scss", ".sass", ".less", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".map", ".csv", ".tsv", ".parquet", ".avro", ".orc", ".xlsx", ".xls", ".pb", ".zip", ".gz", ".tgz", ".tar",
    ".bz2", ".xz", ".7z", ".rar", ".jar", ".war", ".whl", ".egg", ".so", ".dll", ".dylib", ".exe", ".bin", ".pyc", ".pyo", ".class", ".o", ".a", ".lib", ".pdb", ".mp3", ".mp4", ".mov", ".avi",
    ".wav", ".webm", ".flac", ".ogg", ".lock", ".log", ".bak", ".swp", ".ds_store",
)
SKIPPED_FOLDERS = (".git", ".venv", "venv", "node_modules", "__pycache__", "target", "build", "dist")
TEMPLATE_ENDINGS = (".j2", ".jinja", ".jinja2", ".tmpl", ".template", ".tpl", ".mustache", ".hbs", ".erb")
MOST_BYTES = 2_000_000


def extension(path: Column) -> Column:
    """The extension that counts: a template ending is taken off first, others aren't."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    bare = F.regexp_replace(name, "(" + "|".join(re.escape(e) for e in TEMPLATE_ENDINGS) + ")$", "")
    return F.regexp_extract(F.when(bare.contains("."), bare).otherwise(name), r"(\.[^.]+)$", 1)


def decode(raw: bytes) -> str | None:
    """Text of a file; None if it isn't text. Byte-order marks first (the longest ones before those they begin with), then UTF-16 by its zeros, UTF-8, Latin-1."""
    for mark, name in ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                return None
    head = raw[:4096]
    if head.count(0) > len(head) / 10:
        even, odd = head[::2].count(0), head[1::2].count(0)
        try:
            return raw.decode("utf-16-be" if even > odd else "utf-16-le") if max(even, odd) > 4 * min(even, odd) else None
        except UnicodeDecodeError:
            return None
    if 0 in raw:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@dataclass(frozen=True)
class Tree:
    """files (file, ext, text, n_lines) that were read, and unread (file, ext, kind, reason)."""

    files: DataFrame
    unread: DataFrame


def _classified(raw: DataFrame) -> Tree:
    """From (file, length, content): what is read, and everything that isn't, by kind."""
    folders = F.split("file", "/")
    passed = F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    ext = extension(F.col("file"))
    kind = (
        F.when(passed & ext.isin(*CODE_EXTENSIONS), "skipped_folder")
        .when(passed, "ignored")
        .when(~ext.isin(*CODE_EXTENSIONS), F.when((ext == "") | ext.isin(*NOT_CODE), "not_code").otherwise("unknown_type"))
        .when(F.col("length") > MOST_BYTES, "too_long")
    )
    told = raw.withColumn("ext", ext).withColumn("kind", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            yield pa.RecordBatch.from_arrays([b["file"], b["ext"], pa.array([decode(x or b"") for x in b["content"].to_pylist()], pa.string())], ["file", "ext", "text"])

    read = told.where("kind is null").select("file", "ext", "content").mapInArrow(run, "file string, ext string, text string")
    files = read.where("text is not null").withColumn("n_lines", F.size(F.split("text", "\n", -1)))
    reasons = F.create_map(*[
        F.lit(x) for pair in {
            "skipped_folder": "stands in a folder that is passed by", "ignored": "stands in a folder that is passed by and is no code",
            "not_code": "is no code", "unknown_type": "is of a type that isn't opened", "too_long": "is too long to be opened",
        }.items() for x in pair
    ])
    unread = told.where("kind is not null").select("file", "ext", "kind", reasons[F.col("kind")].alias("reason"))
    binary = read.where("text is null").select("file", "ext", F.lit("not_text").alias("kind"), F.lit("can't be read as text").alias("reason"))
    return Tree(files, unread.unionByName(binary))


def read_tree(spark: SparkSession, root: str) -> Tree:
    """A folder of code. Paths are taken relative to it before folders are judged."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "file:" + root.rstrip("/") if root.startswith("/") else root.rstrip("/")
    plain = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    relative = F.expr(f"substring({'plain'}, length(base) + 2)")
    named = raw.withColumn("plain", plain).withColumn("base", F.lit(re.sub("^file:/+", "file:/", base)))
    content = F.when(F.col("length") <= MOST_BYTES, F.col("content"))
    return _classified(named.select(relative.alias("file"), "length", content.alias("content")))


def read_archive(spark: SparkSession, path: str) -> Tree:
    """A tar, packed or not, of a tree (as code hosts make them, with one top folder), or a folder of such, by the same rules."""
    rows = members(spark, path, MOST_BYTES)
    below = F.regexp_extract("name", "^[^/]*/(.+)$", 1)
    return _classified(rows.select(F.when(below != "", below).otherwise(F.col("name")).alias("file"), "length", "content"))


def from_contents(rows: DataFrame, root: str = "") -> Tree:
    """A tree given as (path, length, content) rows, paths relative to ``root``, by the same rules as a folder."""
    base = re.sub("^file:/+", "/", root).rstrip("/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    relative = F.when(F.startswith(plain, F.lit(base + "/")), F.substring(plain, len(base) + 2, 1 << 20)).otherwise(plain) if base else plain
    return _classified(rows.select(relative.alias("file"), "length", "content"))


def from_rows(rows: DataFrame) -> Tree:
    """A tree given as (file, text) rows."""
    raw = rows.select("file", F.octet_length("text").cast("bigint").alias("length"), F.encode("text", "UTF-8").alias("content"))
    return _classified(raw)


def archive_commit(name: str) -> str:
    """The commit in the name of an archive's top folder, or nothing."""
    m = re.search(r"-([0-9a-f]{7,40})/?$", name)
    return m[1] if m else ""


def repository(text: str) -> tuple[str, str, str]:
    """(owner, name, branch) from owner/name, an address, with or without .git or /tree/branch."""
    m = re.match(r"^(?:(?:https?://|git@)[^/:]+[/:])?([\w.\-]+)/([\w.\-]+?)(?:\.git)?(?:/tree/([\w.\-/]+))?/?$", text.strip())
    if not m:
        raise ValueError(f"not a repository: {text!r}")
    return m[1], m[2], m[3] or ""


def git_branch(root: str) -> str:
    """The branch that a checkout on the driver's disk is on, or nothing."""
    try:
        with open(f"{root}/.git/HEAD", encoding="utf-8") as f:
            head = f.read().strip()
    except OSError:
        return ""
    return head.removeprefix("ref: refs/heads/") if head.startswith("ref:") else ""
