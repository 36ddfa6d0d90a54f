"""Taking SQL out of programs, scripts and markup. Each block has the 0-based line it starts on.

A file is read once, from left to right, into words, marks and quoted strings; what a
string is for is told by the words and marks before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from waymark.functions.sqltext import unescape_xml

PLAIN = {".sql", ".sqlx", ".ddl", ".hql"}
PROGRAMS = {".py", ".scala", ".java", ".sh"}
MARKUP = {".xml", ".yaml", ".yml"}

#: The words a statement starts with, each with the words of which one must follow (none: no matter which).
HEADS = {"SELECT": (), "INSERT": ("INTO", "OVERWRITE"), "MERGE": ("INTO",), "DELETE": ("FROM",), "TRUNCATE": ("TABLE",)}
#: What CREATE makes, and the words that may stand between.
MADE = {"TABLE", "VIEW", "FUNCTION"}
BETWEEN = {"TEMP", "TEMPORARY", "MATERIALIZED", "EXTERNAL", "SNAPSHOT"}
#: The words a block that is SQL opens with.
OPENERS = {"SELECT", "WITH", "INSERT", "MERGE", "UPDATE", "DELETE", "CREATE", "TRUNCATE", "DECLARE", "BEGIN"}
#: Keys and elements that hold SQL have one of these in their name.
HOLDERS = ("sql", "query", "statement", "script", "command")
#: Programs that take a query as an argument.
CLIENTS = ("bq query", "psql", "spark-sql", "beeline", "hive", "impala-shell", "clickhouse-client", "athena", "snowsql", "mysql", "sqlcmd", "duckdb", "presto", "trino")
#: Calls, and names of settings, that say where a program writes.
WRITERS = {"saveastable", "insertinto", "createorreplacetempview", "registertemptable", "to_gbq"}
DESTINATIONS = {"destination", "destination_table"}
#: Endings that templates add to a file's name.
TEMPLATES = {"j2", "jinja", "jinja2", "tmpl", "template", "tpl", "mustache", "hbs", "erb"}
#: A single string shorter than this is a fragment or a label.
SHORTEST = 40

Block = tuple[str, int]
_WORD = re.compile(r"[A-Za-z_][\w.\-]*|\S")


def statements_begun(sql: str) -> int:
    """How many statements begin in a text."""
    words = [w.upper() for w in _WORD.findall(sql.replace("`", ""))]
    n = 0
    for k, w in enumerate(words):
        after = words[k + 1 : k + 4]
        if w in HEADS:
            n += not HEADS[w] or after[:1] != [] and after[0] in HEADS[w]
        elif w == "UPDATE":
            n += after[1:2] == ["SET"]
        elif w == "CREATE":
            rest = [x for x in after if x not in BETWEEN]
            n += rest[:2] == ["OR", "REPLACE"] or rest[:1] != [] and rest[0] in MADE
    return n


def opens(text: str) -> bool:
    """Whether a text, after comments to the line's end, opens with a word of SQL."""
    for line in text.split("\n"):
        line = line.strip()
        if line and not line.startswith("--"):
            first = re.match(r"\w+", line)
            return bool(first) and first[0].upper() in OPENERS
    return False


def is_sql(text: str) -> bool:
    return opens(text) and statements_begun(text) > 0


@dataclass(frozen=True)
class Piece:
    """A quoted string (quote is its mark), or the code between two of them (quote is empty)."""

    text: str
    start: int
    end: int
    quote: str = ""

    @property
    def inside(self) -> int:
        return self.start + len(self.quote)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at)


def scan(text: str, ext: str) -> list[Piece]:
    """Code and strings in turn. Strings of one mark end with their line; comments are code without their text."""
    notes = {".py": ("#",), ".sh": ("#",), ".java": ("//",), ".scala": ("//",)}.get(ext, ())
    out: list[Piece] = []
    code: list[str] = []
    at = begun = 0
    while at < len(text):
        c = text[at]
        note = next((n for n in notes if text.startswith(n, at)), None)
        if note and (at == 0 or text[at - 1].isspace()):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            code.append(" " * (stop - at))
            at = stop
            continue
        if c not in "'\"":
            code.append(c)
            at += 1
            continue
        mark = c * 3 if text.startswith(c * 3, at) else c
        stop = at + len(mark)
        while stop < len(text) and not text.startswith(mark, stop) and (len(mark) == 3 or text[stop] != "\n"):
            stop += 2 if text[stop] == "\\" else 1
        if not text.startswith(mark, stop):  # an apostrophe
            code.append(c)
            at += 1
            continue
        out.append(Piece("".join(code), begun, at))
        out.append(Piece(text[at + len(mark) : stop], at, stop + len(mark), mark))
        code, at = [], stop + len(mark)
        begun = at
    return [*out, Piece("".join(code), begun, len(text))]


_PREFIX = re.compile(r"(?<!\w)[fFrRbBuU]{1,2}$")


def _glue(between: str) -> str | None:
    """What joins two strings: '' if nothing but space, plus and a prefix; the name, if they are added to one; None if they aren't one."""
    code = _PREFIX.sub("", between.replace("\\", " "))
    words = re.findall(r"\w+|\+=|\S", code)
    if all(w == "+" for w in words):
        return ""
    core = [w for w in words if w not in "()"]
    return core[0] if len(core) == 2 and core[1] == "+=" and "\n" in code else None


def _assigned(before: str) -> str:
    """The name that the string after this code is given to, or nothing."""
    words = re.findall(r"\w+|\+=|\S", _PREFIX.sub("", before))
    while words and words[-1] == "(":
        words.pop()
    return words[-2] if len(words) > 1 and words[-1] in ("=", "+=") else ""


def program_blocks(text: str, ext: str = ".py") -> list[Block]:
    pieces = scan(text, ext)
    out: list[Block] = []
    group: list[Piece] = []
    name = ""

    def close() -> None:
        if not group:
            return
        body, at = [], group[0].start
        for p in group:  # lines stay where they are
            body.append("\n" * text.count("\n", at, p.start) + p.text)
            at = p.end
        whole = "".join(body)
        if (len(group) > 1 or len(group[0].quote) == 3 or len(whole) >= SHORTEST) and is_sql(whole):
            out.append((whole, _line(text, group[0].inside)))
        group.clear()

    for before, string in zip(pieces[::2], pieces[1::2]):
        glue = _glue(before.text) if group else None
        if glue is None or len(string.quote) == 3 or len(group[0].quote) == 3 or glue and glue != name:
            close()
            name = _assigned(before.text)
        group.append(string)
    close()
    return out


def _heredocs(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, first line, line of the end mark) of each heredoc, lines counted from 0."""
    lines = text.split("\n")
    k = 0
    while k < len(lines):
        head, arrow, tail = lines[k].partition("<<")
        mark = re.match(r"-?\s*[\"']?(\w+)", tail) if arrow else None
        end = next((j for j in range(k + 1, len(lines)) if lines[j].strip() == mark[1]), None) if mark else None
        if end is None:
            k += 1
            continue
        yield k, k + 1, end
        k = end + 1


def _argument(text: str, at: int) -> tuple[str, int] | None:
    """The first quoted argument of the command that goes on at ``at``, with its place; a line that ends in a backslash goes on."""
    while at < len(text):
        c = text[at]
        if text.startswith("\\\n", at):
            at += 2
        elif c == "\n":
            return None
        elif c in "'\"":
            stop = at + 1
            while stop < len(text) and text[stop] != c:
                stop += 2 if c == '"' and text[stop] == "\\" else 1
            return (text[at + 1 : stop], at + 1) if stop < len(text) else None
        else:
            at += 1
    return None


def shell_blocks(text: str) -> list[Block]:
    lines = text.split("\n")
    taken: list[tuple[int, int]] = []
    out: list[Block] = []
    for head, first, end in _heredocs(text):
        taken.append((head, end))
        body = "\n".join(lines[first:end])
        if statements_begun(body):
            out.append((body, first))
    free = lambda line: all(not a < line <= b for a, b in taken)
    told: set[int] = set()
    names = "|".join(re.escape(c).replace(r"\ ", r"\s+") for c in CLIENTS)
    for m in re.finditer(rf"(?<![\w-])(?:{names})(?![\w-])", text):
        found = _argument(text, m.end())
        if found and statements_begun(found[0]) and free(_line(text, found[1])) and _line(text, found[1]) not in told:
            told.add(_line(text, found[1]))
            out.append((found[0].replace('\\"', '"').replace("\\`", "`"), _line(text, found[1])))
    out += [(body, line) for body, line in program_blocks(text, ".sh") if line not in told and free(line)]
    return sorted(out, key=lambda x: x[1])


def _holds(name: str) -> bool:
    return any(h in name.lower() for h in HOLDERS)


def yaml_blocks(text: str) -> list[Block]:
    """Values of keys that hold SQL: blocks after | or >, quoted or plain ones."""
    out: list[Block] = []
    lines = text.split("\n")
    width = lambda s: len(s) - len(s.lstrip())
    for k, line in enumerate(lines):
        key, colon, rest = line.partition(":")
        listed = key.lstrip().startswith("- ")
        own = width(key) + (2 if listed else 0)
        key, rest = key.strip().removeprefix("- ").strip().strip("\"'"), rest.strip()
        if not colon or not re.fullmatch(r"[\w.\-]+", key) or not _holds(key):
            continue
        if rest[:1] in ("|", ">"):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip() and width(lines[j]) <= (width(line) if listed else own)), len(lines))
            value, at = "\n".join(lines[k + 1 : end]), k + 1
        elif rest[:1] in ("'", '"') and rest:
            whole = "\n".join([rest[1:], *lines[k + 1 :]])
            stop = 0
            while stop < len(whole) and whole[stop] != rest[0]:
                stop += 2 if whole[stop] == "\\" else 1
            value, at = whole[:stop], k
        else:
            value, at = rest, k
        if is_sql(value):
            out.append((value, at))
    return out


def xml_blocks(text: str) -> list[Block]:
    """Contents of elements that hold SQL, outermost first."""
    out: list[Block] = []
    at = 0
    for m in re.finditer(r"<([\w:.\-]+)[^<>]*(?<!/)>", text):
        if m.start() < at or not _holds(m[1]):
            continue
        end = re.compile(rf"</\s*{re.escape(m[1])}\s*>", re.IGNORECASE).search(text, m.end())
        if not end:
            continue
        body = text[m.end() : end.start()]
        if statements_begun(body):
            out.append((unescape_xml(body), _line(text, m.end())))
            at = end.end()
    return out


def blocks(text: str, ext: str) -> list[Block]:
    """The SQL in a file."""
    if ext in PLAIN or ext in MARKUP and opens(text):
        return [(text, 0)]
    if ext == ".xml":
        return xml_blocks(text)
    if ext in MARKUP:
        return yaml_blocks(text)
    if ext == ".sh":
        return shell_blocks(text)
    return program_blocks(text, ext) if ext in PROGRAMS else []


def more_than_taken(text: str, ext: str, taken: list[Block]) -> bool:
    """Whether more statements begin in the file than in the blocks taken from it."""
    return ext not in PLAIN and statements_begun(text) > sum(statements_begun(b) for b, _ in taken)


def _names_sql(word: str) -> bool:
    """Whether a word is the path of a .sql file, a template's or not."""
    parts = word.replace("\\", "/").rsplit("/", 1)[-1].lower().split(".")
    if len(parts) > 2 and parts[-1] in TEMPLATES:
        parts.pop()
    return len(parts) > 1 and parts[-1] == "sql" and bool(re.search(r"[\w\-]$", parts[-2]))


def sql_files(text: str, ext: str) -> list[tuple[str, int]]:
    """(.sql file named, 1-based line), the first time each is named: strings in programs, values in markup."""
    words: list[tuple[str, int]] = []
    if ext in PROGRAMS:
        words = [(p.text, p.start) for p in scan(text, ext) if p.quote]
    elif ext in MARKUP:
        words = [(m[0].rstrip(",;)]}"), m.start()) for m in re.finditer(r"(?<![^\s\"'<>:=])[^\s\"'<>:=]+", text) if re.search(r"[:>=\"'][ \t]*$", text[max(0, m.start() - 80) : m.start()])]
    found: dict[str, tuple[str, int]] = {}
    for word, at in words:
        if "\n" not in word and _names_sql(word):
            found.setdefault(word.lower(), (word, _line(text, at) + 1))
    return list(found.values())


def written_tables(text: str, ext: str) -> list[str]:
    """Tables that a program writes to, in order, by their own name."""
    if ext not in PROGRAMS:
        return []
    pieces = scan(text, ext)
    names: list[tuple[int, str]] = []
    keys: list[str] = []
    for before, string in zip(pieces[::2], pieces[1::2]):
        words = re.findall(r"\w+|\S", _PREFIX.sub("", before.text).lower())
        if "}" in words:
            keys.clear()
        last, mark = (words[-2:] if len(words) > 1 else ["", *words, ""])[:2]
        if mark == "(" and last in WRITERS or mark == "=" and last in DESTINATIONS:
            names.append((string.start, string.text))
        elif mark == ":" and keys[-1:] == ["tableid"] and "destinationtable" in keys:
            names.append((string.start, string.text))
        keys.append(string.text.strip().lower())
    for m in re.finditer(r"(?<!\w)(\w+)=([\w\-]+[.:][\w.:\-]+)", text):  # bare, as on a command line
        if m[1].lower() in DESTINATIONS:
            names.append((m.start(2), m[2]))
    own = [re.split(r"[.:]", name)[-1] for _, name in sorted(names) if re.fullmatch(r"[\w.:\-]+", name)]
    return list(dict.fromkeys(own))
