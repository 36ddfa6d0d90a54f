"""Text of notices and pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell the kind of change, asked in this order.
CHANGE_WORDS = {
    "removal": ("decommission", "removed", "removal", "dropped", "retire", "sunset", "deleted", "deletion"),
    "rename": ("renamed", "rename", "renaming"),
    "value_change": ("format", "value", "iso", "full country"),
    "type_change": ("data type", "datatype", "length", "precision", "varchar", "widened"),
}
#: The first letters of the months' names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Phrases that say a whole table changes.
WHOLE = ("whole table", "entire table", "the table itself", "all columns", "all attributes", "every column", "all of its columns", "table as a whole", "table-level", "table level")
#: What is done to a table, as it is said of it, as someone does it, and as a thing.
DONE = ("dropped", "removed", "decommission", "decommissioned", "retired", "renamed", "migrated", "moved", "deprecated", "deleted", "replaced", "sunset", "rebuilt", "discontinued", "archived")
DOING = ("dropping", "removing", "decommissioning", "retiring", "renaming", "migrating", "moving", "deprecating", "deleting", "replacing", "sunsetting", "rebuilding", "discontinuing", "archiving")
DEED = ("decommission", "decommissioning", "removal", "retirement", "deletion", "migration", "deprecation", "rename", "renaming", "replacement", "sunset")
#: Words that may stand between a table's name and what is done to it.
_HELPING = ("will", "shall", "is", "are", "be", "being", "getting", "gets", "to")
_POINTING = ("the", "of", "table")
#: Tags that end a line of text, and those that end a cell.
_LINE_TAGS = ("br", "/p", "/div", "/tr", "/li", "/h1", "/h2", "/h3", "/h4", "/h5", "/h6", "/table", "/ul", "/ol")
_CELL_TAGS = ("/td", "/th")
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and styles go, breaks and block ends become lines, cells tabs; entities are read."""
    seen = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")

    def shown(part: Column, k: Column) -> Column:  # what stands from one < to the next
        close = F.locate(">", part)
        tag = F.regexp_extract(F.lower(part), r"^(/?[a-z]+[1-6]?)", 1)
        mark = F.when(tag.isin(*_LINE_TAGS), "\n").when(tag.isin(*_CELL_TAGS), "\t").otherwise("")
        return F.when(k == 0, part).when(close < 2, F.concat(F.lit("<"), part)).otherwise(F.concat(mark, F.substr(part, close + 1)))

    out = F.array_join(F.transform(F.split(seen, "<", -1), shown), "")
    for entity, character in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def _words(text: Column, marks: str = "") -> Column:
    """The words of a text in small letters; ``marks`` count as letters inside a word."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{marks}]+", " ")
    return F.split(F.trim(F.regexp_replace(spaced, rf"(?<![\p{{L}}\p{{N}}_])[{marks}]+|[{marks}]+(?![\p{{L}}\p{{N}}_])", " ") if marks else spaced), " +")


def _dated(year: Column, month: Column, day: Column) -> Column:
    at = F.try_make_timestamp(year.try_cast("int"), month.cast("int"), day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0.0))
    return F.date_format(at, "yyyy-MM-dd")


def parse_date(text: Column, year: int | None = None) -> Column:
    """The first date as ISO text: 2026-09-18, then 18 September 2026, then September 18, 2026 (or of ``year``); empty for none."""
    plain = F.filter(_words(text, "\\-"), lambda w: F.length(w) == 10)
    digits = F.transform(plain, lambda w: F.split(w, "-"))
    iso = F.filter(digits, lambda p: (F.size(p) == 3) & (F.length(p[0]) == 4) & (F.length(p[1]) == 2) & (F.length(p[2]) == 2) & p[0].try_cast("int").isNotNull())
    words = _words(text)
    months = F.array(*map(F.lit, MONTHS))

    def number(w: Column, most: int) -> Column:
        return F.when((F.length(w) <= most) & F.translate(w, "0123456789", "").eqNullSafe(""), w.try_cast("int"))

    # (month, the number before, the two numbers after) of each word that names a month
    at = F.transform(words, lambda w, k: F.struct(
        F.array_position(months, F.substring(w, 1, 3)).alias("month"), F.when(k > 0, number(F.get(words, k - 1), 2)).alias("before"),
        number(F.get(words, k + 1), 2).alias("after"), F.when(F.length(F.get(words, k + 1)) == 4, number(F.get(words, k + 1), 4)).alias("year"), F.when(F.length(F.get(words, k + 2)) == 4, number(F.get(words, k + 2), 4)).alias("later"),
    ))
    named = F.filter(at, lambda x: x["month"] > 0)
    first = F.get(F.filter(named, lambda x: x["before"].isNotNull() & x["year"].isNotNull()), F.lit(0))
    second = F.get(F.filter(named, lambda x: x["after"].isNotNull()), F.lit(0))
    own = F.coalesce(second["later"], F.lit(year) if year else F.year(F.current_date()))
    one = F.get(iso, F.lit(0))
    return F.coalesce(_dated(one[0], one[1].try_cast("int"), one[2]), _dated(first["year"], first["month"], first["before"]), _dated(own, second["month"], second["after"]), F.lit(""))


def days_until(iso: Column, today: Column | None = None) -> Column:
    return F.datediff(iso.try_cast("date"), today if today is not None else F.current_date())


def change_kind(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = None
    for kind, words in CHANGE_WORDS.items():
        hit = None
        for w in words:
            hit = low.contains(w) if hit is None else hit | low.contains(w)
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    return found.otherwise("unknown")


def first_sentence(text: Column, most: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.regexp_extract(flat, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.substring(F.when(cut != "", cut).otherwise(flat), 1, most)


def whole_table(text: Column, table: Column) -> Column:
    """Whether the text says that the table itself changes, not one of its columns.

    Either a phrase says so, or of the words about the table's name the nearest that
    neither helps nor points says what is done to it.
    """
    words = _words(text, ".\\-")
    name = F.lower(table)
    flat = F.array_join(_words(text, "\\-"), " ")
    said = F.exists(F.array(*map(F.lit, WHOLE)), lambda phrase: F.concat(F.lit(" "), flat, F.lit(" ")).contains(phrase))

    def told(k: Column) -> Column:
        after = F.filter(F.slice(words, k + 2, 5), lambda w: w != "table")
        deed = F.get(F.filter(after, lambda w: ~w.isin(*_HELPING)), F.lit(0))
        helped = F.get(after, F.lit(0)).isin(*_HELPING)
        before = F.reverse(F.slice(words, F.greatest(k - 4, F.lit(0)) + 1, F.least(k, F.lit(4))))
        doing = F.get(F.filter(before, lambda w: ~w.isin(*_POINTING)), F.lit(0))
        of = F.array_contains(F.slice(before, 1, F.greatest(F.array_position(before, doing).cast("int") - 1, F.lit(0))), "of")
        return helped & deed.isin(*DONE) | doing.isin(*DOING) | doing.isin(*DEED) & of

    own = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: F.element_at(F.split(F.get(words, k), r"\."), -1) == F.element_at(F.split(name, r"\."), -1))
    return said | F.exists(own, lambda k: F.coalesce(told(k), F.lit(False)))


def template_kind(text: Column) -> Column:
    """The kinds of templating in a text."""
    return F.concat_ws(", ", *(F.when(text.contains(mark), what) for mark, what in (("{%", "control tags"), ("{{", "expressions"), ("${", "shell variables"), ("{#", "template comments"))))
