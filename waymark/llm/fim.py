"""Fill-in-middle: documents cut at two lines and put together again in another order.

A text is a rope: a balanced tree whose leaves hold pieces of it and whose nodes cache how
many line ends and code points lie below them. The tree is split at two unit ranks, in as
many steps as it is deep, and the three trees are joined in their new order with marks
between; the way back makes a rope of what was written, splits it at the marks' places and
joins the parts as they were. Nothing but the form is needed for it, because a text that
holds a mark already is left plain.

The places are the smaller and the larger of two hashes of seed and doc_id, so a document
is cut alike whenever a task runs again, and no row needs any other.

Nulls: a null text is empty, and an empty text is plain; a null doc_id is hashed as the
empty string. Repeated rows are cut alike. An empty table gives an empty result. Other
columns are left out. Texts of any length are taken whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.common import documents, slices

#: Code points of a leaf.
LEAF = 2048
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 7


@dataclass(slots=True)
class Rope:
    """A leaf with its text, or two ropes after each other; ``ends`` line ends and ``points`` code points in all."""

    ends: int
    points: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            at = waiting.pop()
            if at.left is None:
                yield at.text
            else:
                waiting += (at.right, at.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def leaf(text: str) -> Rope:
    return Rope(text.count("\n"), len(text), text)


def join(a: Rope, b: Rope) -> Rope:
    """One rope of two; what is empty leaves no node behind."""
    if not a.points or not b.points:
        return a if a.points else b
    return Rope(a.ends + b.ends, a.points + b.points, "", a, b)


def rope(text: str) -> Rope:
    """A balanced rope, built level by level."""
    level = [leaf(text[at : at + LEAF]) for at in range(0, len(text), LEAF)] or [leaf("")]
    while len(level) > 1:
        level = [join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def units(r: Rope, text: str) -> int:
    """Lines of a text; the last one may lack its end."""
    return r.ends + bool(text and not text.endswith("\n"))


def _after_line(text: str, rank: int) -> int:
    at = 0
    for _ in range(rank):
        at = text.index("\n", at) + 1
    return at


def split(r: Rope, rank: int, count: Callable[[Rope], int], place: Callable[[str, int], int]) -> tuple[Rope, Rope]:
    """The rope before and from ``rank``, counted by a cached number of each node; ``place`` finds it in a leaf."""
    if rank <= 0:
        return leaf(""), r
    if rank > count(r):
        return r, leaf("")
    if r.left is None:
        at = place(r.text, rank)
        return leaf(r.text[:at]), leaf(r.text[at:])
    before = count(r.left)
    if rank <= before:
        a, b = split(r.left, rank, count, place)
        return a, join(b, r.right)
    a, b = split(r.right, rank - before, count, place)
    return join(r.left, a), b


def split_lines(r: Rope, rank: int) -> tuple[Rope, Rope]:
    return split(r, rank, lambda x: x.ends, _after_line)


def split_points(r: Rope, rank: int) -> tuple[Rope, Rope]:
    return split(r, rank, lambda x: x.points, lambda _, at: at)


def places(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four hashes of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def rearranged(text: str, doc_id: int | None, rate: int = 100, spm: int = 50, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, code points of the prefix and of the middle, what is written)."""
    whole = rope(text)
    n = units(whole, text)
    h1, h2, h3, h4 = places(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split_lines(whole, last)
    prefix, middle = split_lines(head, first)
    form = "spm" if h4 % 100 < spm else "psm"
    order = [(SUFFIX, suffix), (PREFIX, prefix)] if form == "spm" else [(PREFIX, prefix), (SUFFIX, suffix)]
    out = leaf("")
    for mark, part in [*order, (MIDDLE, middle)]:
        out = join(join(out, leaf(mark)), part)
    return n, form, prefix.points, middle.points, str(out)


def put_back(output: str, form: str) -> str:
    """The text that ``rearranged`` was given."""
    if form == "plain":
        return output
    second = PREFIX if form == "spm" else SUFFIX
    at = output.index(second, len(PREFIX))
    middle_at = output.index(MIDDLE, at + len(second))
    rest, middle = split_points(rope(output), middle_at + len(MIDDLE))
    rest, two = split_points(split_points(rest, middle_at)[0], at + len(second))
    one = split_points(split_points(rest, at)[0], len(PREFIX))[1]
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return str(join(join(prefix, middle), suffix))


def transform(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = SEED) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars and output of every document.

    ``rate`` of a hundred documents are cut, ``spm`` of a hundred of those suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in slices(batches, 64):
            made = [rearranged(t, d, rate, spm, seed) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist())]
            columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return documents(docs).mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(written: DataFrame) -> DataFrame:
    """``written`` (output, form, ...) with the text as it was in ``restored``, made of these two columns alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            back = [put_back(o, f) for o, f in zip(b["output"].to_pylist(), b["form"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], [*b.schema.names, "restored"])

    rest = written.drop("restored")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{kinds}, restored string")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
    ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4
  FROM d),
c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(list_slice(lines, 1, a), '') AS pre, array_to_string(list_slice(lines, a + 1, b), '') AS mid, array_to_string(list_slice(lines, b + 1, n), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
