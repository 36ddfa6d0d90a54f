"""Exact removal of long repeated byte strings, by merging the suffix orders of shards.

A string of ``length`` bytes is led by its minimizer: the position, among its first
``WINDOW``, whose 24-byte hash is least. Equal strings have equal leaders, so only
suffixes at leaders are ordered, and only those whose first bytes, the key that all
strings led from there share, occur twice. Around the key, which is one symbol then, two
strings of ``SIDE`` symbols remain: the text after it, and the text before it read
backwards.

A shard is what one task holds at a time. It sorts its suffixes once, by what follows the
key and by what stands before it (the columns of its transform), and hands on the ranks
and the common prefixes of neighbours. Shards are merged by refining their interleave: at
first all rows of a class are one block, shard after shard; round k parts each block,
stably, by the symbol at k, and a border that appears in round k has a common prefix of k
symbols. Blocks that hold rows of one shard only aren't refined further, for their order
and their prefixes are that shard's. So nothing is sorted again, and no symbol is read
that a shard has settled. Intervals of the merged orders that share enough symbols on both
sides hold the repeated strings.

Copies never meet in the merge: equal surroundings of a leader are counted first, and one
stands for all. A class of over ``CLASS`` different surroundings is parted before it is
merged, by where its strings begin: those that begin at least a and at most b symbols
before the key have a symbols before it and ``SIDE`` - b after it in common, so rows are
classed by these, and rows that also agree on the b and ``SIDE`` - a symbols that the
strings can reach share all of them. Rows alone in their class have no partner, and this
goes on until classes are small or hold one string. So no class, however common its key,
meets in one task.

Keys, surroundings and the symbol strings of parted classes are told apart by 64-bit
hashes, each within its key.

Nulls: a null text is empty and has nothing removed. Repeated rows count as documents of
their own, so all their bytes go if the text has ``length`` bytes. An empty table gives an
empty result. Other columns are ignored. Text is taken in pieces of 1 MiB; what is known of a
document's own leaders stands in one row, as its text does, and is smaller.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import documents, may_have, settle, slices

LENGTH = 400
WINDOW = 128
SIDE = WINDOW - 1
#: Bytes of a leader's hash, which must lie in every key.
SEED = 24
#: Different surroundings of one class beyond which it is parted.
CLASS = 8192
#: Parts that a round makes of one; a power of two, as ``WINDOW`` is.
PARTS = 4
MISSING = 256
PIECE = 1 << 20
#: Rows of a shard, and rows that are merged together at least.
SHARD = 20_000
MERGE = 20_000
_CONTEXT = "key bigint, around bigint, copies bigint, shard bigint, rank_after int, same_after int, rank_before int, same_before int, before binary, after binary"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _MIX
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_BYTES = _byte_values()


def _join(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    b = b[by:]
    return a[: len(b)] * _MIX + (b ^ (b >> _SHIFT))


def leaders(text: bytes, length: int = LENGTH) -> np.ndarray:
    """Positions that lead some ``length``-byte string of the text, in order."""
    found = []
    for at in range(0, max(0, len(text) - length + 1), PIECE):
        b = np.frombuffer(text[at : at + PIECE + length - 1], np.uint8)
        h1 = _BYTES[b]
        h2 = _join(h1, h1, 1)
        h4 = _join(h2, h2, 2)
        h8 = _join(h4, h4, 4)
        h = _join(_join(h8, h8, 8), h8, 16)
        h ^= h >> np.uint64(32)
        low = h
        span = 1
        while span < WINDOW:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = low[: len(b) - length + 1]
        # a position leads if it is the least of some window that holds it
        high = np.concatenate((np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)))
        span = 1
        while span < WINDOW:
            high = np.maximum(high[:-span], high[span:])
            span *= 2
        m = min(len(high), len(h))
        found.append(np.flatnonzero(high[:m] == h[:m]) + at)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _suffixes(docs: DataFrame, length: int) -> DataFrame:
    """(key, around, doc, tint, pos) of every leader."""
    key = length - SIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches):
            keys: list[int] = []
            around: list[int] = []
            pos, many = [], []
            for text in b["text"].to_pylist():
                text = text.encode()
                at = leaders(text, length)
                n = len(text)
                for p in at.tolist():
                    keys.append(digest(text[p : p + key]))
                    around.append(digest(text[max(0, p - SIDE) : p + length], min(p, SIDE) * 65536 + min(n - p, length)))
                pos.append(at)
                many.append(len(at))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(around, dtype=np.uint64).view(np.int64)),
                        pa.array(np.repeat(b["doc"].to_numpy(), many)),
                        pa.array(np.repeat(b["tint"].to_numpy(), many)),
                        pa.array(np.concatenate(pos).astype(np.int32)),
                    ],
                    ["key", "around", "doc", "tint", "pos"],
                )

    return docs.select("doc", "tint", "text").mapInArrow(run, "key bigint, around bigint, doc bigint, tint int, pos int")


def symbols(strings: list[bytes]) -> np.ndarray:
    """(strings, SIDE) symbols; places past a string's end hold ``MISSING``."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.full((len(strings), SIDE), MISSING, dtype=np.uint16)
    out[np.arange(SIDE) < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def ordered(keys: list[int], strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A shard's order: each row's rank, by key and string, and the symbols that it shares with the row before it; -1 across keys."""
    order = sorted(range(len(keys)), key=lambda k: (keys[k], strings[k]))
    rank, same = np.empty(len(keys), np.int32), np.full(len(keys), -1, np.int32)
    rank[order] = np.arange(len(keys))
    for a, b in zip(order, order[1:]):
        if keys[a] == keys[b]:
            same[b] = _common(strings[a], strings[b])
    return rank, same


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The surroundings of ``wanted`` leaders (doc, tint, list of pos, key, around, copies), in the order of shards."""
    key = length - SIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[int, int, int, bytes, bytes]] = []
        shards = 0

        def out() -> pa.RecordBatch:
            keys, around, copies, before, after = (list(c) for c in zip(*held))
            held.clear()
            ranks = [pa.array(x) for strings in (after, before) for x in ordered(keys, strings)]
            shard = pa.array(np.full(len(keys), TaskContext.get().partitionId() << 32 | shards))
            columns = [pa.array(keys, pa.int64()), pa.array(around, pa.int64()), pa.array(copies, pa.int64()), shard, *ranks, pa.array(before, pa.binary()), pa.array(after, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _CONTEXT.split(", ")])

        for b in slices(batches, 16):
            for text, places in zip(b["text"].to_pylist(), b["wanted"].to_pylist()):
                text = text.encode()
                for w in places:
                    p = w["pos"]
                    held.append((w["key"], w["around"], w["copies"], text[max(0, p - SIDE) : p][::-1], text[p + key : p + length]))
                    if len(held) >= SHARD:
                        yield out()
                        shards += 1
        if held:
            yield out()

    found = may_have(docs.select("doc", "tint", "text"), "doc", wanted).where("maybe").join(wanted, ["doc", "tint"])
    return found.select("text", "wanted").mapInArrow(run, _CONTEXT)


def neighbours(group: np.ndarray, shard: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """What each row shares with the one before it, if that is of its group and shard, else -1."""
    apart = (columns[1:] != columns[:-1]) | (columns[1:] == MISSING)
    same = np.where(apart.any(axis=1), apart.argmax(axis=1), columns.shape[1])
    return np.concatenate(([-1], np.where((group[1:] == group[:-1]) & (shard[1:] == shard[:-1]), same, -1)))


def interleave(group: np.ndarray, shard: np.ndarray, same: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of rows, and the symbols that each shares with the one before it; -1 across groups.

    Rows come by group, then shard, then rank in it; ``same`` is what a row shares with
    the one before it in its shard. Missing symbols match nothing.
    """
    n = len(group)
    order, shared = np.arange(n), np.full(n, -1, dtype=np.int64)
    first = np.concatenate(([True], group[1:] != group[:-1]))

    def mixed(first: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Whether a row's block, each beginning at ``first``, has rows of several shards."""
        starts = np.flatnonzero(first)
        return np.repeat(np.minimum.reduceat(shards, starts) != np.maximum.reduceat(shards, starts), np.diff(np.append(starts, len(first))))

    # inside a block of one shard, neighbours share what they share there
    inside = ~first
    open_ = np.flatnonzero(mixed(first, shard))
    block = np.cumsum(first)
    for k in range(columns.shape[1]):
        if not len(open_):
            break
        rows, of = order[open_], block[open_]
        symbol = columns[rows, k]
        by = np.argsort(of * 512 + symbol, kind="stable")
        rows, symbol = rows[by], symbol[by]
        order[open_] = rows
        border = np.concatenate(([True], (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1]) | (symbol[1:] == MISSING)))
        appears = border & np.concatenate(([False], of[1:] == of[:-1]))
        shared[open_[appears]] = k
        inside[open_[appears]] = False
        block[open_] = open_[border][np.cumsum(border) - 1] + n + 1  # the place where it begins, apart from the first numbers
        open_ = open_[mixed(border, shard[rows])]
    whole = np.zeros(n, dtype=bool)
    whole[open_] = True  # never parted: all symbols are the same
    shared[inside] = np.where(whole[inside], columns.shape[1], same[order[inside]])
    return order, shared


def repeated(after: tuple[np.ndarray, np.ndarray], before: tuple[np.ndarray, np.ndarray], have_after: np.ndarray, have_before: np.ndarray) -> np.ndarray:
    """(rows, WINDOW): whether the string that starts o symbols before the key occurs in another row, by the two merged orders."""
    (ro, rs), (lo, ls) = after, before
    n = len(ro)
    out = np.zeros((n, WINDOW), dtype=bool)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(WINDOW):
        left[lo] = np.cumsum(ls < o)
        right[ro] = np.cumsum(rs < SIDE - o)
        rows = np.flatnonzero((have_before >= o) & (have_after >= SIDE - o))
        _, at, count = np.unique(left[rows] * (n + 1) + right[rows], return_inverse=True, return_counts=True)
        out[rows, o] = count[at] > 1
    return out


def _merge(contexts: DataFrame, parted: bool) -> DataFrame:
    """(key, around, bits) of contexts (class, lo, hi and ``_CONTEXT``), sorted by class, shard and rank in their partition.

    A parted class has some of a shard's rows of a key only, so what neighbours share in
    it is looked up anew; their order stays.
    """

    def decide(rows: pa.Table) -> pa.RecordBatch:
        at = {c: rows[c].to_numpy() for c in ("class", "shard", "same_after", "same_before", "rank_before", "copies", "lo", "hi")}
        group = np.cumsum(np.concatenate(([True], at["class"][1:] != at["class"][:-1])))
        after, before = (symbols(rows[c].to_pylist()) for c in ("after", "before"))
        turn = np.lexsort((at["rank_before"], at["shard"], group))
        there, shards = group[turn], at["shard"][turn]
        same = (neighbours(group, at["shard"], after), neighbours(there, shards, before[turn])) if parted else (at["same_after"], at["same_before"][turn])
        forth = interleave(group, at["shard"], same[0], after)
        order, shared = interleave(there, shards, same[1], before[turn])
        bits = repeated(forth, (turn[order], shared), (after != MISSING).sum(axis=1), (before != MISSING).sum(axis=1))
        bits[at["copies"] > 1] = True
        o = np.arange(WINDOW)
        bits &= (o >= at["lo"][:, None]) & (o <= at["hi"][:, None])
        some = np.flatnonzero(bits.any(axis=1))
        packed = np.packbits(bits[some], axis=1, bitorder="little")
        key, around = (pa.array(rows[c].to_numpy()[some]) for c in ("key", "around"))
        return pa.RecordBatch.from_arrays([key, around, pa.array([x.tobytes() for x in packed], pa.binary())], ["key", "around", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            for at in range(0, b.num_rows, MERGE):
                part = pa.Table.from_batches([b.slice(at, MERGE)])
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows >= MERGE:
                    key = held["class"].to_numpy()
                    cut = int(np.searchsorted(key == key[-1], True))
                    if cut:
                        yield decide(held.slice(0, cut))
                        held = held.slice(cut)
        if held is not None and held.num_rows:
            yield decide(held)

    return contexts.mapInArrow(run, "key bigint, around bigint, bits binary")


def _all_bits(lo: int, hi: int) -> bytes:
    return np.packbits((np.arange(WINDOW) >= lo) & (np.arange(WINDOW) <= hi), bitorder="little").tobytes()


def _decided(contexts: DataFrame) -> list[DataFrame]:
    """(key, around, bits) of settled contexts, by rounds: small classes are merged, large ones parted.

    A round goes from the strings that begin ``lo`` to ``hi`` symbols before the key to
    parts of these. All of a part's strings hold its core, by which rows are classed, and
    none goes beyond its reach; rows of one reach share all of the part's strings, so they
    are decided, and one stands for them from there on.
    """
    out: list[DataFrame] = []
    now = contexts.withColumns({"class": F.col("key"), "lo": F.lit(0), "hi": F.lit(SIDE)})
    size = WINDOW  # of the parts of a round
    while True:
        large = settle(now.groupBy("class").agg(F.count("*").alias("rows")).where(F.col("rows") > CLASS).select("class"))
        some = not large.isEmpty()
        small = now.join(large, "class", "left_anti") if some else now
        # dealt by a key that no join has: Spark drops a repartition by the join's own, and then reads where the rows lie if it comes to broadcast ``large``
        out.append(_merge(small.repartition(F.hash("class")).sortWithinPartitions("class", "shard", "rank_after"), size < WINDOW))
        if not some:
            return out
        size = max(1, size // PARTS)
        starts = F.sequence(F.col("lo"), F.col("hi"), F.lit(size))
        parts = now.join(large, "class", "left_semi").withColumn("lo", F.explode(starts)).withColumn("hi", F.col("lo") + (size - 1))
        after = lambda o: F.substring("after", F.lit(1), F.lit(SIDE) - F.col(o))  # noqa: E731  what strings from o on have at most, or all of them to o have
        before = lambda o: F.substring("before", F.lit(1), F.col(o))
        parts = parts.where((F.length("before") >= F.col("lo")) & (F.length("after") >= F.lit(SIDE) - F.col("hi")))
        parts = parts.withColumn("class", F.xxhash64("class", "lo", before("lo"), after("hi"))).withColumn("reach", F.xxhash64(before("hi"), after("lo")))
        parts = settle(parts)
        one = F.min_by(F.struct("key", "around", "shard", "rank_after", "same_after", "rank_before", "same_before", "before", "after"), F.struct("shard", "rank_after"))
        kinds = parts.groupBy("class", "lo", "hi", "reach").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"), one.alias("x"))
        kinds = settle(kinds.select("class", "lo", "hi", "reach", "copies", "rows", "x.*"))
        shared = kinds.where("copies > 1").select("class", "reach")
        whole = reduce(lambda x, a: x.when(F.col("lo") == a, F.lit(_all_bits(a, a + size - 1))), range(0, WINDOW, size), F.when(F.lit(False), F.lit(b"")))
        out.append(parts.join(shared, ["class", "reach"], "left_semi").select("key", "around", whole.alias("bits")))
        several = kinds.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
        now = settle(kinds.join(several, "class", "left_semi").select(now.columns))


def _marks(docs: DataFrame, length: int) -> DataFrame:
    """(doc, tint, marks): for each document the leaders with repeated strings; null bits stand for all of them."""
    suffixes = _suffixes(docs, length)
    classes = suffixes.groupBy("key").agg(F.count("*").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi"))
    # settled, so that the join has shuffles of its own and the rows of a hot key are split
    classes = settle(classes.where("n > 1").select("key", F.expr("lo <> hi").alias("mixed")))
    shared = settle(suffixes.join(classes, "key"))
    mixed = shared.where("mixed").select("key", "around", "doc", "tint", "pos")
    kinds = mixed.groupBy("key", "around").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "tint", "pos")).alias("at"))
    wanted = settle(kinds.groupBy("at.doc", "at.tint").agg(F.collect_list(F.struct("at.pos", "key", "around", "copies")).alias("wanted")))
    bits = reduce(DataFrame.unionByName, _decided(settle(_contexts(docs, wanted, length))))
    marks = mixed.join(bits, ["key", "around"]).select("doc", "tint", "pos", "bits")
    marks = marks.unionByName(shared.where("not mixed").select("doc", "tint", "pos", F.lit(None).cast("binary").alias("bits")))
    return settle(marks.groupBy("doc", "tint").agg(F.collect_set(F.struct("pos", "bits")).alias("marks")))


def spans(size: int, marks: list[dict], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that the marks name."""
    edges = []
    for m in marks:
        at = m["pos"]
        lo, hi = max(0, length - (size - at)), min(SIDE, at)
        if m["bits"] is None:
            edges.append((at - hi, at - lo + length))
            continue
        on = np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], np.uint8), bitorder="little"))
        on = on[(on >= lo) & (on <= hi)]
        if len(on):  # gaps between them are narrower than a string, so one run covers all
            edges.append((at - int(on[-1]), at - int(on[0]) + length))
    out: list[tuple[int, int]] = []
    for a, b in sorted(edges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *more: str, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """doc_id, the columns in ``more``, n_bytes, spans (start, end) removed, kept (the bytes left) of every row.

    Strings of ``length`` bytes count, which is ``WINDOW`` + ``SEED`` at least. With ``as_text`` a column text holds what is left instead; characters that a cut
    broke are left out of it.
    """
    if length < WINDOW + SEED:
        raise ValueError(f"strings have {WINDOW + SEED} bytes at least")
    # rows with one doc_id and one text have the same marks; 96 bits tell the others apart
    own = documents(docs, *more).withColumns({"doc": F.coalesce("doc_id", F.xxhash64("text")), "tint": F.hash("text")})
    marks = _marks(own, length)
    apart = may_have(own, "doc", marks)
    unmarked = apart.where("not maybe").withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType))
    joined = apart.where("maybe").join(marks, ["doc", "tint"], "left").select(unmarked.columns).unionByName(unmarked)
    names = ["doc_id", *more]
    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names)

    last = "text" if as_text else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size, cuts, kept = [], [], []
            for text, found in zip(b["text"].to_pylist(), b["marks"].to_pylist()):
                text = text.encode()
                runs = spans(len(text), found or [], length)
                size.append(len(text))
                cuts.append([{"start": s, "end": e} for s, e in runs])
                at, parts = 0, []
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                left = b"".join([*parts, text[at:]])
                kept.append(left.decode(errors="ignore") if as_text else left)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in names), pa.array(size, pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.string() if as_text else pa.binary())],
                [*names, "n_bytes", "spans", last],
            )

    return joined.select(*names, "text", "marks").mapInArrow(run, f"{schema}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, {last} {'string' if as_text else 'binary'}")
