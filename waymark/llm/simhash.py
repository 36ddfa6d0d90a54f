"""Near duplicates by SimHash, found by bit-sliced comparison.

Fingerprints within the radius agree in two of four 16-bit blocks (a radius of 2 can
spoil two blocks only), so each distinct fingerprint is filed under the six pairs of
blocks. The rows of one pair are compared in bit-sliced form: 64 bit planes hold one bit
of 1,024 fingerprints each, carry-save counters in bitwise words add up 64 distances at a
time, and a query leaves its block as soon as all its distances exceed the radius.
Buckets above ``BUCKET`` rows are filed again under three parts of the other 32 bits,
which is exact too, and leaves buckets of 2**21 fingerprints at the very most. A task
reports a spanning forest of the links it found, not the links, and stars over the
distinct fingerprints give the components.

Nulls: a null text is empty; texts without words get the zero fingerprint and are linked
like any others. Repeated rows count as documents of their own. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import components, documents, may_have, settle, slices

RADIUS = 2
#: Rows of one pair of blocks beyond which the other bits are used too.
BUCKET = 4096
BLOCK = 1024
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash, unsigned, of UTF-8 text: A-Z lower-cased, ASCII white space parts words."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) < words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(map(len, w), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :])], dtype="<u8")
    votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t.encode()) for t in b["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit j of fingerprint i is bit i % 64 of word i // 64 in row j."""
    n = -(-len(fps) // 64) * 64
    rows = np.zeros(n, dtype="<u8")
    rows[: len(fps)] = fps
    bits = np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, sliced: np.ndarray, size: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (query, row) of all pairs at most ``radius`` (up to 2) bits apart."""
    assert 0 <= radius <= 2
    words = sliced.shape[1]
    ones = np.zeros((len(queries), words), dtype=np.uint64)
    twos, over = np.zeros_like(ones), np.zeros_like(ones)
    if size % 64:
        over[:, -1] = FULL << np.uint64(size % 64)
    left = np.arange(len(queries))
    mask = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), FULL, np.uint64(0))
    for j in range(64):
        differs = sliced[j][None, :] ^ mask[:, j][:, None]
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if j % 4 == 3:
            beyond = over | (ones & twos if radius == 2 else twos if radius == 1 else ones | twos)
            alive = (beyond != FULL).any(axis=1)
            if not alive.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if alive.sum() * 2 < len(alive) or j == 63:
                ones, twos, over, mask, left = ones[alive], twos[alive], over[alive], mask[alive], left[alive]
    beyond = over | (ones & twos if radius == 2 else twos if radius == 1 else ones | twos)
    q, r = np.nonzero(np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little"))
    return left[q], r


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a, b) join it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def reduced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what the links (a, b) join, one for each node that isn't a root."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = forest(len(nodes), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row indexes (row, root) of a spanning forest of the links; rows are sorted by key, runs whole."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.append(first, len(key)))
    rows = np.flatnonzero(np.repeat(length > 1, length))
    start = np.repeat(np.arange(len(first)), length)[rows]
    blocks = [rows[k : k + BLOCK] for k in range(0, len(rows), BLOCK)]
    sliced: list[np.ndarray] = []
    tree: list[tuple[np.ndarray, np.ndarray]] = []
    for k, at in enumerate(blocks):
        sliced.append(planes(fp[at]))
        back = k
        while back and start[back * BLOCK - 1] == start[k * BLOCK]:
            back -= 1
        found = [within(fp[at], sliced[c], len(blocks[c])) for c in range(back, k + 1)]
        a = np.concatenate([at[q] for q, _ in found])
        b = np.concatenate([blocks[c][r] for c, (_, r) in zip(range(back, k + 1), found)])
        tree.append(reduced(a[a > b], b[a > b]))
    return reduced(*(np.concatenate(x) for x in zip(*tree))) if tree else (key[:0], key[:0])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): representatives of distinct fingerprints (fp, rep) that are linked, as a forest per task."""
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]

    def rest(i: int, j: int) -> F.Column:
        x, y = (blocks[k] for k in range(4) if k not in (i, j))
        return F.shiftleft(x, 16).bitwiseOR(y)

    filed = fps.select(
        "fp", "rep",
        F.explode(F.array(*(
            F.struct(
                (F.lit(t) * (1 << 32) + blocks[i] * (1 << 16) + blocks[j]).alias("key"),
                rest(i, j).alias("rest"),
            )
            for t, (i, j) in enumerate(pairs)
        ))).alias("x"),
    ).select("fp", "rep", "x.key", "x.rest")
    counts = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    filed = filed.join(counts, "key")
    few = filed.where(F.col("n") <= BUCKET).select(F.col("key"), F.lit(0).alias("part"), "fp", "rep")
    #: the other 32 bits in parts of 11, 11 and 10: two that differ leave one part equal
    many = filed.where(F.col("n") > BUCKET).select(
        "key", "fp", "rep",
        F.explode(F.array(*(
            F.struct((F.lit(1 + k) * (1 << 12) + F.shiftright("rest", low).bitwiseAND(F.lit((1 << bits) - 1))).cast("int").alias("part"))
            for k, (low, bits) in enumerate(((0, 11), (11, 11), (22, 10)))
        ))).alias("x"),
    ).select("key", "x.part", "fp", "rep")
    spread = few.unionByName(many).repartition("key", "part").sortWithinPartitions("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(key, fp)
            return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch["key"].to_numpy() * 8192 + batch["part"].to_numpy()
            held.append((key, batch["fp"].to_numpy().view(np.uint64), batch["rep"].to_numpy()))
            cols = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(cols[0] == cols[0][-1], True))  # the last run may go on
            held = [tuple(c[cut:] for c in cols)]
            if cut:
                yield out(*(c[:cut] for c in cols))
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return spread.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable by links."""
    marked = settle(fingerprints(docs))
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    roots = components(links(distinct))
    found = distinct.join(roots, distinct["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marked.join(found, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their group, with all their columns.

    Rows that share one doc_id are one document, and one of them stays; rows without
    doc_id can't be named, and stay. Only texts that may have to go are shuffled.
    """
    groups = settle(near_duplicates(docs).where("doc_id is not null").select("doc_id", F.expr("doc_id <> component_id").alias("gone")))
    gone = settle(groups.where("gone").select("doc_id").distinct())
    apart = may_have(docs, "doc_id", gone)
    kept = apart.where("maybe").drop("maybe").join(gone, "doc_id", "left_anti").select(docs.columns).unionByName(apart.where("not maybe").drop("maybe"))
    twice = settle(groups.where("not gone").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not twice.limit(1).count():
        return kept
    single = may_have(kept, "doc_id", twice)
    return single.where("not maybe").drop("maybe").unionByName(single.where("maybe").drop("maybe").dropDuplicates(["doc_id"]))
