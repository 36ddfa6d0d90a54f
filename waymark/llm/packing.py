"""Packing documents into sequences of bounded length: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the whole corpus is one histogram of at
most ``capacity`` counts, whatever its size; the plan is made from it on the driver.
First Martello and Toth's reduction fixes sets that dominate all others holding their
largest document: a document nothing fits beside; one with the document that fills its
sequence exactly; one with the largest that fits, where no two (or no better two) fit.
The rest is packed best-fit decreasing, whole runs of equal sequences at a time. Then
every document takes the slot of its rank among those of its length; ranks are counted
in hashed buckets, so a length that most documents share is spread over many tasks.

Nulls: a null text is empty, and is packed as its end mark alone. Repeated rows are packed
once each. An empty table gives an empty result. Other columns are ignored. Texts of any
length are tokenized whole; only documents beyond the capacity are cut, and only their
first piece is shorter than it.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import documents, settle, slices

CAPACITY = 2048
#: About so many pieces are ranked in one bucket of one length.
RANKED = 512

Plan = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def encoder(vocabulary: str = "byte_bpe_50k", added: bool = False):
    """Text to token ids: byte-level BPE by the ranks of a public vocabulary.

    With ``added`` the strings of the vocabulary's added tokens are taken out of texts first
    and are one token each, as ``tokenizers`` has them; without, they are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    special = {}
    if added:
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    built = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return partial(built.encode, allowed_special="all") if special else built.encode_ordinary


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in slices(batches):
            encode = encode or encoder(vocabulary, added=True)
            out: list[tuple] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                tokens = np.array([*encode(text), 0], dtype="<u4")
                first = (len(tokens) - 1) % capacity + 1
                starts = [0, *range(first, len(tokens), capacity)]
                for k, start in enumerate(starts):
                    end = first if not k else start + capacity
                    raw = tokens[start:end].tobytes()
                    out.append((doc, k, start, end - start, zlib.crc32(raw), *([raw] if ids else [])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids
    return documents(docs).mapInArrow(run, schema)


def reduction(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating sets out of ``counts`` until none is found; returns (lengths, times)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            counts[x] -= times
            if not counts[x]:
                del counts[x]
        fixed.append((lengths, times))

    def least(k: int, but: int) -> list[int]:
        """The k smallest lengths there are besides one document of length ``but``."""
        out: list[int] = []
        for x in sorted(counts):
            out += [x] * min(k - len(out), counts[x] - (x == but))
            if len(out) >= k:
                break
        return out

    def step(j: int) -> bool:
        room = capacity - j
        if room in counts and (room != j or counts[j] > 1):
            take((j, room), counts[j] // 2 if room == j else min(counts[j], counts[room]))
            return True
        small = least(3, j)
        if not small or small[0] > room:
            take((j,), counts[j])
            return True
        k = max(x for x in counts if x <= room and (x != j or counts[j] > 1))
        if len(small) < 2 or small[0] + small[1] > room:
            alone = True
        elif len(small) < 3 or sum(small) > room:
            # two more at most: the best two must not beat the largest one
            pair = max((a + b for a in counts if a < room for b in [max((x for x in counts if x <= room - a), default=0)] if b), default=0)
            alone = pair <= k
        else:
            alone = False
        if alone:
            take((j, k), 1 if k == j or counts[k] < 3 else max(1, min(counts[j], counts[k] - 2)))
        return alone

    again = True
    while again:
        again = False
        for j in sorted(counts, reverse=True):
            while j in counts and step(j):
                again = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of the counted lengths; (lengths, times)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for x in sorted(counts, reverse=True):
        left = counts[x]
        room = x
        while left:
            while room < capacity and not open_.get(room):
                room += 1
            if room >= capacity:
                lengths, bins, room_now = (), left, capacity
            else:
                lengths, bins = open_[room].pop()
                room_now = room
            each = room_now // x
            whole = min(bins, left // each)
            if whole:
                open_[room_now - each * x].append((lengths + (x,) * each, whole))
            left -= whole * each
            if whole < bins:
                rest = bins - whole if lengths else 0
                if left:
                    open_[room_now - left * x].append((lengths + (x,) * left, 1))
                    left = 0
                    rest -= bool(lengths)
                if rest:
                    open_[room_now].append((lengths, rest))
    return [p for room in sorted(open_) for p in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Plan, int]:
    """For each length its runs (first rank, first sequence, offset), and how many sequences there are."""
    counts = {int(x): int(n) for x, n in counts.items() if n}
    bins = reduction(counts, capacity)
    bins += best_fit(counts, capacity)
    rank: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequences = 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            runs[x].append((rank[x], sequences, offset))
            rank[x] += times
            offset += x
        assert offset <= capacity
        sequences += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in runs.items()}, sequences


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; offsets leave no gaps."""
    cut = settle(pieces(docs, capacity, vocabulary, ids))
    lengths = settle(cut.groupBy("length").agg(F.count("*").alias("n")))  # at most ``capacity`` rows
    made, _ = plan({r["length"]: r["n"] for r in lengths.collect()}, capacity)
    buckets = lengths.select("length", (F.floor(F.col("n") / RANKED) + 1).alias("buckets"))
    hashed = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")).cast("int")
    bucket = cut.join(F.broadcast(buckets), "length").select(*cut.columns, hashed.alias("bucket"))
    before = bucket.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select(
        "length", "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucket.withColumn("rank", F.row_number().over(within)).join(before, ["length", "bucket"])
    ranked = ranked.select(*cut.columns, (F.col("before") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, base, place = made[x]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[k] + rank[at] - first[k]
                offset[at] = place[k]
            rest = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.array(sequence), pa.array(offset)], [*rest, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian 32-bit, end to end) of what ``pack(ids=True)`` returns."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
