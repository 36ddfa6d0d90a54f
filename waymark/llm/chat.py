"""Chat formatting into a prefix tree: shared turns are emitted once, depth first.

The template writes a turn as ``### role: text </turn>`` and a line break. In texts and
roles a backslash, ``### `` and ``</turn>`` (and a colon in roles) get a backslash before
them, so nothing a text says can open or close a turn, and reading takes it away again.

Turns are nodes of a tree; conversations that begin with the same turns share them. The
conversations are sorted by their turns' digests, which is depth-first order, and each
emits the turns that it doesn't share with the one before it. Sorted ranges are emitted
side by side: a range learns from the ends of the one before which of its first turns are
there already, and where they stand, so a beginning that a third of all conversations
share is still emitted once. A node has its token ids, its place in the stream of all
tokens, the position of its first token in its conversations, the intervals of the stream
that its tokens attend to besides those before them in the node, and the interval of its
ids that counts for the loss: the text of an assistant's turn.

Nulls: a null text or role is empty, a null conv_id is a conversation of its own, turns
without a number come first. Turns with equal numbers, repeated rows among them, are all
kept, ordered by role and text. An empty table gives empty results. Other columns are
ignored. A conversation is formatted whole, in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import settle, slices
from waymark.llm.packing import encoder

ASSISTANT = "assistant"
KEY = 16
_CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, the escaped text, what stands after."""
    return f"### {escape(role).replace(':', chr(92) + ':')}: ", escape(text), " </turn>\n"


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; raises ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m or not m[2].endswith(" "):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return turns


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(errors="surrogatepass"), digest_size=KEY).digest()


def shared(a: bytes, b: bytes) -> int:
    """Turns that two conversations share from the start, by their keys."""
    n = min(len(a), len(b)) // KEY
    for k in range(n):
        if a[k * KEY : k * KEY + KEY] != b[k * KEY : k * KEY + KEY]:
            return k
    return n


def sorted_conversations(rows: DataFrame) -> DataFrame:
    """shard, conv_id, key, turns: conversations in depth-first order, range by range."""
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gathered = rows.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [b"".join(digest(t["role"], t["text"]) for t in turns) for turns in b["turns"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turns"], pa.array(keys, pa.binary())], ["conv_id", "turns", "key"])

    kind = "array<struct<turn: bigint, role: string, text: string>>"
    keyed = gathered.mapInArrow(run, f"conv_id bigint, turns {kind}, key binary")
    return settle(keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("shard", F.spark_partition_id()))


def _emit(before: dict[int, bytes], depth: dict[int, int], vocabulary: str) -> Iterator:
    """The function that emits the nodes of one range, as if it began at 0, given the key before it.

    The ``depth`` nodes that it takes over from there have no length, and a negative
    place of their own: -2 for the first, -4 for the second and so on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        last: bytes | None = None
        stack: list[tuple[int, int, int]] = []
        at = line = 0
        for b in slices(batches):
            out: list[tuple] = []
            for shard, conv, key, turns in zip(*(b[c].to_pylist() for c in ("shard", "conv_id", "key", "turns"))):
                if encode is None:
                    encode = encoder(vocabulary)
                    last, stack = before.get(shard, b""), [(-2 * k - 2, -2 * k - 2, 0) for k in range(depth[shard])]
                same = shared(last, key)
                del stack[same:]
                for k in range(same, len(turns)):
                    head, body, foot = (encode(x) for x in parts(turns[k]["role"], turns[k]["text"]))
                    ids = np.array([*head, *body, *foot], dtype="<u4")
                    position = stack[-1][2] + stack[-1][1] - stack[-1][0] if stack else 0
                    attends: list[dict] = []
                    for start, end, _ in stack:
                        if attends and attends[-1]["end"] == start:
                            attends[-1]["end"] = end
                        else:
                            attends.append({"start": start, "end": end})
                    loss = (len(head), len(head) + len(body)) if turns[k]["role"] == ASSISTANT else (0, 0)
                    out.append((shard, line, None, None, at, at + len(ids), k, position, attends, *loss, ids.tobytes()))
                    stack.append((at, at + len(ids), position))
                    at += len(ids)
                out.append((shard, line, conv, [s[0] for s in stack], None, None, None, None, None, None, None, None))
                last = key
                line += 1
            yield _rows(out)

    return run


def _placed(stacks: dict[int, list[tuple[int, int, int]]], base: dict[int, int]) -> Iterator:
    """The function that moves the nodes of a range to where it begins, behind the nodes (start, end, position) it takes over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for r in b.to_pylist():
                above, at = stacks[r["shard"]], base[r["shard"]]
                if r["path"] is not None:
                    r["path"] = [x + at if x >= 0 else above[-x // 2 - 1][0] for x in r["path"]]
                else:
                    taken = [above[-x["start"] // 2 - 1] for x in r["attends"] if x["start"] < 0]
                    attends: list[dict] = []
                    for start, end in [t[:2] for t in taken] + [(x["start"] + at, x["end"] + at) for x in r["attends"] if x["start"] >= 0]:
                        if attends and attends[-1]["end"] == start:
                            attends[-1]["end"] = end
                        else:
                            attends.append({"start": start, "end": end})
                    r |= {"start": r["start"] + at, "end": r["end"] + at, "position": r["position"] + sum(t[1] - t[0] for t in taken), "attends": attends}
                out.append(tuple(r.values()))
            yield _rows(out)

    return run


_NODES = (
    "shard int, line bigint, conv_id bigint, path array<bigint>, start bigint, end bigint, depth int, position bigint, "
    "attends array<struct<start: bigint, end: bigint>>, loss_start int, loss_end int, ids binary"
)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int64(), span, pa.int32(), pa.int32(), pa.binary())
    names = ["shard", "line", "conv_id", "path", "start", "end", "depth", "position", "attends", "loss_start", "loss_end", "ids"]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def format_tree(rows: DataFrame, vocabulary: str = "byte_bpe_50k") -> tuple[DataFrame, DataFrame]:
    """(nodes, conversations): nodes as described above; conversations (conv_id, path) name the nodes by their start."""
    sorted_ = sorted_conversations(rows)
    # what ranges must know of each other: a row for each, whatever they hold
    ends = sorted_.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    shards = sorted((r["shard"], bytes(r["first"]), bytes(r["last"])) for r in ends)
    before = {s: shards[k - 1][2] if k else b"" for k, (s, _, _) in enumerate(shards)}
    depth = {s: shared(before[s], first) for s, first, _ in shards}
    # each range as if it began at 0; turns become tokens here, once
    alone = settle(sorted_.mapInArrow(_emit(before, depth, vocabulary), _NODES))
    made = alone.where("path is not null")
    size = {r["shard"]: r["n"] for r in alone.groupBy("shard").agg(F.coalesce(F.max("end"), F.lit(0)).alias("n")).collect()}
    lasts = made.groupBy("shard").agg(F.max(F.struct("line", "path"))["path"].alias("path"))
    widths = alone.where("start is not null").select("shard", "start", "end")
    tips = lasts.select("shard", F.explode("path").alias("start")).where("start >= 0").join(widths, ["shard", "start"]).collect()
    own = {(r["shard"], r["start"]): r["end"] for r in tips}
    paths = {r["shard"]: r["path"] for r in lasts.collect()}
    base, stacks, at = {}, {}, 0
    stack: list[tuple[int, int, int]] = []
    for s, _, _ in shards:
        base[s], stacks[s] = at, stack[: depth[s]]
        stack, position = [], 0
        for k, start in enumerate(paths[s]):
            begin, end = stacks[s][k][:2] if start < 0 else (start + at, own[s, start] + at)
            stack.append((begin, end, position))
            position += end - begin
        at += size[s]
    done = alone.mapInArrow(_placed(stacks, base), _NODES)
    nodes = done.where("start is not null").drop("shard", "line", "conv_id", "path")
    return nodes, done.where("path is not null").select("conv_id", "path")


def read_back(nodes: DataFrame, conversations: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss (unescaped texts under the mask), from tokens."""
    steps = conversations.select("conv_id", F.posexplode_outer("path").alias("k", "start"))
    joined = steps.join(nodes.select("start", "ids", "loss_start", "loss_end"), "start", "left")
    whole = joined.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids", "loss_start", "loss_end"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = None
        for b in slices(batches):
            decode = decode or encoder(vocabulary).__self__.decode
            formatted, turns, loss = [], [], []
            for nodes in b["parts"].to_pylist():
                ids = [np.frombuffer(n["ids"], "<u4") for n in nodes if n["ids"] is not None]
                formatted.append(decode(np.concatenate(ids).tolist()) if ids else "")
                turns.append([{"role": r, "text": t} for r, t in read(formatted[-1])])
                loss.append([unescape(decode(np.frombuffer(n["ids"], "<u4")[n["loss_start"] : n["loss_end"]].tolist())) for n in nodes if n["ids"] is not None and n["loss_end"]])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b["conv_id"], pa.array(formatted, pa.string()), pa.array(turns, kind), pa.array(loss, pa.list_(pa.string()))],
                ["conv_id", "formatted", "turns", "loss"],
            )

    return whole.mapInArrow(run, "conv_id bigint, formatted string, turns array<struct<role: string, text: string>>, loss array<string>")
