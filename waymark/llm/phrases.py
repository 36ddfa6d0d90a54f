"""Phrases whose words keep company: contiguous pattern growth over projected occurrences.

Everything is counted per language. Words found ``LEAST`` times or more are patterns of
one word. A pattern's occurrences are pointers into the texts; growing it by a word to its
right keeps those whose next word is the same. A pointer can't be followed from another
machine, so it is projected: it travels with the words it would be followed to, two at
most beyond a frequent pair, and equal ones travel once with their number. No pointer is
sent whose pair or next pair is rare, since no longer phrase there can be frequent.

Pointers are dealt by their prefix, a pair of words, and sorted; each prefix is grown in
one task, depth first: a run of equal next words is a grown pattern, and is run through
again for the next word before its neighbour. A prefix with over a 4,096th of all words
(there are at most 4,096 of those) is dealt by its grown patterns instead, so its pointers
spread over all tasks, and the supports found there are added up.

Words travel as hashes of language and word, of as many bits as it takes for no two
frequent words to share one; that none do is checked, and they are hashed anew with another
salt if two do, so all counts are exact. A task sends what it counted as one packed row for
each part of the keys; a part has about ``PART`` rows, so there are as many as the corpus
needs.

Nulls: a null text has no words, a null lang is ``und``. Repeated rows count each time. An
empty table gives an empty result. doc_id and other columns are ignored. Long texts are
read in windows of ``WINDOW`` bytes, cut between words; phrases run across the cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import joined_small, settle, slices

LEAST, LONGEST, KEPT, COVERED, SCALE = 30, 4, 2000, 80, 2_000_000
#: Words that a task holds before it sends what it counted.
BLOCK = 1 << 22
#: Bytes that are split into words at once.
WINDOW = 1 << 20
#: A filter of 2**FILTER bits says which words or pairs may be frequent.
FILTER = 26
#: A prefix with more than one in so many words is dealt by its grown patterns.
HOT = 4096
#: About so many rows of keys make a part.
PART = 1 << 22
BREAK = b"."
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_LINE = bytes.maketrans(_BREAKS, b"\n" * len(_BREAKS))
_GAP = re.compile(rb"[ \t\n]")
KEYS = ["k1", "k2", "k3", "k4"]


class _Numbers(dict):
    """Gives each word a number when it is first seen; a break between pieces has 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def split_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in windows, with ``BREAK`` where a piece ends; A-Z in lower case."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].replace(b"\n", b" . ").split()
        at = end


def word_blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words, numbers): the words of many texts of one language as numbers into ``words``; 0 is a break."""
    held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def given(lang: str) -> tuple[str, list[bytes], np.ndarray]:
        numbers, parts = held.pop(lang)
        sizes.pop(lang, None)
        return lang, list(numbers), np.concatenate(parts)

    def take(lang: str, text: bytes) -> None:
        numbers, parts = held.setdefault(lang, (_Numbers(), [np.zeros(1, dtype=np.int64)]))
        for words in split_words(text.lower().translate(_TO_LINE)):
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            sizes[lang] = sizes.get(lang, 0) + len(words)
        parts.append(np.zeros(1, dtype=np.int64))

    for b in slices(batches, 256):
        short: dict[str, list[bytes]] = {}
        for lang, text in zip(b["lang"], b["text"]):  # one text of any length, or some short ones together
            lang, text = lang.as_py(), text.as_py()
            if text and len(text) >= WINDOW:
                take(lang, text)
            elif text:
                short.setdefault(lang, []).append(text)
        for lang, some in short.items():
            for at in range(0, len(some), 64):
                take(lang, b"\n".join(some[at : at + 64]))
        while sum(sizes.values()) >= block:
            yield given(max(sizes, key=sizes.get))
    for lang in sorted(held):
        yield given(lang)


@dataclass(frozen=True)
class Keys:
    """How words become keys: the upper ``bits`` of a salted hash, never 0 in a frequent word."""

    salt: str
    bits: int

    @property
    def mask(self) -> int:
        return (1 << 64) - (1 << 64 - self.bits)

    def column(self, lang: str, word: str) -> Column:
        signed = self.mask - (1 << 64)
        return F.xxhash64(F.concat(F.lit(self.salt), lang), word).bitwiseAND(F.lit(signed).cast("bigint"))

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        """What ``column`` gives; 0 for the first of ``words``, the break."""
        seed = xxhash.xxh64_intdigest((self.salt + lang).encode(), 42)
        found = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)) & np.uint64(self.mask)
        found[0] = 0
        return found


def keys_of(words: DataFrame) -> Keys:
    """Keys that tell all ``words`` (lang, word) apart."""
    bits = min(64, max(FILTER, 2 * words.count().bit_length() + 2))
    for salt in map(str, range(20)):
        keys = Keys(salt, bits)
        shared = words.select(keys.column("lang", "word").alias("key")).groupBy("key").count().where("count > 1 or key = 0")
        if shared.isEmpty():
            return keys
        bits = min(64, bits + 1)
    raise RuntimeError("two frequent words have one key, whatever the salt")


def _place(*keys: Column) -> Column:
    """A key's, or a pair's, place in a filter, from 1: the highest bits of the one, and of the other turned by 21."""
    mixed = keys[0] if len(keys) == 1 else keys[0].bitwiseXOR(F.shiftleft(keys[1], 21).bitwiseOR(F.shiftrightunsigned(keys[1], 43)))
    return F.shiftrightunsigned(mixed, 64 - FILTER) + 1


def _place_of(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    mixed = a if b is None else a ^ ((b << np.uint64(21)) | (b >> np.uint64(43)))
    return (mixed >> np.uint64(64 - FILTER)).astype(np.int64)


class Filter:
    """Bits, 8 MiB whatever the data, of keys that may be there: a key without its bit isn't."""

    def __init__(self, keys: DataFrame, *columns: str) -> None:
        at = _place(*(F.col(c) for c in columns)).alias("at")
        rows = keys.select(at).groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
        bits = bytearray(1 << FILTER - 3)
        for r in rows:  # Spark counts its buckets of 4096 bytes from 1
            bits[(r["n"] - 1) * 4096 : r["n"] * 4096] = bytes(r["bits"])
        self.sent = keys.sparkSession.sparkContext.broadcast(bytes(bits))

    def has(self, places: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.sent.value, dtype=np.uint8)
        return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 != 0


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, each partition's added up first; word null: all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, numbers in word_blocks(batches):
            n = np.bincount(numbers, minlength=len(words))[1:]
            # a word numbered in this block is found in it, so none has 0
            columns = [pa.array([lang] * (len(n) + 1), pa.string()), pa.array([*words[1:], None], pa.binary()), pa.array(np.append(n, n.sum()), pa.int64())]
            yield from slices(iter([pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])]), 65536)

    return docs.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _merged(keys: np.ndarray, columns: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of numbers as one row of keys, with how many there are; number 0 has key 0."""
    code = columns[0][at]
    for k, c in enumerate(columns[1:]):  # one number for all columns so far, and the next column
        if k:
            _, code = np.unique(code, return_inverse=True)
        code = code.astype(np.int64) << 32 | c[at]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return np.stack([keys[c[at[first]]] for c in columns], axis=1), n


def _in_order(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(rows.T[::-1])


PACKED = "part int, rows int, packed binary"


def pack(rows: np.ndarray, n: np.ndarray, spread: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A packed row for each part: keys in order, byte by byte, then their numbers. ``spread`` deals rows to parts."""
    part = ((spread >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((*rows.T[::-1], part))
    rows, n, part = rows[order], n[order], part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for start, end in zip(starts, [*starts[1:], len(part)]):
        planes = [np.ascontiguousarray(c[start:end]).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (*rows.T, n)]
        packed = pa.compress(b"".join(planes), codec="zstd", asbytes=True)
        columns = [pa.array([int(part[start])], pa.int32()), pa.array([int(end - start)], pa.int32()), pa.array([packed], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "rows", "packed"])


def unpack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, numbers) of each part, equal keys added up, in order."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for part, rows, packed in zip(*(b[c].to_pylist() for c in ("part", "rows", "packed"))):
            held.setdefault(part, []).append((rows, packed))
    for part in sorted(held):
        blocks = []
        for rows, packed in held.pop(part):
            planes = np.frombuffer(pa.decompress(packed, decompressed_size=rows * 8 * (width + 1), codec="zstd", asbytes=True), dtype=np.uint8)
            blocks.append(np.ascontiguousarray(planes.reshape(width + 1, 8, rows).transpose(2, 0, 1)).view(np.uint64)[:, :, 0])
        every = np.concatenate(blocks)
        every = every[_in_order(every[:, :width])]
        starts = np.flatnonzero(np.append(True, (every[1:, :width] != every[:-1, :width]).any(axis=1)))
        yield every[starts, :width], np.add.reduceat(every[:, width], starts).astype(np.int64)


def _turned(key: np.ndarray) -> np.ndarray:
    return (key << np.uint64(21)) | (key >> np.uint64(43))


def dealt(sent: DataFrame, parts: int) -> DataFrame:
    return sent.repartition(parts, "part")


def count_pairs(docs: DataFrame, words: Filter, keys: Keys, parts: int, least: int = LEAST) -> DataFrame:
    """(k1, k2, n) of all pairs found ``least`` times or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, known, numbers in word_blocks(batches):
            key = keys.of(lang, known)
            may = words.has(_place_of(key)) & (key != 0)
            ok = may[numbers]
            rows, n = _merged(key, [numbers[:-1], numbers[1:]], np.flatnonzero(ok[:-1] & ok[1:]))
            yield from pack(rows, n, rows[:, 0] ^ _turned(rows[:, 1]), parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in unpack(batches, 2):
            rows, n = rows[n >= least].view(np.int64), n[n >= least]
            yield from slices(iter([pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(n)], ["k1", "k2", "n"])]), 65536)

    return dealt(docs.mapInArrow(send, PACKED), parts).mapInArrow(add, "k1 bigint, k2 bigint, n bigint")


def pointers(docs: DataFrame, words: Filter, pairs: Filter, hot: set[tuple[int, int]], keys: Keys, parts: int) -> DataFrame:
    """Occurrences of pairs that may be frequent, with the next word and the one after it (0: it can't matter), packed by prefix."""
    firsts = np.array(sorted({a for a, _ in hot}), dtype=np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, known, numbers in word_blocks(batches):
            key = keys.of(lang, known)
            may = words.has(_place_of(key)) & (key != 0)
            ok = may[numbers]
            two = np.zeros(len(numbers), dtype=bool)
            at = np.flatnonzero(ok[:-1] & ok[1:])
            two[at] = pairs.has(_place_of(key[numbers[at]], key[numbers[at + 1]]))
            next_ = np.append(numbers, [0, 0, 0])
            fourth = np.where(np.append(two[2:], [False, False]), next_[3:], 0)
            rows, n = _merged(key, [numbers, next_[1:-2], next_[2:-1], fourth], np.flatnonzero(two[:-1] & two[1:]))
            spread = rows[:, 0] ^ _turned(rows[:, 1])
            some = np.flatnonzero(np.isin(rows[:, 0], firsts))
            some = some[[x in hot for x in zip(rows[some, 0].tolist(), rows[some, 1].tolist())]]
            spread[some] ^= _turned(_turned(rows[some, 2])) ^ _turned(_turned(_turned(rows[some, 3])))
            yield from pack(rows, n, spread, parts)

    return docs.mapInArrow(send, PACKED)


def grow(rows: np.ndarray, n: np.ndarray, depth: int, start: int, end: int, least: int, whole: bool) -> Iterator[tuple[int, int, int]]:
    """(row, words, support) of the patterns grown from a projection, the rows from ``start`` to ``end``, alike in ``depth`` words.

    A pattern of three words of a prefix that isn't here as a ``whole`` is told however little support it has here.
    """
    runs = start + np.flatnonzero(np.append(True, rows[start + 1 : end, depth] != rows[start : end - 1, depth]))
    supports = np.add.reduceat(n[start:end], runs - start)
    for run, stop, support in zip(runs.tolist(), [*runs[1:].tolist(), end], supports.tolist()):
        if not rows[run, depth]:
            continue
        if support >= least or not whole and depth == 2:
            yield run, depth + 1, support
        if support >= least and depth + 1 < LONGEST:
            yield from grow(rows, n, depth + 1, run, stop, least, whole)


def grown_patterns(sent: DataFrame, hot: set[tuple[int, int]], parts: int, least: int = LEAST) -> DataFrame:
    """(k1 to k4, n) of all patterns of three and four words found ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in unpack(batches, LONGEST):
            starts = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            support = np.add.reduceat(n, starts)
            found: list[tuple[int, int, int]] = []
            for start, end, s in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], support.tolist()):
                whole = (int(rows[start, 0]), int(rows[start, 1])) not in hot
                if s >= least or not whole:
                    found += grow(rows, n, 2, start, end, least, whole)
            at, words, supports = (np.array(c, dtype=np.int64) for c in zip(*found)) if found else [np.zeros(0, dtype=np.int64)] * 3
            columns = [pa.array(np.where(words > k, rows[at, k], np.uint64(0)).view(np.int64)) for k in range(LONGEST)]
            yield from slices(iter([pa.RecordBatch.from_arrays([*columns, pa.array(supports)], [*KEYS, "n"])]), 65536)

    grown = dealt(sent, parts).mapInArrow(run, ", ".join(f"{k} bigint" for k in KEYS) + ", n bigint")
    return grown.groupBy(*KEYS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grams, words, totals): k1 to k4, m and n of all phrases of up to four words found ``least`` times or more; key, lang, word; lang, total."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = settle(count_words(texts).where(F.col("word").isNull() | (F.col("n") >= least)))
    totals = counted.where("word is null").select("lang", F.col("n").alias("total"))
    every = totals.agg(F.sum("total")).first()[0] or 0
    keys = keys_of(counted.where("word is not null"))
    words = counted.where("word is not null").select(keys.column("lang", "word").alias("key"), "lang", F.col("word").cast("string").alias("word"), "n")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), every // PART + 1)
    may_word = Filter(words, "key")
    pairs = settle(count_pairs(texts, may_word, keys, parts, least))
    hot = {(r["k1"] % (1 << 64), r["k2"] % (1 << 64)) for r in pairs.where(F.col("n") > every // HOT).select("k1", "k2").collect()}
    grown = grown_patterns(pointers(texts, may_word, Filter(pairs, "k1", "k2"), hot, keys, parts), hot, parts, least)
    none = F.lit(0).cast("bigint")
    ones = words.select(F.col("key").alias("k1"), none.alias("k2"), none.alias("k3"), none.alias("k4"), "n")
    twos = pairs.select("k1", "k2", none.alias("k3"), none.alias("k4"), "n")
    length = F.lit(1) + sum((F.col(k) != 0).cast("int") for k in KEYS[1:])
    return settle(ones.unionByName(twos).unionByName(grown).select(*KEYS, length.alias("m"), "n")), words, totals


def _part(start: Column | int, length: Column | int) -> Column:
    """Keys of a part of a phrase, as grams have them."""
    ks = F.array(*KEYS)
    return F.struct(*(F.when(F.lit(k) < length, F.get(ks, start + k)).otherwise(F.lit(0).cast("bigint")).alias(name) for k, name in enumerate(KEYS)))


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``kept`` phrases of each language by score, a, phrase."""
    grams, words, totals = counts(docs, least)
    cand = grams.where("m > 1")
    # the cut with the lowest score
    cuts = cand.select(*KEYS, F.col("n").alias("a"), "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("cut"))
    cuts = cuts.select(*KEYS, "a", "cut", _part(F.lit(0), F.col("cut")).alias("first"), _part(F.col("cut"), F.col("m") - F.col("cut")).alias("rest"))

    def looked_up(df: DataFrame, what: str, name: str) -> DataFrame:
        known = grams.select(*(F.col(k).alias(f"g{k}") for k in KEYS), F.col("n").alias(name))
        return df.join(known, [F.col(f"{what}.{k}") == F.col(f"g{k}") for k in KEYS]).drop(*(f"g{k}" for k in KEYS), what)

    cuts = looked_up(looked_up(cuts, "first", "l"), "rest", "r")
    score = F.expr(f"div(cast({SCALE} as decimal(10, 0)) * cast(a as decimal(19, 0)), cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))").cast("bigint")
    scored = cuts.groupBy(*KEYS).agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    # candidates that a longer one covers
    inside = cand.where("m > 2").select("n", "m", *KEYS, F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("of"))
    inside = inside.select("n", "m", *KEYS, "of", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("of"))).alias("start"))
    inside = inside.select("n", _part(F.col("start"), F.col("of")).alias("p")).groupBy(*(F.col(f"p.{k}").alias(k) for k in KEYS)).agg(F.max("n").alias("longer"))
    left = scored.join(inside, KEYS, "left").where(F.coalesce(F.lit(100).cast("decimal(10,0)") * F.col("longer") < F.lit(covered).cast("decimal(10,0)") * F.col("a"), F.lit(True)))
    spelled = settle(left.select(*KEYS, "a", "x.l", "x.r", "x.score"))
    for k in KEYS:
        named = words.select(F.col("key").alias(k), F.col("word").alias(f"w_{k}"), *(["lang"] if k == "k1" else []))
        spelled = joined_small(spelled, named, k)
    phrase = F.concat_ws(" ", *(f"w_{k}" for k in KEYS))
    spelled = joined_small(spelled.select("lang", phrase.alias("phrase"), "a", "l", "r", "score"), totals, "lang", "inner")
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = spelled.withColumn("rank", best).where(F.col("rank") <= kept)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, m, ws[i:i + m - 1] AS g, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) ms WHERE len(ws) >= m)
  GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, m, g, f AS a FROM grams WHERE m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.m, c.g, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[c.k + 1:c.m]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[s:s + o - 1] AS g, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - o + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS o FROM cand WHERE m > 2)) GROUP BY ALL),
ranked AS (
  SELECT l.lang, array_to_string(l.g, ' ') AS phrase, l.a, l.l, l.r, l.score,
    row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, encode(array_to_string(l.g, ' '))) AS rank
  FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.g = l.g WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * l.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
