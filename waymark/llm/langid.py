"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones. A trigram is the product of its
letters' vectors, the first rotated twice and the second once; a text is the sum of its
trigrams, a language the sum of its training texts. A text gets the language whose
prototype is at the least angle.

Every letter of Unicode is a sign of its own, whose vector comes from a hash of its code
point, and each run of anything else is one sign. Trigrams are counted sparsely by
language, in each task before they are shuffled, and summed to vectors on executors; the
driver gets one vector of each language and task.

Nulls: a null text has no letter and is ``und`` with score 0; rows with a null language
aren't learned from; a null doc_id counts as the empty string in the split. Without any
training text every document is ``und``. Repeated rows count once each. An empty table
gives an empty result. Other columns are ignored. Long texts are taken in pieces of
2**20 characters that overlap, so no trigram is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import documents, slices

DIMENSIONS = 1024
#: Bits of a sign in a trigram: code points are below 2**21.
BITS = 21
SEED = 11
PIECE = 1 << 20
FOLDS, HELD_OUT = 4, 2
#: Texts, and trigrams, that are turned to vectors together.
TOGETHER = 256
GRAMS = 1 << 20
#: Trigrams that a task counts before it hands them on.
FLUSH = 1 << 22
#: Tasks that sum vectors.
SUMS = 32


def split(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return documents(docs, F.col("lang").cast("string").alias("lang")).withColumn("held_out", fold == HELD_OUT)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def is_letter(points: np.ndarray) -> np.ndarray:
    return np.array([chr(p).isalpha() for p in points.tolist()], dtype=bool)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.where(is_letter(np.arange(0x110000)), np.arange(0x110000), 0).astype(np.int32)


def sign_table(letters: np.ndarray | None = None) -> np.ndarray:
    """Sign of every code point: 0 for no letter, else itself; if letters are given, 1 for all others."""
    table = _letters()
    if letters is None:
        return table
    return np.where(np.isin(table, letters), table, (table > 0).astype(np.int32))


def trigrams(text: str, table: np.ndarray) -> Iterator[np.ndarray]:
    """The trigrams of a text, piece by piece; none without a letter."""
    carry = np.zeros(1, np.int64)
    letters = False
    for at in range(0, len(text), PIECE):
        points = code_points(text[at : at + PIECE])
        signs = table[points].astype(np.int64)
        if at + PIECE >= len(text):
            signs = np.append(signs, 0)
        signs = np.concatenate((carry, signs))
        signs = signs[np.concatenate(([True], (signs[1:] != 0) | (signs[:-1] != 0)))]
        letters = letters or bool(signs.any())
        if letters and len(signs) > 2:
            yield (signs[:-2] << 2 * BITS) | (signs[1:-1] << BITS) | signs[2:]
        carry = signs[-2:]


def sign_vectors(signs: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """(signs, dimensions) of plus and minus one, by a hash (the finaliser of SplitMix64) of the sign and of the place."""
    words = -(-dimensions // 64)
    x = (signs.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(SEED << 32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """(grams, dimensions) of plus and minus one."""
    low = (1 << BITS) - 1
    signs, at = np.unique(np.stack((grams >> 2 * BITS, (grams >> BITS) & low, grams & low)), return_inverse=True)
    at = at.reshape(3, -1)
    base = sign_vectors(signs, dimensions)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    return (first[at[0]] * second[at[1]] * base[at[2]]).astype(np.float32)


def prototypes(train: DataFrame, table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes at unit length."""
    sent = train.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        size = 0
        for b in slices(batches):
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist()):
                for grams in trigrams(text, sent.value):
                    held.setdefault(lang, []).append(grams)
                    size += len(grams)
                    if size > FLUSH:
                        yield from out()
                        size = 0
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        total: dict[str, int] = {}
        for b in slices(batches, 4096):
            lang, gram, n = np.array(b["lang"].to_pylist(), dtype=object), b["gram"].to_numpy(), b["n"].to_numpy()
            for g in set(lang):
                of = lang == g
                # whole numbers, so their order makes no difference
                sums[g] = sums.get(g, 0) + n[of].astype(np.float64) @ vectors(gram[of])
                total[g] = total.get(g, 0) + int(n[of].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "n", "v"])

    counted = train.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.repartition(SUMS, "gram").mapInArrow(add, "lang string, n bigint, v array<double>").toArrow().to_pydict()
    langs = sorted(set(found["lang"]))
    sums, total = np.zeros((len(langs), DIMENSIONS)), np.zeros(len(langs))
    for lang, n, v in zip(found["lang"], found["n"], found["v"]):
        sums[langs.index(lang)] += v
        total[langs.index(lang)] += n
    sums /= np.maximum(total, 1)[:, None]
    # what all languages share tells none apart
    sums -= sums.mean(axis=0) if len(langs) > 1 else 0
    return langs, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, at least 0) and margin over the next language."""
    own = split(docs)
    train = own.where(~F.col("held_out") & F.col("lang").isNotNull())
    table = sign_table()
    langs, known = prototypes(train, table)
    sent = docs.sparkSession.sparkContext.broadcast((table, langs, known.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, langs, known = sent.value
        for b in slices(batches):
            texts = b["text"].to_pylist()
            pred, score, margin = [], [], []
            at = 0
            while at < len(texts):
                grams, n = [], 0
                while at < len(texts) and len(grams) < TOGETHER and n < GRAMS:
                    grams.append(list(trigrams(texts[at], table)))
                    n += sum(map(len, grams[-1]))
                    at += 1
                flat = np.concatenate([np.zeros(0, np.int64), *(g for parts in grams for g in parts)])
                gram, place = np.unique(flat, return_inverse=True)
                # counts of (text, trigram), by trigrams
                cell, n = np.unique(place * len(grams) + np.repeat(np.arange(len(grams)), [sum(map(len, parts)) for parts in grams]), return_counts=True)
                bounds = np.searchsorted(cell, np.arange(0, len(gram) + 4096, 4096) * len(grams))
                bundled = np.zeros((len(grams), known.shape[1]), dtype=np.float32)
                for k, (a, b_) in enumerate(zip(bounds, bounds[1:])):
                    some = gram[k * 4096 : (k + 1) * 4096]
                    counts = np.zeros((len(grams), len(some)), dtype=np.float32)
                    counts[cell[a:b_] % len(grams), cell[a:b_] // len(grams) - k * 4096] = n[a:b_]
                    bundled += counts @ vectors(some)
                size = np.linalg.norm(bundled, axis=1)
                cosines = bundled @ known.T / np.maximum(size, 1e-12)[:, None]
                for k, parts in enumerate(grams):
                    if not parts or not langs:
                        pred.append("und")
                        score.append(0.0)
                        margin.append(0.0)
                        continue
                    order = np.argsort(-cosines[k], kind="stable")
                    pred.append(langs[order[0]])
                    score.append(float(min(1.0, max(0.0, cosines[k][order[0]]))))
                    margin.append(float(cosines[k][order[0]] - cosines[k][order[1]]) if len(order) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "margin"],
            )

    return own.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, margin double")
