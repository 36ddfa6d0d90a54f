"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's chance is logistic in its distinct words and in the first four and five
letters of longer ones; a document's is the noisy-or of its
sentences' (one less the product of their complements). Only documents have labels; the
gradient of their likelihood through the noisy-or trains the sentences, so the model also
tells which sentences made a document toxic.

The model is fitted on the driver on at most ``SAMPLE`` labelled documents of each label,
those with the least hash of their id, on their whole texts; its words are at most
``WORDS``, those whose presence tells the labels apart best. They are counted on
executors, and the driver gets the places of those words in sentences, not the texts.
Scoring takes all texts whole too.

Nulls: a null text has no sentence and scores 0; labels with a null toxic don't count, of
several labels for one id the highest does; a null doc_id counts as the empty string in
the split and has no label. Without labels of both kinds every document scores 0. Repeated
rows are scored once each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import documents, settle, slices

SAMPLE = 3000
WORDS = 3000
#: Largest bias: a thousand sentences without a known word make a third of a per cent at most.
CALM = -12.5
FOLDS, HELD_OUT = 5, 0
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(words: set[str]) -> set[str]:
    """The words, and the beginnings of longer ones, marked by a star."""
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


def fold(column: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of the documents to fit on, whole."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(fold() != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    return settle(documents(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"))


def sentences(text: str) -> Iterator[set[str]]:
    """The distinct words of each sentence that has any."""
    for s in _SENTENCE.finditer(text):
        words = {w.lower() for w in _WORD.findall(s.group())}
        if words:
            yield words


def vocabulary(texts: DataFrame, total: dict[int, int]) -> list[str]:
    """The words whose presence in a document says most about its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            for toxic, text in zip(b["toxic"].to_pylist(), b["text"].to_pylist()):
                words = sorted(features(set().union(*sentences(text))))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(words), pa.int32()), pa.array(words, pa.string())], ["toxic", "word"])

    seen = texts.mapInArrow(run, "toxic int, word string").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    p, q, r = F.col("a") / max(total[1], 1), F.col("b") / max(total[0], 1), (F.col("a") + F.col("b")) / sum(total.values())
    said = F.abs(p - q) / F.sqrt(r * (1 - r) + 1e-6)
    return [x["word"] for x in seen.where("a + b >= 5").orderBy(said.desc(), "word").limit(WORDS).select("word").collect()]


def hits(texts: DataFrame, words: list[str]) -> pa.Table:
    """(doc_id, toxic, blank, sizes, hits): sentences without any of the words, and of each other one how many and which it has."""
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: k for k, w in enumerate(sent.value)}
        for b in slices(batches, 16):
            blank, sizes, found = [], [], []
            for text in b["text"].to_pylist():
                by = [sorted(at[w] for w in features(s) if w in at) for s in sentences(text)]
                blank.append(sum(not x for x in by))
                sizes.append([len(x) for x in by if x])
                found.append([k for x in by for k in x])
            columns = [b["doc_id"], b["toxic"], pa.array(blank, pa.int64()), pa.array(sizes, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "blank", "sizes", "hits"])

    return texts.mapInArrow(run, "doc_id bigint, toxic int, blank bigint, sizes array<int>, hits array<int>").toArrow()


def fit(texts: DataFrame, rounds: int = 500, decay: float = 0.02) -> tuple[dict[str, float], float]:
    """Weight of each word, and the bias of a sentence."""
    total = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total[0] or not total[1]:
        return {}, -40.0
    words = vocabulary(texts, total)
    rows = hits(texts, words)
    size, which = ([x.values.to_numpy() for x in rows[c]] for c in ("sizes", "hits"))
    docs = rows["doc_id"].to_pylist()
    order = sorted(range(len(docs)), key=lambda k: (docs[k], size[k].tobytes(), which[k].tobytes()))
    labels = rows["toxic"].to_numpy()[order].astype(np.float64)
    blank = rows["blank"].to_numpy()[order].astype(np.float64)
    size, which = [size[k] for k in order], [which[k] for k in order]
    word = np.concatenate(which).astype(int)
    bag = np.repeat(np.arange(len(order)), [len(x) for x in size])
    sentence = np.repeat(np.arange(len(bag)), np.concatenate(size))
    weight, bias = np.zeros(len(words)), CALM
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    first, second = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, weight[word], minlength=len(bag))
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(bag, -np.logaddexp(0, z), minlength=len(labels)) - blank * np.logaddexp(0, bias)  # log of no sentence being toxic
        some = -np.expm1(none)
        # derivative of the log-likelihood by each sentence's z
        pull = np.where(labels == 1, np.exp(none) / np.maximum(some, 1e-9), -1.0) * balance
        by_sentence = pull[bag] * p
        grad = np.append(np.bincount(word, by_sentence[sentence], minlength=len(words)), by_sentence.sum() + (pull * blank).sum() / (1 + np.exp(-bias))) / len(labels)
        grad[:-1] -= decay / len(labels) * weight
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weight += move[:-1]
        bias = min(bias + move[-1], CALM)
    return dict(zip(words, weight.tolist())), float(bias)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (start, end and chance of sentences from a half on)."""
    weights, bias = fit(sample(docs, labels))
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))
    own = documents(docs).withColumn("held_out", fold() == HELD_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        whole = {w: x for w, x in weights.items() if not w.endswith("*")}
        four, five = ({w[:-1]: x for w, x in weights.items() if w.endswith("*") and len(w) == n} for n in (5, 6))
        none = float(np.logaddexp(0, bias))
        for b in slices(batches):
            scores, spans = [], []
            for text in b["text"].to_pylist():
                free, found = 0.0, []
                for s in _SENTENCE.finditer(text):
                    words = {w.lower() for w in _WORD.findall(s.group())}
                    hit = [whole[w] for w in words if w in whole]
                    hit += [four[w] for w in {w[:4] for w in words if len(w) > 4} if w in four]
                    hit += [five[w] for w in {w[:5] for w in words if len(w) > 5} if w in five]
                    if not hit:
                        free -= none
                        continue
                    z = bias + math.fsum(hit)
                    free -= float(np.logaddexp(0, z))
                    if z >= 0:
                        found.append({"start": s.start(), "end": s.end(), "chance": float(1 / (1 + np.exp(-z)))})
                scores.append(float(min(1.0, max(0.0, -np.expm1(free)))))
                spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "held_out", "score", "offending"]
            )

    found = own.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, offending array<struct<start: int, end: int, chance: double>>")
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "offending")
