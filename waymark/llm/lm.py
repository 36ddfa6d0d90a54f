"""Language-model scores by deleted interpolation.

The chance of a word mixes maximum-likelihood estimates of the word after the two words
before it, and after the one before it, over all words and all training documents, with
a class model that knows every word: a word is one of ``CLASSES`` frequent words, each a
class of its own, or of the class of all others; the chance of a class after a class
mixes estimates of the pair, of the class alone and the uniform one; the chance of a word
in the common class mixes its share of the class and the uniform one over all known words
and one unknown. The weights depend on how often the context was seen, by powers of two,
and are learned by expectation-maximisation on counts of one part of the training
documents that the estimates leave out (the deleted part); then the estimates take all
parts back. The sum over all words is one after every context.

All counts cover all training documents. Documents lie in chunks of about ``CHUNK``
characters. A chunk sends each different word, pair and triple of words once, by a hash
and with its number, to the task that counts this hash, and gets the counts of the corpus
back; so no n-gram is too rare to count, and a frequent one is sent once a chunk. Words
and pairs are counted first and triples after them, so that only one part of what is sent
lies on disk at a time. Words have hashes of 64 bits; pairs and triples have 20 bits more
than it takes to number them, so that one in a million shares another's count. What goes
to every executor is a matrix of ``CLASSES`` squared.

Nulls: a null text is empty and has the end mark only; a null doc_id counts as the empty
string in the split. Repeated rows are scored and counted once each. An empty table gives
an empty result; without any training token all words are unknown. Other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import documents, release, settle, shuffles_removed, slices

HEAD = 1 << 17
CLASSES = 512
#: The end of a document among the words; no word holds white space.
END = b"\n"
#: Different words that a task counts before it hands them on.
FLUSH = 400_000
FOLDS, HELD_OUT, DELETED = 7, 2, 3
WORDS, PAIRS, TRIPLES = 0, 1, 2
#: Characters of documents that send their n-grams together, and tokens whose n-grams a task counts together.
CHUNK = 1 << 22
PART = 1 << 20
#: Estimates are graded so many times a power of ten where the weights are learned, which bounds what the driver gets.
GRADES = 4
START = np.uint64(0x9E3779B97F4A7C15)


def split(docs: DataFrame) -> DataFrame:
    """Documents with their fold: 2 is held out of everything, 3 is the deleted part of training."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return documents(docs).withColumn("fold", fold.cast("int"))


def word_counts(lots: DataFrame) -> DataFrame:
    """(word, n, deleted): tokens in training, and those of them in the deleted part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = list(n)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([deleted[w] for w in words], pa.int64())],
                ["word", "n", "deleted"],
            )

        n: Counter[bytes] = Counter()
        deleted: Counter[bytes] = Counter()
        for b in slices(batches, 1):
            _, _, ids, names = opened(b["payload"][0].as_py())
            found = dict(zip(names, np.bincount(ids, minlength=len(names)).tolist()))
            n.update(found)
            if b["deleted"][0].as_py():
                deleted.update(found)
            if len(n) > FLUSH:
                yield out()
                n.clear()
                deleted.clear()
        yield out()

    part = lots.where("not held_out").select("deleted", "payload")
    return part.mapInArrow(run, "word binary, n bigint, deleted bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("deleted").alias("deleted"))


def frequent(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, n) of the words from some count on, at most ``most`` of them, the most frequent first.

    The count comes from a histogram by eighths of a power of two, so nothing is sorted
    and no task hands on more than it must. Fewer than ``most`` words are all returned.
    """
    step = F.floor(8 * F.log2(F.greatest("n", F.lit(1)))).cast("int")
    histogram = {r["step"]: r["words"] for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    least, total = None, 0
    for s in sorted(histogram, reverse=True):
        total += histogram[s]
        if total > most:
            break
        least = s
    if least is None:
        return []
    found = words.where(step >= least).select("word", "n").toArrow()
    return sorted(zip(map(bytes, found["word"].to_pylist()), found["n"].to_pylist()), key=lambda x: (-x[1], x[0]))


def class_pairs(lots: DataFrame, classes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (context, class) in training and in its deleted part; the last context is the start."""
    k = len(classes)
    shape = (k + 2, k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, shape[0] * shape[1]), dtype=np.int64)
        for b in slices(batches, 1):
            _, begin, ids, names = opened(b["payload"][0].as_py())
            kind = np.array([classes.get(w, k) for w in names])[ids]
            context = np.append(0, kind[:-1])
            context[begin] = k + 1
            total[int(b["deleted"][0].as_py())] += np.bincount(context * (k + 1) + kind, minlength=total.shape[1])
        cell = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[0][cell]), pa.array(total[1][cell])], ["cell", "kept", "deleted"])

    part = lots.where("not held_out").select("deleted", "payload")
    counts = part.mapInArrow(run, "cell bigint, kept bigint, deleted bigint").groupBy("cell").agg(F.sum("kept").alias("kept"), F.sum("deleted").alias("deleted"))
    found = counts.toPandas()
    out = np.zeros((2, shape[0] * shape[1]))
    out[0, found["cell"]] = found["kept"]
    out[1, found["cell"]] = found["deleted"]
    return out[0].reshape(shape), out[1].reshape(shape)


def bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(int)


def learn(estimates: list[np.ndarray], held: np.ndarray, buckets: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (bucket, estimate) that make the held-out counts likeliest, by expectation-maximisation.

    Arrays are (context, outcome), ``buckets`` is by context. Buckets without counts take
    the weights of all counts together.
    """
    stack = np.stack([np.broadcast_to(e, held.shape) for e in estimates], axis=-1)

    def fit(rows: np.ndarray) -> np.ndarray:
        w = np.full(len(estimates), 1 / len(estimates))
        seen = held[rows] > 0
        e, n = stack[rows][seen], held[rows][seen]
        for _ in range(rounds if n.size else 0):
            share = e * w
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            w = (share * n[:, None]).sum(axis=0)
            w = (w + 1e-3) / (w.sum() + 1e-3 * len(w))  # no weight ever vanishes
        return w

    every = fit(np.arange(len(held)))
    out = np.tile(every, (64, 1))
    for b in np.unique(buckets):
        rows = np.flatnonzero(buckets == b)
        if held[rows].sum() > 0:
            out[b] = fit(rows)
    return out


def _estimates(pairs: np.ndarray) -> list[np.ndarray]:
    context, single = pairs.sum(axis=1, keepdims=True), pairs.sum(axis=0, keepdims=True)
    return [pairs / np.maximum(context, 1), single / max(single.sum(), 1), np.full((1, pairs.shape[1]), 1 / pairs.shape[1])]


def class_chances(kept: np.ndarray, deleted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each class after each context, by the kept part alone and by all training documents."""
    weights = learn(_estimates(kept), deleted, bucket(kept.sum(axis=1)))

    def mixed(pairs: np.ndarray) -> np.ndarray:
        at = weights[bucket(pairs.sum(axis=1))]
        return sum(at[:, [k]] * e for k, e in enumerate(_estimates(pairs)))

    return mixed(kept), mixed(kept + deleted)


def class_model(kept: np.ndarray, deleted: np.ndarray) -> np.ndarray:
    """log10 of the chance of each class after each context."""
    return np.log10(class_chances(kept, deleted)[1])


def word_weight(histogram: list[tuple[float, float]], size: float, known: int) -> float:
    """Weight of the maximum-likelihood share among the common class: histogram of (kept count, deleted tokens)."""
    counts = np.array([h[0] for h in histogram] or [0.0])
    held = np.array([h[1] for h in histogram] or [0.0])
    estimates = [(counts / max(size, 1))[None, :], np.full((1, len(counts)), 1 / (known + 1))]
    return float(learn(estimates, held[None, :], np.array([0]))[0, 0])


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed; the length first."""
    raw = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(payload: bytes, kind: type) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(payload[8:], int.from_bytes(payload[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def chunks(own: DataFrame) -> DataFrame:
    """(chunk, kind, deleted, held_out, payload): words of documents of one part of the split, numbered in the chunk; kind is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int) -> pa.RecordBatch:
            docs, begin, ids, at = held.pop(kind)
            size.pop(kind)
            # numbers by planes of bytes take a quarter less than zstd makes of them as they are
            columns = {"doc_id": ([docs], pa.list_(pa.int64())), "words": ([b"".join(at)], pa.large_binary())}
            columns |= {c: ([packed(np.array(x, dtype=np.int32))], pa.binary()) for c, x in (("begin", begin), ("ids", ids), ("sizes", [len(w) for w in at]))}
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns.values()], list(columns))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            columns = [pa.array([kind == DELETED]), pa.array([kind == HELD_OUT]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["deleted", "held_out", "payload"])

        held: dict[int, tuple[list, list, list, dict[bytes, int]]] = {}
        size: Counter[int] = Counter()
        for b in slices(batches):
            for doc, fold, text in zip(*(b[c].to_pylist() for c in ("doc_id", "fold", "text"))):
                kind = fold if fold in (DELETED, HELD_OUT) else -1
                docs, begin, ids, at = held.setdefault(kind, ([], [], [], {}))
                docs.append(doc)
                begin.append(len(ids))
                tokens = text.encode().lower().split()
                tokens.append(END)
                ids += [at.setdefault(w, len(at)) for w in tokens]
                size[kind] += len(text) + 1
                if size[kind] >= CHUNK:
                    yield out(kind)
        for kind in list(held):
            yield out(kind)

    found = own.select("doc_id", "fold", "text").mapInArrow(run, "deleted boolean, held_out boolean, payload binary")
    return found.select(F.monotonically_increasing_id().alias("chunk"), F.lit(-1).alias("kind"), "deleted", "held_out", "payload")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def opened(payload: bytes) -> tuple[list, np.ndarray, np.ndarray, list[bytes]]:
    """(doc_ids, first token of each document, number of each token's word, different words) of a chunk."""
    batch = pa.ipc.open_stream(payload).read_next_batch()
    begin, ids, sizes = (unpacked(batch[c][0].as_py(), np.int32) for c in ("begin", "ids", "sizes"))
    words, ends = batch["words"][0].as_py(), np.cumsum(sizes, dtype=np.int64)
    return batch["doc_id"][0].as_py(), begin, ids, [words[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def keys_of(begin: np.ndarray, ids: np.ndarray, names: list[bytes], bits: int, kinds: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of ``kinds`` (words, pairs, triples): its different keys, ascending, and the place of each token's key among them.

    Words have keys of 64 bits, pairs and triples of ``bits``.
    """
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in names], dtype=np.uint64)
    found = {}
    if WORDS in kinds:
        words, at = np.unique(hashed, return_inverse=True)
        found[WORDS] = words, at[ids]
    word = hashed[ids]
    before = np.concatenate(([START], word[:-1]))
    before[begin] = START
    pair = _mixed(before, word)
    if PAIRS in kinds:
        found[PAIRS] = np.unique(pair >> np.uint64(64 - bits), return_inverse=True)
    if TRIPLES in kinds:
        last = np.concatenate(([START], pair[:-1]))
        last[begin] = START
        found[TRIPLES] = np.unique(_mixed(last ^ np.uint64(0x5851F42D4C957F2D), word) >> np.uint64(64 - bits), return_inverse=True)
    return [found[k] for k in kinds]


def key_bits(total: int) -> int:
    """Bits of a key, so that of the pairs of ``total`` tokens one in a million meets another's key, and of the triples."""
    return min(64, max(32, (int(total) + 1).bit_length() + 20))


def bounds(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Ascending keys lie by parts, each a range of keys; part p from bounds[p] to bounds[p + 1]."""
    edges = np.array([-(-(p << bits) // parts) for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def counted(lots: DataFrame, parts: int, bits: int, kinds: tuple[int, ...]) -> DataFrame:
    """(chunk, kind, part, deleted, counts): counts in the kept and in the deleted part of the keys of a kind that a chunk has in a part."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            chunk, deleted, held = (b[c][0].as_py() for c in ("chunk", "deleted", "held_out"))
            for kind, (keys, place) in zip(kinds, keys_of(*opened(b["payload"][0].as_py())[1:], bits, kinds)):
                n = np.bincount(place, minlength=len(keys)).astype(np.uint32) * np.uint32(not held)
                edges = bounds(keys, parts, 64 if kind == WORDS else bits)
                some = [p for p in range(parts) if edges[p + 1] > edges[p]]
                # keys of a part ascend, and so differ by less than they are
                packs = [
                    [packed(np.diff(keys[edges[p] : edges[p + 1]], prepend=np.uint64(0))) for p in some],
                    [packed(n[edges[p] : edges[p + 1]]) for p in some],
                ]
                columns = [pa.array([x] * len(some), t) for x, t in ((chunk, pa.int64()), (kind, pa.int32()), (deleted, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in packs)], ["chunk", "kind", "deleted", "part", "keys", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        for kind in kinds:
            own = [r for r in rows if r["kind"] == kind]
            if not own:
                continue
            keys = [np.cumsum(unpacked(r.pop("keys"), np.uint64), dtype=np.uint64) for r in own]
            n = np.concatenate([unpacked(r.pop("n"), np.uint32) for r in own])
            sizes = [len(k) for k in keys]
            different, place = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            late = np.repeat([r["deleted"] for r in own], sizes)
            sums = np.stack([np.bincount(place, np.where(late == d, n, 0), minlength=len(different)).astype(np.uint32) for d in (False, True)])
            ends = np.cumsum(sizes)
            found = [packed(sums[:, place[e - m : e]].ravel()) for e, m in zip(ends, sizes)]
            for a in range(0, len(own), 256):
                some = own[a : a + 256]
                columns = [pa.array([r[c] for r in some], t) for c, t in (("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("deleted", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found[a : a + 256], pa.binary())], ["chunk", "kind", "part", "deleted", "counts"])

    sent = lots.mapInArrow(send, "chunk bigint, kind int, deleted boolean, part int, keys binary, n binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(count, "chunk bigint, kind int, part int, deleted boolean, counts binary")


def with_counts(lots: DataFrame, counts: DataFrame, partitions: int) -> DataFrame:
    """Rows of chunks, each followed by its counts by kind and part."""
    rows = lots.select("chunk", "kind", "held_out", "payload").unionByName(counts.select("chunk", "kind", "part", "counts"), allowMissingColumns=True)
    return rows.repartition(partitions, "chunk").sortWithinPartitions("chunk", "kind", "part").select("kind", "held_out", "payload", "counts")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bytes, np.ndarray]]:
    """(held_out, documents, counts (kept or deleted, key) of all kinds in the order of ``keys_of``) of each chunk."""
    now: tuple[bool, bytes, list] | None = None

    def out() -> tuple[bool, bytes, np.ndarray]:
        return now[0], now[1], np.concatenate([unpacked(x, np.uint32).reshape(2, -1) for x in now[2]], axis=1).astype(np.int64)

    for b in batches:
        for r in b.to_pylist():
            if r["kind"] < 0:
                if now:
                    yield out()
                now = (r["held_out"], r["payload"], [])
            else:
                now[2].append(r["counts"])
    if now:
        yield out()


def context_bucket(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """By the count of the two words before, or of the one before if those two were never seen."""
    return np.where(two > 0, 24 + np.minimum(bucket(two), 39), np.minimum(bucket(one), 23))


def orders(counts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triple's share of its context, pair's share of its context, bucket) of tokens, by counts (word, pair, triple)."""
    word, pair, triple = counts
    end = np.append(begin[1:], len(word)) - 1
    one, two = np.append(0, word[:-1]), np.append(0, pair[:-1])
    one[begin], two[begin] = word[end], 0  # documents start as often as they end
    return np.where(two > 0, triple / np.maximum(two, 1), 0.0), pair / np.maximum(one, 1), context_bucket(one, two)


def order_weights(histogram: list[tuple[int, float, float, float, float]]) -> np.ndarray:
    """Weights (bucket; triple, pair, class model) from rows (bucket, estimates of the three, tokens); none of an order whose context wasn't seen."""
    rows = np.array(histogram or [(0, 0.0, 0.0, 1.0, 0.0)])
    weights = learn([rows[:, [k]] for k in (1, 2, 3)], rows[:, [4]], rows[:, 0].astype(int))
    weights[:25, 0] = 0
    weights[0, 1] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    lots = settle(chunks(split(docs)))
    with shuffles_removed(spark):
        words = settle(word_counts(lots))
    total, known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = frequent(words, HEAD)
    classes = {w: k for k, w in enumerate(dict.fromkeys([END, *(h[0] for h in head[: CLASSES - 1])]))}
    kept, deleted = class_pairs(lots, classes)
    chances = class_chances(kept, deleted)

    # the words of the common class: counts above 1,000 are rounded to three digits
    k = F.col("n") - F.col("deleted")
    step = F.when(k < 1000, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(k, F.lit(1)))) - 2))
    common = words.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in classes], "word binary")), "word", "left_anti")
    shares = common.groupBy((F.round(k / step) * step).alias("k")).agg(F.sum("deleted").alias("deleted"), F.sum(k).alias("size"), F.sum("n").alias("n")).collect()
    sizes = sum(r["size"] for r in shares), sum(r["n"] for r in shares)
    weight = word_weight([(r["k"], r["deleted"]) for r in shares if r["deleted"]], sizes[0], known)

    del words, common, k, step
    release(spark)
    parts = max(spark.sparkContext.defaultParallelism, int(total) // PART + 1)
    bits = key_bits(total)
    # one kind or two are counted at a time, so a task counts those of twice the tokens, and chunks send half the rows
    ranges = max(spark.sparkContext.defaultParallelism, int(total) // (2 * PART) + 1)
    with shuffles_removed(spark):
        counts = settle(counted(lots, ranges, bits, (WORDS, PAIRS))).unionByName(settle(counted(lots, ranges, bits, (TRIPLES,))))
    denominator = total + known + 1
    sent = spark.sparkContext.broadcast((classes, chances))

    def estimates(payload: bytes, found: np.ndarray, whole: bool) -> tuple:
        """(doc_ids, begin, counts of words, estimates of the three orders, buckets), by all training documents or by the kept ones."""
        classes, chances = sent.value
        docs, begin, ids, names = opened(payload)
        grams = keys_of(begin, ids, names, bits, (WORDS, PAIRS, TRIPLES))
        first = np.cumsum([0, *(len(keys) for keys, _ in grams[:-1])])
        place = np.stack([at + a for (_, at), a in zip(grams, first)])
        kind = np.array([classes.get(w, len(classes)) for w in names])[ids]
        n = (found.sum(axis=0) if whole else found[0])[place]
        context = np.append(0, kind[:-1])
        context[begin] = len(classes) + 1
        inside = np.where(kind == len(classes), weight / max(sizes[whole], 1) * n[0] + (1 - weight) / (known + 1), 1.0)
        triple, pair, at = orders(n, begin)
        return docs, begin, n[0], np.stack((triple, pair, chances[whole][context, kind] * inside)), at

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram: Counter[tuple] = Counter()
        for _, payload, found in gathered(batches):
            _, _, _, e, at = estimates(payload, found, False)
            steps = np.where(e > 0, np.round(GRADES * np.log10(np.maximum(e, 1e-30))), -999).astype(np.int64)
            cells, n = np.unique(np.concatenate((at[None], steps)), axis=1, return_counts=True)
            for cell, m in zip(cells.T.tolist(), n.tolist()):
                histogram[tuple(cell)] += m
        cells = list(histogram)
        columns = [pa.array([c[j] for c in cells], pa.int64()) for j in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(histogram.values(), pa.int64())], ["b", "e3", "e2", "e1", "n"])

    with shuffles_removed(spark):
        rows = with_counts(lots.where("deleted"), counts.where("deleted"), parts)
        cells = rows.mapInArrow(learned, "b bigint, e3 bigint, e2 bigint, e1 bigint, n bigint").groupBy("b", "e3", "e2", "e1").agg(F.sum("n").alias("n")).collect()
    weights = order_weights(sorted((r["b"], *(10.0 ** (r[c] / GRADES) if r[c] > -999 else 0.0 for c in ("e3", "e2", "e1")), r["n"]) for r in cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, payload, found in gathered(batches):
            docs, begin, n, e, at = estimates(payload, found, True)
            value = np.log10((weights[at].T * e).sum(axis=0))
            columns = [
                pa.array(docs, pa.int64()), pa.array([held] * len(docs), pa.bool_()), pa.array(np.diff(np.append(begin, len(n)))), pa.array(np.add.reduceat((n > 0).astype(np.int64), begin)),
                pa.array(np.full(len(docs), total, dtype=np.int64)), pa.array(np.add.reduceat(np.log10((n + 1) / denominator), begin)), pa.array(np.add.reduceat(value, begin)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_counts(lots, counts, parts).mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
