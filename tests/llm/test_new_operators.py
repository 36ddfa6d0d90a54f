"""Fill-in-middle, sharding and phrases against plain versions."""

import hashlib
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute, fixtures
from waymark.llm import fim, phrases, queries, sharding


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return fixtures.tables(spark, tmp_path_factory.mktemp("odd"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op11_odd_cases(spark, odd):
    got = Counter(tuple(r) for r in queries.op11_fim(spark, odd).collect())
    want = Counter()
    for d, t, *_ in fixtures.documents():
        n, form, pre, mid, out = brute.fim(d, t)
        want[d, n, form, pre, mid, sha(out), sha(t or "")] += 1
    assert got == want


def test_op11_rates_and_other_columns(spark):
    rows = [(i, f"a{i}\nb\nc\n\nd", "en", "a", 1) for i in range(400)]
    df = fixtures.frame(spark, rows)
    made = fim.restore(fim.transform(df, rate=50, spm=0).withColumn("restored", F.lit("odd")))
    found = made.collect()
    forms = Counter(r["form"] for r in found)
    assert set(forms) == {"plain", "psm"} and 150 < forms["plain"] < 250
    assert all(r["restored"] == rows[r["doc_id"]][1] for r in found)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n<PSM>é😀", max_size=60), st.integers(-5, 10**6), st.integers(1, 5))
def test_rope_splits_and_comes_back(text, doc_id, size):
    was, fim.LEAF = fim.LEAF, size
    try:
        n, form, pre, mid, out = fim.rearranged(text, doc_id)
        assert (n, form, pre, mid, out) == brute.fim(doc_id, text)
        assert fim.put_back(out, form) == text
        r = fim.rope(text)
        assert str(r) == text and r.points == len(text) and r.ends == text.count("\n")
        for rank in range(len(text) + 2):
            assert [str(x) for x in fim.split_points(r, rank)] == [text[:rank], text[rank:]]
    finally:
        fim.LEAF = was


def test_rope_of_a_long_text_is_flat():
    text = "".join(f"line {i}\n" for i in range(200_000))
    a, b = fim.split_lines(fim.rope(text), 123_456)
    assert str(a) == "".join(f"line {i}\n" for i in range(123_456)) and str(a) + str(b) == text


def test_op12_odd_cases(spark, odd):
    rows = queries.op12_sharding(spark, odd).collect()
    docs = fixtures.documents()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 8, crc32((t or "").encode())) for d, t, *_ in docs)
    of = defaultdict(set)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "key" and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
    assert all(len(x) == 1 for x in of.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op12_one_key_in_many_partitions(spark):
    rows = [(5 if i % 3 else i, "same" if i % 3 else f"text {i}", "en", "a", 4) for i in range(3000)]
    found = sharding.assign(fixtures.frame(spark, rows).repartition(7)).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert len(found) == 3000 and all(sorted(x) == list(range(len(x))) for x in slots.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=50), st.integers(1, 200))
def test_jump_agrees_and_moves_only_to_the_new_shard(keys, shards):
    got = sharding.jump(np.array(keys, dtype=np.int64), shards).tolist()
    assert got == [brute.jump(k % (1 << 64), shards) for k in keys]
    grown = sharding.jump(np.array(keys, dtype=np.int64), shards + 1).tolist()
    assert all(b in (a, shards) for a, b in zip(got, grown))


def test_jump_is_even():
    n = np.bincount(sharding.jump(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 240_000), 24), minlength=24)
    assert n.min() > 9500 and n.max() < 10500


def test_shards_on_disk_keep_every_row(spark, tmp_path):
    rows = [(i, f"t{i}", "en", "a", 2) for i in range(500)]
    sharding.write_shards(fixtures.frame(spark, rows), str(tmp_path / "out"), 6, tasks=2)
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "shard", "word").collect()
    assert sorted(r["doc_id"] for r in back) == list(range(500)) and {r["shard"] for r in back} == set(range(6)) and {r["word"] for r in back} == {"odd"}


PHRASED = [
    ("the cat sat on the mat. The cat sat, on the MAT", "en"), ("the cat sat on the mat", "en"), ("a a a a a a a", "en"), (None, "en"), ("", None), ("x y\tz x y z x  y z", None),
    ("É É é, É É", "fr"), ("x y z x y z", "und"), ("\x1fa b\x1fa b\x85 a b", "de"), ("one", "solo"), ("the cat sat on the mat", "en"),
]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_op13_counts_and_scores(spark, least):
    rows = [(i, t, lang, "a", 1) for i, (t, lang) in enumerate(PHRASED)]
    got = phrases.collocations(fixtures.frame(spark, rows).repartition(3), least=least).collect()
    assert sorted(map(tuple, got)) == sorted(brute.phrases(PHRASED, least))


def test_op13_odd_cases(spark, odd):
    docs = [(t, lang) for _, t, lang, *_ in fixtures.documents()]
    got = phrases.collocations(spark.read.parquet(f"{odd}/documents.parquet"), least=2, kept=50).collect()
    assert sorted(map(tuple, got)) == sorted(brute.phrases(docs, 2, 50))
    got = queries.op13_phrases(spark, odd)
    assert sorted(map(tuple, got.collect())) == sorted(brute.phrases(docs, 30)) and dict(got.dtypes)["rank"] == "bigint"
    assert phrases.collocations(spark.createDataFrame([], fixtures.SCHEMA).withColumn("n", F.lit(1))).count() == 0


def test_op13_hot_prefix_is_spread(spark):
    """One pair holds most of the words, its followers are many: supports found in parts are added up."""
    rows = [(f"hot pair w{i % 7} z{i % 3}", "en") for i in range(300)] + [(f"rest{i % 5} of it", "en") for i in range(60)]
    df = fixtures.frame(spark, [(i, t, lang, "a", 1) for i, (t, lang) in enumerate(rows)]).repartition(5)
    assert sorted(map(tuple, phrases.collocations(df, least=20).collect())) == sorted(brute.phrases(rows, 20))


@given(st.lists(st.text(alphabet="aB .,\t\n", max_size=40), max_size=6), st.integers(1, 7), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_words_across_windows_and_blocks(texts, window, block):
    was, phrases.WINDOW = phrases.WINDOW, window
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts), pa.string()), pa.array([t.encode() for t in texts], pa.binary())], ["lang", "text"])
        got = Counter()
        for _, words, numbers in phrases.word_blocks(iter([batch]), block):
            line = " ".join("|" if not n else words[n].decode() for n in numbers)
            got.update(p for p in (" ".join(x.split()) for x in line.split("|")) if p)
        want = Counter(p for t in texts for p in (" ".join(x.split()) for x in t.lower().translate(str.maketrans(".,\n", "|||")).split("|")) if p)
        assert got == want
    finally:
        phrases.WINDOW = was


@given(st.lists(st.tuples(*[st.integers(0, 3)] * 4, st.integers(1, 9)), max_size=60), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_packed_rows_come_back_added_up(rows, parts):
    keys = np.array([r[:4] for r in rows], dtype=np.uint64).reshape(-1, 4) << np.uint64(40)
    n = np.array([r[4] for r in rows], dtype=np.int64)
    want = Counter()
    for k, x in zip(keys.tolist(), n.tolist()):
        want[tuple(k)] += x
    sent = list(phrases.pack(keys, n, keys[:, 0], parts))
    got = [(tuple(k), x) for ks, xs in phrases.unpack(iter(sent), 4) for k, x in zip(ks.tolist(), xs.tolist())]
    assert dict(got) == dict(want) and len(got) == len(want)


def test_op3_takes_added_tokens_first(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from waymark.llm import packing

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n b", "<|endoftext", "<|<|endoftext|>|>", "<|ENDOFTEXT|>", "x" * 50 + "<|endoftext|>" + "y z " * 900, "<|fim|> <|endoftext|>é"]
    found = packing.pack(fixtures.frame(spark, [(i, x, "en", "a", 1) for i, x in enumerate(texts)]), ids=True).collect()
    for i, x in enumerate(texts):
        ids = b"".join(bytes(r["ids"]) for r in sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["piece"]))
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 0]


def test_op4_leaves_out_columns_of_other_names(spark):
    from pyspark.sql import functions as F

    from waymark.llm import chat

    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (2, 0, "user", "hello"), (2, 1, "assistant", "other"), (3, 0, "user", None)]
    plain = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    odd = plain
    for name in ("key", "parent", "turns", "loss", "formatted", "ids", "start", "end", "position", "node", "root", "depth", "tokens", "n", "conv", "rank"):
        odd = odd.withColumn(name, F.lit("odd"))
    shown = lambda df: sorted((r["conv_id"], [tuple(t) for t in r["turns"]], list(r["loss"]), r["formatted"]) for r in chat.read_back(*chat.format_tree(df)).collect())
    assert shown(odd) == shown(plain) and len(shown(odd)) == 3
