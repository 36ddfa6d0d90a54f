"""Every query on a table of odd cases and on empty tables, against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import brute, fixtures
from waymark.llm import queries


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return fixtures.tables(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return fixtures.tables(spark, tmp_path_factory.mktemp("empty"), [])


def run(spark, name, at):
    return [r.asDict() for r in queries.queries()[name](spark, at).collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def multiset(rows):
    return Counter(rows)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty, name):
    rows = run(spark, name, empty)
    assert rows == [] or name == "op4_chat" and [r["conv_id"] for r in rows] == [-7]


def test_op1_counts_and_mixture(spark, odd):
    rows = run(spark, "op1_mixing", odd)
    docs = Counter(r[0] for r in fixtures.documents())
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, found in by.items():
        n = found[0]["n_copies"]
        assert Counter(r["copy"] for r in found) == {k: docs[i] for k in range(1, n + 1)}
        assert all(r["word"] == "odd" and r["text"] in [x[1] for x in fixtures.documents() if x[0] == i] for r in found)


def test_op1_weights(spark):
    from waymark.llm import mixing

    rows = [(i, "word " * 20, "en", "big" if i % 10 else "small", 100) for i in range(4000)]
    df = fixtures.frame(spark, rows, extra=False)
    n = Counter(r["source"] for r in mixing.mix(df, {"big": 1.0, "small": 1.0}).select("source").collect())
    assert abs(n["small"] - 2000) < 200 and abs(n["big"] - 2000) < 200
    n = Counter(r["source"] for r in mixing.mix(df, {"small": 1.0}).select("source").collect())
    assert set(n) == {"small"} and abs(n["small"] - 4000) < 300
    assert mixing.mix(df, seed=3).select("doc_id", "copy").collect() == mixing.mix(df, seed=3).select("doc_id", "copy").collect()


def test_op1_distribution(spark):
    from pyspark.sql import functions as F

    from waymark.llm import mixing

    for mean in (0.01, 1.0, 31.9):
        cdf = spark.range(1).select(mixing.distribution(F.lit(mean)).alias("c")).first()["c"]
        p, total = math.exp(-mean), 0.0
        for k, c in enumerate(cdf):
            total += p
            p *= mean / (k + 1)
            assert abs(c - total) < 1e-12


def test_op2_round_trip(spark, odd):
    rows = run(spark, "op2_media", odd)
    want = []
    for i, t, *_ in fixtures.documents():
        b = (t or "").encode()
        p = b + b"\xff" * ((-len(b)) % 576 if b else 576)
        want.append((i, len(b), len(p), sha(p), zlib.crc32(p[-32:])))
    assert multiset(want) == multiset((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    from waymark.llm import media

    for i, t, *_ in fixtures.documents():
        png = media.to_png((t or "").encode())
        assert media.from_png(png) == (media.pad((t or "").encode()), len((t or "").encode()))
        assert any(r["media_sha256"] == sha(png) and r["media_bytes"] == len(png) for r in rows)


def test_op2_damaged_members(spark, tmp_path):
    from waymark.llm import media

    folder = f"file://{tmp_path}/m"
    media.write_media(spark.createDataFrame([(f"m{k}", bytes([k]) * 700) for k in range(20)], "member string, payload binary").coalesce(1), folder)
    (path,) = (tmp_path / "m").glob("*.zip")
    raw = bytearray(path.read_bytes())
    at = raw.index(b"IDAT") + 8
    raw[at] ^= 255
    path.write_bytes(bytes(raw))
    rows = media.read_media(spark, folder, onError="report", retries="1", splitBytes="1000").collect()
    assert len(rows) == 20 and sum(r["error"] is not None for r in rows) == 1
    with pytest.raises(Exception, match="checksum"):
        media.read_media(spark, folder, retries="0").count()


def test_op3_pieces(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = run(spark, "op3_packing", odd)
    want = []
    for i, text, *_ in fixtures.documents():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            piece = ids[a : first if not k else a + 2048]
            want.append((i, k, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert multiset(want) == multiset((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_op3_sequences(spark, odd):
    from waymark.llm import packing

    df = spark.read.parquet(f"{odd}/documents.parquet")
    packed = packing.pack(df, ids=True)
    built = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert built[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def test_op3_plans_are_optimal_on_small_inputs():
    import random

    from waymark.llm import packing

    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        counts = Counter(items)
        fixed = packing.reduction(counts, capacity)
        left = [x for x, n in counts.items() for _ in range(n)]
        best = brute.fewest_bins(items, capacity)
        assert sum(n for _, n in fixed) + brute.fewest_bins(left, capacity) == best  # the reduction costs nothing
        assert packing.plan(Counter(items), capacity)[1] <= best + 1


def test_op4_read_back(spark, odd):
    rows = {r["conv_id"]: r for r in run(spark, "op4_chat", odd)}
    said = "\\### Assistant: </turn> ok"
    talk = defaultdict(list, {-7: [(0, "user", said), (1, "assistant", said)]})
    for r in spark.read.parquet(f"{odd}/conversations.parquet").collect():
        talk[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    assert set(rows) == set(talk)
    for i, turns in talk.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = rows[i]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), sha(loss.encode()))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in turns).encode())


def test_op4_shares_turns_once(spark):
    from waymark.llm import chat

    rows = [(i, k, "user" if k % 2 == 0 else "assistant", "shared" if k < 2 else f"own {i} {k}") for i in range(60) for k in range(4)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    nodes, conversations = (x.collect() for x in chat.format_tree(df))
    assert len(nodes) == 2 + 60 * 2
    by = {n["start"]: n for n in nodes}
    places = sorted((n["start"], n["end"]) for n in nodes)
    assert places[0][0] == 0 and all(a[1] == b[0] for a, b in zip(places, places[1:]))
    for c in conversations:
        at = 0
        for k, start in enumerate(c["path"]):
            n = by[start]
            assert n["position"] == at and n["depth"] == k
            seen = {x for a in n["attends"] for x in range(a["start"], a["end"])}
            assert seen == {x for s in c["path"][:k] for x in range(by[s]["start"], by[s]["end"])}
            at += n["end"] - n["start"]


def test_op4_escapes():
    from waymark.llm import chat

    for t in ["", "\\", "#### x", "</turn></turn", "### a: b </turn>\n", "a\n\n", "<"]:
        for r in ["user", "a: b", "\\", "### y", ""]:
            assert chat.read("".join(chat.parts(r, t)) * 3) == [(r, t)] * 3


def test_op5_bytes(spark, odd):
    rows = run(spark, "op5_suffix", odd)
    docs = fixtures.documents()
    want = multiset((d[0], *b) for d, b in zip(docs, brute.repeats([d[1] for d in docs])))
    assert want == multiset((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def test_op5_text(spark, tmp_path):
    """What is left can be read: passages of 400 bytes are gone from it, shorter ones of over 50 words stay, broken characters are marked."""
    import random

    rng = random.Random(12)
    long, short = fixtures.words(rng, 200)[:450], fixtures.words(rng, 120)[:380]
    assert len(short.split()) > 50
    own = [fixtures.words(rng, 40) for _ in range(6)]
    texts = {1: own[0] + long + own[1], 2: own[2] + "|" + short + "|" + own[3], 3: own[4] + "#" + short + "#" + own[5], 4: long + "é", 5: long + "è" + own[0], 6: long, 7: None, 8: own[5]}
    got = {r["doc_id"]: r for r in run(spark, "op5_suffix", fixtures.tables(spark, tmp_path, [(i, t, None, None, 0) for i, t in texts.items()]))}
    assert {i: r["text"] for i, r in got.items()} == {1: own[0] + own[1], 2: texts[2], 3: texts[3], 4: "\ufffd", 5: "\ufffd" + own[0], 6: "", 7: "", 8: own[5]}
    assert all(sha(r["text"].encode()) == r["kept_sha256"] for i, r in got.items() if i not in (4, 5))


@pytest.mark.parametrize("limit, length", [(65_536, 400), (2, 400), (2, 200), (65_536, 200)])
def test_op5_edges(spark, monkeypatch, limit, length):
    """Overlaps, edits near the edges, and classes that are parted."""
    import random

    from waymark.llm import suffix

    monkeypatch.setattr(suffix, "CLASS", limit)
    rng = random.Random(8)
    core = fixtures.words(rng, 150)
    texts = [core[a : a + n] for a, n in ((0, 500), (50, 420), (101, 399), (0, 400), (1, 400), (90, 410))]
    texts += [fixtures.words(rng, 30)[: rng.randint(0, 80)] + core[100 : 100 + n] + fixtures.words(rng, 9) for n in range(395, 411)]
    texts += [core[:300] + "é" + core[300:], core[:300] + "è" + core[300:]]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    texts += [fixtures.words(rng, 20) + core[300 : 300 + n] + fixtures.words(rng, 9) for n in range(196, 204)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = suffix.remove_repeats(fixtures.frame(spark, rows), length=length).collect()
    want = {i: b for i, b in enumerate(brute.repeats(texts, length))}
    for r in got:
        assert (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), sha(bytes(r["kept"]))) == want[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("length", [400, 200])
def test_op5_parted_classes(spark, monkeypatch, length):
    """One key in many surroundings that share more or less on either side, dealt to many shards and parted often."""
    import random

    from waymark.llm import suffix

    monkeypatch.setattr(suffix, "CLASS", 3)
    monkeypatch.setattr(suffix, "SHARD", 7)
    rng = random.Random(4)
    core = fixtures.words(rng, 200)[: length - 60]
    left, right = [fixtures.words(rng, 60)[:150] for _ in range(4)], [fixtures.words(rng, 60)[:150] for _ in range(4)]
    texts = []
    for _ in range(90):
        a, b = rng.choice(left), rng.choice(right)
        a, b = a[: rng.randint(0, 150)][::-1], b[: rng.randint(0, 150)]
        texts.append(fixtures.words(rng, 3) + a + core + b + fixtures.words(rng, 3))
    got = suffix.remove_repeats(fixtures.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), length=length).collect()
    want = dict(enumerate(brute.repeats(texts, length)))
    assert sum(w[1] > 0 for w in want.values()) > 20
    for r in got:
        assert (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), sha(bytes(r["kept"]))) == want[r["doc_id"]], r["doc_id"]


def test_op5_classes_stay_whole(spark, monkeypatch):
    """Small classes meet in one task though large ones are joined away from them, also where that join turns into a broadcast as it runs."""
    import random

    from waymark.llm import suffix

    monkeypatch.setattr(suffix, "CLASS", 8)
    rng = random.Random(21)
    own = lambda: fixtures.words(rng, 30)[:150]
    hot, cores = fixtures.words(rng, 120)[:410], [fixtures.words(rng, 120)[:410] for _ in range(12)]
    texts = [own() + hot + own() for _ in range(12)] + [own() + core + own() for _ in range(3) for core in cores]
    docs = fixtures.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).repartition(6, "doc_id")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = suffix.remove_repeats(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = dict(enumerate(brute.repeats(texts)))
    assert all(w[1] >= 410 for w in want.values())
    assert {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), sha(bytes(r["kept"]))) for r in got} == want


def test_op5_merge_of_shards():
    """Merged orders and common prefixes are those of one sort, however rows are dealt to shards."""
    import random

    import numpy as np

    from waymark.llm import suffix

    rng = random.Random(3)
    for few in (1, 2, 5, 40):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice((0, 3, 9, 127)))) for _ in range(30)]
        strings += [s[:k] + s[k:][::-1] for s in rng.choices(strings, k=30) for k in (0, 50, 126)] + strings[:9] + [b"a" * 127] * 3
        keys = [rng.randrange(3) for _ in strings]
        shard = [rng.randrange(few) for _ in strings]
        rank, same = np.zeros(len(strings), int), np.zeros(len(strings), int)
        for x in range(few):
            own = [k for k, y in enumerate(shard) if y == x]
            r, c = suffix.ordered([keys[k] for k in own], [strings[k] for k in own]) if own else ([], [])
            rank[own], same[own] = r, c
        rows = sorted(range(len(strings)), key=lambda k: (keys[k], shard[k], rank[k]))
        columns = suffix.symbols([strings[k] for k in rows])
        order, shared = suffix.interleave(np.array([keys[k] for k in rows]), np.array([shard[k] for k in rows]), same[rows], columns)
        merged = [rows[k] for k in order]
        assert sorted(merged) == sorted(rows) and shared[0] == -1
        for a, b, n in zip(merged, merged[1:], shared[1:]):
            want = -1 if keys[a] != keys[b] else suffix._common(strings[a], strings[b])
            assert n == want
        # rows that share n symbols stand together
        for n in (1, 4, 60, 127):
            runs = np.cumsum(shared < n)
            by = {}
            for k, run in zip(merged, runs):
                if len(strings[k]) >= n:
                    by.setdefault((keys[k], strings[k][:n]), set()).add(run)
            assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def test_op6_base(spark, odd):
    rows = run(spark, "op6_quality", odd)
    want = multiset((d[0], *brute.quality(d[1])) for d in fixtures.documents())
    assert want == multiset((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_op6_tail_and_guarantee(spark):
    from pyspark.sql import functions as F

    from waymark.llm import quality

    cases = [(0, 10, 0.3), (3, 40, 0.1), (5, 1000, 0.01), (90, 10_000, 0.01), (0, 1, 0.5), (9, 10, 0.5)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first()["x"]
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if n < 1000 else None
        if k > n * p:
            assert got == 1.0
        elif exact is not None:
            assert abs(got - exact) < 1e-9
        else:
            logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
            assert abs(got - sum(map(math.exp, logs))) < 1e-8
    # bad documents are full of symbols: with enough labels they go, good ones stay
    docs = [(i, ("good plain text of some words here " * 3) if i % 4 else ("bad*** text### with&&& signs%%% in$$$ it|| " * 2), "en", "a", 0) for i in range(4000)]
    labels = spark.createDataFrame([(i, int(bool(i % 4))) for i in range(4000)], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality.keep_good(fixtures.frame(spark, [(i, t + f" number {i} ends it so", *x) for i, t, *x in docs]), labels).collect()}
    base = {r["doc_id"] for r in quality.measures(fixtures.frame(spark, [(i, t + f" number {i} ends it so", *x) for i, t, *x in docs])).where("not base_failed").collect()}
    assert kept == {i for i in base if i % 4}


def test_op7_components(spark, odd):
    rows = run(spark, "op7_simhash", odd)
    docs = [d for d in fixtures.documents()]
    marked = [(d[0], brute.simhash(d[1])) for d in docs]
    ids = [(i if i is not None else 1 << 62, f) for i, f in marked]
    want = multiset((i, f"{f:016x}", c) for (i, f), c in zip(marked, brute.near_components(ids)))
    assert want == multiset((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows)


@pytest.mark.parametrize("limit", [4096, 8])
def test_op7_links(spark, monkeypatch, limit):
    """All links of random and crowded fingerprints, with and without the second filing."""
    import random

    from pyspark.sql import functions as F

    from waymark.llm import common, simhash

    monkeypatch.setattr(simhash, "BUCKET", limit)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)} | {0}
    center = rng.getrandbits(64)
    fps |= {center ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 1, 2, 2, 3, 4) for _ in range(60)}
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "fp bigint, rep bigint")
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(df)).collect()}
    want = brute.near_components([(i, f) for i, f in enumerate(sorted(fps))])
    assert [roots.get(i, i) for i in range(len(fps))] == want
    assert df.select(F.count("*")).first()[0] == len(fps)


def test_op7_keep_one(spark, odd):
    from waymark.llm import simhash

    df = spark.read.parquet(f"{odd}/documents.parquet")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = {r["doc_id"]: r["component_id"] for r in run(spark, "op7_simhash", odd)}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i: 1 for i, c in groups.items() if i is None or i == c})


def test_components_of_a_chain(spark):
    from waymark.llm import common

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 50] + [(7, 7)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert all(r == (n - 1) // 50 * 50 + 1 or n % 50 == 0 and r == n - 49 for n, r in roots.items())


def test_op8_learns(spark, odd, tmp_path):
    rows = run(spark, "op8_langid", odd)
    docs = fixtures.documents()
    assert multiset(r["doc_id"] for r in rows) == multiset(d[0] for d in docs)
    blank = {d[0] for d in docs if not any(c.isalpha() for c in d[1] or "")}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in blank) and 0 <= r["score"] <= 1 for r in rows)
    letters = {"en": "the of and to in that is was he for it with as", "fr": "le de un et être à il avoir ne je son que se qui", "de": "der die und in den von zu das mit sich des auf für"}
    import random

    rng = random.Random(4)
    made = [(i, " ".join(rng.choice(letters[g].split()) for _ in range(30)), g, "s", 0) for i in range(600) for g in [list(letters)[i % 3]]]
    at = fixtures.tables(spark, tmp_path / "l", made)
    right = {d[0]: d[2] for d in made}
    held = [r for r in run(spark, "op8_langid", at) if r["held_out"]]
    assert len(held) > 100 and all(r["lang_pred"] == right[r["doc_id"]] for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)


def test_op8_pieces_lose_nothing(monkeypatch):
    from waymark.llm import langid

    table = langid.sign_table(np.array([ord(c) for c in "abcdefghij"]))
    text = "abc, def!! ghi  j日本é -- abc" * 9 + "!!"
    whole = np.concatenate(list(langid.trigrams(text, table)))
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (np.concatenate(list(langid.trigrams(text, table))) == whole).all()


def test_op8_tells_apart_all_scripts(spark):
    """Languages written in letters that are rare in the corpus differ, beyond the first plane too."""
    import random

    from waymark.llm import langid

    rng = random.Random(12)
    scripts = {"many": range(0x4E00, 0x4E50), "el": range(0x3B1, 0x3C2), "th": range(0xE01, 0xE2F), "got": range(0x10330, 0x10341), "ett": range(0x10300, 0x10311)}

    words = {g: ["".join(chr(rng.choice(points)) for _ in range(5)) for _ in range(40)] for g, points in scripts.items()}
    made = [(i, " ".join(rng.choice(words[g]) for _ in range(60 if g == "many" else 12)), g, "s", 0) for i in range(500) for g in [list(scripts)[i % 5]]]
    found = langid.identify(fixtures.frame(spark, made)).collect()
    assert all(r["lang_pred"] == made[r["doc_id"]][2] for r in found)


def test_op9_learns(spark, odd, tmp_path):
    rows = run(spark, "op9_toxicity", odd)
    assert multiset(r["doc_id"] for r in rows) == multiset(d[0] for d in fixtures.documents())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    import random

    from waymark.llm import toxicity

    rng = random.Random(6)
    texts = {i: ". ".join(fixtures.words(rng, 12) for _ in range(8)) + (f". You {rng.choice(['vilex', 'foulo', 'nastyq'])} thing. " + fixtures.words(rng, 9) if i % 3 == 0 else "") for i in range(900)}
    docs = fixtures.frame(spark, [(i, t, "en", "a", 0) for i, t in texts.items()])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id bigint, toxic int")
    found = toxicity.score(docs, labels).collect()
    held = [r for r in found if r["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held)
    assert right >= 0.97 * len(held)
    for r in held:
        if r["predicted"] and r["doc_id"] % 3 == 0:
            assert any(w in texts[r["doc_id"]][o["start"] : o["end"]] for o in r["offending"] for w in ("vilex", "foulo", "nastyq"))


def test_op9_learns_from_the_ends_of_long_texts(spark):
    import random

    from waymark.llm import toxicity

    rng = random.Random(9)
    calm = fixtures.words(rng, 400).split()
    texts = {i: ". ".join(" ".join(rng.sample(calm, 60)) for _ in range(80)) + (". You vilex thing." if i % 2 else ".") for i in range(120)}
    texts |= {i: " ".join(rng.sample(calm, 60)) + (". You vilex thing." if i % 2 else ".") for i in range(1000, 1060)}
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, toxic int")
    found = toxicity.score(fixtures.frame(spark, [(i, t, "en", "a", 0) for i, t in texts.items()]), labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in found)


def test_op10_base_and_model(spark, odd):
    rows = run(spark, "op10_lm", odd)
    docs = fixtures.documents()
    counts, tokens = Counter(), []
    for i, t, *_ in docs:
        w = [*(t or "").encode().lower().split(), b"\n"]
        tokens.append(w)
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, *_), w in zip(docs, tokens):
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(i), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_op10_rare_words_by_join(spark, monkeypatch):
    """Words looked up in the head and words that meet their counts in the join score alike."""
    from waymark.llm import lm

    monkeypatch.setattr(lm, "CLASSES", 3)
    rows = [(i, f"a a a b b c{i % 9} d{i % 31} e{i} unseen{i * 7 % 50}", None, None, 0) for i in range(120)]
    scores = []
    for head in (1 << 17, 12):
        monkeypatch.setattr(lm, "HEAD", head)
        scores.append({r["doc_id"]: r for r in lm.score(fixtures.frame(spark, rows)).collect()})
    assert len(scores[0]) == 120 == len(scores[1])
    for i, r in scores[0].items():
        other = scores[1][i]
        assert r["n_known"] == other["n_known"] and abs(r["base_score"] - other["base_score"]) < 1e-9 and abs(r["score"] - other["score"]) < 1e-9


def test_op10_shuffle_files_go_once_used(spark, monkeypatch):
    """What was sent to be counted is gone from disk when the counts are settled, also if the driver's heap isn't collected."""
    import time

    from waymark.llm import lm

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "/shuffle_" in f}

    def settle(df):
        before, out = files(), real(df)
        for _ in range(100):
            if not files() - before:
                break
            time.sleep(0.1)
        left.append(len(files() - before))
        return out

    real, left = lm.settle, []
    monkeypatch.setattr(lm, "settle", settle)
    monkeypatch.setattr(lm, "release", lambda spark: None)
    rows = [(i, f"a a b c{i % 9} d{i % 31} e{i}", None, None, 0) for i in range(120)]
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    assert lm.score(fixtures.frame(spark, rows)).count() == 120
    assert len(left) > 2 and not any(left)
    assert spark.conf.get(name, None) == was


def test_op10_mixture_adds_to_one():
    from waymark.llm import lm

    rng = np.random.default_rng(1)
    kept, deleted = rng.poisson(3, (10, 9)).astype(float), rng.poisson(1, (10, 9)).astype(float)
    kept[3] = 0
    assert np.allclose((10 ** lm.class_model(kept, deleted)).sum(axis=1), 1)
    e = [np.array([[0.7, 0.2, 0.1]]), np.array([[0.1, 0.1, 0.8]])]
    w = lm.learn(e, np.array([[700.0, 200.0, 100.0]]), np.array([0]))
    assert w[0, 0] > 0.95


def test_op10_counts_rare_pairs_and_triples(spark, monkeypatch):
    """Rare words' surroundings count, in every chunk and part alike, and chances add to one."""
    from waymark.llm import lm

    monkeypatch.setattr(lm, "CLASSES", 2)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 60} x{(i * 7 + k) % 60}" for k in range(8)), None, None, 0) for i in range(200)]
    turned = [(1000 + i, " ".join(reversed(t.split())), *x) for i, t, *x in rows]
    scores = []
    for chunk, part in ((1 << 18, 1 << 21), (200, 50)):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "PART", part)
        scores.append({r["doc_id"]: r["score"] for r in lm.score(fixtures.frame(spark, rows + [r for r in turned if zlib.crc32(str(r[0]).encode()) % 7 == 2])).collect()})
    assert scores[0].keys() == scores[1].keys() and all(abs(x - scores[1][i]) < 1e-9 for i, x in scores[0].items())
    known = [x for i, x in scores[0].items() if i < 1000 and zlib.crc32(str(i).encode()) % 7 == 2]
    other = [x for i, x in scores[0].items() if i >= 1000]
    assert known and other and min(known) > max(other) + 10  # the same words, in an order never seen

    w = lm.order_weights([(0, 0.0, 0.0, 0.1, 5.0), (3, 0.0, 0.5, 0.1, 9.0), (26, 0.9, 0.5, 0.1, 9.0)])
    assert np.allclose(w.sum(axis=1), 1) and not w[:25, 0].any() and w[0, 1] == 0
    counts = np.array([[2, 3, 1], [1, 2, 1], [9, 2, 1]])
    e3, e2, b = lm.orders(counts, np.array([0]))
    assert e3.tolist() == [0, 2, 0.5] and np.allclose(e2, [1, 1, 1 / 3]) and b.tolist() == [1, 25, 26]


def test_pipeline(spark, odd):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    shared = corpus_pipeline.shared_path(spark, "test")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, odd).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        rows = before.collect()
        if k == 1:
            marked = [(r["doc_id"] if r["doc_id"] is not None else 1 << 62, brute.simhash(r["text"])) for r in rows]
            keep = {i for (i, _), c in zip(marked, brute.near_components(marked)) if i == c}
            assert {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None} == keep - {1 << 62}
        if k == 2:
            want = multiset(b[3] for b in brute.repeats([r["text"] for r in rows], corpus_pipeline.PASSAGE))
            got = multiset(sha(r["text"].encode()) for r in docs.collect())
            assert sum((want - got).values()) <= 1  # a cut may break a character
    assert docs.count() and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    path = fixtures.tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, path).count() == 0


def fold_of(doc, folds):
    import zlib

    return zlib.crc32(str(doc).encode() if doc is not None else b"") % folds


def test_op8_plain(spark, odd):
    rows = fixtures.documents()
    train = [(r[2], r[1] or "") for r in rows if fold_of(r[0], 4) != 2 and r[2] is not None]
    want = multiset((r[0], p, round(s, 4)) for r, (p, s) in zip(rows, brute.language(train, [r[1] for r in rows])))
    assert want == multiset((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in run(spark, "op8_langid", odd))


def test_op9_plain(spark):
    import random

    from waymark.llm import toxicity

    rng = random.Random(6)
    calm = [w for w in fixtures.words(rng, 300).split() if len(w) > 2]
    texts = {i: ". ".join(" ".join(rng.sample(calm, 8)) for _ in range(rng.randint(1, 6))) + (". Such vilest nonsense!" if i % 2 else "\nfine") for i in range(200)}
    docs = fixtures.frame(spark, [(i, t, None, None, 0) for i, t in [*texts.items(), (900, None), (901, ""), (902, "..! ?")]])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in texts], "doc_id bigint, quality int, toxic int")
    weights, bias = toxicity.fit(toxicity.sample(docs, labels))
    assert weights
    for r in toxicity.score(docs, labels).collect():
        assert abs(r["score"] - brute.toxic(texts.get(r["doc_id"], {902: "..! ?"}.get(r["doc_id"], "")), weights, bias)) < 1e-9


@pytest.mark.parametrize("classes", [512, 4])
def test_op10_plain(spark, monkeypatch, classes):
    """Scores are those of counts in plain dictionaries, with words in classes of their own or mostly in the common one."""
    import random

    from waymark.llm import lm

    monkeypatch.setattr(lm, "CLASSES", classes)
    rng = random.Random(12)
    some = fixtures.words(rng, 60).split()
    texts = [" ".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "Wholly New words"]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    want = brute.language_model([(fold_of(i, 7), t) for i, t in enumerate(texts)])
    for r in lm.score(fixtures.frame(spark, rows)).collect():
        n, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6, r["doc_id"]
