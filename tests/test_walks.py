"""Walks over random graphs against plain versions: ends as bits, directed reach, star chains, labels of a walk."""

import random
from collections import defaultdict

import pytest

from waymark.engine import Engine
from waymark.operators import lineage
from waymark.operators.components import reachable
from waymark.operators.words import naming


def closure(edges, start):
    seen, waiting = set(), [start]
    while waiting:
        for b in edges.get(waiting.pop(), ()):
            if b not in seen:
                seen.add(b)
                waiting.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_with_cycles(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(30)}
    edges = defaultdict(set)
    for a, b in pairs:
        edges[a].add(b)
    got = reachable(spark.createDataFrame(sorted(pairs), "a int, b int"), spark.createDataFrame([(k,) for k in range(8)], "start int"))
    assert {tuple(r) for r in got.collect()} == {(k, x) for k in range(8) for x in closure(edges, k) if x != k}


@pytest.mark.parametrize("seed", [3, 4])
def test_ends_as_bits_agree_with_pairs(spark, seed):
    rng = random.Random(seed)
    steps = {(r, f"T{rng.randint(0, 40)}", f"T{rng.randint(0, 150)}") for r in ("x", "y") for _ in range(260)}
    ends = {f"T{k}" for k in range(150) if rng.random() < 0.7}
    df = spark.createDataFrame([(r, a, "C", b, "C") for r, a, b in sorted(steps)], "root string, from_short string, from_key string, short string, key string").repartition(5)
    got = {(r["root"], r["end"], r["short"]) for r in lineage.upstream_of(df, spark.createDataFrame([(e,) for e in sorted(ends)], "short string")).collect()}
    want = set()
    for root in ("x", "y"):
        edges = defaultdict(set)
        for r, a, b in steps:
            if r == root:
                edges[a].add(b)
        nodes = {n for r, a, b in steps if r == root for n in (a, b)}
        targets = {b for r, _, b in steps if r == root}
        want |= {(root, e, n) for n in nodes for e in (closure(edges, n) | ({n} & targets)) & ends}
    assert got == want


def test_star_chains_leave_out_and_list(spark):
    """Chains in one step each: what is left out on the way unites, what is listed on the way is passed on in order."""
    repo = Engine(spark).read_texts({
        "d.sql": "CREATE TABLE c0 (k INT64, v STRING, w DATE)",
        "a.sql": "CREATE TABLE c1 AS SELECT * EXCEPT (v), k + 1 AS x FROM c0;\nCREATE TABLE c2 AS SELECT *, k AS y FROM c1;\nCREATE TABLE c3 AS SELECT * EXCEPT (x) FROM c2;\nCREATE TABLE c4 AS SELECT *, w AS b FROM c3;\nCREATE TABLE c5 AS SELECT * FROM c4",
        "loop.sql": "CREATE TABLE l1 AS SELECT * FROM l2;\nCREATE TABLE l2 AS SELECT * FROM l1",
        "gap.sql": "CREATE TABLE g1 AS SELECT * FROM nowhere;\nCREATE TABLE g2 AS SELECT * FROM g1",
        "two.sql": "CREATE TABLE m AS SELECT a.*, b.* FROM c5 a JOIN c1 b ON a.k = b.k;\nCREATE TABLE n AS SELECT * FROM m",
    })
    told = defaultdict(list)
    for r in sorted(repo.catalog.collect(), key=lambda r: (r["key"], r["pos"])):
        told[r["key"]].append(r["column"])
    assert told["C1"] == ["k", "w", "x"] and told["C2"] == ["k", "w", "x", "y"] and told["C3"] == ["k", "w", "y"]
    assert told["C4"] == told["C5"] == ["k", "w", "y", "b"]
    assert sorted(told["M"]) == sorted(told["N"]) == ["b", "k", "w", "x", "y"]
    assert {r["table"] for r in repo.gaps.collect()} == {"l1", "l2", "g1", "g2"}
    assert not {"L1", "L2", "G1", "G2"} & set(told)


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_labels_are_the_best_of_all_ways(spark, seed):
    """Random statements of stars and columns: the least hops, and the best of (inferred, not sure) over all walks."""
    rng = random.Random(seed)
    n, rows = 7, []
    for k in range(16):
        a, b = rng.sample(range(n), 2)
        star = rng.random() < 0.5
        rows.append((f"s{k}", f"T{a}", f"T{b}", star, rng.random() < 0.6))
    schema = "stmt string, file string, table string, s_short string, s_ds string, column string, out string, how string, without string, certain boolean, star boolean, target string, t_short string, t_ds string"
    flows = spark.createDataFrame([(s, "f", a, a, "", "*" if star else "c", "*" if star else "c", "star" if star else "direct", "", sure, star, b, b, "") for s, a, b, star, sure in rows], schema)
    start = lineage.column_start(spark.createDataFrame([("T0", "c")], "table string, column string"))
    known = spark.createDataFrame([], "key string, column string")
    nodes, _, _ = lineage.walk_columns(flows, start, known)
    best = {0: [(0, 0, False)]}
    hops = {0: 0}
    front, hop = {(0, 0, False)}, 0
    seen = set(front)
    while front:
        hop += 1
        onward = set()
        for t, inferred, unsure in front:
            for _, a, b, star, sure in rows:
                if a == f"T{t}" and inferred < 8:
                    onward.add((int(b[1:]), inferred + star, unsure or not sure))
        front = onward - seen
        seen |= onward
        for t, i, u in front:
            hops.setdefault(t, hop)
            best.setdefault(t, []).append((i, u))
    got = {int(r["short"][1:]): (r["hop"], r["inferred"], not r["sure"]) for r in nodes.collect()}
    want = {t: (hops[t], *min((i, u) for _, i, u in [x for x in seen if x[0] == t])) for t in hops}
    assert got == want


def test_names_are_found_whole(spark):
    rows = spark.createDataFrame([(1, "a_b and a-b, xa_b"), (2, "A-B"), (3, "ab a"), (4, "$é É_"), (5, None)], "id int, text string")
    names = spark.createDataFrame([("a_b",), ("a-b",), ("É_",), ("zz",), ("-",)], "name string")
    assert {(r["id"], r["name"]) for r in naming(rows, "text", names).collect()} == {(1, "a_b"), (1, "a-b"), (2, "a-b"), (4, "É_")}
