"""Merging of nodes and deduplication of the graph against a walk in plain Python; components; domain of the queries."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebank.operators import components as C
from lorebank.operators import graph as G
from lorebank.operators import similarity as S


def walk(nodes, edges, merges):
    """Edges (src, dst, relation) and merged ids, by making the merges one after the other on lists of parallel edges."""
    cells, merged = {}, {n: [] for n in nodes}
    for s, d, r in edges:
        cells.setdefault((s, d), []).append(r)
    for kept, gone in merges:
        for s, d in [c for c in cells if c[1] == gone]:
            for r in cells[s, d]:
                if (s, kept) not in cells:
                    cells[s, kept] = [r]
        for s, d in [c for c in cells if c[0] == gone]:
            for r in cells[s, d]:
                if (kept, d) not in cells:
                    cells[kept, d] = [r]
        cells = {c: r for c, r in cells.items() if gone not in c}
        merged[kept].append(gone)
        del merged[gone]
    return sorted((*c, r) for c, x in cells.items() for r in x), merged


def graphs(count, seed):
    """Random graphs with parallel edges and loops, and forests of merges with chains, in any order."""
    rng = random.Random(seed)
    for g in range(count):
        n = rng.randint(2, 9)
        nodes = [f"{g}-{i}" for i in range(n)]
        edges = [(rng.choice(nodes), rng.choice(nodes), f"R{k}") for k in range(rng.randint(1, 18))]
        left, merges = list(nodes), []
        for _ in range(rng.randint(1, n - 1)):
            a, b = rng.sample(left, 2)
            if rng.random() < 0.5 and merges and merges[-1][0] in left:  # a chain
                b, a = merges[-1][0], rng.choice([x for x in left if x != merges[-1][0]])
            left.remove(b)
            merges.append((a, b))
        yield nodes, edges, merges


@pytest.mark.parametrize("numbered", [1 << 20, 2])
def test_merges_equal_the_walk(spark, numbered, monkeypatch):
    monkeypatch.setattr(G, "NUMBERED", numbered)
    nodes, edges, merges, want, left = [], [], [], [], {}
    for a, b, c in graphs(250, 11):
        nodes += [(x, "FACT") for x in a]
        edges += [(*x, k) for k, x in enumerate(b)]
        merges += [(*x, len(merges) + k) for k, x in enumerate(c)]
        e, m = walk(a, b, c)
        want += e
        left |= m
    random.Random(1).shuffle(edges)
    n, e, m = G.merge(spark.createDataFrame(nodes, "node_id string, type string"), spark.createDataFrame(edges, "src string, dst string, relation string, seq long"), spark.createDataFrame(merges, "kept string, removed string, at long"))
    assert sorted((r.src, r.dst, r.relation) for r in e.collect()) == sorted(want)
    assert {r.node_id for r in n.collect()} == set(left)
    got = {}
    for r in sorted(m.collect(), key=lambda r: r.at):
        got.setdefault(r.node_id, []).append(r.merged_id)
    assert got == {k: v for k, v in left.items() if v}


def test_a_long_chain_of_merges(spark):
    n = 10_000
    edges = [(f"e{i}", f"f{i}", "SUBJECT_OF", i) for i in range(n)] + [(f"f{i}", "topic", "ABOUT", i) for i in range(1, 5)]
    merges = [(f"f{i + 1}", f"f{i}", i) for i in range(n - 1)]
    nodes = [(f"f{i}", "FACT") for i in range(n)]
    left, e, m = G.merge(spark.createDataFrame(nodes, "node_id string, type string"), spark.createDataFrame(edges, "src string, dst string, relation string, seq long"), spark.createDataFrame(merges, "kept string, removed string, at long"))
    last = f"f{n - 1}"
    assert [r.node_id for r in left.collect()] == [last] and [(r.node_id, r.merged_id) for r in m.collect()] == [(last, f"f{n - 2}")]
    assert sorted((r.src, r.dst, r.seq) for r in e.collect()) == sorted([(f"e{i}", last, i) for i in range(n)] + [(last, "topic", 4)])


def test_merging_nothing(spark):
    edges = spark.createDataFrame([("a", "b", "R", 1), ("a", "b", "S", 2), ("a", "a", "R", 3), (None, "b", "R", 4)], "src string, dst string, relation string, seq long")
    nodes = spark.createDataFrame([("a", "FACT"), ("b", "FACT")], "node_id string, type string")
    n, e, m = G.merge(nodes, edges, spark.createDataFrame([], "kept string, removed string, at long"))
    assert (n.count(), e.count(), m.count()) == (2, 4, 0)
    n, e, m = G.merge(nodes.limit(0), edges.limit(0), spark.createDataFrame([("a", "b", 1)], "kept string, removed string, at long"))
    assert (n.count(), e.count()) == (0, 0)


def brute_walk(pairs, score):
    gone, out = set(), []
    for i, j in sorted(pairs):
        if i not in gone and j not in gone:
            x = i if score[j] > score[i] else j
            gone.add(x)
            out.append((i + j - x, x))
    return out


@pytest.mark.parametrize("walked", [1 << 20, 3])
def test_walks_in_tasks_and_in_rounds(spark, walked, monkeypatch):
    monkeypatch.setattr(S, "WALKED", walked)
    rng = random.Random(3)
    members, near, score, pairs = [], [], {}, set()
    for g in range(60):
        ids = list(range(g * 100, g * 100 + rng.randint(2, 14)))
        classes: dict[int, list[int]] = {}
        for i in ids:
            c = rng.choice([i, *classes])
            classes.setdefault(c, []).append(i)
            score[i] = float(rng.randint(0, 3))
        members += [(i, c) for c, x in classes.items() for i in x]
        links = {tuple(sorted(rng.sample(sorted(classes), 2))) for _ in range(rng.randint(0, 2 * len(classes)))} if len(classes) > 1 else set()
        near += [(*x, 0.9) for x in links]
        pairs |= {tuple(sorted((i, j))) for x in classes.values() for i in x for j in x if i != j}
        pairs |= {tuple(sorted((i, j))) for a, b in links for i in classes[a] for j in classes[b]}
    got = S.merge_classes(spark.createDataFrame(members, "id long, cls long"), spark.createDataFrame(near, "i long, j long, similarity double"), spark.createDataFrame(list(score.items()), "id long, score double"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_walk(pairs, score))


def jobs(spark, run):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    group = f"g{random.random()}"
    sc.setJobGroup(group, "")
    out = run()
    sc._jsc.clearJobGroup()
    return out, len(tracker.getJobIdsForGroup(group))


@pytest.mark.parametrize("rising", [False, True])
def test_a_chain_of_pairs_takes_as_many_jobs_as_a_short_one(spark, rising):
    took = []
    for n in (30, 10_000):
        pairs = [(i, i + 1) for i in range(n)]
        score = {i: float(i if rising else 0) for i in range(n + 1)}
        merged = lambda p=pairs, s=score: S.greedy_merge(spark.createDataFrame(p, "i long, j long"), spark.createDataFrame(list(s.items()), "id long, score double")).collect()
        got, k = jobs(spark, merged)
        assert sorted(map(tuple, got)) == sorted(brute_walk(pairs, score))
        took.append(k)
    assert took[1] <= took[0] + 4


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1200)] + [(i, i + 1) for i in range(5000, 5400)]
    rng.shuffle(edges)
    want = brute_components([e for e in edges if e[0] != e[1]])
    for rows in (spark.createDataFrame(edges, "a long, b long").repartition(7), spark.createDataFrame([(f"{a:05}", f"{b:05}") for a, b in edges], "a string, b string")):
        got = {int(r.node): int(r.root) for r in C.components(rows).collect()}
        assert got == want
    assert C.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []
    assert C.least_of_component(np.array([0, 2, 4]), np.array([1, 3, 2]), 6).tolist() == [0, 0, 2, 2, 2, 5]


def test_similarity_of_merges(spark):
    texts = ["a b c d e f g h i j", "j i h g f e d c b a", "a b c d e f g h i j k", "other words", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members, near = S.near_classes(rows)
    merges = S.merge_classes(members, near, rows.select("id", F.lit(1.0).alias("score")))
    assert sorted(map(tuple, S.with_similarity(merges, members, near).collect())) == [(0, 1, 1.0), (0, 2, 0.9091)]
    assert not re.search("CartesianProduct|BroadcastNestedLoop", merges._jdf.queryExecution().toString())
