"""Graph operators against plain Python on graphs with every awkward shape."""

import random
from collections import defaultdict, deque

import pytest

from tessella.operators import domains as d
from tessella.operators import graph as g
from tessella.plans.catalogue import CORE
from tessella.sources import bindings as b

# Self-loop, two-cycle, longer cycle back, repeated edge, chain longer than five hops, diamond, isolated node.
EDGES = [(1, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (3, 4), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (15, 16), (20, 21), (20, 22), (21, 23), (22, 23), (None, 3), (3, None)]
NODES = [1, 2, 3, 4, 10, 11, 12, 13, 14, 15, 16, 20, 21, 22, 23, 99]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*e, "x") for e in EDGES], "src long, dst long, id string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id long")


def walk(seeds, hops, reverse=True):
    near = defaultdict(set)
    for a, b in EDGES:
        if a is not None and b is not None:
            near[b if reverse else a].add(a if reverse else b)
    seen, queue = {s: 0 for s in seeds}, deque(seeds)
    while queue:
        x = queue.popleft()
        if seen[x] < hops:
            for y in near[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
    return {k: v for k, v in seen.items() if k not in seeds}


@pytest.mark.parametrize("seeds, hops, reverse", [([16], 5, True), ([1], 5, True), ([23, 4], 5, True), ([10], 3, False), ([99], 5, True), ([12345], 5, True), ([3], 1, True)])
def test_reach(spark, edges, seeds, hops, reverse):
    got = {r.id: r.hop for r in g.reach(edges, ids(spark, *seeds), hops, reverse).collect()}
    assert got == walk(seeds, hops, reverse)


def test_closure_equals_single_walks(spark, edges):
    got = {(r.file, r.dependent): r.hop for r in g.closure(edges).collect()}
    assert got == {(n, m): h for n in NODES for m, h in walk([n], 5).items()}
    counts = {r.id: r.dependents for r in g.impact_counts(g.closure(edges)).collect()}
    assert counts == {n: len(walk([n], 5)) for n in NODES if walk([n], 5)}
    assert g.closure(edges.limit(0)).count() == 0


def test_whole_graphs(spark, data):
    items = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    orders = defaultdict(set)
    for r in items:
        orders[r.l_orderkey].add(r.l_partkey)
    truth = {(x, y) for parts in orders.values() for x in parts for y in parts if x > y}
    assert {(r.src, r.dst) for r in b.whole_graph(spark, data).collect()} == truth and b.graph(spark, data).count() < len(truth)
    near = defaultdict(set)
    for r in b.edges(spark, data).collect():
        near[r.dst].add(r.src)
    dependents = {}
    for n in list(near):
        seen = front = {n}
        for _ in range(5):
            front = {m for x in front for m in near.get(x, ())} - seen
            seen = seen | front
        if len(seen) > 1:
            dependents[n] = len(seen) - 1
    assert CORE.plans["import_closure"](spark, data).count() == sum(dependents.values())
    got = [(r.id, r.dependents) for r in CORE.plans["import_high_impact_files"](spark, data).collect()]
    assert sorted(got, key=lambda x: (-x[1], x[0])) == sorted(dependents.items(), key=lambda x: (-x[1], x[0]))[:20]


def test_similarity_of_all_files(spark, data):
    out = defaultdict(set)
    for r in b.edges(spark, data).collect():
        out[r.src].add(r.dst)
    shared = {(x, y): len(out[x] & out[y]) for x in out for y in out if x != y and out[x] & out[y]}
    assert len({x for x, _ in shared}) > 10
    assert {(r.id, r.other): r.shared for r in CORE.plans["similar_patterns_all"](spark, data).collect()} == shared
    assert {(r.id, r.other): r.shared for r in CORE.plans["shared_import_peers_all"](spark, data).collect()} == {p: n for p, n in shared.items() if n >= 2}
    rows = spark.createDataFrame([(x, d) for x in range(9) for d in range(x % 3 + 1)], "id long, dst long")
    got = {(r.id, r.other): r.shared for r in g.sharing(rows, rows.withColumnRenamed("id", "other"), most=2).collect()}
    assert got == {(x, y): min(x % 3, y % 3) + 1 for x in range(9) for y in range(9) if x != y}


def test_neighbours(spark, edges):
    got = {(r.src, r.dst) for r in g.neighbours(edges.dropna(), ids(spark, 23), 2).collect()}
    assert got == {(21, 23), (22, 23), (20, 21), (20, 22)}


def test_jaccard_and_bitmaps(spark):
    e = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 6), (2, 7), (3, 8)], "src long, dst long")
    assert [(r.id, r.other, r.shared, round(r.score, 6)) for r in g.jaccard(e, ids(spark, 1)).collect()] == [(1, 2, 1, round(1 / 3, 6))]
    far = spark.createDataFrame([(1, 5), (1, 5), (1, 40_000), (1, 90_000), (2, 0)], "src long, dst long")
    assert {r.src: r.n for r in g.bitmap_counts(g.adjacency_bitmaps(far)).collect()} == {1: 3, 2: 1}


def test_edge_changes_and_resolve(spark):
    a, b = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"), spark.createDataFrame([(1, 3), (1, 4), (1, 4)], "src long, dst long")
    assert sorted(map(tuple, g.edge_changes(a, b).collect())) == [(1, 2, "removed"), (1, 4, "added")]
    imports = spark.createDataFrame([(1, None, "a"), (1, None, "zz"), (2, 9, "a"), (3, None, None)], "src long, dst long, path string")
    files = spark.createDataFrame([(8, "a"), (7, "a"), (6, None)], "id long, path string")
    assert sorted((r.src, r.dst) for r in g.resolve(imports, files).collect() if r.dst) == [(1, 7), (2, 9)]


def test_votes(spark):
    files = spark.createDataFrame([(1, "r/auth/a.ts"), (2, "r/auth/b.ts"), (3, "r/x/c.ts"), (4, "r/billing/d.ts"), (5, "r/y/e.ts"), (6, None)], "id long, path string")
    edges = spark.createDataFrame([(3, 1), (2, 3), (3, 4), (5, 1), (5, 4)], "src long, dst long")
    got = {r.id: (r.domain, r.confidence) for r in d.assign(files, edges, globs={"EDITOR": ["**/y/*.ts"]}, anchors={"r/x/none.ts": "Q"}).collect()}
    assert got == {1: ("AUTH", 0.9), 2: ("AUTH", 0.9), 3: ("AUTH", 0.5), 4: ("PAYMENTS", 0.9), 5: ("EDITOR", 1.0), 6: ("CORE", 0.2)}


def test_communities(spark):
    clique = lambda names: [(a, b) for a in names for b in names if a < b]
    edges = clique([1, 2, 3, 4]) + clique([11, 12, 13, 14]) + [(4, 11)]
    nodes, e = ids(spark, 1, 2, 3, 4, 11, 12, 13, 14, 50), spark.createDataFrame(edges, "src long, dst long")
    first = {r.id: r.community for r in d.communities(nodes, e, 0.3).collect()}
    assert set(first) == {1, 2, 3, 4, 11, 12, 13, 14, 50} and first[50] == 50
    assert first == {r.id: r.community for r in d.communities(nodes, e, 0.3).collect()}
    inside = sum(first[a] == first[b] for a, b in edges)
    sizes = defaultdict(int)
    for c in first.values():
        sizes[c] += 1
    assert inside - 0.3 * sum(n * (n - 1) / 2 for n in sizes.values()) >= 0
    assert {r.id: r.component for r in d.components(nodes, e).collect()} == {**{n: 1 for n in (1, 2, 3, 4, 11, 12, 13, 14)}, 50: 50}


def test_communities_until_no_node_can_gain(spark):
    rnd = random.Random(2)
    edges = {tuple(sorted((n, rnd.randrange(n)))) for n in range(1, 400) for _ in range(5)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    of = {r.id: r.community for r in d.communities(ids(spark, *range(400)), spark.createDataFrame(sorted(edges), "src long, dst long"), 0.05).collect()}
    size = defaultdict(int)
    for c in of.values():
        size[c] += 1
    gain = lambda n, c: sum(of[m] == c for m in near[n]) - 0.05 * (size[c] - (of[n] == c))
    assert not [n for n in of if max(gain(n, of[m]) for m in near[n]) > max(0, gain(n, of[n])) + 1e-6]
    with pytest.raises(RuntimeError):
        d.communities(ids(spark, *range(400)), spark.createDataFrame(sorted(edges), "src long, dst long"), 0.05, rounds=2)
