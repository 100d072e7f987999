"""Walks by groups against brute force, with as many groups as tiny graphs allow."""

import random
from collections import defaultdict

import pytest

from tessella.operators import tiles
from tessella.plans.catalogue import CORE


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tiles, "_LEAST", 50)


def graph_of(spark, n=300, seed=3):
    rnd = random.Random(seed)
    edges = {(a, rnd.choice((max(0, a - rnd.randrange(9)), rnd.randrange(n), 7))) for a in range(n) for _ in range(3)}
    wide = {(a * 10**12 - 5, b * 10**12 - 5) for a, b in edges}
    return wide, spark.createDataFrame([*wide, *list(wide)[:20], (None, 3), (3, None)], "src long, dst long")


def shuffled_by(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]


def test_similar_of_groups(spark, small):
    edges, df = graph_of(spark)
    out = defaultdict(set)
    for a, b in edges | {(3, None)}:
        out[a].add(b)
    truth = {(x, y): (len(z), len(z) / len(out[x] | out[y])) for x in out for y in out if x != y and (z := (out[x] & out[y]) - {None})}
    got = tiles.similar(df).collect()
    assert len(got) == len(truth) and {(r.id, r.other): (r.shared, r.score) for r in got} == truth
    assert tiles.similar(df.limit(0)).count() == 0


def test_similar_patterns_all_shuffles_no_pairs(spark, data):
    assert not [x for x in shuffled_by(CORE.plans["similar_patterns_all"](spark, data)) if "other" in x]


def test_closure_of_groups(spark, small):
    edges, df = graph_of(spark)
    near = defaultdict(set)
    for a, b in edges:
        near[b].add(a)
    truth = {}
    for n in list(near):
        seen = front = {n}
        for hop in range(1, 6):
            front = {m for x in front for m in near.get(x, ())} - seen
            seen = seen | front
            truth |= {(n, m): hop for m in front}
    for hops in (5, 2):
        got = tiles.closure(df, hops).collect()
        want = {k: h for k, h in truth.items() if h <= hops}
        assert len(got) == len(want) and {(r.file, r.dependent): r.hop for r in got} == want
    counts = defaultdict(int)
    for n, _ in truth:
        counts[n] += 1
    assert {r.id: r.dependents for r in tiles.dependents(df).collect()} == counts
    assert tiles.closure(df.limit(0)).count() == tiles.dependents(df.limit(0)).count() == 0


def test_import_closure_shuffles_no_pairs(spark, data):
    assert not [x for x in shuffled_by(CORE.plans["import_closure"](spark, data)) if "dependent" in x or "file" in x]


def test_import_high_impact_files_makes_no_pairs(spark, data):
    plan = CORE.plans["import_high_impact_files"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "dependent#" not in plan
