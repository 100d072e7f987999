import os

import pytest

from tessella.llm import mixture as m


def test_plan(spark):
    totals = spark.createDataFrame([("a", 1000, 10), ("b", 100, 5), ("d", 9, 1)], "source string, tokens long, documents long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.3, 3), ("d", 0.0, 3)], "source string, target_share double, max_repeats int")
    made = {r.source: r for r in m.plan(totals, targets, 1100).collect()}
    assert made["a"].quota == 200 and made["b"].quota == 200 and made["b"].reachable and made["b"].whole == 2 and abs(made["a"].part - 0.2) < 1e-9
    assert not made["c"].reachable and made["c"].quota == 0 and made["d"].quota == 0
    given = {r.source: r for r in m.plan(totals, targets, 1100, "give").collect()}
    assert given["a"].quota == 550 and given["b"].quota == 200 and not given["b"].reachable
    assert m.plan(totals.limit(0), targets.limit(0)).count() == 0


def test_flight_keeps_both_balances():
    prob, size = [0.3] * 500 + [0.7] * 500, [float(i * i % 97 + 1) for i in range(1000)]
    p = m.flight(prob, size, "s")
    assert sum(1 for x in p if 0 < x < 1) <= 2
    assert abs(sum(p) - sum(prob)) < 1e-6 and abs(sum(a * b for a, b in zip(p, size)) - sum(a * b for a, b in zip(prob, size))) < 1e-3
    assert all(x in (0.0, 1.0) for x in m.land(p, size)) and m.flight([], [], "s") == [] and p == m.flight(prob, size, "s")


def test_the_flight_keeps_expectations():
    tries = [m.flight([0.25] * 8, [1.0, 2, 3, 4, 5, 6, 7, 8], str(i)) for i in range(400)]
    assert all(abs(sum(t[k] for t in tries) / 400 - 0.25) < 0.12 for k in range(8))


@pytest.mark.skipif(not os.path.isdir(m.TOKENIZERS), reason="no tokenizers here")
def test_mixture(spark):
    docs = [(i, "word " * (i % 7 + 1), "big", "x") for i in range(300)] + [(1000 + i, "tiny text", "small", "x") for i in range(4)] + [(2000, "left out", "other", None), (2001, "left out", None, None), (2002, None, "big", None), (2003, "", "big", None), (None, "no id", "big", None)]
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 2), ("absent", 0.2, 2), (None, 0.5, 1)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    for block in (20_000, 40):
        made = m.mix(d.drop("tokens"), t, total_tokens=400, block=block)
        rows, told = made.documents.collect(), {r.source: r for r in made.shares().collect()}
        assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small"}
        assert all(1 <= r.copies <= (1 if r.source == "big" else 3) for r in rows)
        assert told["small"].copies == 12 and told["small"].reachable and told["absent"].tokens == 0 and not told["absent"].reachable
        assert all(abs(r.tokens - r.target_tokens) <= 8 for r in told.values() if r.reachable)
        assert abs(sum(r.actual_share for r in told.values()) - 1) < 1e-9
        assert sorted(map(tuple, rows)) == sorted(map(tuple, m.mix(d.drop("tokens"), t, total_tokens=400, block=block).documents.collect()))
    kept = {r.source: r for r in m.mix(d.drop("tokens"), t, total_tokens=400, short="give").shares().collect()}
    assert abs(kept["big"].tokens - 250) <= 8 and kept["small"].copies == 12 and not kept["small"].reachable
    assert m.mix(d.limit(0).drop("tokens"), t).documents.count() == 0 and m.mix(d.drop("tokens"), t.limit(0)).shares().count() == 0


@pytest.mark.skipif(not os.path.isdir(m.TOKENIZERS), reason="no tokenizers here")
def test_shares_of_the_test_tables(spark, data):
    larger = data.replace("sf0.001", "sf0.01")
    told = m.mix(spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/mix_targets.parquet")).shares().collect()
    assert len(told) == 9 and all(r.most_copies <= r.max_repeats for r in told)
    assert all(r.reachable and abs(r.actual_share - r.share) <= 0.005 for r in told)
