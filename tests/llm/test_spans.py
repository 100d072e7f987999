import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import spans


def brute(texts, span):
    sets = {k: {t[i : i + span] for i in range(len(t) - span + 1)} for k, t in texts.items() if t}
    pairs = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    share = {}
    for k, t in texts.items():
        others = set().union(*[s for o, s in sets.items() if o != k])
        hit = np.zeros(len(t or ""), dtype=bool)
        for i in range(len(t or "") - span + 1):
            if t[i : i + span] in others:
                hit[i : i + span] = True
        share[k] = int(hit.sum())
    return pairs, share


def collection(span):
    rnd = random.Random(9)
    letters = "abcdefghij äöü漢𝒳\n"
    make = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    texts = {i: make(rnd.randint(0, 6 * span)) for i in range(60)}
    for i in range(0, 40, 2):  # planted spans of about the length, at any place
        n = span + rnd.choice([-2, -1, 0, 1, 5, span])
        part = make(n)
        for j in (i, i + 1, rnd.randint(0, 59)):
            at = rnd.randint(0, len(texts[j]))
            texts[j] = texts[j][:at] + part + texts[j][at:]
    notice = make(span - 1)
    for i in range(60, 110):  # a notice just too short, in many
        texts[i] = make(50) + notice + make(50)
    shared = make(span + 3)
    for i in range(110, 150):  # one just long enough, in many
        texts[i] = make(rnd.randint(0, 90)) + shared + make(rnd.randint(0, 90))
    for i in range(150, 155):
        texts[i] = texts[1]
    return {**texts, 200: "", 201: None, 202: "z" * (5 * span), 203: "z" * span, 204: "z" * (span - 1)}


@pytest.mark.parametrize("span", [64, 320])
def test_pairs_and_shares_equal_brute_force(spark, span):
    texts = collection(span)
    pairs, share = brute(texts, span)
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in texts.items()], "doc long, text string, h string, n int")
    found = spans.shared_windows(df, span)
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {r.doc: r.shared_chars for r in spans.shared_share(found, df).collect()} == share
    longest, n = {}, span
    while level := {a for p in brute(texts, n)[0] for a in p}:
        longest.update(dict.fromkeys(level, n))
        n *= 2
    assert {r.doc: r.length for r in found.lengths().collect()} == longest


def test_nothing_to_share(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 400)], "doc long, text string")
    none = spans.shared_windows(df)
    assert none.pairs().count() == 0 and none.lengths().count() == 0 and spans.shared_windows(df.limit(0)).pairs().count() == 0
    assert sorted(map(tuple, spans.shared_share(none, df.where("doc is not null")).collect())) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def test_many_copies_are_linked_to_the_first(spark, monkeypatch):
    monkeypatch.setattr(spans, "COPIES", 3)
    df = spark.createDataFrame([(i, "q" * 100 + str(7) * 300) for i in range(6)] + [(9, "q" * 100 + "7" * 300 + "!")], "doc long, text string")
    assert sorted(map(tuple, spans.shared_windows(df).pairs().collect())) == [(0, i) for i in (1, 2, 3, 4, 5, 9)]


def test_a_crowd_is_told_by_its_members(spark):
    rnd = random.Random(4)
    part = "".join(rnd.choice("abcdef ") for _ in range(330))
    n = 10_000
    df = spark.createDataFrame([(i, chr(0x4E00 + i) + part + chr(0x4E00 + i)) for i in range(n)], "doc long, text string")
    found = spans.shared_windows(df)
    held = [tuple(r) for r in found.classes().collect()]
    assert len(held) == n and {d for *_, d, _ in held} == set(range(n)) and {r for *_, r in held} == {n}
    pairs = {tuple(r) for r in found.pairs().collect()}
    assert pairs == {(0, i) for i in range(1, n)}


def test_many_texts_with_many_copies(spark):
    df = spark.range(900 * 4).select((F.col("id")).alias("doc"), F.concat(F.lpad((F.col("id") % 900).cast("string"), 5, "0"), F.repeat(F.sha2((F.col("id") % 900).cast("string"), 256), F.lit(6))).alias("text"))
    found = spans.copies(df)
    assert found.count() == 3600 and found.where("copies = 4 and first = doc % 900").count() == 3600


def test_long_texts(spark, monkeypatch):
    rnd = random.Random(2)
    part = "".join(rnd.choice("abc") for _ in range(330))
    long = "".join(rnd.choice("abcdef") for _ in range(spans.PIECE + 5000))
    texts = {1: long[: spans.PIECE - 100] + part + long[spans.PIECE - 100 :], 2: part + long[:10], 3: "no"}
    df = spark.createDataFrame(list(texts.items()), "doc long, text string")
    assert [tuple(r) for r in spans.shared_windows(df).pairs().collect()] == [(1, 2)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=5, max_size=80), st.integers(1, 5))
def test_smallest(values, width):
    v = np.array(values, dtype=np.uint64)
    assert spans._smallest(v, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab漢", min_size=3, max_size=60), st.integers(1, 3))
def test_equal_windows_hash_alike(text, width):
    h = spans.Hasher()
    got = h.windows(h.prefix(spans.code_points(text)), width)
    for i in range(len(got)):
        for j in range(len(got)):
            assert (got[i] == got[j]) == (text[i : i + width] == text[j : j + width])
