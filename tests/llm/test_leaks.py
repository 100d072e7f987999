import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import leaks


def runs(text, n=12):
    ws = leaks.words(text)
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def corpus():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "Überlauf"] * 30
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(30)), "t") for i in range(12)] + [(90, None, None), (91, "too short", None), (92, " ".join(["same"] * 20), None)]
    docs = []
    for d in range(150):
        ws = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 120))]
        if d % 5 == 0:
            _, text, _ = rnd.choice(items[:12])
            part = text.split()
            n, at = rnd.randint(8, 20), rnd.randint(0, 10)
            ws[10:10] = [w.upper() if rnd.random() < 0.5 else w + rnd.choice([",", " --", "\n"]) for w in part[at : at + n]]
        docs.append((d, " ".join(ws), None))
    return docs + [(500, None, "x"), (501, "", "x"), (502, "same " * 13, "x"), (503, "same_" * 11, "x"), (None, items[0][1], "x")], items


def test_runs_equal_brute_force(spark):
    docs, items = corpus()
    truth = {(i, d) for i, t, _ in items for d, x, _ in docs if d is not None and runs(t) & runs(x)}
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items + items[:2], "item_id long, text string, task string")
    got = [tuple(r) for r in leaks.leaked_runs(d, i).collect()]
    assert truth and sorted(got) == sorted(truth)
    assert {tuple(r) for r in leaks.leaked_runs(d, i, block_words=90).collect()} == truth
    assert leaks.leaked_runs(d.limit(0), i).count() == 0 and leaks.leaked_runs(d, i.limit(0)).count() == 0


def test_paraphrases(spark):
    base = [f"word{i}" for i in range(24)]
    swapped = base[:]
    swapped[3], swapped[9] = "other", "thing"
    docs = spark.createDataFrame([(1, " ".join(swapped)), (2, " ".join(f"else{i}" for i in range(60))), (3, "filler " * 12 + " ".join(base))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(base))], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leaks.paraphrased(docs, items).collect()}
    assert (7, 3) in got and (7, 2) not in got


def test_paraphrases_with_new_words(spark):
    rnd = random.Random(5)
    common = [f"word{i}" for i in range(21)]
    base = common[:7] + ["answer"] + common[7:14] + ["stands"] + common[14:] + ["here"]
    docs = [(100 + d, " ".join(rnd.choice(common) if rnd.random() < 0.4 else f"else{rnd.randrange(900)}" for _ in range(60))) for d in range(60)]
    for n in range(10):  # n words that no item has, the answer kept, at every shift to the strides
        for shift in range(6):
            line = base[:]
            for at in rnd.sample([i for i, w in enumerate(base) if w in common], n):
                line[at] = f"new{at}"
            docs.append((1000 + 10 * n + shift, " ".join(["before"] * (12 + shift) + line + ["after"] * 12)))
    docs.append((2000, " ".join(["before"] * 12 + [w if w not in ("answer", "stands", "here") and i % 2 else f"new{i}" for i, w in enumerate(base)] + ["after"] * 12)))
    items = spark.createDataFrame([(7, " ".join(base))], "item_id long, text string")
    got = {r.doc_id for r in leaks.paraphrased(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1000 + 10 * n + shift for n in range(10) for shift in range(6)}


def test_recall_on_planted_rewordings(spark, data):
    """Passages of 24 words of the items at any place, a third of their words replaced by new ones and two neighbours swapped: at least nine in ten are found."""
    rnd = random.Random(8)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()]
    corpus = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").limit(150).collect()]
    planted, truth = [], set()
    for n in range(200):
        name, text = rnd.choice(items)
        ws = leaks.words(text)
        at = rnd.randrange(max(1, len(ws) - 23))
        line = ws[at : at + 24]
        for k in rnd.sample(range(len(line)), len(line) // 3):
            line[k] = f"neu{rnd.randrange(9999)}"
        i = rnd.randrange(len(line) - 1)
        line[i], line[i + 1] = line[i + 1], line[i]
        around = leaks.words(rnd.choice(corpus)[1])[:60]
        cut = rnd.randrange(len(around) + 1)
        planted.append((100_000 + n, " ".join(around[:cut] + line + around[cut:])))
        truth.add((name, 100_000 + n))
    got = {(r.item_id, r.doc_id) for r in leaks.paraphrased(spark.createDataFrame(corpus + planted, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(truth & got) / len(truth) >= 0.9


def test_short_items_are_whole_passages(spark):
    items = spark.createDataFrame([(1, "nine words that stand in one short odd item"), (2, "too few words")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "nine words which stand in one short odd item"), (6, "too few words"), (7, "quite another text about nothing of the kind")], "doc_id long, text string")
    assert [(r.item_id, r.doc_id) for r in leaks.paraphrased(docs, items).collect()] == [(1, 5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert leaks.common_subsequence(a, b) == table[-1, -1]


def test_words():
    assert leaks.words("Don't STOP_now, Straße 2½!") == ["don", "t", "stop", "now", "strasse", "2½"] and leaks.words(None) == [] and leaks.words(" _ ") == []
