import ast
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import statements as st


def valid(text):
    try:
        ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


GOOD = [
    "", "x = 1\n", "def f(a, *b, c: int = 3, **d) -> dict[str, int]:\n    return {a: [x for x in b if x], **d}\n", "class A(B, metaclass=M):\n    x: int = 3\n\n    @property\n    async def g(self):\n        await h(*self.a[1:2, ::3])\n        yield\n",
    "from .a import (b as c,\n    d,)\nimport os.path as p, sys\n", "if a and not b: pass\nelif c is not None or d not in e:\n    del a[0], b.c\nelse:\n    raise X(1) from e\n", "try:\n    a += lambda x, *y: x if x else -1\nexcept (A, B) as e:\n    global z\nfinally:\n    assert a, 'm'\n",
    "with open(f) as g, h():\n    print('a' \"b\", f'{x}', r'\\n', end='')\n    for i, (j, k) in enumerate(a): x = y = i; continue\n", "s = '''a\nb ( '''  # c (\nt = x \\\n    + 1\n", "while (n := f()) > 0:\n    n -= 1\n", "@a.b(1)\ndef f(): ...\n",
]
BAD = ["x = = 1\n", "def f(:\n    pass\n", "return return\n", "x = (1, 2]\n", "a b c d e f\n", "if x\n    pass\n", "def f():\n", "def f():\npass\n", "x = 1\n    y = 2\n", "x = 'open\n", "<<<<<<< HEAD\na = 1\n=======\na = 2\n>>>>>>> b\n", "import\n", "x = 1 +\n", "for in x:\n    pass\n", "func Run() { return }\n"]


def test_statements_agree_with_the_language(spark):
    assert all(map(valid, GOOD)) and not any(map(valid, BAD))
    texts = GOOD + BAD + [None, "   "]
    got = {r.k for r in st.python_faults(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()}
    assert got == set(range(len(GOOD), len(GOOD) + len(BAD)))


def test_recall_and_precision_on_mutated_sources(spark, data):
    """The project's Python texts, whole and damaged; the language's own parser says which of them are well-formed."""
    rnd = random.Random(4)
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").where("source = 'source_code'")
    texts = [r.text for r in docs.where(st.looks_like_python(F.col("text"))).collect()]
    others = [r.text for r in docs.where(~st.looks_like_python(F.col("text"))).limit(20).collect()]
    damaged = list(texts) + others
    for t in texts:
        at = rnd.randrange(len(t))
        lines = t.split("\n")
        i = rnd.randrange(len(lines))
        damaged += [t[:at], "\n".join([*lines[:i], "<<<<<<< ours", lines[i], "=======", "x = 1", ">>>>>>> theirs", *lines[i + 1 :]]), t[:at] + t[at + 1 :]]
    truth = {i for i, t in enumerate(damaged) if not valid(t)}
    got = {r.k for r in st.python_faults(spark.createDataFrame(list(enumerate(damaged)), "k int, t string"), "k", "t").collect()}
    assert len(truth & got) / len(truth) >= 0.95 and len(truth & got) / len(got) >= 0.95


def test_pairs_follow_from_rules():
    g = st.Lines((("a", "a"), ("b", "b"), ("c", "c")), {"s": "a b* (c | a)?"}, {"top": "s"})
    assert g.pairs("top") == {("^", "a"), ("a", "b"), ("b", "b"), ("a", "c"), ("a", "a"), ("b", "c"), ("b", "a"), ("a", "$"), ("b", "$"), ("c", "$")}
    with pytest.raises(ValueError):
        st.Lines((("a", "a"),), {"s": "a z"}, {"top": "s"}).pattern("top")
