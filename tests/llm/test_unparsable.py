from pyspark.sql import functions as F

from tessella.llm import unparsable as u
from tessella.llm.grammar import Grammar

BAD = [
    "Unexpected token (3:4)", "TS1005: '}' expected. (23,9)", "12:3: missing ',' before newline in composite literal", "invalid syntax (<unknown>, line 4)", "'(' was never closed (a/b.py, line 2)",
    "leftover conflict marker ======= (7:1)", "UNEXPECTED EOF WHILE PARSING", "a/b/C.java:9: error: ';' expected\n\n  8 | x\n> 9 | y\n   ^", "NUL bytes between offsets 1 and 2, cannot be tokenised", "JSON object at top level where go source was expected", "Identifier 'x' has already been declared. (1:2)",
]
GOOD = [
    None, "", "unexpected token in plugin credentials, anonymous mode used", "option 'x' expected boolean, found string", "module 'token-parser' has no export 'parse'", "parse: timed out after 9 ms", "EACCES: permission denied, open 'a/syntax/error.py'",
    "file is 9 bytes, limit is 3; not read", "plugin manifest: missing ';' between include patterns 1 and 2", "missing semicolon inserted, file accepted", "worker exited with code 1\n    at unexpectedToken (a/b.js:1:2)", "x" * 100_000,
]


def test_messages(spark):
    rows = [(i, i, m) for i, m in enumerate(BAD + GOOD)] + [(3, 3, BAD[3]), (None, 1, BAD[0])]
    got = {r.error_id: r.malformed for r in u.judged_messages(spark.createDataFrame(rows, "id long, file_id long, error_message string")).collect()}
    assert got == {i: i < len(BAD) for i in range(len(BAD + GOOD))}


def test_files_and_rates(spark, moment):
    errors = spark.createDataFrame([(1, 1, BAD[0]), (2, 1, GOOD[2]), (3, 2, GOOD[2]), (4, 99, BAD[0]), (5, None, BAD[1])], "id long, file_id long, error_message string")
    files = spark.createDataFrame([(1, "r", "py", moment(1)), (1, "r", "Python", moment(2)), (2, "r", None, None)], "id long, repo_name string, language string, last_indexed_at timestamp_ntz")
    assert [r.file_id for r in u.unparsable_files(errors, files).collect()] == [1]
    assert sorted(map(tuple, u.rates(errors, files).collect())) == [("r", "python", 1, 1, 1.0), ("r", "unknown", 1, 0, 0.0)]
    assert u.unparsable_files(errors.limit(0), files).count() == 0


def test_pairs_follow_from_rules():
    g = Grammar((("a", "a"), ("b", "b"), ("c", "c")), {"s": (("a", "t", "c"),), "t": ((), ("b", "t"))}, "s")
    assert g.pairs == {("^", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "$")}


def test_source_texts(spark):
    texts = ["def f(a):\n    return [a, {1: 2}]\n", "x = (1, 2]", "f(", ")", 'a = "open\nb', "a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n", "// it's ( fine\n/* { */ a", "", None, "s = 'it\\'s ('; t = \"]\"", "([{}])" * 3000]
    got = {r.k: (r.conflict, r.open_string, r.nesting) for r in u.unparsable_texts(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[4][1] and got[5][0] and got[1][2] and got[2][2] and got[3][2]
