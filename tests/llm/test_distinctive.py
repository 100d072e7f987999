import math
from collections import Counter, defaultdict

from tessella.functions.words import identifier_words
from tessella.llm.distinctive import file_terms, residual_idf
from pyspark.sql import functions as F


def test_words(spark):
    df = spark.createDataFrame([("parseHTTPRequest_v2",), ("getÄrger",), ("__x--Y9z",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(identifier_words(F.col("t"))).collect()] == [["parse", "http", "request", "v2"], ["get", "ärger"], ["x", "y9z"], [], None]


def test_scores_equal_the_formula(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "c"), (3, "c"), (None, "a"), (2, None)] + [(i, "hot") for i in range(1, 60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "r long, t string, score string")
    tf = Counter(r for r in rows if None not in r)
    n = len({r for r, _ in tf})
    cf, docs = Counter(), defaultdict(set)
    for (r, t), k in tf.items():
        cf[t] += k
        docs[t].add(r)
    got = {(x.r, x.t): x for x in residual_idf(df, "r", "t").collect()}
    assert set(got) == set(tf)
    for (r, t), x in got.items():
        ridf = math.log2(n / len(docs[t])) + math.log2(1 - math.exp(-cf[t] / n))
        assert (x.tf, x.df, x.cf) == (tf[r, t], len(docs[t]), cf[t]) and abs(x.ridf - ridf) < 1e-9 and abs(x.score - tf[r, t] * ridf) < 1e-9
    # Three uses in one record tell more than one use in each of three.
    assert residual_idf(df.limit(0), "r", "t").count() == 0


def test_file_terms(spark, moment):
    files = spark.createDataFrame([(1, "./a\\Foo.ts", moment(1)), (1, "b/barBaz.ts", moment(2)), (2, None, None), (None, "x/y", moment(1))], "id long, path string, last_indexed_at timestamp_ntz")
    symbols = spark.createDataFrame([(1, 1, "getBar"), (1, 1, "getBar"), (2, 9, "lost"), (3, None, "none"), (4, 2, None)], "id long, file_id long, name string")
    words, n = file_terms(files, symbols)
    assert n == 2 and sorted(map(tuple, words.collect())) == [(1, "b", 1), (1, "bar", 2), (1, "baz", 1), (1, "get", 1), (1, "ts", 1)]
