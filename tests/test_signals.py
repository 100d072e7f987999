"""Time, mining, retrieval, planning and risk operators on small fixtures with nulls, ties, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import attention, history, journal, mining, planning, retrieval, risk, runtime, structure, temporal

SNAP = "id long, repo_name string, ts timestamp_ntz, commit_sha string"
MEMB = "snapshot_id long, file_path string, domain_name string, recorded_at timestamp_ntz"


@pytest.fixture(scope="module")
def series(spark, moment):
    snaps = spark.createDataFrame([(1, "r", moment(1), None), (2, "r", moment(10), None), (3, "r", moment(20), None)], SNAP)
    rows = [(1, f"a{i}", "A", None) for i in range(10)] + [(2, f"a{i}", "A", None) for i in range(4)] + [(2, f"a{i}", "B", None) for i in range(4, 10)] + [(3, f"a{i}", "B", None) for i in range(10)] + [(3, "n", None, None)]
    return history.full_snapshots(snaps, spark.createDataFrame(rows, MEMB))


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_ranges():
    assert [temporal.range_ms(x) for x in ("90d", "12 h", "2w", "7", "1y")] == [7776000000, 43200000, 1209600000, 604800000, 31536000000]
    with pytest.raises(ValueError):
        temporal.range_ms("soon")


def test_series_reports(series):
    assert rows(temporal.drift(*series)) == [("r", "A", 10, 0, -10, "shrinking"), ("r", "B", 0, 10, 10, "growing")]
    assert rows(temporal.evolution(*series, "A"), "snapshot_id", "files") == [(1, 10), (2, 4), (3, 0)]
    assert rows(temporal.events(*series), "snapshot_id", "domain", "kind", "severity") == [
        (2, "A", "domain_unstable", "critical"), (2, "A", "shrink", "major"), (2, "B", "new_domain", "minor"), (3, "A", "domain_disappeared", "minor"),
    ]
    assert rows(temporal.health(*series, days=9), "domain", "before", "after", "growth_rate", "moved") == [("A", 4, 0, -1.0, 4), ("B", 6, 10, 0.67, 0)]
    empty = (series[0].limit(0), series[1].limit(0))
    assert all(f(*empty).count() == 0 for f in (temporal.drift, temporal.events, temporal.health, temporal.presence))


def test_snapshot_intake_is_idempotent(spark):
    cols = "repo_name string, commit_sha string, source string, n int"
    known = spark.createDataFrame([("r", "a", "sync", 1)], cols)
    new = spark.createDataFrame([("r", "a", "sync", 2), ("r", "a", "commit", 3), ("r", "a", "commit", 4), ("r", None, "sync", 5), ("r", None, "sync", 5)], cols)
    assert rows(temporal.new_snapshots(known, new), "commit_sha", "source") == [("a", "commit"), (None, "sync"), (None, "sync")]


def test_churn_and_co_change(spark, moment):
    commits = spark.createDataFrame([(1, moment(1)), (2, moment(2)), (3, moment(3))], "sha long, ts timestamp_ntz")
    touched = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5), (2, 6), (3, 5), (9, 7)], "sha long, file long")
    assert rows(temporal.churn(commits, touched), "file", "commits") == [(5, 3), (6, 2)]
    pairs = mining.co_change(touched)
    assert rows(pairs) == [(5, 6, 2, 3, 2, 1.0)]
    assert rows(mining.action_patterns(pairs, least=2), "anchor", "partner") == [(5, 6), (6, 5)]
    assert rows(mining.action_patterns(pairs), "anchor", "partner") == [(5, 6)]  # an anchor needs three commits


def test_conventions(spark):
    names = ["a-b", "a_b", "AbC", "abC", "abc", "", None, "A"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(mining.name_case(F.col("n"))).collect()]
    assert got == ["kebab-case", "snake_case", "PascalCase", "camelCase", None, None, None, None]
    df = spark.createDataFrame([("g", "x")] * 3 + [("g", "y")] + [("g", None)] + [("h", "x"), ("h", "y")], "g string, v string")
    assert rows(mining.convention(df, ["g"], "v")) == [("g", "x", 3, 4, 0.75)]
    assert rows(structure.leading_value(df.dropna().groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), ["g"], "v")) == [("g", "x", 3, 4, 0.75), ("h", "x", 1, 2, 0.5)]


def test_globs_and_filters(spark):
    df = spark.createDataFrame([("src/a.ts",), ("src/b/c.ts",), ("lib/xa.ts",), (None,)], "p string")
    hit = lambda g: rows(df.where(F.col("p").rlike(structure.glob_pattern(g))))
    assert hit("src/*.ts") == [("src/a.ts",)] and hit("**/c.ts") == [("src/b/c.ts",)] and hit("lib/?a.ts") == [("lib/xa.ts",)] and hit("src/**") == [("src/a.ts",), ("src/b/c.ts",)]
    assert structure.where_given(df, p=None).count() == 4 and structure.where_given(df, p=["src/a.ts", "zz"]).count() == 1


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "cache cache token"), (2, "token"), (3, "nothing here"), (4, ""), (5, None)], "d long, t string")
    posted = retrieval.postings(docs.dropna(), "d", F.split("t", " ")).where("token <> ''")
    best = retrieval.bm25(posted, "d", ["cache", "token"], 4, 2.0)
    assert [r.d for r in best.collect()] == [1, 2] and retrieval.bm25(posted, "d", ["absent"], 4, 2.0).count() == 0
    fused = retrieval.fuse([best, spark.createDataFrame([(2, 9.0), (3, 9.0)], "d long, score double")], "d")
    assert [(r.d, r.channels) for r in fused.collect()] == [(2, 2), (1, 1), (3, 1)]
    line = spark.createDataFrame([(1, "a", 600), (2, "b", 900), (3, "c", 300), (4, "d", 500)], "rank int, k string, cost long")
    assert rows(retrieval.pack(line, "k", "cost", 1200), "k", "used", "mode") == [("a", 600, "full"), ("b", 200, "summary"), ("c", 300, "full")]


def test_nearest(spark):
    v = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.9, 0.1]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None)]
    df = spark.createDataFrame(v, "i long, e array<double>")
    got = retrieval.nearest(df, "i", "e", df.where("i in (1, 5, 6)"), k=2, block=1)
    assert rows(got) == [(1, 1, 2), (1, 2, 3)] and retrieval.nearest(df.limit(0), "i", "e", df.limit(0)).count() == 0


def test_planning(spark, moment):
    assert planning.intent("Add POST /api/rate-limit to the Invoice webhook") == {"content": ["post", "invoice", "webhook", "api", "rate", "limit"], "verbs": ["POST"], "paths": ["/api/rate-limit"]}
    assert planning.intent(None)["content"] == []
    files = spark.createDataFrame([(1, "r/invoice/a.ts", "A"), (2, "r/b.ts", None), (3, None, None)], "id long, path string, domain string")
    symbols = spark.createDataFrame([(2, "sendInvoice", True), (2, "x", True), (2, None, True)], "file_id long, name string, exported boolean")
    assert [(r.id, r.reasons) for r in planning.anchors(files, symbols, ["invoice"]).collect()] == [(1, ["path:invoice"]), (2, ["symbol:invoice"])]
    assert planning.anchors(files, symbols, ["none"]).count() == 0
    edges = spark.createDataFrame([(1, 2), (2, 2)], "src long, dst long")
    one = planning.file_context(files, edges, symbols.dropna(), spark.createDataFrame([(2,)], "id long")).head()
    assert (one.exports, one.imports, one.imported_by) == (["sendInvoice", "x"], [], ["r/invoice/a.ts"])
    docs = spark.createDataFrame([(1, moment(1)), (2, None)], "d long, w timestamp_ntz")
    assert rows(planning.stale(docs, "d", "w", F.lit(moment(31)), days=20)) == [(1, 30)]
    log = spark.createDataFrame([(1, '{"pending": true}', moment(3)), (2, "{}", moment(3)), (3, None, moment(3)), (4, "no json", None), (5, '{"unresolved": true}', moment(1)), (6, '{"risk": "HIGH"}', moment(2))], "id long, payload string, ts timestamp_ntz")
    assert sorted(r.id for r in attention.pending(log, F.lit(moment(2))).collect()) == [1, 6]


def test_risk_and_tests(spark):
    files = spark.createDataFrame([(1, "r", "src/a.ts"), (2, "r", "src/b.py"), (3, "r", "tests/test_b.py"), (4, "r", "src/index.ts"), (5, "r", "x.md"), (6, "q", "b.py"), (7, "r", None)], "id long, repo_name string, path string")
    assert rows(risk.untested(files), "id") == [(1,), (6,)]
    none = files.limit(0).select("id")
    got = risk.risk_scores(files.where("id < 3"), spark.createDataFrame([(1, 4), (2, 2)], "id long, dependents long"), spark.createDataFrame([(1, 5)], "id long, commits long"), none, none.withColumn("n", F.lit(1)), risk.untested(files), limit=5)
    assert [(r.id, r.score) for r in got.collect()] == [(1, 0.65), (2, 0.15)]
    blame = spark.createDataFrame([(1, 9, 5), (1, 8, 5), (2, 7, 1)], "file long, author long, lines long")
    assert rows(risk.ownership(blame), "file", "author", "share") == [(1, 8, 0.5), (2, 7, 1.0)]
    edges = spark.createDataFrame([(1, 2), (2, 2)], "src long, dst long")
    assert rows(risk.cross_owner_edges(edges, risk.ownership(blame)), "src", "dst") == [(1, 2)]


def test_traffic(spark):
    routes = spark.createDataFrame([(1, "GET", "/u/:id"), (2, "POST", "/u/{id}"), (3, "GET", "/none")], "file long, method string, path string")
    counts = spark.createDataFrame([("GET", "/u/1", 2), ("GET", "/u/2?x", 3)], "method string, path string, count long")
    impact = spark.createDataFrame([(1, 4)], "id long, dependents long")
    assert rows(runtime.weighted_routes(routes, counts, impact), "file", "calls", "weight") == [(1, 5, 24), (2, 0, 0), (3, 0, 0)]
    orphans = spark.createDataFrame([(1, "a"), (3, "c"), (9, "z")], "id long, path string")
    assert rows(runtime.unused(orphans, routes, counts), "id", "confidence") == [(3, 0.9), (9, 0.6)]


def test_log(spark, moment):
    log = spark.createDataFrame([(1, moment(1, 0), 1, "k", "f", None, None), (2, moment(1, 0), 2, "k", "f", "HIGH", None), (3, moment(1, 2), 1, "j", None, "LOW", True)], "id long, ts timestamp_ntz, session_id long, kind string, file string, severity string, accepted boolean")
    assert rows(journal.conflicts(log), "file", "sessions") == [("f", 2)] and rows(journal.attribution(log)) == [("j", 1, 1, 0), ("k", 2, 2, 1)]
    assert rows(journal.replay(log), "session_id", "id", "step", "gap_s") == [(1, 1, 1, None), (1, 3, 2, 7200), (2, 2, 1, None)]
    assert rows(journal.latest_per_file(log), "file", "id") == [("f", 2)] and {r.n for r in journal.severity_counts(log).where("severity is null and kind is null").collect()} == {2}
