"""Readers, patterns, diffs, bundles and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.engine import FAMILIES, Engine
from tessella.operators import change, journal, runtime
from tessella.sources import container, extract, formats, tree
from tessella.streaming import changes


@pytest.fixture(scope="module")
def source_tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {
        "src/app.ts": "import { a } from './util';\nimport x from '@org/pkg';\napp.get('/users/:id', f);\nfetch('/users/7?x=1', { method: 'POST' });\nprocess.env.API_URL;", "src/util.ts": "export const a = () => 1;\ninterface Shape { x: number }",
        "src/util.test.ts": "x", "node_modules/p/i.js": "x", "api/main.py": "from .models import User\nimport os\n@app.post('/items')\ndef create(): os.getenv('DB_URL')", "api/models.py": "class User(BaseModel):\n    pass\n__tablename__ = 'users'",
        ".env": "SECRET=1", "my_secret.py": "x", "README.md": "x", "main.go": "import (\n  \"fmt\"\n)\nfunc Run() {}\ntype Item struct {\n}",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_discovery(spark, source_tree):
    got = sorted(r.path for r in tree.read_tree(spark, source_tree).collect())
    assert got == ["api/main.py", "api/models.py", "main.go", "src/app.ts", "src/util.ts"]


def test_extraction_and_resolution(spark, source_tree):
    c = tree.read_tree(spark, source_tree).select(F.col("path").alias("file"), "content").cache()
    assert {(r.file, r.method, r.path) for r in extract.routes(c).collect()} == {("src/app.ts", "GET", "/users/:id"), ("api/main.py", "POST", "/items")}
    assert {(r.kind, r.name) for r in extract.models(c).collect()} == {("interface", "Shape"), ("pydantic", "User"), ("struct", "Item")}
    assert {r.name for r in extract.variables(c).collect()} == {"API_URL", "DB_URL"} and {r.name for r in extract.tables(c).collect()} == {"users"}
    assert {"create", "Run", "a"} <= {r.name for r in extract.functions(c).collect()}
    found = {(r.file, r.target): r.resolved for r in extract.resolve_imports(extract.imports(c), c.select(F.col("file").alias("path"))).collect()}
    assert found == {("src/app.ts", "./util"): "src/util.ts", ("src/app.ts", "@org/pkg"): None, ("api/main.py", ".models"): "api/models.py", ("api/main.py", "os"): None, ("main.go", "fmt"): None}
    calls = runtime.calls(c)
    assert [(r.method, r.path) for r in calls.collect()] == [("POST", "/users/7")]
    matched = runtime.match_calls(calls, extract.routes(c).select("file", "method", "path")).head()
    assert (matched.route_file, matched.route_path) == ("src/app.ts", "/users/:id")


def test_registered_extractors(spark):
    extract.register_extractor(".toy", lambda content, file: [{"kind": "word", "name": w} for w in content.split()])
    extract.register_extractor("bad", lambda content, file: 1 / 0)
    df = spark.createDataFrame([("a.toy", "x y"), ("b.bad", "z"), ("c.md", "n"), ("d.toy", None)], "file string, content string")
    got = sorted(map(tuple, extract.run_extractors(df).collect()), key=str)
    assert got == [("a.toy", "word", "x", None), ("a.toy", "word", "y", None), ("b.bad", None, None, "ZeroDivisionError: division by zero")]
    with pytest.raises(TypeError):
        extract.register_extractor("x", 5)


def test_detect_changes(spark):
    a = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 1, "h"), ("changed", 1, 1, "h"), ("gone", 1, 1, "h")], "path string, mtime int, size int, hash string")
    b = spark.createDataFrame([("same", 1, 1, "?"), ("touched", 2, 1, "h"), ("changed", 1, 2, "i"), ("new", 1, 1, None)], "path string, mtime int, size int, hash string")
    assert {(r.path, r.change) for r in tree.detect_changes(a, b).collect()} == {("touched", "touched"), ("changed", "changed"), ("gone", "removed"), ("new", "new")}


DIFF = """diff --git a/src/a.ts b/src/a.ts
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,3 +1,3 @@
 keep
-function oldName() {}
+function newName() {}
--- looks like a header
+import y from 'src/pay/b'
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1 @@
+def fresh(): pass
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x = 1
diff --git a/o.ts b/n.ts
similarity index 100%
rename from o.ts
rename to n.ts
diff --git a/p.png b/p.png
Binary files a/p.png and b/p.png differ
"""


def test_diffs(spark):
    rows = formats.diff_rows(DIFF)
    assert ("src/a.ts", None, "modify", "-", 2, "function oldName() {}") in rows and ("src/a.ts", None, "modify", "+", 2, "function newName() {}") in rows and ("src/a.ts", None, "modify", "-", 3, "-- looks like a header") in rows
    assert ("new.py", None, "add", "+", 1, "def fresh(): pass") in rows and ("gone.py", None, "delete", "-", 1, "x = 1") in rows and ("n.ts", "o.ts", "rename", "", 0, "") in rows and not any(r[0] == "p.png" for r in rows)
    assert formats.diff_rows(None) == [] and formats.diff_rows("no diff\n@@ what") == []
    d = formats.parse_diffs(spark.createDataFrame([(1, DIFF), (2, None)], "k int, t string"), "k", "t").cache()
    files = spark.createDataFrame([(1, "src/a.ts", "AUTH"), (2, "src/pay/b.ts", "PAYMENTS"), (3, "user.ts", None)], "id long, path string, domain string")
    edges = spark.createDataFrame([(3, 1)], "src long, dst long")
    assert [(r.id, r.hop) for r in change.diff_reach(d, files, edges).collect()] == [(3, 1)]
    assert [(r.path, r.target, r.from_domain, r.to_domain) for r in change.new_domain_links(d, files, edges).collect()] == [("src/a.ts", "src/pay/b.ts", "AUTH", "PAYMENTS")]
    told = {(r.change, r.old, r.new) for r in change.semantic_changes(d).collect()}
    assert ("renamed", "oldName", "newName") in told and ("file rename", "o.ts", "n.ts") in told
    whole = formats.diff_rows(formats.whole_file_diff("a.py", "x\ny", "z"))
    assert [(r[3], r[4], r[5]) for r in whole] == [("-", 1, "x"), ("-", 2, "y"), ("+", 1, "z")]


def test_formats(spark):
    log = spark.createDataFrame([(1, "COMMIT|abc|86400\nsrc/a.ts\nsrc/b.ts\n\nCOMMIT|def|90000\n")], "key int, text string")
    assert sorted(((r.sha, r.path) for r in formats.commit_log(log).collect()), key=str) == [("abc", "src/a.ts"), ("abc", "src/b.ts"), ("def", None)]
    span = lambda m, p: {"attributes": [{"key": "http.method", "value": {"stringValue": m}}, {"key": "http.route", "value": {"stringValue": p}}]}
    doc = {"resourceSpans": [{"scopeSpans": [{"spans": [span("get", "/a?x"), span("GET", "/a"), {"name": "none"}]}]}]}
    traces = spark.createDataFrame([(json.dumps(doc),), (json.dumps(doc) + "\n" + json.dumps({"spans": [span("POST", "/b")]}),), ("broken {",), (None,)], "text string")
    assert {(r.method, r.path): r["count"] for r in formats.trace_counts(traces).collect()} == {("GET", "/a"): 4, ("POST", "/b"): 1}
    texts = spark.createDataFrame(
        [
            ("m.tf", 'resource "aws_s3_bucket" "b" {\n}\nmodule "net" {\n}'), ("x/Chart.yaml", "name: web\nversion: 1"), ("stack.ts", "import * as s3 from 'aws-cdk-lib';\nnew s3.Bucket(this, 'logs')"), ("plain.ts", "new Foo('x')"),
            ("package.json", '{"dependencies": {"@org/a": "1"}, "devDependencies": {"b": "2"}}'), ("go.mod", "require (\n\texample.org/x/y v1.2.0\n)"), ("pyproject.toml", '[tool]\nrequests = "^2"\nname = "me"'),
            ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>3</version></dependency>"), ("db/migrations/1.sql", "CREATE TABLE IF NOT EXISTS users (id int)"), ("a.proto", 'import "b.proto";'),
        ],
        "file string, content string",
    )
    assert {(r.kind, r.type, r.name) for r in formats.infrastructure(texts).collect()} == {("resource", "aws_s3_bucket", "b"), ("module", None, "net"), ("helm-chart", None, "web"), ("construct", "s3.Bucket", "logs")}
    assert {(r.ecosystem, r.name, r.version) for r in formats.requirements(texts).collect()} == {("npm", "@org/a", "1"), ("npm", "b", "2"), ("go", "example.org/x/y", "v1.2.0"), ("pypi", "requests", "^2"), ("maven", "g:a", "3")}
    assert {(r.kind, r.target) for r in formats.schema_links(texts).collect()} == {("db-table", "users"), ("grpc", "b.proto")}


def test_bundle(spark, tmp_path):
    path = f"file://{tmp_path}/bundle"
    edges = spark.createDataFrame([(1, 2), (3, None)], "src long, dst long")
    container.save(path, {"edges": edges}, {"commit": "abc"})
    assert sorted(map(tuple, container.load(spark, path, verify=True)["edges"].collect()), key=str) == [(1, 2), (3, None)]
    edges.limit(1).write.mode("overwrite").parquet(f"{path}/edges")
    with pytest.raises(ValueError):
        container.load(spark, path, verify=True)
    assert [container.staleness(*a) for a in [("a", "a", set(), False), ("a", "a", set(), True), ("a", "b", {"a"}, False), ("a", "b", set(), False), (None, "b", set(), False)]] == ["fresh", "dirty", "behind", "diverged", "unknown"]


def test_bursts_and_upserts(spark, tmp_path, moment):
    rows = [("r", moment(1), f"f{i}", i, "k") for i in range(25)] + [("r", moment(2), "g", 30, "k"), ("s", moment(1), "h", 31, "k"), ("r", moment(3), "f1", 40, "z")]
    spark.createDataFrame(rows, "root string, ts timestamp, file string, id long, kind string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("root string, ts timestamp, file string, id long, kind string").parquet(f"{tmp_path}/in")
    got = changes.run_once(changes.bursts(stream()), "bursts_test", "append")
    assert [(r.root, r.files) for r in got.collect()] == [("r", 21)]
    target = f"{tmp_path}/table"
    stream().writeStream.foreachBatch(changes.upserts(target)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    table = {r.file: r.id for r in changes.latest_version(spark, target).collect()}
    assert len(table) == 27 and table["f1"] == 40


def test_journal(spark):
    old = spark.createDataFrame([("a", True, "why"), ("gone", True, None)], "hash string, dismissed boolean, reason string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "hash string, line int")
    assert sorted(map(tuple, journal.merge_gaps(old, new).collect())) == [("a", 1, True, "why"), ("b", 2, False, None)]
    log = spark.createDataFrame([(1, "x"), (2, "y")], "id long, kind string")
    assert journal.append(log, spark.createDataFrame([(2, "again"), (3, "z"), (3, "z")], "id long, kind string")).count() == 3


def test_facade(spark, data):
    e = Engine(spark, data)
    assert all(q in e.names() for family in FAMILIES.values() for q in family.values())
    assert e.query("history", "velocity").columns == ["day", "commits"] and e.query("org").columns == ["from_repo", "to_repo", "kind", "edges"]
    with pytest.raises(KeyError):
        e.query("no such query")
    e.register_rule("long", lambda t: t["files"].where("size > 5").select(F.col("path").alias("file"), F.lit(None).alias("line"), F.lit("HIGH").alias("severity")))
    files = spark.createDataFrame([("a", 9), ("a", 9), ("b", 1)], "path string, size int")
    assert [r.file for r in e.findings({"files": files}).collect()] == ["a"] and Engine(spark, data).findings({}).count() == 0
