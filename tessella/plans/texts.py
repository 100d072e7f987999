"""Queries over texts: diffs, version-control output, traces, infrastructure, manifests, sources. The test tables hold no such files, so small ones stand here, and the SQL tells what must come out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import change, runtime
from tessella.operators import domains as d
from tessella.operators import risk as k
from tessella.operators import structure as s
from tessella.plans.registry import CORE
from tessella.sources import extract, formats, project

_PAGE = "\n".join(f"+const v{n} = {n};" for n in range(51))
DIFF = f"""diff --git a/src/core/db.ts b/src/core/db.ts
--- a/src/core/db.ts
+++ b/src/core/db.ts
@@ -4,2 +4,3 @@
 context
-export function oldName(a) {{
+export function newName(a) {{
+// import './no'
diff --git a/src/ui/page.ts b/src/ui/page.ts
--- a/src/ui/page.ts
+++ b/src/ui/page.ts
@@ -1,1 +1,53 @@
+import {{ login }} from '../auth/login';
+import {{ db }} from '@core/db';
{_PAGE}
diff --git a/tools/gen/new.py b/tools/gen/new.py
new file mode 100644
--- /dev/null
+++ b/tools/gen/new.py
@@ -0,0 +1,2 @@
+from os import path
+import json
diff --git a/old.txt b/older.txt
rename from old.txt
rename to older.txt
"""


def _values(columns: str, *rows: tuple) -> str:
    """SQL that gives the rows as they must come out."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def _diff(spark: SparkSession) -> DataFrame:
    return formats.parse_diffs(spark.createDataFrame([(1, DIFF)], "id int, text string"), "id", "text")


def _project(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """57 views need the database and 25 of them the page; each lies in a domain."""
    files = [(1, "src/core/db.ts", "CORE"), (2, "src/auth/login.ts", "AUTH"), (3, "src/ui/page.ts", "UI")] + [(n, f"src/ui/v{n}.ts", "UI") for n in range(4, 61)]
    edges = [(n, 1) for n in range(4, 61)] + [(n, 3) for n in range(4, 29)]
    return spark.createDataFrame(files, "id long, path string, domain string"), spark.createDataFrame(edges, "src long, dst long")


@CORE.query("diff_summary", _values("path, kind, added, removed", ("src/core/db.ts", "modify", 2, 1), ("src/ui/page.ts", "modify", 53, 0), ("tools/gen/new.py", "add", 2, 0), ("older.txt", "rename", 0, 0)))
def diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Lines added and removed per file of a diff."""
    return change.diff_summary(_diff(spark))


@CORE.query("diff_imports", _values("path, line, target", ("src/ui/page.ts", 1, "../auth/login"), ("src/ui/page.ts", 2, "@core/db"), ("tools/gen/new.py", 1, "os"), ("tools/gen/new.py", 2, "json")))
def diff_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Imports that a diff adds."""
    return formats.added_imports(_diff(spark))


_ALIASES = {"@core/": "src/core/"}


def _violations(spark: SparkSession) -> DataFrame:
    return change.violations(_diff(spark), *_project(spark), aliases=_ALIASES)


@CORE.query(
    "diff_violations",
    _values(
        "kind, severity, path, detail, suggestion", ("high_blast", "HIGH", "src/core/db.ts", "57", None), ("high_blast", "MEDIUM", "src/ui/page.ts", "25", "split_file"),
        ("cross_domain", "HIGH", "src/ui/page.ts", "src/auth/login.ts", "add_interface"), ("cross_domain", "MEDIUM", "src/ui/page.ts", "src/core/db.ts", None),
    ),
)
def diff_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What a diff does that wants a look."""
    return _violations(spark)


@CORE.query("validate_diff", _values("risk, files, dependents, violations, blocked", ("HIGH", 4, 57, 4, True)))
def validate_diff(spark: SparkSession, folder: str) -> DataFrame:
    """One verdict on a diff, and whether a gate at HIGH stops it."""
    told = change.verdict(_diff(spark), *_project(spark), _violations(spark))
    return told.withColumn("blocked", change.should_block(F.col("risk")))


@CORE.query("validate_file", _values("risk, files, dependents, violations, blocked", ("MEDIUM", 1, 0, 0, False)))
def validate_file(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict on a file's new content; an open finding on the file lifts it."""
    files, edges = _project(spark)
    text = formats.whole_file_diff("src/ui/v60.ts", "a\n", "b\n")
    diff = formats.parse_diffs(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    gaps = spark.createDataFrame([("src/ui/v60.ts", "MEDIUM"), ("src/core/db.ts", "HIGH")], "path string, severity string")
    return change.verdict(diff, files, edges, change.violations(diff, files, edges), gaps).withColumn("blocked", change.should_block(F.col("risk")))


@CORE.query("diff_log", _values("kind, severity, file", ("validate_diff", None, None), ("high_blast", "HIGH", "src/core/db.ts"), ("high_blast", "MEDIUM", "src/ui/page.ts"), ("cross_domain", "HIGH", "src/ui/page.ts"), ("cross_domain", "MEDIUM", "src/ui/page.ts")))
def diff_log(spark: SparkSession, folder: str) -> DataFrame:
    """What a validated diff leaves in the log."""
    return change.log_entries(DIFF, _violations(spark), "s1").select("kind", "severity", "file")


@CORE.query("semantic_diff", _values("change, old, new", ("renamed", "oldName", "newName"), ("file rename", "old.txt", "older.txt"), ("file add", None, "tools/gen/new.py"), ("new prefix", None, "tools/gen")))
def semantic_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Renames, new files and new places of a diff."""
    diff = _diff(spark)
    fresh = change.new_prefixes(diff, _project(spark)[0]).select(F.lit("new prefix").alias("change"), F.lit(None).cast("string").alias("old"), F.col("prefix").alias("new"))
    return change.semantic_changes(diff).select("change", "old", "new").unionByName(fresh)


@CORE.query("log_source", _values("sha, path, day", ("abc", "src/a.ts", "1970-01-02"), ("abc", "src/b.py", "1970-01-02"), ("def", None, "1970-01-03")))
def log_source(spark: SparkSession, folder: str) -> DataFrame:
    """Commits and their files out of a version-control log."""
    log = spark.createDataFrame([(1, "COMMIT|abc|86400\nsrc/a.ts\nsrc/b.py\n\nCOMMIT|def|172800\n")], "key int, text string")
    return formats.commit_log(log).select("sha", "path", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@CORE.query("blame_source", _values("file, author, lines", ("a.ts", "Ann", 2), ("a.ts", "Bo Lee", 1)))
def blame_source(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per author out of porcelain blame text."""
    text = "".join(f"{n:040d} 1 1 1\nauthor {name}\nauthor-mail <x@y>\n\tcode {n}\n" for n, name in enumerate(("Ann", "Bo Lee", "Ann")))
    return formats.blame_lines(spark.createDataFrame([("a.ts", text), ("empty.ts", ""), ("none.ts", None)], "file string, text string"))


@CORE.query("status_source", _values("change, path, old_path", ("modified", "src/a.ts", None), ("added", "new.ts", None), ("deleted", "gone.ts", None), ("renamed", "to.ts", "from.ts"), ("added", "staged.ts", None)))
def status_source(spark: SparkSession, folder: str) -> DataFrame:
    """Changed paths out of a short status."""
    return formats.status_rows(spark.createDataFrame([(" M src/a.ts\n?? new.ts\n D gone.ts\nR  from.ts -> to.ts\nA  staged.ts\n",)], "text string"))


def _span(method: str, path: str) -> dict:
    return {"attributes": [{"key": "http.method", "value": {"stringValue": method}}, {"key": "http.route", "value": {"stringValue": path}}]}


_TRACES = [
    (json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [_span("get", "/users/7?x=1"), _span("GET", "/users/:id"), _span("POST", "/pay")]}]}]}),),
    (json.dumps({"spans": [_span("GET", "/users/9")]}) + "\n" + json.dumps({"spans": [_span("POST", "/pay"), {"name": "none"}]}),), ("broken {",), (None,),
]
_ROUTES = [(1, "GET", "/users/{id}"), (2, "POST", "/pay"), (3, "GET", "/old"), (4, "DELETE", "/users/{id}")]
_SOURCES = [
    ("web/a.ts", "await fetch('/users/' + id); fetch(`/users/${id}?full=1`); axios.post('/pay', body); axios({method: 'delete', url: '/users/12'})"),
    ("web/b.js", "$.ajax({type: 'PUT', url: '/missing'}); jQuery.get(\"/old\", (x) => done(x)); fetch('/pay', {method: 'POST', body: f(g(1))}); $.ajax('/old')"),
    ("web/c.ts", "refetch('/users/1'); fetch('https://elsewhere/x'); nothing()"),
]


def _traces(spark: SparkSession) -> DataFrame:
    return formats.trace_counts(spark.createDataFrame(_TRACES, "text string"))


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ROUTES, "file long, method string, path string")


@CORE.query("trace_counts", _values("method, path, count", ("GET", "/users/7", 1), ("GET", "/users/:id", 1), ("GET", "/users/9", 1), ("POST", "/pay", 2)))
def trace_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Calls per route out of trace documents."""
    return _traces(spark)


@CORE.query("http_calls", _values("file, method, path", ("web/a.ts", "GET", "/users/"), ("web/a.ts", "GET", "/users/:id"), ("web/a.ts", "POST", "/pay"), ("web/a.ts", "DELETE", "/users/12"), ("web/b.js", "PUT", "/missing"), ("web/b.js", "GET", "/old"), ("web/b.js", "POST", "/pay"), ("web/b.js", "ALL", "/old")))
def http_calls(spark: SparkSession, folder: str) -> DataFrame:
    """HTTP calls of script sources."""
    return runtime.calls(spark.createDataFrame(_SOURCES, "file string, content string"))


@CORE.query(
    "call_graph_match",
    _values(
        "file, method, path, route_file", ("web/a.ts", "GET", "/users/", None), ("web/a.ts", "GET", "/users/:id", 1), ("web/a.ts", "POST", "/pay", 2), ("web/a.ts", "DELETE", "/users/12", 4), ("web/b.js", "PUT", "/missing", None),
        ("web/b.js", "GET", "/old", 3), ("web/b.js", "POST", "/pay", 2), ("web/b.js", "ALL", "/old", 3),
    ),
)
def call_graph_match(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of sources matched with the routes that serve them; null where none does."""
    return runtime.match_calls(runtime.calls(spark.createDataFrame(_SOURCES, "file string, content string")), _routes(spark)).select("file", "method", "path", "route_file")


@CORE.query("risk_weighted_routes", _values("file, calls, dependents, weight", (1, 3, 4, 16), (2, 2, 10, 30), (3, 0, 0, 0), (4, 0, 0, 0)))
def risk_weighted_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes weighted by the calls that traces tell and by dependents."""
    impact = spark.createDataFrame([(1, 4), (2, 10)], "id long, dependents long")
    return runtime.weighted_routes(_routes(spark), _traces(spark), impact).select("file", "calls", "dependents", "weight")


@CORE.query("dead_code", _values("id, confidence", (3, 0.9), (4, 0.9), (5, 0.6)))
def dead_code(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nobody imports and whose routes no trace calls."""
    files = spark.createDataFrame([(n, f"api/r{n}.ts", None) for n in range(1, 7)], "id long, path string, domain string")
    orphans = s.orphans(files, spark.createDataFrame([(5, 6), (6, 6)], "src long, dst long"))
    return runtime.unused(orphans, _routes(spark), _traces(spark)).select("id", F.col("confidence").cast("double").alias("confidence"))


@CORE.query("hot_without_tests", _values("id, path, calls", (2, "api/pay.ts", 2)))
def hot_without_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose routes are called and that no test covers."""
    files = spark.createDataFrame([(1, "r", "api/users.ts"), (2, "r", "api/pay.ts"), (3, "r", "api/old.ts"), (9, "r", "api/users.test.ts")], "id long, repo_name string, path string")
    none = spark.createDataFrame([], "id long, dependents long")
    called = runtime.weighted_routes(_routes(spark), _traces(spark), none).groupBy(F.col("file").alias("id")).agg(F.sum("calls").alias("calls")).where("calls > 0")
    return k.untested(files).join(called, "id").select("id", "path", "calls")


_PLACES = [
    ("infra/main.tf", 'resource "aws_s3_bucket" "logs" {\n  acl = "private"\n}\nresource "aws_sns_topic" "t" {\n  bucket = aws_s3_bucket.logs.arn\n}\nmodule "net" {\n}\ndata "aws_ami" "a" {\n}'),
    ("charts/web/Chart.yaml", "name: web\nversion: 1"), ("stack.ts", "import * as s3 from 'aws-cdk-lib';\nnew s3.Bucket(this, 'logs')"), ("plain.ts", "import x from '@org/ui/button';\nimport React from 'react';\nnew Foo('x')"),
    ("package.json", '{"name": "root", "dependencies": {"@org/a": "1", "express": "4", "stripe": "2"}, "devDependencies": {"react": "2"}}'), ("libs/core/package.json", '{"name": "@org/core"}'),
    ("go.mod", "module m\nrequire (\n\texample.org/x/y v1.2.0\n)"), ("pyproject.toml", '[tool.poetry.dependencies]\nrequests = "^2"\norg-lib = "1"\nname = "me"'), ("svc/main.py", "from fastapi import FastAPI\nimport redis.client\nfrom orgutil.io import x"),
    ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>3</version></dependency>"), ("db/migrations/1.sql", "CREATE TABLE IF NOT EXISTS users (id int)"), ("a.proto", 'import "b.proto";'),
]


def _places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PLACES, "file string, content string")


@CORE.query("infrastructure", _values("file, kind, type, name", ("infra/main.tf", "resource", "aws_s3_bucket", "logs"), ("infra/main.tf", "resource", "aws_sns_topic", "t"), ("infra/main.tf", "module", None, "net"), ("infra/main.tf", "data", "aws_ami", "a"), ("charts/web/Chart.yaml", "helm-chart", None, "web"), ("stack.ts", "construct", "s3.Bucket", "logs")))
def infrastructure(spark: SparkSession, folder: str) -> DataFrame:
    """Declared infrastructure."""
    return formats.infrastructure(_places(spark))


@CORE.query("infrastructure_links", _values("file, name, target", ("infra/main.tf", "aws_sns_topic.t", "aws_s3_bucket.logs")))
def infrastructure_links(spark: SparkSession, folder: str) -> DataFrame:
    """Which declared resource refers to which."""
    return formats.infrastructure_links(_places(spark))


@CORE.query(
    "manifest_packages",
    _values(
        "file, ecosystem, name, version", ("package.json", "npm", "@org/a", "1"), ("package.json", "npm", "express", "4"), ("package.json", "npm", "stripe", "2"), ("package.json", "npm", "react", "2"), ("go.mod", "go", "example.org/x/y", "v1.2.0"),
        ("pyproject.toml", "pypi", "requests", "^2"), ("pyproject.toml", "pypi", "org-lib", "1"), ("pom.xml", "maven", "g:a", "3"),
    ),
)
def manifest_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Packages that manifests declare."""
    return formats.requirements(_places(spark))


@CORE.query("published_edges", _values("kind, file, target", ("npm", "package.json", "@org/a"), ("npm", "plain.ts", "@org/ui"), ("pypi", "pyproject.toml", "org-lib"), ("pypi", "svc/main.py", "orgutil"), ("db-table", "db/migrations/1.sql", "users"), ("grpc", "a.proto", "b.proto")))
def published_edges(spark: SparkSession, folder: str) -> DataFrame:
    """What a repository uses of an organisation's own packages and schemas."""
    return formats.published_edges(_places(spark), ("@org/", "org"))


@CORE.query("workspace_packages", _values("name, folder", ("root", ""), ("@org/core", "libs/core")))
def workspace_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Packages of a workspace."""
    return project.workspace_packages(_places(spark))


@CORE.query("stack_labels", _values("label", ("Express",), ("FastAPI",), ("React",), ("Redis",), ("Stripe",)))
def stack_labels(spark: SparkSession, folder: str) -> DataFrame:
    """What a project is built on."""
    return project.stack(_places(spark))


@CORE.query("framework", _values("language, framework, confidence", ("typescript", "express", "high"), ("python", "generic", "low"), ("go", "generic", "low")))
def framework(spark: SparkSession, folder: str) -> DataFrame:
    """The framework of each language of a project."""
    return project.framework(_places(spark))


_CONFIG = '{"domains": {"billing": {"keywords": ["pay"], "globs": ["svc/**"], "anchor": ["infra/main.tf"]}, "web": ["ui", 7], "none": 3}}'


@CORE.query("configured_domains", _values("path, domain, confidence", ("svc/main.py", "BILLING", 1.0), ("infra/main.tf", "BILLING", 1.0), ("app/ui/x.ts", "WEB", 0.9), ("app/pay/x.ts", "BILLING", 0.9), ("plain.ts", "CORE", 0.2)))
def configured_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domains by a project's own configuration: globs and anchors before keywords."""
    told = project.read_config(_CONFIG) or {}
    files = spark.createDataFrame([(1, "svc/main.py"), (2, "infra/main.tf"), (3, "app/ui/x.ts"), (4, "app/pay/x.ts"), (5, "plain.ts")], "id long, path string")
    none = spark.createDataFrame([], "src long, dst long")
    assigned = d.assign(files, none, {n: c["keywords"] for n, c in told.items() if c["keywords"]}, {n: c["globs"] for n, c in told.items()}, {a: n for n, c in told.items() for a in c["anchor"]})
    return assigned.join(files, "id").select("path", "domain", F.col("confidence").cast("double").alias("confidence"))


_TSCONFIG = {"web/tsconfig.json": '{// own\n"extends": "../base.json", "compilerOptions": {"paths": {"@ui/*": ["ui/*"],}}}', "base.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@core/*": ["core/*"], "@ui/*": ["other/*"]}}}'}


@CORE.query("aliased_imports", _values("file, target, resolved", ("web/a.ts", "@ui/button", "src/ui/button.tsx"), ("web/a.ts", "@core/db", "src/core/db/index.ts"), ("web/a.ts", "../lib/x", "lib/x.ts"), ("web/a.ts", "react", None), ("pkg/m.py", ".near", "pkg/near.py")))
def aliased_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Imports resolved by the aliases of a compiler configuration and what it extends."""
    found = spark.createDataFrame([("web/a.ts", t) for t in ("@ui/button", "@core/db", "../lib/x", "react")] + [("pkg/m.py", ".near")], "file string, target string")
    listing = spark.createDataFrame([(p,) for p in ("src/ui/button.tsx", "src/core/db/index.ts", "lib/x.ts", "lib/x.js", "pkg/near.py", "web/a.ts")], "path string")
    return extract.resolve_imports(found, listing, project.path_aliases(_TSCONFIG, "web/tsconfig.json"))


_CODE = [
    ("a.ts", "export const r = router({ list: publicProcedure.input(z.object({ a: f(1) })).query(() => 1), save: t.procedure.mutation(x), live: p.procedure.subscription(y) });\napp.get('/ts', h);\nconst User = z.object({});\nprocess.env.API_KEY"),
    ("b.py", "@app.get('/py')\ndef read():\n    return os.getenv('DB_URL')\nclass Item(BaseModel):\n    pass\n__tablename__ = 'items'"), ("c.go", 'package c\ntype Node struct {\n}\nfunc Run() {}\nr.GET("/go", h)\nos.Getenv("HOME")'),
    ("D.java", '@GetMapping("/java")\npublic void x() {}\nrecord Pair(int a) {}\nSystem.getenv("PATH")'), ("e.rb", "get '/rb'\nclass Post < ApplicationRecord\nend\nENV['TOKEN']"), ("f.rs", '#[get("/rs")]\nfn f() {}\nstruct Row {}\nstd::env::var("RUST_LOG")'),
    ("g.cs", '[HttpPost("/cs")]\npublic class Order {}\nEnvironment.GetEnvironmentVariable("ASPNET")'), ("h.php", "Route::get('/php', 1);\nclass Cart extends Model {}\ngetenv('PHP_ENV')"),
]


def _code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CODE, "file string, content string")


@CORE.query("extracted_routes", _values("file, method, path", ("a.ts", "GET", "/trpc/list"), ("a.ts", "POST", "/trpc/save"), ("a.ts", "SUBSCRIBE", "/trpc/live"), ("a.ts", "GET", "/ts"), ("b.py", "GET", "/py"), ("c.go", "GET", "/go"), ("D.java", "GET", "/java"), ("e.rb", "GET", "/rb"), ("f.rs", "GET", "/rs"), ("g.cs", "POST", "/cs"), ("h.php", "GET", "/php")))
def extracted_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes out of sources of eight languages."""
    return extract.routes(_code(spark)).select("file", "method", "path")


@CORE.query("extracted_models", _values("file, kind, name", ("a.ts", "zod", "User"), ("b.py", "pydantic", "Item"), ("c.go", "struct", "Node"), ("D.java", "record", "Pair"), ("e.rb", "active-record", "Post"), ("f.rs", "struct", "Row"), ("g.cs", "class", "Order"), ("h.php", "eloquent", "Cart")))
def extracted_models(spark: SparkSession, folder: str) -> DataFrame:
    """Data models out of sources."""
    return extract.models(_code(spark))


@CORE.query("extracted_variables", _values("file, name", ("a.ts", "API_KEY"), ("b.py", "DB_URL"), ("c.go", "HOME"), ("D.java", "PATH"), ("e.rb", "TOKEN"), ("f.rs", "RUST_LOG"), ("g.cs", "ASPNET"), ("h.php", "PHP_ENV")))
def extracted_variables(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the environment that sources read."""
    return extract.variables(_code(spark)).select("file", "name")


@CORE.query("extracted_tables", _values("file, kind, name", ("b.py", "tablename", "items")))
def extracted_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Database tables that sources name."""
    return extract.tables(_code(spark))
