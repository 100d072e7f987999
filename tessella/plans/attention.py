"""Queries of conventions, working memory, suggestions, checklists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import attention as a
from tessella.operators import graph as g
from tessella.operators import history
from tessella.operators import journal as j
from tessella.operators import mining as m
from tessella.operators import planning as p
from tessella.operators import risk as k
from tessella.operators import temporal as t
from tessella.plans.patterns import _CASE
from tessella.plans.records import _SERIES
from tessella.plans.registry import CORE
from tessella.sources import bindings as b
from tessella.sources.tables import table

_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"
_BASE = "regexp_extract(path, '[^/]*$')"
_STRENGTH = "CASE WHEN n / total >= 0.9 THEN 'high' ELSE 'medium' END"
_CONVENTIONS = f"""{b.FILES_SQL}, {b.SYMBOLS_SQL},
named AS (SELECT {_DIR} AS dir, regexp_extract({_BASE}, '(\\.[^.]+)$', 1) AS ext, regexp_replace({_BASE}, '\\.[^.]*$', '') AS stem FROM files_b WHERE path IS NOT NULL),
cased AS (SELECT dir, ext, {_CASE.format("stem")} AS style FROM named),
cases AS (SELECT dir, ext, style, count(*) AS n FROM cased WHERE style IS NOT NULL GROUP BY ALL),
cases_r AS (SELECT *, row_number() OVER (PARTITION BY dir, ext ORDER BY n DESC, style) r, sum(n) OVER (PARTITION BY dir, ext) AS total FROM cases),
dirs AS (SELECT dir, count(*) AS total FROM (SELECT {_DIR} AS dir FROM files_b WHERE path IS NOT NULL) GROUP BY dir),
suffixes AS (SELECT dir, parts[-2] AS suffix, count(*) AS n FROM (SELECT {_DIR} AS dir, string_split({_BASE}, '.') AS parts FROM files_b WHERE path IS NOT NULL) WHERE len(parts) >= 3 GROUP BY ALL),
langs AS (SELECT split_part(path, '/', 1) AS dir, lang, count(*) AS n FROM files_b WHERE contains(path, '/') AND lang IS NOT NULL GROUP BY ALL),
langs_r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, lang) r, sum(n) OVER (PARTITION BY dir) AS total FROM langs),
styles AS (SELECT f.domain, sum(CASE WHEN s.is_default THEN 1 ELSE 0 END) AS d, count(*) AS n FROM symbols_b s JOIN files_b f ON f.id = s.file_id WHERE s.exported AND f.domain IS NOT NULL GROUP BY f.domain),
conventions AS (
  SELECT 'naming_case' AS kind, dir AS scope, ext, style AS rule, round(n / total, 2) AS confidence, {_STRENGTH} AS strength, n AS evidence FROM cases_r WHERE r = 1 AND total >= 4 AND n / total >= 0.75
  UNION ALL SELECT 'filename_suffix', dir, NULL, suffix, round(n / total, 2), {_STRENGTH}, n FROM suffixes JOIN dirs USING (dir) WHERE total >= 4 AND n / total >= 0.75
  UNION ALL SELECT 'directory_language', dir, NULL, lang, round(n / total, 2), {_STRENGTH}, n FROM langs_r WHERE r = 1 AND total >= 5 AND n / total >= 0.75
  UNION ALL SELECT 'export_style', domain, NULL, CASE WHEN d / n >= 0.75 THEN 'default' ELSE 'named' END, round(greatest(d / n, 1 - d / n), 2), CASE WHEN greatest(d / n, 1 - d / n) >= 0.9 THEN 'high' ELSE 'medium' END, n
    FROM styles WHERE n >= 5 AND greatest(d / n, 1 - d / n) >= 0.75)"""


def _conventions(spark: SparkSession, folder: str) -> DataFrame:
    files = b.files(spark, folder)
    styles = a.export_styles(m.export_style(b.symbols(spark, folder), files))
    return a.naming_cases(files).unionByName(a.filename_suffixes(files)).unionByName(a.folder_languages(files)).unionByName(styles)


@CORE.query("conventions", f"WITH {_CONVENTIONS} SELECT * FROM conventions")
def conventions(spark: SparkSession, folder: str) -> DataFrame:
    """Naming styles, suffixes, languages and export styles that hold in three of four cases."""
    return _conventions(spark, folder)


@CORE.query(
    "conventions_for_files",
    f"""WITH {_CONVENTIONS}, told AS (SELECT id, path, domain, {_DIR} AS dir, regexp_extract({_BASE}, '(\\.[^.]+)$', 1) AS of FROM files_b WHERE path IS NOT NULL)
    SELECT f.id, c.kind, c.scope, c.rule, c.confidence FROM told f JOIN conventions c ON CASE WHEN c.kind = 'export_style' THEN c.scope = f.domain ELSE (c.scope = '.' OR f.dir = c.scope OR starts_with(f.dir, c.scope || '/')) AND (c.ext IS NULL OR c.ext = f.of) END""",
)
def conventions_for_files(spark: SparkSession, folder: str) -> DataFrame:
    """The conventions each file stands under."""
    return a.conventions_for(b.files(spark, folder), _conventions(spark, folder))


@CORE.query(
    "domain_naming",
    f"""WITH {b.FILES_SQL}, c AS (SELECT domain, array_to_string(string_split(path, '/')[1:2], '/') AS prefix, count(*) AS n FROM files_b WHERE domain IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, prefix) AS r, sum(n) OVER (PARTITION BY domain)::BIGINT AS total FROM c) SELECT domain, prefix, n, total, n / total AS share FROM r WHERE r = 1 AND total >= 5 AND n / total >= 0.05""",
)
def domain_naming(spark: SparkSession, folder: str) -> DataFrame:
    """Where the files of each domain lie, from one in twenty on."""
    return a.domain_naming(b.files(spark, folder), share=0.05)


_DECISIONS = f"""{b.LOG_SQL}, log_p AS (SELECT id, ts, session_id, kind, file, '{{"pending":' || CASE WHEN id % 5 = 0 THEN 'true' ELSE 'false' END || coalesce(',"risk":"' || severity || '"', '') || '}}' AS payload FROM log_b)"""


@CORE.query("pending_decisions", f"""WITH {_DECISIONS} SELECT id, concat_ws(' ', 'pending=' || json_extract_string(payload, '$.pending'), 'risk=' || json_extract_string(payload, '$.risk')) AS line FROM log_p WHERE ts >= (SELECT max(ts) FROM log_b) - INTERVAL 24 HOURS AND (json_extract_string(payload, '$.pending') = 'true' OR json_extract_string(payload, '$.risk') IN ('HIGH', 'MEDIUM'))""")
def pending_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Open decisions of the last day of the log, told in one line; the payload is built from the log's own columns."""
    rows = b.log(spark, folder)
    now = F.lit(rows.agg(F.max("ts")).head()[0]).cast("timestamp_ntz")
    payload = F.to_json(F.struct((F.col("id") % 5 == 0).alias("pending"), F.col("severity").alias("risk")))
    open_ = a.pending(rows.withColumn("payload", payload), now - F.expr("INTERVAL 24 HOURS"))
    return open_.select("id", p.payload_line(F.col("payload"), ("pending", "risk")).alias("line"))


@CORE.query("working_memory", f"WITH {b.LOG_SQL} SELECT count(CASE WHEN severity IS NULL THEN 1 END) AS decisions, count(severity) AS interventions, count(CASE WHEN severity IS NOT NULL AND NOT coalesce(accepted, false) THEN 1 END) AS open_interventions, count(DISTINCT session_id) AS sessions, count(DISTINCT file) AS files FROM log_b WHERE ts >= (SELECT max(ts) FROM log_b) - INTERVAL 24 HOURS")
def working_memory(spark: SparkSession, folder: str) -> DataFrame:
    """What happened in the last day of the log."""
    rows = b.log(spark, folder)
    return a.working_memory(rows, F.lit(rows.agg(F.max("ts")).head()[0]).cast("timestamp_ntz"))


_DRIFTED = """counts AS (SELECT e.repo_name, e.seq, e.snapshot_id, s.domain_name AS domain, count(*) AS files FROM states s JOIN series e USING (snapshot_id) WHERE s.domain_name IS NOT NULL GROUP BY ALL),
ends AS (SELECT repo_name, arg_min(snapshot_id, seq) AS a, arg_max(snapshot_id, seq) AS z FROM series GROUP BY repo_name HAVING count(*) > 1),
drifted AS (SELECT repo_name || '/' || domain AS domain, sum(CASE WHEN snapshot_id = a THEN files ELSE 0 END)::BIGINT AS before, sum(CASE WHEN snapshot_id = z THEN files ELSE 0 END)::BIGINT AS after FROM counts JOIN ends USING (repo_name) WHERE snapshot_id IN (a, z) GROUP BY repo_name, domain)"""


def _drifted(spark: SparkSession, folder: str) -> DataFrame:
    series, states = history.full_snapshots(table(spark, folder, "snapshots"), table(spark, folder, "file_domains_at"))
    return t.drift(series, states).select(F.concat_ws("/", "repo_name", "domain").alias("domain"), "before", "after", "delta")


_HOT = f"""{b.COMMITS_SQL}, churn_b AS (SELECT f.file, count(*) AS commits, max(c.ts) AS ts FROM commit_files_b f JOIN commits_b c USING (sha) GROUP BY f.file), {b.WHOLE_SQL}, fan AS (SELECT dst AS file, count(*) AS dependents FROM whole_b GROUP BY dst),
hot AS (SELECT c.file, c.commits * greatest(1, coalesce(f.dependents, 0)) AS score, c.ts FROM churn_b c LEFT JOIN fan f USING (file))"""


def _hot(spark: SparkSession, folder: str) -> DataFrame:
    churned = t.churn(b.commits(spark, folder), b.commit_files(spark, folder))
    fan = g.degrees(b.whole_graph(spark, folder)).select(F.col("id").alias("file"), F.col("fan_in").alias("dependents"))
    scored = churned.join(fan, "file", "left")
    return scored.select("file", (F.col("commits") * F.greatest(F.lit(1), F.coalesce("dependents", F.lit(0)))).alias("score"), F.col("last_modified").cast("timestamp_ntz").alias("ts"))


@CORE.query(
    "active_suggestions",
    _SERIES + f""", {_DRIFTED}, {b.LOG_SQL}, {_HOT}, n AS (SELECT max(ts) AS now FROM log_b),
    s AS (
      SELECT 'cross_domain_jump_' || domain AS id, 'cross_domain_jump' AS trigger, 'major' AS severity, now AS ts FROM drifted, n WHERE before > 0 AND after - before >= 3
      UNION ALL SELECT * FROM (SELECT 'session_conflict_' || file, 'session_conflict', 'critical', max(ts) AS ts FROM log_b, n WHERE file IS NOT NULL AND ts >= now - INTERVAL 30 MINUTES GROUP BY file HAVING count(DISTINCT session_id) >= 2 ORDER BY max(ts) DESC, file LIMIT 20)
      UNION ALL SELECT * FROM (SELECT 'convention_violation_' || id, 'convention_violation', 'major', ts FROM log_b, n WHERE ts >= now - INTERVAL 1 HOUR AND severity = 'HIGH' AND NOT coalesce(accepted, false) ORDER BY ts DESC, id DESC LIMIT 10)
      UNION ALL SELECT 'hotspot_active_' || file, 'hotspot_active', CASE WHEN score >= 120 THEN 'critical' ELSE 'major' END, ts::TIMESTAMP FROM hot WHERE score >= 60)
    SELECT * FROM s ORDER BY ts DESC, id LIMIT 50""",
)
def active_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty newest suggestions from drift, sessions, interventions and hotspots."""
    rows = b.log(spark, folder)
    now = F.lit(rows.agg(F.max("ts")).head()[0]).cast("timestamp_ntz")
    return a.suggestions(_drifted(spark, folder), rows, _hot(spark, folder), now)


_FAN = "fan AS (SELECT dst AS id, count(*) AS dependents FROM edges_b WHERE src <> dst GROUP BY dst)"
_UNTESTED = rf"""told AS (SELECT id, repo_name, path, {_BASE} AS base, regexp_replace(regexp_replace(regexp_replace({_BASE}, '^test_', ''), '\..*$', ''), '_test$', '') AS stem,
  regexp_matches({_BASE}, '^test_|_test\.\w+$|\.(test|spec|stories)\.') OR regexp_matches(path, '(^|/)(tests?|__tests__|spec)/') AS t FROM files_b WHERE path IS NOT NULL),
bare AS (SELECT id FROM told x WHERE NOT t AND regexp_matches(base, '\.(ts|tsx|js|jsx|py|go|rs)$') AND NOT regexp_matches(base, '\.d\.ts$') AND stem <> 'index' AND NOT EXISTS (SELECT 1 FROM told y WHERE y.t AND y.repo_name = x.repo_name AND y.stem = x.stem))"""
_ALARMS = "alarms AS (SELECT CAST(substr(file, 2) AS BIGINT) AS id, count(*) AS n FROM log_b WHERE severity = 'HIGH' AND NOT coalesce(accepted, false) AND file IS NOT NULL GROUP BY 1)"
_SEEN = "seen AS (SELECT f.id, count(DISTINCT m.snapshot_id) AS commits FROM (SELECT snapshot_id, regexp_replace(replace(file_path, '\\', '/'), '^\\./', '') AS path FROM file_domains_at WHERE snapshot_id IS NOT NULL AND file_path IS NOT NULL) m JOIN files_b f USING (path) GROUP BY f.id)"


def _signals(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    from tessella.functions.paths import clean_path

    files, edges = b.files(spark, folder), b.edges(spark, folder)
    fan = g.degrees(edges.where("src <> dst")).select("id", F.col("fan_in").alias("dependents")).where("dependents > 0")
    crossing = g.crossing(edges, files).select(F.col("src").alias("id"))
    held = table(spark, folder, "file_domains_at").where("snapshot_id is not null and file_path is not null").select("snapshot_id", clean_path(F.col("file_path")).alias("path")).distinct()
    seen = held.groupBy("path").agg(F.count(F.lit(1)).alias("commits")).join(files.select("id", "path"), "path").select("id", "commits")
    alarms = j.interventions_by_file(b.log(spark, folder).where("file is not null and not coalesce(accepted, false)")).select(F.substring("file", 2, 20).cast("long").alias("id"), "n")
    return files, fan, crossing, k.untested(files).select("id"), seen, alarms


@CORE.query(
    "safety_checklist",
    f"""WITH {b.EDGES_SQL}, {b.LOG_SQL}, {_FAN}, {_UNTESTED}, {_ALARMS}, {_SEEN}, crosses AS (SELECT DISTINCT e.src AS id FROM edges_b e JOIN files_b x ON x.id = e.src JOIN files_b z ON z.id = e.dst WHERE x.domain <> z.domain),
    r AS (SELECT f.id, coalesce(dependents, 0) AS d, coalesce(commits, 0) AS c, coalesce(n, 0) AS n, f.id IN (SELECT id FROM crosses) AS x, f.id IN (SELECT id FROM bare) AS b FROM files_b f LEFT JOIN fan USING (id) LEFT JOIN seen USING (id) LEFT JOIN alarms USING (id)),
    i AS (SELECT id, CASE WHEN d >= 20 THEN 'major' ELSE 'minor' END AS severity, CASE WHEN d >= 20 THEN 'wide impact' ELSE 'impact' END AS item FROM r WHERE d >= 5 UNION ALL SELECT id, 'major', 'imports across domains' FROM r WHERE x UNION ALL SELECT id, 'major', 'no test' FROM r WHERE b
      UNION ALL SELECT id, 'critical', 'hotspot' FROM r WHERE c >= 5 AND d >= 10 UNION ALL SELECT id, 'major', 'open interventions' FROM r WHERE n > 0)
    SELECT * FROM i UNION ALL SELECT id, 'safe', 'no concern' FROM r WHERE id NOT IN (SELECT id FROM i)""",
)
def safety_checklist(spark: SparkSession, folder: str) -> DataFrame:
    """What to mind before changing each file of the import graph."""
    files, fan, crossing, bare, seen, alarms = _signals(spark, folder)
    return a.safety(files, fan, crossing, bare, seen, alarms)


@CORE.query(
    "file_risk",
    f"""WITH {b.EDGES_SQL}, {b.LOG_SQL}, {_FAN}, {_UNTESTED}, {_ALARMS}, {_SEEN}, crosses AS (SELECT DISTINCT e.src AS id FROM edges_b e JOIN files_b x ON x.id = e.src JOIN files_b z ON z.id = e.dst WHERE x.domain <> z.domain),
    r AS (SELECT f.id, coalesce(dependents / greatest((SELECT max(dependents) FROM fan), 1), 0)::DOUBLE AS blast, coalesce(commits / greatest((SELECT max(commits) FROM seen), 1), 0)::DOUBLE AS churn, (f.id IN (SELECT id FROM crosses))::INT::DOUBLE AS "cross",
      coalesce(n / greatest((SELECT max(n) FROM alarms), 1), 0)::DOUBLE AS interventions, (f.id IN (SELECT id FROM bare))::INT::DOUBLE AS untested FROM files_b f LEFT JOIN fan USING (id) LEFT JOIN seen USING (id) LEFT JOIN alarms USING (id))
    SELECT id, round(blast, 6) AS blast, round(churn, 6) AS churn, "cross", round(interventions, 6) AS interventions, untested, floor((blast * 0.3 + churn * 0.25 + "cross" * 0.2 + interventions * 0.15 + untested * 0.1) * 1000 + 0.5) / 1000 AS score FROM r""",
)
def file_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted risk of every file of the import graph, with the signal of missing tests."""
    files, fan, crossing, bare, seen, alarms = _signals(spark, folder)
    return k.risk_scores(files, fan, seen, crossing, alarms, bare)


@CORE.query(
    "interface_contract",
    f"""WITH {b.FILES_SQL}, {b.IMPORTS_SQL}, {b.SYMBOLS_SQL}, used AS (SELECT dst AS file_id, symbol_name AS name, count(DISTINCT src) AS importers FROM imports_b WHERE dst IS NOT NULL AND symbol_name IS NOT NULL GROUP BY ALL)
    SELECT s.file_id, s.name, coalesce(u.importers, 0) AS importers FROM (SELECT DISTINCT file_id, name FROM symbols_b WHERE exported AND name IS NOT NULL AND file_id IN (SELECT id FROM files_b)) s LEFT JOIN used u USING (file_id, name)""",
)
def interface_contract(spark: SparkSession, folder: str) -> DataFrame:
    """What every file exports and how many files import each name."""
    return a.interface(b.files(spark, folder), b.symbols(spark, folder), b.imports(spark, folder))


@CORE.query("token_budget_report", f"WITH {b.FILES_SQL}, s AS (SELECT coalesce(sum(ceil(coalesce(size, 0) / 4)), 0)::BIGINT AS total_tokens FROM files_b) SELECT total_tokens, 200000::BIGINT AS budget, least(total_tokens, 200000) AS used, floor(least(total_tokens, 200000) / total_tokens * 10000 + 0.5) / 100 AS efficiency FROM s")
def token_budget_report(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the code base a budget of tokens holds."""
    return a.budget_report(b.files(spark, folder), 200_000)


@CORE.query(
    "drift_digest",
    _SERIES + f""", {_DRIFTED}, {_HOT}, {b.LOG_SQL} SELECT * FROM (SELECT 'drift' AS section, domain AS key, (after - before)::DOUBLE AS value FROM drifted ORDER BY abs(after - before) DESC, domain LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'hotspots', file::VARCHAR, score::DOUBLE FROM hot ORDER BY score DESC, file LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'interventions', file, count(*)::DOUBLE FROM log_b WHERE severity = 'HIGH' AND file IS NOT NULL GROUP BY file ORDER BY count(*) DESC, file LIMIT 10)""",
)
def drift_digest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten domains that moved most, the ten hottest files and the ten with most grave interventions."""
    moved = _drifted(spark, folder).orderBy(F.desc(F.abs("delta")), "domain").limit(10).select(F.col("domain").alias("key"), F.col("delta").alias("value"))
    hot = _hot(spark, folder).orderBy(F.desc("score"), "file").limit(10).select(F.col("file").alias("key"), F.col("score").alias("value"))
    grave = j.interventions_by_file(b.log(spark, folder).where("file is not null")).orderBy(F.desc("n"), "file").limit(10).select(F.col("file").alias("key"), F.col("n").alias("value"))
    return a.digest({"drift": moved, "hotspots": hot, "interventions": grave})


_WORDS = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"
_WISH = "Make the invoice refund webhook retry for auth"
_ANCHORS = f"""{b.EDGES_SQL}, {b.SYMBOLS_SQL}, {b.ROUTES_SQL}, q AS (SELECT unnest(['invoice', 'refund', 'webhook', 'retry', 'auth']) AS t),
fw AS (SELECT id, path, domain, {_WORDS.format("path")} AS w FROM files_b WHERE path IS NOT NULL), sw AS (SELECT row_number() OVER () AS k, file_id AS id, {_WORDS.format("name")} AS w FROM symbols_b WHERE exported AND name IS NOT NULL),
rw AS (SELECT row_number() OVER () AS k, file AS id, {_WORDS.format("path")} AS w FROM routes_b),
docs AS (SELECT w FROM fw UNION ALL SELECT w FROM sw), df AS (SELECT t, (SELECT count(*) FROM docs WHERE list_contains(w, t)) AS d, (SELECT count(*) FROM docs) AS n FROM q),
wt AS (SELECT t, CASE WHEN d > 0 THEN ln((n + 1.0::DOUBLE) / (d + 1)) + 1 ELSE 1.0 END AS x FROM df),
s AS (
  SELECT id, 'route' AS kind, round(sum(60 * x) + 40 * (count(*) - 1), 4) AS score FROM rw, wt WHERE len(list_filter(w, lambda y: y = t OR (len(t) >= 4 AND starts_with(y, t) AND len(y) > len(t)))) > 0 GROUP BY k, id
  UNION ALL SELECT id, 'file', round(sum(CASE WHEN list_contains(w, t) THEN 30 * x ELSE 10 * x END), 4) FROM fw, wt WHERE len(list_filter(w, lambda y: y = t OR (len(t) >= 4 AND starts_with(y, t) AND len(y) > len(t)))) > 0 GROUP BY id
  UNION ALL SELECT id, 'symbol', round(sum(25 * x), 4) FROM sw, wt WHERE list_contains(w, t) GROUP BY k, id
  UNION ALL SELECT id, 'domain', 15 FROM (SELECT id, row_number() OVER (PARTITION BY domain ORDER BY path, id) r FROM fw WHERE domain IS NOT NULL AND EXISTS (SELECT 1 FROM q WHERE contains(lower(domain), t) OR contains(t, lower(domain)))) WHERE r <= 3),
anchors_b AS (SELECT id, path, arg_max(kind, (score, kind)) AS kind, max(score) AS score FROM s JOIN files_b USING (id) GROUP BY id, path ORDER BY score DESC, path, id LIMIT 8)"""


def _anchored(spark: SparkSession, folder: str) -> DataFrame:
    return p.select_anchors(b.files(spark, folder), b.symbols(spark, folder), b.routes(spark, folder), p.intent(_WISH))


@CORE.query("change_anchors", f"WITH {_ANCHORS} SELECT * FROM anchors_b")
def change_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Where a wish in words begins: by routes, paths, symbols and domains."""
    return _anchored(spark, folder).select("id", "path", "kind", "score")


@CORE.query(
    "change_plan",
    f"""WITH RECURSIVE {_ANCHORS}, steps AS (SELECT 'forward' AS role, src AS id, dst AS other FROM edges_b WHERE src <> dst UNION ALL SELECT 'review', dst, src FROM edges_b WHERE src <> dst),
    near AS (SELECT * FROM steps WHERE id IN (SELECT id FROM anchors_b)), sides AS (SELECT DISTINCT n.role, f.id, f.path, f.domain FROM near n JOIN files_b f ON f.id = n.other),
    seed AS (SELECT id FROM anchors_b ORDER BY score DESC, path, id LIMIT 5), walk AS (SELECT id, 0 AS hop FROM seed UNION SELECT e.src, w.hop + 1 FROM walk w JOIN edges_b e ON e.dst = w.id WHERE w.hop < 5),
    hops AS (SELECT id, min(hop) AS hop FROM walk WHERE id NOT IN (SELECT id FROM anchors_b) GROUP BY id)
    SELECT 'anchor' AS role, path, CASE WHEN score >= 0.5 * (SELECT max(score) FROM anchors_b) THEN 'high' ELSE 'maybe' END AS detail FROM anchors_b
    UNION ALL SELECT role, path, domain FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY path, id) r FROM sides) WHERE r <= 10
    UNION ALL SELECT * FROM (SELECT 'blast', f.path, h.hop::VARCHAR FROM hops h JOIN files_b f USING (id) ORDER BY h.hop, f.path, f.id LIMIT 15)
    UNION ALL SELECT DISTINCT 'domain', domain, NULL FROM (SELECT domain FROM sides UNION ALL SELECT f.domain FROM anchors_b JOIN files_b f USING (id)) WHERE domain IS NOT NULL
    UNION ALL SELECT * FROM (SELECT DISTINCT 'cross', z.path, x.domain || '>' || z.domain AS d FROM near n JOIN files_b x ON x.id = n.id JOIN files_b z ON z.id = n.other WHERE x.domain <> z.domain ORDER BY z.path, d LIMIT 8)""",
)
def change_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What a wish in words touches: anchors, neighbours, dependents, domains."""
    return p.plan_change(_anchored(spark, folder), b.files(spark, folder), b.edges(spark, folder))
