"""Queries about single files, wishes in words and what wants attention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import history
from tessella.operators import planning as p
from tessella.operators import risk
from tessella.operators import temporal as t
from tessella.plans.records import _SERIES
from tessella.plans.registry import CORE
from tessella.sources import bindings as b
from tessella.sources.tables import table

_WORDS = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"


@CORE.query(
    "intent_anchors",
    f"""WITH {b.FILES_SQL}, {b.SYMBOLS_SQL}, q AS (SELECT unnest(['invoice', 'refund', 'webhook', 'retry']) AS token),
    hits AS (SELECT DISTINCT id, token, 'path' AS place FROM (SELECT id, unnest({_WORDS.format('path')}) AS token FROM files_b) JOIN q USING (token)
      UNION ALL SELECT DISTINCT file_id, token, 'symbol' FROM (SELECT file_id, unnest({_WORDS.format('name')}) AS token FROM symbols_b) JOIN q USING (token)),
    df AS (SELECT token, count(DISTINCT id) AS df FROM hits GROUP BY token), n AS (SELECT count(*) AS n FROM files_b),
    scored AS (SELECT h.id, round(sum(CASE WHEN place = 'path' THEN 30.0::DOUBLE ELSE 25.0::DOUBLE END * (ln((n + 1.0::DOUBLE) / (df + 1)) + 1)), 4) AS score, list_sort(list(DISTINCT place || ':' || token)) AS reasons FROM hits h JOIN df USING (token), n GROUP BY h.id)
    SELECT id, path, score, reasons FROM scored JOIN files_b USING (id) ORDER BY score DESC, path, id LIMIT 8""",
)
def intent_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The files that a wish in words concerns most."""
    return p.anchors(b.files(spark, folder), b.symbols(spark, folder), p.intent("Make the invoice refund webhook retry")["content"])


@CORE.query(
    "file_context",
    f"""WITH {b.EDGES_SQL}, {b.SYMBOLS_SQL}, seed AS (SELECT dst AS id FROM edges_b WHERE src <> dst GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5)
    SELECT f.id, f.path, f.domain,
      coalesce((SELECT list(name ORDER BY name) FROM (SELECT DISTINCT name FROM symbols_b s WHERE s.file_id = f.id AND s.exported ORDER BY name LIMIT 50)), []) AS exports,
      coalesce((SELECT list(path ORDER BY path) FROM (SELECT z.path FROM edges_b e JOIN files_b z ON z.id = e.dst WHERE e.src = f.id AND e.src <> e.dst ORDER BY z.path, z.id LIMIT 50)), []) AS imports,
      coalesce((SELECT list(path ORDER BY path) FROM (SELECT z.path FROM edges_b e JOIN files_b z ON z.id = e.src WHERE e.dst = f.id AND e.src <> e.dst ORDER BY z.path, z.id LIMIT 50)), []) AS imported_by
    FROM files_b f JOIN seed USING (id)""",
)
def file_context(spark: SparkSession, folder: str) -> DataFrame:
    """What is known about the five most imported files, nested in one row each."""
    edges = b.edges(spark, folder)
    seeds = edges.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(5)
    return p.file_context(b.files(spark, folder), edges, b.symbols(spark, folder), seeds)


@CORE.query("stale_docs", "SELECT doc_id, date_diff('day', created_at::DATE, DATE '2025-06-01') AS age_days FROM documents WHERE date_diff('day', created_at::DATE, DATE '2025-06-01') > 30 ORDER BY age_days DESC, doc_id LIMIT 50")
def stale_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty documents that have not been written for longest."""
    return p.stale(table(spark, folder, "documents"), "doc_id", "created_at", F.lit("2025-06-01").cast("timestamp_ntz")).withColumn("age_days", F.col("age_days").cast("long"))


@CORE.query(
    "active_drift",
    _SERIES
    + """, counts AS (SELECT e.repo_name, e.seq, e.snapshot_id, s.domain_name AS domain, count(*) AS files FROM states s JOIN series e USING (snapshot_id) WHERE s.domain_name IS NOT NULL GROUP BY ALL),
    ends AS (SELECT repo_name, arg_min(snapshot_id, seq) AS a, arg_max(snapshot_id, seq) AS z FROM series GROUP BY repo_name HAVING count(*) > 1),
    d AS (SELECT repo_name, domain, sum(CASE WHEN snapshot_id = a THEN files ELSE 0 END)::BIGINT AS before, sum(CASE WHEN snapshot_id = z THEN files ELSE 0 END)::BIGINT AS after FROM counts JOIN ends USING (repo_name) WHERE snapshot_id IN (a, z) GROUP BY ALL)
    SELECT repo_name, domain, before, after, after - before AS delta FROM d WHERE before > 0 AND abs(after - before) / before >= 0.2 AND abs(after - before) >= 3""",
)
def active_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Domains that drifted by a fifth and three files."""
    series, states = history.full_snapshots(table(spark, folder, "snapshots"), table(spark, folder, "file_domains_at"))
    return p.breaches(t.drift(series, states)).select("repo_name", "domain", "before", "after", "delta")


@CORE.query(
    "untested_hubs",
    rf"""WITH {b.EDGES_SQL}, told AS (SELECT id, repo_name, path, regexp_extract(path, '[^/]*$') AS base,
      regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '^test_', ''), '\..*$', ''), '_test$', '') AS stem,
      regexp_matches(regexp_extract(path, '[^/]*$'), '^test_|_test\.\w+$|\.(test|spec|stories)\.') OR regexp_matches(path, '(^|/)(tests?|__tests__|spec)/') AS t FROM files_b WHERE path IS NOT NULL),
    bare AS (SELECT id, path FROM told x WHERE NOT t AND regexp_matches(base, '\.(ts|tsx|js|jsx|py|go|rs)$') AND NOT regexp_matches(base, '\.d\.ts$') AND stem <> 'index' AND NOT EXISTS (SELECT 1 FROM told y WHERE y.t AND y.repo_name = x.repo_name AND y.stem = x.stem)),
    fan AS (SELECT dst AS id, count(*) AS fan_in FROM edges_b WHERE src <> dst GROUP BY dst)
    SELECT id, path, fan_in FROM bare JOIN fan USING (id) ORDER BY fan_in DESC, path, id LIMIT 50""",
)
def untested_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty most imported files without a test."""
    fan = b.edges(spark, folder).where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return risk.untested(b.files(spark, folder)).join(fan, "id").select("id", "path", "fan_in").orderBy(F.desc("fan_in"), "path", "id").limit(50)
