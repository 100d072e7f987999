"""Queries of the general record problems: history (2), nesting (3), references (6), snapshot changes (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import history, references, shred, snapdiff
from tessella.plans.registry import CORE
from tessella.sources.tables import table
from tessella.storage import materialize

_SERIES = r"""
WITH heads AS (
  SELECT id AS snapshot_id, repo_name, ts, commit_sha FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, repo_name DESC, commit_sha DESC NULLS LAST) rn FROM snapshots WHERE id IS NOT NULL) WHERE rn = 1),
members AS (
  SELECT snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^\./', '') AS file_path,
         upper(regexp_replace(domain_name, '^\s+|\s+$', '', 'g')) AS domain_name, recorded_at
  FROM file_domains_at WHERE snapshot_id IS NOT NULL AND file_path IS NOT NULL),
states AS (
  SELECT snapshot_id, file_path, domain_name FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_id, file_path ORDER BY recorded_at DESC NULLS LAST, domain_name DESC NULLS LAST) rn FROM members) WHERE rn = 1),
series AS (
  SELECT *, row_number() OVER w AS seq, coalesce(lead(snapshot_id) OVER w, -1) AS next_id
  FROM heads WHERE snapshot_id IN (SELECT snapshot_id FROM members)
  WINDOW w AS (PARTITION BY repo_name ORDER BY ts NULLS FIRST, snapshot_id))"""

_VERSIONS = _SERIES + """,
dated AS (SELECT s.*, e.repo_name, e.seq, e.next_id, e.ts, e.commit_sha FROM states s JOIN series e USING (snapshot_id)),
marked AS (
  SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(domain_name) OVER w IS NOT DISTINCT FROM domain_name THEN 0 ELSE 1 END AS opens
  FROM dated WINDOW w AS (PARTITION BY repo_name, file_path ORDER BY seq)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY repo_name, file_path ORDER BY seq) AS run FROM marked),
versions AS (
  SELECT repo_name, file_path, any_value(domain_name) AS domain_name, arg_min(snapshot_id, seq) AS from_snapshot_id,
         arg_max(next_id, seq) AS to_snapshot_id, min(ts) AS valid_from
  FROM runs GROUP BY repo_name, file_path, run)"""


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return history.merge(*history.delivered_snapshots(table(spark, folder, "snapshots"), table(spark, folder, "file_domains_at")))


@CORE.query("p2_found", _VERSIONS + " SELECT file_path, from_snapshot_id, to_snapshot_id FROM versions")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of a file's domain by the snapshots that open and close it."""
    return _versions(spark, folder).select("file_path", "from_snapshot_id", "to_snapshot_id")


@CORE.query(
    "p2_history",
    _VERSIONS
    + """ SELECT v.repo_name, v.file_path, v.domain_name, v.valid_from, e.ts AS valid_to, b.commit_sha AS from_commit, v.to_snapshot_id = -1 AS is_current
  FROM versions v LEFT JOIN series e ON e.snapshot_id = v.to_snapshot_id JOIN series b ON b.snapshot_id = v.from_snapshot_id""",
)
def p2_history(spark: SparkSession, folder: str) -> DataFrame:
    """The domain history with the period each version was valid."""
    return _versions(spark, folder).select("repo_name", "file_path", "domain_name", "valid_from", "valid_to", "from_commit", "is_current")


@CORE.query("p2_incremental", _VERSIONS + " SELECT repo_name, file_path, domain_name, from_snapshot_id, to_snapshot_id FROM versions")
def p2_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The same history merged in two loads: the older half of every series, then the newer half into what the first load wrote."""
    series, states = history.delivered_snapshots(table(spark, folder, "snapshots"), table(spark, folder, "file_domains_at"))
    middle = series.groupBy("repo_name").agg(F.floor((F.max("seq") + 1) / 2).cast("int").alias("seq"))
    older = series.join(middle.withColumnRenamed("seq", "m"), "repo_name").where("seq <= m").select("snapshot_id")
    first = materialize(history.merge(series.join(older, "snapshot_id", "left_semi"), states.join(older, "snapshot_id", "left_semi")), "versions")
    out = history.merge(series, states.join(older, "snapshot_id", "left_anti"), first, middle)
    return out.select("repo_name", "file_path", "domain_name", "from_snapshot_id", "to_snapshot_id")


_OBJECTS = r"""WITH RECURSIVE raw AS (
  SELECT 'models' AS t, id, fields_json AS x FROM (SELECT DISTINCT id, fields_json FROM models) UNION ALL SELECT 'snapshots', id, summary_json FROM (SELECT DISTINCT id, summary_json FROM snapshots)),
parsed AS (SELECT t, id, CASE WHEN json_type(x::JSON) = 'VARCHAR' THEN (x::JSON ->> '$')::JSON ELSE x::JSON END AS j FROM raw WHERE x IS NOT NULL AND json_valid(x)),
tops AS (SELECT t, id, CASE WHEN t = 'models' AND json_type(j) = 'OBJECT' AND json_type(j, '$.fields') = 'ARRAY' THEN j -> '$.fields' WHEN t = 'snapshots' AND json_type(j, '$.summary') = 'OBJECT' THEN j -> '$.summary' -> '$.domains' WHEN t = 'snapshots' THEN j -> '$.domains' ELSE j END AS j FROM parsed),
lists AS (SELECT t, id, 1 AS level, '' AS path, j FROM tops
  UNION ALL
  SELECT t, id, level + 1, path, j FROM (
    SELECT t, id, level, path || name || '>' AS path, unnest(CASE WHEN t = 'models' THEN [o -> '$.fields', o -> '$.items.fields'] WHEN level = 1 THEN [o -> '$.languages'] ELSE [] END) AS j FROM (
      SELECT t, id, level, path, o, coalesce(o ->> '$.name', k) AS name FROM (
        SELECT t, id, level, path, NULL AS k, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN j::JSON[] ELSE [] END) AS o FROM lists WHERE json_type(j) = 'ARRAY'
        UNION ALL SELECT t, id, level, path, unnest(map_keys(j::MAP(VARCHAR, JSON))), unnest(map_values(j::MAP(VARCHAR, JSON))) FROM lists WHERE json_type(j) = 'OBJECT'))) WHERE j IS NOT NULL)
SELECT t AS table_name, id AS record_id, path || coalesce(o ->> '$.name', k) AS node_path FROM (
  SELECT t, id, path, NULL AS k, unnest(j::JSON[]) AS o FROM lists WHERE json_type(j) = 'ARRAY'
  UNION ALL SELECT t, id, path, unnest(map_keys(j::MAP(VARCHAR, JSON))), unnest(map_values(j::MAP(VARCHAR, JSON))) FROM lists WHERE json_type(j) = 'OBJECT')
WHERE json_type(o) = 'OBJECT' AND coalesce(o ->> '$.name', k) IS NOT NULL"""


@CORE.query("p3_found", _OBJECTS)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every nested named object of the model and snapshot records."""
    parts = []
    for name, rows in (("models", shred.model_fields(table(spark, folder, "models"))), ("snapshots", shred.snapshot_domains(table(spark, folder, "snapshots")))):
        parts.append(rows.select(F.lit(name).alias("table_name"), "record_id", "node_path"))
    return parts[0].unionByName(parts[1])


_REJECTS = """SELECT t AS table_name, id AS record_id FROM (SELECT 'models' AS t, id, fields_json AS x FROM models UNION SELECT 'snapshots', id, summary_json FROM snapshots) WHERE x <> '' AND id IS NOT NULL AND NOT json_valid(x)"""


@CORE.query("p3_rejects", _REJECTS)
def p3_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose text is no JSON and thus gave no object."""
    parts = [shred.rejects(nodes).select(F.lit(name).alias("table_name"), "record_id") for name, nodes in (("models", shred.model_nodes(table(spark, folder, "models"))), ("snapshots", shred.snapshot_nodes(table(spark, folder, "snapshots"))))]
    return parts[0].unionByName(parts[1])


@CORE.query("p3_model_fields")
def p3_model_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The field table: one row per field object with its parent link."""
    return shred.model_fields(table(spark, folder, "models"))


_DOMAINS = r"""WITH parsed AS (SELECT id, CASE WHEN json_type(x::JSON) = 'VARCHAR' THEN (x::JSON ->> '$')::JSON ELSE x::JSON END AS j FROM (SELECT DISTINCT id, summary_json AS x FROM snapshots) WHERE x IS NOT NULL AND json_valid(x)),
tops AS (SELECT id, CASE WHEN json_type(j, '$.summary') = 'OBJECT' THEN j -> '$.summary' -> '$.domains' ELSE j -> '$.domains' END AS d FROM parsed),
doms AS (SELECT id, NULL AS k, i - 1 AS ordinal, (d::JSON[])[i] AS o FROM (SELECT id, d, unnest(range(1, len(d::JSON[]) + 1)) AS i FROM tops WHERE json_type(d) = 'ARRAY')
  UNION ALL SELECT id, map_keys(d::MAP(VARCHAR, JSON))[i], i - 1, map_values(d::MAP(VARCHAR, JSON))[i] FROM (SELECT id, d, unnest(range(1, len(map_keys(d::MAP(VARCHAR, JSON))) + 1)) AS i FROM tops WHERE json_type(d) = 'OBJECT')),
named AS (SELECT id, coalesce(o ->> '$.name', k) AS name, ordinal, o FROM doms WHERE json_type(o) = 'OBJECT'),
langs AS (SELECT id, name AS parent, NULL AS k, i - 1 AS ordinal, (l::JSON[])[i] AS o FROM (SELECT id, name, o -> '$.languages' AS l, unnest(range(1, len((o -> '$.languages')::JSON[]) + 1)) AS i FROM named WHERE json_type(o, '$.languages') = 'ARRAY')
  UNION ALL SELECT id, name, map_keys(l::MAP(VARCHAR, JSON))[i], i - 1, map_values(l::MAP(VARCHAR, JSON))[i] FROM (SELECT id, name, o -> '$.languages' AS l, unnest(range(1, len(map_keys((o -> '$.languages')::MAP(VARCHAR, JSON))) + 1)) AS i FROM named WHERE json_type(o, '$.languages') = 'OBJECT'))
SELECT id AS record_id, NULL AS parent_name, name, ordinal::INT AS ordinal, 1 AS level, CASE WHEN json_type(o, '$.files') NOT IN ('ARRAY', 'OBJECT') THEN o ->> '$.files' END AS files FROM named WHERE name IS NOT NULL
UNION ALL SELECT id, parent, coalesce(o ->> '$.name', k), ordinal::INT, 2, CASE WHEN json_type(o, '$.files') NOT IN ('ARRAY', 'OBJECT') THEN o ->> '$.files' END FROM langs WHERE json_type(o) = 'OBJECT' AND coalesce(o ->> '$.name', k) IS NOT NULL"""


@CORE.query("p3_domain_links", _DOMAINS)
def p3_domain_links(spark: SparkSession, folder: str) -> DataFrame:
    """Domains and languages of the snapshot summaries, each language with the domain it belongs to, by the parent link."""
    rows = materialize(shred.snapshot_domains(table(spark, folder, "snapshots")), "domain-rows")
    above = rows.select("record_id", F.col("node").alias("parent_entity"), F.col("name").alias("parent_name"))
    return rows.join(above, ["record_id", "parent_entity"], "left").select("record_id", "parent_name", "name", "ordinal", "level", "files")


@CORE.query("p3_snapshot_domains")
def p3_snapshot_domains(spark: SparkSession, folder: str) -> DataFrame:
    """The domain and language table of the snapshot summaries with parent links."""
    return shred.snapshot_domains(table(spark, folder, "snapshots"))


_ORPHANS = r"""
WITH refs AS (
  SELECT id AS import_id, to_file_id, resolved, indexed_at, regexp_replace(replace(to_path, '\', '/'), '^\./', '') AS ref_path
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, from_file_id DESC NULLS LAST, to_file_id DESC NULLS LAST,
          to_path DESC NULLS LAST, symbol_name DESC NULLS LAST, resolved DESC NULLS LAST) rn FROM imports) WHERE rn = 1),
project AS (
  SELECT * FROM refs WHERE to_file_id IS NOT NULL
     OR (contains(ref_path, '/') AND split_part(ref_path, '/', 1) IN (SELECT name FROM repos WHERE name IS NOT NULL))),
lost AS (
  SELECT * FROM project p WHERE
    (p.to_file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.id = p.to_file_id))
    OR (p.to_file_id IS NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE regexp_replace(replace(f.path, '\', '/'), '^\./', '') = p.ref_path)))"""


@CORE.query("p6_found", _ORPHANS + " SELECT import_id FROM lost")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Imports that point at a project file which is not in ``files``."""
    return references.import_orphans(table(spark, folder, "imports"), table(spark, folder, "files"), table(spark, folder, "repos")).select("import_id")


@CORE.query(
    "p6_report",
    _ORPHANS
    + """, kinds AS (SELECT import_id, strftime(indexed_at, '%Y-%m') AS period, CASE WHEN to_file_id IS NULL THEN 'path' ELSE 'id' END AS ref_kind, resolved FROM project),
  bad AS (SELECT import_id FROM lost)
  SELECT 'imports' AS table_name, period, ref_kind, count(*) AS "references", count(b.import_id) AS orphans,
         count(CASE WHEN b.import_id IS NOT NULL AND resolved = 1 THEN 1 END) AS claimed_resolved
  FROM kinds LEFT JOIN bad b USING (import_id) GROUP BY period, ref_kind""",
)
def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """References and orphans per month of ``indexed_at``."""
    return references.orphan_report(table(spark, folder, "imports"), table(spark, folder, "files"), table(spark, folder, "repos"))


_CHANGES = _SERIES + """,
dated AS (SELECT s.*, e.repo_name, e.seq FROM states s JOIN series e USING (snapshot_id)),
now AS (SELECT *, seq AS at FROM dated WHERE seq > 1),
before AS (SELECT d.*, seq + 1 AS at FROM dated d WHERE seq < (SELECT max(seq) FROM series x WHERE x.repo_name = d.repo_name)),
both_sides AS (
  SELECT coalesce(n.repo_name, b.repo_name) AS repo_name, coalesce(n.at, b.at) AS at, coalesce(n.file_path, b.file_path) AS file_path,
         CASE WHEN b.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'removed' WHEN n.domain_name IS DISTINCT FROM b.domain_name THEN 'changed' END AS change
  FROM now n FULL JOIN before b ON n.repo_name = b.repo_name AND n.at = b.at AND n.file_path = b.file_path),
changes AS (SELECT e.snapshot_id, c.file_path, c.change FROM both_sides c JOIN series e ON e.repo_name = c.repo_name AND e.seq = c.at WHERE c.change IS NOT NULL)"""


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    series, states = history.delivered_snapshots(table(spark, folder, "snapshots"), table(spark, folder, "file_domains_at"))
    return snapdiff.changes(snapdiff.chunked(states, series), series)


@CORE.query("p7_found", _CHANGES + " SELECT snapshot_id, file_path, change FROM changes")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paths added, removed or changed between consecutive full snapshots."""
    return _changes(spark, folder).select("snapshot_id", "file_path", "change")


@CORE.query("p7_counts", _CHANGES + " SELECT snapshot_id, change, count(*) AS paths FROM changes GROUP BY ALL")
def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Changes per snapshot and kind."""
    return _changes(spark, folder).groupBy("snapshot_id", "change").agg(F.count(F.lit(1)).alias("paths"))
