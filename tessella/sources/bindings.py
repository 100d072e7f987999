"""The engine's inputs over the test tables, for Spark and, word for word, for SQL.

``files``, ``imports``, ``symbols``, ``models``, ``snapshots``, ``file_domains_at`` and ``extraction_errors`` are taken as they are, one row
per record. Facts the tables lack come from their neighbours: commits are orders with their line items, the dependency graph of bulk
queries is the order graph of parts, the log is the event table, the routes are those that API documents tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.paths import clean_label, clean_path
from tessella.operators.rows import latest
from tessella.sources.tables import table
from tessella.storage import kept


def _clean(column: str) -> str:
    return rf"regexp_replace(replace({column}, '\', '/'), '^\./', '')"


def _label(column: str) -> str:
    return rf"upper(regexp_replace({column}, '^\s+|\s+$', '', 'g'))"


# ---- files, edges, symbols -------------------------------------------------------------------------------------------------------

FILES_SQL = rf"""files_b AS (
  SELECT id, repo_name, path, lang, domain, size FROM (
    SELECT id, repo_name, {_clean("path")} AS path, lower(language) AS lang, {_label("domain")} AS domain, size,
           row_number() OVER (PARTITION BY id ORDER BY last_indexed_at DESC NULLS LAST, repo_name DESC NULLS LAST, path DESC NULLS LAST, language DESC NULLS LAST, domain DESC NULLS LAST, size DESC NULLS LAST) rn
    FROM files WHERE id IS NOT NULL) WHERE rn = 1)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``id, repo_name, path, lang, domain, size``, the latest delivery of each id, cleaned; kept for the session."""

    def build() -> DataFrame:
        rows = latest(table(spark, folder, "files").where("id is not null").select("id", "repo_name", "path", "language", "domain", "size", "last_indexed_at"), ["id"], ["last_indexed_at"])
        return rows.select("id", "repo_name", clean_path(F.col("path")).alias("path"), F.lower("language").alias("lang"), clean_label(F.col("domain")).alias("domain"), "size")

    return kept(spark, "files", [f"{folder}/files.parquet"], build)


IMPORTS_SQL = rf"""imports_b AS (
  SELECT id, src, dst, path, symbol_name FROM (
    SELECT id, from_file_id AS src, to_file_id AS dst, {_clean("to_path")} AS path, symbol_name,
           row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, from_file_id DESC NULLS LAST, to_file_id DESC NULLS LAST, to_path DESC NULLS LAST, symbol_name DESC NULLS LAST) rn
    FROM imports WHERE id IS NOT NULL) WHERE rn = 1)"""

EDGES_SQL = (
    FILES_SQL
    + ", "
    + IMPORTS_SQL
    + """, paths_b AS (SELECT path, min(id) AS id FROM files_b WHERE path IS NOT NULL GROUP BY path),
edges_b AS (
  SELECT DISTINCT i.src, coalesce(i.dst, p.id) AS dst FROM imports_b i LEFT JOIN paths_b p ON i.dst IS NULL AND i.path = p.path
  WHERE i.src IN (SELECT id FROM files_b) AND coalesce(i.dst, p.id) IN (SELECT id FROM files_b))"""
)


def imports(spark: SparkSession, folder: str) -> DataFrame:
    """``id, src, dst, path, symbol_name``: one row per import, target path cleaned."""
    rows = latest(table(spark, folder, "imports").where("id is not null").select("id", "from_file_id", "to_file_id", "to_path", "symbol_name", "indexed_at"), ["id"], ["indexed_at"])
    return rows.select("id", F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst"), clean_path(F.col("to_path")).alias("path"), "symbol_name")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ``src, dst`` between known files; imports without an id are resolved by their exact path. Kept for the session: every walk reads the same table."""
    from tessella.operators.graph import resolve

    def build() -> DataFrame:
        known = files(spark, folder)
        ends = resolve(imports(spark, folder), known)
        ids = known.select("id")
        return (
            ends.where("src is not null and dst is not null")
            .select("src", "dst")
            .distinct()
            .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
            .select("src", "dst")
        )

    return kept(spark, "edges", [f"{folder}/{t}.parquet" for t in ("files", "imports")], build)


SYMBOLS_SQL = """symbols_b AS (
  SELECT id, file_id, name, kind, line, exported, is_default FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_id DESC NULLS LAST, name DESC NULLS LAST, kind DESC NULLS LAST, line DESC NULLS LAST, exported DESC NULLS LAST, is_default DESC NULLS LAST) rn
    FROM symbols WHERE id IS NOT NULL) WHERE rn = 1)"""


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "symbols").where("id is not null"), ["id"])


MODELS_SQL = """models_b AS (
  SELECT id, file_id, name, kind FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_id DESC NULLS LAST, name DESC NULLS LAST, kind DESC NULLS LAST) rn FROM models WHERE id IS NOT NULL) WHERE rn = 1)"""


def models(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "models").where("id is not null").select("id", "file_id", "name", "kind"), ["id"])


ERRORS_SQL = """errors_b AS (
  SELECT id, file_id, phase, error_message, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, file_id DESC NULLS LAST, phase DESC NULLS LAST, error_message DESC NULLS LAST) rn FROM extraction_errors WHERE id IS NOT NULL) WHERE rn = 1)"""


def errors(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "extraction_errors").where("id is not null").select("id", "file_id", "phase", "error_message", "ts"), ["id"], ["ts"])


# ---- the bulk graph ------------------------------------------------------------------------------------------------------------

PARTS_SQL = "nodes_b AS (SELECT p_partkey AS id, lower(replace(p_name, ' ', '_')) || '_' || p_partkey AS path, p_brand AS domain FROM part)"
GRAPH_SQL = """graph_b AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  WHERE a.l_quantity > 40 AND b.l_quantity > 40 AND a.l_partkey > b.l_partkey)"""
CYCLIC_SQL = """cyclic_b AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  WHERE a.l_quantity > 47 AND b.l_quantity > 47 AND a.l_partkey <> b.l_partkey)"""


WHOLE_SQL = """whole_b AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey > b.l_partkey)"""


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("domain"))


def _pairs(spark: SparkSession, folder: str, least: int | None, on) -> DataFrame:
    items = table(spark, folder, "lineitem")
    if least is not None:
        items = items.where(F.col("l_quantity") > least)
    a = items.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("src"))
    b = items.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("dst"))
    return a.join(b, "o").where(on).select("src", "dst").distinct()


def graph(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder, 40, F.col("src") > F.col("dst"))


def cyclic(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder, 47, F.col("src") != F.col("dst"))


def whole_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The order graph of parts from all line items; ``graph`` and ``cyclic`` hold only those of large quantities, as their SQL does."""
    return _pairs(spark, folder, None, F.col("src") > F.col("dst"))


# ---- history -------------------------------------------------------------------------------------------------------------------

COMMITS_SQL = """commits_b AS (SELECT o_orderkey AS sha, o_orderdate AS ts, o_custkey AS author FROM orders),
commit_files_b AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS file FROM lineitem)"""


def commits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"))


def commit_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file")).distinct()


BLAME_SQL = "blame_b AS (SELECT l_partkey AS file, l_suppkey AS author, count(*) AS lines FROM lineitem GROUP BY ALL)"


def blame(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author")).agg(F.count(F.lit(1)).alias("lines"))


# ---- log -----------------------------------------------------------------------------------------------------------------------

LOG_SQL = """log_b AS (
  SELECT event_id AS id, ts, user_id AS session_id, event_type AS kind, 'p' || json_extract_string(props, '$.k') AS file, props AS payload,
         CASE WHEN event_type = 'error' THEN CASE WHEN value >= 100 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM' ELSE 'LOW' END END AS severity,
         CASE CAST(json_extract_string(props, '$.k') AS INT) % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS accepted
  FROM events)"""


def log(spark: SparkSession, folder: str) -> DataFrame:
    """``id, ts, session_id, kind, file, payload, severity, accepted``: decisions, and interventions where severity is set."""
    k = F.get_json_object("props", "$.k")
    third = k.cast("int") % 3
    level = F.when(F.col("value") >= 100, "HIGH").when(F.col("value") >= 50, "MEDIUM").otherwise("LOW")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), F.concat(F.lit("p"), k).alias("file"), F.col("props").alias("payload"),
        F.when(F.col("event_type") == "error", level).alias("severity"), F.when(third == 1, False).when(third == 2, True).alias("accepted"),
    )


# ---- routes --------------------------------------------------------------------------------------------------------------------

ROUTES_SQL = r"""routes_b AS (
  SELECT DISTINCT doc_id AS file, split_part(r, ' ', 1) AS method, split_part(r, ' ', 2) AS path
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '### ((?:GET|POST|PUT|PATCH|DELETE) /[\w/:.{}-]+)', 1)) AS r FROM documents))"""


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ``file, method, path`` of the routes that documents tell."""
    found = table(spark, folder, "documents").select(F.col("doc_id").alias("file"), F.explode(F.regexp_extract_all("text", F.lit(r"### ((?:GET|POST|PUT|PATCH|DELETE) /[\w/:.{}-]+)"), 1)).alias("r"))
    return found.select("file", F.substring_index("r", " ", 1).alias("method"), F.substring_index("r", " ", -1).alias("path")).distinct()
