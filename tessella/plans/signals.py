"""Queries of domain assignment, ownership, risk, routes and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import domains as d
from tessella.operators import graph as g
from tessella.operators import journal as j
from tessella.operators import org as o
from tessella.operators import risk as k
from tessella.operators import runtime as rt
from tessella.operators import temporal as t
from tessella.plans.graphs import _CLOSURE
from tessella.plans.registry import CORE
from tessella.sources import bindings as b
from tessella.sources.tables import table

_SEEDED = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{d.seed_pattern(w)}') THEN '{n}'" for n, w in d.SEEDS.items()) + " END"
_VOTES = f"""{b.EDGES_SQL}, told AS (SELECT id, {_SEEDED} AS domain FROM files_b),
ways AS (SELECT src AS id, dst AS n FROM edges_b UNION ALL SELECT dst, src FROM edges_b),
counts AS (SELECT w.id, t.domain, count(*) AS votes FROM ways w JOIN told t ON t.id = w.n WHERE t.domain IS NOT NULL GROUP BY ALL),
top AS (SELECT *, max(votes) OVER (PARTITION BY id) AS m, sum(votes) OVER (PARTITION BY id) AS total FROM counts),
won AS (SELECT id, any_value(domain) AS domain, any_value(m) AS votes FROM top WHERE votes = m GROUP BY id HAVING count(*) = 1 AND any_value(m) >= 2 AND any_value(m) / any_value(total) >= 0.5),
voted AS (SELECT * FROM won WHERE id NOT IN (SELECT id FROM told WHERE domain IS NOT NULL)),
assigned AS (SELECT t.id, coalesce(t.domain, v.domain, 'CORE') AS domain, CASE WHEN t.domain IS NOT NULL THEN 0.9 WHEN v.domain IS NOT NULL THEN 0.5 ELSE 0.2 END AS confidence FROM told t LEFT JOIN voted v USING (id))"""


@CORE.query("domain_keyword_vote", f"WITH {_VOTES} SELECT id, domain, confidence::DOUBLE AS confidence FROM assigned")
def domain_keyword_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Domains from path words and, where those are silent, from neighbours."""
    return d.assign(b.files(spark, folder), b.edges(spark, folder))


@CORE.query("domain_largest", f"WITH {_VOTES}, c AS (SELECT domain, count(*) AS n FROM assigned GROUP BY domain) SELECT arg_max(domain, (n, domain)) AS domain, max(n) / sum(n) AS share FROM c")
def domain_largest(spark: SparkSession, folder: str) -> DataFrame:
    """The largest assigned domain and its share."""
    return d.largest_share(d.assign(b.files(spark, folder), b.edges(spark, folder)))


@CORE.query("domain_merge_small", f"WITH {_VOTES}, c AS (SELECT domain, count(*) AS n FROM assigned GROUP BY domain) SELECT a.id, CASE WHEN c.n < 20 THEN 'CORE' ELSE a.domain END AS domain FROM assigned a JOIN c USING (domain)")
def domain_merge_small(spark: SparkSession, folder: str) -> DataFrame:
    """Assigned domains with the small ones sent to the core."""
    return d.merge_small(d.assign(b.files(spark, folder), b.edges(spark, folder)), 20)


@CORE.query("domain_communities")
def domain_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the import graph."""
    files = b.files(spark, folder)
    return d.communities(files, b.edges(spark, folder), gamma=0.05)


@CORE.query("ownership", f"WITH {b.BLAME_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lines DESC, author) rn, sum(lines) OVER (PARTITION BY file)::BIGINT AS total FROM blame_b) SELECT file, author, lines, total, lines / total AS share FROM r WHERE rn = 1")
def ownership(spark: SparkSession, folder: str) -> DataFrame:
    """The main author of each file."""
    return k.ownership(b.blame(spark, folder))


@CORE.query(
    "cross_team_coupling",
    f"""WITH {b.BLAME_SQL}, {b.GRAPH_SQL}, own AS (SELECT file, author FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lines DESC, author) rn FROM blame_b) WHERE rn = 1)
    SELECT e.src, e.dst, x.author AS src_owner, y.author AS dst_owner FROM graph_b e JOIN own x ON x.file = e.src JOIN own y ON y.file = e.dst WHERE x.author <> y.author""",
)
def cross_team_coupling(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between files of different main authors."""
    return k.cross_owner_edges(b.graph(spark, folder), k.ownership(b.blame(spark, folder)))


_BASE = "regexp_extract(path, '[^/]*$')"
_STEM = f"regexp_replace(regexp_replace(regexp_replace({_BASE}, '^test_', ''), '\\..*$', ''), '_test$', '')"


@CORE.query(
    "files_without_tests",
    rf"""WITH {b.FILES_SQL}, told AS (SELECT id, repo_name, path, {_BASE} AS base, {_STEM} AS stem, regexp_matches({_BASE}, '^test_|_test\.\w+$|\.(test|spec|stories)\.') OR regexp_matches(path, '(^|/)(tests?|__tests__|spec)/') AS t FROM files_b WHERE path IS NOT NULL)
    SELECT id, path FROM told x WHERE NOT t AND regexp_matches(base, '\.(ts|tsx|js|jsx|py|go|rs)$') AND NOT regexp_matches(base, '\.d\.ts$') AND stem <> 'index'
      AND NOT EXISTS (SELECT 1 FROM told y WHERE y.t AND y.repo_name = x.repo_name AND y.stem = x.stem)""",
)
def files_without_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Source files whose stem no test of their repository carries."""
    return k.untested(b.files(spark, folder))


@CORE.query(
    "risk_scores",
    f"""WITH RECURSIVE {b.GRAPH_SQL}, {b.PARTS_SQL}, {b.COMMITS_SQL}, {b.LOG_SQL}, {_CLOSURE.format('graph_b')},
    blast AS (SELECT file AS id, count(*) AS v FROM closure_b GROUP BY file), chu AS (SELECT file AS id, count(*) AS v FROM commit_files_b GROUP BY file),
    inter AS (SELECT CAST(substr(file, 2) AS BIGINT) AS id, count(*) AS v FROM log_b WHERE severity = 'HIGH' AND file IS NOT NULL GROUP BY 1),
    cr AS (SELECT DISTINCT e.src AS id FROM graph_b e JOIN nodes_b a ON a.id = e.src JOIN nodes_b z ON z.id = e.dst WHERE a.domain <> z.domain),
    parts AS (SELECT n.id, coalesce(blast.v / greatest((SELECT max(v) FROM blast), 1), 0) AS blast, coalesce(chu.v / greatest((SELECT max(v) FROM chu), 1), 0) AS churn,
      CASE WHEN n.id IN (SELECT id FROM cr) THEN 1.0 ELSE 0.0 END AS "cross", coalesce(inter.v / greatest((SELECT max(v) FROM inter), 1), 0) AS interventions, 0.0 AS untested
      FROM nodes_b n LEFT JOIN blast USING (id) LEFT JOIN chu USING (id) LEFT JOIN inter USING (id))
    SELECT id, round(blast::DOUBLE, 6) AS blast, round(churn::DOUBLE, 6) AS churn, "cross"::DOUBLE AS "cross", round(interventions::DOUBLE, 6) AS interventions, untested::DOUBLE AS untested,
      floor((blast::DOUBLE * 0.3 + churn::DOUBLE * 0.25 + "cross"::DOUBLE * 0.2 + interventions::DOUBLE * 0.15) * 1000 + 0.5) / 1000 AS score FROM parts""",
)
def risk_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted risk of every node of the bulk graph. The signal of missing tests (weight 0.10) is left out, as in the SQL: parts have no test files."""
    nodes, graph = b.nodes(spark, folder), b.graph(spark, folder)
    churned = t.churn(b.commits(spark, folder), b.commit_files(spark, folder)).withColumnRenamed("file", "id")
    alarms = j.interventions_by_file(b.log(spark, folder)).where("file is not null").select(F.substring("file", 2, 20).cast("long").alias("id"), "n")
    crossing = g.crossing(graph, nodes).select(F.col("src").alias("id"))
    return k.risk_scores(nodes, g.impact_counts(g.closure(graph)), churned, crossing, alarms, nodes.limit(0))


_SHAPE = r"array_to_string(list_transform(string_split(regexp_replace(path, '\?.*$', ''), '/'), lambda x: CASE WHEN regexp_matches(x, '^:|^\{.*\}$|^\d+$|^[0-9a-f]{8}-[0-9a-f]{4}') THEN ':id' ELSE x END), '/')"


@CORE.query("route_shapes", f"WITH {b.ROUTES_SQL} SELECT method, {_SHAPE} AS shape, count(*) AS routes, count(DISTINCT file) AS files FROM routes_b GROUP BY 1, 2")
def route_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes by method and normalised path."""
    return b.routes(spark, folder).groupBy("method", rt.route_shape(F.col("path")).alias("shape")).agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("file").alias("files"))


_ORG = f"""{b.EDGES_SQL}, org_b AS (SELECT a.repo_name AS from_repo, z.repo_name AS to_repo, 'import' AS kind, z.path AS target FROM edges_b e JOIN files_b a ON a.id = e.src JOIN files_b z ON z.id = e.dst),
graph_o AS (SELECT from_repo, to_repo, kind, count(*) AS edges FROM org_b WHERE to_repo IS NOT NULL AND from_repo <> to_repo GROUP BY ALL)"""


def _org(spark: SparkSession, folder: str) -> DataFrame:
    known = b.files(spark, folder)
    a = known.select(F.col("id").alias("src"), F.col("repo_name").alias("from_repo"))
    z = known.select(F.col("id").alias("dst"), F.col("repo_name").alias("to_repo"), F.col("path").alias("target"))
    return b.edges(spark, folder).join(a, "src").join(z, "dst").select("from_repo", "to_repo", F.lit("import").alias("kind"), "target")


@CORE.query("service_graph", f"WITH {_ORG} SELECT * FROM graph_o")
def service_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Imports between repositories."""
    return o.service_graph(_org(spark, folder))


@CORE.query(
    "migration_order",
    f"""WITH {_ORG}, ends AS (SELECT to_repo AS repo, edges AS i, 0 AS o FROM graph_o UNION ALL SELECT from_repo, 0, edges FROM graph_o)
    SELECT repo, sum(i)::BIGINT AS used_by, sum(o)::BIGINT AS uses, sum(i) / (sum(i) + sum(o)) AS stability FROM ends GROUP BY repo""",
)
def migration_order(spark: SparkSession, folder: str) -> DataFrame:
    """How much each repository is used and uses others."""
    return o.migration_order(o.service_graph(_org(spark, folder)))


@CORE.query("boundary_violations", f"WITH {_ORG} SELECT from_repo, to_repo, target FROM org_b WHERE from_repo <> to_repo AND regexp_matches(target, '(?i)internal|private|_lib|/_')")
def boundary_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of what another repository keeps to itself."""
    return o.private_uses(_org(spark, folder)).select("from_repo", "to_repo", "target")


@CORE.query("repo_consumers", f"WITH {_ORG} SELECT from_repo AS repo, kind, edges FROM graph_o WHERE to_repo = 'loom-core'")
def repo_consumers(spark: SparkSession, folder: str) -> DataFrame:
    """Who uses one repository."""
    return o.downstream(o.service_graph(_org(spark, folder)), "loom-core")
