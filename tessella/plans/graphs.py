"""Queries over the import graph and the bulk graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph as g
from tessella.operators import risk as k
from tessella.operators import tiles
from tessella.plans.registry import CORE
from tessella.sources import bindings as b

_SEED = "seed AS (SELECT dst AS id FROM edges_b WHERE src <> dst GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
_SEEDS = "seed AS (SELECT dst AS id FROM edges_b WHERE src <> dst GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 3)"


def _hubs(edges: DataFrame, n: int) -> DataFrame:
    return edges.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(n).select("id")


def _walk(start: str, end: str, hops: int, edges: str = "edges_b") -> str:
    return f"""walk AS (SELECT id, 0 AS hop FROM seed UNION SELECT e.{end}, w.hop + 1 FROM walk w JOIN {edges} e ON e.{start} = w.id WHERE w.hop < {hops}),
reached AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id HAVING id NOT IN (SELECT id FROM seed))"""


@CORE.query("blast_radius", f"WITH RECURSIVE {b.EDGES_SQL}, {_SEED}, {_walk('dst', 'src', 5)} SELECT f.path AS file, r.hop AS hop_distance FROM reached r JOIN files_b f USING (id)")
def blast_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that depends on the most imported file within five hops."""
    edges = b.edges(spark, folder)
    return g.reach(edges, _hubs(edges, 1)).join(b.files(spark, folder), "id").select(F.col("path").alias("file"), F.col("hop").alias("hop_distance"))


@CORE.query("simulate_change_impact", f"WITH RECURSIVE {b.EDGES_SQL}, {_SEEDS}, {_walk('dst', 'src', 5)} SELECT f.path AS file, r.hop AS hop_distance FROM reached r JOIN files_b f USING (id)")
def simulate_change_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that depends on any of three files, by the least hop."""
    edges = b.edges(spark, folder)
    return g.reach(edges, _hubs(edges, 3)).join(b.files(spark, folder), "id").select(F.col("path").alias("file"), F.col("hop").alias("hop_distance"))


@CORE.query(
    "forward_reach",
    f"WITH RECURSIVE {b.EDGES_SQL}, seed AS (SELECT src AS id FROM edges_b WHERE src <> dst GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), {_walk('src', 'dst', 3)} SELECT id, hop FROM reached",
)
def forward_reach(spark: SparkSession, folder: str) -> DataFrame:
    """What the file with the most imports needs within three hops."""
    edges = b.edges(spark, folder)
    seed = edges.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1)
    return g.reach(edges, seed, 3, reverse=False)


_CLOSURE = """pairs AS (SELECT dst AS file, src AS dependent, 1 AS hop FROM {0} UNION SELECT p.file, e.src, p.hop + 1 FROM pairs p JOIN {0} e ON e.dst = p.dependent WHERE p.hop < 5),
closure_b AS (SELECT file, dependent, min(hop) AS hop FROM pairs WHERE file <> dependent GROUP BY ALL)"""


@CORE.query("reverse_closure", f"WITH RECURSIVE {b.GRAPH_SQL}, {_CLOSURE.format('graph_b')} SELECT file, dependent, hop FROM closure_b")
def reverse_closure(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs within five hops of the bulk graph."""
    return g.closure(b.graph(spark, folder))


@CORE.query("cyclic_closure", f"WITH RECURSIVE {b.CYCLIC_SQL}, {_CLOSURE.format('cyclic_b')} SELECT file, dependent, hop FROM closure_b")
def cyclic_closure(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs within five hops of a graph with cycles."""
    return g.closure(b.cyclic(spark, folder))


@CORE.query(
    "high_impact_files",
    f"WITH RECURSIVE {b.GRAPH_SQL}, {b.PARTS_SQL}, {_CLOSURE.format('graph_b')} SELECT n.path AS file, count(*) AS dependents FROM closure_b c JOIN nodes_b n ON n.id = c.file GROUP BY n.path ORDER BY dependents DESC, file LIMIT 20",
)
def high_impact_files(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nodes with the most dependents within five hops."""
    counts = g.impact_counts(g.closure(b.graph(spark, folder)))
    named = counts.join(b.nodes(spark, folder), "id").select(F.col("path").alias("file"), "dependents")
    return named.orderBy(F.desc("dependents"), "file").limit(20)


@CORE.query("import_closure", f"WITH RECURSIVE {b.EDGES_SQL}, {_CLOSURE.format('edges_b')} SELECT file, dependent, hop FROM closure_b")
def import_closure(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs within five hops of the whole import graph."""
    return tiles.closure(b.edges(spark, folder))


@CORE.query(
    "import_high_impact_files",
    f"WITH RECURSIVE {b.EDGES_SQL}, {_CLOSURE.format('edges_b')} SELECT f.id, f.path AS file, count(*) AS dependents FROM closure_b c JOIN files_b f ON f.id = c.file GROUP BY f.id, f.path ORDER BY dependents DESC, f.id LIMIT 20",
)
def import_high_impact_files(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty files with the most dependents within five hops of the whole import graph."""
    counts = tiles.dependents(b.edges(spark, folder))
    named = counts.join(b.files(spark, folder), "id").select("id", F.col("path").alias("file"), "dependents")
    return named.orderBy(F.desc("dependents"), "id").limit(20)


_NEAR = """incident AS (
  SELECT DISTINCT e.src, e.dst FROM edges_b e WHERE e.src IN (SELECT id FROM inner_b) OR e.dst IN (SELECT id FROM inner_b))"""


@CORE.query(
    "neighbors",
    f"""WITH RECURSIVE {b.EDGES_SQL}, {_SEED}, both_b AS (SELECT src, dst FROM edges_b UNION SELECT dst, src FROM edges_b),
    {_walk('src', 'dst', 1, 'both_b')}, inner_b AS (SELECT id FROM seed UNION SELECT id FROM reached), {_NEAR} SELECT src, dst FROM incident""",
)
def neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """Edges on an undirected walk of two hops from the most imported file."""
    edges = b.edges(spark, folder)
    return g.neighbours(edges, _hubs(edges, 1), 2)


_CROSS = """cross_b AS (
  SELECT e.src, e.dst, a.domain AS src_domain, z.domain AS dst_domain FROM edges_b e JOIN files_b a ON a.id = e.src JOIN files_b z ON z.id = e.dst WHERE a.domain <> z.domain)"""


@CORE.query("cross_domain_edges", f"WITH {b.EDGES_SQL}, {_CROSS} SELECT a.path AS from_file, c.src_domain AS from_domain, z.path AS to_file, c.dst_domain AS to_domain FROM cross_b c JOIN files_b a ON a.id = c.src JOIN files_b z ON z.id = c.dst")
def cross_domain_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Imports whose two files belong to different domains."""
    known = b.files(spark, folder)
    found = g.crossing(b.edges(spark, folder), known)
    a = known.select(F.col("id").alias("src"), F.col("path").alias("from_file"))
    z = known.select(F.col("id").alias("dst"), F.col("path").alias("to_file"))
    return found.join(a, "src").join(z, "dst").select("from_file", F.col("src_domain").alias("from_domain"), "to_file", F.col("dst_domain").alias("to_domain"))


@CORE.query("cross_domain_pairs", f"WITH {b.EDGES_SQL}, {_CROSS} SELECT src_domain, dst_domain, count(*) AS edges, list(src ORDER BY src, dst)[1:3] AS examples FROM cross_b GROUP BY ALL")
def cross_domain_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Crossing edges per pair of domains with three examples; the examples are kept small while counting."""
    found = g.crossing(b.edges(spark, folder), b.files(spark, folder))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("src_domain", "dst_domain").orderBy("src", "dst"))
    first = found.withColumn("r", rank).where("r <= 3").groupBy("src_domain", "dst_domain").agg(F.array_sort(F.collect_list("src")).alias("examples"))
    return found.groupBy("src_domain", "dst_domain").agg(F.count(F.lit(1)).alias("edges")).join(first, ["src_domain", "dst_domain"])


@CORE.query(
    "similar_patterns",
    f"""WITH {b.EDGES_SQL}, seed AS (SELECT src AS id FROM edges_b GROUP BY src ORDER BY count(*) DESC, src LIMIT 10), size AS (SELECT src, count(*) AS n FROM edges_b GROUP BY src),
    shared AS (SELECT a.src AS id, z.src AS other, count(*) AS shared FROM edges_b a JOIN edges_b z USING (dst) WHERE a.src IN (SELECT id FROM seed) AND a.src <> z.src GROUP BY ALL)
    SELECT s.id, s.other, s.shared, s.shared / (x.n + y.n - s.shared) AS score FROM shared s JOIN size x ON x.src = s.id JOIN size y ON y.src = s.other""",
)
def similar_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Jaccard similarity of ten files' imports with everybody's."""
    edges = b.edges(spark, folder)
    seeds = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(10)
    return g.jaccard(edges, seeds)


@CORE.query(
    "similar_patterns_all",
    f"""WITH {b.EDGES_SQL}, size AS (SELECT src, count(*) AS n FROM edges_b GROUP BY src),
    shared AS (SELECT a.src AS id, z.src AS other, count(*) AS shared FROM edges_b a JOIN edges_b z USING (dst) WHERE a.src <> z.src GROUP BY ALL)
    SELECT s.id, s.other, s.shared, s.shared / (x.n + y.n - s.shared) AS score FROM shared s JOIN size x ON x.src = s.id JOIN size y ON y.src = s.other""",
)
def similar_patterns_all(spark: SparkSession, folder: str) -> DataFrame:
    """Jaccard similarity of every file's imports with everybody's."""
    return tiles.similar(b.edges(spark, folder))


@CORE.query("resolve_late_edges", f"WITH {b.FILES_SQL}, {b.IMPORTS_SQL}, paths_b AS (SELECT path, min(id) AS id FROM files_b WHERE path IS NOT NULL GROUP BY path) SELECT i.id, i.src, coalesce(i.dst, p.id) AS dst FROM imports_b i LEFT JOIN paths_b p ON i.dst IS NULL AND i.path = p.path")
def resolve_late_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every import with its target, repaired by exact path where it was unresolved."""
    return g.resolve(b.imports(spark, folder), b.files(spark, folder)).select("id", "src", "dst")


@CORE.query(
    "degrees",
    f"""WITH {b.EDGES_SQL}, ends AS (SELECT dst AS id, 1 AS i, 0 AS o FROM edges_b UNION ALL SELECT src, 0, 1 FROM edges_b)
    SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM ends GROUP BY id""",
)
def degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Direct dependents and dependencies of each file."""
    return g.degrees(b.edges(spark, folder))


@CORE.query("adjacency_bitmap_counts", f"WITH {b.EDGES_SQL} SELECT src, count(*) AS n FROM edges_b GROUP BY src")
def adjacency_bitmap_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of dependencies per file, counted on bitmaps."""
    return g.bitmap_counts(g.adjacency_bitmaps(b.edges(spark, folder)))


@CORE.query(
    "snapshot_edge_diff",
    f"""WITH {b.GRAPH_SQL}, {b.CYCLIC_SQL} SELECT src, dst, 'removed' AS change FROM graph_b WHERE (src, dst) NOT IN (SELECT (src, dst) FROM cyclic_b)
    UNION ALL SELECT src, dst, 'added' FROM cyclic_b WHERE (src, dst) NOT IN (SELECT (src, dst) FROM graph_b)""",
)
def snapshot_edge_diff(spark: SparkSession, folder: str) -> DataFrame:
    """What two states of an edge set do not have in common."""
    return g.edge_changes(b.graph(spark, folder), b.cyclic(spark, folder))


@CORE.query("cross_team_whole", f"WITH {b.BLAME_SQL}, {b.WHOLE_SQL}, own AS (SELECT file, author FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lines DESC, author) rn FROM blame_b) WHERE rn = 1) SELECT e.src, e.dst, x.author AS src_owner, y.author AS dst_owner FROM whole_b e JOIN own x ON x.file = e.src JOIN own y ON y.file = e.dst WHERE x.author <> y.author")
def cross_team_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between files of different main authors, over all line items."""
    return k.cross_owner_edges(b.whole_graph(spark, folder), k.ownership(b.blame(spark, folder)))


@CORE.query(
    "affected_routes_domains",
    f"""WITH RECURSIVE {b.EDGES_SQL}, {_SEED}, {_walk('dst', 'src', 5)}
    SELECT count(CASE WHEN hop = 1 THEN 1 END) AS direct, count(CASE WHEN hop > 1 THEN 1 END) AS transitive, count(DISTINCT f.domain) AS domains, list_sort(list(DISTINCT f.domain) FILTER (f.domain IS NOT NULL)) AS domain_names
    FROM reached r JOIN files_b f USING (id)""",
)
def affected_routes_domains(spark: SparkSession, folder: str) -> DataFrame:
    """The blast radius of a file rolled up: direct, transitive, domains touched."""
    edges = b.edges(spark, folder)
    hit = g.reach(edges, _hubs(edges, 1)).join(b.files(spark, folder), "id")
    return hit.agg(
        F.count(F.when(F.col("hop") == 1, 1)).alias("direct"), F.count(F.when(F.col("hop") > 1, 1)).alias("transitive"), F.count_distinct("domain").alias("domains"), F.array_sort(F.collect_set("domain")).alias("domain_names")
    )
