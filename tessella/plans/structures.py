"""Relational queries: summaries, orphans, roll-ups, histograms, packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import attention as a
from tessella.operators import domains as d
from tessella.operators import graph as g
from tessella.operators import structure as s
from tessella.plans.registry import CORE
from tessella.sources import bindings as b
from tessella.sources.tables import table


@CORE.query(
    "structure_totals",
    f"""WITH {b.EDGES_SQL}, {b.SYMBOLS_SQL}, {b.MODELS_SQL}
    SELECT (SELECT count(*) FROM files_b) AS files, (SELECT count(*) FROM imports_b) AS imports, (SELECT count(*) FROM edges_b) AS edges, (SELECT count(*) FROM symbols_b) AS symbols,
           (SELECT count(*) FROM models_b) AS models, (SELECT count(DISTINCT domain) FROM files_b) AS domains""",
)
def structure_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of every fact table in one row."""
    parts = [(b.files(spark, folder), "files"), (b.imports(spark, folder), "imports"), (b.edges(spark, folder), "edges"), (b.symbols(spark, folder), "symbols"), (b.models(spark, folder), "models")]
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("k"), "n") for df, n in parts]
    rows.append(b.files(spark, folder).agg(F.count_distinct("domain").alias("n")).select(F.lit("domains").alias("k"), "n"))
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return union.agg(*[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in ("files", "imports", "edges", "symbols", "models", "domains")])


@CORE.query(
    "domain_summary",
    f"""WITH {b.FILES_SQL}, {b.SYMBOLS_SQL}, {b.MODELS_SQL}
    SELECT domain, count(DISTINCT f.id) AS files, (SELECT count(*) FROM symbols_b s JOIN files_b x ON x.id = s.file_id WHERE x.domain = f.domain) AS symbols,
           (SELECT count(*) FROM models_b m JOIN files_b x ON x.id = m.file_id WHERE x.domain = f.domain) AS models
    FROM files_b f WHERE domain IS NOT NULL GROUP BY domain""",
)
def domain_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Files, symbols and models of each domain."""
    return s.domain_summary(b.files(spark, folder), b.symbols(spark, folder), b.models(spark, folder))


@CORE.query("domain_files", f"WITH {b.FILES_SQL}, {b.SYMBOLS_SQL} SELECT f.path, s.name, s.kind FROM symbols_b s JOIN files_b f ON f.id = s.file_id WHERE f.domain = 'AUTH' AND s.exported")
def domain_files(spark: SparkSession, folder: str) -> DataFrame:
    """Exported symbols of one domain."""
    wanted = s.where_given(b.files(spark, folder), domain="AUTH").select(F.col("id").alias("file_id"), "path")
    return b.symbols(spark, folder).where("exported").join(wanted, "file_id").select("path", "name", "kind")


@CORE.query("orphans", f"WITH {b.EDGES_SQL} SELECT id, path FROM files_b f WHERE NOT EXISTS (SELECT 1 FROM edges_b e WHERE e.dst = f.id AND e.src <> e.dst)")
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Files that no other file imports."""
    return s.orphans(b.files(spark, folder), b.edges(spark, folder)).select("id", "path")


@CORE.query(
    "entry_points",
    f"WITH {b.EDGES_SQL}, real_b AS (SELECT * FROM edges_b WHERE src <> dst) SELECT id, path FROM files_b WHERE id IN (SELECT src FROM real_b) AND id NOT IN (SELECT dst FROM real_b)",
)
def entry_points(spark: SparkSession, folder: str) -> DataFrame:
    """Files that import others and are imported by none."""
    return s.entry_points(b.files(spark, folder), b.edges(spark, folder)).select("id", "path")


@CORE.query(
    "error_rollup",
    f"WITH {b.ERRORS_SQL} SELECT file_id, count(*) AS errors, string_agg(DISTINCT phase, ',' ORDER BY phase) AS phases, arg_max(coalesce(error_message, ''), (ts, id)) AS sample FROM errors_b GROUP BY file_id",
)
def error_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Errors per file with phases and the newest message."""
    return s.error_rollup(b.errors(spark, folder).withColumn("error_message", F.coalesce("error_message", F.lit(""))))


_LINKS = """owned AS (SELECT id, domain FROM files_b WHERE domain IS NOT NULL),
dpairs AS (SELECT x.domain AS a, y.domain AS z, count(*) AS n FROM edges_b e JOIN owned x ON x.id = e.src JOIN owned y ON y.id = e.dst WHERE e.src <> e.dst GROUP BY ALL),
links AS (SELECT d.domain, count(*) AS files,
    coalesce((SELECT sum(n) FROM dpairs WHERE a = d.domain AND z = d.domain), 0)::BIGINT AS intra,
    coalesce((SELECT sum(n) FROM dpairs WHERE a = d.domain AND z <> d.domain), 0)::BIGINT AS outgoing,
    coalesce((SELECT sum(n) FROM dpairs WHERE a <> d.domain AND z = d.domain), 0)::BIGINT AS incoming FROM owned d GROUP BY d.domain)"""


@CORE.query("cut_points", f"WITH {b.EDGES_SQL}, {_LINKS} SELECT domain, files, intra, outgoing, incoming, CASE WHEN intra + outgoing + incoming > 0 THEN intra / (intra + outgoing + incoming) END AS cohesion FROM links")
def cut_points(spark: SparkSession, folder: str) -> DataFrame:
    """Links within, out of and into each domain, and its cohesion."""
    return s.domain_links(b.edges(spark, folder), b.files(spark, folder))


@CORE.query(
    "dependency_surface",
    f"""WITH {b.IMPORTS_SQL} SELECT CASE WHEN path LIKE '@%' AND contains(path, '/') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) WHEN path LIKE '@%' THEN path ELSE split_part(path, '/', 1) END AS package,
    count(*) AS imports, count(DISTINCT src) AS importers FROM imports_b WHERE path IS NOT NULL AND dst IS NULL AND split_part(path, '/', 1) NOT IN (SELECT name FROM repos WHERE name IS NOT NULL) GROUP BY 1""",
)
def dependency_surface(spark: SparkSession, folder: str) -> DataFrame:
    """Outside packages with their imports and importing files."""
    return s.import_packages(b.imports(spark, folder), table(spark, folder, "repos"))


@CORE.query(
    "upgrade_reach",
    f"""WITH {b.FILES_SQL}, {b.IMPORTS_SQL} SELECT i.path AS package, count(DISTINCT i.src) AS files, count(DISTINCT f.domain) AS domains FROM imports_b i JOIN files_b f ON f.id = i.src
    WHERE i.dst IS NULL AND i.path IS NOT NULL AND NOT contains(i.path, '/') GROUP BY i.path HAVING count(DISTINCT i.src) >= 10""",
)
def upgrade_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Packages imported by at least ten files, and over how many domains."""
    owner = b.files(spark, folder).select(F.col("id").alias("src"), "domain")
    used = b.imports(spark, folder).where("dst is null and path is not null").where(~F.col("path").contains("/")).select("path", "src").distinct().join(owner, "src")
    return used.groupBy(F.col("path").alias("package")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("domain").alias("domains")).where("files >= 10")


@CORE.query(
    "top_files_per_domain",
    f"""WITH {b.EDGES_SQL}, fan AS (SELECT dst AS id, count(*) AS n FROM edges_b WHERE src <> dst GROUP BY dst)
    SELECT domain, path, n FROM (SELECT f.domain, f.path, fan.n, row_number() OVER (PARTITION BY f.domain ORDER BY fan.n DESC, f.path, f.id) r FROM fan JOIN files_b f USING (id) WHERE f.domain IS NOT NULL) WHERE r <= 5""",
)
def top_files_per_domain(spark: SparkSession, folder: str) -> DataFrame:
    """The five most imported files of each domain."""
    fan = b.edges(spark, folder).where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = fan.join(b.files(spark, folder), "id").where("domain is not null").select("domain", "path", "n", "id")
    return s.top_per_group(rows, ["domain"], [F.desc("n"), F.col("path"), F.col("id")], 5).drop("id")


@CORE.query(
    "language_share",
    f"""WITH {b.FILES_SQL} SELECT repo_name, lang, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY repo_name) AS share FROM files_b GROUP BY repo_name, lang""",
)
def language_share(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of each repository and their share."""
    return s.share_of_group(b.files(spark, folder).groupBy("repo_name", "lang").agg(F.count(F.lit(1)).alias("n")), ["repo_name"])


@CORE.query(
    "shared_import_peers",
    f"""WITH {b.EDGES_SQL}, seed AS (SELECT src AS id FROM edges_b GROUP BY src ORDER BY count(*) DESC, src LIMIT 10)
    SELECT a.src AS id, z.src AS other, count(DISTINCT a.dst) AS shared FROM edges_b a JOIN edges_b z USING (dst) WHERE a.src IN (SELECT id FROM seed) AND a.src <> z.src GROUP BY ALL HAVING count(DISTINCT a.dst) >= 2""",
)
def shared_import_peers(spark: SparkSession, folder: str) -> DataFrame:
    """Files that share at least two imports with one of ten files."""
    edges = b.edges(spark, folder)
    seeds = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(10).select("src")
    mine = edges.join(seeds, "src", "left_semi").select(F.col("src").alias("id"), "dst")
    return mine.join(edges.select(F.col("src").alias("other"), "dst"), "dst").where("id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


@CORE.query(
    "shared_import_peers_all",
    f"""WITH {b.EDGES_SQL} SELECT a.src AS id, z.src AS other, count(DISTINCT a.dst) AS shared FROM edges_b a JOIN edges_b z USING (dst) WHERE a.src <> z.src GROUP BY ALL HAVING count(DISTINCT a.dst) >= 2""",
)
def shared_import_peers_all(spark: SparkSession, folder: str) -> DataFrame:
    """Files that share at least two imports, for every file."""
    edges = b.edges(spark, folder)
    return g.sharing(edges.select(F.col("src").alias("id"), "dst"), edges.select(F.col("src").alias("other"), "dst")).where("shared >= 2")


@CORE.query("routes_list", f"WITH {b.ROUTES_SQL} SELECT file, method, path FROM routes_b")
def routes_list(spark: SparkSession, folder: str) -> DataFrame:
    """All routes that documents tell."""
    return b.routes(spark, folder)


@CORE.query("search_routes", f"WITH {b.ROUTES_SQL} SELECT file, method, path FROM routes_b WHERE contains(lower(path), 'invoice') OR contains(lower(method), 'invoice')")
def search_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes whose path or method holds a text, case aside."""
    return b.routes(spark, folder).where(s.contains_any_case(["path", "method"], "Invoice"))


@CORE.query("glob_files", rf"WITH {b.FILES_SQL} SELECT id, path FROM files_b WHERE regexp_full_match(path, '(?:.*/)?src/[^/]*/[^/]*/[^/]*\.ts')")
def glob_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that match a path glob."""
    return b.files(spark, folder).where(F.col("path").rlike(s.glob_pattern("**/src/*/*/*.ts"))).select("id", "path")


@CORE.query("model_kinds", f"WITH {b.MODELS_SQL} SELECT kind, count(*) AS models, kind NOT IN ('interface', 'class', 'swiftui-view', 'flutter-widget') AS data FROM models_b WHERE kind IS NOT NULL GROUP BY kind")
def model_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Models by kind, those that hold data told from interfaces, classes and views."""
    kinds = b.models(spark, folder).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("models"))
    return kinds.withColumn("data", ~F.col("kind").isin("interface", "class", "swiftui-view", "flutter-widget"))


@CORE.query(
    "error_remainder",
    f"WITH {b.ERRORS_SQL}, c AS (SELECT file_id, count(*) AS n FROM errors_b WHERE file_id IS NOT NULL GROUP BY file_id), top AS (SELECT n FROM c ORDER BY n DESC, file_id LIMIT 5) SELECT (SELECT count(*) FROM errors_b) AS errors, (SELECT sum(n) FROM top)::BIGINT AS of_top_five, (SELECT count(*) FROM errors_b) - (SELECT sum(n) FROM top)::BIGINT AS remainder",
)
def error_remainder(spark: SparkSession, folder: str) -> DataFrame:
    """All errors, those of the five files with most, and the rest."""
    errors = b.errors(spark, folder)
    top = s.error_rollup(errors.where("file_id is not null")).orderBy(F.desc("errors"), "file_id").limit(5).agg(F.sum("errors").alias("of_top_five"))
    return errors.agg(F.count(F.lit(1)).alias("errors")).join(F.broadcast(top), F.lit(True)).select("errors", "of_top_five", (F.col("errors") - F.col("of_top_five")).alias("remainder"))


@CORE.query(
    "upgrade_risk",
    f"""WITH {b.FILES_SQL}, {b.IMPORTS_SQL}, used AS (SELECT DISTINCT CASE WHEN starts_with(path, '@') THEN array_to_string(string_split(path, '/')[1:2], '/') ELSE split_part(path, '/', 1) END AS package, src FROM imports_b WHERE dst IS NULL AND path IS NOT NULL AND split_part(path, '/', 1) NOT IN (SELECT name FROM repos WHERE name IS NOT NULL))
    SELECT package, count(*) AS files, count(DISTINCT f.domain) AS domains, CASE WHEN count(*) >= 50 THEN 'HIGH' WHEN count(*) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM used u JOIN files_b f ON f.id = u.src GROUP BY package""",
)
def upgrade_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Outside packages, scoped ones by scope and name, with the files and domains an upgrade reaches."""
    names = table(spark, folder, "repos").select(F.col("name").alias("__s")).where("__s is not null").distinct()
    segment = F.substring_index("path", "/", 1)
    package = F.when(F.col("path").startswith("@"), F.substring_index("path", "/", 2)).otherwise(segment)
    used = b.imports(spark, folder).where("dst is null and path is not null").withColumn("__s", segment).join(names, "__s", "left_anti").select(package.alias("package"), "src").distinct()
    owner = b.files(spark, folder).select(F.col("id").alias("src"), "domain")
    return a.upgrade_levels(used.join(owner, "src").groupBy("package").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("domain").alias("domains")))


@CORE.query(
    "cut_candidates",
    f"""WITH {b.EDGES_SQL}, p AS (SELECT x.domain AS a, y.domain AS z, count(*) AS n FROM edges_b e JOIN files_b x ON x.id = e.src JOIN files_b y ON y.id = e.dst WHERE e.src <> e.dst AND x.domain IS NOT NULL AND y.domain IS NOT NULL GROUP BY ALL),
    d AS (SELECT domain, count(*) AS files FROM files_b WHERE domain IS NOT NULL GROUP BY domain), l AS (SELECT domain, files, coalesce((SELECT sum(n) FROM p WHERE a = domain AND z = domain), 0) AS intra, coalesce((SELECT sum(n) FROM p WHERE (a = domain) <> (z = domain)), 0) AS outside FROM d)
    SELECT domain, files, intra / (intra + outside) AS cohesion, files >= 10 AND intra / (intra + outside) >= 0.7 AS candidate FROM l WHERE intra + outside > 0""",
)
def cut_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Which domains are large and cohesive enough to be cut out."""
    links = s.domain_links(b.edges(spark, folder), b.files(spark, folder)).where("cohesion is not null")
    return links.select("domain", "files", "cohesion", ((F.col("files") >= 10) & (F.col("cohesion") >= 0.7)).alias("candidate"))


@CORE.query(
    "domain_inspection",
    f"""WITH {b.FILES_SQL}, {b.MODELS_SQL}, {b.SYMBOLS_SQL}, {b.ROUTES_SQL}, r AS (SELECT file AS id, count(*) AS n FROM routes_b GROUP BY 1), m AS (SELECT file_id AS id, count(*) AS n FROM models_b GROUP BY 1), y AS (SELECT file_id AS id, count(*) AS n FROM symbols_b GROUP BY 1)
    SELECT domain, count(*) AS files, coalesce(sum(y.n), 0)::BIGINT AS symbols, coalesce(sum(m.n), 0)::BIGINT AS models, coalesce(sum(r.n), 0)::BIGINT AS routes FROM files_b f LEFT JOIN r USING (id) LEFT JOIN m USING (id) LEFT JOIN y USING (id) WHERE domain IS NOT NULL GROUP BY domain""",
)
def domain_inspection(spark: SparkSession, folder: str) -> DataFrame:
    """Files, symbols, models and routes of each domain; a document's routes count for the file of the same id."""
    files = b.files(spark, folder)
    out = s.domain_summary(files, b.symbols(spark, folder), b.models(spark, folder))
    routes = b.routes(spark, folder).groupBy(F.col("file").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(files.select("id", "domain"), "id").groupBy("domain").agg(F.sum("n").alias("routes"))
    return out.join(routes, "domain", "left").withColumn("routes", F.coalesce("routes", F.lit(0)))


@CORE.query(
    "peers_by_imports",
    f"""WITH {b.EDGES_SQL}, n AS (SELECT f.id, f.path, f.domain, count(e.dst) AS imports FROM files_b f LEFT JOIN edges_b e ON e.src = f.id WHERE f.domain IS NOT NULL GROUP BY ALL), seed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY imports DESC, id) r FROM n) WHERE r = 1)
    SELECT domain, path, imports FROM (SELECT n.*, row_number() OVER (PARTITION BY n.domain ORDER BY abs(n.imports - s.imports), n.path, n.id) r FROM n JOIN seed s ON s.domain = n.domain WHERE n.id <> s.id) WHERE r <= 8""",
)
def peers_by_imports(spark: SparkSession, folder: str) -> DataFrame:
    """In each domain the eight files whose number of imports comes closest to that of the file with most."""
    out = b.edges(spark, folder).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("imports"))
    rows = b.files(spark, folder).where("domain is not null").select("id", "path", "domain").join(out, "id", "left").withColumn("imports", F.coalesce("imports", F.lit(0)))
    seeds = s.top_per_group(rows, ["domain"], [F.desc("imports"), F.col("id")], 1).select("domain", F.col("id").alias("seed"), F.col("imports").alias("of_seed"))
    near = rows.join(seeds, "domain").where("id <> seed")
    return s.top_per_group(near, ["domain"], [F.abs(F.col("imports") - F.col("of_seed")), F.col("path"), F.col("id")], 8).select("domain", "path", "imports")


@CORE.query(
    "declared_domains",
    f"""WITH {b.FILES_SQL} SELECT id, CASE WHEN path LIKE '%/src/db/%' THEN 'DATABASE' WHEN regexp_matches(path, '^(?:.*/)?api/[^/]*$') THEN 'API' ELSE 'CORE' END AS domain FROM files_b""",
)
def declared_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domains that a project declares by globs; the first that fits holds, all else is the core."""
    files = b.files(spark, folder)
    none = files.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    return d.assign(files, none, {}, {"DATABASE": ("**/src/db/**",), "API": ("**/api/*",)}).select("id", "domain")


@CORE.query("model_domains", f"""WITH {b.MODELS_SQL} SELECT CASE {" ".join("WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in words) + f" THEN '{n}'" for n, words in d.SEEDS.items())} ELSE 'DATABASE' END AS domain, count(*) AS models FROM models_b WHERE name IS NOT NULL GROUP BY 1""")
def model_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Models grouped by the domain whose words their names hold, DATABASE otherwise."""
    return d.cluster_names(b.models(spark, folder), "name", "DATABASE").withColumnRenamed("n", "models")


@CORE.query(
    "bitmap_sets",
    f"""WITH {b.EDGES_SQL}, hub AS (SELECT src FROM edges_b GROUP BY src ORDER BY count(*) DESC, src LIMIT 6), p AS (SELECT a.src AS a, z.src AS b FROM hub a JOIN hub z ON a.src < z.src)
    SELECT a, b, (SELECT count(*) FROM (SELECT dst FROM edges_b WHERE src = a INTERSECT SELECT dst FROM edges_b WHERE src = b)) AS both, (SELECT count(*) FROM (SELECT dst FROM edges_b WHERE src = a UNION SELECT dst FROM edges_b WHERE src = b)) AS either,
      (SELECT count(*) FROM (SELECT dst FROM edges_b WHERE src = a EXCEPT SELECT dst FROM edges_b WHERE src = b)) AS only_a FROM p""",
)
def bitmap_sets(spark: SparkSession, folder: str) -> DataFrame:
    """And, or and and-not of the imports of six files, on bitmaps."""
    edges = b.edges(spark, folder)
    hubs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(6).select("src")
    pairs = hubs.select(F.col("src").alias("a")).join(hubs.select(F.col("src").alias("b")), F.col("a") < F.col("b"))
    return g.bitmap_set_counts(g.adjacency_bitmaps(edges), pairs)
