"""Queries over commits and snapshot series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph as g
from tessella.operators import history
from tessella.operators import temporal as t
from tessella.plans.graphs import _CLOSURE
from tessella.plans.records import _SERIES
from tessella.plans.registry import CORE
from tessella.sources import bindings as b
from tessella.sources.tables import table


def _history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return history.full_snapshots(table(spark, folder, "snapshots"), table(spark, folder, "file_domains_at"))


_CHURN = f"{b.COMMITS_SQL}, churn_b AS (SELECT f.file, count(*) AS commits, min(c.ts) AS first_seen, max(c.ts) AS last_modified FROM commit_files_b f JOIN commits_b c USING (sha) GROUP BY f.file)"


@CORE.query("churn", f"WITH {_CHURN} SELECT * FROM churn_b")
def churn(spark: SparkSession, folder: str) -> DataFrame:
    """Commits per file with first and last time."""
    return t.churn(b.commits(spark, folder), b.commit_files(spark, folder))


@CORE.query(
    "hotspots",
    f"""WITH RECURSIVE {b.GRAPH_SQL}, {_CLOSURE.format('graph_b')}, {_CHURN}, first_b AS (SELECT * FROM churn_b ORDER BY commits DESC, file LIMIT 500),
    hit AS (SELECT file, count(*) AS dependents FROM closure_b GROUP BY file)
    SELECT f.file, f.commits, coalesce(h.dependents, 0) AS dependents, f.commits * greatest(1, coalesce(h.dependents, 0)) AS score FROM first_b f LEFT JOIN hit h USING (file) ORDER BY score DESC, f.file LIMIT 20""",
)
def hotspots(spark: SparkSession, folder: str) -> DataFrame:
    """Files that change often and have many dependents."""
    impact = g.impact_counts(g.closure(b.graph(spark, folder)))
    return t.hotspots(t.churn(b.commits(spark, folder), b.commit_files(spark, folder)), impact)


@CORE.query("change_velocity", f"WITH {b.COMMITS_SQL} SELECT CAST(ts AS DATE) AS day, count(*) AS commits FROM commits_b GROUP BY 1")
def change_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Commits per day."""
    return t.velocity(b.commits(spark, folder))


_COUNTS = _SERIES + """,
counts AS (SELECT e.repo_name, e.seq, e.snapshot_id, s.domain_name AS domain, count(*) AS files FROM states s JOIN series e USING (snapshot_id) WHERE s.domain_name IS NOT NULL GROUP BY ALL)"""


@CORE.query(
    "architectural_drift",
    _COUNTS
    + """, ends AS (SELECT repo_name, arg_min(snapshot_id, seq) AS a, arg_max(snapshot_id, seq) AS z FROM series GROUP BY repo_name HAVING count(*) > 1),
    both_ends AS (SELECT repo_name, domain, sum(CASE WHEN snapshot_id = a THEN files ELSE 0 END)::BIGINT AS before, sum(CASE WHEN snapshot_id = z THEN files ELSE 0 END)::BIGINT AS after
      FROM counts JOIN ends USING (repo_name) WHERE snapshot_id IN (a, z) GROUP BY ALL)
    SELECT repo_name, domain, before, after, after - before AS delta, CASE WHEN after > before * 1.05 THEN 'growing' WHEN after < before * 0.95 THEN 'shrinking' ELSE 'stable' END AS trend FROM both_ends""",
)
def architectural_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Domain sizes, first against last full snapshot."""
    return t.drift(*_history(spark, folder))


@CORE.query("domain_evolution", _COUNTS + " SELECT e.repo_name, e.snapshot_id, e.ts, coalesce(c.files, 0) AS files FROM series e LEFT JOIN counts c ON c.snapshot_id = e.snapshot_id AND c.domain = 'AUTH'")
def domain_evolution(spark: SparkSession, folder: str) -> DataFrame:
    """Size of one domain in every full snapshot."""
    return t.evolution(*_history(spark, folder), "AUTH")


_MOVES = _SERIES + """,
placed AS (SELECT e.repo_name, e.seq, s.file_path, s.domain_name AS domain FROM states s JOIN series e USING (snapshot_id) WHERE s.domain_name IS NOT NULL),
sides AS (SELECT repo_name, seq, file_path, domain, 1 AS now, 0 AS was FROM placed WHERE seq > 1
  UNION ALL SELECT repo_name, seq + 1, file_path, domain, 0, 1 FROM placed p WHERE seq < (SELECT max(seq) FROM series x WHERE x.repo_name = p.repo_name)),
each_b AS (SELECT repo_name, seq, domain, file_path, max(now) AS now, max(was) AS was FROM sides GROUP BY ALL),
moves AS (SELECT repo_name, seq, domain, sum(was)::BIGINT AS before, sum(now)::BIGINT AS after, sum(CASE WHEN now = 0 THEN 1 ELSE 0 END)::BIGINT AS left_it, sum(CASE WHEN was = 0 THEN 1 ELSE 0 END)::BIGINT AS joined FROM each_b GROUP BY ALL)"""


@CORE.query("membership_moves", _MOVES + " SELECT * FROM moves")
def membership_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Files that joined and left each domain between neighbouring snapshots."""
    return t.membership_moves(*_history(spark, folder))


@CORE.query(
    "arch_events",
    _MOVES
    + """, m AS (SELECT *, abs(after - before) AS change, CASE WHEN before > 0 THEN abs(after - before) / before END AS part, greatest(before, after) AS size FROM moves),
    e AS (
      SELECT *, 'new_domain' AS kind, CASE WHEN size >= 10 THEN 'major' ELSE 'minor' END AS severity FROM m WHERE before = 0
      UNION ALL SELECT *, 'domain_disappeared', CASE WHEN size >= 10 THEN 'major' ELSE 'minor' END FROM m WHERE after = 0
      UNION ALL SELECT *, CASE WHEN after > before THEN 'growth' ELSE 'shrink' END, CASE WHEN part >= 0.5 THEN 'major' ELSE 'minor' END FROM m WHERE before > 0 AND after > 0 AND part >= 0.2 AND change >= 5
      UNION ALL SELECT *, 'domain_unstable', CASE WHEN left_it / before >= 0.5 THEN 'critical' ELSE 'major' END FROM m WHERE before > 0 AND after > 0 AND left_it >= 3 AND left_it / before >= 0.3)
    SELECT s.snapshot_id, e.domain, e.kind, e.severity, e.before, e.after FROM e JOIN series s ON s.repo_name = e.repo_name AND s.seq = e.seq""",
)
def arch_events(spark: SparkSession, folder: str) -> DataFrame:
    """Appearing, vanishing, growing, shrinking and unstable domains."""
    return t.events(*_history(spark, folder))


@CORE.query(
    "domain_health",
    _SERIES
    + """, last_b AS (SELECT repo_name, arg_max(snapshot_id, seq) AS l, max(ts) AS lts FROM series GROUP BY repo_name),
    ends AS (SELECT s.repo_name, any_value(l) AS l, arg_max(s.snapshot_id, s.seq) AS p FROM series s JOIN last_b USING (repo_name) WHERE s.ts <= lts - INTERVAL 30 DAYS GROUP BY s.repo_name),
    each_b AS (SELECT e.repo_name, s.domain_name AS domain, s.file_path, max(CASE WHEN s.snapshot_id = l THEN 1 ELSE 0 END) AS now, max(CASE WHEN s.snapshot_id = p THEN 1 ELSE 0 END) AS was
      FROM states s JOIN ends e ON s.snapshot_id IN (e.l, e.p) WHERE s.domain_name IS NOT NULL GROUP BY ALL),
    sums AS (SELECT repo_name, domain, sum(was)::BIGINT AS before, sum(now)::BIGINT AS after, sum(CASE WHEN now = 0 THEN 1 ELSE 0 END)::BIGINT AS moved FROM each_b GROUP BY ALL)
    SELECT *, after - before AS growth, CASE WHEN before > 0 THEN floor((after - before) / before * 100 + 0.5) / 100 END AS growth_rate, CASE WHEN before > 0 THEN floor(moved / before * 100 + 0.5) / 100 END AS instability FROM sums""",
)
def domain_health(spark: SparkSession, folder: str) -> DataFrame:
    """The latest full snapshot against the one as of thirty days before."""
    return t.health(*_history(spark, folder))


@CORE.query(
    "file_presence",
    _SERIES
    + """ SELECT e.repo_name, s.file_path, count(*) AS snapshots, count(DISTINCT s.domain_name) AS domains, CASE WHEN count(*) >= 3 THEN 'tracked' ELSE 'sparse' END AS kind FROM states s JOIN series e USING (snapshot_id) GROUP BY e.repo_name, s.file_path""",
)
def file_presence(spark: SparkSession, folder: str) -> DataFrame:
    """How many full snapshots hold each path."""
    return t.presence(*_history(spark, folder))


@CORE.query(
    "domain_stability",
    f"""WITH {b.FILES_SQL}, firsts AS (SELECT id, domain FROM (SELECT id, {b._label('domain')} AS domain, row_number() OVER (PARTITION BY id ORDER BY last_indexed_at ASC NULLS FIRST, {b._label('domain')} ASC NULLS FIRST) rn FROM files WHERE id IS NOT NULL) WHERE rn = 1)
    SELECT count(*) AS files, count(CASE WHEN a.domain IS DISTINCT FROM z.domain THEN 1 END) AS changed, count(CASE WHEN a.domain IS DISTINCT FROM z.domain THEN 1 END) / count(*) AS share FROM firsts a JOIN files_b z USING (id)""",
)
def domain_stability(spark: SparkSession, folder: str) -> DataFrame:
    """How many files changed their domain between their first and last delivery."""
    from tessella.functions.paths import clean_label

    rows = table(spark, folder, "files").where("id is not null").select("id", clean_label(F.col("domain")).alias("domain"), "last_indexed_at")
    first = rows.groupBy("id").agg(F.min(F.struct("last_indexed_at", "domain")).alias("r")).select("id", "r.domain")
    return t.stability(first, b.files(spark, folder))


@CORE.query(
    "snapshot_intake",
    """WITH k AS (SELECT DISTINCT repo_name, commit_sha, source FROM snapshots WHERE commit_sha IS NOT NULL)
    SELECT repo_name, source, count(*) AS snapshots FROM (SELECT repo_name, source FROM k UNION ALL SELECT repo_name, source FROM (SELECT DISTINCT * FROM snapshots) WHERE commit_sha IS NULL) GROUP BY ALL""",
)
def snapshot_intake(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots that an empty store takes in, per repository and source."""
    rows = table(spark, folder, "snapshots").distinct()
    return t.new_snapshots(rows.limit(0), rows).groupBy("repo_name", "source").agg(F.count(F.lit(1)).alias("snapshots"))


@CORE.query(
    "initial_events",
    _SERIES + " SELECT e.snapshot_id, NULL::VARCHAR AS domain, 'initial_snapshot' AS kind, 'minor' AS severity, 0::BIGINT AS before, count(*) AS after FROM series e JOIN states s USING (snapshot_id) WHERE e.seq = 1 GROUP BY e.snapshot_id",
)
def initial_events(spark: SparkSession, folder: str) -> DataFrame:
    """Where each repository's series begins."""
    return t.first_events(*_history(spark, folder))


@CORE.query(
    "hotspot_events",
    f"""WITH {b.WHOLE_SQL}, {_CHURN}, top AS (SELECT dst AS id, count(*) AS dependents FROM whole_b GROUP BY dst ORDER BY dependents DESC, id LIMIT 20)
    SELECT t.id, CASE WHEN t.dependents >= 50 THEN 'critical' ELSE 'major' END AS severity, t.dependents, c.commits FROM top t JOIN churn_b c ON c.file = t.id WHERE t.dependents >= 20 AND c.commits >= 2""",
)
def hotspot_events(spark: SparkSession, folder: str) -> DataFrame:
    """The files with most dependents of all that were committed again."""
    fan = g.degrees(b.whole_graph(spark, folder)).select("id", F.col("fan_in").alias("dependents"))
    return t.hotspot_events(t.churn(b.commits(spark, folder), b.commit_files(spark, folder)), fan)


@CORE.query(
    "churn_vs_blast",
    f"""WITH {b.WHOLE_SQL}, {_CHURN}, fan AS (SELECT dst AS file, count(*) AS dependents FROM whole_b GROUP BY dst)
    SELECT c.file, c.commits, coalesce(f.dependents, 0) AS dependents FROM churn_b c LEFT JOIN fan f USING (file) ORDER BY c.commits DESC, c.file LIMIT 1000""",
)
def churn_vs_blast(spark: SparkSession, folder: str) -> DataFrame:
    """The thousand most committed files with their direct dependents."""
    fan = g.degrees(b.whole_graph(spark, folder)).select(F.col("id").alias("file"), F.col("fan_in").alias("dependents"))
    first = t.churn(b.commits(spark, folder), b.commit_files(spark, folder)).orderBy(F.desc("commits"), "file").limit(1000)
    return first.join(fan, "file", "left").select("file", "commits", F.coalesce("dependents", F.lit(0)).alias("dependents"))


_EVENTS = _MOVES + """, m AS (SELECT *, abs(after - before) AS change, CASE WHEN before > 0 THEN abs(after - before) / before END AS part, greatest(before, after) AS size FROM moves),
    e AS (SELECT *, 'new_domain' AS kind, CASE WHEN size >= 10 THEN 'major' ELSE 'minor' END AS severity FROM m WHERE before = 0
      UNION ALL SELECT *, 'domain_disappeared', CASE WHEN size >= 10 THEN 'major' ELSE 'minor' END FROM m WHERE after = 0
      UNION ALL SELECT *, CASE WHEN after > before THEN 'growth' ELSE 'shrink' END, CASE WHEN part >= 0.5 THEN 'major' ELSE 'minor' END FROM m WHERE before > 0 AND after > 0 AND part >= 0.2 AND change >= 5
      UNION ALL SELECT *, 'domain_unstable', CASE WHEN left_it / before >= 0.5 THEN 'critical' ELSE 'major' END FROM m WHERE before > 0 AND after > 0 AND left_it >= 3 AND left_it / before >= 0.3),
    told AS (SELECT s.snapshot_id, s.ts, e.domain, e.kind, e.severity, e.before, e.after FROM e JOIN series s ON s.repo_name = e.repo_name AND s.seq = e.seq)"""


@CORE.query("recent_events", _EVENTS + " SELECT * FROM told WHERE ts >= (SELECT max(ts) FROM series) - INTERVAL 90 DAYS AND severity IN ('major', 'critical') ORDER BY ts DESC, snapshot_id, domain, kind LIMIT 100")
def recent_events(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred newest grave events of the last ninety days."""
    series, states = _history(spark, folder)
    return t.recent_events(t.events(series, states), series, 90, ("major", "critical"))


@CORE.query(
    "drift_in_range",
    _COUNTS
    + """, near AS (SELECT s.* FROM series s JOIN (SELECT repo_name, max(ts) AS l FROM series GROUP BY repo_name) USING (repo_name) WHERE s.ts >= l - INTERVAL 90 DAYS),
    ends AS (SELECT repo_name, arg_min(snapshot_id, seq) AS a, arg_max(snapshot_id, seq) AS z FROM near GROUP BY repo_name HAVING count(*) > 1),
    d AS (SELECT repo_name, domain, sum(CASE WHEN snapshot_id = a THEN files ELSE 0 END)::BIGINT AS before, sum(CASE WHEN snapshot_id = z THEN files ELSE 0 END)::BIGINT AS after FROM counts JOIN ends USING (repo_name) WHERE snapshot_id IN (a, z) GROUP BY ALL)
    SELECT repo_name, domain, before, after, after - before AS delta FROM d ORDER BY abs(after - before) DESC, repo_name, domain LIMIT 50""",
)
def drift_in_range(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty domains that moved most within the last ninety days of their series."""
    series, states = _history(spark, folder)
    return t.drift(t.within(series, 90), states).select("repo_name", "domain", "before", "after", "delta").orderBy(F.desc(F.abs("delta")), "repo_name", "domain").limit(50)


@CORE.query(
    "file_history",
    _SERIES
    + """, last_b AS (SELECT repo_name, max(ts) AS now, max(seq) AS m FROM series GROUP BY repo_name)
    SELECT e.repo_name, s.file_path, count(*) AS snapshots, count(DISTINCT s.domain_name) AS domains, min(e.ts) AS first_seen, max(e.ts) AS last_seen, date_diff('day', min(e.ts)::DATE, any_value(now)::DATE)::INT AS age_days, max(e.seq) = any_value(m) AS held_now
    FROM states s JOIN series e USING (snapshot_id) JOIN last_b USING (repo_name) GROUP BY e.repo_name, s.file_path""",
)
def file_history(spark: SparkSession, folder: str) -> DataFrame:
    """Age and presence of every path."""
    return t.file_history(*_history(spark, folder))


@CORE.query("velocity_summary", f"WITH {b.COMMITS_SQL}, d AS (SELECT ts::DATE, count(*) AS n FROM commits_b GROUP BY 1) SELECT count(*) AS days, sum(n)::BIGINT AS commits, avg(n) AS mean FROM d")
def velocity_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Commits per day with commits, on average."""
    return t.velocity_summary(b.commits(spark, folder))


@CORE.query(
    "decision_log",
    f"""WITH {b.LOG_SQL}, d AS (SELECT id, ts, kind, file, date_trunc('hour', ts) AS h FROM log_b WHERE severity IS NULL ORDER BY ts DESC, id DESC LIMIT 200), a AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM log_b WHERE severity IS NOT NULL GROUP BY 1)
    SELECT d.id, d.ts, d.kind, d.file, coalesce(a.n, 0) AS interventions FROM d LEFT JOIN a USING (h)""",
)
def decision_log(spark: SparkSession, folder: str) -> DataFrame:
    """The two hundred newest decisions with the interventions of the same hour."""
    rows = b.log(spark, folder)
    hour = F.date_trunc("hour", "ts")
    first = rows.where("severity is null").orderBy(F.desc("ts"), F.desc("id")).limit(200).select("id", "ts", "kind", "file", hour.alias("h"))
    alarms = rows.where("severity is not null").groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return first.join(alarms, "h", "left").select("id", "ts", "kind", "file", F.coalesce("n", F.lit(0)).alias("interventions"))


@CORE.query(
    "repeated_intake",
    """WITH d AS (SELECT DISTINCT * FROM snapshots), m AS (SELECT median(epoch_us(ts)) AS m FROM d), known AS (SELECT DISTINCT repo_name, commit_sha, source FROM d, m WHERE epoch_us(ts) < m AND commit_sha IS NOT NULL),
    fresh AS (SELECT DISTINCT repo_name, commit_sha, source FROM d WHERE commit_sha IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.repo_name = d.repo_name AND k.commit_sha = d.commit_sha AND k.source = d.source))
    SELECT repo_name, source, count(*) AS snapshots FROM (SELECT repo_name, source FROM fresh UNION ALL SELECT repo_name, source FROM d WHERE commit_sha IS NULL) GROUP BY ALL""",
)
def repeated_intake(spark: SparkSession, folder: str) -> DataFrame:
    """What a store that holds the older half of the snapshots takes in of a delivery of all: known commits are left out."""
    rows = table(spark, folder, "snapshots").distinct()
    middle = rows.agg(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).head()[0]
    known = rows.where(F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(middle))
    return t.new_snapshots(known, rows).groupBy("repo_name", "source").agg(F.count(F.lit(1)).alias("snapshots"))
