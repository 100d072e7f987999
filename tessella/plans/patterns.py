"""Queries of mining, log and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.words import identifier_words
from tessella.operators import graph as g
from tessella.operators import journal as j
from tessella.operators import mining as m
from tessella.operators import retrieval as r
from tessella.operators import structure as s
from tessella.plans.registry import CORE
from tessella.sources import bindings as b
from tessella.sources.tables import table

_CO = f"""{b.COMMITS_SQL}, size AS (SELECT file, count(*) AS n FROM commit_files_b GROUP BY file),
pairs AS (SELECT x.file AS a, y.file AS b, count(*) AS together FROM commit_files_b x JOIN commit_files_b y USING (sha) WHERE x.file < y.file GROUP BY ALL HAVING count(*) >= 2),
co AS (SELECT p.a, p.b, p.together, u.n AS of_a, v.n AS of_b, p.together / least(u.n, v.n) AS confidence FROM pairs p JOIN size u ON u.file = p.a JOIN size v ON v.file = p.b)"""


@CORE.query("co_change", f"WITH {_CO} SELECT * FROM co")
def co_change(spark: SparkSession, folder: str) -> DataFrame:
    """Files changed together in at least two commits."""
    return m.co_change(b.commit_files(spark, folder))


@CORE.query(
    "action_patterns",
    f"""WITH {_CO}, ways AS (SELECT a AS anchor, b AS partner, together, together / of_a AS confidence, of_a AS n FROM co UNION ALL SELECT b, a, together, together / of_b, of_b FROM co)
    SELECT anchor, partner, together, confidence FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY confidence DESC, together DESC, partner) rn FROM ways WHERE confidence >= 0.05 AND n >= 3) WHERE rn <= 10 ORDER BY together DESC, confidence DESC, anchor, partner LIMIT 50""",
)
def action_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """For each file its best partners in commits."""
    return m.action_patterns(m.co_change(b.commit_files(spark, folder)), confidence=0.05)


_CASE = """CASE WHEN regexp_full_match({0}, '[a-z0-9]+(-[a-z0-9]+)+') THEN 'kebab-case' WHEN regexp_full_match({0}, '[a-z0-9]+(_[a-z0-9]+)+') THEN 'snake_case'
  WHEN regexp_full_match({0}, '[A-Z][a-zA-Z0-9]*') AND regexp_matches({0}, '[a-z]') THEN 'PascalCase' WHEN regexp_full_match({0}, '[a-z][a-zA-Z0-9]*') AND regexp_matches({0}, '[A-Z]') THEN 'camelCase' END"""


@CORE.query(
    "case_conventions",
    f"""WITH {b.FILES_SQL}, {b.SYMBOLS_SQL}, cased AS (SELECT f.repo_name, f.lang, {_CASE.format('s.name')} AS style FROM symbols_b s JOIN files_b f ON f.id = s.file_id),
    counts AS (SELECT repo_name, lang, style, count(*) AS n FROM cased WHERE style IS NOT NULL GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY repo_name, lang ORDER BY n DESC, style) r, sum(n) OVER (PARTITION BY repo_name, lang)::BIGINT AS total FROM counts)
    SELECT repo_name, lang, style, n, total, n / total AS share FROM best WHERE r = 1 AND total >= 4 AND n / total >= 0.5""",
)
def case_conventions(spark: SparkSession, folder: str) -> DataFrame:
    """The leading naming style of each repository and language."""
    owner = b.files(spark, folder).select(F.col("id").alias("file_id"), "repo_name", F.coalesce("lang", F.lit("")).alias("lang"))
    rows = b.symbols(spark, folder).join(owner, "file_id").withColumn("style", m.name_case(F.col("name")))
    return m.convention(rows, ["repo_name", "lang"], "style", share=0.5).withColumn("lang", F.when(F.col("lang") != "", F.col("lang")))


@CORE.query(
    "directory_language",
    f"""WITH {b.FILES_SQL}, counts AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir, lang, count(*) AS n FROM files_b WHERE lang IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, lang) r, sum(n) OVER (PARTITION BY dir)::BIGINT AS total FROM counts)
    SELECT dir, lang, n, total, n / total AS share FROM best WHERE r = 1 AND total >= 5 AND n / total >= 0.25""",
)
def directory_language(spark: SparkSession, folder: str) -> DataFrame:
    """The leading language of each top folder."""
    rows = b.files(spark, folder).where("path is not null").withColumn("dir", F.array_join(F.slice(F.split("path", "/"), 1, 2), "/"))
    rows = rows.withColumn("dir", F.when(F.col("path").contains("/"), F.col("dir")).otherwise(F.concat("path", F.lit("/"))))
    return m.convention(rows, ["dir"], "lang", least=5, share=0.25)


@CORE.query(
    "no_import_invariants",
    f"""WITH {b.EDGES_SQL}, placed AS (SELECT id, repo_name || '/' || domain AS domain FROM files_b), big AS (SELECT domain FROM placed WHERE domain IS NOT NULL GROUP BY domain HAVING count(*) >= 5),
    linked AS (SELECT DISTINCT x.domain AS a, y.domain AS z FROM edges_b e JOIN placed x ON x.id = e.src JOIN placed y ON y.id = e.dst WHERE x.domain IS NOT NULL AND y.domain IS NOT NULL)
    SELECT p.domain, q.domain AS missing FROM big p JOIN big q ON p.domain <> q.domain WHERE (p.domain, q.domain) NOT IN (SELECT (a, z) FROM linked)""",
)
def no_import_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of large domains, each of one repository, between which no import leads."""
    placed = b.files(spark, folder).withColumn("domain", F.concat("repo_name", F.lit("/"), "domain"))
    return m.absent_links(b.edges(spark, folder), placed)


@CORE.query(
    "export_histogram",
    f"""WITH {b.FILES_SQL}, {b.SYMBOLS_SQL}, per AS (SELECT file_id, count(*) AS exports FROM symbols_b WHERE exported GROUP BY file_id)
    SELECT f.domain, p.exports, count(*) AS files, count(*) / sum(count(*)) OVER (PARTITION BY f.domain) AS share FROM per p JOIN files_b f ON f.id = p.file_id WHERE f.domain IS NOT NULL GROUP BY f.domain, p.exports""",
)
def export_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How many symbols the files of a domain export."""
    return m.export_histogram(b.symbols(spark, folder), b.files(spark, folder))


@CORE.query(
    "export_style",
    f"""WITH {b.FILES_SQL}, {b.SYMBOLS_SQL}, d AS (SELECT f.domain, sum(CASE WHEN s.is_default THEN 1 ELSE 0 END)::BIGINT AS defaults, count(*) AS exports FROM symbols_b s JOIN files_b f ON f.id = s.file_id WHERE s.exported AND f.domain IS NOT NULL GROUP BY f.domain)
    SELECT *, CASE WHEN defaults / exports >= 0.75 THEN 'default' ELSE 'named' END AS style FROM d WHERE exports >= 5 AND (defaults / exports >= 0.75 OR 1 - defaults / exports >= 0.75)""",
)
def export_style(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a domain exports by default or by name."""
    return m.export_style(b.symbols(spark, folder), b.files(spark, folder))


@CORE.query(
    "canonical_exemplar",
    f"""WITH {b.EDGES_SQL}, {b.MODELS_SQL}, fan AS (SELECT dst AS id, count(*) AS fan_in FROM edges_b GROUP BY dst), cnt AS (SELECT file_id AS id, count(*) AS count FROM models_b WHERE file_id IS NOT NULL GROUP BY file_id),
    scored AS (SELECT f.domain, f.path, c.count, fan.fan_in, round(c.count * ln(fan.fan_in + 1.0), 6) AS score, f.id FROM files_b f JOIN cnt c USING (id) JOIN fan USING (id) WHERE f.domain IS NOT NULL AND NOT regexp_matches(f.path, '(?i)/(demos?|examples?|fixtures?|samples?|mocks?|__tests__|__mocks__|tests?|stories)/'))
    SELECT domain, path, count, fan_in, score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, count DESC, fan_in DESC, path, id) r FROM scored) WHERE r = 1""",
)
def canonical_exemplar(spark: SparkSession, folder: str) -> DataFrame:
    """The file of each domain that shows model definitions best."""
    counts = b.models(spark, folder).where("file_id is not null").groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("count"))
    return m.exemplars(b.files(spark, folder), counts, g.degrees(b.edges(spark, folder)))


@CORE.query("log_sessions", f"WITH {b.LOG_SQL} SELECT session_id, min(ts) AS started_at, max(ts) AS ended_at, count(CASE WHEN severity IS NULL THEN 1 END) AS decisions, count(severity) AS interventions FROM log_b GROUP BY session_id")
def log_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the log."""
    return j.sessions(b.log(spark, folder))


@CORE.query("recent_decisions", f"WITH {b.LOG_SQL} SELECT id, ts, session_id, kind, file FROM log_b WHERE ts >= TIMESTAMP '2024-01-03' AND severity IS NULL")
def recent_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions from a point in time on."""
    return j.recent(b.log(spark, folder).where("severity is null"), F.lit("2024-01-03").cast("timestamp_ntz")).select("id", "ts", "session_id", "kind", "file")


@CORE.query("search_decisions", f"WITH {b.LOG_SQL} SELECT id, ts, kind, file FROM log_b WHERE contains(lower(kind), 'p7') OR contains(lower(coalesce(file, '')), 'p7') OR contains(lower(coalesce(payload, '')), 'p7') ORDER BY ts DESC, id DESC LIMIT 100")
def search_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred newest log rows that hold a text."""
    return j.search(b.log(spark, folder), "P7").select("id", "ts", "kind", "file")


@CORE.query("session_replay", f"WITH {b.LOG_SQL} SELECT session_id, id, row_number() OVER w AS step, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000) AS BIGINT) AS gap_s FROM log_b WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)")
def session_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Each session's rows in order with the gaps between them."""
    return j.replay(b.log(spark, folder))


@CORE.query("session_conflicts", f"WITH {b.LOG_SQL} SELECT time_bucket(INTERVAL 30 MINUTES, ts, TIMESTAMP '1970-01-01') AS start, file, count(DISTINCT session_id) AS sessions, max(ts) AS last_ts FROM log_b WHERE file IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT session_id) >= 2")
def session_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Files that several sessions touched within the same half hour."""
    return j.conflicts(b.log(spark, folder))


@CORE.query("client_attribution", f"WITH {b.LOG_SQL} SELECT kind, count(*) AS rows, count(DISTINCT session_id) AS sessions, count(CASE WHEN severity IS NOT NULL AND accepted IS NULL THEN 1 END) AS unanswered FROM log_b GROUP BY kind")
def client_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, sessions and unanswered interventions per kind."""
    return j.attribution(b.log(spark, folder))


@CORE.query("intervention_files", f"WITH {b.LOG_SQL} SELECT file, count(*) AS n FROM log_b WHERE severity = 'HIGH' GROUP BY file")
def intervention_files(spark: SparkSession, folder: str) -> DataFrame:
    """Grave interventions per file."""
    return j.interventions_by_file(b.log(spark, folder))


@CORE.query("latest_per_file", f"WITH {b.LOG_SQL} SELECT file, id, ts, kind FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, id DESC) r FROM log_b WHERE file IS NOT NULL) WHERE r = 1")
def latest_per_file(spark: SparkSession, folder: str) -> DataFrame:
    """The newest log row of each file."""
    return j.latest_per_file(b.log(spark, folder))


@CORE.query("severity_counts", f"WITH {b.LOG_SQL} SELECT severity, kind, count(*) AS n FROM log_b WHERE severity IS NOT NULL GROUP BY CUBE (severity, kind)")
def severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Interventions by severity and kind with subtotals."""
    return j.severity_counts(b.log(spark, folder))


_WORDS = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"
_POST = f"""docs_b AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
post AS (SELECT doc_id, token, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(w) AS size, unnest(w) AS token FROM docs_b) GROUP BY doc_id, token)"""


def _posted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs, r.postings(docs, "doc_id", identifier_words(F.col("text")))


@CORE.query("idf", f"WITH {_POST}, n AS (SELECT count(*) AS n FROM docs_b) SELECT token, count(*) AS df, round(ln((n + 1.0) / (count(*) + 1)) + 1, 6) AS idf FROM post, n GROUP BY token, n")
def idf(spark: SparkSession, folder: str) -> DataFrame:
    """Inverse document frequency of all words of the documents."""
    docs, posted = _posted(spark, folder)
    return r.idf(posted, docs.count()).withColumn("idf", F.round("idf", 6))


_BM = f"""{_POST}, stat AS (SELECT count(*) AS n, avg(len(w)) AS average FROM docs_b), q AS (SELECT unnest(['retry', 'cache', 'legacy', 'token']) AS token),
freq AS (SELECT token, count(*) AS df FROM post WHERE token IN (SELECT token FROM q) GROUP BY token),
bm AS (SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))), 6) AS score FROM post JOIN freq USING (token), stat GROUP BY doc_id)"""


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return r.search(docs, "doc_id", identifier_words(F.col("text")), ["retry", "cache", "legacy", "token"])


@CORE.query("bm25", f"WITH {_BM} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 30")
def bm25(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty best documents for a question."""
    return _ranked(spark, folder)


_FUSE = f"""{_BM}, a AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 30), z AS (SELECT doc_id, n_chars AS score FROM documents WHERE title LIKE '%retry%' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 30),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC NULLS LAST, doc_id) FROM z),
fused AS (SELECT doc_id, round(sum(1 / (60 + rank)), 9) AS score, count(*) AS channels FROM ranks GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 30)"""


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    titled = table(spark, folder, "documents").where(F.col("title").contains("retry")).select("doc_id", F.col("n_chars").cast("double").alias("score")).orderBy(F.desc_nulls_last("score"), "doc_id").limit(30)
    return r.fuse([_ranked(spark, folder), titled], "doc_id")


@CORE.query("rrf_fuse", f"WITH {_FUSE} SELECT doc_id, score, channels FROM fused")
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Two ranked lists fused by reciprocal ranks."""
    return _fused(spark, folder)


@CORE.query(
    "token_budget_pack",
    f"""WITH RECURSIVE {_FUSE}, line AS (SELECT row_number() OVER (ORDER BY f.score DESC, f.doc_id) AS rank, f.doc_id, least(CAST(ceil(coalesce(d.n_chars, 0) / 4) AS BIGINT), 4096) AS cost FROM fused f JOIN documents d USING (doc_id)),
    fold AS (SELECT 0::BIGINT AS rank, NULL::BIGINT AS doc_id, 0::BIGINT AS spent, 0::BIGINT AS used, 'start' AS mode
      UNION ALL SELECT l.rank, l.doc_id, CASE WHEN f.spent + l.cost <= 4000 THEN f.spent + l.cost WHEN f.spent + 200 <= 4000 THEN f.spent + 200 ELSE f.spent END,
        CASE WHEN f.spent + l.cost <= 4000 THEN l.cost WHEN f.spent + 200 <= 4000 THEN 200 END, CASE WHEN f.spent + l.cost <= 4000 THEN 'full' WHEN f.spent + 200 <= 4000 THEN 'summary' ELSE 'skip' END
      FROM fold f JOIN line l ON l.rank = f.rank + 1)
    SELECT doc_id, rank, used, mode FROM fold WHERE mode IN ('full', 'summary')""",
)
def token_budget_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The fused list packed under a budget of tokens."""
    from pyspark.sql import Window

    ranked = _fused(spark, folder).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    sized = ranked.join(table(spark, folder, "documents").select("doc_id", r.token_estimate(F.col("n_chars")).alias("cost")), "doc_id")
    return r.pack(sized, "doc_id", "cost", 4000)


@CORE.query(
    "cosine_topk",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), pairs AS (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(q.v, e.v) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query, rank, vec_id FROM (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10""",
)
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every twentieth vector, against all."""
    rows = table(spark, folder, "embeddings")
    return r.nearest(rows, "vec_id", "embedding", rows.where("vec_id % 20 = 0"))


@CORE.query(
    "file_search",
    f"""WITH {b.FILES_SQL}, {b.SYMBOLS_SQL}, own AS (SELECT id, {_WORDS.format("path")} AS w FROM files_b WHERE path IS NOT NULL UNION ALL SELECT file_id, {_WORDS.format("name")} FROM symbols_b WHERE exported AND file_id IN (SELECT id FROM files_b WHERE path IS NOT NULL)),
    docs_b AS (SELECT id, sum(len(w)) AS size FROM own GROUP BY id), stat AS (SELECT count(*) AS n, avg(size) AS average FROM docs_b), words_b AS (SELECT id, unnest(w) AS token FROM own),
    post AS (SELECT id, token, count(*) AS tf FROM words_b WHERE token IN ('invoice', 'refund', 'webhook') GROUP BY ALL), freq AS (SELECT token, count(*) AS df FROM post GROUP BY token)
    SELECT id, path, score FROM (SELECT p.id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))), 6) AS score FROM post p JOIN freq USING (token) JOIN docs_b USING (id), stat GROUP BY p.id ORDER BY score DESC, id LIMIT 30) JOIN files_b USING (id)""",
)
def file_search(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty best files for a question, by the words of their paths and exported symbols."""
    files = b.files(spark, folder).where("path is not null")
    named = b.symbols(spark, folder).where("exported and file_id is not null and name is not null").groupBy(F.col("file_id").alias("id")).agg(F.flatten(F.collect_list(identifier_words(F.col("name")))).alias("names"))
    docs = files.select("id", "path").join(named, "id", "left")
    words = F.concat(identifier_words(F.col("path")), F.coalesce("names", F.array().cast("array<string>")))
    return r.search(docs, "id", words, ["invoice", "refund", "webhook"]).join(files.select("id", "path"), "id").select("id", "path", "score")
