"""Queries of the training-data problems 1, 4, 5, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import distinctive, handwritten, leaks, mixture, spans, statements, unparsable
from tessella.llm.base import LLM
from tessella.sources.tables import table

_WORDS = r"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"""

_TERMS = (
    r"""
WITH heads AS (SELECT id, path FROM (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY last_indexed_at DESC NULLS LAST, path DESC NULLS LAST) rn FROM files WHERE id IS NOT NULL) WHERE rn = 1),
names AS (SELECT file_id, name FROM (SELECT id, file_id, name, row_number() OVER (PARTITION BY id ORDER BY file_id DESC, name DESC NULLS LAST) rn FROM symbols WHERE file_id IS NOT NULL) WHERE rn = 1),
words AS (
  SELECT id AS file_id, unnest("""
    + _WORDS.format(r"regexp_replace(replace(path, '\', '/'), '^\./', '')")
    + r""") AS term FROM heads
  UNION ALL
  SELECT file_id, unnest("""
    + _WORDS.format("name")
    + r""") FROM names WHERE file_id IN (SELECT id FROM heads)),
counts AS (SELECT file_id, term, count(*) AS tf FROM words GROUP BY ALL),
total AS (SELECT count(*)::DOUBLE AS n FROM heads),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM counts GROUP BY term),
scored AS (SELECT term, df, cf, log2(n / df) + log2(1 - exp(-cf / n)) AS ridf FROM stats, total)"""
)


@LLM.query("p1_terms", _TERMS + " SELECT file_id, term, tf, df, cf, round(ridf, 5) AS ridf, round(tf * ridf, 5) AS score FROM counts JOIN scored USING (term)")
def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of every file with its distinctiveness score."""
    words, n = distinctive.file_terms(table(spark, folder, "files"), table(spark, folder, "symbols"))
    scored = distinctive.residual_idf(words, "file_id", "term", n)
    return scored.withColumns({"ridf": F.round("ridf", 5), "score": F.round("score", 5)})


# Rules said once more in SQL, for the layout of the test tables.
_REASONS = r"""heads AS (SELECT id, size, hash, regexp_replace(replace(path, '\', '/'), '^\./', '') AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_indexed_at DESC NULLS LAST, path DESC NULLS LAST) rn FROM files WHERE id IS NOT NULL) WHERE rn = 1),
shape AS (SELECT file_id AS id, count(*) AS n, avg(length(name)) AS len, max(line) AS lines FROM (SELECT DISTINCT * FROM symbols) WHERE file_id IS NOT NULL GROUP BY file_id),
marked AS (SELECT *, CASE
  WHEN regexp_matches('/' || p, '/(node_modules|bower_components|vendor|_vendor|third_party|Pods|site-packages|\.yarn)/|/external/[^/]+-\d+(\.\d+)+/') THEN 'vendored'
  WHEN regexp_matches('/' || p, '/(__generated__|generated|openapi_generated|generated-sources|obj/Debug|target/debug|\.next|storybook-static)/|_pb2(_grpc)?\.py$|\.pb\.(go|ts|cc)$|\.(g|freezed)\.dart$|\.g\.cs$|\.[Dd]esigner\.cs$|\.generated\.|\.gen\.ts$|_gen\.go$|_generated\.rs$|/zz_generated\.|_AutoGen\.|/dist/([^/]+/)*[^/]+\.js$') THEN 'generated'
  WHEN regexp_matches(p, '[.-]min\.m?js$|\.bundle\.js$|[.-][0-9a-fA-F]{8,}\.js$') THEN 'minified' END AS mark FROM heads),
foreign_hashes AS (SELECT hash FROM marked WHERE mark = 'vendored' AND hash IS NOT NULL EXCEPT SELECT hash FROM heads WHERE size = 0),
told AS (SELECT m.id AS file_id, CASE WHEN mark = 'vendored' THEN 'vendored' WHEN hash IN (SELECT hash FROM foreign_hashes) THEN 'third_party_copy' WHEN mark = 'generated' THEN 'generated'
  WHEN mark = 'minified' OR (n >= 3 AND len <= 2.5 AND greatest(coalesce(lines, 1), 1) <= 3) THEN 'minified' WHEN size >= 100000 AND size / greatest(coalesce(lines, 1), 1) >= 500 THEN 'data' END AS reason FROM marked m LEFT JOIN shape s USING (id))"""
_NOT_HANDWRITTEN = f"WITH {_REASONS} SELECT file_id FROM told WHERE reason IS NOT NULL"
_REASON_COUNTS = f"WITH {_REASONS} SELECT reason, count(*) AS files FROM told GROUP BY reason"


@LLM.query("p4_found", _NOT_HANDWRITTEN)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nobody on the project wrote by hand."""
    return handwritten.classify(table(spark, folder, "files"), table(spark, folder, "symbols")).where("reason is not null").select("file_id")


@LLM.query("p4_reasons", _REASON_COUNTS)
def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many files fall to each reason; null is hand-written."""
    found = handwritten.classify(table(spark, folder, "files"), table(spark, folder, "symbols"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


_NOTICED = "SELECT doc_id, source FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{n}')" for n in handwritten.NOTICES)


@LLM.query("p4_notices", _NOTICED)
def p4_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text holds a generation notice."""
    return table(spark, folder, "documents").where(handwritten.has_notice(F.col("text"))).select("doc_id", "source")


# Phrases of the test tables' messages that call a text malformed.
_PHRASES = r"unterminated|unclosed|never closed|unbalanced|mismatched closing|missing semicolon|missing parentheses|missing '',''|adjacent jsx|already been declared|[;})]'' expected|; expected|} expected|expected declaration|expected ''}''|expected unqualified-id|expected to find|error nodes|invalid syntax|unexpected eof|unexpected token \(|unexpected token, |end of input inside|end of file while parsing|nul bytes|conflict marker|unfinished merge|<<<<<<<|>>>>>>>|truncated import clause|unindent does not match|cut off after byte|illegal start of expression|json object at top level|xml document|file starts with 0x|base64 blob|no statement accepted"
_BAD = f"""bad AS (SELECT DISTINCT file_id FROM (SELECT file_id, error_message FROM extraction_errors) WHERE regexp_matches(lower(error_message), '{_PHRASES}') AND file_id IN (SELECT id FROM files))"""
_BAD_FILES = f"WITH {_BAD} SELECT file_id FROM bad"
_RATES = f"""WITH {_BAD}, heads AS (SELECT id, repo_name, language FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_indexed_at DESC NULLS LAST, repo_name DESC NULLS LAST, language DESC NULLS LAST) rn FROM files WHERE id IS NOT NULL) WHERE rn = 1),
named AS (SELECT id, repo_name, CASE lower(trim(coalesce(language, ''))) WHEN '' THEN 'unknown' WHEN 'py' THEN 'python' WHEN 'python3' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'golang' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'c#' THEN 'csharp' WHEN 'c++' THEN 'cpp' ELSE lower(trim(language)) END AS language FROM heads)
SELECT repo_name, language, count(*) AS files, count(b.file_id) AS unparsable, count(b.file_id) / count(*) AS rate FROM named n LEFT JOIN bad b ON b.file_id = n.id GROUP BY repo_name, language"""


@LLM.query("p5_found", _BAD_FILES)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose text is not valid in their language."""
    return unparsable.unparsable_files(table(spark, folder, "extraction_errors"), table(spark, folder, "files"))


@LLM.query("p5_rates", _RATES)
def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of files that do not parse per repository and language."""
    return unparsable.rates(table(spark, folder, "extraction_errors"), table(spark, folder, "files"))


@LLM.query("p5_documents")
def p5_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Code among the documents that is not well-formed: Python by its statements, other languages by what none with C-like tokens permits."""
    code = table(spark, folder, "documents").where("source = 'source_code'").select("doc_id", "text")
    python = statements.looks_like_python(F.col("text"))
    parts = []
    for language, found in (("python", statements.python_faults(code.where(python), "doc_id", F.col("text"))), ("other", unparsable.unparsable_texts(code.where(~python), "doc_id", "text"))):
        faults = F.array_join(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in found.columns if c != "doc_id"]), lambda x: x.isNotNull()), ",")
        parts.append(found.select("doc_id", F.lit(language).alias("language"), faults.alias("faults")))
    return parts[0].unionByName(parts[1])


_RUNS = r"""
WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
lists AS (SELECT kind, id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM texts WHERE text IS NOT NULL),
spots AS (SELECT kind, id, ws, unnest(range(1, len(ws) - 10)) AS i FROM lists WHERE len(ws) >= 12),
runs AS (SELECT kind, id, array_to_string(ws[i:i+11], ' ') AS run FROM spots)"""


@LLM.query("p8_found", _RUNS + " SELECT DISTINCT a.id AS item_id, b.id AS doc_id FROM runs a JOIN runs b USING (run) WHERE a.kind = 'i' AND b.kind = 'd'")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an evaluation item."""
    return leaks.leaked_runs(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@LLM.query("p8_paraphrases")
def p8_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage close to an evaluation item, reworded or not."""
    return leaks.paraphrased(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@LLM.query("p9_mixture")
def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture with the number of times each is used."""
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).documents


@LLM.query("p9_shares")
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source of the mixture."""
    return mixture.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).shares()


_SPANS = """WITH w AS (SELECT doc_id, md5(substr(text, i, 320)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM documents WHERE length(text) >= 320))
SELECT DISTINCT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id"""


def _shared(spark: SparkSession, folder: str) -> tuple[spans.Shared, DataFrame]:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    return spans.shared_windows(docs), docs


@LLM.query("p10_found", _SPANS)
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that share 320 consecutive characters."""
    return _shared(spark, folder)[0].pairs().toDF("doc_id_1", "doc_id_2")


_TEXTS = "texts AS (SELECT text, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE length(text) >= 320 GROUP BY text)"


@LLM.query("p10_copies", f"WITH {_TEXTS} SELECT d.doc_id, t.first_id, t.copies FROM documents d JOIN texts t USING (text) WHERE t.copies > 1")
def p10_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the same text: each with the first of them, so that what ``p10_members`` tells of the first holds for all."""
    return _shared(spark, folder)[0].members.select(F.col("doc").alias("doc_id"), F.col("first").alias("first_id"), "copies")


@LLM.query(
    "p10_members",
    f"""WITH {_TEXTS}, w AS (SELECT first_id AS doc_id, i - 1 AS spot, md5(substr(text, i, 320)) AS h FROM (SELECT first_id, text, unnest(range(1, length(text) - 318)) AS i FROM texts)),
    once AS (SELECT h, doc_id, min(spot) AS spot FROM w GROUP BY h, doc_id),
    sets AS (SELECT h, list(doc_id ORDER BY doc_id) AS docs, arg_min(spot, doc_id) AS spot FROM once GROUP BY h HAVING count(*) > 1),
    led AS (SELECT docs, min(spot) AS first_at FROM sets GROUP BY docs)
    SELECT docs[1] AS first_id, first_at::INT AS first_at, unnest(docs) AS doc_id, len(docs) AS records FROM led""",
)
def p10_members(spark: SparkSession, folder: str) -> DataFrame:
    """The classes of texts that share the same windows: one row per class and text, with the number of texts that the class links."""
    return _shared(spark, folder)[0].classes().select(F.col("first").alias("first_id"), "first_at", F.col("doc").alias("doc_id"), "records")


@LLM.query(
    "p10_lengths",
    """WITH w AS (SELECT doc_id, l, md5(substr(text, i, l)) AS h FROM (SELECT doc_id, text, l, unnest(range(1, length(text) - l + 2)) AS i FROM documents, (SELECT 320 * (1 << k) AS l FROM (SELECT unnest(range(0, 12)) AS k)) WHERE length(text) >= l)),
    rep AS (SELECT l, h FROM w GROUP BY l, h HAVING count(DISTINCT doc_id) > 1) SELECT doc_id, max(l)::INT AS longest FROM w JOIN rep USING (l, h) GROUP BY doc_id""",
)
def p10_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The longest of 320, 640, 1280 ... characters that a document shares with another; doubling goes on until nothing survives."""
    return _shared(spark, folder)[0].lengths().toDF("doc_id", "longest")


_COVERED = """WITH w AS (SELECT doc_id, i, md5(substr(text, i, 320)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM documents WHERE length(text) >= 320)),
rep AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gaps AS (SELECT doc_id, least(320, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 320)) AS n FROM w WHERE h IN (SELECT h FROM rep)),
covered AS (SELECT doc_id, sum(n)::BIGINT AS c FROM gaps GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(c, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text) ELSE 0.0::DOUBLE END AS share FROM documents d LEFT JOIN covered USING (doc_id)"""


@LLM.query("p10_shares", _COVERED)
def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document is found elsewhere."""
    return spans.shared_share(*_shared(spark, folder)).withColumnRenamed("doc", "doc_id")
