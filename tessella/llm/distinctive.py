"""How distinctive a term is per record: residual inverse document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import clean_path
from tessella.functions.words import identifier_words
from tessella.operators.rows import latest
from tessella.operators.skew import look_up, present_in
from tessella.storage import materialize


def residual_idf(terms: DataFrame, record: str, term: str, records: int | None = None) -> DataFrame:
    """``record, term, tf, df, cf, ridf, score`` for every term of every record.

    ``terms`` has one row per occurrence, or an occurrence count in ``n``. With N records, document frequency df and collection
    frequency cf, the observed ``log2(N/df)`` less what a Poisson spread of the cf occurrences would give,
    ``-log2(1 - exp(-cf/N))``, is ``ridf``; ``score = tf * ridf``. ``records`` sets N where some records have no term. Null records or
    terms are left out; an empty table gives an empty one; further columns are ignored.
    A term found in a third of all records costs no task more than another (see :func:`look_up`).
    """
    weight = F.sum("n") if "n" in terms.columns and "n" not in (record, term) else F.count(F.lit(1))
    # The counts are needed for the statistics and for the scores; texts are split into words once.
    counts = terms.where(F.col(record).isNotNull() & F.col(term).isNotNull()).groupBy(F.col(record).alias("record"), F.col(term).alias("term")).agg(weight.alias("tf"))
    counts = materialize(counts, "term-counts")
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    n = records if records is not None else counts.select("record").distinct().count()
    n = float(max(n, 1))
    expected = -F.log2(1 - F.exp(-F.col("cf") / n))
    scored = stats.withColumn("ridf", F.log2(F.lit(n) / F.col("df")) - expected)
    return look_up(counts, "term", materialize(scored, "term-scores"), "df").select(
        F.col("record").alias(record), F.col("term").alias(term), "tf", "df", "cf", "ridf", (F.col("tf") * F.col("ridf")).alias("score")
    )


def file_terms(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, int]:
    """(``file_id, term, n`` per file and source, number of files): words of a file's cleaned path and of its symbols.

    Of a file delivered more than once the row with the latest ``last_indexed_at`` holds; a symbol id is read once;
    symbols of files that do not exist are left out.
    """
    heads = latest(files.where(F.col("id").isNotNull()).select("id", "path", "last_indexed_at"), ["id"], ["last_indexed_at"])
    # Repeats are exact: a distinct over the plain columns hashes, where the choice of a latest row would sort.
    names = present_in(symbols.select("id", "file_id", "name"), "file_id", files, "id").distinct()
    owned = names.groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("k"))
    words = heads.select(F.col("id").alias("file_id"), F.explode(identifier_words(clean_path(F.col("path")))).alias("term"), F.lit(1).cast("long").alias("k")).unionByName(
        owned.select("file_id", F.explode(identifier_words(F.col("name"))).alias("term"), "k")
    )
    return words.groupBy("file_id", "term").agg(F.sum("k").alias("n")), files.where(F.col("id").isNotNull()).select("id").distinct().count()
