"""Combined signals per file: weighted scores, ownership, missing tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import base_name
from tessella.operators.structure import leading_value

WEIGHTS = {"blast": 0.30, "churn": 0.25, "cross": 0.20, "interventions": 0.15, "untested": 0.10}


def risk_scores(files: DataFrame, blast: DataFrame, churn: DataFrame, crossing: DataFrame, interventions: DataFrame, untested: DataFrame, limit: int | None = None) -> DataFrame:
    """``id, score`` and its parts: each signal over its maximum, weighted, to three places; signals are tables of ``id`` and one value.

    ``crossing`` and ``untested`` are sets of ids. Files without a signal count 0 for it.
    """
    out = files.select("id")
    for name, table, value in (("blast", blast, "dependents"), ("churn", churn, "commits"), ("interventions", interventions, "n")):
        top = table.agg(F.greatest(F.max(value), F.lit(1)).alias("__m"))
        part = table.join(F.broadcast(top), F.lit(True)).select("id", (F.col(value) / F.col("__m")).alias(name))
        out = out.join(part, "id", "left")
    for name, ids in (("cross", crossing), ("untested", untested)):
        out = out.join(ids.select("id").distinct().withColumn(name, F.lit(1.0)), "id", "left")
    parts = {n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(n, F.lit(0.0)))) for n in WEIGHTS}
    score = sum((parts[n] * w for n, w in WEIGHTS.items()), F.lit(0.0))
    scored = out.select("id", *[F.round(parts[n], 6).alias(n) for n in WEIGHTS], (F.floor(score * 1000 + 0.5) / 1000).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit) if limit else scored


def ownership(blame: DataFrame) -> DataFrame:
    """``file, author, lines, total, share``: who wrote most of each file; the least author wins a tie."""
    return leading_value(blame.groupBy("file", "author").agg(F.sum("lines").alias("lines")), ["file"], "author", "lines")


def cross_owner_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``src, dst, src_owner, dst_owner`` of the edges between files of different owners."""
    a = owners.select(F.col("file").alias("src"), F.col("author").alias("src_owner"))
    b = owners.select(F.col("file").alias("dst"), F.col("author").alias("dst_owner"))
    return edges.join(a, "src").join(b, "dst").where("src_owner <> dst_owner").select("src", "dst", "src_owner", "dst_owner")


def untested(files: DataFrame) -> DataFrame:
    """``id, path`` of source files for which no test file of the same repository carries their stem.

    A test file is ``test_x``, ``x_test``, ``x.test.y``, ``x.spec.y`` or lies below a test folder. Tests themselves, ``index`` files, declarations and files that are no
    source are not asked for.
    """
    base = base_name(F.col("path"))
    is_test = base.rlike(r"^test_|_test\.\w+$|\.(test|spec|stories)\.") | F.col("path").rlike(r"(^|/)(tests?|__tests__|spec)/")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"^test_", ""), r"\..*$", ""), r"_test$", "")
    told = files.where("path is not null").select("id", "repo_name", "path", is_test.alias("t"), stem.alias("stem"), base.alias("base"))
    source = told.where(~F.col("t") & F.col("base").rlike(r"\.(ts|tsx|js|jsx|py|go|rs)$") & ~F.col("base").rlike(r"\.d\.ts$") & (F.col("stem") != "index"))
    tests = told.where("t").select("repo_name", "stem").distinct()
    return source.join(tests, ["repo_name", "stem"], "left_anti").select("id", "path")
