"""What a diff touches: blast radius, new links between domains, renames and moves."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import reach, reach_each
from tessella.sources.extract import resolve_imports
from tessella.sources.formats import added_imports


def diff_summary(diff: DataFrame) -> DataFrame:
    """``path, kind, added, removed`` per file of a parsed diff."""
    return diff.groupBy("path", "kind").agg(F.count(F.when(F.col("side") == "+", 1)).alias("added"), F.count(F.when(F.col("side") == "-", 1)).alias("removed"))


def diff_reach(diff: DataFrame, files: DataFrame, edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """``id, hop`` of everything that depends on the changed files; added and unknown files reach nothing."""
    seeds = files.join(diff.where("kind <> 'add'").select("path").distinct(), "path", "left_semi").select("id")
    return reach(edges, seeds, max_hops)


def new_domain_links(diff: DataFrame, files: DataFrame, edges: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``path, target, from_domain, to_domain`` of imports the diff adds to a file of another domain that it did not use before; deleted files add none.

    Targets are resolved like imports of source trees, from the importing file's folder and ``aliases``.
    """
    known = files.where("domain is not null").select("id", "path", "domain")
    added = added_imports(diff.where("kind <> 'delete'")).select(F.col("path").alias("file"), "target")
    meant = resolve_imports(added, files.select("path"), aliases).where("resolved is not null").select(F.col("file").alias("path"), F.col("resolved").alias("to_path")).distinct()
    into = meant.join(known.select(F.col("path").alias("to_path"), F.col("id").alias("to_id"), F.col("domain").alias("to_domain")), "to_path")
    own = into.join(known.select("path", F.col("id").alias("from_id"), F.col("domain").alias("from_domain")), "path").where("from_domain <> to_domain")
    return own.join(edges.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id")), ["from_id", "to_id"], "left_anti").select("path", F.col("to_path").alias("target"), "from_domain", "to_domain")


#: Domains that no other may newly depend on without a closer look; ranks of severity.
SENSITIVE = ("AUTH", "PAYMENTS", "PAYMENT", "BILLING", "SECURITY")
RANKS = ("SAFE", "LOW", "MEDIUM", "HIGH")


def rank(level: Column) -> Column:
    """0 to 3 for SAFE, LOW, MEDIUM and HIGH; 0 for anything else."""
    return F.greatest(F.array_position(F.array(*[F.lit(r) for r in RANKS]), level) - 1, F.lit(0))


def violations(diff: DataFrame, files: DataFrame, edges: DataFrame, high: int = 50, medium: int = 20, aliases: dict[str, str] | None = None) -> DataFrame:
    """``kind, severity, path, detail, suggestion`` of what a diff does that wants a look.

    ``high_blast``: a changed file with more than ``medium`` dependents within five hops (HIGH from more than ``high``; a medium one with more than 50 added lines should be split); ``cross_domain``: a
    new import of another domain, HIGH and better through an interface if either side is sensitive, else MEDIUM. Added files have no dependents.
    """
    touched = diff.where("kind not in ('add', 'delete')").select("path").distinct().join(files.select("id", "path"), "path")
    sizes = reach_each(edges, touched.select("id")).groupBy(F.col("seed").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > medium)
    lines = diff.where("side = '+'").groupBy("path").agg(F.count(F.lit(1)).alias("added"))
    wide = touched.join(sizes, "id").join(lines, "path", "left")
    big = F.col("n") > high
    split = ~big & (F.coalesce("added", F.lit(0)) > 50)
    blast = wide.select(F.lit("high_blast").alias("kind"), F.when(big, "HIGH").otherwise("MEDIUM").alias("severity"), "path", F.col("n").cast("string").alias("detail"), F.when(split, "split_file").alias("suggestion"))
    links = new_domain_links(diff, files, edges, aliases)
    grave = F.col("from_domain").isin(*SENSITIVE) | F.col("to_domain").isin(*SENSITIVE)
    crossing = links.select(F.lit("cross_domain").alias("kind"), F.when(grave, "HIGH").otherwise("MEDIUM").alias("severity"), "path", F.col("target").alias("detail"), F.when(grave, "add_interface").alias("suggestion"))
    return blast.unionByName(crossing)


def verdict(diff: DataFrame, files: DataFrame, edges: DataFrame, found: DataFrame, gaps: DataFrame | None = None, safe: int = 5) -> DataFrame:
    """One row ``risk, files, dependents, violations``: the gravest violation, else SAFE below ``safe`` dependents in all and LOW from there on.

    ``gaps`` (``path, severity``): open findings; a HIGH one on a touched file makes the risk HIGH, a MEDIUM one at least MEDIUM.
    """
    touched = diff.select("path").distinct()
    union = diff_reach(diff, files, edges).agg(F.count(F.lit(1)).alias("dependents"))
    worst = found.agg(F.max(rank(F.col("severity"))).alias("worst"), F.count(F.lit(1)).alias("violations"))
    open_ = gaps.join(touched, "path", "left_semi").agg(F.max(F.when(F.col("severity").isin("HIGH", "MEDIUM"), rank(F.col("severity")))).alias("gap")) if gaps is not None else found.agg(F.lit(None).cast("long").alias("gap"))
    row = touched.agg(F.count(F.lit(1)).alias("files")).join(F.broadcast(union), F.lit(True)).join(F.broadcast(worst), F.lit(True)).join(F.broadcast(open_), F.lit(True))
    base = F.when(F.coalesce("worst", F.lit(0)) > 0, F.col("worst")).when(F.col("dependents") < safe, 0).otherwise(1)
    level = F.greatest(base, F.coalesce("gap", F.lit(0)))
    return row.select(F.element_at(F.array(*[F.lit(r) for r in RANKS]), (level + 1).cast("int")).alias("risk"), "files", "dependents", "violations")


def should_block(risk: Column, threshold: str = "HIGH") -> Column:
    """Whether a gate stops a change of this risk; an unknown or null risk passes."""
    return F.coalesce(risk.isin(*RANKS) & (rank(risk) >= F.lit(RANKS.index(threshold))), F.lit(False))


def log_entries(text: str, found: DataFrame, session_id: str) -> DataFrame:
    """``session_id, kind, severity, file, payload``: one decision for a validated diff, told by sixteen digits of its digest, and one intervention for each violation."""
    spark = found.sparkSession
    key = hashlib.sha256(text.encode()).hexdigest()[:16]
    head = spark.createDataFrame([(session_id, "validate_diff", None, None, key)], "session_id string, kind string, severity string, file string, payload string")
    return head.unionByName(found.select(F.lit(session_id).alias("session_id"), "kind", "severity", F.col("path").alias("file"), F.concat_ws(" ", F.lit(key), "detail").alias("payload")))


_DECLARED = r"\b(?:function|class|def|fn|func|interface|struct|type|const)\s+(\w+)"


def semantic_changes(diff: DataFrame) -> DataFrame:
    """``change, old, new, path``: renamed (a declaration whose line only differs in its name), moved (a declaration that left one file for another), files added and deleted."""
    named = diff.where("side in ('+', '-')").select("path", "side", F.regexp_extract("content", _DECLARED, 1).alias("name"), F.trim("content").alias("text")).where("name <> ''")
    masked = named.withColumn("mask", F.expr("replace(text, name, '\u0001')"))
    gone = masked.where("side = '-'").select("path", F.col("name").alias("old"), "mask", "text")
    come = masked.where("side = '+'").select(F.col("path").alias("to_path"), F.col("name").alias("new"), F.col("mask").alias("m"), F.col("text").alias("t"))
    renamed = gone.join(come, (F.col("path") == F.col("to_path")) & (F.col("mask") == F.col("m")) & (F.col("old") != F.col("new"))).select(F.lit("renamed").alias("change"), "old", "new", "path")
    moved = gone.join(come, (F.col("text") == F.col("t")) & (F.col("path") != F.col("to_path"))).select(F.lit("moved").alias("change"), F.col("path").alias("old"), F.col("to_path").alias("new"), F.col("path"))
    whole = diff.where("kind in ('add', 'delete', 'rename')").select(F.concat(F.lit("file "), F.col("kind")).alias("change"), F.col("old_path").alias("old"), F.col("path").alias("new"), "path")
    return renamed.unionByName(moved).unionByName(whole).distinct()


def new_prefixes(diff: DataFrame, files: DataFrame) -> DataFrame:
    """``prefix`` of added files: the first two path segments that no known file has."""
    two = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, 2), "/").alias("prefix")
    return diff.where("kind = 'add'").select(two(F.col("path"))).distinct().join(files.where("path is not null").select(two(F.col("path"))).distinct(), "prefix", "left_anti")
