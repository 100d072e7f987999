"""Patterns in code bases: co-change, naming, export and directory conventions, absent links, exemplars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import sharing
from tessella.operators.structure import leading_value, top_per_group

#: A list of group names that is compared with itself must stay small; beyond this it is refused.
MOST_DOMAINS = 10_000


#: The naming styles and what a name of each looks like; the first that fits counts.
CASES = (
    ("kebab-case", r"^[a-z0-9]+(-[a-z0-9]+)+$"),
    ("snake_case", r"^[a-z0-9]+(_[a-z0-9]+)+$"),
    ("PascalCase", r"^(?=.*[a-z])[A-Z][a-zA-Z0-9]*$"),
    ("camelCase", r"^(?=.*[A-Z])[a-z][a-zA-Z0-9]*$"),
)


def name_case(name: Column) -> Column:
    """kebab, snake, Pascal or camel; null where the name is of none, of one lower-case word or of capitals only."""
    return F.coalesce(*[F.when(name.rlike(pattern), style) for style, pattern in CASES])


def co_change(commit_files: DataFrame, least: int = 2) -> DataFrame:
    """``a, b, together, of_a, of_b, confidence``: files changed in the same commits at least ``least`` times, a < b.

    A commit of many files is salted, so that no task meets all its pairs. ``confidence`` is the greater share of the commits of either file.
    """
    once = commit_files.select("sha", "file").distinct()
    size = once.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    met = sharing(once.select(F.col("file").alias("id"), F.col("sha").alias("dst")), once.select(F.col("file").alias("other"), F.col("sha").alias("dst")), once=True)
    pairs = met.where(F.col("shared") >= least).select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("shared").alias("together"))
    out = pairs.join(size.select(F.col("file").alias("a"), F.col("n").alias("of_a")), "a").join(size.select(F.col("file").alias("b"), F.col("n").alias("of_b")), "b")
    return out.select("a", "b", "together", "of_a", "of_b", (F.col("together") / F.least("of_a", "of_b")).alias("confidence"))


def action_patterns(pairs: DataFrame, confidence: float = 0.6, partners: int = 10, least: int = 3, limit: int = 50) -> DataFrame:
    """``anchor, partner, together, confidence``: both directions of :func:`co_change`, for anchors of ``least`` commits the best ``partners`` of each, and of those the ``limit`` seen together most."""
    ways = [pairs.select(F.col(x).alias("anchor"), F.col(y).alias("partner"), "together", (F.col("together") / F.col(f"of_{x}")).alias("confidence"), F.col(f"of_{x}").alias("n")) for x, y in (("a", "b"), ("b", "a"))]
    held = ways[0].unionByName(ways[1]).where((F.col("confidence") >= confidence) & (F.col("n") >= least)).drop("n")
    best = top_per_group(held, ["anchor"], [F.desc("confidence"), F.desc("together"), F.col("partner")], partners)
    return best.orderBy(F.desc("together"), F.desc("confidence"), "anchor", "partner").limit(limit)


def convention(df: DataFrame, group: list[str], value: str, least: int = 4, share: float = 0.75) -> DataFrame:
    """``group, value, n, total, share`` where the leading value of a group has the share; groups of fewer than ``least`` are left out. Null values do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return leading_value(counts, group, value).where((F.col("total") >= least) & (F.col("share") >= share))


def absent_links(edges: DataFrame, files: DataFrame, least: int = 5) -> DataFrame:
    """``domain, missing``: pairs of domains of at least ``least`` files between which, in this direction, no edge leads.

    Per domain the list of all large domains less those it reaches; the list is checked to be small.
    """
    sizes = files.where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("domain")
    names = [r[0] for r in sizes.limit(MOST_DOMAINS + 1).collect()]
    if len(names) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    every = F.array(*[F.lit(n) for n in sorted(names)]) if names else F.array().cast("array<string>")
    owner = files.where("domain is not null").select("id", "domain")
    reached = (
        edges.join(owner.select(F.col("id").alias("src"), F.col("domain")), "src").join(owner.select(F.col("id").alias("dst"), F.col("domain").alias("other")), "dst").select("domain", "other").distinct().groupBy("domain").agg(F.collect_set("other").alias("others"))
    )
    open_ = sizes.join(reached, "domain", "left").select("domain", F.array_except(F.array_remove(every, F.col("domain")), F.coalesce("others", F.array().cast("array<string>"))).alias("m"))
    return open_.select("domain", F.explode("m").alias("missing"))


def export_histogram(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``domain, exports, files, share``: how many files of a domain export so many symbols."""
    owner = files.where("domain is not null").select(F.col("id").alias("file_id"), "domain")
    per_file = symbols.where("exported").groupBy("file_id").agg(F.count(F.lit(1)).alias("exports")).join(owner, "file_id")
    counts = per_file.groupBy("domain", "exports").agg(F.count(F.lit(1)).alias("files"))
    totals = counts.groupBy("domain").agg(F.sum("files").alias("t"))
    return counts.join(totals, "domain").select("domain", "exports", "files", (F.col("files") / F.col("t")).alias("share"))


def export_style(symbols: DataFrame, files: DataFrame, least: int = 5, share: float = 0.75) -> DataFrame:
    """``domain, defaults, exports, style``: default or named where one of them has the share."""
    owner = files.where("domain is not null").select(F.col("id").alias("file_id"), "domain")
    per_file = symbols.where("exported").groupBy("file_id").agg(F.sum(F.col("is_default").cast("int")).alias("d"), F.count(F.lit(1)).alias("n"))
    out = per_file.join(owner, "file_id").groupBy("domain").agg(F.sum("d").alias("defaults"), F.sum("n").alias("exports")).where(F.col("exports") >= least)
    part = F.col("defaults") / F.col("exports")
    return out.withColumn("style", F.when(part >= share, "default").when(1 - part >= share, "named")).where("style is not null")


def exemplars(files: DataFrame, counts: DataFrame, fan: DataFrame, n: int = 1, avoid: str = r"(?i)/(demos?|examples?|fixtures?|samples?|mocks?|__tests__|__mocks__|tests?|stories)/") -> DataFrame:
    """``domain, path, count, fan_in, score``: the files of a domain that show a pattern best, ``count * ln(fan_in + 1)``."""
    rows = files.where("domain is not null").where(~F.col("path").rlike(avoid)).join(counts, "id").join(fan.where("fan_in > 0").select("id", "fan_in"), "id")
    scored = rows.withColumn("score", F.round(F.col("count") * F.log(F.col("fan_in") + 1.0), 6))
    return top_per_group(scored.select("domain", "path", "count", "fan_in", "score", "id"), ["domain"], [F.desc("score"), F.desc("count"), F.desc("fan_in"), F.col("path"), F.col("id")], n).drop("id")
