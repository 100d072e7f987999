"""What wants attention: conventions of a code base, working memory, suggestions, checklists and digests. ``now`` is always an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import base_name
from tessella.operators.mining import convention, name_case

#: From which share on a convention is strong.
STRONG = 0.9


def folder(path: Column) -> Column:
    """The folder of a path, ``.`` at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def _told(df: DataFrame, kind: str, scope: Column, rule: Column, ext: Column | None = None) -> DataFrame:
    strength = F.when(F.col("share") >= STRONG, "high").otherwise("medium")
    return df.select(F.lit(kind).alias("kind"), scope.alias("scope"), (ext if ext is not None else F.lit(None).cast("string")).alias("ext"), rule.alias("rule"), F.round("share", 2).alias("confidence"), strength.alias("strength"), F.col("n").alias("evidence"))


def naming_cases(files: DataFrame, least: int = 4, share: float = 0.75) -> DataFrame:
    """The naming style of each folder and extension, from the names that show one."""
    base = base_name(F.col("path"))
    rows = files.where("path is not null").select(folder(F.col("path")).alias("dir"), F.regexp_extract(base, r"(\.[^.]+)$", 1).alias("ext"), name_case(F.regexp_replace(base, r"\.[^.]*$", "")).alias("style"))
    return _told(convention(rows, ["dir", "ext"], "style", least, share), "naming_case", F.col("dir"), F.col("style"), F.col("ext"))


def filename_suffixes(files: DataFrame, least: int = 4, share: float = 0.75) -> DataFrame:
    """The last but one part of dotted names (``x.service.ts``) where it has the share of all files of its folder."""
    rows = files.where("path is not null").select(folder(F.col("path")).alias("dir"), F.split(base_name(F.col("path")), r"\.").alias("parts"))
    totals = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= least)
    counts = rows.where(F.size("parts") >= 3).groupBy("dir", F.element_at("parts", -2).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(totals, "dir").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= share)
    return _told(out, "filename_suffix", F.col("dir"), F.col("suffix"))


def folder_languages(files: DataFrame, least: int = 5, share: float = 0.75) -> DataFrame:
    """The language of each top folder."""
    rows = files.where("path like '%/%'").select(F.substring_index("path", "/", 1).alias("dir"), "lang")
    return _told(convention(rows, ["dir"], "lang", least, share), "directory_language", F.col("dir"), F.col("lang"))


def export_styles(styles: DataFrame) -> DataFrame:
    """The rows of :func:`tessella.operators.mining.export_style` as conventions."""
    part = F.col("defaults") / F.col("exports")
    rows = styles.select("domain", "style", F.col("exports").alias("n"), F.when(F.col("style") == "default", part).otherwise(1 - part).alias("share"))
    return _told(rows, "export_style", F.col("domain"), F.col("style"))


def domain_naming(files: DataFrame, least: int = 5, share: float = 0.85) -> DataFrame:
    """``domain, prefix, n, total, share``: the first two path segments that the files of a domain have in common."""
    rows = files.where("domain is not null and path is not null").select("domain", F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("prefix"))
    return convention(rows, ["domain"], "prefix", least, share)


def conventions_for(files: DataFrame, conventions: DataFrame) -> DataFrame:
    """``id, kind, scope, rule, confidence`` of the conventions that hold for each file.

    A style or suffix holds in its folder and below, a style for its extension only; a language holds below its folder; an export style in its domain. Every folder above a file is looked up by
    an equality, so no file meets all conventions.
    """
    rows = files.where("path is not null").select("id", "domain", F.regexp_extract(base_name(F.col("path")), r"(\.[^.]+)$", 1).alias("of"), F.split(folder(F.col("path")), "/").alias("steps"))
    above = rows.select("id", "of", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda n: F.array_join(F.slice("steps", F.lit(1), n), "/"))).alias("scope"))
    above = above.unionByName(rows.where(F.element_at("steps", 1) != ".").select("id", "of", F.lit(".").alias("scope")))
    by_place = above.join(conventions.where("kind <> 'export_style'"), "scope").where("ext is null or ext = of")
    by_domain = rows.select("id", F.col("domain").alias("scope")).join(conventions.where("kind = 'export_style'"), "scope")
    columns = ["id", "kind", "scope", "rule", "confidence"]
    return by_place.select(*columns).unionByName(by_domain.select(*columns))


def pending(log: DataFrame, since: Column, flags: tuple[str, ...] = ("pending", "unresolved"), risks: tuple[str, ...] = ("HIGH", "MEDIUM")) -> DataFrame:
    """Rows from ``since`` on whose JSON payload sets one of the flags or tells one of the risks."""
    open_ = reduce(lambda a, b: a | b, [F.coalesce(F.get_json_object("payload", f"$.{f}"), F.lit("")) == "true" for f in flags])
    return log.where((F.col("ts") >= since) & (open_ | F.coalesce(F.get_json_object("payload", "$.risk").isin(*risks), F.lit(False))))


def working_memory(log: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row: decisions, interventions, open interventions, sessions and files of the last hours."""
    rows = log.where(F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    alarm = F.col("severity").isNotNull()
    return rows.agg(
        F.count(F.when(~alarm, 1)).alias("decisions"), F.count(F.when(alarm, 1)).alias("interventions"), F.count(F.when(alarm & ~F.coalesce("accepted", F.lit(False)), 1)).alias("open_interventions"),
        F.count_distinct("session_id").alias("sessions"), F.count_distinct("file").alias("files"),
    )


def suggestions(drifted: DataFrame, log: DataFrame, hot: DataFrame, now: Column, grown: int = 3, minutes: int = 30, hours: int = 1, score: int = 60, limit: int = 50) -> DataFrame:
    """``id, trigger, severity, ts``: what to look at, newest first, each id once.

    A domain that grew by ``grown`` files (``drifted``: ``domain, before, delta``), a file that two sessions touched within ``minutes``, a grave intervention of the last ``hours``
    that was not accepted (the ten newest), and a file whose commits times dependents reach ``score`` (``hot``: ``file, score, ts``; critical from twice that on).
    """
    told = lambda df, ident, trigger, severity, ts: df.select(F.concat(F.lit(trigger + "_"), ident.cast("string")).alias("id"), F.lit(trigger).alias("trigger"), severity.alias("severity"), ts.alias("ts"))
    jumps = told(drifted.where((F.col("before") > 0) & (F.col("delta") >= grown)), F.col("domain"), "cross_domain_jump", F.lit("major"), now)
    met = log.where((F.col("ts") >= now - F.expr(f"INTERVAL {minutes} MINUTES")) & F.col("file").isNotNull()).groupBy("file").agg(F.count_distinct("session_id").alias("sessions"), F.max("ts").alias("ts"))
    met = met.where("sessions >= 2").orderBy(F.desc("ts"), "file").limit(20)
    grave = log.where((F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("severity") == "HIGH") & ~F.coalesce("accepted", F.lit(False))).orderBy(F.desc("ts"), F.desc("id")).limit(10)
    parts = [
        jumps,
        told(met, F.col("file"), "session_conflict", F.lit("critical"), F.col("ts")),
        told(grave, F.col("id"), "convention_violation", F.lit("major"), F.col("ts")),
        told(hot.where(F.col("score") >= score), F.col("file"), "hotspot_active", F.when(F.col("score") >= 2 * score, "critical").otherwise("major"), F.col("ts")),
    ]
    union = reduce(DataFrame.unionByName, parts)
    once = union.groupBy("id").agg(F.max_by(F.struct("trigger", "severity", "ts"), F.struct("ts", "severity")).alias("r")).select("id", "r.*")
    return once.orderBy(F.desc("ts"), "id").limit(limit)


def safety(files: DataFrame, impact: DataFrame, crossing: DataFrame, untested: DataFrame, churned: DataFrame, interventions: DataFrame) -> DataFrame:
    """``id, severity, item``: what to mind before each file is changed; a file without concern gets one row ``safe``.

    ``impact`` (``id, dependents``), ``churned`` (``id, commits``), ``interventions`` (``id, n``: open grave ones); ``crossing`` and ``untested`` are sets of ids.
    """
    mark = lambda ids, name: ids.select("id").distinct().withColumn(name, F.lit(True))
    rows = files.select("id").join(impact.select("id", "dependents"), "id", "left").join(churned.select("id", "commits"), "id", "left").join(interventions.select("id", "n"), "id", "left")
    rows = rows.join(mark(crossing, "crosses"), "id", "left").join(mark(untested, "bare"), "id", "left")
    blast, commits = F.coalesce("dependents", F.lit(0)), F.coalesce("commits", F.lit(0))
    one = lambda test, severity, item: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(item).alias("item")))
    items = F.filter(
        F.array(
            F.coalesce(one(blast >= 20, "major", "wide impact"), one(blast >= 5, "minor", "impact")), one(F.col("crosses"), "major", "imports across domains"), one(F.col("bare"), "major", "no test"),
            one((commits >= 5) & (blast >= 10), "critical", "hotspot"), one(F.col("n") > 0, "major", "open interventions"),
        ),
        lambda x: x.isNotNull(),
    )
    safe = F.array(F.struct(F.lit("safe").alias("severity"), F.lit("no concern").alias("item")))
    return rows.select("id", F.explode(F.when(F.size(items) > 0, items).otherwise(safe)).alias("i")).select("id", "i.severity", "i.item")


def digest(sections: dict[str, DataFrame]) -> DataFrame:
    """``section, key, value``: several short reports (``key, value``) as one."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("section"), F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value")) for name, df in sections.items()])


def interface(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``file_id, name, importers``: the exported names of every file and how many files import each by name."""
    exported = symbols.where("exported and file_id is not null and name is not null").select("file_id", "name").distinct().join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    used = imports.where("dst is not null and symbol_name is not null").groupBy(F.col("dst").alias("file_id"), F.col("symbol_name").alias("name")).agg(F.count_distinct("src").alias("importers"))
    return exported.join(used, ["file_id", "name"], "left").select("file_id", "name", F.coalesce("importers", F.lit(0)).alias("importers"))


def upgrade_levels(reach: DataFrame, high: int = 50, medium: int = 10) -> DataFrame:
    """``reach`` (with ``files``) and the risk of an upgrade."""
    return reach.withColumn("risk", F.when(F.col("files") >= high, "HIGH").when(F.col("files") >= medium, "MEDIUM").otherwise("LOW"))


def budget_report(files: DataFrame, budget: int) -> DataFrame:
    """One row ``total_tokens, budget, used, efficiency``: a quarter of all bytes against a budget; efficiency in percent to two places."""
    total = F.coalesce(F.sum(F.ceil(F.coalesce("size", F.lit(0)) / 4)), F.lit(0)).cast("long")
    out = files.agg(total.alias("total_tokens")).withColumn("budget", F.lit(budget).cast("long")).withColumn("used", F.least("total_tokens", "budget"))
    return out.withColumn("efficiency", F.when(F.col("total_tokens") > 0, F.floor(F.col("used") / F.col("total_tokens") * 10_000 + 0.5) / 100).otherwise(0.0))
