"""Analytics over time: churn, drift, evolution, health and events of snapshot series. ``now`` is always an argument."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of a time unit.
UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}


def range_ms(text: str) -> int:
    """``90d``, ``12 h``, ``2w`` in milliseconds; a bare number means days. Anything else raises ValueError."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhdwy]?)\s*", text)
    if not m:
        raise ValueError(f"no time range: {text!r}")
    return int(m[1]) * UNITS[m[2] or "d"]


def since(column: str, now: Column, text: str) -> Column:
    """Whether a time lies within the range before ``now``."""
    return F.col(column) >= now - F.expr(f"INTERVAL {range_ms(text) // 1000} SECONDS")


def new_snapshots(known: DataFrame, arriving: DataFrame) -> DataFrame:
    """Snapshots to append: with a commit, only those whose (repo, commit, source) is new; without one, all. Repeats within ``arriving`` enter once."""
    keyed = arriving.where("commit_sha is not null").dropDuplicates(["repo_name", "commit_sha", "source"])
    fresh = keyed.join(known.where("commit_sha is not null").select("repo_name", "commit_sha", "source").distinct(), ["repo_name", "commit_sha", "source"], "left_anti")
    return fresh.select(*arriving.columns).unionByName(arriving.where("commit_sha is null"))


def churn(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """``file, commits, first_seen, last_modified`` over distinct (commit, file), so a repeated load changes nothing."""
    return (
        commit_files.select("sha", "file").distinct().join(commits.select("sha", "ts"), "sha").groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_modified"))
    )


def hotspots(churned: DataFrame, impact: DataFrame, limit: int = 20, candidates: int = 500) -> DataFrame:
    """``file, commits, dependents, score``: the most changed ``candidates`` by commits, then the top ``limit`` by commits times dependents (one at least)."""
    first = churned.orderBy(F.desc("commits"), "file").limit(candidates)
    scored = first.join(impact.select(F.col("id").alias("file"), "dependents"), "file", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    return scored.withColumn("score", F.col("commits") * F.greatest(F.lit(1), "dependents")).select("file", "commits", "dependents", "score").orderBy(F.desc("score"), "file").limit(limit)


def velocity(commits: DataFrame) -> DataFrame:
    """``day, commits`` per UTC day."""
    return commits.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("commits"))


def domain_counts(series: DataFrame, states: DataFrame) -> DataFrame:
    """``repo_name, seq, snapshot_id, domain, files`` per full snapshot; a null domain is left out."""
    return states.where("domain_name is not null").groupBy("snapshot_id", F.col("domain_name").alias("domain")).agg(F.count(F.lit(1)).alias("files")).join(series.select("snapshot_id", "repo_name", "seq", "ts"), "snapshot_id")


def drift(series: DataFrame, states: DataFrame, growing: float = 1.05, shrinking: float = 0.95) -> DataFrame:
    """``repo_name, domain, before, after, delta, trend``: first against last full snapshot; series of one snapshot are left out."""
    ends = series.groupBy("repo_name").agg(F.min_by("snapshot_id", "seq").alias("first"), F.max_by("snapshot_id", "seq").alias("last")).where("first <> last")
    counts = domain_counts(series, states).select("repo_name", "snapshot_id", "domain", "files")
    sides = counts.join(ends, "repo_name").where("snapshot_id in (first, last)")
    out = sides.groupBy("repo_name", "domain").agg(
        F.sum(F.when(F.col("snapshot_id") == F.col("first"), F.col("files")).otherwise(0)).alias("before"), F.sum(F.when(F.col("snapshot_id") == F.col("last"), F.col("files")).otherwise(0)).alias("after")
    )
    trend = F.when(F.col("after") > F.col("before") * growing, "growing").when(F.col("after") < F.col("before") * shrinking, "shrinking").otherwise("stable")
    return out.withColumn("delta", F.col("after") - F.col("before")).withColumn("trend", trend)


def evolution(series: DataFrame, states: DataFrame, domain: str) -> DataFrame:
    """``repo_name, snapshot_id, ts, files``: a domain's size in every full snapshot, 0 where absent."""
    sizes = states.where(F.col("domain_name") == domain).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    return series.join(sizes, "snapshot_id", "left").select("repo_name", "snapshot_id", "ts", F.coalesce("n", F.lit(0)).alias("files"))


def membership_moves(series: DataFrame, states: DataFrame) -> DataFrame:
    """``repo_name, seq, domain, before, after, left_it, joined`` for neighbouring full snapshots; null domains do not count."""
    rows = states.where("domain_name is not null").join(series.select("snapshot_id", "repo_name", "seq"), "snapshot_id").select("repo_name", "seq", "file_path", F.col("domain_name").alias("domain"))
    last = series.groupBy("repo_name").agg(F.max("seq").alias("m"))
    now = rows.where("seq > 1").withColumn("now", F.lit(1)).withColumn("was", F.lit(0))
    was = rows.join(last, "repo_name").where("seq < m").drop("m").withColumn("seq", F.col("seq") + 1).withColumn("now", F.lit(0)).withColumn("was", F.lit(1))
    each = now.unionByName(was).groupBy("repo_name", "seq", "domain", "file_path").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    return each.groupBy("repo_name", "seq", "domain").agg(
        F.sum("was").alias("before"), F.sum("now").alias("after"), F.sum(F.when(F.col("now") == 0, 1).otherwise(0)).alias("left_it"), F.sum(F.when(F.col("was") == 0, 1).otherwise(0)).alias("joined")
    )


def events(series: DataFrame, states: DataFrame, share: float = 0.2, least: int = 5, major: int = 10) -> DataFrame:
    """``snapshot_id, domain, kind, severity, before, after`` between neighbouring full snapshots.

    new_domain and domain_disappeared (major from ``major`` files on), growth and shrink (from ``share`` and ``least`` files on; major from half on), and
    domain_unstable (30 % and three files moved out; critical from half on).
    """
    moves = membership_moves(series, states).withColumn("change", F.abs(F.col("after") - F.col("before"))).withColumn("part", F.when(F.col("before") > 0, F.abs(F.col("after") - F.col("before")) / F.col("before")))
    size = F.greatest("before", "after")
    big = F.when(size >= major, "major").otherwise("minor")
    half = F.when(F.col("part") >= 0.5, "major").otherwise("minor")
    resized = (F.col("before") > 0) & (F.col("after") > 0) & (F.col("part") >= share) & (F.col("change") >= least)
    gone = F.col("left_it") / F.col("before")
    kinds = F.array(
        F.when(F.col("before") == 0, F.struct(F.lit("new_domain").alias("kind"), big.alias("severity"))),
        F.when(F.col("after") == 0, F.struct(F.lit("domain_disappeared").alias("kind"), big.alias("severity"))),
        F.when(resized & (F.col("after") > F.col("before")), F.struct(F.lit("growth").alias("kind"), half.alias("severity"))),
        F.when(resized & (F.col("after") < F.col("before")), F.struct(F.lit("shrink").alias("kind"), half.alias("severity"))),
        F.when((F.col("before") > 0) & (F.col("after") > 0) & (F.col("left_it") >= 3) & (gone >= 0.3), F.struct(F.lit("domain_unstable").alias("kind"), F.when(gone >= 0.5, "critical").otherwise("major").alias("severity"))),
    )
    out = moves.withColumn("e", F.explode(F.filter(kinds, lambda e: e.isNotNull())))
    ids = series.select("repo_name", "seq", "snapshot_id")
    return out.join(ids, ["repo_name", "seq"]).select("snapshot_id", "domain", F.col("e.kind").alias("kind"), F.col("e.severity").alias("severity"), "before", "after")


def health(series: DataFrame, states: DataFrame, days: int = 30) -> DataFrame:
    """``repo_name, domain, before, after, growth, growth_rate, moved, instability``: the latest full snapshot against the one as of ``days`` before it.

    The rate is to two places, half up, null without files before; series without an earlier snapshot are left out.
    """
    last = series.groupBy("repo_name").agg(F.max_by(F.struct("snapshot_id", "ts"), "seq").alias("l"))
    cut = series.join(last, "repo_name").where(F.col("ts") <= F.col("l.ts") - F.expr(f"INTERVAL {days} DAYS"))
    prior = cut.groupBy("repo_name").agg(F.max_by("snapshot_id", "seq").alias("p"))
    ends = last.join(prior, "repo_name").select("repo_name", F.col("l.snapshot_id").alias("l"), "p")
    rows = states.where("domain_name is not null").join(series.select("snapshot_id", "repo_name"), "snapshot_id").join(ends, "repo_name").where("snapshot_id in (l, p)")
    each = rows.groupBy("repo_name", F.col("domain_name").alias("domain"), "file_path").agg(F.max((F.col("snapshot_id") == F.col("l")).cast("int")).alias("now"), F.max((F.col("snapshot_id") == F.col("p")).cast("int")).alias("was"))
    out = each.groupBy("repo_name", "domain").agg(F.sum("was").alias("before"), F.sum("now").alias("after"), F.sum(F.when(F.col("now") == 0, 1).otherwise(0)).alias("moved"))
    growth = F.col("after") - F.col("before")
    rate = lambda x: F.when(F.col("before") > 0, F.floor(x / F.col("before") * 100 + 0.5) / 100)
    return out.withColumns({"growth": growth, "growth_rate": rate(growth), "instability": rate(F.col("moved"))})


def first_events(series: DataFrame, states: DataFrame) -> DataFrame:
    """``snapshot_id, domain, kind, severity, before, after`` of the first full snapshot of each series: one event ``initial_snapshot`` with its files."""
    sizes = states.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("after"))
    first = series.where("seq = 1").join(sizes, "snapshot_id")
    return first.select("snapshot_id", F.lit(None).cast("string").alias("domain"), F.lit("initial_snapshot").alias("kind"), F.lit("minor").alias("severity"), F.lit(0).cast("long").alias("before"), "after")


def hotspot_events(churned: DataFrame, impact: DataFrame, top: int = 20, dependents: int = 20, commits: int = 2, critical: int = 50) -> DataFrame:
    """``id, severity, dependents, commits``: of the ``top`` files by dependents, those with so many dependents that were committed again. Ties by id."""
    first = impact.orderBy(F.desc("dependents"), "id").limit(top).where(F.col("dependents") >= dependents)
    held = first.join(churned.select(F.col("file").alias("id"), "commits"), "id").where(F.col("commits") >= commits)
    return held.select("id", F.when(F.col("dependents") >= critical, "critical").otherwise("major").alias("severity"), "dependents", "commits")


def recent_events(told: DataFrame, series: DataFrame, days: int = 90, severities: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """The newest events within ``days`` before the last snapshot of all."""
    dated = told.join(series.select("snapshot_id", "ts"), "snapshot_id")
    last = series.agg(F.max("ts")).head()[0]
    rows = dated.where(F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    rows = rows.where(F.col("severity").isin(*severities)) if severities else rows
    return rows.orderBy(F.desc("ts"), "snapshot_id", "domain", "kind").limit(limit)


def within(series: DataFrame, days: int) -> DataFrame:
    """The snapshots of each series within ``days`` before its last one; the series' own clock is ``now``."""
    last = series.groupBy("repo_name").agg(F.max("ts").alias("__last"))
    return series.join(last, "repo_name").where(F.col("ts") >= F.col("__last") - F.expr(f"INTERVAL {days} DAYS")).drop("__last")


def file_history(series: DataFrame, states: DataFrame) -> DataFrame:
    """``repo_name, file_path, snapshots, domains, first_seen, last_seen, age_days, held_now``: what is known over time of every path.

    The age is that of the first snapshot with the path, counted from the last of the series.
    """
    last = series.groupBy("repo_name").agg(F.max("ts").alias("now"), F.max("seq").alias("m"))
    rows = states.join(series.select("snapshot_id", "repo_name", "ts", "seq"), "snapshot_id")
    seen = rows.groupBy("repo_name", "file_path").agg(F.count(F.lit(1)).alias("snapshots"), F.count_distinct("domain_name").alias("domains"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("seq").alias("s"))
    return seen.join(last, "repo_name").select("repo_name", "file_path", "snapshots", "domains", "first_seen", "last_seen", F.datediff("now", "first_seen").alias("age_days"), (F.col("s") == F.col("m")).alias("held_now"))


def velocity_summary(commits: DataFrame) -> DataFrame:
    """One row ``days, commits, mean``: days with commits, all commits, and the mean over those days."""
    return velocity(commits).agg(F.count(F.lit(1)).alias("days"), F.sum("commits").alias("commits"), F.avg("commits").alias("mean"))


def presence(series: DataFrame, states: DataFrame) -> DataFrame:
    """``repo_name, file_path, snapshots, domains, kind``: full snapshots a path was in; tracked from three on."""
    seen = states.join(series.select("snapshot_id", "repo_name"), "snapshot_id").groupBy("repo_name", "file_path").agg(F.count(F.lit(1)).alias("snapshots"), F.count_distinct("domain_name").alias("domains"))
    return seen.withColumn("kind", F.when(F.col("snapshots") >= 3, "tracked").otherwise("sparse"))


def stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``files, changed, share`` over the files both assignments (``id, domain``) know; null is a value."""
    both = before.select("id", F.col("domain").alias("d1")).join(after.select("id", F.col("domain").alias("d2")), "id")
    moved = F.count(F.when(~F.col("d1").eqNullSafe(F.col("d2")), 1))
    return both.agg(F.count(F.lit(1)).alias("files"), moved.alias("changed")).withColumn("share", F.when(F.col("files") > 0, F.col("changed") / F.col("files")))


def running(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with a running sum per group."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
