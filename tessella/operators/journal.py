"""The append-only log of sessions, decisions and interventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.structure import contains_any_case


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """``log`` with ``rows`` whose id it does not hold yet; the log is never changed."""
    return log.unionByName(rows.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti").select(*log.columns))


def recent(log: DataFrame, since: Column, limit: int | None = None) -> DataFrame:
    """Rows from ``since`` on, newest first."""
    rows = log.where(F.col("ts") >= since).orderBy(F.desc("ts"), F.desc("id"))
    return rows.limit(limit) if limit else rows


def search(log: DataFrame, topic: str, limit: int = 100) -> DataFrame:
    """The newest rows that hold ``topic`` in kind, file or payload, case aside."""
    return log.where(contains_any_case(["kind", "file", "payload"], topic)).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def replay(log: DataFrame) -> DataFrame:
    """Each session's rows numbered in order of time, with the seconds since the one before."""
    line = Window.partitionBy("session_id").orderBy("ts", "id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(line).cast("timestamp"))
    return log.select("session_id", "id", F.row_number().over(line).alias("step"), F.floor(gap / 1_000_000).alias("gap_s"))


def sessions(log: DataFrame) -> DataFrame:
    """``session_id, started_at, ended_at, decisions, interventions``."""
    return log.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.when(F.col("severity").isNull(), 1)).alias("decisions"), F.count("severity").alias("interventions"))


def conflicts(log: DataFrame, window: str = "30 minutes", slide: str | None = None, least: int = 2) -> DataFrame:
    """``start, file, sessions, last_ts``: files that several sessions touched within a window of time."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = log.where("file is not null").groupBy(span.alias("w"), "file").agg(F.count_distinct("session_id").alias("sessions"), F.max("ts").alias("last_ts"))
    return out.where(F.col("sessions") >= least).select(F.col("w.start").alias("start"), "file", "sessions", "last_ts")


def interventions_by_file(log: DataFrame, severities: tuple[str, ...] = ("HIGH",)) -> DataFrame:
    """``file, n`` of interventions of the given severities."""
    return log.where(F.col("severity").isin(*severities)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def attribution(log: DataFrame) -> DataFrame:
    """``kind, rows, sessions, unanswered`` per kind of row; unanswered interventions were neither accepted nor refused."""
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("session_id").alias("sessions"), F.count(F.when(F.col("severity").isNotNull() & F.col("accepted").isNull(), 1)).alias("unanswered"))


def latest_per_file(log: DataFrame) -> DataFrame:
    """The newest row of each file."""
    best = F.max_by(F.struct("id", "ts", "kind"), F.struct("ts", "id")).alias("r")
    return log.where("file is not null").groupBy("file").agg(best).select("file", "r.id", "r.ts", "r.kind")


def merge_gaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` findings (``hash, dismissed, reason``) merged with ``new`` ones (``hash``): vanished ones go, dismissals of the rest stay."""
    kept = old.select("hash", F.col("dismissed").alias("__d"), F.col("reason").alias("__r"))
    return new.dropDuplicates(["hash"]).join(kept, "hash", "left").select(*new.columns, F.coalesce("__d", F.lit(False)).alias("dismissed"), F.col("__r").alias("reason"))


def finding_hash(*parts: str) -> Column:
    """Sixteen hexadecimal digits over the parts; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])), 1, 16)


def severity_counts(log: DataFrame) -> DataFrame:
    """``severity, kind, n`` with subtotals by severity, by kind and in all (null marks the summed column)."""
    return log.where("severity is not null").cube("severity", "kind").agg(F.count(F.lit(1)).alias("n"))
