"""History of changing attributes: type-two versions from periodic snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.paths import clean_label, clean_path
from tessella.operators.rows import latest

OPEN = -1


def attribute_hash(attrs: Sequence[str], seed: int = 0) -> Column:
    """64 bits over a set of attributes, each told apart from null; ``seed`` gives independent bits."""
    return F.xxhash64(F.lit(seed), *[x for a in attrs for x in (F.col(a).isNull(), F.col(a))])


def full_snapshots(snapshots: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series, states): the ordered full snapshots of each repository, and what each one holds.

    series: ``repo_name, snapshot_id, ts, commit_sha, seq, next_id`` (``next_id`` is -1 at the end);
    a snapshot without any member row is no full snapshot and gets no place. states: one row per
    ``snapshot_id`` and cleaned ``file_path`` with the cleaned ``domain_name`` of the latest
    ``recorded_at``. Member rows with a null path or of an unknown snapshot are ignored; equal times
    fall back to the greater id, so the order is total.
    """
    series, rows = _series(snapshots, members)
    return series, latest(rows, ["snapshot_id", "file_path"], ["recorded_at"]).select("snapshot_id", "file_path", "domain_name")


def delivered_snapshots(snapshots: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like :func:`full_snapshots`, but states are the deliveries (with ``recorded_at``), exact repeats dropped while they are read.

    Which delivery of a path holds is left to the operator, which sorts by key anyway.
    """
    series, rows = _series(snapshots, members)
    return series, rows.distinct()


def _series(snapshots: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    heads = latest(snapshots.select("id", "repo_name", "ts", "commit_sha").where(F.col("id").isNotNull()), ["id"], ["ts"])
    given = members.where(F.col("file_path").isNotNull() & F.col("snapshot_id").isNotNull())
    rows = given.select("snapshot_id", clean_path(F.col("file_path")).alias("file_path"), clean_label(F.col("domain_name")).alias("domain_name"), "recorded_at")
    order = Window.partitionBy("repo_name").orderBy("ts", "snapshot_id")
    series = (
        heads.withColumnRenamed("id", "snapshot_id")
        .join(given.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
        .withColumn("seq", F.row_number().over(order))
        .withColumn("next_id", F.coalesce(F.lead("snapshot_id").over(order), F.lit(OPEN).cast("long")))
        .select("repo_name", "snapshot_id", "ts", "commit_sha", "seq", "next_id")
    )
    return series, rows


def merge(series: DataFrame, states: DataFrame, dimension: DataFrame | None = None, merged: DataFrame | None = None, key: str = "file_path", attrs: Sequence[str] = ("domain_name",)) -> DataFrame:
    """The type-two merge: the arriving full snapshots ``states`` into ``dimension``; one snapshot, or a backlog of any length in one pass.

    ``series`` orders the snapshots known so far, merged and arriving (:func:`full_snapshots`); ``merged`` (``repo_name, seq``) tells up to which place of each series the
    dimension, a former result of this function, has been merged. Every arriving row's attribute hash is compared with that of the version
    current at the snapshot before, which is the dimension's open version where the backlog begins. Where they differ, or the key was absent there,
    a version opens; the current version is closed by the next snapshot that lacks its key or hashes otherwise, else it stays open
    (``to_snapshot_id`` -1, ``valid_to`` null). Closed versions pass through and no merged snapshot is read again.

    Result: ``repo_name, key, attrs, from_snapshot_id, to_snapshot_id, valid_from, valid_to, from_commit, is_current``. If ``states`` has
    ``recorded_at``, the latest delivery of a key in a snapshot holds, among equals the greatest attributes. Null attributes are values, empty inputs give an
    empty result, further columns are ignored. One shuffle by key: a key's rows are at most as many as its series has snapshots and distinct deliveries.
    """
    given = ["recorded_at"] if "recorded_at" in states.columns else []
    from_ = ["__id", "__ts", "__commit"]
    order = Window.partitionBy("repo_name").orderBy("seq")
    known = series.withColumn("next_id", F.coalesce(F.lead("snapshot_id").over(order), F.lit(OPEN).cast("long")))
    places = known.select("repo_name", "seq", "next_id", "snapshot_id", *[F.col(c).alias(n) for c, n in zip(("snapshot_id", "ts", "commit_sha"), from_)])
    rows = states.select("snapshot_id", key, *attrs, *given).join(places, "snapshot_id").drop("snapshot_id")
    if dimension is not None:
        current = dimension.where(F.col("to_snapshot_id") == OPEN).select(
            "repo_name", key, *attrs, F.col("from_snapshot_id").alias("__id"), F.col("valid_from").alias("__ts"), F.col("from_commit").alias("__commit"), *[F.lit(None).cast(states.schema[c].dataType).alias(c) for c in given]
        )
        at = merged.select("repo_name", "seq").join(places.select("repo_name", "seq", "next_id"), ["repo_name", "seq"])
        rows = rows.unionByName(current.join(at, "repo_name"))
    rows = rows.repartition("repo_name", key)
    if given:
        last = F.lead(F.lit(1)).over(Window.partitionBy("repo_name", key, "seq").orderBy(*given, *attrs)).isNull()
        rows = rows.withColumn("__last", last).where("__last").drop("__last", *given)
    rows = rows.withColumn("__hash", attribute_hash(attrs))
    line = Window.partitionBy("repo_name", key).orderBy("seq")
    like = lambda other, step: F.coalesce((other("seq").over(line) == F.col("seq") + step) & (other("__hash").over(line) == F.col("__hash")), F.lit(False))
    ends = rows.withColumns({"__opens": ~like(F.lag, -1), "__closes": ~like(F.lead, 1)}).where("__opens or __closes")
    found = ends.withColumn("to_snapshot_id", F.when(F.col("__closes"), F.col("next_id")).otherwise(F.lead("next_id").over(line))).where("__opens")
    told = series.select(F.col("snapshot_id").alias("__end"), F.col("ts").alias("valid_to"))
    out = found.join(told, F.col("to_snapshot_id") == F.col("__end"), "left").select(
        "repo_name", key, *attrs, F.col("__id").alias("from_snapshot_id"), "to_snapshot_id", F.col("__ts").alias("valid_from"), "valid_to", F.col("__commit").alias("from_commit"), (F.col("to_snapshot_id") == OPEN).alias("is_current")
    )
    return out if dimension is None else out.unionByName(dimension.where(F.col("to_snapshot_id") != OPEN))
