"""Streams of file events and log rows. Every plan takes a batch or a stream of ``ts, file, ...``, so each stream has a batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.storage import delete_at_exit, shared_folder


def _timed(df: DataFrame, delay: str | None) -> DataFrame:
    rows = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay) if delay else rows


def counts(df: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """``start, kind, n`` per window of time."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(df, delay).groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "kind", "n")


def churn(df: DataFrame) -> DataFrame:
    """``file, changes, first_seen, last_seen`` as a running aggregate."""
    return df.groupBy("file").agg(F.count(F.lit(1)).alias("changes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def debounced(df: DataFrame, quiet: str = "10 minutes", delay: str | None = None, key: str = "session_id") -> DataFrame:
    """``key, start, end, n, last_file``: bursts of events closed by a quiet time, the last file of each."""
    w = F.session_window("ts", quiet)
    grouped = _timed(df, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max_by("file", F.struct("ts", "id")).alias("last_file"))
    return grouped.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "last_file")


def conflicts(df: DataFrame, size: str = "30 minutes", slide: str = "5 minutes", delay: str | None = None, least: int = 2) -> DataFrame:
    """``start, file, sessions``: files that several sessions touched within a sliding window; distinct sessions are kept as a set per window and file."""
    grouped = _timed(df, delay).where("file is not null").groupBy(F.window("ts", size, slide).alias("w"), "file").agg(F.size(F.collect_set("session_id")).cast("long").alias("sessions"))
    return grouped.where(F.col("sessions") >= least).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "file", "sessions")


def new_rows(df: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows whose id has not been seen within the watermark."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def bursts(df: DataFrame, gap_ms: int = 100, least: int = 20) -> DataFrame:
    """``root, start, files``: windows that begin with an event and restart with the first event more than ``gap_ms`` after it, with over ``least`` distinct files.

    Exact and stateful: per ``root`` the state holds the window's start and its files. A burst is told once, when it exceeds ``least``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, files, told = state.get if state.exists else (None, [], False)
        seen = set(files)
        out = []
        for batch in batches:
            for ts, file in batch.sort_values("ts")[["ts", "file"]].itertuples(index=False):
                ms = int(pd.Timestamp(ts).value // 1_000_000)
                if start is None or ms - start > gap_ms:
                    start, seen, told = ms, set(), False
                seen.add(file)
                if len(seen) > least and not told:
                    told = True
                    out.append((key[0], start, len(seen)))
        state.update((start, sorted(seen), told))
        yield pd.DataFrame(out, columns=["root", "start_ms", "files"])

    return df.groupBy("root").applyInPandasWithState(
        step, "root string, start_ms long, files long", "start long, files array<string>, told boolean", "append", GroupStateTimeout.NoTimeout
    )


def upserts(path: str):
    """A ``foreachBatch`` function that keeps the newest row per file in a Parquet table: each batch writes a new version beside the old and then names it."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = spark._jvm.org.apache.hadoop.fs
        fs = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        versions = sorted(int(s.getPath().getName()[2:]) for s in (fs.listStatus(files.Path(path)) if fs.exists(files.Path(path)) else []) if s.getPath().getName().startswith("v=") and fs.exists(files.Path(s.getPath(), "_SUCCESS")))
        rows = batch.select("file", "ts", "id", "kind")
        if versions and versions[-1] >= number:
            return
        if versions:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v={versions[-1]}"))
        rows.groupBy("file").agg(F.max(F.struct("ts", "id", "kind")).alias("r")).select("file", "r.*").write.mode("overwrite").parquet(f"{path}/v={number}")

    return apply


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version written by :func:`upserts`."""
    files = spark._jvm.org.apache.hadoop.fs
    fs = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(files.Path(path)) if s.getPath().getName().startswith("v=") and fs.exists(files.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/v={max(done)}")


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is available, through a streaming query into Parquet files of the shared folder; the checkpoint lies beside them, one of its own for each run.

    A batch writes its own part, and writing it again replaces it, so a repeated batch changes nothing; in complete mode the newest batch holds the whole
    result and replaces the one before. Nothing passes through the driver.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/result/start")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/{'whole' if mode == 'complete' else f'batch-{number}'}")

    query = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/result")
