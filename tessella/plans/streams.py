"""Streaming plans run over the event table, as a stream of all that is available; SQL tells their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.registry import CORE
from tessella.sources import bindings as b
from tessella.streaming import changes as c


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a stream: the event file is found by its name in the folder."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    if probe.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(probe).isFile():
        rows = source.option("pathGlobFilter", "events.parquet").parquet(folder)
    else:
        rows = source.parquet(path)
    k = F.get_json_object("props", "$.k")
    return rows.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), F.concat(F.lit("p"), k).alias("file"))


def _name(base: str) -> str:
    return f"{base}_{uuid.uuid4().hex[:12]}"


@CORE.query("stream_hourly_counts", f"WITH {b.LOG_SQL} SELECT date_trunc('hour', ts) AS start, kind, count(*) AS n FROM log_b GROUP BY 1, 2")
def stream_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and kind."""
    return c.run_once(c.counts(_stream(spark, folder)), _name("counts"))


@CORE.query("stream_churn", f"WITH {b.LOG_SQL} SELECT file, count(*) AS changes, min(ts) AS first_seen, max(ts) AS last_seen FROM log_b GROUP BY file")
def stream_churn(spark: SparkSession, folder: str) -> DataFrame:
    """Changes per file as a running aggregate."""
    return c.run_once(c.churn(_stream(spark, folder)), _name("churn"))


@CORE.query(
    "stream_conflicts",
    f"""WITH {b.LOG_SQL}, slid AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '1970-01-01') - INTERVAL 5 MINUTES * i AS start, file, session_id FROM log_b, (SELECT unnest(range(6)) AS i) WHERE file IS NOT NULL)
    SELECT start, file, count(DISTINCT session_id) AS sessions FROM slid GROUP BY ALL HAVING count(DISTINCT session_id) >= 2""",
)
def stream_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Files that several sessions touched within half an hour, every five minutes."""
    return c.run_once(c.conflicts(_stream(spark, folder)), _name("conflicts"))


@CORE.query(
    "debounce_sessions",
    f"""WITH {b.LOG_SQL}, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 10 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM log_b WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, id) AS run FROM gaps)
    SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTES AS "end", count(*) AS n, arg_max(file, (ts, id)) AS last_file FROM runs GROUP BY session_id, run""",
)
def debounce_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of events per session, closed by ten quiet minutes."""
    return c.debounced(b.log(spark, folder))
