"""Ranked retrieval: IDF, BM25, rank fusion, packing under a budget, vector search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import materialize

K1, B = 1.2, 0.75


def postings(df: DataFrame, key: str, words: Column) -> DataFrame:
    """``key, token, tf, size`` of the documents' words."""
    rows = df.select(F.col(key).alias("doc"), words.alias("w"))
    sizes = F.size("w").alias("size")
    return rows.select("doc", sizes, F.explode("w").alias("token")).groupBy("doc", "token", "size").agg(F.count(F.lit(1)).alias("tf")).select(F.col("doc").alias(key), "token", "tf", "size")


def idf(posted: DataFrame, documents: int) -> DataFrame:
    """``token, df, idf`` with ``ln((N + 1) / (df + 1)) + 1``."""
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((F.lit(documents) + 1.0) / (F.col("df") + 1)) + 1)


def bm25(posted: DataFrame, key: str, query: list[str], documents: int, average: float, limit: int = 30) -> DataFrame:
    """``key, score``: the ``limit`` best documents for any of the query's tokens; ties by key."""
    hits = materialize(posted.where(F.col("token").isin(*query)), "bm25-hits")
    seen = {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen:
        return posted.select(key, F.lit(0.0).alias("score")).limit(0)
    weight = reduce(lambda c, t: c.when(F.col("token") == t[0], F.lit(float(np.log((documents - t[1] + 0.5) / (t[1] + 0.5) + 1)))), seen.items(), F.when(F.lit(False), F.lit(0.0)))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(average)))
    return hits.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def search(df: DataFrame, key: str, words: Column, query: list[str], limit: int = 30) -> DataFrame:
    """``key, score``: :func:`bm25` over texts in one pass: each text is split once, of its words only those asked for go on, and the mean size comes from the same rows."""
    rows = df.select(key, words.alias("w"))
    held = materialize(rows.select(key, F.size("w").alias("size"), F.filter("w", lambda w: w.isin(*query)).alias("hits")), "search-hits")
    n, average = held.agg(F.count(F.lit(1)), F.avg("size")).head()
    posted = held.select(key, "size", F.explode("hits").alias("token")).groupBy(key, "token", "size").agg(F.count(F.lit(1)).alias("tf"))
    return bm25(posted, key, query, n, average or 1.0, limit)


def fuse(channels: list[DataFrame], key: str, k: int = 60, limit: int = 30) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``key, score``): ``key, score, channels``; ties by key. The lists are short results."""
    ranked = [c.select(F.col(key), F.lit(i).alias("channel"), F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank")) for i, c in enumerate(channels)]
    union = reduce(DataFrame.unionByName, ranked)
    return union.groupBy(key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("channels")).orderBy(F.desc("score"), key).limit(limit)


def pack(ranked: DataFrame, key: str, cost: str, budget: int, summary: int = 200) -> DataFrame:
    """``key, rank, used, mode`` of the rows taken in order under a budget: whole if it fits, else its summary, else skipped.

    A skipped row uses nothing, so a running sum would not do: the short ranked list is folded in order. ``ranked`` has ``rank``.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(cost).cast("long").alias("cost"), F.col(key).alias("key"))))
    item = ranked.schema[key].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast(f"array<struct<key:{item},rank:int,used:bigint,mode:string>>").alias("taken"))

    def step(acc, row):
        fits = acc["spent"] + row["cost"] <= budget
        brief = acc["spent"] + summary <= budget
        used = F.when(fits, row["cost"]).when(brief, F.lit(summary).cast("long"))
        one = F.struct(row["key"].alias("key"), row["rank"].cast("int").alias("rank"), used.alias("used"), F.when(fits, "full").otherwise("summary").alias("mode"))
        return F.when(fits | brief, F.struct((acc["spent"] + used).alias("spent"), F.concat(acc["taken"], F.array(one)).alias("taken"))).otherwise(acc)

    folded = ranked.agg(F.aggregate(rows, start, step).alias("a"))
    return folded.select(F.explode("a.taken").alias("t")).select(F.col("t.key").alias(key), "t.rank", "t.used", "t.mode")


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """``query, rank, key``: the ``k`` rows of greatest cosine for each query row, the query itself left out; ties by key.

    Exact. The stated queries go out in blocks of ``block``; every batch of rows keeps its own best, which are then merged per query. Null and zero vectors match nothing.
    """
    spark = df.sparkSession
    wanted = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), vector)
    blocks = int(wanted.count() // block) + 1
    found = []
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()
        if not len(part):
            continue
        m = np.stack(part[vector].to_numpy()).astype(float)
        norm = np.linalg.norm(m, axis=1)
        part, m = part[norm > 0], m[norm > 0] / norm[norm > 0, None]
        shared = spark.sparkContext.broadcast((part["q"].to_numpy(), m))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, m = shared.value
            for batch in batches:
                batch = batch[batch["v"].notna()]
                if not len(batch):
                    continue
                rows = np.stack(batch["v"].to_numpy()).astype(float)
                size = np.linalg.norm(rows, axis=1)
                ids, rows = batch["k"].to_numpy()[size > 0], rows[size > 0] / size[size > 0, None]
                if not len(ids):
                    continue
                near = m @ rows.T
                near[names[:, None] == ids[None, :]] = -np.inf
                top = min(k, near.shape[1])
                least = np.partition(near, -top, axis=1)[:, -top]
                i, j = np.nonzero((near >= least[:, None]) & np.isfinite(near))
                yield pd.DataFrame({"query": names[i], "k": ids[j], "s": near[i, j]})

        found.append(df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInPandas(best, "query long, k long, s double"))
    if not found:
        return spark.createDataFrame([], "query long, rank int, " + key + " long")
    line = Window.partitionBy("query").orderBy(F.desc("s"), "k")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query", "rank", F.col("k").alias(key))


def token_estimate(size: Column, most: int = 4096) -> Column:
    """A quarter of the bytes, rounded up, at most ``most``."""
    return F.least(F.ceil(F.coalesce(size, F.lit(0)) / 4), F.lit(most))
