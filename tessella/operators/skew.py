"""Joins that hold when a few keys own most of the rows.

The heavy keys are found by a pre-aggregated count. At most ``1 / share`` keys can own at least
``share`` of the rows each, so their list has a proven bound and may be broadcast; everything else goes
through an ordinary shuffle, in which no key is large any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on; so there are at most 500 heavy keys.
HEAVY_SHARE = 1 / 500


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """The keys that own at least ``share`` of the rows: at most ``1/share`` values, by pre-aggregated counts. Null is no key."""
    rows = df.where(F.col(key).isNotNull())
    limit = max(2, rows.count() * share)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= limit)
    return [r[0] for r in counts.select(key).limit(int(1 / share)).collect()]


def _split(df: DataFrame, key: str, known: DataFrame, known_key: str, share: float, how: str) -> DataFrame:
    targets = known.select(F.col(known_key).alias("__t")).where(F.col("__t").isNotNull()).distinct()
    rows = df.where(F.col(key).isNotNull())
    heavy = heavy_keys(df, key, share)
    if not heavy:
        return rows.join(targets, F.col(key) == F.col("__t"), how)
    there = {r[0] for r in targets.where(F.col("__t").isin(heavy)).collect()}
    kept = [k for k in heavy if (k in there) == (how == "left_semi")]
    cold = rows.where(~F.col(key).isin(heavy)).join(targets, F.col(key) == F.col("__t"), how)
    return cold.unionByName(rows.where(F.col(key).isin(kept))) if kept else cold


def missing_from(df: DataFrame, key: str, known: DataFrame, known_key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Rows of ``df`` whose non-null ``key`` (a number or text) occurs nowhere in ``known``: an anti-join safe against hot keys.

    Heavy keys are looked up once each and their rows filtered by the short list; the rows of all other keys take a
    shuffled anti-join. Rows with a null key are left out. ``df`` keeps its columns.
    """
    return _split(df, key, known, known_key, share, "left_anti")


def present_in(df: DataFrame, key: str, known: DataFrame, known_key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Rows of ``df`` whose non-null ``key`` occurs in ``known``: a semi-join safe against hot keys, see :func:`missing_from`."""
    return _split(df, key, known, known_key, share, "left_semi")


def look_up(df: DataFrame, key: str, facts: DataFrame, weight: str, share: float = HEAVY_SHARE) -> DataFrame:
    """``df`` inner-joined with ``facts``, which has one row per ``key`` and, in ``weight``, the key's rows in ``df``.

    The facts of heavy keys, at most ``1/share``, are broadcast; the rest takes a shuffled join.
    """
    total = facts.agg(F.sum(weight)).head()[0] or 0
    limit = max(2, total * share)
    heavy = facts.where(F.col(weight) >= limit).limit(int(1 / share))
    light = facts.where(F.col(weight) < limit)
    names = heavy.select(F.col(key).alias("__h"))
    hot = df.join(F.broadcast(heavy), key)
    cold = df.join(F.broadcast(names), F.col(key) == F.col("__h"), "left_anti").join(light, key)
    return hot.unionByName(cold)
