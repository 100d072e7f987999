"""One row per record out of repeated deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``by``; among equals the greatest rest.

    A plain aggregate with partial combination, so a key that owns a third of all rows never sits in
    one task. Null order values lose. Rows with a null key form one group of their own. The order
    of the remaining columns breaks ties, so the result depends on content alone.
    """
    rest = [c for c in df.columns if c not in keys and c not in by]
    packed = F.struct(*[F.col(f"`{c}`") for c in (*by, *rest)])
    grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max(packed).alias("__row"))
    return grouped.select(*[F.col(f"`{c}`") if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns])
