"""What changed between consecutive full snapshots, by content-defined chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.history import attribute_hash
from tessella.storage import materialize

#: One key in so many starts a new chunk.
CHUNK_ROWS = 64
#: A repository's keys fall into so many blocks by their hash; the number is part of what a stored digest means.
BLOCKS = 256


def chunked(states: DataFrame, series: DataFrame, chunk_rows: int = CHUNK_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """Each state row with its chunk: ``repo_name, seq, snapshot_id, next_id, file_path, domain_name, block, chunk, h1, h2``.

    A key's block is a hash of the key, so it is the same in every run and on every cluster. Within a block the keys of a snapshot are sorted,
    and a chunk starts at every key whose own hash says so: where a chunk begins depends on content alone, and an inserted or deleted row changes the chunk
    it lies in and no other. The block bounds the rows that one sort sees. Of repeated deliveries (``recorded_at``) the latest holds.
    """
    spread = states.join(series.select("snapshot_id", "repo_name", "seq", "next_id"), "snapshot_id").withColumn("block", F.pmod(F.xxhash64("file_path"), F.lit(blocks)).cast("int")).repartition("repo_name", "block")
    if "recorded_at" in states.columns:
        last = F.lead(F.lit(1)).over(Window.partitionBy("repo_name", "block", "seq", "file_path").orderBy("recorded_at", "domain_name")).isNull()
        spread = spread.withColumn("__last", last).where("__last")
    line = Window.partitionBy("repo_name", "block", "seq").orderBy("file_path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.xxhash64(F.lit(1), "file_path")
    starts = F.when(F.pmod(own, F.lit(chunk_rows)) == 0, own)
    content = ["file_path", "domain_name"]
    return spread.withColumn("chunk", F.coalesce(F.last(starts, ignorenulls=True).over(line), F.lit(0))).select(
        "repo_name", "seq", "snapshot_id", "next_id", "file_path", "domain_name", "block", "chunk", attribute_hash(content).alias("h1"), attribute_hash(content, 7).alias("h2")
    )


def digests(rows: DataFrame) -> DataFrame:
    """``repo_name, block, chunk, seq, n, d1, d2`` of chunks: row count and two 64-bit digests that do not depend on the rows' order. Small enough to be kept with each snapshot."""
    return rows.groupBy("repo_name", "block", "chunk", "seq").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"))


def changes(rows: DataFrame, series: DataFrame) -> DataFrame:
    """``repo_name, snapshot_id, file_path, change, old_domain, new_domain`` between neighbours of a series.

    ``rows`` comes from :func:`chunked`. A chunk whose digest also occurs at the same place of the snapshot before is discarded. A key whose chunk is unmatched on one
    side lies in an unmatched chunk on the other side too, so the rows that are left meet their counterparts by key, sorted by snapshot: a merge join of each snapshot with the one before.
    ``added``: the path is only in this one; ``removed``: only in the one before; ``changed``: the attribute differs, null being a value. The first snapshot of a series has
    no rows.
    """
    rows = materialize(rows, "snapshot-chunks")
    place = Window.partitionBy("repo_name", "block", "chunk").orderBy("seq")
    same = lambda other, step: F.coalesce((other("seq").over(place) == F.col("seq") + step) & (other(F.struct("n", "d1", "d2")).over(place) == F.struct("n", "d1", "d2")), F.lit(False))
    last = series.groupBy("repo_name").agg(F.max("seq").alias("last"))
    open_ = (
        digests(rows)
        .join(last, "repo_name")
        .select("repo_name", "block", "chunk", "seq", ((F.col("seq") > 1) & ~same(F.lag, -1)).alias("new"), ((F.col("seq") < F.col("last")) & ~same(F.lead, 1)).alias("old"))
        .where("new or old")
    )
    left = rows.select("repo_name", "seq", "snapshot_id", "next_id", "file_path", "domain_name", "block", "chunk").join(open_, ["repo_name", "block", "chunk", "seq"])
    line = Window.partitionBy("repo_name", "file_path").orderBy("seq")
    before = F.coalesce(F.lag("seq").over(line) == F.col("seq") - 1, F.lit(False))
    after = F.coalesce(F.lead("seq").over(line) == F.col("seq") + 1, F.lit(False))
    met = left.select("repo_name", "snapshot_id", "next_id", "file_path", "domain_name", "new", "old", before.alias("before"), after.alias("after"), F.lag("domain_name").over(line).alias("was"))
    none = F.lit(None).cast("string")
    told = lambda at, kind, old, new: F.struct(F.col(at).alias("snapshot_id"), F.lit(kind).alias("change"), old.alias("old_domain"), new.alias("new_domain"))
    now, was = F.col("domain_name"), F.col("was")
    kinds = F.array(
        F.when(F.col("new") & ~F.col("before"), told("snapshot_id", "added", none, now)).when(F.col("new") & ~was.eqNullSafe(now), told("snapshot_id", "changed", was, now)),
        F.when(F.col("old") & ~F.col("after"), told("next_id", "removed", now, none)),
    )
    return met.select("repo_name", "file_path", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("repo_name", "k.snapshot_id", "file_path", "k.change", "k.old_domain", "k.new_domain")
