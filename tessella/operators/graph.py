"""Reachability, closure and neighbourhood over an edge table ``src, dst`` (src depends on dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import materialize


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (``src, dst, path``) with a null ``dst`` filled by the file of exactly that path; the least id where several have it."""
    by_path = files.where("path is not null").groupBy(F.col("path").alias("__p")).agg(F.min("id").alias("__id"))
    known = imports.where("dst is not null")
    late = imports.where("dst is null").join(by_path, F.col("path") == F.col("__p"), "left").withColumn("dst", F.col("__id")).drop("__p", "__id")
    return known.unionByName(late)


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int = 5, reverse: bool = True) -> DataFrame:
    """``id, hop`` of the nodes reachable from ``seeds`` (``id``), least hop, seeds left out even on cycles.

    ``reverse`` follows dependents, else dependencies. Each hop joins the frontier only, is written once, and the walk ends when it is
    empty. Repeated and self edges change nothing; unknown seeds reach nothing.
    """
    start, end = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(start).alias("id"), F.col(end).alias("next")).where("id is not null and next is not null")
    if max_hops > 1:  # every hop reads the edges again
        steps = materialize(steps, "reach-steps")
    visited = seeds.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct().withColumn("hop", F.lit(0))
    frontier = visited
    for hop in range(1, max_hops + 1):
        found = frontier.join(steps, "id").select(F.col("next").cast("long").alias("id")).distinct().join(visited.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        frontier = materialize(found, "reach")
        if frontier.head() is None:
            break
        visited = visited.unionByName(frontier)
    return visited.where("hop > 0")


def reach_each(edges: DataFrame, seeds: DataFrame, max_hops: int = 5) -> DataFrame:
    """``seed, id, hop``: what depends on each seed within ``max_hops``, each seed by itself, least hop, the seed left out."""
    back = materialize(edges.where("src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("id")).distinct(), "reach-steps")
    known = delta = seeds.select(F.col("id").cast("long").alias("seed"), F.col("id").cast("long").alias("id")).where("id is not null").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, max_hops + 1):
        found = delta.select("seed", F.col("id").alias("at")).join(back, "at").select("seed", "id").distinct().join(known.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop))
        delta = materialize(found, "reach")
        if delta.head() is None:
            break
        known = known.unionByName(delta)
    return known.where("hop > 0")


def bitmap_set_counts(bitmaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, both, either, only_a`` of the adjacency bitmaps of each pair of nodes: and, or and and-not, bucket by bucket."""
    left = pairs.join(bitmaps.select(F.col("src").alias("a"), "bucket", F.col("bits").alias("x")), "a")
    right = pairs.join(bitmaps.select(F.col("src").alias("b"), "bucket", F.col("bits").alias("y")), "b")
    met = left.select("a", "b", "bucket", F.col("x").alias("bits")).unionByName(right.select("a", "b", "bucket", F.col("y").alias("bits")))
    each = met.groupBy("a", "b", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("either"), F.when(F.count(F.lit(1)) == 2, F.bitmap_count(F.bitmap_and_agg("bits"))).otherwise(0).alias("both"))
    sizes = bitmaps.groupBy(F.col("src").alias("a")).agg(F.sum(F.bitmap_count("bits")).alias("of_a"))
    sums = each.groupBy("a", "b").agg(F.sum("both").alias("both"), F.sum("either").alias("either"))
    return sums.join(sizes, "a", "left").select("a", "b", "both", "either", (F.coalesce("of_a", F.lit(0)) - F.col("both")).alias("only_a"))


def closure(edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """``file, dependent, hop``: all pairs within ``max_hops`` of reverse reachability, self left out.

    Semi-naive: each round extends only the pairs of the round before and drops those known; both sides are spread by
    the pair, so a hub file is no hot key in the dropping step, and the extending join is an ordinary one that
    adaptive execution may split.
    """
    back = materialize(edges.where("src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("dependent")).distinct(), "closure-steps")
    known = back.select(F.col("at").alias("file"), "dependent", F.lit(1).alias("hop"))
    delta = known = materialize(known, "closure")
    for hop in range(2, max_hops + 1):
        more = (
            delta.select("file", F.col("dependent").alias("at"))
            .join(back, "at")
            .where("file <> dependent")
            .select("file", "dependent")
            .distinct()
            .join(known.select("file", "dependent"), ["file", "dependent"], "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        delta = materialize(more, "closure")
        if delta.head() is None:
            break
        known = known.unionByName(delta)
    return known


def impact_counts(pairs: DataFrame) -> DataFrame:
    """``id, dependents`` from a closure, by number of distinct dependents."""
    return pairs.groupBy(F.col("file").alias("id")).agg(F.count_distinct("dependent").alias("dependents"))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """``src, dst`` of the edges met on an undirected walk of ``hops`` from the seeds: those that touch a node nearer than ``hops``."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = seeds.select(F.col("id").cast("long").alias("id")).distinct()
    inner = start if hops <= 1 else start.unionByName(reach(both, seeds, hops - 1, reverse=False).select("id"))
    inner = inner.distinct()
    out = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst")
    into = edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return out.unionByName(into).distinct()


def crossing(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``src, dst, src_domain, dst_domain`` of the edges between different domains, both known."""
    named = files.where("domain is not null").select("id", "domain")
    a = named.select(F.col("id").alias("src"), F.col("domain").alias("src_domain"))
    b = named.select(F.col("id").alias("dst"), F.col("domain").alias("dst_domain"))
    return edges.join(a, "src").join(b, "dst").where("src_domain <> dst_domain").select("src", "dst", "src_domain", "dst_domain")


def sharing(mine: DataFrame, others: DataFrame, most: int = 500, once: bool = False) -> DataFrame:
    """``id, other, shared``: how many ``dst`` a row's ``id`` of ``mine`` (``id, dst``) and an ``other`` of ``others`` (``other, dst``) share; both hold distinct rows.

    A target of more than ``most`` others is salted: its others are spread over so many parts, and ``mine`` goes to each, so no task meets all pairs of a hub. ``once`` tells each pair in one direction only.
    """
    parts = others.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    spread = others.join(parts, "dst").select("other", "dst", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("salt"))
    each = mine.join(parts, "dst").select("id", "dst", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return each.join(spread, ["dst", "salt"]).where("id < other" if once else "id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("shared"))


def jaccard(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id, other, shared, score``: similarity of the seeds' dependency sets with those of all files; zero overlap is left out.

    Only files that share a dependency with a seed meet it; set sizes are pre-aggregated.
    """
    out = edges.select("src", "dst").distinct()
    size = out.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    mine = out.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("id"), "dst")
    shared = sharing(mine, out.select(F.col("src").alias("other"), "dst"))
    return (
        shared.join(size.select(F.col("src").alias("id"), F.col("n").alias("n1")), "id")
        .join(size.select(F.col("src").alias("other"), F.col("n").alias("n2")), "other")
        .select("id", "other", "shared", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("score"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    """``id, fan_in, fan_out`` over distinct edges."""
    once = edges.select("src", "dst").distinct()
    ends = once.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(once.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def adjacency_bitmaps(edges: DataFrame) -> DataFrame:
    """``src, bucket, bits``: each node's dependencies as bitmaps of fixed size, one row per bucket of ids."""
    place = F.col("dst") + 1
    return edges.groupBy("src", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def bitmap_counts(bitmaps: DataFrame) -> DataFrame:
    """``src, n``: how many bits each node's bitmaps hold."""
    return bitmaps.groupBy("src").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``src, dst, change``: the symmetric difference of two edge sets."""
    sides = old.select("src", "dst", F.lit(-1).alias("s")).distinct().unionByName(new.select("src", "dst", F.lit(1).alias("s")).distinct())
    return sides.groupBy("src", "dst").agg(F.sum("s").alias("s")).where("s <> 0").select("src", "dst", F.when(F.col("s") > 0, "added").otherwise("removed").alias("change"))
