"""Assigning files to domains: path seeds, neighbour vote, declared globs, and communities of the graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.structure import glob_pattern
from tessella.storage import materialize

#: Path words that tell a domain, in order of preference.
SEEDS: dict[str, tuple[str, ...]] = {
    "AUTH": ("auth", "login", "logout", "signin", "signup", "oauth", "jwt", "session", "password", "credential"),
    "PAYMENTS": ("payment", "payments", "billing", "stripe", "invoice", "subscription", "checkout"),
    "TRPC": ("trpc", "procedure"),
    "DATABASE": ("prisma", "drizzle", "migration", "migrations", "sqlalchemy"),
    "EVENTS": ("webhook", "webhooks", "queue", "worker", "cron"),
    "NOTIFICATIONS": ("notification", "notifications", "mailer", "sms"),
}
CORE = "CORE"


def seed_pattern(words: Sequence[str]) -> str:
    """A word counts as a whole path segment, or at the start or end of one, never inside another word."""
    one = "|".join(words)
    return f"/(?:{one})[/._-]|[_-](?:{one})\\."


def seeded(path: Column, seeds: Mapping[str, Sequence[str]] = SEEDS) -> Column:
    """The first domain one of whose words the path tells, else null."""
    lower = F.lower(path)
    return F.coalesce(*[F.when(lower.rlike(seed_pattern(words)), F.lit(name)) for name, words in seeds.items()], F.lit(None).cast("string"))


def vote(edges: DataFrame, seeds: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """``id, domain, votes`` of unseeded files whose seeded neighbours agree: ``least`` votes, more than any other domain, at least ``share``.

    Neighbours are counted in both directions with multiplicity. Voted files do not vote, so one join settles it, in any order.
    """
    known = seeds.where("domain is not null").select(F.col("id").alias("n"), "domain")
    ways = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("n")))
    counts = ways.join(known, "n").groupBy("id", "domain").agg(F.count(F.lit(1)).alias("votes"))
    sums = counts.groupBy("id").agg(F.sum("votes").alias("total"), F.max("votes").alias("top"), F.max_by("domain", F.struct("votes", F.col("domain"))).alias("domain"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("votes") * F.col("votes")).alias("sq"))
    ties = counts.join(sums.select("id", "top"), "id").where("votes = top").groupBy("id").agg(F.count(F.lit(1)).alias("ties"))
    won = sums.join(ties, "id").where((F.col("ties") == 1) & (F.col("top") >= least) & (F.col("top") / F.col("total") >= share))
    return won.join(known.select(F.col("n").alias("id")).distinct(), "id", "left_anti").select("id", "domain", F.col("top").alias("votes"))


def assign(files: DataFrame, edges: DataFrame, seeds: Mapping[str, Sequence[str]] = SEEDS, globs: Mapping[str, Sequence[str]] | None = None, anchors: Mapping[str, str] | None = None) -> DataFrame:
    """``id, domain, confidence`` for every file: declared anchors and globs 1.0, path seeds 0.9, votes 0.5, else CORE at 0.2."""
    path = F.col("path")
    declared = F.lit(None).cast("string")
    for name, patterns in reversed(list((globs or {}).items())):
        test = F.lit(False)
        for g in patterns:
            test = test | path.rlike(glob_pattern(g))
        declared = F.when(test, name).otherwise(declared)
    for file, name in (anchors or {}).items():
        declared = F.when(path == file, name).otherwise(declared)
    told = files.select("id", declared.alias("declared"), seeded(path, seeds).alias("domain"))
    voted = vote(edges, told).select("id", F.col("domain").alias("voted"))
    return told.join(voted, "id", "left").select(
        "id",
        F.coalesce("declared", "domain", "voted", F.lit(CORE)).alias("domain"),
        F.when(F.col("declared").isNotNull(), 1.0).when(F.col("domain").isNotNull(), 0.9).when(F.col("voted").isNotNull(), 0.5).otherwise(0.2).alias("confidence"),
    )


def cluster_names(rows: DataFrame, name: str, otherwise: str, seeds: Mapping[str, Sequence[str]] = SEEDS) -> DataFrame:
    """``domain, n``: rows by the first domain one of whose words their name holds anywhere; null names are left out."""
    lower = F.lower(F.col(name))
    told = F.coalesce(*[F.when(lower.rlike("|".join(words)), F.lit(domain)) for domain, words in seeds.items()], F.lit(otherwise))
    return rows.where(F.col(name).isNotNull()).groupBy(told.alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def strategy(files: int, edges: int) -> dict:
    """Keywords for few files or a sparse graph, else communities with their resolution and least size."""
    if files < 100 or edges / files < 1.5:
        return {"kind": "keyword"}
    return {"kind": "graph", "gamma": min(0.10, 0.02 + 0.02 * log10(files / 10)), "least": max(5, min(20, round(sqrt(files))))}


def merge_small(assigned: DataFrame, least: int) -> DataFrame:
    """``id, domain`` with domains of fewer than ``least`` files sent to CORE."""
    sizes = assigned.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return assigned.join(sizes, "domain").select("id", F.when(F.col("n") < least, CORE).otherwise(F.col("domain")).alias("domain"))


def largest_share(assigned: DataFrame) -> DataFrame:
    """One row ``domain, share``: the largest domain; a share above 0.7 means the resolution is too low."""
    counts = assigned.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("domain", F.struct("n", F.col("domain"))).alias("domain"), (F.max("n") / F.sum("n")).alias("share"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the least id reachable over undirected edges, by min-label spreading with pointer jumping, until no label falls."""
    ways = materialize(edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("n")).unionByName(edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("n"))).distinct(), "component-ways")
    label = materialize(nodes.select("id", F.col("id").alias("component")), "component-labels")
    while True:
        near = ways.join(label.select(F.col("id").alias("n"), "component"), "n").groupBy("id").agg(F.min("component").alias("c"))
        lower = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("was"))
        jump = lower.join(lower.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"), "was")
        after = materialize(jump, "component-labels")
        label = after.select("id", "component")
        if after.where("component <> was").head() is None:
            break
    return label


_BLOCK = 1 << 23  # ways that one task may hold


def _move(of: list[int], starts: list[int], ends: np.ndarray, gamma: float, passes: int) -> bool:
    """Moves one node after the other to its best neighbouring community in ``of`` until none can gain; False if they still can after so many passes."""
    size = [0] * len(of)
    for c in of:
        size[c] += 1
    due, whole = range(len(of)), True
    for _ in range(passes):
        touched: set[int] = set()
        for v in due:
            home = of[v]
            near = ends[starts[v] : starts[v + 1]].tolist()
            ties: dict[int, int] = {}
            for n in near:
                c = of[n]
                ties[c] = ties.get(c, 0) + 1
            best, to = max(0.0, round(ties.get(home, 0) - gamma * (size[home] - 1), 9)), home
            for c, k in ties.items():
                if c != home and ((g := round(k - gamma * size[c], 9)) > best or (g == best and to != home and c < to)):
                    best, to = g, c
            if to != home:
                size[home] -= 1
                size[to] += 1
                of[v] = to
                touched.update(n for n in near if of[n] != to)
        if not touched and whole:
            return True
        # a community that shrank may draw nodes that met no moved node, so the last pass is over all
        due, whole = (sorted(touched), False) if touched else (range(len(of)), True)
    return False


def _parts(of: list[int], starts: list[int], ends: np.ndarray) -> tuple[list[int], bool]:
    """The least node of each node's connected part of its community, and whether a community had more than one."""
    part, seen = [-1] * len(of), set()
    several = False
    for v in range(len(of)):
        if part[v] >= 0:
            continue
        several |= of[v] in seen
        seen.add(of[v])
        part[v], line = v, [v]
        while line:
            x = line.pop()
            for n in ends[starts[x] : starts[x + 1]].tolist():
                if part[n] < 0 and of[n] == of[v]:
                    part[n] = v
                    line.append(n)
    return part, several


def _settle(block: pa.Table, gamma: float, passes: int) -> pa.Table:
    """Local moving among the communities of a block; rows are its nodes (``n`` null) and its ways."""
    ids, n, label = (block[c].combine_chunks() for c in ("id", "n", "community"))
    members = n.is_null().to_numpy(zero_copy_only=False)
    ids, label = ids.to_numpy(), label.to_numpy(zero_copy_only=False)
    order = np.argsort(ids[members])
    nodes, of = ids[members][order], label[members][order]
    src, dst = (np.searchsorted(nodes, c) for c in (ids[~members], n.drop_null().to_numpy()))
    order = np.lexsort((dst, src))
    ends = dst[order].astype(np.int32)
    starts = np.searchsorted(src[order], np.arange(len(nodes) + 1)).tolist()
    now = np.unique(of, return_inverse=True)[1].tolist()
    settled, several = False, True
    while several:  # parts are fewer nodes without ties, so a split gains as well, and moving goes on from there
        settled = _move(now, starts, ends, gamma, passes)
        now, several = _parts(now, starts, ends)
        if not settled:
            break
    return pa.table({"id": nodes, "community": nodes[now], "settled": np.full(len(nodes), settled)})


def communities(nodes: DataFrame, edges: DataFrame, gamma: float, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """``id, community``: local moving under the constant Potts model, in connected parts; labels are the least id of a part.

    A node moves to the neighbouring community of greatest gain ``edges - gamma * size``, if it exceeds that of staying. In each round the communities from or
    to which nodes can gain are dealt to blocks, whole with all their nodes, and each block moves its nodes one by one among its own communities until none can
    gain, and splits those that are not connected. So sizes are exact, each move makes the whole better, and nodes don't swap. What fits a task is one block; else
    blocks are ranges of labels in the first round and drawn by hash then. It ends when no node of all can gain; RuntimeError tells that nodes can still gain after
    ``rounds`` rounds, or passes of a block. The same seed gives the same result.
    """

    def settle(block: pa.Table) -> pa.Table:
        return _settle(block, gamma, rounds)

    ways = edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("n")).unionByName(edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("n"))).distinct()
    known = nodes.select(F.col("id").cast("long").alias("id"))
    ways = materialize(ways.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "n"), "n", "left_semi").select(F.col("id").cast("long").alias("id"), F.col("n").cast("long").alias("n")), "community-ways")
    label = materialize(known.select("id", F.col("id").alias("community")), "community-labels")
    for r in range(rounds):
        at_n = label.select(F.col("id").alias("n"), F.col("community").alias("there"))
        both = ways.join(label, "id").join(at_n, "n").select("id", "n", "community", "there")
        if r == 0:
            held, many = label.select("community").distinct(), ways.count()
        else:
            sizes = label.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
            ties = both.groupBy("id", F.col("community").alias("home"), F.col("there").alias("community")).agg(F.count(F.lit(1)).alias("k")).join(sizes, "community")
            own = F.col("community") == F.col("home")
            gain = F.round(F.col("k") - gamma * (F.col("size") - F.when(own, 1).otherwise(0)), 9)
            best = ties.withColumn("gain", gain).groupBy("id", "home").agg(F.max_by("community", F.struct("gain", -F.col("community"))).alias("to"), F.max("gain").alias("g"), F.max(F.when(own, F.col("gain"))).alias("stay"))
            gains = materialize(best.where(F.col("g") > F.greatest(F.lit(0.0), F.coalesce("stay", F.lit(0.0)))).select("home", "to"), "community-gains")
            if gains.head() is None:
                return label
            held = gains.select(F.explode(F.array("home", "to")).alias("community")).distinct()
            many = both.join(held, "community", "left_semi").count()
        blocks = max(1, -(-many // _BLOCK))
        if blocks == 1:
            block = F.lit(0)
        elif r == 0:
            cuts = sorted(set(ways.agg(F.percentile_approx("id", [k / blocks for k in range(1, blocks)], 100 * blocks)).head()[0]))
            block = sum((F.when(F.col("community") >= int(c), 1).otherwise(0) for c in cuts), F.lit(0))
        else:
            block = F.pmod(F.xxhash64("community", F.lit(seed * 1000 + r)), F.lit(blocks)).cast("int")
        held = held.select("community", block.cast("int").alias("block"))
        inner = both.join(held, "community").join(held.select(F.col("community").alias("there"), F.col("block").alias("other")), "there").where("block = other").select("block", "id", "n", "community")
        rows = label.join(held, "community").select("block", "id", F.lit(None).cast("long").alias("n"), "community").unionByName(inner)
        moved = materialize(rows.groupBy("block").applyInArrow(settle, "id long, community long, settled boolean"), "community-moved")
        if moved.where("not settled").head() is not None:
            break
        label = materialize(label.join(moved.select("id", F.col("community").alias("now")), "id", "left").select("id", F.coalesce("now", "community").alias("community")), "community-labels") if r else moved.select("id", "community")
    raise RuntimeError(f"nodes can still gain after {rounds} rounds of local moving")


def community_names(assigned: DataFrame, files: DataFrame, generic: Sequence[str] = ("src", "lib", "app", "apps", "packages", "services", "main", "index", "tests", "test", "core", "common", "shared", "utils")) -> DataFrame:
    """``community, name``: the seed domain most of its paths tell, else its most frequent telling folder in upper case, else CORE."""
    rows = assigned.join(files.select("id", "path"), "id")
    by_seed = rows.withColumn("d", seeded(F.col("path"))).where("d is not null").groupBy("community", "d").agg(F.count(F.lit(1)).alias("n"))
    folders = rows.select("community", F.explode(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))).alias("d")).where(~F.lower("d").isin(*generic) & (F.col("d") != ""))
    by_folder = folders.groupBy("community", F.upper("d").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    pick = lambda c, name: c.groupBy("community").agg(F.max_by("d", F.struct("n", F.col("d"))).alias(name))
    return assigned.select("community").distinct().join(pick(by_seed, "a"), "community", "left").join(pick(by_folder, "b"), "community", "left").select("community", F.coalesce("a", "b", F.lit(CORE)).alias("name"))


def top_assignment(assignments: DataFrame) -> DataFrame:
    """``id, domain, confidence``: each file's assignment of greatest confidence; the least domain wins a tie."""
    line = Window.partitionBy("id").orderBy(F.desc("confidence"), "domain")
    return assignments.withColumn("__r", F.row_number().over(line)).where("__r = 1").select("id", "domain", "confidence")
