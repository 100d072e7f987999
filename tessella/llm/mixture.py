"""Mixing sources to target weights by balanced sampling (cube method)."""

from __future__ import annotations

import base64
import functools
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.rows import latest
from tessella.operators.skew import look_up, present_in
from tessella.storage import materialize

#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: One task moves the probabilities of so many documents.
BLOCK = 20_000


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without ``text`` but with ``tokens``: the length of the whole text in tokens of a public tokenizer; null counts 0."""
    path = f"{tokenizers}/{vocabulary}"
    keep = [f for f in docs.schema.fields if f.name not in (text, "tokens")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["tokens long"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            out = batch[[f.name for f in keep]].copy()
            out["tokens"] = [len(encode(t)) if t else 0 for t in batch[text]]
            yield out

    return docs.select(*[f.name for f in keep], text).mapInPandas(count, schema)


def plan(totals: DataFrame, targets: DataFrame, total_tokens: float | None = None, short: str = "shrink") -> DataFrame:
    """What each target source gives: ``source, target_share, max_repeats, held_tokens, held_documents, share, target_tokens, quota, reachable, whole, part``.

    ``totals``: ``source, tokens, documents``; ``targets``: ``source, target_share, max_repeats``. The mixture has at most ``total_tokens`` tokens, by default as many as the
    targeted sources hold. ``short`` says what happens where a source cannot reach its share even when every document is used ``max_repeats`` times:
    ``shrink`` - the mixture gets the greatest size at which every source has its share; ``give`` - the size stays, the source gives all it may and is told as not reachable.
    Sources without tokens or repeats, or with a share of zero or less, give nothing; ``share`` is the target among the others, summing to one. ``whole`` copies of every document and ``part`` of
    one more make up the quota.
    """
    if short not in ("shrink", "give"):
        raise ValueError("short must be shrink or give")
    most = F.coalesce("tokens", F.lit(0)) * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    aims = targets.join(totals, "source", "left").select(
        "source", "target_share", F.coalesce("max_repeats", F.lit(0)).cast("long").alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("held_tokens"), F.coalesce("documents", F.lit(0)).alias("held_documents"),
        most.cast("double").alias("most"), F.when((most > 0) & (F.col("target_share") > 0), F.col("target_share")).otherwise(0.0).alias("weight"),
    )
    weight, held, least = aims.agg(F.sum("weight"), F.sum("held_tokens"), F.min(F.when(F.col("weight") > 0, F.col("most") / F.col("weight")))).head()
    size = float(held or 0) if total_tokens is None else float(total_tokens)
    total = min(size, least * weight) if short == "shrink" and least is not None else size
    share = F.col("weight") / F.lit(float(weight or 1.0))
    wanted = share * total
    copies = F.when(F.col("held_tokens") > 0, F.col("quota") / F.col("held_tokens")).otherwise(0.0)
    whole = F.floor(copies + 1e-12)
    out = aims.select("*", share.alias("share"), wanted.alias("target_tokens"), F.least(wanted, F.col("most")).alias("quota"))
    return out.select(
        "source", "target_share", "max_repeats", "held_tokens", "held_documents", "share", "target_tokens", "quota", ((F.col("weight") > 0) & (F.col("quota") >= F.col("target_tokens") * (1 - 1e-9))).alias("reachable"),
        whole.cast("long").alias("whole"), F.greatest(copies - whole, F.lit(0.0)).alias("part"),
    )


def flight(prob: list[float], size: list[float], seed: str) -> list[float]:
    """The flight phase: probabilities move until at most two are neither 0 nor 1, and the sums of ``prob`` and ``prob*size`` stay.

    Three open units at a time have a direction in the null space of the two balances; along it the walk goes to a face of the cube,
    forward or back so that every expectation is kept.
    """
    rnd = random.Random(seed)
    p = list(prob)
    waiting = [i for i, x in enumerate(p) if 1e-9 < x < 1 - 1e-9][::-1]
    for i, x in enumerate(p):
        if not 1e-9 < x < 1 - 1e-9:
            p[i] = float(round(x))
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 2:
            break
        a, b, c = (held + [-1])[:3]
        if size[a] == size[b]:
            move = ((a, 1.0), (b, -1.0))
        elif c < 0:
            break
        elif size[a] == size[c]:
            move = ((a, 1.0), (c, -1.0))
        elif size[b] == size[c]:
            move = ((b, 1.0), (c, -1.0))
        else:
            move = ((a, size[b] - size[c]), (b, size[c] - size[a]), (c, size[a] - size[b]))
        ahead = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in move)
        back = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in move)
        step = ahead if rnd.random() * (ahead + back) < back else -back
        for i, u in move:
            x = p[i] + step * u
            p[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        held = [i for i in held if 0.0 < p[i] < 1.0]
    return p


def land(prob: list[float], size: list[float]) -> list[float]:
    """The landing: the few open units are rounded so that the token total, then the count, moves least."""
    p = list(prob)
    left = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    best = None
    for bits in range(1 << len(left)):
        chosen = [float(bits >> j & 1) for j in range(len(left))]
        off = (abs(sum((x - p[i]) * size[i] for x, i in zip(chosen, left))), abs(sum(x - p[i] for x, i in zip(chosen, left))), bits)
        if best is None or off < best[0]:
            best = (off, chosen)
    for x, i in zip(best[1] if best else [], left):
        p[i] = x
    return p


def _fly(docs: DataFrame, seed: int, last: bool) -> DataFrame:
    """One level: every block of a source flies by itself; on the last level each source is one block and lands."""

    def move(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        sizes = [float(x) for x in group["tokens"]]
        p = flight(list(group["p"]), sizes, f"{seed}/{group['source'].iloc[0]}/{group['block'].iloc[0]}/{last}")
        return group.assign(p=land(p, sizes) if last else p)

    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    return blocked.groupBy("source", "block").applyInPandas(move, "doc_id long, source string, tokens long, p double, blocks long, block long").drop("block")


@dataclass(frozen=True)
class Mixture:
    """``documents``: ``doc_id, source, tokens, copies`` of the documents used; ``aims``: the plan, one row per target."""

    documents: DataFrame
    aims: DataFrame

    def shares(self) -> DataFrame:
        """One row per target: what was planned and what came out; ``actual_share`` is of all tokens of the mixture."""
        sums = materialize(
            self.documents.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies")), "mixture-sums"
        )
        total = sums.agg(F.sum("tokens")).head()[0]
        told = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "copies", "most_copies")]
        actual = F.coalesce("tokens", F.lit(0)) / F.lit(float(total)) if total else F.lit(None).cast("double")
        return self.aims.drop("whole", "part").join(sums, "source", "left").select(*[c for c in self.aims.columns if c not in ("whole", "part")], *told, actual.alias("actual_share"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, block: int = BLOCK, tokenizers: str = TOKENIZERS, short: str = "shrink") -> Mixture:
    """A mixture in which every source has its share of the tokens, see :func:`plan`.

    Every document of a source is used ``whole`` times and, by balanced sampling, some once more, so that the source's token total and its document
    count come out as planned up to the landing of two documents. Documents without a target source, with a null source or id are not used; null and empty texts weigh
    nothing. The same input and seed give the same mixture. Repeated targets of one source: the greatest share holds. Any number of sources is taken; documents meet their
    source's plan by a join in which the plans of large sources, at most ``1/HEAVY_SHARE`` of them, are broadcast.
    """
    goals = materialize(latest(targets.where("source is not null and target_share is not null").select("source", F.col("target_share").cast("double"), "max_repeats"), ["source"]), "mixture-goals")
    # Texts are filtered where they are read: a join by source would send a third of them to one task.
    used = present_in(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "source", "text"), "source", goals, "source")
    counts = materialize(token_counts(used, tokenizers=tokenizers), "mixture-tokens")
    totals = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    aims = materialize(plan(totals, goals, total_tokens, short), "mixture-plan")
    planned = look_up(counts.select("doc_id", "source", "tokens"), "source", aims.where("quota > 0").select("source", "whole", F.col("part").alias("p"), "held_documents"), "held_documents")
    moving = planned.where("p > 0").select("doc_id", "source", "tokens", "p", F.ceil(F.col("held_documents") / block).alias("blocks"))
    most = math.ceil((aims.agg(F.max("held_documents")).head()[0] or 0) / block)
    done: list[DataFrame] = []
    while True:
        last = most <= 1
        moved = materialize(_fly(moving, seed, last), "mixture-flight")
        done.append(moved if last else moved.where("p in (0.0, 1.0)"))
        if last:
            break
        # At most two documents of a block are still open.
        moving = moved.where("p not in (0.0, 1.0)").withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
        most = math.ceil(2 * most / block)
    drawn = functools.reduce(DataFrame.unionByName, done)
    extra = drawn.select("doc_id", F.col("p").cast("long").alias("copies")).where("copies > 0")
    sure = planned.where("whole > 0").select("doc_id", F.col("whole").alias("copies"))
    copies = sure.unionByName(extra).groupBy("doc_id").agg(F.sum("copies").alias("copies"))
    return Mixture(counts.join(copies, "doc_id").select("doc_id", "source", "tokens", "copies"), aims)
