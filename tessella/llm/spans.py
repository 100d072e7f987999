"""Long spans that stand letter for letter in more than one record, by level-wise doubling of repeated windows."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.skew import HEAVY_SHARE, look_up
from tessella.storage import materialize

#: Characters hashed at once; a longer text is taken in pieces that overlap by one span.
PIECE = 1 << 20
#: Offsets tried between a window of half the span and one of the span, less this step.
STEP = 16
#: The records that share a window are told in all pairs up to this number, else each against the first; the classes tell all of them.
PAIRS = 1_000
#: Exact copies of one text are told in all pairs up to this number, else each against the first.
COPIES = 64
#: Bits of the fixed-size filter that keeps records without a candidate from being shuffled.
FILTER_BITS = 1 << 24

_BASE = 0x9E3779B97F4A7C15  # odd, and 5 modulo 8: its powers repeat only after 2^62 places
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, 1 << 64))
        more = min(size, n - size)
        out[size : size + more] = out[:more] * step
        size += more
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Rolling hashes of code points; every window of a piece in a handful of array operations."""

    def __init__(self) -> None:
        base = _BASE & ~7 | 5
        size = PIECE + 1
        self.power = _powers(base, size)
        self.inverse = _powers(pow(base, -1, 1 << 64), size)
        self.letters = _mix(np.arange(1, 1 << 16 | 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        value = self.letters[codes & np.uint32(0xFFFF)] + (codes >> np.uint32(16)).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        out = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(value * self.power[: len(codes)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the windows of ``width`` at the places ``at``, or at every place."""
        if at is None:
            n = len(prefix) - width
            return _mix((prefix[width:] - prefix[:n]) * self.inverse[:n])
        return _mix((prefix[at + width] - prefix[at]) * self.inverse[at])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in three passes."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(hasher: Hasher, texts: list[str], width: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of windows of ``width`` chosen by content, so that each stretch of ``span`` characters holds one.

    Of all windows within a stretch the one of least hash is chosen, the last of equals; two texts that share the stretch
    thus share the choice. About two windows in ``span - width`` places are kept.
    """
    near = span - width + 1
    low = np.uint64(PIECE - 1)
    docs, places, hashes = [], [], []
    batch: list[tuple[int, int, np.ndarray]] = []

    def work() -> None:
        codes = np.concatenate([c for *_, c in batch])
        sizes = np.array([len(c) for *_, c in batch])
        prefix = hasher.prefix(codes)
        h = hasher.windows(prefix, width)
        key = (h & ~low) | (low - (np.arange(len(h), dtype=np.uint64) & low))
        least = _smallest(key, near)
        ends = np.cumsum(sizes)
        inside = np.ones(len(least), dtype=bool)
        for e in ends[:-1]:  # windows of places that would reach over the end of a text
            inside[max(0, e - span + 1) : e] = False
        chosen = np.unique((low - (least[inside] & low)).astype(np.int64))
        which = np.searchsorted(ends, chosen, side="right")
        starts = ends - sizes
        names = np.array([d for d, *_ in batch])
        shift = np.array([o for _, o, _ in batch])
        docs.append(names[which])
        places.append(chosen - starts[which] + shift[which])
        hashes.append(h[chosen])
        batch.clear()

    held = 0
    for i, t in enumerate(texts):
        if t is None or len(t) < span:
            continue
        codes = code_points(t)
        for o in range(0, max(1, len(codes) - span + 1), PIECE - span):
            piece = codes[o : o + PIECE]
            if len(piece) < span:
                break
            if held and held + len(piece) > PIECE:
                work()
                held = 0
            batch.append((i, o, piece))
            held += len(piece)
    if batch:
        work()
    if not docs:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    d, p, h = np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)
    once = np.unique(np.stack([d, p]), axis=1, return_index=True)[1] if len(texts) and max(map(len, filter(None, texts)), default=0) > PIECE else slice(None)
    return d[once], p[once], h[once]


def _rows(docs, places, hashes) -> pd.DataFrame:
    return pd.DataFrame({"h": hashes.astype(np.uint64).view(np.int64), "doc": docs, "at": places.astype(np.int32)})


_ROW = "h long, doc long, at int"


def first_windows(docs: DataFrame, width: int, span: int) -> DataFrame:
    """``h, doc, at``: the chosen windows of all records, see :func:`anchors`."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            i, at, h = anchors(hasher, batch["text"].tolist(), width, span)
            yield _rows(batch["doc"].to_numpy()[i], at, h)

    return docs.mapInPandas(choose, _ROW)


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose window occurs in more than one record.

    Counting combines before the shuffle; windows that own a large share of the rows, at most ``1/HEAVY_SHARE``, are looked up by
    broadcast, all others by a shuffled join.
    """
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("h", "n")
    known = materialize(counts, "repeated-windows")
    total = known.agg(F.sum("n")).head()[0] or 0
    limit = max(1000, total * HEAVY_SHARE)
    heavy = F.broadcast(known.where(F.col("n") >= limit).limit(int(1 / HEAVY_SHARE)).select("h"))
    return rows.join(heavy, "h", "left_semi").unionByName(rows.join(heavy, "h", "left_anti").join(known.where(F.col("n") < limit).select("h"), "h", "left_semi"))


def _holding(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The records named in ``marked`` and, rarely, others: a filter of fixed size, applied before any shuffle."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = (
        marked.select(place("doc").alias("__p"))
        .groupBy(F.bitmap_bucket_number("__p").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__bits"))
    )
    hit = F.expr("(cast(conv(hex(substring(__bits, cast(bitmap_bit_position(__p) div 8 as int) + 1, 1)), 16, 10) as int) >> cast(bitmap_bit_position(__p) % 8 as int)) & 1") == 1
    return docs.withColumn("__p", place("doc")).withColumn("__bucket", F.bitmap_bucket_number("__p")).join(F.broadcast(bits), "__bucket").where(hit).drop("__p", "__bucket", "__bits")


def _with_places(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``doc, text, places``: each record with its surviving places. One record's places are bounded by its text."""
    return texts.join(rows.groupBy("doc").agg(F.collect_set("at").alias("places")), "doc")


def _extended(held: DataFrame, per_text) -> DataFrame:
    """``h, doc, at, first`` of the windows that ``per_text(length, places)`` gives for each record; ``first`` marks one place of each window in a record."""

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            out: list[tuple] = []
            for doc, text, places in zip(batch["doc"], batch["text"], batch["places"]):
                codes, at = code_points(text), np.sort(np.asarray(places, dtype=np.int64))
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for o in range(0, max(1, len(codes)), PIECE // 2):
                    mine = at[(at >= o) & (at < o + PIECE // 2)]
                    if len(mine):
                        low = max(0, o - PIECE // 8)
                        piece = codes[low : o + PIECE // 2 + PIECE // 8]
                        starts, width = per_text(len(piece), mine - low)
                        starts = np.unique(starts)
                        found.append((starts + low, hasher.windows(hasher.prefix(piece), width, starts)))
                if found:
                    starts, h = (np.concatenate(x) for x in zip(*found))
                    once = np.unique(starts, return_index=True)[1] if len(found) > 1 else slice(None)
                    starts, h = starts[once], h[once]
                    first = np.zeros(len(h), dtype=bool)
                    first[np.unique(h, return_index=True)[1]] = True
                    out.append((np.full(len(starts), doc), starts, h, first))
            if out:
                docs, places, hashes, firsts = (np.concatenate(x) for x in zip(*out))
                yield _rows(docs, places, hashes).assign(first=firsts)

    return held.mapInPandas(extend, f"{_ROW}, first boolean")


def _doubled(width: int):
    """Both ways to extend a window to twice its length within the text."""

    def starts(n: int, at: np.ndarray) -> tuple[np.ndarray, int]:
        both = np.concatenate([at, at - width])
        return both[(both >= 0) & (both + 2 * width <= n)], 2 * width

    return starts


def _stepped(width: int, span: int, step: int):
    """The windows of ``span - step`` around a window of ``width``, at multiples of ``step`` before it."""

    def starts(n: int, at: np.ndarray) -> tuple[np.ndarray, int]:
        size = span - step
        every = (at[:, None] - np.arange(0, size - width + 1, step)).ravel()
        return every[(every >= 0) & (every + size <= n)], size

    return starts


def _full(span: int, step: int):
    """All windows of ``span`` around a window of ``span - step``."""

    def starts(n: int, at: np.ndarray) -> tuple[np.ndarray, int]:
        every = (at[:, None] - np.arange(step + 1)).ravel()
        return every[(every >= 0) & (every + span <= n)], span

    return starts


def copies(docs: DataFrame, span: int = 320) -> DataFrame:
    """``doc, first, copies, n`` of the records of at least ``span`` characters whose text occurs more than once: the least of them, their number and length.

    Texts with a great share of the copies, at most ``1/HEAVY_SHARE`` of them, are looked up by broadcast, all others by a shuffled join.
    """
    prints = docs.select("doc", F.length("text").alias("n"), F.sha2("text", 256).alias("print"))
    groups = prints.groupBy("print").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return materialize(look_up(prints, "print", materialize(groups, "span-copies"), "copies").select("doc", "first", "copies", "n"), "span-members")


@dataclass(frozen=True)
class Shared:
    """What :func:`shared_windows` finds; copies but the least of each text have no windows of their own.

    ``rows``: ``h, doc, at, first``, all windows that may be shared. ``sets``: those that are, ``h, records, x, doc, at``: how many texts hold a window, a digest
    of which, and its place in the least of them.
    """

    span: int
    members: DataFrame
    rows: DataFrame
    sets: DataFrame

    def windows(self) -> DataFrame:
        """``h, doc, at`` of the shared windows at all their places."""
        return look_up(self.rows.select("h", "doc", "at"), "h", self.sets.select("h", "records"), "records").drop("records")

    def classes(self) -> DataFrame:
        """``first, first_at, doc, records``: the sets of texts that share windows, one row per set and text.

        Windows shared by the same texts are one class, named by the first of its windows in its least record. The rows grow with the records, not with
        their pairs, however many share a window.
        """
        led = self.sets.groupBy("records", "x", F.col("doc").alias("first")).agg(F.min("at").alias("first_at"), F.min_by("h", "at").alias("h"))
        return look_up(self.rows.where("first").select("h", "doc"), "h", materialize(led.drop("x"), "span-classes"), "records").select("first", "first_at", "doc", "records")

    def pairs(self) -> DataFrame:
        """``doc_1, doc_2``: every two different texts that share a span, and the copies.

        Beyond ``PAIRS`` texts in a class, or ``COPIES`` copies of a text, each is paired with the first only; :meth:`classes` and ``members`` hold the rest of
        those links. What holds for a text holds for each of its copies, up to that number.
        """
        held = materialize(self.classes(), "span-held")
        small = held.where(F.col("records") <= PAIRS)
        place = ["first", "first_at"]
        pairs = small.select(*place, F.col("doc").alias("a")).join(small.select(*place, F.col("doc").alias("b")), place).where("a < b").select("a", "b")
        pairs = pairs.unionByName(held.where((F.col("records") > PAIRS) & (F.col("doc") != F.col("first"))).select(F.col("first").alias("a"), F.col("doc").alias("b"))).distinct()
        some = self.members.where(F.col("copies") <= COPIES)
        spread = some.select(F.col("first").alias("__f"), F.col("doc").alias("__d"))
        for side in ("a", "b"):
            pairs = pairs.join(spread, F.col(side) == F.col("__f"), "left").withColumn(side, F.coalesce("__d", side)).drop("__f", "__d")
        inside = some.select("first", F.col("doc").alias("a")).join(some.select("first", F.col("doc").alias("b")), "first").where("a < b").select("a", "b")
        star = self.members.where((F.col("copies") > COPIES) & (F.col("doc") != F.col("first"))).select(F.col("first").alias("a"), F.col("doc").alias("b"))
        return pairs.select(F.least("a", "b").alias("doc_1"), F.greatest("a", "b").alias("doc_2")).unionByName(inside.unionByName(star).toDF("doc_1", "doc_2"))

    def stretches(self) -> DataFrame:
        """``doc, low, high``: the places that are found elsewhere; they may overlap. A text that has copies is found whole."""
        whole = self.members.select("doc", F.lit(0).alias("low"), F.col("n").alias("high"))
        parts = self.windows().select("doc", F.col("at").alias("low"), (F.col("at") + self.span).alias("high"))
        return parts.join(self.members.select("doc"), "doc", "left_anti").unionByName(whole)

    def lengths(self) -> DataFrame:
        """``doc, length``: the longest of the span, twice the span, four times the span ... that a text shares.

        Doubling goes on beyond the span: two windows that meet in a record are one of twice the length, and those that repeat again go on until none survives.
        The hash of the longer window is that of its halves, so no text is read again.
        """
        level, width = materialize(self.windows(), "span-level"), self.span
        told = [level.select("doc").distinct().withColumn("length", F.lit(width))]
        while True:
            after = level.select("doc", (F.col("at") - width).alias("at"), F.col("h").alias("h2"))
            twice = materialize(level.join(after, ["doc", "at"]).select(F.xxhash64("h", "h2").alias("h"), "doc", "at"), "span-twice")
            level, width = materialize(repeated(twice), "span-level"), 2 * width
            if level.head() is None:
                break
            told.append(level.select("doc").distinct().withColumn("length", F.lit(width)))
        copied = self.members.select("doc", (F.lit(self.span) * F.pow(F.lit(2), F.floor(F.log2(F.col("n") / self.span) + 1e-9))).cast("int").alias("length"))
        return functools.reduce(DataFrame.unionByName, [*told, copied]).groupBy("doc").agg(F.max("length").alias("length"))


def shared_windows(docs: DataFrame, span: int = 320) -> Shared:
    """All windows of ``span`` characters that stand letter for letter in more than one text.

    Levels: windows of a quarter of the span, chosen by content so that no shared span is without one; those repeated in another record are
    extended to twice the length on either side; those repeated again to nearly the span, then to every window of the span around. What repeats at a length alone
    goes on to the next. Exact copies are found first and the least of them stands for all. ``docs`` has ``doc`` (unique) and ``text``; null and shorter texts share
    nothing; every place of every text is read. Windows are compared by 64-bit hashes at four lengths in turn.
    """
    quarter = span // 4
    given = docs.where(F.col("doc").isNotNull() & (F.length("text") >= span)).select(F.col("doc").cast("long").alias("doc"), "text")
    members = copies(given, span)
    rows = materialize(first_windows(given, quarter, span), "span-windows").join(members.where("doc <> first").select("doc"), "doc", "left_anti")
    level = repeated(rows)
    texts = materialize(_with_places(_holding(given, level), level), "span-texts")
    extended = lambda held, how, name: repeated(materialize(_extended(held, how), name))
    level = extended(texts, _doubled(quarter), "span-windows-2")
    body = texts.select("doc", "text")
    level = extended(_with_places(body, level), _stepped(2 * quarter, span, STEP), "span-windows-3")
    rows = materialize(_extended(_with_places(body, level), _full(span, STEP)), "span-windows-4")
    of = lambda c: F.when(F.col("first"), c)
    sets = rows.groupBy("h").agg(F.count(of(F.lit(1))).alias("records"), F.bit_xor(of(F.xxhash64("doc"))).alias("x"), F.min("doc").alias("doc"), F.min_by("at", of(F.col("doc"))).alias("at")).where("records > 1")
    return Shared(span, members, rows, materialize(sets, "span-sets"))


def shared_share(shared: Shared, docs: DataFrame) -> DataFrame:
    """``doc, n_chars, shared_chars, share`` of every record: how much of it lies in spans found elsewhere. Null and empty texts share 0."""
    line = Window.partitionBy("doc").orderBy("low", "high")
    ahead = shared.stretches().withColumn("reach", F.max("high").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    covered = ahead.withColumn("new", F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.coalesce("reach", F.lit(0))))).groupBy("doc").agg(F.sum("new").alias("shared_chars"))
    sizes = docs.select(F.col("doc").cast("long").alias("doc"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    return sizes.join(covered, "doc", "left").select(
        "doc", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("share")
    )
