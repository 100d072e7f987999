"""Evaluation passages inside a training corpus: latent semantic retrieval, then checks on the words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of evaluation text that one pass over the corpus looks for; more are taken in blocks.
BLOCK_WORDS = 100_000
RANK = 24
PASSAGE = 24
#: Pairs of windows compared at once.
PAIRS_AT_ONCE = 1 << 14
#: So many of a passage's most specific words stand for its answer, and so many of them a rewording must hold (all, if the passage has fewer).
ANSWERS, HELD = 8, 3

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, case folded."""
    found = _WORD.findall(text) if text else []
    return " ".join(found).casefold().split(" ") if found else []


@dataclass(frozen=True)
class Latent:
    """A latent space over the items' vocabulary: ``vectors[w]`` is the weighted image of word w; the row after the last is any other word."""

    index: dict[str, int]
    vectors: np.ndarray
    norms: np.ndarray
    other: float
    idf: np.ndarray

    def ids(self, text: str | None) -> list[int]:
        get, other = self.index.get, len(self.index)
        return [get(w, other) for w in words(text)]


def _lines(texts, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """All word ids of a batch in one array, and the length of each text."""
    get, other = index.get, len(index)
    flat: list[int] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        ws = words(t)
        lengths[i] = len(ws)
        flat.extend([get(w, other) for w in ws])
    return np.array(flat, dtype=np.int64), lengths


def _sketch(ids: np.ndarray, lengths: np.ndarray, omega: np.ndarray, df: np.ndarray, out: np.ndarray) -> None:
    """Adds one batch to the document frequencies and to ``T'(T omega)``, T being the passage-term counts."""
    d = len(df)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = (np.arange(len(ids)) - starts) // PASSAGE
    known = np.flatnonzero(ids < d)
    if not len(known):
        return
    term, doc, passage = ids[known], doc[known], passage[known]
    df += np.bincount(np.unique(doc * d + term) % d, minlength=d)
    place = doc * (int(passage.max()) + 1) + passage
    heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    image = np.add.reduceat(omega[term], heads, axis=0)
    of = np.cumsum(np.r_[True, place[1:] != place[:-1]]) - 1
    order = np.argsort(term, kind="stable")
    sorted_term = term[order]
    firsts = np.flatnonzero(np.r_[True, sorted_term[1:] != sorted_term[:-1]])
    out[sorted_term[firsts]] += np.add.reduceat(image[of[order]], firsts, axis=0)


def fit(docs: DataFrame, text: str, item_texts: list[str | None], rank: int = RANK, seed: int = 11) -> Latent:
    """The latent space of TF-IDF passages of the whole corpus and the items, by a distributed randomised SVD.

    One pass over all documents gathers, per term of the items' vocabulary, its document frequency and its row of ``T'T omega`` for a random
    ``omega``; every partition adds up its passages and the partial sums meet in a shuffled aggregate, so the driver gets one row per term, however large the
    corpus. From the sketch the leading right singular vectors follow (Nystroem form of the range finder).
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in item_texts for w in words(t)})
    index = {w: i for i, w in enumerate(vocabulary)}
    d = len(vocabulary)
    width = max(1, min(rank + 8, d))
    omega = np.random.default_rng(seed).standard_normal((d, width))
    shared = spark.sparkContext.broadcast((index, omega))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, omega = shared.value
        df, out, n = np.zeros(len(omega), dtype=np.int64), np.zeros_like(omega), 0
        for batch in batches:
            n += len(batch)
            ids, lengths = _lines(batch["text"].tolist(), index)
            _sketch(ids, lengths, omega, df, out)
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-1, seen], "df": np.r_[n, df[seen]], "row": [None, *out[seen].tolist()]})

    parts = docs.select(F.col(text).alias("text")).mapInPandas(gather, "term int, df long, row array<double>")
    sums = parts.groupBy("term").agg(F.sum("df").alias("df"), *[F.sum(F.col("row")[i]).alias(f"c{i}") for i in range(width)]).toPandas()
    n_docs = int(sums.loc[sums["term"] < 0, "df"].sum())
    sums = sums[sums["term"] >= 0]
    df, sketch = np.zeros(d, dtype=np.int64), np.zeros((d, width))
    terms = sums["term"].to_numpy(dtype=np.int64)
    df[terms] = sums["df"].to_numpy(dtype=np.int64)
    sketch[terms] = sums[[f"c{i}" for i in range(width)]].to_numpy(dtype=float)
    # The items are passages too: their own words must have an image even if the corpus lacks them.
    ids, lengths = _lines(item_texts, index)
    _sketch(ids, lengths, omega, np.zeros(d, dtype=np.int64), sketch)
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    image = idf[:, None] * sketch
    core = omega.T @ sketch
    values, basis = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(initial=0), 0) * 1e-10
    left = np.linalg.svd(image @ (basis[:, good] / np.sqrt(values[good])), full_matrices=False)[0][:, :rank] if good.any() else np.zeros((d, 1))
    vectors = np.vstack([idf[:, None] * left, np.zeros((1, left.shape[1]))])
    return Latent(index, vectors, np.linalg.norm(vectors, axis=1), float(np.log(n_docs + 1) + 1), idf)


def _windows(ids: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of all windows of ``width`` words."""
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(ids)) - starts[doc]
    keep = np.flatnonzero(at + width <= lengths[doc])
    return doc[keep], keep


def _unit(vectors: np.ndarray, others: np.ndarray | float = 0.0) -> np.ndarray:
    """Rows scaled to length one, the words outside the vocabulary counting in the length; vanishing rows share a direction of their own."""
    total = np.sqrt((vectors**2).sum(axis=1) + others)
    tiny = total < 1e-9
    return np.hstack([vectors / np.where(tiny, 1.0, total)[:, None], tiny[:, None].astype(float)])


def _expand(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, position) for each position in [low, high) of each row, in pieces of bounded size."""
    sizes = high - low
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
        rows = np.repeat(np.arange(a, b), sizes[a:b])
        first = np.cumsum(sizes[a:b]) - sizes[a:b]
        for c in range(0, len(rows), PAIRS_AT_ONCE):
            part = np.arange(c, min(c + PAIRS_AT_ONCE, len(rows)))
            yield rows[part], low[rows[part]] + part - first[rows[part] - a]
        a = b


@dataclass(frozen=True)
class Query:
    """Distinct windows of the items: word ids (filled up with ``other`` where the item is shorter than the window), lengths, unit images, and the items of each.

    ``rare`` holds the places of the most specific words of each window, which stand for its answer.
    """

    ids: np.ndarray
    size: np.ndarray
    unit: np.ndarray
    rare: np.ndarray
    items: list[np.ndarray]

    @classmethod
    def of(cls, latent: Latent, items: list[tuple[int, str | None]], width: int, stride: int, least: int, answers: int) -> Query:
        other = len(latent.index)
        held: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            line = latent.ids(text)
            n = len(line)
            for a in sorted({*range(0, n - width + 1, stride), max(0, n - width)}) if n >= least else ():
                held.setdefault(tuple(line[a : a + width]), set()).add(name)
        lines = sorted(held)
        ids = np.full((len(lines), width), other, dtype=np.int64)
        for row, line in zip(ids, lines):
            row[: len(line)] = line
        size = np.array([len(x) for x in lines], dtype=np.int64)
        weight = np.r_[latent.idf, -1.0][ids]
        rare = np.argsort(-weight, axis=1, kind="stable")[:, :answers]
        image = latent.vectors[ids].sum(axis=1) if len(lines) else np.zeros((0, latent.vectors.shape[1]))
        return cls(ids, size, _unit(image), rare, [np.array(sorted(held[x]), dtype=np.int64) for x in lines])

    def answers(self) -> np.ndarray:
        """The ids of the specific words, ``other`` where a window has fewer."""
        return np.take_along_axis(self.ids, self.rare, axis=1)


class Buckets:
    """Cosine buckets: the sides of random planes on which a unit image lies, one bit each.

    Equal images have equal bits, whatever the rank. An item window so near to a plane that rounding might move it across is kept on both sides, so none of its equals is missed.
    """

    def __init__(self, unit: np.ndarray, bits: int = 20, seed: int = 3) -> None:
        self.planes = np.random.default_rng(seed).standard_normal((unit.shape[1], bits))
        self.bit = 1 << np.arange(bits, dtype=np.int64)
        side = unit @ self.planes
        codes, owners = [self.codes(side)], [np.arange(len(unit))]
        for row, plane in zip(*np.nonzero(np.abs(side) < 1e-6)):
            flipped = np.concatenate([c[o == row] for c, o in zip(codes, owners)]) ^ self.bit[plane]
            codes.append(flipped)
            owners.append(np.full(len(flipped), row))
        code, owner = np.concatenate(codes), np.concatenate(owners)
        order = np.lexsort((owner, code))
        self.code, self.owner = code[order], owner[order]

    def codes(self, side: np.ndarray) -> np.ndarray:
        return (side > 0) @ self.bit

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the item windows in the bucket of each image, as places of ``owner``."""
        code = self.codes(unit @ self.planes)
        return np.searchsorted(self.code, code, side="left"), np.searchsorted(self.code, code, side="right")


def near_windows(latent: Latent, query: Query, buckets: Buckets, ids: np.ndarray, lengths: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, query window) of the windows whose cosine to a query window of their bucket is at least ``least``.

    A window is passed over only if even the sum of the lengths of its words' images could not reach the bound beside its words
    outside the vocabulary. Work and memory follow the bucket's content, not the number of item windows.
    """
    width = query.ids.shape[1]
    if not len(query.ids) or not len(ids):
        return
    doc, start = _windows(ids, lengths, width)
    most = np.r_[0.0, np.cumsum(latent.norms[ids])]
    outside = np.r_[0, np.cumsum(ids == len(latent.index))]
    other = (outside[start + width] - outside[start]) * latent.other**2
    open_ = np.flatnonzero((most[start + width] - most[start]) ** 2 * (1 - least**2) + 1e-9 >= other * least**2)
    for at in range(0, len(open_), 4096):
        part = open_[at : at + 4096]
        unit = _unit(latent.vectors[ids[start[part][:, None] + np.arange(width)]].sum(axis=1), other[part])
        for w, place in _expand(*buckets.of(unit)):
            q = buckets.owner[place]
            near = np.einsum("ij,ij->i", unit[w], query.unit[q]) >= least
            if near.any():
                yield doc[part][w[near]], start[part][w[near]], q[near]


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about ``block_words`` words, each collected by itself; an id is read once."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.max("text").alias("text"))
    size = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).head()[0] or 0
    n = int(size // block_words) + 1
    for b in range(n):
        block = [(int(r["item_id"]), r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()]
        if block:
            yield sorted(block)


def leaked_runs(docs: DataFrame, items: DataFrame, run: int = 12, least: float = 0.98, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``item_id, doc_id`` where the document holds ``run`` consecutive words of the item.

    Every run of the items and every run of the documents is a passage in the latent space. A document's run that equals an item's has the same
    image, so the search in its cosine bucket finds it whatever the rank. A candidate must hold the run's most specific words at their places, and its longest common subsequence with
    the run must be the whole run. Null and short texts give nothing; ties and copies are all reported; ids occur once a pair.
    """
    spark = docs.sparkSession
    given = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for block in item_blocks(items, block_words):
        latent = fit(given, "text", [t for _, t in block])
        query = Query.of(latent, block, run, 1, run, ANSWERS)
        shared = spark.sparkContext.broadcast((latent, query, Buckets(query.unit)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            latent, query, buckets = shared.value
            answers = query.answers()
            for batch in batches:
                ids, lengths = _lines(batch["text"].tolist(), latent.index)
                names = batch["doc_id"].to_numpy()
                hits: set[tuple[int, int]] = set()
                for doc, start, q in near_windows(latent, query, buckets, ids, lengths, least):
                    answered = (ids[start[:, None] + query.rare[q]] == answers[q]).all(axis=1)
                    for n, s, w in zip(doc[answered].tolist(), start[answered].tolist(), q[answered].tolist()):
                        if common_subsequence(query.ids[w].tolist(), ids[s : s + run].tolist()) == run:
                            hits.update((i, int(names[n])) for i in query.items[w].tolist())
                if hits:
                    yield pd.DataFrame(sorted(hits), columns=["item_id", "doc_id"])

        found.append(given.mapInPandas(search, "item_id long, doc_id long"))
    if not found:
        return spark.createDataFrame([], "item_id long, doc_id long")
    return reduce(DataFrame.unionByName, found).distinct()


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one bit row a word of ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << i
    row = 0
    for x in a:
        seen = row | masks.get(x, 0)
        row = seen & (seen ^ (seen - ((row << 1) | 1)))
    return row.bit_count()


def paraphrased(docs: DataFrame, items: DataFrame, width: int = 24, stride: int = 3, shortest: int = 8, least: float = 0.5, share: float = 0.6, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``item_id, doc_id, cosine, common``: documents with a passage close to an item, reworded or not.

    The items' passages have ``width`` words and begin at every ``stride``; an item of ``shortest`` words or more that is shorter is one passage, shorter ones are not asked for. A
    document's passages begin at every word. A pair counts if the document's passage, widened by half the width on either side, holds ``HELD`` of the ``ANSWERS`` most specific words of the item's passage,
    which stand for its answer; if the cosine of their images is at least ``least``, by the images of the items' words alone: a new word has no image, and its idf is no measure of how far
    a rewording goes; and if the longest common subsequence of the widened passage and the item's covers ``share`` of the latter.

    As a part of the answer must be there, cosines are taken only around the places of a passage's most specific words, which an index of those words gives: nothing is lost by
    it, and no passage meets items it has no answer of. The passing place of greatest cosine is told.
    """
    spark = docs.sparkSession
    given = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "item_id long, doc_id long, cosine double, common double"
    found = []
    for block in item_blocks(items, block_words):
        latent = fit(given, "text", [t for _, t in block])
        shared = spark.sparkContext.broadcast((latent, Query.of(latent, block, width, stride, shortest, ANSWERS)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            latent, query = shared.value
            for batch in batches:
                ids, lengths = _lines(batch["text"].tolist(), latent.index)
                names = batch["doc_id"].to_numpy()
                best: dict[tuple[int, int], tuple[float, float]] = {}
                for n, q, cosine, common in close_passages(latent, query, ids, lengths, least, share):
                    for i in query.items[q].tolist():
                        pair = (i, int(names[n]))
                        best[pair] = max(best.get(pair, (0.0, 0.0)), (cosine, common))
                if best:
                    yield pd.DataFrame([(i, n, c, m) for (i, n), (c, m) in sorted(best.items())], columns=["item_id", "doc_id", "cosine", "common"])

        found.append(given.mapInPandas(search, schema))
    if not found:
        return spark.createDataFrame([], schema)
    union = reduce(DataFrame.unionByName, found)
    told = union.groupBy("item_id", "doc_id").agg(F.max(F.struct("cosine", "common")).alias("t"))
    return told.select("item_id", "doc_id", "t.cosine", "t.common")


def close_passages(latent: Latent, query: Query, ids: np.ndarray, lengths: np.ndarray, least: float, share: float) -> Iterator[tuple[int, int, float, float]]:
    """(text, query window, cosine, common) of the best place of each text for each query window, see :func:`paraphrased`."""
    if not len(query.ids) or not len(ids):
        return
    width, other = query.ids.shape[1], len(latent.index)
    half = width // 2
    answers = query.answers()
    needed = np.minimum(HELD, (answers < other).sum(axis=1))
    # Of the answers of a passage all but ``HELD - 1`` are indexed: one of those must occur.
    first = answers[:, : max(1, answers.shape[1] - HELD + 1)]
    word, owner = first.ravel(), np.repeat(np.arange(len(first)), first.shape[1])
    order = np.argsort(word, kind="stable")
    keys, owner = word[order], owner[order]
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(lengths)), lengths)
    held = np.unique(of * (other + 1) + ids)
    sums = np.vstack([np.zeros((1, latent.vectors.shape[1])), np.cumsum(latent.vectors[ids], axis=0)])
    spots = np.flatnonzero((ids < other) & np.isin(ids, keys))
    shifts = np.arange(-(width + half) + 1, half + 1)
    tried: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for row, place in _expand(np.searchsorted(keys, ids[spots], side="left"), np.searchsorted(keys, ids[spots], side="right")):
        q, spot = owner[place], spots[row]
        pair, back = np.unique(of[spot] * len(answers) + q, return_inverse=True)
        wanted = (pair // len(answers))[:, None] * (other + 1) + answers[pair % len(answers)]
        there = (held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted) & (answers[pair % len(answers)] < other)
        near = (there.sum(axis=1) >= needed[pair % len(answers)])[back]
        q, spot = q[near], spot[near]
        doc = of[spot]
        low, high = (ends - lengths)[doc], ends[doc]
        start = spot[:, None] + shifts
        good = (start >= low[:, None]) & (start < high[:, None]) & ((start + query.size[q][:, None] <= high[:, None]) | (start == low[:, None]))
        r, c = np.nonzero(good)
        start = start[r, c]
        stop = np.minimum(start + query.size[q[r]], high[r])
        cosine = np.einsum("ij,ij->i", _unit(sums[stop] - sums[start]), query.unit[q[r]])
        keep = np.flatnonzero(cosine >= least)
        for n, w, s, x in zip(doc[r[keep]].tolist(), q[r[keep]].tolist(), start[keep].tolist(), cosine[keep].tolist()):
            tried.setdefault((n, w), []).append((x, s))
    for (n, w), places in tried.items():
        line, size = query.ids[w, : query.size[w]].tolist(), int(query.size[w])
        wanted = set(answers[w].tolist()) - {other}
        for x, s in sorted(set(places), key=lambda t: (-t[0], t[1])):
            near = ids[max(s - half, int(ends[n] - lengths[n])) : min(s + size + half, int(ends[n]))].tolist()
            if len(wanted & set(near)) >= needed[w] and (common := common_subsequence(line, near) / size) >= share:
                yield n, w, x, common
                break
