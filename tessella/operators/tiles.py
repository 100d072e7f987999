"""Walks of all nodes of a graph by groups of near ones, so that pairs never cross a shuffle.

A group is a range of nodes. It gets the edges it may meet and answers for its own nodes alone: all pairs of a node come out of one task
and go straight to the result. What is shuffled is edges, not pairs. For longer walks they are packed into tiles of two or three bytes an edge.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import materialize

_ROWS = 1 << 18  # of an Arrow batch that goes out
_GROUPS = 24  # as many, so that the work spreads over the cores
_LEAST, _MOST = 1 << 12, 1 << 18  # edges of a group below and beyond that number of groups
_built: dict[tuple, tuple] = {}  # the last graph that this Python worker unpacked


def _pack(columns: list[np.ndarray]) -> bytes:
    """Differences, their bytes by place: runs of zeros, which compress well."""
    planes = [np.ascontiguousarray(np.diff(c, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zlib.compress(b"".join(planes), 1)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(columns, 8, -1)
    return [np.cumsum(np.ascontiguousarray(p.T).view(np.int64).ravel()) for p in planes]


def _spread(batches: Iterator[pa.RecordBatch], bounds: list[int], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = [pa.array(np.searchsorted(bounds, b[c].to_numpy(), "right").astype(np.int32)) for c, _ in zip(("src", "dst"), names)]
        yield pa.RecordBatch.from_arrays([*at, *b.columns], [*names, *b.schema.names])


def _tile(rows: pa.Table) -> pa.Table:
    names = rows.column_names[2:]
    columns = [rows[c].to_numpy() for c in names]
    order = np.lexsort((columns[1], columns[0]))
    data = _pack([c[order] for c in columns])
    return pa.table({"tile": pa.array([rows["tile"][0].as_py()], pa.int32()), "towards": pa.array([np.unique(rows["towards"].to_numpy())], pa.list_(pa.int32())), "data": pa.array([data], pa.binary())})


def grouped(edges: DataFrame, *names: str) -> tuple[DataFrame, list[int]]:
    """``edges`` with the group of ``src`` and that of ``dst`` by these names, and the least node of each group but the first; groups hold about as many edges."""
    n = edges.count()
    many = max(min(_GROUPS, -(-n // _LEAST)), -(-n // _MOST), 1)
    cuts = edges.agg(F.percentile_approx("src", [k / many for k in range(1, many)], 100 * many)).head()[0] if many > 1 else []
    bounds = sorted({int(c) for c in cuts or []})
    kinds = ", ".join(f"{c} bigint" for c in edges.columns)
    longs = edges.select(*[F.col(c).cast("long").alias(c) for c in edges.columns])
    return longs.mapInArrow(partial(_spread, bounds=bounds, names=names), f"{', '.join(f'{c} int' for c in names)}, {kinds}"), bounds


def _gathered(rows: DataFrame, bounds: list[int], *order: str) -> DataFrame:
    """Each group's rows in one partition, together and in order; four partitions a group, as few should meet in one."""
    return rows.repartition(4 * len(bounds) + 4, "g").sortWithinPartitions("g", *order)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    now, held = None, []
    for b in batches:
        g = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and g[i] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(g[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def _built_once(token: str, rows: pa.Table) -> tuple:
    """The graph of the tiles; groups that need the same ones share it in a worker."""
    key = (token, *rows["tile"].to_pylist())
    if key not in _built:
        _built.clear()
        _built[key] = _graph(rows["data"].to_pylist())
    return _built[key]


def _emit(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + _ROWS]) for c in columns], names)


# ---- reverse reachability --------------------------------------------------------------------------------------------------------


def _graph(data: list[bytes]) -> tuple:
    """Nodes, and edges by number of node, in order of the node depended on."""
    src, dst = (np.concatenate(c) for c in zip(*(_unpack(d, 2) for d in data), strict=True))
    nodes = np.unique(np.concatenate([src, dst]))
    s, e = (np.searchsorted(nodes, c).astype(np.int32) for c in (src, dst))
    order = np.argsort(e, kind="stable")
    return nodes, s[order], e[order]


def _hops(roots: np.ndarray, s: np.ndarray, e: np.ndarray, n: int, hops: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``hop, nodes, bits``: the nodes first met so many hops from roots, and from which: bit k of a row is the k-th root."""
    words = -(-len(roots) // 64)
    k = np.arange(len(roots))
    seen = np.zeros((n, words), np.uint64)
    seen[roots, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
    front, place, active = seen[roots], np.zeros(n, np.int32), np.zeros(n, bool)
    place[roots], active[roots] = k, True
    chunk = max(1, (1 << 19) // words)
    for hop in range(1, hops + 1):
        met = np.flatnonzero(active[s])
        if not len(met):
            return
        row, to = place[s[met]], e[met]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        ends, targets = np.r_[starts[1:], len(met)], to[starts]
        active, at, fresh, rows = np.zeros(n, bool), 0, [], []
        while at < len(starts):
            z = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, "right")))
            bits = np.bitwise_or.reduceat(front[row[starts[at] : ends[z - 1]]], starts[at:z] - starts[at], axis=0)
            bits &= ~seen[targets[at:z]]
            some = bits.any(axis=1)
            bits, there = bits[some], targets[at:z][some]
            seen[there] |= bits
            if len(there):
                yield hop, there, bits
                fresh.append(there)
                rows.append(bits)
            at = z
        if not fresh:
            return
        there = np.concatenate(fresh)
        front = np.concatenate(rows)
        place[there], active[there] = np.arange(len(there)), True


def _pairs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each set bit, in order."""
    flat = bits.view(np.uint8).ravel()
    some = np.flatnonzero(flat)
    one = np.flatnonzero(np.unpackbits(flat[some], bitorder="little"))
    at = some[one >> 3]
    width = bits.shape[1] * 8
    row = at // width
    return row, ((at - row * width) << 3) | (one & 7)


def _walk(batches: Iterator[pa.RecordBatch], token: str, bounds: list[int], hops: int, count: bool) -> Iterator[pa.RecordBatch]:
    for g, rows in _groups(batches):
        nodes, s, e = _built_once(token, rows)
        n = len(nodes)
        mine = np.unique(s)
        mine = mine[np.searchsorted(bounds, nodes[mine], "right") == g]
        step = 64 * min(64, max(1, (1 << 23) // n))  # bits of all nodes: 64 MB
        total = np.zeros(n, np.int64)
        for k in range(0, len(mine), step):
            roots = mine[k : k + step]
            for hop, there, bits in _hops(roots, s, e, n, hops):
                if count:
                    total[there] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                else:
                    row, place = _pairs(bits)
                    yield from _emit(["file", "dependent", "hop"], [nodes[there][row], nodes[roots][place], np.full(len(row), hop, np.int32)])
        if count:
            some = np.flatnonzero(total)
            yield from _emit(["id", "dependents"], [nodes[some], total[some]])


def _walked(edges: DataFrame, max_hops: int, count: bool) -> DataFrame:
    once = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "closure-steps")
    wide, bounds = grouped(once, "tile", "towards")
    tiles = materialize(wide.groupBy("tile").applyInArrow(_tile, "tile int, towards array<int>, data binary"), "closure-tiles")
    links = tiles.select("tile", F.explode("towards").alias("next")).where("tile <> next")
    needs = tiles.select(F.col("tile").alias("g"), "tile")
    for _ in range(max_hops - 1):  # a node met at the last hop needs no edges
        needs = needs.unionByName(needs.join(links, "tile").select("g", F.col("next").alias("tile"))).distinct()
    rows = _gathered(materialize(needs, "closure-needs").join(tiles, "tile").select("g", "tile", "data"), bounds, "tile")
    schema = "id bigint, dependents bigint" if count else "file bigint, dependent bigint, hop int"
    return rows.mapInArrow(partial(_walk, token=uuid.uuid4().hex, bounds=bounds, hops=max_hops, count=count), schema)


def closure(edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """``file, dependent, hop`` as ``graph.closure`` gives them, without a shuffle of pairs.

    A group's dependents walk to what they need, a bit for each, 64 at a word, so that a step of all of them over an edge is a few words' *or*.
    """
    return _walked(edges, max_hops, False)


def dependents(edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """``id, dependents``: how many pairs of ``closure`` each file has; the bits are counted, and no pair is made."""
    return _walked(edges, max_hops, True).groupBy("id").agg(F.sum("dependents").alias("dependents"))


# ---- similarity ------------------------------------------------------------------------------------------------------------------


def _meet(batches: Iterator[pa.RecordBatch], bounds: list[int]) -> Iterator[pa.RecordBatch]:
    for g, rows in _groups(batches):
        dst, src, n = (rows[c].to_numpy() for c in ("dst", "src", "n"))
        nodes, first, s = np.unique(src, return_index=True, return_inverse=True)
        size = n[first]
        starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])  # of a target's list
        each = np.diff(np.r_[starts, len(dst)])
        own = np.flatnonzero((np.searchsorted(bounds, nodes, "right") == g)[s])
        own = own[np.argsort(s[own], kind="stable")]  # the group's edges by node
        target = np.searchsorted(starts, own, "right") - 1
        ends = np.flatnonzero(np.r_[s[own][1:] != s[own][:-1], True]) + 1  # where a node's edges end
        sums = np.cumsum(each[target])
        at = node = 0
        while node < len(ends):
            before = sums[at - 1] if at else 0
            node = max(node + 1, int(np.searchsorted(sums[ends - 1], before + (1 << 21), "right")))
            now = slice(at, ends[node - 1])
            at = ends[node - 1]
            width = each[target[now]]
            place = np.arange(width.sum()) + np.repeat(starts[target[now]] - np.cumsum(width) + width, width)
            keys = np.repeat(s[own[now]] * len(nodes), width) + s[place]
            keys.sort()
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            shared = np.diff(np.r_[new, len(keys)])
            a, b = np.divmod(keys[new], len(nodes))
            apart = np.flatnonzero(a != b)
            a, b, shared = a[apart], b[apart], shared[apart]
            yield from _emit(["id", "other", "shared", "score"], [nodes[a], nodes[b], shared, shared / (size[a] + size[b] - shared)])


def similar(edges: DataFrame) -> DataFrame:
    """``id, other, shared, score`` of all files as ``graph.jaccard`` gives them, without a shuffle of pairs.

    A group of files gets the list of the files that import each of its targets, meets the others there and counts them by sorting. A row of a
    list stands for one pair at least, so no more rows are shuffled than come out, and far fewer where neighbours import the same.
    """
    out = edges.select("src", "dst").distinct()
    sizes = out.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    lists = materialize(out.join(sizes, "src").where("dst is not null").select("dst", "src", "n"), "similar-lists")
    wide, bounds = grouped(lists.select("src", "dst"), "g")
    rows = wide.select("g", "dst").distinct().join(lists, "dst").select("g", *[F.col(c).cast("long").alias(c) for c in ("dst", "src", "n")])
    return _gathered(rows, bounds, "dst", "src").mapInArrow(partial(_meet, bounds=bounds), "id bigint, other bigint, shared bigint, score double")
