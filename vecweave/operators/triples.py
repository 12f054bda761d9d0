"""Triangles of large graphs by triples of colours.

Vertices have one of p colours by a hash. Edges are packed once into blocks by the colours of their ends, and a task takes
the blocks of one triple of colours: every triangle is in exactly one, an edge goes to p of them, and no path of two edges
leaves a task. With p growing as the root of the edges a task holds about EDGES of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_of

#: Edges of a task (some 60 bytes each there), and the colours of a small graph, so that there are tasks for all cores.
EDGES, LEAST = 6_000_000, 4
#: Edges packed at once, and paths of two edges that are looked at together.
PACKED, PATHS = 2_000_000, 1 << 21
BLOCK = "i int, j int, n int, u binary, v binary, s binary"


def colours_for(edges: int, in_task: int = EDGES) -> int:
    """A triple of different colours has 6 / p² of the edges."""
    return max(LEAST, int(np.ceil(np.sqrt(6 * edges / in_task))))


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as zstandard, all first bytes first: numbers of one size have their high bytes alike."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unsqueezed(b: pa.Scalar, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b.as_buffer(), 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel()


def gathered(batches: Iterator[pa.RecordBatch], rows: int = PACKED) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def packed(edges: DataFrame, p: int) -> DataFrame:
    """BLOCK rows of edges(u, v[, sim_q]), i <= j the colours of u and v; edges of a row go by rising u, as differences."""
    carried = ["sim_q"] if "sim_q" in edges.columns else []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
            cu, cv = block_of(u, p), block_of(v, p)
            turn = cu > cv
            u, v, code = np.where(turn, v, u), np.where(turn, u, v), np.minimum(cu, cv) * p + np.maximum(cu, cv)
            order = np.lexsort((u, code))
            u, v, code = u[order], v[order], code[order]
            s = t.column("sim_q").to_numpy()[order] if carried else None
            first = np.flatnonzero(np.diff(code, prepend=-1))
            for x, y in zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=True):
                cell = [squeezed(np.diff(u[x:y], prepend=0)), squeezed(v[x:y]), squeezed(s[x:y]) if carried else None]
                at = [pa.array([int(k)], pa.int32()) for k in (code[x] // p, code[x] % p, y - x)]
                yield pa.RecordBatch.from_arrays([*at, *(pa.array([c], pa.binary()) for c in cell)], ["i", "j", "n", "u", "v", "s"])

    return edges.select("u", "v", *carried).mapInArrow(pack, BLOCK)


def dealt(blocks: DataFrame, p: int) -> DataFrame:
    """The blocks under each triple t of colours that takes them: (i, j) is in {i, j, x} for every x."""
    place = {t: k for k, t in enumerate(combinations_with_replacement(range(p), 3))}
    takes = blocks.sparkSession.createDataFrame([(i, j, [place[tuple(sorted((i, j, x)))] for x in range(p)]) for i in range(p) for j in range(i, p)], "i int, j int, ts array<int>")
    return blocks.join(F.broadcast(takes), ["i", "j"]).select(F.explode("ts").alias("t"), "n", "u", "v", "s").repartition(len(place), "t")  # a row for each two colours


def edges_in(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """u, v and s of the blocks of a table."""
    n = t.column("n").to_pylist()
    u = np.concatenate([np.cumsum(unsqueezed(b, k)) for b, k in zip(t.column("u"), n, strict=True)])
    v = np.concatenate([unsqueezed(b, k) for b, k in zip(t.column("v"), n, strict=True)])
    s = np.concatenate([unsqueezed(b, k) for b, k in zip(t.column("s"), n, strict=True)]) if t.column("s")[0].is_valid else None
    return u, v, s


def numbered(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, positions of u, positions of v); without a sort where the ids lie close together."""
    low, high = min(int(u.min()), int(v.min())), max(int(u.max()), int(v.max()))
    if high - low > 8 * len(u) + 1000:
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        return ids, at[: len(u)].astype(np.int32), at[len(u) :].astype(np.int32)
    seen = np.zeros(high - low + 1, bool)
    seen[u - low] = seen[v - low] = True
    place = (np.cumsum(seen) - 1).astype(np.int32)
    return np.flatnonzero(seen) + low, place[u - low], place[v - low]


def closed(t: pa.Table, p: int, paths: int = PATHS) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, a, b, c, ab, ac, bc) of a triple's triangles, many at a time: positions in ids of the three ends and, where
    edges carry them, the similarities.

    Vertices are ordered by their edges in the task, so none has more than about the root of twice the edges after it. For
    each two of these whose colours fit, a bitmap of the edges says which may be linked, and the sorted edges which are.
    """
    u, v, s = edges_in(t)
    number = t.column("t")[0].as_py()
    triple = next(x for k, x in enumerate(combinations_with_replacement(range(p), 3)) if k == number)
    ids, u, v = numbered(u, v)
    n = len(ids)
    order = np.argsort(np.bincount(u, minlength=n) + np.bincount(v, minlength=n), kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    ids = ids[order]
    colour = block_of(ids, p)
    kind = np.searchsorted(np.unique(triple), colour)
    u, v = rank[u], rank[v]
    a, b = np.minimum(u, v), np.maximum(u, v)
    del u, v, rank
    key = (a.astype(np.int64) * 3 + kind[b]) * n + b
    if s is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, s = key[order], s[order]
    del a, b, order
    group = key // n
    a, b = (group // 3).astype(np.int32), (key % n).astype(np.int32)
    # The ends that are left to a first one have two colours or one: those from the next colour's first on, or the next ones.
    rest = [[x for k, x in enumerate(triple) if k != triple.index(c)] for c in np.unique(triple)]
    cross = np.array([x[0] != x[1] for x in rest])[kind[a]]
    end = np.searchsorted(group, (np.arange(n, dtype=np.int64) + 1) * 3)[a]
    next_ = np.flatnonzero(np.diff(group, append=-1)) + 1
    next_ = np.repeat(next_, np.diff(next_, prepend=0))
    low, high = np.where(cross, next_, np.arange(1, len(key) + 1)), np.where(cross, end, next_)
    del group, cross, end, next_
    many = (high - low).astype(np.int32)
    del high
    bits = max(16, min(28, int(len(key)).bit_length() + 4))
    hashed = lambda x, y: ((x.astype(np.uint32) * np.uint32(2654435761)) ^ (y.astype(np.uint32) * np.uint32(2246822519))) * np.uint32(3266489917) >> np.uint32(32 - bits)
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    h = hashed(a, b)
    for k in range(8):
        bitmap[h[h & 7 == k] >> 3] |= np.uint8(1 << k)
    del h
    open_ = np.flatnonzero(many)
    sums = np.cumsum(many[open_], dtype=np.int64)
    at = 0
    while at < len(open_):
        upto = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + paths, "right")))
        mine = open_[at:upto]
        at = upto
        m = many[mine]
        starts = np.cumsum(m, dtype=np.int64) - m
        second = np.repeat((low[mine] - starts).astype(np.int32), m) + np.arange(int(m.sum()), dtype=np.int32)
        x, y = np.repeat(b[mine], m), b[second]
        less, more = np.minimum(x, y), np.maximum(x, y)
        h = hashed(less, more)
        hit = np.flatnonzero(bitmap[h >> 3] >> (h & 7).astype(np.uint8) & 1)
        less, more = less[hit], more[hit]
        want = (less.astype(np.int64) * 3 + kind[more]) * n + more
        third = np.minimum(np.searchsorted(key, want), len(key) - 1)
        true = np.flatnonzero(key[third] == want)
        if not len(true):
            continue
        hit, third, less, more = hit[true], third[true], less[true], more[true]
        first = np.repeat(mine.astype(np.int32), m)[hit]
        second = second[hit]
        if s is None:
            yield ids, a[first], less, more, None, None, None
        else:
            up = b[first] == less
            yield ids, a[first], less, more, np.where(up, s[first], s[second]), np.where(up, s[second], s[first]), s[third]


def counts(blocks: DataFrame, p: int) -> DataFrame:
    """(id, n): rows of the triangles that each triple of colours finds at a vertex."""

    def count(t: pa.Table) -> pa.Table:
        n = ids = None
        for ids, *ends, _, _, _ in closed(t, p):
            found = sum(np.bincount(x, minlength=len(ids)) for x in ends)
            n = found if n is None else n + found
        some = np.flatnonzero(n) if n is not None else []
        return pa.table({"id": pa.array(ids[some] if n is not None else [], pa.int64()), "n": pa.array(n[some] if n is not None else [], pa.int64())})

    return dealt(blocks, p).groupBy("t").applyInArrow(count, "id long, n long")


LINKS = "g int, kind int, n int, a binary, b binary, c binary, d binary"


def _by_group(kind: int, g: int, id_: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """LINKS rows of whole numbers: those of the ids in one of g groups each, by rising id, ids as differences."""
    group = block_of(id_, g)
    order = np.lexsort((id_, group))
    group, id_, rest = group[order], id_[order], [x[order] for x in rest]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    for x, y in zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=True):
        cells = [squeezed(np.diff(id_[x:y], prepend=0)), *(squeezed(r[x:y]) for r in rest)]
        yield pa.RecordBatch.from_arrays([*(pa.array([int(k)], pa.int32()) for k in (group[x], kind, y - x)), *(pa.array([c], pa.binary()) for c in cells)], ["g", "kind", "n", "a", "b", "c", "d"])


def neighbours(oriented: DataFrame, g: int) -> DataFrame:
    """LINKS rows of kind 0 of oriented edges (a, b, sim_q): id, neighbour, similarity, whether the neighbour comes first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            a, b, s = (t.column(k).to_numpy() for k in ("a", "b", "sim_q"))
            yield from _by_group(0, g, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]), np.repeat([0, 1], len(a)))

    return oriented.select("a", "b", "sim_q").mapInArrow(pack, LINKS)


def links(blocks: DataFrame, p: int, g: int) -> DataFrame:
    """LINKS rows of kind 1: for each triangle and each of its ends (id, x, y, similarity of x and y)."""

    def deliver(t: pa.Table) -> pa.Table:
        out, held, n = [], [], 0

        def flush() -> None:
            a, b, c, ab, ac, bc = (np.concatenate(x) for x in zip(*held, strict=True))
            out.extend(_by_group(1, g, np.concatenate([a, b, c]), np.concatenate([b, a, a]), np.concatenate([c, c, b]), np.concatenate([bc, ac, ab])))

        for ids, a, b, c, *sims in closed(t, p):
            held.append((ids[a], ids[b], ids[c], *sims))
            n += len(a)
            if n > PACKED // 2:
                flush()
                held, n = [], 0
        if held:
            flush()
        empty = {"g": pa.int32(), "kind": pa.int32(), "n": pa.int32(), **dict.fromkeys("abcd", pa.binary())}
        return pa.Table.from_batches(out) if out else pa.table({k: pa.array([], x) for k, x in empty.items()})

    return dealt(blocks, p).groupBy("t").applyInArrow(deliver, LINKS)


def read(t: pa.Table, kind: int) -> list[np.ndarray]:
    """The four columns of a group's LINKS rows of one kind, not in order."""
    t = t.filter(pa.array(t.column("kind").to_numpy() == kind))
    n, out = t.column("n").to_pylist(), []
    for name in "abcd":
        x = [unsqueezed(b, k) for b, k in zip(t.column(name), n, strict=True)]
        out.append(np.concatenate([np.cumsum(y) if name == "a" else y for y in x]) if x else np.zeros(0, np.int64))
    return out


def neighbourhoods_in(t: pa.Table, tau_q: int | None = None) -> Iterator[tuple[list[int], list[int], list[dict[int, int]], int, int]]:
    """(names, adj, w, later, earlier) of each vertex of a group: itself is 0, neighbours follow in the order of their ids.
    With ``tau_q`` only of those that a pair reaching it starts from."""
    own, nbr, s, first = read(t, 0)
    order = np.lexsort((nbr, own))
    own, nbr, s, first = own[order], nbr[order], s[order], first[order].astype(bool)
    ids, at = np.unique(own, return_index=True)
    names = np.unique(nbr)
    width = len(names)
    key = np.searchsorted(ids, own) * width + np.searchsorted(names, nbr)
    who, x, y, ls = read(t, 1)
    who = np.searchsorted(ids, who)
    order = np.argsort(who, kind="stable")
    who, x, y, ls = who[order], x[order], y[order], ls[order]
    x, y = (np.searchsorted(key, who * width + np.searchsorted(names, z)) - at[who] + 1 for z in (x, y))
    upto, ends = np.append(at, len(own)).tolist(), np.searchsorted(who, np.arange(len(ids) + 1)).tolist()
    root = np.ones(len(ids), bool) if tau_q is None else np.logical_or.reduceat((s >= tau_q) & ~first, at)
    for k in np.flatnonzero(root).tolist():
        i, j = upto[k], upto[k + 1]
        m = j - i + 1
        adj, w, earlier = [(1 << m) - 2, *[1] * (m - 1)], [dict(enumerate(s[i:j].tolist(), 1)), *({0: z} for z in s[i:j].tolist())], 0
        for z in np.flatnonzero(first[i:j]).tolist():
            earlier |= 2 << z
        for a, b, z in zip(x[ends[k] : ends[k + 1]].tolist(), y[ends[k] : ends[k + 1]].tolist(), ls[ends[k] : ends[k + 1]].tolist(), strict=True):
            w[a][b] = w[b][a] = z
            adj[a] |= 1 << b
            adj[b] |= 1 << a
        yield [int(ids[k]), *nbr[i:j].tolist()], adj, w, adj[0] & ~earlier, earlier
