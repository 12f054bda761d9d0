"""Core numbers and layers of large graphs by blocks of vertices.

A block is one row: its vertices, their neighbours as positions in a table of names, and what is known of each name. A
round is a job in which blocks take packed messages from others and send their own, so edges move once, when they are
packed. All rows have the columns of ROW; kind tells what they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf

ROW = "block int, kind int, a binary, b binary, c binary, d binary, e binary"
#: GRAPH: own ids, offsets, neighbours as positions in names, names. CORES: bound of own, bound of names. NEWS: ids, values.
#: LAYERS: core of own, core of names, layer of own, layer of names (-1: not yet), neighbours left to own.
GRAPH, CORES, NEWS, LAYERS = range(4)
#: Neighbours that a block is meant to hold, and how many times as many it may before vertices count as too large for one.
ENTRIES, SLACK = 3_000_000, 4


def block_column(column: str, n: int):
    x = F.col(column)
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 7)).bitwiseXOR(F.shiftright(x, 17)), F.lit(n).cast("long")).cast("int")


def block_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The same in numpy."""
    return np.mod(ids ^ (ids >> 7) ^ (ids >> 17), n)


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows of ROW from (block, kind, arrays)."""
    cells = [[x[k].tobytes() if k < len(x) else None for _, _, x in rows] for k in range(5)]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), **{name: pa.array(c, pa.binary()) for name, c in zip("abcde", cells, strict=True)}})


def _of(t: pa.Table, kind: int, *types) -> list[list[np.ndarray]]:
    """The arrays of each row of one kind."""
    at = np.flatnonzero(t.column("kind").to_numpy() == kind)
    return [[np.frombuffer(t.column(name)[int(i)].as_buffer(), x) for name, x in zip("abcde", types, strict=False)] for i in at]


def packed(entries: DataFrame, n: int) -> DataFrame:
    """One GRAPH row for each block of entries(id, nbr)."""

    def pack(t: pa.Table) -> pa.Table:
        ids, nbrs = t.column("id").to_numpy(), t.column("nbr").to_numpy()
        names, nbr = np.unique(nbrs, return_inverse=True)
        own, who = np.unique(ids, return_inverse=True)
        order = np.argsort(who, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(own)))])
        return _rows([(int(block_of(own[:1], n)[0]), GRAPH, (own, at, nbr[order].astype(np.int32), names))])

    return entries.select(block_column("id", n).alias("block"), "id", "nbr").groupBy("block").applyInArrow(pack, ROW)


def _sent(n: int, names: np.ndarray, owner: np.ndarray, nbr: np.ndarray, own: np.ndarray, value: np.ndarray) -> list[tuple]:
    """NEWS of own vertices for every block that holds a neighbour among the given entries."""
    if not len(nbr):
        return []
    to = np.unique(block_of(names, n)[nbr].astype(np.int64) * len(own) + owner)
    block, who = np.divmod(to, len(own))
    ends = np.flatnonzero(np.diff(block, prepend=-1)).tolist() + [len(to)]
    return [(int(block[i]), NEWS, (own[who[i:j]], value[who[i:j]])) for i, j in zip(ends, ends[1:], strict=False)]


def lowered(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners, h): for each owner the largest h such that h of its values are h or more."""
    key = owner.astype(np.int64) << 32 | (0x7FFFFFFF - value.astype(np.int64))  # by owner, values falling
    key.sort()
    owner, value = key >> 32, 0x7FFFFFFF - (key & 0xFFFFFFFF)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(first, append=len(owner))) + 1
    return owner[first], np.maximum.reduceat(np.minimum(value, rank), first)


def _bounds(n: int, every: bool = False):
    """A round of core numbers: bounds start as degrees, and go down to what the neighbours' bounds leave.

    A block goes on by itself until its own bounds no longer move, then tells the others. The first round tells degrees,
    the next looks at ``every`` vertex, later ones at those that had news.
    """

    def step(t: pa.Table) -> pa.Table:
        [(own, at, nbr, names)] = _of(t, GRAPH, np.int64, np.int64, np.int32, np.int64)
        state, news, block = _of(t, CORES, np.int32, np.int32), _of(t, NEWS, np.int64, np.int32), int(block_of(own[:1], n)[0])
        degree = np.diff(at)
        owner = np.repeat(np.arange(len(own)), degree)
        if not state:
            core = degree.astype(np.int32)
            away = block_of(names, n)[nbr] != block
            here = np.searchsorted(own, names)
            here[here == len(own)] = 0
            seen = np.where(own[here] == names, core[here], np.iinfo(np.int32).max).astype(np.int32)
            return _rows([(block, CORES, (core, seen)), *_sent(n, names, owner[away], nbr[away], own, core)])
        core, seen = state[0][0].copy(), state[0][1].copy()
        fresh = np.full(len(names), every)
        for ids, value in news:
            k = np.searchsorted(names, ids)
            seen[k], fresh[k] = value, True
        moved, mine = np.zeros(len(own), bool), np.searchsorted(names, own)
        mine[mine == len(names)] = 0
        mine = np.where(names[mine] == own, mine, -1)  # own vertices that own vertices see
        while fresh.any():
            hit = np.zeros(len(own), bool)
            hit[owner[fresh[nbr] & (seen[nbr] < core[owner])]] = True
            fresh[:] = False
            if not hit.any():
                break
            some = hit[owner]
            who, h = lowered(owner[some], seen[nbr[some]])
            less = h < core[who]
            who, h = who[less], h[less]
            core[who], moved[who] = h, True
            inside = mine[who] >= 0
            seen[mine[who[inside]]], fresh[mine[who[inside]]] = h[inside], True
        told = moved[owner] & (block_of(names, n)[nbr] != block)
        return _rows([(block, CORES, (core, seen)), *_sent(n, names, owner[told], nbr[told], own, core)])

    return step


def _peeled(n: int, layer: int):
    """A round of layers: of each shell the vertices with no more neighbours left, in it or in higher ones, than their core."""

    def step(t: pa.Table) -> pa.Table:
        [(own, at, nbr, names)] = _of(t, GRAPH, np.int64, np.int64, np.int32, np.int64)
        block, owner = int(block_of(own[:1], n)[0]), np.repeat(np.arange(len(own)), np.diff(at))
        begun = _of(t, LAYERS, *[np.int32] * 5)
        if begun:
            core, seen, mine, theirs, left = (x.copy() for x in begun[0])
            same = seen[nbr] == core[owner]
        else:
            [(core, seen)] = _of(t, CORES, np.int32, np.int32)
            same = seen[nbr] == core[owner]
            mine, theirs = np.full(len(own), -1, np.int32), np.full(len(names), -1, np.int32)
            left = np.bincount(owner[seen[nbr] >= core[owner]], minlength=len(own)).astype(np.int32)
        gone = np.zeros(len(names), bool)
        for ids, value in _of(t, NEWS, np.int64, np.int32):
            k = np.searchsorted(names, ids)
            theirs[k], gone[k] = value, True
        left -= np.bincount(owner[gone[nbr] & same], minlength=len(own)).astype(np.int32)
        out = (mine < 0) & (left <= core)
        mine[out] = layer
        told = out[owner] & same
        return _rows([(block, LAYERS, (core, seen, mine, theirs, left)), *_sent(n, names, owner[told], nbr[told], own, mine)])

    return step


def _unpacked(t: pa.Table) -> pa.Table:
    """(id, core, layer, ahead, degree) of a block's vertices; ahead counts the neighbours that come later in the order of
    (core, layer, id)."""
    [(own, at, nbr, names)] = _of(t, GRAPH, np.int64, np.int64, np.int32, np.int64)
    degree = np.diff(at)
    [state] = _of(t, LAYERS, *[np.int32] * 5) or [[*_of(t, CORES, np.int32, np.int32)[0], np.zeros(len(own), np.int32), np.zeros(len(names), np.int32)]]
    core, seen, mine, theirs = state[:4]
    owner = np.repeat(np.arange(len(own)), degree)
    c, l = core[owner], mine[owner]
    later = (seen[nbr] > c) | (seen[nbr] == c) & ((theirs[nbr] > l) | (theirs[nbr] == l) & (names[nbr] > own[owner]))
    ahead = np.bincount(owner[later], minlength=len(own))
    return pa.table({"id": own, "core": core.astype(np.int64), "layer": mine, "ahead": ahead.astype(np.int64), "degree": degree.astype(np.int64)})


def blocks_for(entries: DataFrame, size: int = ENTRIES) -> int | None:
    """How many blocks hold entries(id, nbr) in about ``size`` each; None if a vertex has too many for one."""
    total = entries.count()
    n = max(1, -(-total // size)) | 1
    largest = entries.groupBy(block_column("id", n).alias("block")).count().agg(F.max("count")).first()[0]
    return n if (largest or 0) <= SLACK * size else None


def shells(shelf: Shelf, entries: DataFrame, n: int, layers: bool = True) -> DataFrame:
    """(id, core, layer, ahead, degree) of every vertex of entries(id, nbr), each edge from both its ends once; without
    ``layers`` of core numbers only. Rounds go on until no block has news, and a round's rows go once the next are there."""
    graph = shelf.put(packed(entries, n))
    now = None

    def turn(step) -> bool:
        nonlocal now
        rows = graph if now is None else graph.unionByName(now)
        after = shelf.put(rows.groupBy("block").applyInArrow(step, ROW))
        if now is not None:
            shelf.drop(now)
        now = after
        return now.where(F.col("kind") == NEWS).limit(1).count() > 0

    turn(_bounds(n))
    more = turn(_bounds(n, every=True))
    while more:
        more = turn(_bounds(n))
    layer = 0
    while layers and turn(_peeled(n, layer)):
        layer += 1
    return graph.unionByName(now.where(F.col("kind") != NEWS)).groupBy("block").applyInArrow(_unpacked, "id long, core long, layer int, ahead long, degree long")
