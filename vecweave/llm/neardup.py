"""Near duplicates: SimHash fingerprints joined exactly within a Hamming radius by vantage-point trees.

Equal fingerprints are first made one row. A tree fitted on a bounded sample cuts the rest into shards: at each node a
fingerprint goes by its distance to a vantage point to the inner or the outer side. Pairs across a cut are found by
sending every outer row within the radius of the boundary to the inner side as a query, and queries to each side that
the triangle inequality doesn't exclude. A shard compares its own rows with each other and with its queries; a shard
that is large cuts itself by a tree of its own in the same way. What leaves a shard is a forest of links, never all
pairs; components() joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_first, lean, materialise, table, text_bytes, text_key, tune
from .components import components

WORDS, RADIUS, SEED = 3, 2, 42
#: Rows of its own that a shard should hold, sampled rows for each shard that the tree is to have, the least and the most
#: of a sample, rows of a shard beyond which it cuts itself, and rows that are routed together.
SHARD, PER_SHARD, LEAST, SAMPLE, LOCAL, ROUTED = 1_024, 4, 16_384, 1 << 18, 4_096, 1 << 17

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def simhash_texts(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprints of lower-cased word shingles; bit set if it is in over half of the shingle hashes."""
    h, of, hashes, counts = xxhash.xxh64_intdigest, [], [], np.zeros(len(texts), np.int64)
    out = np.zeros((len(texts), 8, 8))
    held = 0

    def flush() -> None:
        if not hashes:
            return
        raw = np.concatenate(hashes).view(np.uint8).reshape(-1, 8)
        n = np.array([len(x) for x in hashes])
        row = np.repeat(np.arange(len(of)), n) * 256
        for k in range(8):
            out[of, k] += np.bincount(row + raw[:, k], minlength=256 * len(of)).reshape(-1, 256) @ _BITS
        of.clear()
        hashes.clear()

    for i, text in enumerate(texts):
        w = text.lower().split()
        if not w:
            continue
        joined = b" ".join(w)
        if len(w) <= words:
            got = [h(joined, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            got = [h(joined[a:b], SEED) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
        counts[i] = len(got)
        of.append(i)
        hashes.append(np.array(got, "<u8"))
        held += len(got)
        if held > 1 << 19:
            flush()
            held = 0
    flush()
    set_ = 2 * out > counts[:, None, None]
    return (set_.reshape(-1, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64) if len(texts) else np.zeros(0, np.uint64)


def fingerprint_of(hashes: np.ndarray) -> np.uint64:
    """The 64-bit fingerprint of one text's shingle hashes."""
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.stack([np.bincount(raw[:, k], minlength=256) for k in range(8)]) @ _BITS
    return np.packbits(2 * ones.reshape(-1) > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, fp long) for each row of ``docs``, key being its text's; null or wordless text has fingerprint zero."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(2))
            raw, at = data.tobytes(), at.tolist()
            fp = simhash_texts([raw[s:e] for s, e in zip(at, at[1:], strict=False)], words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text").mapInArrow(lean(run), "doc_id long, key long, fp long")


class Tree:
    """A vantage-point tree over unsigned 64-bit fingerprints; leaves are shards."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int, depth: int = 40):
        self.radius, self.point, self.cut, self.sides, self.n_leaves = radius, [], [], [], 0
        self.root = self._node(sample, leaf, depth)

    def _node(self, x: np.ndarray, leaf: int, depth: int) -> int:
        """A node's number, or minus one minus a leaf's."""
        best = None
        if len(x) > leaf and depth:
            for v in x[np.linspace(0, len(x) - 1, 12).astype(int)]:
                seen = np.bincount(np.bitwise_count(x ^ v), minlength=65)
                inner = np.cumsum(seen)
                for m in np.flatnonzero((inner >= 0.25 * len(x)) & (inner <= 0.75 * len(x))):
                    near = inner[min(64, m + self.radius)] - inner[max(0, m - self.radius)]
                    score = near / len(x) + abs(inner[m] / len(x) - 0.5) / 2
                    if best is None or score < best[0]:
                        best = (score, v, int(m))
        if best is None:
            self.n_leaves += 1
            return -self.n_leaves
        k = len(self.point)
        self.point.append(best[1])
        self.cut.append(best[2])
        self.sides.append(None)
        inside = np.bitwise_count(x ^ best[1]) <= best[2]
        self.sides[k] = (self._node(x[inside], leaf, depth - 1), self._node(x[~inside], leaf, depth - 1))
        return k

    def route(self, x: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows of x, whether each is the leaf's own): own rows reach one leaf, queries all they may have links in."""
        todo = [(self.root, np.arange(len(x)), own)]
        while todo:
            k, rows, mine = todo.pop()
            if not len(rows):
                continue
            if k < 0:
                yield -k - 1, rows, mine
                continue
            d, m, r = np.bitwise_count(x[rows] ^ self.point[k]).astype(np.int16), self.cut[k], self.radius
            inside = d <= m
            inner = np.where(mine, d <= m + r, d - r <= m)
            outer = np.where(mine, ~inside, d + r > m)
            todo.append((self.sides[k][0], rows[inner], (mine & inside)[inner]))
            todo.append((self.sides[k][1], rows[outer], mine[outer]))


def links(own: np.ndarray, queries: np.ndarray, radius: int, local: int = LOCAL) -> tuple[np.ndarray, np.ndarray]:
    """A forest over distinct fingerprints: each linked one with the first of its tree; links have an own row at one end."""
    if len(own) > local:
        tree = Tree(own[:: max(1, len(own) // LEAST)], max(8, local * LEAST // max(LEAST, len(own)) // 2), radius)
        if tree.n_leaves > 1:
            both, mine = np.concatenate([own, queries]), np.arange(len(own) + len(queries)) < len(own)
            parts: dict[int, list] = {}
            for leaf, rows, m in tree.route(both, mine):
                parts.setdefault(leaf, []).append((rows, m))
            found = []
            for got in parts.values():
                rows, m = (np.concatenate(x) for x in zip(*got, strict=True))
                # A leaf that its tree couldn't make smaller is compared as it is, in chunks.
                found.append(links(both[rows[m]], both[rows[~m]], radius, local if m.sum() < 0.9 * len(own) else 1 << 62))
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    every = np.concatenate([own, queries])
    n, linked = len(own), np.zeros(len(every), bool)
    step = max(1, (1 << 22) // max(1, len(every)))
    for a in range(0, n, step):
        rest = every[a:]
        near = np.bitwise_count(own[a : a + step, None] ^ rest[None, :]) <= radius
        k = np.arange(len(near))
        near[k, k] = False
        linked[a : a + len(near)] |= near.any(1)
        linked[a:] |= near.any(0)
    at = np.flatnonzero(linked)
    x, mine = every[at], at < n
    root, free = np.full(len(x), -1), np.ones(len(x), bool)
    for seed in np.flatnonzero(mine):
        if not free[seed]:
            continue
        free[seed], root[seed], front = False, seed, np.array([seed])
        while len(front):
            reached = []
            for a in range(0, len(front), 64):
                some = front[a : a + 64]
                open_ = np.flatnonzero(free)
                near = np.bitwise_count(x[some, None] ^ x[None, open_]) <= radius
                near &= mine[some, None] | mine[None, open_]
                new = open_[near.any(0)]
                free[new], root[new] = False, seed
                reached.append(new)
            front = np.concatenate(reached)
    leaves = np.flatnonzero((root >= 0) & (root != np.arange(len(x))))
    return x[leaves], x[root[leaves]]


def near_groups(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for every distinct value of ``fps(fp long)`` that has another within ``radius`` bits."""
    distinct = fps.select("fp").distinct()
    n = distinct.count()
    # The smallest hashes are a uniform sample and the same one in every run. It grows with the shards that are needed,
    # up to SAMPLE rows (2 MB); beyond SHARD * SAMPLE / PER_SHARD fingerprints shards grow, and cut themselves further.
    want = min(SAMPLE, max(LEAST, PER_SHARD * -(-n // SHARD)))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(want).toArrow().column("fp").to_numpy().view(np.uint64)
    tree = Tree(sample, max(PER_SHARD, int(SHARD * len(sample) / max(1, n))), radius)

    def routed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held).view(np.uint64)
        for leaf, rows, own in tree.route(x, np.ones(len(x), bool)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, np.int32)), pa.array(x[rows].view(np.int64)), pa.array(own)], ["leaf", "fp", "own"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy())
            n += len(b)
            if n >= ROUTED:  # a node of the tree is visited once for all of them
                yield from routed(held)
                held, n = [], 0
        if held:
            yield from routed(held)

    def search(t: pa.Table) -> pa.Table:
        x, own = t.column("fp").to_numpy().view(np.uint64), t.column("own").to_numpy(zero_copy_only=False)
        a, b = links(x[own], x[~own], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    edges = distinct.mapInArrow(lean(route), "leaf int, fp long, own boolean").groupBy("leaf").applyInArrow(search, "a long, b long")
    return components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, key, fp, component_id) for each row of ``docs``; key is its text's.

    component_id is the smallest doc_id among the rows reachable by fingerprints within ``radius`` bits. Equal texts
    share a fingerprint, so copies are one row in the search. Null, empty and blank texts have fingerprint zero and
    link like any other; texts of any length are hashed whole. Rows with a null doc_id take part but never name a
    component (null if there is no other). Repeated rows stay repeated. Further columns of ``docs`` aren't read, so
    their names don't matter. An empty table gives an empty result.
    """
    return _grouped(docs, words, radius).select("doc_id", "key", "fp", "component_id")


def _grouped(docs: DataFrame, words: int, radius: int) -> DataFrame:
    rows = materialise(fingerprints(docs, words))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = near_groups(least, radius)
    named = materialise(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(first, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of fingerprints within ``radius`` bits, as common.keep_first() chooses it."""
    return keep_first(docs, materialise(_grouped(docs, words, radius).select("doc_id", "key", "root")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
