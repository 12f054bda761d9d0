"""Periodic runs of words by Stoye and Gusfield's suffix-tree method.

The internal nodes of a text's suffix tree come from its suffix array and the common prefixes of neighbours, as a tree of
two-way splits: the parting of a node's children, one after another. At a node of string depth D, the leaves of the
smaller half are listed, and a leaf i with i + D or i - D in the other half is a branching tandem repeat: two copies of D
words that the next word doesn't go on. Listing only smaller halves makes n log n leaves at most. Every run ends with
exactly one branching repeat of its period, so rotating that to the left, for as long as the word before fits, gives the
whole run; repeats of several periods at one end that are the same run merge into the one of the smallest period.

A run of k periods holds each of its words k times at least, so texts are cut first at words that are rarer in their
stretch, again and again until nothing changes, and the tree is built over what is left of them: no run is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import lean, table, tune

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Pairs of a node and a leaf looked at together.
BLOCK = 1 << 20


def stretches(x: np.ndarray, periods: int, least: int) -> np.ndarray:
    """Positions that a run may hold: each word at least ``periods`` times in its stretch of neighbours, ``least`` in a stretch."""
    at = np.flatnonzero(np.bincount(x, minlength=1)[x] >= periods)
    while len(at):
        stretch = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
        _, word, times = np.unique(stretch * (int(x.max()) + 1) + x[at], return_inverse=True, return_counts=True)
        good = (times[word] >= periods) & (np.bincount(stretch)[stretch] >= least)
        if good.all():
            return at
        at = at[good]
    return at


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sa, rank, lcp): suffixes in order, their places, and the common prefix of each with the one before (lcp[0] = 0).

    Prefix doubling: a rank is the place of the first suffix with the same beginning, so only groups that aren't told
    apart yet are sorted again; the ranks of all rounds give the common prefixes.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    fresh = np.concatenate([[True], np.diff(x[order]) != 0])
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, h = [rank.astype(np.int32)], 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(sizes[rank] > 1)
        if not len(open_):
            break
        then = np.where(open_ + h < n, rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + then
        by = np.argsort(key, kind="stable")
        group, key = rank[open_][by], key[by]
        place = np.arange(len(by)) - np.searchsorted(group, group)  # within the old group
        fresh = np.concatenate([[True], np.diff(key) != 0])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
        rank = rank.copy()
        rank[open_[by]] = group + place[start]
        levels.append(rank.astype(np.int32))
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    a, b, lcp = sa[:-1].copy(), sa[1:].copy(), np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        lcp[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return sa, rank, np.concatenate([[0], lcp])


def splits(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, at, right): a split at ``at`` parts the leaves [left, at) from [at, right), which share lcp[at] words."""
    values, n = lcp.tolist(), len(lcp)
    left, right, stack = [0] * n, [n] * n, []
    for k in range(1, n):
        v = values[k]
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = k
        left[k] = stack[-1] if stack else 0
        stack.append(k)
    at = np.flatnonzero(lcp > 0)
    return np.array(left)[at], at, np.array(right)[at]


def branching_repeats(sa: np.ndarray, rank: np.ndarray, lcp: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(i, d): the branching tandem repeats, d words at i and again at i + d."""
    n, (left, at, right) = len(sa), splits(lcp)
    low = at - left <= right - at  # the smaller half
    lo, hi = np.where(low, left, at), np.where(low, at, right)
    other_lo, other_hi, depth = np.where(low, at, left), np.where(low, right, at), lcp[at]
    upto, out = np.cumsum(hi - lo), []
    k = 0
    while k < len(at):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + block, "right")))
        size = (hi - lo)[k:stop]
        node = np.repeat(np.arange(k, stop), size)
        leaf = sa[np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + lo[node]]
        d = depth[node]
        for shift, start in ((d, leaf), (-d, leaf - d)):
            j = leaf + shift
            ok = (j >= 0) & (j < n)
            r = rank[np.where(ok, j, 0)]
            hit = ok & (r >= other_lo[node]) & (r < other_hi[node])
            out.append((start[hit], d[hit]))
        k = stop
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def rotated(x: np.ndarray, start: int, d: int) -> int:
    """Where the run of period d that the repeat at ``start`` belongs to begins."""
    hi, block = start, 64
    while hi:
        lo = max(0, hi - block)
        differ = np.flatnonzero(x[lo:hi] != x[lo + d : hi + d])
        if len(differ):
            return lo + int(differ[-1]) + 1
        hi, block = lo, block * 2
    return 0


def periodic_runs(words: np.ndarray, periods: int = MIN_PERIODS, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least ``least`` words and ``periods`` periods, by start and period."""
    words = np.asarray(words, np.int64)
    at = stretches(words, max(2, periods), max(2, least))
    if not len(at):
        return []
    # Stretches stand apart by words of their own.
    gaps = np.flatnonzero(np.diff(at) != 1) + 1
    x = np.insert(words[at], gaps, int(words.max()) + 1 + np.arange(len(gaps)))
    place = np.insert(at, gaps, -1)
    i, d = branching_repeats(*suffix_array(x))
    # Further back, too, the words must repeat before a run is looked at as a whole.
    reach = np.maximum(periods * d, least)
    end = i + 2 * d
    far = end - reach
    ok = far >= 0
    i, d, end, far = i[ok], d[ok], end[ok], far[ok]
    ok = x[far] == x[far + d]
    i, d, end = i[ok], d[ok], end[ok]
    order = np.lexsort((d, end))
    found: dict[tuple[int, int], int] = {}
    seen: list[tuple[int, int]] = []
    last = -1
    for e, p, s in zip(end[order].tolist(), d[order].tolist(), i[order].tolist(), strict=True):
        if e != last:
            last, seen = e, []
        if any(p % q == 0 and b <= s for q, b in seen):
            continue  # the same run as that of the smaller period
        b = rotated(x, s, p)
        seen.append((p, b))
        if e - b >= max(least, periods * p):
            found.setdefault((b, e), p)
    return sorted((int(place[b]), e - b, p) for (b, e), p in found.items())


def _ids(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if words else np.zeros(0, np.int64)


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(docs: DataFrame, periods: int = MIN_PERIODS, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period), and collapsed: the words, joined by one space, without those
    that a run holds after its first period.

    Words are what stands between ASCII white space. Null, empty and blank texts have no words, no runs and collapse to
    nothing; a text is read whole, however long, with about 200 bytes for each word in its repetitive stretches. A row
    that repeats has a result of its own and a null doc_id is like any other. Columns of ``docs`` keep their names, but
    n_words, runs and collapsed give way to the new ones. An empty table gives an empty table.
    """
    tune(docs.sparkSession)
    out = pa.schema([("n_words", pa.int64()), ("runs", _RUN), ("collapsed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, texts = [], [], []
            for text in b.column(1):
                words = (text.as_py() or b"").split()  # of bytes, at ASCII white space
                found = periodic_runs(_ids(words), periods, least) if len(words) >= least else []
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in found:
                        edge[start + period] += 1
                        edge[start + length] -= 1
                    inside = np.cumsum(edge[:-1]) > 0
                    words, count = [words[k] for k in np.flatnonzero(~inside).tolist()], len(words)
                else:
                    count = len(words)
                n.append(count)
                runs.append([{"start": s, "length": k, "period": p} for s, k, p in found])
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, f.type) for v, f in zip((n, runs, texts), out, strict=True))], ["row", *out.names])

    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("binary").alias("text"))
    run_type = "array<struct<start:long,length:long,period:long>>"
    schema = StructType([rows.schema["row"], StructField("n_words", LongType()), StructField("runs", StructType.fromDDL(f"r {run_type}")["r"].dataType), StructField("collapsed", BinaryType())])
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in out.names]
    return rows.mapInArrow(lean(run), schema).select(*own, "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def collapsed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each text that has a run collapsed; other texts stay as they are, to the byte."""
    rows = docs.select(F.struct("*").alias("r"), "text")
    new = with_runs(rows, **options)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("r.text"))
    return new.select(*(text.alias(c) if c == "text" else F.col(f"r.`{c}`").alias(c) for c in docs.columns))


def strongest(runs: str = "runs") -> Column:
    """The run of the greatest exact length / period, then smallest start, then period; null without a run."""
    better = "x.length * best.period > best.length * x.period or (x.length * best.period = best.length * x.period and (x.start < best.start or (x.start = best.start and x.period < best.period)))"
    return F.expr(f"aggregate(slice({runs}, 2, size({runs})), get({runs}, 0), (best, x) -> if({better}, x, best))")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` as the query is asked to read them: a tenth of the texts, told by a checksum of doc_id, go on as a cycle of
    their own words. A null doc_id has no checksum and its text stays."""
    words = F.expr(r"filter(split(text, '[ \\t-\\r]+'), w -> w <> '')")
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w")).withColumn("_g", F.expr("crc32(cast(doc_id as string)) div 10"))
    d = d.withColumn("_a", F.expr("if(_n > 0, cast(_g % _n as int), 0)"))
    d = d.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    cycle = F.expr("array_join(transform(sequence(0, _n - 1), i -> if(i < _a, _w[i], _w[_a + (i - _a) % _p])), ' ')")
    text = F.when(F.col("_w").isNotNull() & (F.col("_n") > 0), cycle).otherwise(F.col("text"))
    return d.select(*(text.alias(c) if c == "text" else c for c in docs.columns))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the strongest one, and digests of all and of the collapsed text."""
    found = with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", strongest())
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
