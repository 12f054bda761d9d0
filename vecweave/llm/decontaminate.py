"""Benchmark decontamination by winnowing.

Texts are cut into lower-cased words. Every k-gram of words is hashed, and in each run of w neighbouring k-grams those
with the smallest hash are kept as fingerprints: two texts that share k + w - 1 words share a fingerprint inside the
shared span, so no shared window is missed. Fingerprints of documents that a filter over the benchmark's fingerprints may
contain are joined with the benchmark's distinct ones, and each hit is extended to the windows around it, which are
joined with the benchmark's distinct windows and their items. Both joins give one row at most for each row of a document,
and a document has one row for each different gram or window, so stock phrases and short items don't multiply. Items
shorter than a window are matched whole by grams of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, lean, materialise, mix64, slice_hashes, small_side, table, text_bytes, text_key, tune, without_rows

WINDOW, GRAM = 10, 5
#: Bits of the filter for each fingerprint of the benchmark, and the least and the most of all (as powers of two). Where
#: the most (32 MB) is too few, more fingerprints of documents pass, and the joins do the rest.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28
#: Pairs of an item and a window, and distinct fingerprints, up to which the benchmark's side of a join is broadcast.
SMALL = 200_000

_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_WORD[0x41:0x5B] = True  # lower-cased before they are words

_WIN = pa.struct([("text", pa.string()), ("at", pa.list_(pa.int32()))])
_GRAM = pa.struct([("h", pa.int64()), ("kind", pa.int32()), ("core", pa.string()), ("wins", pa.list_(_WIN))])
_FP = "rid long, id long, key long, n_words long, fps array<struct<h:long,kind:int,core:string,wins:array<struct<text:string,at:array<int>>>>>"


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and each text's first word (one more entry than texts)."""
    data = LOWER[data]
    m = _WORD[data]
    edges = at[(at > 0) & (at < len(data))]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    first[edges] = m[edges]
    last[:-1] &= ~m[1:]
    last[edges - 1] = m[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, starts, ends, np.searchsorted(starts, at)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words that begin at a word; len(h) - n + 1 of them."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(out)]
    return mix64(out + np.uint64(n))


def winnow(g: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Which grams are the smallest of at least one run of w grams; ties all count."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    g = np.where(valid, g, top)
    if len(g) < w:
        low = np.full(len(g), g.min() if len(g) else top)
        return valid & (g == low)
    low = g[: len(g) - w + 1].copy()
    for k in range(1, w):
        np.minimum(low, g[k : k + len(low)], out=low)
    high = np.zeros(len(g), np.uint64)
    for k in range(w):
        np.maximum(high[k : k + len(low)], low, out=high[k : k + len(low)])
    return valid & (g == high)


def may_contain(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    six, low, bits = np.uint64(6), np.uint64(63), np.uint64(64 * len(filter_) - 1)
    a, b = h & bits, (h >> np.uint64(32)) & bits
    return ((filter_[(a >> six).astype(np.int64)] >> (a & low)) & (filter_[(b >> six).astype(np.int64)] >> (b & low)) & np.uint64(1)).astype(bool)


def fingerprint_rows(items: DataFrame, id_column: str, filter_: np.ndarray | None, short: list[int] | None, window: int, gram: int) -> DataFrame:
    """One row for each row of ``items``, in the form of _FP: each different gram with the windows that hold it.

    Without a filter (the benchmark) every fingerprint is kept, and an item of fewer than ``window`` words is one gram
    of its own length. With one (documents) only those that the filter may contain, and grams of the lengths ``short``.
    A gram of kind zero is a fingerprint; one of another kind is a whole short item and its own only window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            data, starts, ends, first = words_of(*text_bytes(b.column(2)))
            n_docs = len(b)
            h = slice_hashes(data, starts, ends)
            counts = np.diff(first)
            of = np.repeat(np.arange(n_docs), counts)
            stop = np.repeat(first[1:], counts)  # of each word, the first word of the next text
            g = gram_hashes(h, gram)
            ok = np.arange(len(g)) + gram <= stop[: len(g)]
            if filter_ is None:
                ok &= counts[of[: len(g)]] >= window
            got = np.flatnonzero(winnow(g, ok, window - gram + 1))
            picked = [(got, g[got], 0)]
            for k in range(1, window) if filter_ is None else short:
                g = gram_hashes(h, k)
                at = first[:-1][counts == k] if filter_ is None else np.flatnonzero(np.arange(len(g)) + k <= stop[: len(g)])
                picked.append((at, g[at], k))
            rows: list[dict[tuple, dict[str, list[int]]]] = [{} for _ in range(n_docs)]
            words = lambda i, j: " ".join(data[x:y].tobytes().decode() for x, y in zip(starts[i:j], ends[i:j], strict=True))
            for at, hashes, kind in picked:
                if filter_ is not None and len(at):
                    hit = may_contain(filter_, hashes)
                    at, hashes = at[hit], hashes[hit]
                for w, x in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    d = int(of[w])
                    lo, hi = int(first[d]), int(first[d + 1])
                    wins = rows[d].setdefault((x, kind, words(w, w + (kind or gram))), {})
                    for s in (w,) if kind else range(max(lo, w + gram - window), min(w, hi - window) + 1):
                        wins.setdefault(words(s, s + (kind or window)), []).append(s - lo)
            fps = pa.array([[{"h": h, "kind": k, "core": c, "wins": [{"text": t, "at": p} for t, p in wins.items()]} for (h, k, c), wins in r.items()] for r in rows], pa.list_(_GRAM))
            rid = pa.array(part + seen + np.arange(n_docs))
            seen += n_docs
            yield pa.RecordBatch.from_arrays([rid, b.column(0), b.column(1), pa.array(counts.astype(np.int64)), fps], ["rid", "id", "key", "n_words", "fps"])

    return items.select(F.col(id_column).cast("long").alias("id"), text_key().alias("key"), "text").mapInArrow(lean(run), _FP)


def benchmark_filter(grams: DataFrame) -> np.ndarray:
    """Two bits for each of the distinct ``grams(h)`` in a bitmap sized by their number."""
    power = int(np.ceil(np.log2(BITS_EACH * max(1, grams.count()))))
    low = (1 << min(MOST_BITS, max(LEAST_BITS, power))) - 1
    bits = grams.select(F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32).bitwiseAND(low))).alias("b"))
    # At most one row for each word of the bitmap reaches the driver.
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v")).toArrow()
    out = np.zeros((low + 1) // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.view(np.uint64)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``docs``: doc_id, key, n_words, n_hit, n_items, item_ids (sorted strings), spans, contaminated.

    ``key`` is the text's. A span is a window's [first, past last) in words. Null or wordless texts have no words and no
    hits; texts of any length are read whole; wordless items never occur; items with equal text all count; a row that
    repeats has a result of its own; rows with a null doc_id are judged like any other, and items with a null item_id
    mark words but aren't listed. Further columns aren't read, so their names don't matter. An empty benchmark hits
    nothing; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    items = materialise(fingerprint_rows(benchmark, "item_id", None, None, window, gram).select(F.col("id").cast("string").alias("item"), F.explode("fps").alias("f")))
    grams = materialise(items.select("f.h", "f.kind", "f.core").distinct())
    pairs = materialise(items.select("item", "f.kind", F.explode("f.wins.text").alias("text")).distinct())
    wins = pairs.groupBy("kind", "text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    wins = F.broadcast(wins) if pairs.limit(SMALL + 1).count() <= SMALL else wins
    short = sorted(r.kind for r in grams.where("kind > 0").select("kind").distinct().collect())
    found = fingerprint_rows(docs, "doc_id", benchmark_filter(grams), short, window, gram)
    # Rows without a gram or window keep their own number as the key, so that they don't gather in one task.
    d = found.select("rid", "id", "key", "n_words", F.explode_outer("fps").alias("d"))
    d = d.select("rid", "id", "key", "n_words", F.coalesce("d.h", "rid").alias("h"), F.coalesce("d.kind", F.lit(-1)).alias("kind"), F.coalesce("d.core", F.lit("")).alias("core"), "d.wins")
    d = d.join(small_side(grams.withColumn("real", F.lit(True)), SMALL), ["h", "kind", "core"], "left")
    w = d.select("rid", "id", "key", "n_words", "kind", F.explode_outer(F.when(F.col("real"), F.col("wins"))).alias("w"))
    w = w.select("rid", "id", "key", "n_words", "w.at", F.when(F.col("w").isNull(), -1).otherwise(F.col("kind")).alias("kind"), F.coalesce("w.text", F.col("rid").cast("string")).alias("text"))
    size = F.when(F.col("kind") > 0, F.col("kind")).otherwise(window)
    hits = w.join(wins, ["kind", "text"], "left").withColumn("size", size)
    span = F.when(F.col("items").isNotNull(), F.transform("at", lambda a: F.struct(a.alias("a"), (a + F.col("size")).alias("b"))))
    found = hits.groupBy("rid", "id", "key", "n_words").agg(F.collect_list(span).alias("spans"), F.collect_set("items").alias("items"))
    found = found.withColumn("all", F.array_sort(F.flatten("spans"))).withColumn("item_ids", F.array_sort(F.array_distinct(F.flatten("items"))))
    found = found.withColumn("spans", F.expr("filter(all, (x, i) -> i = 0 or x <> all[i - 1])"))
    merged = "aggregate(spans, struct(0L as n, 0 as past), (s, x) -> struct(s.n + greatest(0, x.b - greatest(x.a, s.past)) as n, greatest(s.past, x.b) as past)).n"
    return found.select(F.col("id").alias("doc_id"), "key", "n_words", F.expr(merged).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans", (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; each row follows its own text, with or without a doc_id."""
    return without_rows(docs, contamination(docs, benchmark, **options).where("contaminated"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_SQL_WORDS} w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') win
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) k FROM d, (SELECT DISTINCT n FROM iw))),
h AS MATERIALIZED (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
p AS (SELECT doc_id, count(DISTINCT q) hit FROM (SELECT doc_id, unnest(range(k, k + n)) q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
