"""Phrase collocations from generalised suffix automata.

Every shard, some megabytes of text of one language in a task, becomes a generalised suffix automaton of its pieces, cut
at a depth. A state is a class of phrases that end at the same places; it knows its longest phrase, how many places that
ends at, and by its suffix link the class of the longest suffix that ends elsewhere too. The links form the tree of the
words read backwards, so the states come from sorting each place's last words, nearest first: runs of equal beginnings
are its nodes, and a node that ends no more often than one below it belongs to the same state. The phrases of a length
are read off the states, one for each state that spans it, and their counts are summed over all shards.

Single words and pairs are counted first. Longer phrases are then sent on only where the phrase without its first word
(along the suffix link) and that without its last may both be frequent, by a bitmap over the frequent ones: others can't
be. The counts of what is sent are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, lean, materialise, mix64, small_side, table, tune
from .decontaminate import benchmark_filter, may_contain

MIN_COUNT, MOST_WORDS, TOP, PERCENT = 10, 3, 2000, 50
#: Bytes of text of a shard; a longer text is a shard of its own, cut between pieces.
SHARD_BYTES = 4 << 20
#: Parts of a language that are ranked apart before their best rows meet.
PARTS = 64

_CUT = np.zeros(256, bool)  # between pieces
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = np.zeros(256, bool)  # between words
_GAP[[0x20, 0x09]] = True


class Automaton:
    """States of the generalised suffix automaton of some pieces, for phrases of up to ``depth`` words.

    ``words`` are the words (Arrow), ``back`` has for each state its longest phrase as word numbers from the last word
    backwards (-1 beyond it), ``length`` and ``shortest`` say how many words its phrases have, ``count`` at how many places
    they end, ``link`` which state its suffix link leads to (-1 is the root). ``total`` counts all places.
    """

    def __init__(self, data: np.ndarray, depth: int = MOST_WORDS):
        data = LOWER[data]
        cut = _CUT[data]
        word = ~(cut | _GAP[data])
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(cut), starts)
        self.total = n = len(starts)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        held = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[word])])
        coded = held.dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self._states(ids, piece, depth)

    def _states(self, ids: np.ndarray, piece: np.ndarray, depth: int) -> None:
        n, base = len(ids), len(self.words) + 1
        back = [ids + 1]
        for k in range(1, depth):
            held = np.zeros(n, np.int64)
            held[k:] = np.where(piece[k:] == piece[: n - k], ids[: n - k] + 1, 0)
            back.append(held)
        if base**depth < 2**63:  # the words of a place in one number, which sorts like them
            key = np.zeros(n, np.int64)
            for b in back:
                key = key * base + b
            key.sort()
            for k in range(depth - 1, -1, -1):
                back[k] = key % base
                key //= base
        else:
            order = np.lexsort(back[::-1])
            back = [b[order] for b in back]
        # Nodes of depth k + 1: runs of places that agree in that many words.
        fresh, nodes, above = np.zeros(n, bool), [], None
        if n:
            fresh[0] = True
        for k, b in enumerate(back):
            fresh = fresh.copy()
            fresh[1:] |= b[1:] != b[:-1]
            start = np.flatnonzero(fresh)
            size = np.diff(np.append(start, n))
            real = back[k][start] > 0
            start, size = start[real], size[real]
            parent = np.full(len(start), -1) if above is None else np.searchsorted(above, start, "right") - 1
            nodes.append((start, size, parent))
            above = start
        first = np.cumsum([0] + [len(s) for s, _, _ in nodes])
        count = np.concatenate([c for _, c, _ in nodes])
        parent = np.concatenate([np.where(p >= 0, p + at - (len(nodes[k - 1][0]) if k else 0), -1) for k, ((_, _, p), at) in enumerate(zip(nodes, first[:-1], strict=True))])
        level = np.repeat(np.arange(1, depth + 1), np.diff(first))
        place = np.concatenate([s for s, _, _ in nodes])
        # A node that one below it equals in count gives way to that: the same ends, a longer phrase.
        same = (parent >= 0) & (count == count[parent])
        merged = np.zeros(len(count), bool)
        merged[parent[same]] = True
        shortest, up = level.copy(), parent.copy()
        for _ in range(1, depth):  # up past the nodes that have merged into the state
            go = (up >= 0) & (count[up] == count)
            shortest[go], up[go] = level[up[go]], parent[up[go]]
        state = np.cumsum(~merged) - 1
        # A link leads to a node that may have merged into a longer one; its state is that of the longest below it.
        home = np.where(merged, -1, state)
        for k in range(depth - 1, 0, -1):
            below = np.flatnonzero(same & (level == k + 1))
            home[parent[below]] = home[below]
        keep = ~merged
        self.length, self.shortest, self.count = level[keep], shortest[keep], count[keep]
        self.link = np.where(up[keep] >= 0, home[up[keep]], -1)
        self.back = [np.where(k < self.length, b[place[keep]] - 1, -1) for k, b in enumerate(back)]

    def phrases(self, n: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The different phrases of n words, as word numbers from first to last, and their counts."""
        has = (self.shortest <= n) & (n <= self.length)
        return [b[has] for b in self.back[:n][::-1]], self.count[has]

    def text(self, columns: list[np.ndarray]) -> pa.Array:
        parts = [self.words.take(pa.array(c)) for c in columns]
        return (parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))).cast(pa.string())


def phrase_hash(lang: str, columns: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    out = np.full(len(columns[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for c in columns:
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + hashes[c])
    return out


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


def blocks(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in blocks of about ``size`` bytes, cut between pieces; a piece stays whole."""
    at = 0
    while len(text) - at > size:
        near = np.flatnonzero(_CUT[np.frombuffer(text, np.uint8, size, at)])
        if len(near):
            stop = at + int(near[-1]) + 1
        else:
            stop = at + size
            while stop < len(text):  # the piece goes on: to its end
                near = np.flatnonzero(_CUT[np.frombuffer(text, np.uint8, min(size, len(text) - stop), stop)])
                if len(near):
                    stop += int(near[0]) + 1
                    break
                stop += min(size, len(text) - stop)
        yield text[at:stop]
        at = stop
    yield text[at:]


def _emitted(docs: DataFrame, lengths: tuple[int, ...], filter_: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, words, phrase, f) from each shard; with words = 0 the number of all words. With a filter only phrases whose
    suffix and prefix, one word shorter, it may contain."""
    depth = max(lengths)

    def emit(lang: str, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        made = Automaton(np.frombuffer(b"\n".join(parts), np.uint8), depth)
        hashes = None if filter_ is None else word_hashes(made.words)
        for n in lengths:
            if n == 0:
                yield pa.RecordBatch.from_pydict({"lang": [lang], "words": pa.array([0], pa.int32()), "phrase": [""], "f": [made.total]})
                continue
            columns, count = made.phrases(n)
            if filter_ is not None and len(count):
                ok = may_contain(filter_, phrase_hash(lang, columns[1:], hashes)) & may_contain(filter_, phrase_hash(lang, columns[:-1], hashes))
                columns, count = [c[ok] for c in columns], count[ok]
            for k in range(0, len(count), 100_000):
                part = [c[k : k + 100_000] for c in columns]
                m = len(part[0])
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(m, np.int32))), pa.array(np.full(m, n, np.int32)), made.text(part), pa.array(count[k : k + m].astype(np.int64))], ["lang", "words", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for part in blocks(text.as_py() or b"", shard_bytes):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= shard_bytes:
                        for name, parts in held.items():
                            yield from emit(name, parts)
                        held, size = {}, 0
        for name, parts in held.items():
            yield from emit(name, parts)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "lang string, words int, phrase string, f long")


def _summed(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def _filter_of(frequent: DataFrame) -> np.ndarray:
    """Bitmap over (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [p.split(" ") for p in b.column(1).to_pylist()]
            h = [phrase_hash(lang, [np.arange(k, k + 1) for k in range(len(w))], word_hashes(pa.array(w)))[0] for lang, w in zip(b.column(0).to_pylist(), words, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], ["h"])

    return benchmark_filter(materialise(frequent.select("lang", "phrase").mapInArrow(lean(run), "h long").distinct()))


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, most: int = MOST_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, words, phrase, f): how often each phrase of up to ``most`` words occurs, for those that do ``least`` times, and
    with words = 0 the number of all words of the language."""
    tune(docs.sparkSession)
    found = materialise(_summed(_emitted(docs, tuple(range(min(most, 2) + 1)), None, shard_bytes), least))
    last = found
    for n in range(3, most + 1):
        last = materialise(_summed(_emitted(docs, (n,), _filter_of(last.where(F.col("words") == n - 1)), shard_bytes), least))
        found = found.unionByName(last)
    return found


def collocations(docs: DataFrame, least: int = MIN_COUNT, most: int = MOST_WORDS, top: int = TOP, percent: int = PERCENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two or more words.

    The score is the least floor(1000000 a a / (l r)) over the cuts of a phrase in two, the first such cut counting.
    A phrase inside a longer candidate that occurs at least ``percent`` hundredths as often goes. A null lang is the
    language und, a null or empty text has no words, and texts are read whole (a shard holds one piece at least, so memory
    grows with the longest piece without punctuation). Repeated rows count as often as they are there. Further columns
    aren't read, so their names don't matter; an empty table gives an empty result.
    """
    counts = phrase_counts(docs, least, most, shard_bytes)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where(F.col("words").between(1, most - 1)).select("lang", "phrase", "f")
    many = counts.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"))
    # A part of a candidate is at least as frequent, so it is counted.
    cut = F.explode(F.expr("transform(sequence(1, words - 1), k -> struct(k, substring_index(phrase, ' ', k) as first, substring_index(phrase, ' ', k - words) as rest))"))
    cuts = many.withColumn("c", cut).select("lang", "words", "phrase", "a", "c.*")
    side = small_side(parts)
    cuts = cuts.join(side.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(side.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    big = lambda c: f"cast({c} as decimal(18, 0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(1000000 as decimal(7, 0)) * ({big('a')} * {big('a')}) div ({big('l')} * {big('r')})"))
    best = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every shorter run of words of a longer candidate, each once with the most frequent of those that hold it.
    inner = F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m), k -> substring_index(substring_index(phrase, ' ', k + m), ' ', -m))))"))
    longer = many.where("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = kept.withColumn("p", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("p") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) t FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) phrase FROM w, range(1, 4) x(k)),
c AS MATERIALIZED (SELECT lang, k, phrase, count(*) f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
u AS (SELECT lang, k words, phrase, f a, unnest(range(1, k)) k, string_split(phrase, ' ') s FROM c WHERE k > 1),
v AS (SELECT u.lang, u.words, u.phrase, u.a, u.k, l.f l, r.f r, (1000000::HUGEINT * u.a * u.a) // (l.f::HUGEINT * r.f) score
  FROM u JOIN c l ON l.lang = u.lang AND l.phrase = array_to_string(s[:u.k], ' ') JOIN c r ON r.lang = u.lang AND r.phrase = array_to_string(s[u.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) i FROM v),
x AS (SELECT lang, array_to_string(string_split(phrase, ' ')[j : j + 1], ' ') phrase, max(f) longer FROM c, (SELECT unnest([1, 2]) j) WHERE k = 3 GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) rank FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase
  WHERE i = 1 AND (longer IS NULL OR 100 * longer < {PERCENT} * a))
SELECT o.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN t ON t.lang = o.lang WHERE rank <= {TOP}
"""
