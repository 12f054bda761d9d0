"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Lexicons come from the training rows: words and word stems whose share of toxic documents is far above that of others,
and a short list of common insults. Features are lexicon densities, their nearness to second-person words, capitals,
punctuation and obfuscation rates. The trees are fitted on features whose lexicon comes from the other half of the
training rows, and the calibration on scores of trees fitted on the other half, so neither has seen its own rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise, table, text_key, tune, without_rows

#: Bound of the labelled rows that are fitted on (those with the smallest hash of doc_id), and of a lexicon.
TRAIN_ROWS, LEXICON = 20_000, 4_000
REJECT_AT = 0.7
#: A word is in the lexicon if it is in so many toxic documents and its smoothed log odds reach the bound.
LEAST, ODDS, STRONG = 6, 2.5, 4.0
#: Words whose counts a worker gathers before it gives them out.
COUNTED = 60_000
TREES, DEPTH, BINS, RATE = 80, 3, 32, 0.15

INSULTS = frozenset("idiot idiots moron stupid dumb loser trash scum worthless pathetic disgusting ugly fool kill hate shut freak clown dummkopf arschloch connard imbécile estúpido imbécil".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())

_WORD = re.compile(r"[^\W_]+(?:['’\-*@$!.][^\W_]+)*[@$!*]*")
_SIGNS = str.maketrans("013457@$!", "oieastasi", "*.-'’")
FEATURES = ("strong_density", "strong_count", "weak_density", "max_odds", "odds_density", "insult_density", "near_you", "you_density", "capitals", "shouted_words", "exclaiming", "signs", "obfuscated", "obfuscated_hits", "log_words")

_UPPER, _EXCLAIM, _SIGN, _LETTER = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_EXCLAIM[[33, 63]] = True
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _SIGN[_a:_b] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def stems(word: str) -> list[str]:
    """The word and, for longer ones, its first letters."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


class Words(dict):
    """What the lexicon says of a written word: log odds, insult, second person, obfuscated, hit only when read plainly."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def odds(self, word: str) -> float:
        return max((self.lexicon.get(x, 0.0) for x in stems(word)), default=0.0)

    def __missing__(self, written: str) -> tuple[float, bool, bool, bool, bool, bool]:
        word = written.lower().rstrip("!*.")
        plain = word.translate(_SIGNS)
        odds, insult = self.odds(word), word in INSULTS
        odd = plain != word and any(c.isalpha() for c in word)
        hit = odd and not odds and not insult and (self.odds(plain) >= STRONG or plain in INSULTS)
        out = (self.odds(plain) if hit else odds, insult or hit, word in YOU, odd, hit, len(written) > 2 and written.isupper())
        if len(self) > 100_000:
            self.clear()
        if len(written) <= 40:
            self[written] = out
        return out


def rates(texts: pa.Array, lexicon: dict[str, float], words: Words | None = None) -> np.ndarray:
    """One row of FEATURES for each text; all zero for null, empty and wordless texts but for the sign rates."""
    words = Words(lexicon) if words is None else words
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        n, letters = len(raw), max(1, int(_LETTER[raw].sum()))
        out[i, 8], out[i, 10], out[i, 11] = _UPPER[raw].sum() / letters, _EXCLAIM[raw].sum() / n, _SIGN[raw].sum() / n
        got = list(map(words.__getitem__, _WORD.findall(text)))
        if not got:
            continue
        m = len(got)
        odds, insult, you, odd, hit, loud = zip(*got, strict=True)
        odds, insult, you = np.array(odds), np.array(insult), np.array(you)
        strong = (odds >= STRONG) | insult
        here, there = np.flatnonzero(strong), np.flatnonzero(you)
        near = 0
        if len(here) and len(there):
            k = np.clip(np.searchsorted(there, here), 1, len(there)) - 1
            after = np.minimum(k + 1, len(there) - 1)
            near = int((np.minimum(np.abs(here - there[k]), np.abs(there[after] - here)) <= 5).sum())
        out[i, :8] = len(here) / m, np.log1p(len(here)), ((odds > 0) & ~strong).sum() / m, odds.max(), odds.sum() / m, insult.mean(), near / m, you.mean()
        out[i, 9], out[i, 12], out[i, 13], out[i, 14] = sum(loud) / m, sum(odd) / m, sum(hit) / m, np.log1p(m)
    return out


def lexicon_of(counts: list[tuple[str, int, int]], toxic: int, others: int) -> dict[str, float]:
    """Log odds of the words whose counts (toxic documents, others) reach the bounds; the LEXICON strongest of them."""
    found = {w: float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (others + 1))) for w, a, b in counts if a >= LEAST}
    best = sorted(((v, w) for w, v in found.items() if v >= ODDS), key=lambda x: (-x[0], x[1]))[:LEXICON]
    return {w: v for v, w in best}


class Trees:
    """Boosted regression trees of fixed depth on binned features, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        z = np.full(len(y), self.base)
        for _ in range(TREES if len(np.unique(y)) > 1 else 0):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            z += RATE * self._leaf(b, tree)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | np.ndarray]:
        """For each level the feature and bin of every node's cut, and at last the leaves' values."""
        node, levels = np.zeros(len(b), int), []
        for depth in range(DEPTH):
            n = 1 << depth
            best, feature, cut = np.zeros(n), np.zeros(n, int), np.full(n, BINS)
            for f in range(b.shape[1]):
                k = node * BINS + b[:, f]
                gs, hs = (np.bincount(k, v, n * BINS).reshape(n, BINS).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 2) | (ht - hs < 2)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(n), at] > best + 1e-9
                best[better], feature[better], cut[better] = gain[np.arange(n), at][better], f, at[better]
            levels.append((feature, cut))
            node = 2 * node + (b[np.arange(len(b)), feature[node]] > cut[node])
        n = 1 << DEPTH
        gs, hs = np.bincount(node, g, n), np.bincount(node, h, n)
        return [*levels, gs / (hs + 1)]

    @staticmethod
    def _leaf(b: np.ndarray, tree: list) -> np.ndarray:
        node = np.zeros(len(b), int)
        for feature, cut in tree[:-1]:
            node = 2 * node + (b[np.arange(len(b)), feature[node]] > cut[node])
        return tree[-1][node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + RATE * sum((self._leaf(b, t) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing fit, by pooling adjacent violators; each block is smoothed."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    p = np.array([v for b in blocks for v in [(b[0] + 0.02) / (b[1] + 0.04)] * 2])
    return x, np.maximum.accumulate(p)


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """The model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; None without a toxic and another row.

    Rows without a label or an id aren't fitted on; of rows with equal text one is, toxic if
    any of them is so labelled. Counts of words are made where the
    rows are; what reaches the driver is the lexicon, and FEATURES of at most ``rows`` rows.
    """
    some = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = docs.join(F.broadcast(some), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.max("toxic").alias("toxic"))
    held = materialise(held.withColumn("half", F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: dict[tuple[int, int], Counter] = {(h, t): Counter() for h in (0, 1) for t in (0, 1)}

        def told(least: int) -> Iterator[pa.RecordBatch]:
            for (h, t), c in both.items():
                if len(c) >= least:
                    part = list(c)
                    yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "half": pa.array([h] * len(part), pa.int32()), "toxic": pa.array([t] * len(part), pa.int32()), "n": pa.array([c[w] for w in part], pa.int64())})
                    c.clear()

        for b in batches:
            for t, text, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                both[h, t].update({s for w in set(_WORD.findall(text.lower())) for s in stems(w)})
                yield from told(COUNTED)  # counts of a word are added up later, so a worker holds a bounded number
        yield from told(1)

    sizes = {(r.half, r.toxic): r["count"] for r in held.groupBy("half", "toxic").count().collect()}
    if not any(n for (_, t), n in sizes.items() if t == 1) or not any(n for (_, t), n in sizes.items() if t == 0):
        return None
    cell = lambda h, t: F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0))
    counts = held.select("toxic", "text", "half").mapInArrow(lean(count), "word string, half int, toxic int, n long").groupBy("word").agg(*(cell(h, t).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)))
    # Words of too few toxic documents can't enter a lexicon, so at most (words of the toxic rows) / LEAST words are left.
    counts = counts.where(F.greatest(F.col("n01"), F.col("n11"), F.col("n01") + F.col("n11")) >= LEAST)
    total = lambda t, *hs: sum(sizes.get((h, t), 0) for h in hs)
    odds = lambda a, b, t, o: F.log((a + 0.5) / (t + 1)) - F.log((b + 0.5) / (o + 1))

    def lexicon(*hs: int) -> dict[str, float]:
        a, b = (sum((F.col(f"n{h}{t}") for h in hs[1:]), F.col(f"n{hs[0]}{t}")) for t in (1, 0))
        value = odds(a, b, total(1, *hs), total(0, *hs))
        top = counts.select("word", a.alias("a"), b.alias("b"), value.alias("v")).where(f"a >= {LEAST} and v >= {ODDS}").orderBy(F.desc("v"), "word").limit(LEXICON)
        return lexicon_of([(r.word, r.a, r.b) for r in top.collect()], total(1, *hs), total(0, *hs))

    counts = materialise(counts)
    whole, other = lexicon(0, 1), {0: lexicon(1), 1: lexicon(0)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {h: Words(other[h]) for h in other}
        for b in batches:
            half = b.column(2).to_numpy()
            x = np.zeros((len(b), len(FEATURES)))
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                x[at] = rates(b.column(1).take(pa.array(at)), other[h], words[h])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "half", "x"])

    got = held.select("toxic", "text", "half").mapInArrow(lean(measure), "toxic int, half int, x array<double>").orderBy("half", "toxic", "x").collect()
    x, y, half = np.array([r.x for r in got]), np.array([r.toxic for r in got], float), np.array([r.half for r in got])
    raw = np.zeros(len(y))
    for h in (0, 1):
        if (half != h).any() and (half == h).any():
            raw[half == h] = Trees(x[half != h], y[half != h]).raw(x[half == h])
    return Model(whole, Trees(x, y), isotonic(raw, y))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, key, score) for each row of ``docs``, key being its text's; without a model every score is zero."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.lexicon) if model else None
        for b in batches:
            s = model.score(rates(b.column(2), model.lexicon, words)) if model else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["doc_id", "key", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text").mapInArrow(lean(run), "doc_id long, key long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels aren't learned from; a null doc_id has no label to learn."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, key, held_out, score, predicted) for each row of ``docs``, learning from labels of rows not held out.

    Null and empty texts are scored like any other, and texts of any length whole; rows of equal text get equal scores,
    whatever their doc_id; further columns of ``docs`` aren't read, so their names don't matter; empty tables give
    empty results.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), rows)
    found = score(docs, model)
    return found.select("doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= reject_at).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; each row follows its own text, with or without a doc_id."""
    return without_rows(docs, toxicity(docs, labels, **options).where("predicted = 1"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")
