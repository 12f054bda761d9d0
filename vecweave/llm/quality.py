"""Quality: a weak-label model over heuristic labellers, whose posterior labels train a hashed linear scorer.

Each labeller votes for good, against, or abstains. Votes of all documents are counted by pattern; expectation
maximisation on the counts estimates each labeller's accuracy and the share of good documents, without any given
label. Posteriors of a bounded sample are then the targets of a logistic scorer on hashed word shapes, word endings and
repetition, which scores every document.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, tune

#: Characters of a word whose shape counts as one; longer words, such as texts without white space, are cut into such pieces.
PIECE = 24
#: Documents whose posteriors train the scorer (those with the smallest hash of doc_id and text), and hashed dimensions.
TRAIN_ROWS, DIMS = 6_000, 2_048
KEEP_AT = 0.5
LABELLERS = ("signs", "lines", "variety", "repeats", "word_length", "common_words", "sentences", "shouting", "cells")

COMMON = frozenset("the of and to in a is that it with on for as was by be are this der die das und in zu den ein nicht mit von la le les de et des un une en du que el los las y por con se del para".split())
_ENDS = frozenset(".!?…:;\"'»)")
_LETTER, _HEAD = np.zeros(256, bool), np.ones(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:] = True
_HEAD[0x80:0xC0] = False


class Traits(dict):
    """Whether a word is common, shouted, a cell's bar; remembered up to a bound."""

    def __missing__(self, w: str) -> tuple[bool, bool, bool]:
        out = (w.lower().strip(".,;:!?") in COMMON, len(w) > 1 and w.isupper(), w in ("|", "||", "-", "*", "•"))
        if len(self) > 200_000:
            self.clear()
        if len(w) <= 40:
            self[w] = out
        return out


_traits = Traits()


def votes(text: str) -> str:
    """One vote for each labeller: + good, - bad, 0 abstains; those that look for one kind of junk never vote +."""
    words = text.split()
    n = len(words)
    if not n:
        return "-" * len(LABELLERS)
    out = []
    put = lambda good, bad: out.append("+" if good else "-" if bad else "0")
    solid = np.frombuffer("".join(words).encode(), np.uint8)
    letters, chars = int(_LETTER[solid].sum()), int(_HEAD[solid].sum())
    put(letters >= 0.93 * chars, letters < 0.85 * chars)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    put(False, len(lines) > 3 and len(set(lines)) < 0.7 * len(lines))
    variety, most = len(set(words)) / n, min(1, (400 / n) ** 0.5)
    put(n >= 20 and variety >= 0.3 * most, n >= 20 and variety < 0.2 * most)
    put(False, n >= 8 and sum(map(operator.eq, words, words[1:])) > 0.1 * n)
    mean = chars / n
    put(3 <= mean <= 9, mean < 2 or mean > 14)
    known, loud, bars = map(sum, zip(*map(_traits.__getitem__, words), strict=True))
    put(known >= 0.1 * n, n >= 8 and known < 0.02 * n)
    ended = sum(x[-1] in _ENDS for x in lines)
    put(ended >= 0.6 * len(lines), ended < 0.2 * len(lines))
    put(False, n >= 8 and loud > 0.3 * n)
    put(False, n >= 8 and bars > 0.15 * n)
    return "".join(out)


def voted(docs: DataFrame) -> DataFrame:
    """(doc_id, h, votes) for each row of ``docs``."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([votes(x or "") for x in b.column(2).to_pylist()], pa.string())], ["doc_id", "h", "votes"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("h"), "text")
    return own.mapInArrow(run, "doc_id long, h long, votes string")


def label_model(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """(posterior of good by pattern, (accuracy on good, on bad) by labeller) by expectation maximisation.

    Votes are independent given the class, and abstaining tells nothing. It starts from votes against, which labellers
    give rarely; accuracies are smoothed towards 0.7, so that a labeller that never votes has no say.
    """
    names = sorted(patterns)
    if not names:
        return {}, {}
    v = np.array([[{"+": 1, "-": -1}.get(c, 0) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    q = 1 / (1 + np.exp(3.0 * (v < 0).sum(1) - 2.0))
    good, bad = np.zeros(v.shape[1]), np.zeros(v.shape[1])
    for _ in range(rounds):
        before = q
        for k in range(v.shape[1]):
            on = v[:, k] != 0
            good[k] = ((n * q)[on & (v[:, k] > 0)].sum() + 7) / ((n * q)[on].sum() + 10)
            bad[k] = ((n * (1 - q))[on & (v[:, k] < 0)].sum() + 7) / ((n * (1 - q))[on].sum() + 10)
        share = ((n * q).sum() + 1) / (n.sum() + 2)
        z = np.log(share / (1 - share)) + np.where(v > 0, np.log(good / (1 - bad)), np.where(v < 0, np.log((1 - good) / bad), 0)).sum(1)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(q - before).max() < 1e-9:
            break
    return dict(zip(names, q.tolist(), strict=True)), {k: (float(a), float(b)) for k, a, b in zip(LABELLERS, good, bad, strict=False)}


class Shape(dict):
    """Translation of characters to A, a, 9 or themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return out


class Named(dict):
    """Hashed dimensions of shapes and endings, which are few."""

    def __missing__(self, name: str) -> int:
        out = xxhash.xxh64_intdigest(name) % DIMS
        if len(self) < 100_000:
            self[name] = out
        return out


class Dims(dict):
    """Hashed dimensions of a word's shape and of its ending; remembered up to a bound."""

    shape, named, again = Shape(), Named(), re.compile(r"(.)\1+")

    def __missing__(self, w: str) -> tuple[int, int]:
        out = (self.named["s" + self.again.sub(r"\1", w.translate(self.shape))], self.named["e" + w[-2:]])
        if len(self) > 200_000:
            self.clear()
        self[w] = out
        return out


_dims = Dims()


def pieces(text: str) -> list[str]:
    """The text's words, those of more than PIECE characters cut."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]


def hashed(text: str) -> np.ndarray:
    """Shares of the text's words in each hashed dimension, and the words that repeat the one before."""
    words = pieces(text)
    if not words:
        return np.zeros(DIMS, np.float32)
    dims = np.array(list(map(_dims.__getitem__, words)))
    out = np.bincount(dims[:, 0], minlength=DIMS) + np.bincount(dims[:, 1], minlength=DIMS).astype(float)
    out[0] += 2 * sum(map(operator.eq, words, words[1:]))
    out[1] += 2 * len(words) - 2 * len(set(words))
    return np.sqrt(out / len(words)).astype(np.float32)


def fit_scorer(x: np.ndarray, q: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression to soft labels by accelerated gradient descent; classes weigh the same.

    ``x`` is float32 and so is all that meets it, else every product would convert the whole matrix.
    """
    w, b, past = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32)
    share = float(np.clip(q.mean(), 0.01, 0.99)) if len(q) else 0.5
    weight = (q / share + (1 - q) / (1 - share)) / max(1, len(q))
    back = np.ascontiguousarray(x.T)
    for _ in range(rounds if len(q) else 0):
        g = weight * (1 / (1 + np.exp(-((x @ (w + np.float32(0.9) * past)).astype(float) + b))) - q)
        past = np.float32(0.9) * past - np.float32(rate) * (back @ g.astype(np.float32) + np.float32(decay) * w)
        w, b = w + past, b - rate * g.sum()
    return w, float(b)


def quality(docs: DataFrame, rows: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) for each row of ``docs``.

    Null, empty and blank texts get a vote against from every labeller. Texts of any length are read whole. Repeated
    rows get equal results; a null doc_id is a value like any other. Further columns of ``docs`` aren't read, so their
    names don't matter. An empty table gives an empty result.
    """
    found = materialise(voted(docs))
    # At most 3 to the number of labellers patterns reach the driver, counted over all documents.
    counts = {r.votes: r["count"] for r in found.groupBy("votes").count().collect()}
    posterior, _ = label_model(counts)
    picked = found.select("h").distinct().orderBy("h").limit(rows)
    sample = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "h", "left_semi").dropDuplicates(["h"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [hashed(t) for t in b.column(1).to_pylist()]
            on = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(on, pa.list_(pa.int32())), pa.array([r[k] for r, k in zip(x, on, strict=True)], pa.list_(pa.float32())), pa.array([posterior[votes(t)] for t in b.column(1).to_pylist()])],
                ["h", "k", "v", "q"],
            )

    got = sample.mapInArrow(measure, "h long, k array<int>, v array<float>, q double").toArrow().sort_by("h")
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (k, v) in enumerate(zip(got.column("k"), got.column("v"), strict=True)):
        x[i, k.values.to_numpy()] = v.values.to_numpy()
    w, bias = fit_scorer(x, got.column("q").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array([float(hashed(x) @ w) if x and x.strip() else -30.0 for x in b.column(2).to_pylist()]) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-z)), pa.float64())], ["doc_id", "h", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, score double")
    # A row for each pattern of votes.
    given = docs.sparkSession.createDataFrame(sorted(posterior.items()), "votes string, posterior double")
    told = found.select("h", "votes").dropDuplicates(["h"]).join(F.broadcast(given), "votes")
    return scored.join(told, "h").select("doc_id", "votes", "posterior", "score", (F.col("score") >= keep_at).alias("keep"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality(table(spark, sf_dir, "documents"))
