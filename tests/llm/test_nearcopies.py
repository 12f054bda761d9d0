"""The pipeline's near copies against brute force."""

import random
import time

import numpy as np

import corpus_pipeline
from vecweave.llm import nearcopies
from vecweave.llm.common import table


def plain(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute(rows):
    """Root of each row of (doc_id, text), by the smallest index that five-word similarity reaches."""
    sets, root = [plain(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sorted((len(sets[i]), len(sets[j])))  # sizes too far apart can't be similar
            if 5 * a >= 4 * b and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_stage_finds_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 7)  # so that large groups are dealt out in blocks
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(120)] for _ in range(12)]
    rows = [(100 * k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base):
        for e in range(40 if k == 0 else 4):  # one to six changed words; five-word similarity from 0.92 down to 0.6
            v = list(w)
            for _ in range(1 + e % 6):
                v[rng.randrange(len(v))] = word()
            rows.append((100 * k + 1 + e, " ".join(v)))
    rows += [(5000, rows[0][1].upper()), (5001, None), (5002, " "), (5003, "a b"), (5004, "a c"), (None, rows[1][1]), (None, "has no id"), (300, "another text of the id"), rows[3], rows[3]]
    got = corpus_pipeline.near_copies_out(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    best = {}
    for r, k in zip(rows, brute(rows), strict=True):
        best[k] = min(best.get(k, (True, 0)), (r[0] is None, r[0] or 0))
    assert got.columns == ["doc_id", "text"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(best.values())
    assert nearcopies.keep_one_near(got.limit(0)).count() == 0


def test_planted_pairs_of_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    roots = {}
    for r, k in zip(rows, brute(rows), strict=True):
        roots.setdefault(k, r[0])
    assert sorted(r.doc_id for r in nearcopies.keep_one_near(docs).collect()) == sorted(roots.values())


def test_links_of_sets_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 14, 12).astype(np.uint64)) for _ in range(150)]
    parent = list(range(150))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in nearcopies.exact_links(sets):
        assert len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
        parent[find(a)] = find(b)
    for i in range(150):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                assert find(i) == find(j)


def test_rounds_leave_no_shuffle_files(spark):
    """Rows that are checkpointed leave none of the shuffle files that led to them, whatever the driver's garbage."""
    from pyspark.sql import functions as F

    from vecweave.llm import common
    from vecweave.operators.graph import materialise as of_graphs

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.length()) if found.apply(k).getName().startswith("shuffle_")}

    before, gone = files(), time.time() + 20
    for materialise in (common.materialise, of_graphs):
        rows = materialise(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.count("*").alias("n")).repartition(3, "n"))
        assert [r.n for r in rows.collect()] == [4] * 5_000  # a count would shuffle
    while files() - before and time.time() < gone:  # executors drop them when they are told to
        time.sleep(0.2)
    assert not {f for f in files() - before if f.endswith(".data")}
