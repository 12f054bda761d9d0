"""Triangles by triples of colours, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from vecweave.operators import graph as G
from vecweave.operators import triples as T

LONGS = "u long, v long"


@pytest.mark.parametrize("far", [1, 1 << 56])
@pytest.mark.parametrize("in_task", [6_000_000, 30])
def test_triangle_counts_by_colours(spark, far, in_task):
    rng = random.Random(7)
    pairs = {tuple(sorted(rng.sample(range(-20, 40), 2))) for _ in range(500)} | {(0, k) for k in range(40, 90)}
    want = {}
    for a, b in pairs:
        for c in range(b + 1, 90):
            if (b, c) in pairs and (a, c) in pairs:
                for x in (a, b, c):
                    want[x * far] = want.get(x * far, 0) + 1
    e = spark.createDataFrame([(a * far, b * far) for a, b in pairs], LONGS)
    assert len(want) > 50 and {r.id: r.triangles for r in G.triangle_counts(e, in_task).collect()} == want
    assert G.triangle_counts(e.where("false"), in_task).count() == 0


def test_what_edges_take_along_grows_with_the_colours_only(spark):
    """Before, each edge took the array of edges out of its first end along: some 1,000 bytes for each edge here."""
    e = spark.range(1000).select(F.col("id").alias("u")).join(spark.range(1000).select(F.col("id").alias("v"))).where("u < v and (u + v) % 2 = 0")
    p = T.colours_for(e.count())
    sent = T.dealt(T.packed(e, p), p).agg(F.sum(F.length("u") + F.length("v")).alias("bytes"), F.sum("n").alias("n")).first()
    assert sent.n == p * e.count() and sent.bytes < 4 * sent.n
