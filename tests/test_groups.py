"""Searches over groups of neighbourhoods, against those over one neighbourhood a row."""

import random

import pytest

from vecweave.operators import cliques as C
from vecweave.operators import triples as T


@pytest.mark.parametrize("algorithm", ["canonical", "owned", "sem_bk", "shared_hosts"])
def test_groups_find_what_single_neighbourhoods_do(spark, monkeypatch, algorithm):
    rng = random.Random(11)
    s = spark.createDataFrame([(u, v, rng.randrange(-200, 900)) for u in range(45) for v in range(u + 1, 45) if rng.random() < 0.3], "u long, v long, sim_q long")
    monkeypatch.setattr(T, "EDGES", 200)
    monkeypatch.setattr(C, "GROUP_LINKS", 100)
    found = [sorted(map(tuple, C.msc(s, 500, algorithm).collect()))]
    counted = C.counted(s, 500, algorithm)[1]
    monkeypatch.setattr(C, "GROUPED", 0)
    found.append(sorted(map(tuple, C.msc(s, 500, algorithm).collect())))
    assert found[0] == found[1] and len(found[0]) > 50 and counted == C.counted(s, 500, algorithm)[1]


def test_neighbourhoods_go_packed(spark):
    """Before, an edge took the edges out of its ends along: 24 bytes for each of some 30 others here."""
    s = spark.createDataFrame([(u, v, u * v) for u in range(60) for v in range(u + 1, 60)], "u long, v long, sim_q long")
    structural = C.structural(s, least=1000)
    assert [len(r.clique) for r in structural.collect()] == [60]
    o = s.selectExpr("u as a", "v as b", "sim_q")
    sent = T.links(T.packed(s, 4), 4, 3).selectExpr("sum(n)", "sum(length(a) + length(b) + length(c) + length(d)) / sum(n)").first()
    assert sent[0] == 3 * (60 * 59 * 58 // 6) and sent[1] < 8 and T.neighbours(o, 3).selectExpr("sum(n)").first()[0] == 60 * 59
