from itertools import combinations

import pytest
from pyspark.sql import functions as F

from vecweave.operators import cliques as C
from vecweave.operators import graph as G
from vecweave.operators import similarity as S

SIX = {(1, 2): 80, (1, 3): 60, (1, 4): 80, (2, 3): 48, (2, 4): 100, (3, 4): 48, (3, 5): 64, (3, 6): 48, (4, 5): 0, (4, 6): 0, (5, 6): 96}


def frame(spark, sims):
    return spark.createDataFrame([(u, v, s) for (u, v), s in sims.items()], "u long, v long, sim_q long")


def sets(df):
    return {tuple(r.clique) for r in df.collect()}


def test_audit_of_a_triangle_with_a_tail(spark):
    raw = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (3, 2), (1, 1)], "u long, v long")
    r = G.audit(raw, spark.range(4)).first()
    assert (r.edges, r.max_degree, r.wedges, r.triangles, r.transitivity, r.self_loops, r.duplicate_edges) == (4, 3, 5, 1, 0.6, 1, 1)
    f = G.forward_degree(G.canonical(raw)).first()
    assert f.degeneracy == 2 and f.max_forward_degree == 2
    empty = G.audit(raw.limit(0), spark.range(0)).first()
    assert (empty.edges, empty.triangles, empty.transitivity) == (0, 0, 0.0)


def test_core_numbers(spark):
    edges = [(a, b) for a, b in combinations(range(5), 2)] + [(4, 5), (5, 6), (6, 7), (5, 7)]
    got = {r.id: r.core for r in G.cores(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 2, 6: 2, 7: 2}


@pytest.mark.parametrize("algorithm", C.ALGORITHMS)
def test_running_example(spark, algorithm):
    s = frame(spark, SIX)
    want = {0: {(1, 2, 3, 4), (3, 4, 5, 6)}, 60: {(1, 2, 3, 4), (3, 5, 6)}, 96: {(2, 4), (5, 6)}, 100: {(2, 4)}, 101: set()}
    for tau in want if algorithm in ("canonical", "strsub") else (60, 101):  # test_plans has the plans on random graphs
        assert sets(C.msc(s, tau, algorithm)) == want[tau], tau


def test_structural_and_pairs(spark):
    s = frame(spark, SIX)
    assert sets(C.structural(s, spark.range(1, 8))) == {(1, 2, 3, 4), (3, 4, 5, 6), (7,)}
    assert sets(C.pairsim_cliques(s, spark.range(1, 7), 80)) == {(1, 2, 4), (3,), (5, 6)}
    assert C.feasible_sets(s, 60).count() == 12 and C.feasible_sets(s, 0).count() == 21
    assert sets(C.structural(s.limit(0))) == set() and C.msc(s.limit(0), 0, "auto").count() == 0


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        C.msc(frame(spark, SIX), 0, "none")


def test_quantiles_and_vectors(spark):
    s = frame(spark, {(0, k): k for k in range(1, 11)})
    assert {r.p: r.tau for r in S.tau_quantiles(s, (0, 25, 50, 99, 100)).collect()} == {0: 1, 25: 3, 50: 5, 99: 9, 100: 10}
    r = S.tau_summary(s.withColumn("sim", F.col("sim_q") / 10)).first()
    assert (r.min, r.max, r.mean, r.median) == (0.1, 1.0, 0.55, 0.6)
    v = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [6.0, 8.0])], "id long, vec array<double>")
    e = spark.createDataFrame([(0, 1), (0, 2)], "u long, v long")
    assert {(r.u, r.v): r.sim_q for r in S.sim_edges(e, v, unit=False).collect()} == {(0, 1): 0, (0, 2): 1_000_000}
    assert {(r.u, r.v): round(r.sim, 9) for r in S.cosine_edges(e, v).collect()} == {(0, 1): 0.0, (0, 2): 1.0}


def test_compaction_levels_and_walks(spark):
    e = spark.createDataFrame([(10, 30), (30, 50), (50, 70), (10, 50)], "u long, v long")
    mapped, new = G.compact_ids(G.both_ways(e).select("id"), e)
    assert {r.orig_id: r.id for r in mapped.collect()} == {10: 0, 30: 1, 50: 2, 70: 3}
    assert {tuple(r) for r in new.collect()} == {(0, 1), (1, 2), (2, 3), (0, 2)}
    ranks = G.degree_ranks(new, spark.range(5))
    assert [r.id for r in ranks.orderBy("rank").collect()] == [2, 0, 1, 3, 4]
    assert [r.id for r in G.degree_ranks(new, spark.range(5), 2).orderBy("rank").collect()] == [2, 0]
    levels = G.nested_levels(new, ranks, [2, 3, 5]).collect()
    assert sorted(r.size for r in levels) == [2, 3, 3, 3, 5, 5, 5, 5]
    walked = G.bfs_expansion(new, 3, [1, 3, 99])
    assert [walked[k].count() for k in (1, 3, 99)] == [1, 3, 4]
    with pytest.raises(ValueError):
        G.checked(e, spark.range(5), "FAILFAST")
    assert G.checked(new, spark.range(3)).count() == 3
