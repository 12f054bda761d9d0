"""Every plan gives the same sets; what they count, and what confines them."""

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from vecweave.operators import cliques as C
from vecweave.operators import kernels as K


def graph(spark, seed, n=22, p=0.55, low=-300_000):
    rng = random.Random(seed)
    rows = [(3 * u, 3 * v, rng.randint(low, 900_000)) for u, v in combinations(range(n), 2) if rng.random() < p]
    return spark.createDataFrame(rows, "u long, v long, sim_q long").repartition(3)


def family(df):
    return sorted((tuple(r.clique), r.size, r.sum_q) for r in df.collect())


@pytest.mark.parametrize("tau", [250_000, 700_000])
def test_plans_agree(spark, tau):
    s = graph(spark, tau)
    want = family(C.msc(s, tau, "layered_canonical"))
    assert want
    for algorithm in ("canonical", "owned", "shared_hosts", "strsub", "sem_bk", "host_canonical", "visited"):
        assert family(C.msc(s, tau, algorithm)) == want, algorithm


def test_counts_of_one_run(spark):
    s, tau = graph(spark, 7), 500_000
    found, canonical = C.counted(s, tau)
    feasible = C.feasible_sets(s, tau).count()
    assert family(found) == family(C.msc(s, tau, "layered")) and canonical["states"] == feasible
    assert 0 < canonical["looked"] < canonical["tests"] and canonical["terminals"] >= found.count()
    layered = C.counted(s, tau, "layered_canonical")[1]
    assert (layered["states"], layered["terminals"]) == (feasible, canonical["terminals"])
    visited = C.counted(s, tau, "visited")[1]
    assert visited["states"] >= feasible and visited["duplicates"] > 0 and visited["terminals"] >= canonical["terminals"]
    shared = C.counted(s, tau, "shared_hosts")[1]
    every, owned = C.counted(s, tau, "sem_bk")[1], C.counted(s, tau, "owned")[1]
    assert shared["states"] <= feasible and owned["pruned"] > 0 and every["pruned"] > 0
    hosts = C.counted(s, tau, "host_canonical")[1]
    assert hosts["states"] > 0  # hosts overlap, so sets may be met in several
    assert C.search_counters(s, tau).first().states == feasible


def test_feasible_hosts_are_not_searched(spark):
    """Two feasible cliques and a poor one: only pairs in the poor one are roots."""
    rows = [(u, v, 900_000) for base in (0, 10) for u, v in combinations(range(base, base + 6), 2)] + [(u, v, 900_000 if (u, v) == (20, 21) else 100_000) for u, v in combinations(range(20, 24), 2)]
    s = spark.createDataFrame(rows, "u long, v long, sim_q long")
    found, n = C.counted(s, 800_000, "shared_hosts")
    assert [c for c, _, _ in family(found)] == [(0, 1, 2, 3, 4, 5), (10, 11, 12, 13, 14, 15), (20, 21)] and n["states"] == 1
    assert C.counted(s, 800_000, "canonical")[1]["states"] == 2 * (2**6 - 7) + 1


def test_no_path_of_two_edges_is_a_row(spark):
    plan = C.neighbourhoods(graph(spark, 3), 500_000)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert sum("Inner" in x for x in joins) == 1 and sum("LeftSemi" in x for x in joins) == 2  # arrays at edges; roots


@pytest.mark.parametrize("m", [40, 70, 130])
def test_a_large_host_in_several_tasks(spark, m):
    """Subsets dealt out by first member: the sets of the canonical search, from more than one task."""
    rng = random.Random(m)
    block = {2, 9, 17, 25, m - 1}
    rows = [(u, v, rng.randint(840_000, 900_000) if u in block and v in block else rng.randint(-500_000, 300_000)) for u, v in combinations(range(m), 2)]
    s = spark.createDataFrame(rows, "u long, v long, sim_q long")
    host = spark.createDataFrame([(list(range(m)), m, sum(x for _, _, x in rows))], "clique array<long>, size int, sum_q long")
    tau = 850_000
    whole = family(C.maximal_only(C.from_hosts(host, s, tau, "canonical")))
    split = C.from_hosts(host, s, tau, "subsets", combinations=500)
    assert family(C.maximal_only(split)) == whole and whole


def test_budget_of_shares(spark):
    s = spark.createDataFrame([(u, v, 900_000 if (u + v) % 3 else 0) for u, v in combinations(range(44), 2)], "u long, v long, sim_q long")
    with pytest.raises(Exception, match="budget"):
        C.msc(s, 650_000, "host_canonical", budget=2000).collect()
    assert K.BUDGET // C.SHARES > 1_000_000


def test_time_limit_gives_no_part(spark):
    from vecweave.session import OutOfTime, within_time

    s = graph(spark, 5)
    want = family(C.msc(s, 600_000))
    assert family(within_time(spark, 600, lambda: C.msc(s, 600_000))) == want

    began = time.time()
    with pytest.raises(OutOfTime):  # more numbers than could be added up in a day
        within_time(spark, 2, lambda: spark.range(0, 1 << 50, 1, 4).agg(F.sum(F.sqrt("id")).alias("x")))
    assert time.time() - began < 30 and spark.range(3).count() == 3
