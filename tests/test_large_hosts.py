"""Hosts whose members have no other neighbours, and hosts with more feasible sets than a search may visit."""

import random
import tracemalloc
from itertools import combinations
from math import comb

import pytest

from vecweave.operators import cliques as C
from vecweave.operators import kernels as K


def family(df):
    return sorted((tuple(r.clique), r.size, r.sum_q) for r in df.collect())


def copies(m, t, far=0, near=900):
    """t near copies of each other among m members."""
    return [[0 if i == j else near if i < t and j < t else far for j in range(m)] for i in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_twin_is_searched_for_all(spark, seed):
    """A graph of classes blown up, some of them cliques apart: the cliques and sums of a search without classes."""
    rng = random.Random(seed)
    near = {p for p in combinations(range(9), 2) if rng.random() < 0.5 and 8 not in p}
    of = [rng.randrange(9) for _ in range(34)] + [8, 8, 8]
    rows = [(u, v, rng.randint(-900, 900)) for u, v in combinations(range(len(of)), 2) if of[u] == of[v] or tuple(sorted((of[u], of[v]))) in near]
    s = spark.createDataFrame(rows, "u long, v long, sim_q long").repartition(3)
    found = C.twins(s, 1)
    assert found.count() > 3 and all(r.rep == r.members[0] == min(r.members) for r in found.collect())
    assert family(C.structural(s, least=1)) == family(C.structural(s, least=10**9))
    assert C.twins(s, 10**9) is None


def test_a_large_host_takes_no_neighbourhoods(spark, monkeypatch):
    """Two hosts of 45 with all pairs of their own and a triangle: no neighbourhood of a host's member is gathered."""
    rng = random.Random(5)
    rows = [(u + 100 * g, v + 100 * g, 900_000 if v < 6 else rng.randint(-500_000, 300_000)) for g in (0, 1) for u, v in combinations(range(45), 2)]
    rows += [(300, 301, 900_000), (301, 302, 900_000), (300, 302, 100_000)]
    s = spark.createDataFrame(rows, "u long, v long, sim_q long")
    want, seen, gathered = family(C.msc(s, 850_000, "canonical")), [], C.neighbourhoods
    monkeypatch.setattr(C, "neighbourhoods", lambda sims, tau_q=None: seen.append(sims.count() if tau_q is None else 0) or gathered(sims, tau_q))
    for algorithm in ("strsub", "host_canonical", "shared_hosts"):
        assert family(C.msc(s, 850_000, algorithm)) == want and len(want) == 4, algorithm
    assert max(seen) <= 3


def test_a_search_holds_one_path():
    """The candidates of the sets on one path, not those of all their children."""
    m = 300
    w = copies(m, 25)
    adj = [(1 << m) - 1 & ~(1 << i) for i in range(m)]
    dicts = [{j: x for j, x in enumerate(r) if j != i} for i, r in enumerate(w)]
    for search in (K.canonical(adj, dicts, list(range(m)), [(23, 24)], 400), K.subsets_of_size(w, 37, 400, [], K.Steps(), use=())):
        tracemalloc.start()
        next(search)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 10_000_000


def test_proofs_of_many_feasible_sets():
    rng = random.Random(3)
    proofs = 0
    for _ in range(40):
        m = rng.randint(5, 8)
        w = [[0] * m for _ in range(m)]
        for i, j in combinations(range(m), 2):
            w[i][j] = w[j][i] = 9 if j < 4 else rng.randint(-4, 9)
        feasible = [c for k in range(2, m + 1) for c in combinations(range(m), k) if 2 * sum(w[i][j] for i, j in combinations(c, 2)) >= 4 * k * (k - 1)]
        top = [f for f in feasible if not any(set(f) < set(g) for g in feasible)]
        for t, n, r in K.many_feasible(w, 4):
            most = max(map(len, feasible))
            assert comb(n, r) <= len(feasible) and comb(n, r) <= len(top) * comb(most - t, r)
            proofs += 1
    assert proofs > 40


@pytest.mark.parametrize("method", ["host_canonical", "strsub", "shared_hosts"])
def test_more_sets_than_steps_are_refused_at_once(spark, method):
    w = copies(120, 30)
    s = spark.createDataFrame([(i, j, w[i][j]) for i, j in combinations(range(120), 2)], "u long, v long, sim_q long")
    with pytest.raises(Exception, match="feasible with any"):
        C.msc(s, 400, method).collect()
