"""Clique searches against enumeration of all subsets."""

import random
from itertools import combinations

import pytest

from vecweave.operators import kernels as K


def instance(rng, low=2, high=9, p=0.72):
    n = rng.randint(low, high)
    w = [{} for _ in range(n)]
    for i, j in combinations(range(n), 2):
        if rng.random() < p:
            w[i][j] = w[j][i] = rng.randint(-5, 10)
    return n, w, [sum(1 << j for j in row) for row in w], rng.randint(-2, 9)


def brute(n, w, tau):
    cliques, feasible = [], {}
    for mask in range(1, 1 << n):
        c = [i for i in range(n) if mask >> i & 1]
        if all(j in w[i] for i, j in combinations(c, 2)):
            cliques.append(mask)
            s = sum(w[i][j] for i, j in combinations(c, 2))
            if len(c) > 1 and 2 * s >= tau * len(c) * (len(c) - 1):
                feasible[mask] = s
    top = lambda ms: {a for a in ms if not any(a != b and a & b == a for b in ms)}
    return top(cliques), feasible, top(list(feasible))


def mask(c):
    return sum(1 << v for v in c)


def maximal(ms):
    return {a for a in ms if not any(a != b and a & b == a for b in ms)}


def check(n, w, adj, tau):
    structural, feasible, msc = brute(n, w, tau)
    assert {mask(c) for c in K.maximal_cliques(adj, (1 << n) - 1, 0)} == structural
    roots = [(i, j) for i, j in combinations(range(n), 2) if j in w[i] and w[i][j] >= tau]
    counters = {}
    found = [mask(c) for c, _ in K.canonical(adj, w, list(range(n)), roots, tau, counters)]
    assert counters["states"] == len(feasible) and len(found) == len(set(found))
    assert maximal(found) == msc
    assert maximal([mask(c) for c, _ in K.visited(adj, w, roots, tau)]) == msc
    by_root = []
    for r in range(n):
        above = (1 << n) - 1 & ~((2 << r) - 1)
        by_root += [mask(c) for c, _ in K.pivot_free(adj, w, r, adj[r] & above, adj[r] & ~above, tau)]
    assert sorted(by_root) == sorted(msc)
    for method in ("subsets", "canonical"):
        out = []
        for host in structural:
            members = list(K.bits(host))
            rows = [[w[a].get(b, 0) for b in members] for a in members]
            out += [mask(members[v] for v in c) for c, _ in K.solve_host(members, rows, tau, method, direct=2)]
        assert maximal(out) == msc, method


def test_random_instances_agree_with_enumeration():
    rng = random.Random(20260723)
    for _ in range(400):
        check(*instance(rng))


def test_equal_and_negative_weights():
    for value, tau in ((3, 3), (-4, -4), (0, 0), (5, 6)):
        w = [{j: value for j in range(5) if j != i} for i in range(5)]
        check(5, w, [31 & ~(1 << i) for i in range(5)], tau)


def test_larger_set_without_a_feasible_step():
    w = [{1: 6, 2: 5, 3: 5}, {0: 6, 2: 5, 3: 5}, {0: 5, 1: 5, 3: 10}, {0: 5, 1: 5, 2: 10}]
    assert brute(4, w, 6)[2] == {15}
    check(4, w, [15 & ~(1 << i) for i in range(4)], 6)


def test_low_links_of_one_vertex_hide_no_set():
    w = [{1: 0, 2: 9, 3: 9}, {0: 0, 2: 0, 3: 0}, {0: 9, 1: 0, 3: 9}, {0: 9, 1: 0, 2: 9}]
    assert brute(4, w, 6)[2] == {0b1101}
    check(4, w, [15 & ~(1 << i) for i in range(4)], 6)


def test_bounds_are_never_below_the_best():
    rng = random.Random(7)
    for _ in range(150):
        m = rng.randint(2, 9)
        w = [[0] * m for _ in range(m)]
        for i, j in combinations(range(m), 2):
            w[i][j] = w[j][i] = rng.randint(-20, 20)
        top, member = K.layer_bounds(w)
        for k in range(2, m + 1):
            best = max(sum(w[i][j] for i, j in combinations(c, 2)) for c in combinations(range(m), k))
            assert best <= top[k] and 2 * best <= member[k]


def test_prunings_change_no_result():
    rng = random.Random(3)
    for _ in range(60):
        m = rng.randint(3, 8)
        w = [[0] * m for _ in range(m)]
        for i, j in combinations(range(m), 2):
            w[i][j] = w[j][i] = rng.randint(-9, 9)
        want = maximal([mask(c) for c, _ in K.host_subsets(w, 3)])
        for use in ((), ("edges",), ("members",), ("local",)):
            assert maximal([mask(c) for c, _ in K.host_subsets(w, 3, use=use)]) == want


def test_large_hosts():
    m = 256
    w = [[0] * m for _ in range(m)]
    w[0][1] = w[1][0] = 10
    assert [c for c, _ in K.solve_host(list(range(m)), w, 9)] == [(0, 1)]
    m = 300
    w = [[0 if i == j else 10 for j in range(m)] for i in range(m)]
    assert [len(c) for c, _ in K.solve_host(list(range(m)), w, 9)] == [m]


def test_budget_raises():
    adj = [(1 << 20) - 1 & ~(1 << i) for i in range(20)]
    with pytest.raises(K.TooMany):
        list(K.all_cliques(adj, [{j: 1 for j in range(20)}] * 20, (1 << 20) - 1, steps=K.Steps(1000)))


def test_shares_of_a_host_are_the_whole():
    rng = random.Random(11)
    for m in (8, 12):
        w = [[0] * m for _ in range(m)]
        for i, j in combinations(range(m), 2):
            w[i][j] = w[j][i] = rng.randint(-5, 10)
        whole = sorted(K.solve_host(list(range(m)), w, 6, "canonical"))
        shares = [x for k in range(5) for x in K.solve_host(list(range(m)), w, 6, "canonical", part=(k, 5))]
        assert whole and sorted(shares) == whole


def test_owned_sets_and_bounds():
    """From the lowest pair, with and without bounds: the same sets, and bounds only ever save states."""
    rng = random.Random(21)
    saved = 0
    for _ in range(300):
        n, w, adj, tau = instance(rng)
        msc = brute(n, w, tau)[2]
        name = rng.sample(range(100), n)
        roots = [(i, j) for i, j in combinations(range(n), 2) if j in w[i] and w[i][j] >= tau]
        seen = {}
        for use in ((), ("frontier",), ("depth",), ("frontier", "depth")):
            counters = seen[use] = {}
            found = [mask(c) for c, _ in K.owned(adj, w, name, roots, tau, counters, use=use)]
            assert len(found) == len(set(found)) and maximal(found) == msc
            by_root, free = [], {}
            for r in range(n):
                above = (1 << n) - 1 & ~((2 << r) - 1)
                by_root += [mask(c) for c, _ in K.pivot_free(adj, w, r, adj[r] & above, adj[r] & ~above, tau, None, free, use)]
            assert sorted(by_root) == sorted(msc)
            counters["free"] = free["states"]
        for use in (("frontier",), ("depth",)):
            assert seen["frontier", "depth"]["states"] <= seen[use]["states"] <= seen[()]["states"]
            assert seen["frontier", "depth"]["free"] <= seen[use]["free"] <= seen[()]["free"]
        assert seen[()]["states"] <= seen[()]["free"]
        saved += seen[()]["free"] - seen["frontier", "depth"]["free"]
    assert saved > 1000


def test_a_lowest_pair_that_feasible_steps_do_not_reach():
    """0 1 is the lowest pair of a feasible set of four, and no set of three around it is feasible."""
    w = [{1: 50, 2: 45, 3: 45}, {0: 50, 2: 45, 3: 45}, {0: 45, 1: 45, 3: 75}, {0: 45, 1: 45, 2: 75}]
    adj = [15 & ~(1 << i) for i in range(4)]
    roots = [(0, 1), (2, 3)]
    assert brute(4, w, 50)[2] == {15}
    assert maximal([mask(c) for c, _ in K.owned(adj, w, [0, 1, 2, 3], roots, 50)]) == {15}
    check(4, w, adj, 50)


def test_depth_and_growth_bounds_are_never_below_the_best():
    rng = random.Random(4)
    for _ in range(200):
        n, w, adj, tau = instance(rng, 3, 8)
        feasible = brute(n, w, tau)[1]
        assert max((f.bit_count() for f in feasible), default=1) <= K.depth_limit(w, (1 << n) - 1, tau)
        for c, s in K.all_cliques(adj, w, (1 << n) - 1):
            cand = [v for v in range(n) if all(v in w[u] for u in c)]
            best = K.best_links(w, sum(1 << v for v in cand))
            gains = [sum(w[v][u] for u in c) for v in cand]
            if any(f & mask(c) == mask(c) and f != mask(c) for f in feasible):
                assert K.can_grow(s, len(c), gains, [best[v] for v in cand], tau)


def test_the_scan_ends_at_the_first_that_cannot_be_a_child():
    """Reached sets, rejects and terminals as by comparing every candidate; fewer are compared."""
    rng = random.Random(9)
    less = 0
    for _ in range(200):
        n, w, adj, tau = instance(rng, 4, 10, 0.9)
        roots = [(i, j) for i, j in combinations(range(n), 2) if j in w[i] and w[i][j] >= tau]
        counters = {}
        found = [mask(c) for c, _ in K.canonical(adj, w, list(range(n)), roots, tau, counters)]
        feasible = brute(n, w, tau)[1]
        grow = {f: [v for v in range(n) if not f >> v & 1 and f | 1 << v in feasible] for f in feasible}
        assert counters["states"] == len(feasible) and sorted(found) == sorted(f for f, g in grow.items() if not g)
        children = sum(f.bit_count() > 2 for f in feasible)
        assert counters["rejects"] == sum(map(len, grow.values())) - children
        less += sum(map(len, grow.values())) - counters["looked"]
        assert children <= counters["looked"] <= sum(map(len, grow.values()))
    assert less > 100


def test_searches_that_stay_in_shared_hosts():
    """Only hosts that aren't feasible need a search; feasible ones stand for their subsets."""
    rng = random.Random(13)
    fewer = 0
    for _ in range(300):
        n, w, adj, tau = instance(rng)
        structural, feasible, msc = brute(n, w, tau)
        bad = [h for h in structural if h not in feasible]
        hosts = [sum(1 << k for k, h in enumerate(bad) if h >> v & 1) for v in range(n)]
        roots = [(i, j) for i, j in combinations(range(n), 2) if j in w[i] and w[i][j] >= tau]
        inside, every = {}, {}
        found = [mask(c) for c, _ in K.canonical(adj, w, list(range(n)), roots, tau, inside, hosts=hosts)]
        list(K.canonical(adj, w, list(range(n)), roots, tau, every))
        assert len(found) == len(set(found)) and maximal(found + [h for h in structural if h in feasible]) == msc
        assert inside["states"] == sum(any(f & h == f for h in bad) for f in feasible) <= every["states"]
        fewer += every["states"] - inside["states"]
    assert fewer > 200


def test_layers_in_parts_are_the_whole():
    rng = random.Random(17)
    for _ in range(60):
        m = rng.randint(4, 9)
        w = [[0] * m for _ in range(m)]
        for i, j in combinations(range(m), 2):
            w[i][j] = w[j][i] = rng.randint(-9, 9)
        found = []
        for k in K.open_layers(w, 3):
            larger = list(found)
            parts = [x for first in range(m - k + 1) for x, _ in K.subsets_of_size(w, k, 3, larger, K.Steps(), first)]
            assert sorted(parts) == sorted(x for x, _ in K.subsets_of_size(w, k, 3, larger, K.Steps()))
            assert set(parts) == {mask(c) for c in combinations(range(m), k) if 2 * sum(w[i][j] for i, j in combinations(c, 2)) >= 3 * k * (k - 1) and not any(mask(c) & ~f == 0 for f in larger)}
            found += parts
        assert maximal(found) == set(found) == {mask(c) for c, _ in K.host_subsets(w, 3)}


def test_number_of_combinations():
    from math import comb

    for n in range(12):
        for k in range(n + 1):
            for most in (1, 2, 50, 462, 463):
                assert K.at_least(n, k, most) == (comb(n, k) >= most)
    assert K.at_least(4000, 2000, 250_000)


def test_deep_sets_need_no_recursion():
    n = 1200  # beyond what calls may nest
    w = [{u: 9 for u in range(n) if u != v} for v in range(n)]
    adj = [(1 << n) - 1 & ~(1 << v) for v in range(n)]
    assert next(K.pivot_free(adj, w, 0, (1 << n) - 2, 0, 9, use=())) == (tuple(range(n)), 9 * n * (n - 1) // 2)
