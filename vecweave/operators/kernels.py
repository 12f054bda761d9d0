"""Clique searches on one small graph, in plain Python integers.

A graph is ``adj``: for each local vertex the bit set of its neighbours; ``w`` holds integer similarities of adjacent
pairs as rows of dicts or arrays. A set C of k >= 2 pairwise adjacent vertices is feasible when 2 * sum of its pairs'
similarities >= tau * k * (k - 1). All functions raise TooMany beyond ``budget`` steps; none returns a part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import nlargest
from itertools import combinations
from math import comb

BUDGET = 50_000_000
#: Below every sum of links.
NONE = -(1 << 50)
#: What searches count: sets visited, candidates carried by them, those compared with the members, feasible extensions not
#: followed, branches that a bound ended, sets met again, and sets that nothing extends.
COUNTED = ("states", "tests", "looked", "rejects", "pruned", "duplicates", "terminals")


def count(counters: dict[str, int], **more: int) -> None:
    for key, n in more.items():
        counters[key] = counters.get(key, 0) + n


class TooMany(RuntimeError):
    """A search went past its budget of steps."""


def bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


class Steps:
    def __init__(self, budget: int = BUDGET):
        self.left = budget

    def __call__(self, n: int = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise TooMany("the search needs more steps than its budget")


def maximal_cliques(adj: list[int], p: int, x: int, r: tuple[int, ...] = (), steps: Steps | None = None) -> Iterator[tuple[int, ...]]:
    """Maximal cliques that hold r and otherwise vertices of p, none extendable by p or x; the pivot covers most of p."""
    steps = steps or Steps()
    stack = [(r, p, x)]
    while stack:
        r, p, x = stack.pop()
        steps()
        if not p:
            if not x:
                yield r
            continue
        pivot = max(bits(p | x), key=lambda u: (adj[u] & p).bit_count())
        for v in bits(p & ~adj[pivot]):
            stack.append(((*r, v), p & adj[v], x & adj[v]))
            p ^= 1 << v
            x |= 1 << v


def feasible(total: int, k: int, tau: int) -> bool:
    return 2 * total >= tau * k * (k - 1)


def all_cliques(adj: list[int], w: list[dict[int, int]], p: int, start: tuple[int, ...] = (), total: int = 0, steps: Steps | None = None) -> Iterator[tuple[tuple[int, ...], int]]:
    """Every clique that extends ``start`` by vertices of p, with the sum of its pairs."""
    steps = steps or Steps()
    stack = [(start, total, p)]
    while stack:
        c, s, p = stack.pop()
        steps()
        if len(c) > len(start):
            yield c, s
        for v in bits(p):
            stack.append(((*c, v), s + sum(w[v][u] for u in c), p & adj[v] & ~((2 << v) - 1)))


def has_feasible_superset(c: tuple[int, ...], total: int, cand: int, adj: list[int], w: list[dict[int, int]], tau: int, steps: Steps) -> bool:
    """Whether some vertices of ``cand`` (all adjacent to c) make c larger and feasible, one or many at a time."""
    best_in = {}
    for v in bits(cand):
        best_in[v] = max((w[v][u] for u in bits(cand & adj[v])), default=0)
    stack = [(len(c), total, cand, {v: sum(w[v][u] for u in c) for v in bits(cand)})]
    while stack:
        k, s, p, gain = stack.pop()
        steps()
        # What each further vertex can add at most: its links to the set and, halved, its best links to other candidates.
        most, low = sorted(((gain[v], best_in[v]) for v in bits(p)), key=lambda t: -t[0]), False
        upper, size = s, k
        tops = sorted((b for _, b in most), reverse=True)
        for j, (g, _) in enumerate(most):
            upper += g
            size = k + j + 1
            pairs = j * (j + 1) // 2
            if feasible(upper + (pairs * max(tops[0], 0) if j else 0), size, tau):
                low = True
                break
        if not low:
            continue
        for v in bits(p):
            s2 = s + gain[v]
            if feasible(s2, k + 1, tau):
                return True
            q = p & adj[v] & ~((2 << v) - 1)
            if q:
                stack.append((k + 1, s2, q, {u: gain[u] + w[v][u] for u in bits(q)}))
    return False


def depth_limit(w: list[dict[int, int]], within: int, tau: int) -> int:
    """The most members that a feasible set of vertices of ``within`` can have, by each vertex's best links.

    k members' pairs sum to half of their k - 1 best links each at most, summed over the k vertices where this is most. A
    set without its member of least links is no worse on average, so where k members can't do, more can't either.
    """
    links = [sorted((x for u, x in w[v].items() if within >> u & 1), reverse=True) for v in bits(within)]
    sums = [0] * len(links)
    for k in range(2, len(links) + 1):
        # k - 1 links each; those with fewer are out
        sums = [t + x[k - 2] for t, x in zip(sums, links, strict=True) if len(x) >= k - 1]
        links = [x for x in links if len(x) >= k - 1]
        if len(sums) < k or sum(nlargest(k, sums)) < tau * k * (k - 1):
            return k - 1
    return len(links)


def can_grow(s: int, k: int, gains: list[int], best: list[int], tau: int) -> bool:
    """Whether one or more candidates could make a set of k members with sum s feasible: never false if they can.

    r of them add their links to the set, at most the r largest of ``gains``, and the pairs among themselves, at most half
    of r - 1 times the r largest of ``best``, each candidate's best link to another.
    """
    total, inside = 2 * s, 0
    for r, (g, b) in enumerate(zip(sorted(gains, reverse=True), sorted(best, reverse=True), strict=True), 1):
        total += 2 * g
        inside += b
        if total + (r - 1) * inside >= tau * (k + r) * (k + r - 1):
            return True
    return False


def best_links(w: list[dict[int, int]], within: int) -> dict[int, int]:
    """For each vertex of ``within`` its best link there; far below any other where it has none."""
    return {v: max((x for u, x in w[v].items() if within >> u & 1), default=NONE) for v in bits(within)}


def pivot_free(adj: list[int], w: list[dict[int, int]], root: int, later: int, earlier: int, tau: int, steps: Steps | None = None, counters: dict[str, int] | None = None, use: tuple[str, ...] = ("frontier", "depth")) -> Iterator[tuple[tuple[int, ...], int]]:
    """Maximal feasible sets whose first vertex in the order is ``root``: every clique is visited, and each feasible one
    is kept if no feasible superset is found among its descendants or with the help of vertices passed over before.

    ``use`` names the bounds that end a branch: frontier (nothing below can be feasible) and depth (see depth_limit).
    """
    steps, counters = steps or Steps(), counters if counters is not None else {}
    limit = depth_limit(w, later | 1 << root, tau) if "depth" in use else len(w)
    best = best_links(w, later) if "frontier" in use else {}
    states = pruned = 0
    # A frame: members, sum, [(gain, candidate)] from the last to the next, whether a feasible set is below, how many of
    # the candidates are still to be tried.
    stack = [[(root,), 0, [(w[root][v], v) for v in bits(later)][::-1], False, None]]
    states += 1
    while stack:
        frame = stack[-1]
        c, s, cand, below, todo = frame
        if todo is None:  # first seen
            steps()
            k = len(c)
            frame[4] = todo = len(cand)
            if cand and (k >= limit or (best and not can_grow(s, k, [g for g, _ in cand], [best[v] for _, v in cand], tau))):
                pruned += 1
                frame[4] = todo = 0
        if todo:
            frame[4] = todo = todo - 1
            gain, v = cand[todo]
            wv = w[v]
            stack.append([(*c, v), s + gain, [(g + wv[x], x) for g, x in cand[:todo] if x in wv], False, None])
            states += 1
            continue
        stack.pop()
        here = len(c) > 1 and feasible(s, len(c), tau)
        if here and not below:
            common = later | earlier
            for u in c:
                common &= adj[u]
            if not has_feasible_superset(c, s, common, adj, w, tau, steps):
                yield c, s
        if stack:
            stack[-1][3] |= here or below
    count(counters, states=states, pruned=pruned)


def canonical(adj: list[int], w: list[dict[int, int]], name: list[int], roots: list[tuple[int, int]], tau: int, counters: dict[str, int] | None = None, steps: Steps | None = None, hosts: list[int] | None = None) -> Iterator[tuple[tuple[int, ...], int]]:
    """Feasible sets without a feasible extension by one vertex, each reached once from a pair of ``roots``.

    A set's parent lacks the member with the smallest (sum of links inside, name); this never lowers the average, so
    parents are feasible. A child is followed only from its parent. ``w`` has the adjacent vertices of each vertex and no
    others, or of a host, where all are adjacent, lists by position. A state carries each candidate's sum of links to its members in rising order: those from the first that keeps
    the set feasible extend it, and from the first above what a member has on average none can be a child, for it would
    raise the average, so the scan ends there.

    With ``hosts``, for each vertex the bit set of the hosts that hold it, a search stays inside: a state carries the hosts
    that hold all its members, its candidates are theirs, and roots in no host are left out.
    """
    steps, counters = steps or Steps(), counters if counters is not None else {}
    states = tests = looked = rejects = terminals = 0
    whole = bool(w) and isinstance(w[0], list)  # of a host: all are adjacent, and a row's own place is no link
    try:
        for a, b in roots:
            s, wa, wb = w[a][b], w[a], w[b]
            active = hosts[a] & hosts[b] if hosts else 1
            if not active:
                continue
            # A frame's children are made one at a time, so that a search holds the candidates of one path only.
            state = (a, b), (s, s), s, sorted((wa[v] + wb[v], v) for v in bits(adj[a] & adj[b]) if not hosts or hosts[v] & active), active
            stack = []
            while state or stack:
                if state:
                    c, inner, s, cand, active = state
                    state = None
                    steps()
                    states += 1
                    tests += len(cand)
                    k = len(c)
                    # 2 (s + gain) >= tau (k + 1) k, so an extension needs this gain at least; a child has 2 s / (k - 1) at most.
                    low = bisect_left(cand, (-((2 * s - tau * (k + 1) * k) // 2),))
                    if low == len(cand):
                        terminals += 1
                        yield c, s
                        continue
                    high = bisect_left(cand, (2 * s // (k - 1) + 1,), low)
                    looked += high - low
                    rejects += len(cand) - low
                    stack.append([c, inner, s, cand, active, high, low])
                frame = stack[-1]
                c, inner, s, cand, active, at, low = frame
                if at == low:
                    stack.pop()
                    continue
                frame[5] -= 1
                add, v = cand[at - 1]
                wv, mine = w[v], (add, name[v])
                grown = [i + wv[u] for i, u in zip(inner, c, strict=True)]
                if min(grown) <= add and any((g, name[u]) < mine for g, u in zip(grown, c, strict=True)):
                    continue
                rejects -= 1
                both = active & hosts[v] if hosts else active
                if whole:
                    after = sorted((g + wv[x], x) for g, x in cand if x != v)
                elif hosts:
                    after = sorted((g + wv[x], x) for g, x in cand if x in wv and hosts[x] & both)
                else:
                    after = sorted((g + wv[x], x) for g, x in cand if x in wv)
                state = (*c, v), (*grown, add), s + add, after, both
    finally:
        count(counters, states=states, tests=tests, looked=looked, rejects=rejects, terminals=terminals)


def owned(adj: list[int], w: list[dict[int, int]], name: list[int], roots: list[tuple[int, int]], tau: int, counters: dict[str, int] | None = None, steps: Steps | None = None, use: tuple[str, ...] = ("frontier", "depth")) -> Iterator[tuple[tuple[int, ...], int]]:
    """Feasible sets without a feasible extension by one vertex, each found from the lowest of its pairs that reach tau.

    Every feasible set holds such a pair. From a root all cliques around it are visited in a fixed order, but those with
    a lower pair: they are another root's. So no set is found twice, without a test of parents, and none that is reached
    through sets that aren't feasible is lost; ``use`` names the bounds that end branches as in pivot_free().
    """
    steps, counters = steps or Steps(), counters if counters is not None else {}
    key = lambda u, v: (name[u], name[v]) if name[u] < name[v] else (name[v], name[u])
    states = pruned = terminals = skipped = 0
    for a, b in roots:
        mine, both = key(a, b), adj[a] & adj[b]
        within = both | 1 << a | 1 << b
        lower = {v: sum(1 << u for u, x in w[v].items() if x >= tau and within >> u & 1 and key(u, v) < mine) for v in bits(within)}
        limit = depth_limit(w, within, tau) if "depth" in use else len(w)
        best = best_links(w, both) if "frontier" in use else {}
        gains = [(w[a][v] + w[b][v], v) for v in bits(both)]
        allowed = [(g, v) for g, v in gains if not lower[v] >> a & 1 and not lower[v] >> b & 1]
        skipped += len(gains) - len(allowed)
        stack = [((a, b), w[a][b], allowed, gains)]
        while stack:
            c, s, cand, common = stack.pop()
            steps()
            states += 1
            k = len(c)
            if feasible(s, k, tau) and not any(feasible(s + g, k + 1, tau) for g, _ in common):
                terminals += 1
                yield c, s
            if cand and (k >= limit or (best and not can_grow(s, k, [g for g, _ in cand], [best[v] for _, v in cand], tau))):
                pruned += 1
                continue
            for at, (gain, v) in enumerate(cand):
                wv, low = w[v], lower[v]
                after = [(g + wv[x], x) for g, x in cand[at + 1 :] if x in wv and not low >> x & 1]
                stack.append(((*c, v), s + gain, after, [(g + wv[x], x) for g, x in common if x in wv]))
    count(counters, states=states, pruned=pruned, terminals=terminals, rejects=skipped)


def visited(adj: list[int], w: list[dict[int, int]], roots: list[tuple[int, int]], tau: int, steps: Steps | None = None, counters: dict[str, int] | None = None) -> Iterator[tuple[tuple[int, ...], int]]:
    """As canonical(), but remembering every set seen instead of testing for the parent."""
    steps, counters, seen = steps or Steps(), counters if counters is not None else {}, set()
    terminals = duplicates = 0
    stack = [((1 << a) | (1 << b), w[a][b], 2, [(v, w[a][v] + w[b][v]) for v in bits(adj[a] & adj[b])]) for a, b in roots]
    while stack:
        c, s, k, cand = stack.pop()
        if c in seen:
            duplicates += 1
            continue
        seen.add(c)
        steps()
        need, extends = -((2 * s - tau * (k + 1) * k) // 2), False
        for v, add in cand:
            if add >= need:
                extends, wv = True, w[v]
                stack.append((c | 1 << v, s + add, k + 1, [(x, g + wv[x]) for x, g in cand if x in wv]))
        if not extends:
            terminals += 1
            yield tuple(bits(c)), s
    count(counters, states=len(seen), duplicates=duplicates, terminals=terminals)


def layer_bounds(w: list[list[int]]) -> tuple[list[int], list[int]]:
    """For each k the most that k members' pairs can sum to: by the largest pairs, and by the largest members.

    The second takes half of each member's k - 1 largest links, summed over the k members where this is largest; it is
    doubled, so as to stay whole.
    """
    m = len(w)
    pairs = sorted((w[i][j] for i, j in combinations(range(m), 2)), reverse=True)
    top, total, at = [0, 0], 0, 0
    for k in range(2, m + 1):
        while at < k * (k - 1) // 2:
            total += pairs[at]
            at += 1
        top.append(total)
    links = [sorted((w[i][j] for j in range(m) if j != i), reverse=True) for i in range(m)]
    sums = [0] * m
    member = [0, 0]
    for k in range(2, m + 1):
        sums = [s + x[k - 2] for s, x in zip(sums, links, strict=True)]
        member.append(sum(sorted(sums, reverse=True)[:k]))
    return top, member


def open_layers(w: list[list[int]], tau: int, use: tuple[str, ...] = ("edges", "members", "local")) -> list[int]:
    """The sizes, falling, at which a host's subsets may be feasible by its bounds; ``use`` names those: edges, members."""
    top, member = layer_bounds(w)
    return [k for k in range(len(w), 1, -1) if not (("edges" in use and 2 * top[k] < tau * k * (k - 1)) or ("members" in use and member[k] < tau * k * (k - 1)))]


def at_least(n: int, k: int, most: int) -> bool:
    """Whether there are ``most`` or more combinations of k of n, without working out a number far beyond."""
    total = 1
    for i in range(1, min(k, n - k) + 1):
        total = total * (n - i + 1) // i
        if total >= most:
            return True
    return total >= most


def many_feasible(w: list[list[int]], tau: int) -> Iterator[tuple[int, int, int]]:
    """(t, n, r): proofs that a host has at least as many feasible sets as there are combinations of r of n.

    A set of t members, grown from the best pair by the member of most links to it, is feasible together with any r of the
    n others of most links, even if all pairs among these were the host's least.
    """
    m = len(w)
    least = min(w[i][j] for i, j in combinations(range(m), 2))
    a, b = max(combinations(range(m), 2), key=lambda p: w[p[0]][p[1]])
    s, t, gain = w[a][b], 2, {v: w[a][v] + w[b][v] for v in range(m) if v not in (a, b)}
    while gain and feasible(s, t, tau):
        links = sorted(gain.values(), reverse=True)
        n = len(links)
        while n > 1:
            r = 0
            while r < n and feasible(s + (r + 1) * links[n - 1] + (r + 1) * r // 2 * least, t + r + 1, tau):
                r += 1
            if r:
                yield t, n, r
            n //= 2
        v = max(gain, key=gain.get)
        s, t = s + gain.pop(v), t + 1
        gain = {u: g + w[v][u] for u, g in gain.items()}


def refuse(w: list[list[int]], tau: int, budget: int, most: int | None = None) -> None:
    """Raise TooMany at once where a host has more feasible sets than the budget has steps, as a search takes one for each
    of them. With ``most``, the members of a feasible set at most, maximal ones are counted: one holds the r others of
    that many combinations at most, and a search by sizes takes a step for each maximal set."""
    if not at_least(len(w), len(w) // 2, budget):
        return
    for t, n, r in many_feasible(w, tau):
        if at_least(n, r, budget + 1 if most is None else (budget + 1) * comb(max(0, most - t), r)):
            raise TooMany(f"the search needs more steps than its budget: {t} of a host's {len(w)} members are feasible with any {r} of {n} others")


def subsets_of_size(w: list[list[int]], k: int, tau: int, larger: list[int], steps: Steps, first: int | None = None, use: tuple[str, ...] = ("frontier", "local"), counters: dict[str, int] | None = None) -> Iterator[tuple[int, int]]:
    """(mask, sum) of a host's feasible subsets of k members, those that start at position ``first`` only if given.

    With local in ``use`` none inside one of ``larger`` is looked at, and with frontier a branch ends where its remaining
    members can't add enough. Subsets of one size don't contain each other, so parts by ``first`` are independent.
    """
    m, need, states, pruned = len(w), tau * k * (k - 1), 0, 0
    best = [max((x for j, x in enumerate(r) if j != i), default=0) for i, r in enumerate(w)]
    # A frame is (mask, size, sum, each member's links to it, the next position): members are added one at a time, so that a
    # search holds one row of links for each member of a subset, not for each that might come next.
    for v in (first,) if first is not None else range(m - k + 1):
        stack, fresh = [], (1 << v, 1, 0, w[v], v + 1)
        while fresh or stack:
            if fresh:
                mask, size, s, gain, start = fresh
                fresh = None
                steps()
                states += 1
                left = k - size
                if left == 0:
                    if 2 * s >= need and not ("local" in use and any(mask & ~f == 0 for f in larger)):
                        yield mask, s
                    continue
                if "local" in use and any((mask | (1 << m) - (1 << start)) & ~f == 0 for f in larger):
                    pruned += 1
                    continue
                if "frontier" in use and 2 * (s + sum(nlargest(left, gain[start:]))) + (left - 1) * sum(nlargest(left, best[start:])) < need:
                    pruned += 1
                    continue
                stack.append([mask, size, s, gain, start])
            frame = stack[-1]
            mask, size, s, gain, v = frame
            if v > m - k + size:
                stack.pop()
                continue
            frame[4] += 1
            fresh = mask | 1 << v, size + 1, s + gain[v], [g + x for g, x in zip(gain, w[v], strict=True)], v + 1
    count(counters if counters is not None else {}, states=states, pruned=pruned)


def host_subsets(w: list[list[int]], tau: int, steps: Steps | None = None, use: tuple[str, ...] = ("edges", "members", "local", "frontier"), counters: dict[str, int] | None = None) -> Iterator[tuple[tuple[int, ...], int]]:
    """Feasible subsets of a host (a clique with all pairs in w) that no larger feasible subset of it contains.

    Sizes go down from the host; a size is passed over if its bounds rule it out, and subsets inside one already found
    aren't looked at. ``use`` names the prunings: edges, members, frontier (bounds) and local (containment).
    """
    steps, found = steps or Steps(), []
    for k in open_layers(w, tau, use):
        found += list(subsets_of_size(w, k, tau, [f for f, _ in found], steps, None, use, counters))
    yield from ((tuple(bits(mask)), s) for mask, s in found)


def solve_host(members: list[int], w: list[list[int]], tau: int, method: str = "subsets", direct: int = 7, budget: int = BUDGET, part: tuple[int, int] = (0, 1), counters: dict[str, int] | None = None) -> Iterator[tuple[tuple[int, ...], int]]:
    """Candidate sets of one host by position: the host itself if it is feasible, none without a pair that reaches tau.

    ``part`` (k, n) is the k-th of n shares of a canonical search: the pairs whose first position leaves k. A set is
    reached from one pair only, so shares don't overlap and together are the whole; each has its part of the budget.
    """
    m = len(members)
    every = sum(w[i][j] for i, j in combinations(range(m), 2))
    if m < 2:
        return
    if feasible(every, m, tau):
        yield tuple(range(m)), every
        return
    pairs = sorted((w[i][j] for i, j in combinations(range(m), 2)), reverse=True)
    if pairs[0] < tau:
        return
    if sum(pairs[:3]) < 3 * tau:  # no three members can do
        yield from (((i, j), w[i][j]) for i, j in combinations(range(m), 2) if w[i][j] >= tau)
        return
    if method == "subsets" or m <= direct:
        yield from host_subsets(w, tau, Steps(budget), counters=counters)
        return
    refuse(w, tau, budget)
    full = (1 << m) - 1
    adj = [full & ~(1 << i) for i in range(m)]
    yield from canonical(adj, w, members, [(i, j) for i, j in combinations(range(m), 2) if w[i][j] >= tau and i % part[1] == part[0]], tau, counters, Steps(budget // part[1]))


Kernel = Callable[..., Iterator[tuple[tuple[int, ...], int]]]
