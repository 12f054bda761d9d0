"""Answers that are whole however deep or skewed the graph is, against plain versions."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from vecweave.operators import cliques as C
from vecweave.operators import graph as G
from vecweave.operators import quality as Q
from vecweave.session import Shelf
from vecweave.sources.text import write_csr


def edges_of(spark, pairs):
    return spark.createDataFrame(sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]}), "u long, v long")


def plain_cores(pairs):
    nbrs = {}
    for u, v in pairs:
        nbrs.setdefault(u, set()).add(v)
        nbrs.setdefault(v, set()).add(u)
    core, k = {}, 0
    while nbrs:
        x = min(nbrs, key=lambda v: (len(nbrs[v]), v))
        k = max(k, len(nbrs[x]))
        core[x] = k
        for y in nbrs.pop(x):
            nbrs[y].discard(x)
    return core


def test_cores_of_a_long_path(spark):
    e = edges_of(spark, [(k, k + 1) for k in range(1000)])
    got = {r.id: r.core for r in G.cores(e).collect()}
    assert len(got) == 1001 and set(got.values()) == {1}


@pytest.mark.parametrize("in_task", [10_000, 0])
def test_cores_against_peeling(spark, in_task):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)} | {(100 + k, 101 + k) for k in range(7)} | {(100, 3)}
    assert {r.id: r.core for r in G.cores(edges_of(spark, pairs), in_task).collect()} == plain_cores(pairs)


def test_walk_goes_as_deep_as_it_takes(spark):
    e = edges_of(spark, [(k, k + 1) for k in range(12)] + [(3, 50), (4, 50), (90, 91)])
    got = {k: sorted(map(tuple, x.collect())) for k, x in G.bfs_expansion(e, 0, [2, 5, 1000]).items()}
    assert got[2] == [(0, 1), (1, 2)] and len(got[1000]) == 14 and (90, 91) not in got[1000]
    assert got[5] == [(0, 1), (1, 2), (2, 3), (3, 4), (3, 50)]


def test_triangles_ranks_and_pairs(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(140)} | {(0, k) for k in range(30, 60)}
    e = edges_of(spark, pairs)
    want = {(a, b, c) for a, b in pairs for c in range(60) if b < c and (b, c) in pairs and (a, c) in pairs}
    assert {tuple(sorted(r)) for r in G.triangles(e).collect()} == want
    count = {r.id: r.triangles for r in G.triangle_counts(e).collect()}
    assert count == {v: n for v in range(60) if (n := sum(v in t for t in want))}
    d = {v: sum(v in p for p in pairs) for v in range(62)}
    order = sorted(d, key=lambda v: (-d[v], v))
    ranks = {r.id: r["rank"] for r in G.degree_ranks(e, spark.range(62)).collect()}
    assert ranks == {v: k + 1 for k, v in enumerate(order)}
    rows = spark.createDataFrame([(g, i) for g in range(3) for i in range(g, 40, g + 1)] + [(None, 1), (1, None)], "g long, i long")
    sets = [list(range(g, 40, g + 1)) for g in range(3)]
    assert {tuple(r) for r in G.co_occurrence(rows, "g", "i").collect()} == {(a, b) for s in sets for a in s for b in s if a < b}


def test_hubs_go_to_joins(spark):
    s = spark.createDataFrame([(0, k, 900_000) for k in range(1, 30)] + [(1, 2, 950_000)], "u long, v long, sim_q long")
    assert C.choose(s, 940_000, hub=10) == "layered_canonical" and C.choose(s, 940_000) == "canonical" and C.choose(s, 0) == "host_canonical"
    whole = sorted(map(tuple, C.msc(s, 900_000, "layered_canonical").collect()))
    assert whole == sorted(map(tuple, C.msc(s, 900_000, "canonical").collect())) and ([0, 1, 2], 3, 2_750_000) in whole


def test_csr_file(spark, tmp_path):
    pairs = [(0, 1), (1, 2), (0, 2), (2, 5)]
    write_csr(spark.range(7).repartition(3), edges_of(spark, pairs), str(tmp_path / "g.bin"))
    raw = (tmp_path / "g.bin").read_bytes()
    n = struct.unpack(f"<{len(raw) // 4}I", raw)
    assert n[:3] == (4, 7, 8) and n[3:10] == (2, 2, 3, 0, 0, 1, 0) and n[10:] == (1, 2, 0, 2, 0, 1, 5, 2) and len(list(tmp_path.iterdir())) <= 2


def test_pooled_measures(spark):
    g = spark.createDataFrame([("a", [1, 2, 3]), ("b", [2, 3]), ("c", [9])], "gid string, members array<long>")
    s = spark.createDataFrame([(1, 2, 600_000), (2, 3, 900_000)], "u long, v long, sim_q long")
    got = Q.pooled_measures(Q.edge_measures(g, s)).first()
    assert tuple(got) == (2, 0.75, 600_000.0, 0.5)


def test_split_hosts_give_the_same_sets(spark):
    rng = random.Random(3)
    rows = [(u, v, rng.randint(-200_000, 900_000)) for base, m in ((0, 11), (7, 9)) for u in range(base, base + m) for v in range(u + 1, base + m)]
    sims = spark.createDataFrame(sorted({(u, v): (u, v, s) for u, v, s in rows}.values()), "u long, v long, sim_q long")
    hosts = C.structural(sims)
    family = lambda split: sorted(map(tuple, C.maximal_only(C.from_hosts(hosts, sims, 600_000, "canonical", split=split)).collect()))
    assert family(8) == family(1000) == sorted(map(tuple, C.msc(sims, 600_000, "canonical").collect())) != []


@pytest.mark.parametrize("in_task", [10_000, 0])
def test_an_order_with_few_neighbours_ahead(spark, in_task):
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)} | {(100 + k, 101 + k) for k in range(7)} | {(100, 3)}
    e, cores = edges_of(spark, pairs), plain_cores(pairs)
    order = sorted(G.degeneracy_order(e, in_task).collect(), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(cores))) and {r.id: r.core for r in order} == cores
    place = {r.id: r.position for r in order}
    ahead = {v: sum(place[a if b == v else b] > place[v] for a, b in pairs if v in (a, b)) for v in place}
    assert all(ahead[v] <= cores[v] for v in place)
    assert tuple(G.forward_degree(e, in_task).first()) == (max(cores.values()), max(ahead.values()))


def test_many_vectors_are_not_broadcast(spark):
    """The planner takes 60,000 vectors for the 8 bytes a row of the range they come from."""
    from pyspark.sql import functions as F

    from vecweave.operators.similarity import sim_edges
    from vecweave.session import materialise

    v = materialise(spark.range(60_000).select("id", F.array(F.lit(0.6), F.lit(0.8)).alias("vec")))
    s = sim_edges(spark.createDataFrame([(1, 2), (3, 59_999)], "u long, v long"), v)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and sorted((r.u, r.v, r.sim_q) for r in s.collect()) == [(1, 2, 1_000_000), (3, 59_999, 1_000_000)]


@pytest.mark.parametrize("block", [40, 1])
def test_order_by_blocks_and_by_joins(spark, block):
    """40: many blocks, whose news cross; 1: vertices have too many neighbours for a block, so rounds are joins."""
    rng = random.Random(11)
    pairs = {tuple(sorted(rng.sample(range(-9, 15), 2))) for _ in range(90)}
    e, cores = edges_of(spark, pairs), plain_cores(pairs)
    assert ((G.blocks_for(G.both_ways(e), block) or 0) > 3) == (block == 40)
    order = sorted(G.degeneracy_order(e, 0, block).collect(), key=lambda r: r.position)
    place = {r.id: r.position for r in order}
    ahead = {v: sum(place[a if b == v else b] > place[v] for a, b in pairs if v in (a, b)) for v in place}
    assert {r.id: r.core for r in order} == cores and all(ahead[v] <= cores[v] for v in place)
    # Layers by peeling each shell as SQL does.
    left, layers, k = {v: {a if b == v else b for a, b in pairs if v in (a, b) and cores[a if b == v else b] >= cores[v]} for v in place}, {}, 0
    while left:
        gone = {v for v, x in left.items() if len(x) <= cores[v]}
        layers |= dict.fromkeys(gone, k)
        left, k = {v: {x for x in n if not (x in gone and cores[x] == cores[v])} for v, n in left.items() if v not in gone}, k + 1
    assert {r.id: r.layer for r in order} == layers and k > 1
    raw = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(spark.createDataFrame([(3, 3), (None, 4)], "u long, v long"))
    assert tuple(G.order_audit(raw, spark.range(50), 0, block).first()) == (50, len(pairs), max(cores.values()), max(ahead.values()))


def test_audit_by_rounds_reads_its_rows_once(spark):
    rng = random.Random(12)
    rows = [tuple(rng.sample(range(-9, 15), 2)) for _ in range(220)] + [(2, 2), (2, 2), (5, 5), (None, 5), (5, None), (None, None)]
    pairs = {(min(p), max(p)) for p in rows if None not in p and p[0] != p[1]}
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    raw = spark.createDataFrame(rows, "u long, v long").mapInArrow(seen, "u long, v long")
    r = G.audit(raw, spark.range(30), at_once=1).first()
    assert reads.value == len(rows)
    d = {x: sum(x in p for p in pairs) for x in range(-9, 15)}
    triangles = sum((a, b) in pairs and (b, c) in pairs for a, c in pairs for b in range(a + 1, c))
    assert (r.vertices, r.input_rows, r.self_loops, r.duplicate_edges, r.edges) == (30, len(rows), 3, len(rows) - 3 - len(pairs), len(pairs))
    assert (r.max_degree, r.wedges, r.triangles) == (max(d.values()), sum(x * (x - 1) // 2 for x in d.values()), triangles) and triangles > 50
    with Shelf(spark, "test") as shelf:  # a round for each few bytes
        e = edges_of(spark, pairs | {(100 + i, 100 + j) for i in range(40) for j in range(i)})
        assert G.triangle_total(shelf, e, G.degrees(e), 1).first().triangles == triangles + 40 * 39 * 38 // 6
        assert len(shelf._folders) > 3
