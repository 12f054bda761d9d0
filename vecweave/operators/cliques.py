"""Structural maximal cliques and maximal sets of high average similarity.

All functions take sim_edges(u, v, sim_q) with u < v and vertices(id), and return clique (sorted array of longs), size
and sum_q. A set is feasible when 2 * sum_q >= tau_q * size * (size - 1), in whole numbers; it is in the result when no
feasible strict superset of any size exists. The algorithms give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.sets import signature, within
from ..session import Shelf, materialise
from . import kernels as K
from . import triples as T
from .blocks import block_column
from .graph import both_ways, degrees, oriented, pairs_within

CLIQUE = "clique array<long>, sum_q long"
_COUNTERS = f"counters struct<{', '.join(f'{k}: long' for k in K.COUNTED)}>"
#: Neighbours of a vertex up to which its neighbourhood may be one row of a task.
HUB = 20_000
#: Neighbours up to which vertices' neighbourhoods are gathered in groups, and links of a group at most.
GROUPED, GROUP_LINKS = 1_000, 16_000_000
#: Neighbours of a vertex from which others with the same ones are looked for.
TWINS = 32
#: Members of a host from which its canonical search is split, and into how many tasks.
SPLIT, SHARES = 40, 16
#: Subsets of one size from which a host's are dealt out by their first member.
COMBINATIONS = 250_000
ALGORITHMS = ("layered", "layered_canonical", "canonical", "visited", "owned", "shared_hosts", "strsub", "sem_bk", "host_canonical")


def _out(rows: list[tuple[list[int], int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sorted(c) for c, _ in rows], pa.list_(pa.int64())), pa.array([s for _, s in rows], pa.int64())], ["clique", "sum_q"])


def _in_batches(found: Iterator[tuple[list[int], int]], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for x in found:
        held.append(x)
        if len(held) >= rows:
            yield _out(held)
            held = []
    if held:
        yield _out(held)


def _searched(rows: DataFrame, each, watch: Observation | None = None) -> DataFrame:
    """The sets that ``each(batch, counters)`` finds in the batches of ``rows``.

    With ``watch`` every task adds a row of what it counted, which the observation sums as the rows go by: counts and
    result come out of one run, and a task that is run again counts once.
    """

    watched = watch is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, int] = {}
        found = _in_batches(x for b in batches for x in each(b, counters))
        if not watched:
            yield from found
            return
        none = pa.nulls
        kind = pa.struct([(k, pa.int64()) for k in K.COUNTED])
        for b in found:
            yield pa.RecordBatch.from_arrays([*b.columns, none(len(b), kind)], ["clique", "sum_q", "counters"])
        yield pa.RecordBatch.from_arrays([none(1, pa.list_(pa.int64())), none(1, pa.int64()), pa.array([{k: counters.get(k, 0) for k in K.COUNTED}], kind)], ["clique", "sum_q", "counters"])

    if watch is None:
        return rows.mapInArrow(run, CLIQUE)
    seen = rows.mapInArrow(run, f"{CLIQUE}, {_COUNTERS}").observe(watch, *(F.coalesce(F.sum(f"counters.{k}"), F.lit(0)).alias(k) for k in K.COUNTED))
    return seen.where("clique is not null").select("clique", "sum_q")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, b, ab, out, theirs), an edge with the edges out of its ends, the links (id, x, ys, ss) of each triangle's
    three vertices: those between x and each of ys, as a or b sees them in one row and a third vertex in rows of one."""
    for batch in batches:
        if not len(batch):
            continue
        a, b, ab = (batch.column(k).to_numpy() for k in range(3))
        sides = []
        for k in (3, 4):
            lists = batch.column(k)
            x = lists.flatten()
            at = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            sides.append((at, x.field(0).to_numpy(), x.field(1).to_numpy()))
        (at, c, ac), (at2, c2, bc2) = sides
        names, code = np.unique(np.concatenate([c, c2]), return_inverse=True)
        mine, theirs = at * len(names) + code[: len(c)], at2 * len(names) + code[len(c) :]  # both rise
        place = np.minimum(np.searchsorted(theirs, mine), max(0, len(theirs) - 1))
        hit = np.flatnonzero(theirs[place] == mine) if len(theirs) else np.zeros(0, np.int64)
        at, c, ac, bc = at[hit], c[hit], ac[hit], bc2[place[hit]]
        rows, n = np.unique(at, return_counts=True)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        single = pa.array(np.arange(len(c) + 1, dtype=np.int32))
        lists = lambda offsets, values: pa.ListArray.from_arrays(offsets, pa.array(values))
        for ids, x, ys, ss, offsets in ((a[rows], b[rows], c, bc, ends), (b[rows], a[rows], c, ac, ends), (c, a[at], b[at], ab[at], single)):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x), lists(offsets, ys), lists(offsets, ss)], ["id", "x", "ys", "ss"])


def neighbourhoods(sims: DataFrame, tau_q: int | None = None) -> DataFrame:
    """(id, nbrs, links) for each vertex: its neighbours (nbr, sim_q, first) and the links (x, ys, ss) among them.

    With ``tau_q`` only for vertices that a pair reaching it starts from, so that no other neighbourhood is gathered.

    Vertices are ordered by (degree, id); ``first`` tells that the neighbour comes before the vertex. A vertex holds its
    edges out as one array, about sqrt(2E) at most, and an edge meets the arrays of its two ends, so no path of two edges
    is a row: a triangle is a row for one of its vertices and part of an array for the others.
    """
    o = materialise(oriented(sims, "sim_q"))
    out = materialise(o.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "sim_q"))).alias("out")))
    sent = out.where("size(out) > 1").select("a", "out", F.explode("out").alias("e")).select("a", "e.b", F.col("e.sim_q").alias("ab"), "out")
    met = sent.join(out.select(F.col("a").alias("b"), F.col("out").alias("theirs")), "b").select("a", "b", "ab", "out", "theirs")
    roots = None if tau_q is None else o.where(F.col("sim_q") >= tau_q).select(F.col("a").alias("id")).distinct()
    rooted = lambda df: df if roots is None else df.join(roots, "id", "left_semi")
    links = rooted(met.mapInArrow(_common, "id long, x long, ys array<long>, ss array<long>")).groupBy("id").agg(F.collect_list(F.struct("x", "ys", "ss")).alias("links"))
    ends = F.array(F.struct(F.col("a").alias("id"), F.struct(F.col("b").alias("nbr"), "sim_q", F.lit(False).alias("first")).alias("n")), F.struct(F.col("b").alias("id"), F.struct(F.col("a").alias("nbr"), "sim_q", F.lit(True).alias("first")).alias("n")))
    nbrs = rooted(o.select(F.explode(ends).alias("e")).select("e.*")).groupBy("id").agg(F.collect_list("n").alias("nbrs"))
    return nbrs.join(links, "id", "left").select("id", "nbrs", "links")


def _local(row_id: int, nbrs: pa.ListScalar, links: pa.ListScalar) -> tuple[list[int], list[int], list[dict[int, int]], int, int]:
    """names, adj, w, later and earlier of one neighbourhood; the vertex itself is 0, others in the order of their ids."""
    ids, sims, first = (nbrs.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    order = np.argsort(ids)
    ids = ids[order]
    names = [row_id, *ids.tolist()]
    adj, w, later, earlier = [(1 << len(names)) - 2, *[1] * len(ids)], [{} for _ in names], 0, 0
    for k, (s, before) in enumerate(zip(sims[order].tolist(), first[order].tolist(), strict=True), 1):
        w[0][k] = w[k][0] = s
        if before:
            earlier |= 1 << k
        else:
            later |= 1 << k
    if links.is_valid:
        x, ys, ss = (links.values.field(k) for k in range(3))
        ends = np.repeat(x.to_numpy(), ys.value_lengths().to_numpy())
        both = zip((np.searchsorted(ids, ends) + 1).tolist(), (np.searchsorted(ids, ys.flatten().to_numpy()) + 1).tolist(), ss.flatten().to_pylist(), strict=True)
        for i, j, s in both:
            w[i][j] = w[j][i] = s
        for k in range(1, len(names)):
            for j in w[k]:
                adj[k] |= 1 << j
    return names, adj, w, later, earlier


def _over_neighbourhoods(sims: DataFrame, solve, tau_q: int | None = None, watch: Observation | None = None, held: DataFrame | None = None) -> DataFrame:
    """Apply ``solve(names, adj, w, later, earlier, counters, hosts)`` to every vertex, costly ones dealt apart from each
    other. ``held(id, hosts)`` gives vertices their hosts; those without have none."""

    d = degrees(sims).agg(F.max("degree").alias("most"), F.sum(F.expr("degree * degree")).alias("paths"), F.sum("degree").alias("ends")).first()
    if d.most is not None and d.most <= GROUPED:
        return _over_groups(sims, solve, tau_q, watch, held, d.ends // 2, d.paths // 2)
    confined = held is not None

    def each(b: pa.RecordBatch, counters: dict[str, int]) -> Iterator[tuple[list[int], int]]:
        for i in range(len(b)):
            local = _local(b.column(0)[i].as_py(), b.column(1)[i], b.column(2)[i])
            for c, s in solve(*local, counters, b.column(3)[i].as_py() if confined else None):
                yield [local[0][v] for v in c], s

    n = 4 * sims.sparkSession.sparkContext.defaultParallelism
    dealt = neighbourhoods(sims, tau_q)
    if confined:
        dealt = dealt.join(held, "id")
    return _searched(dealt.repartition(n, "id"), each, watch)


def _over_groups(sims: DataFrame, solve, tau_q: int | None, watch: Observation | None, held: DataFrame | None, edges: int, paths: int) -> DataFrame:
    """The same where no vertex has too many neighbours: edges are packed, their triangles are found by triples of colours
    and go, packed too, to groups of vertices, each a row of a task; their number follows from what they can hold."""
    spark = sims.sparkSession
    p, g = T.colours_for(edges), max(4 * spark.sparkContext.defaultParallelism, -(-2 * edges // T.PACKED), -(-paths // GROUP_LINKS))
    watched, confined = watch is not None, held is not None

    def search(t: pa.Table) -> pa.Table:
        counters: dict[str, int] = {}
        hosts = {}
        if confined:
            rows = t.filter(t.column("hosts").is_valid())
            hosts = dict(zip(rows.column("id").to_pylist(), rows.column("hosts").to_pylist(), strict=True))
        found = []
        for local in T.neighbourhoods_in(t, tau_q):
            names = local[0]
            if not confined or names[0] in hosts:
                found += [([names[v] for v in c], s) for c, s in solve(*local, counters, hosts.get(names[0]))]
        out = pa.Table.from_batches([_out(found)])
        if not watched:
            return out
        kind = pa.struct([(k, pa.int64()) for k in K.COUNTED])
        last = {"clique": pa.nulls(1, pa.list_(pa.int64())), "sum_q": pa.nulls(1, pa.int64()), "counters": pa.array([{k: counters.get(k, 0) for k in K.COUNTED}], kind)}
        return pa.concat_tables([out.append_column("counters", pa.nulls(len(out), kind)), pa.table(last)])

    with Shelf(spark, "groups") as shelf:
        o = shelf.put(oriented(sims.select("u", "v", "sim_q"), "sim_q"))
        blocks = shelf.put(T.packed(o.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim_q"), p))
        links = shelf.put(T.links(blocks, p, g))
        shelf.drop(blocks)
        rows = T.neighbours(o, g).unionByName(links)
        if held is not None:
            rows = rows.unionByName(held.select(block_column("id", g).alias("g"), F.lit(2).alias("kind"), "id", "hosts"), allowMissingColumns=True)
        found = rows.repartition(g, "g").groupBy("g").applyInArrow(search, f"{CLIQUE}, {_COUNTERS}" if watched else CLIQUE)
        if watched:
            found = found.observe(watch, *(F.coalesce(F.sum(f"counters.{k}"), F.lit(0)).alias(k) for k in K.COUNTED)).where("clique is not null").select("clique", "sum_q")
        return materialise(found)


def twins(sims: DataFrame, least: int = TWINS) -> DataFrame | None:
    """(rep, members): vertices that are adjacent and have the same other neighbours, ``least`` or more, under the smallest
    of them; None without any. Hashes of neighbourhoods only say which ones to compare."""
    mixed = lambda c, k: F.xxhash64(c, F.lit(k))
    sums = both_ways(sims).groupBy("id").agg(F.count("*").alias("n"), *(F.bit_xor(mixed("nbr", k)).alias(f"x{k}") for k in (0, 1))).where(F.col("n") >= least)
    keyed = sums.select("id", "n", *(F.col(f"x{k}").bitwiseXOR(mixed("id", k)).alias(f"h{k}") for k in (0, 1)))
    alike = materialise(keyed.groupBy("n", "h0", "h1").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").select(F.explode("ids").alias("id")))
    if not alike.limit(1).count():
        return None
    closed = both_ways(sims).join(alike, "id", "left_semi").groupBy("id").agg(F.array_sort(F.array_append(F.collect_list("nbr"), F.col("id"))).alias("closed"))
    same = closed.groupBy("closed").agg(F.array_sort(F.collect_list("id")).alias("members")).where("size(members) > 1")
    return materialise(same.select(F.col("members")[0].alias("rep"), "members"))


def structural(sims: DataFrame, vertices: DataFrame | None = None, budget: int = K.BUDGET, least: int = TWINS) -> DataFrame:
    """Maximal cliques, whatever their similarity; isolated vertices are cliques of one when ``vertices`` are given.

    A clique that holds a vertex holds its twins too, so one of them is searched for all: a host whose members have no
    other neighbours takes one vertex, not a neighbourhood of all its pairs for each member.
    """

    def solve(names, adj, w, later, earlier, counters, hosts):
        steps = K.Steps(budget)
        for c in K.maximal_cliques(adj, later, earlier, (0,), steps):
            yield c, sum(w[a][b] for i, a in enumerate(c) for b in c[:i])

    classes = twins(sims, least)
    if classes is None:
        found = _over_neighbourhoods(sims, solve)
    else:
        gone = classes.select("rep", F.explode("members").alias("id")).where("id <> rep").select("id")
        kept = materialise(sims.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti"))
        lone = classes.join(both_ways(kept).select(F.col("id").alias("rep")).distinct(), "rep", "left_anti")
        found = _over_neighbourhoods(kept, solve).unionByName(lone.select(F.array("rep").alias("clique"), F.lit(0).cast("long").alias("sum_q")))
        found = _with_twins(found, classes, sims)
    if vertices is not None:
        alone = vertices.select("id").join(both_ways(sims).select("id").distinct(), "id", "left_anti")
        found = found.unionByName(alone.select(F.array("id").alias("clique"), F.lit(0).cast("long").alias("sum_q")))
    return sized(found)


def _with_twins(found: DataFrame, classes: DataFrame, sims: DataFrame) -> DataFrame:
    """The cliques with the twins of their members, and the sums of all their pairs."""
    found = materialise(found.withColumn("n", F.monotonically_increasing_id()))
    held = found.select("n", F.explode("clique").alias("rep")).join(classes, "rep", "left")
    grown = held.groupBy("n").agg(F.array_sort(F.flatten(F.collect_list(F.coalesce("members", F.array("rep"))))).alias("grown"), F.bool_or(F.col("members").isNotNull()).alias("more"))
    grown = materialise(grown.where("more"))
    sums = pairs_within(grown, "grown", "n").join(sims.select("u", "v", "sim_q"), ["u", "v"]).groupBy("n").agg(F.sum("sim_q").alias("sum_q"))
    same = found.join(grown, "n", "left_anti").select("clique", "sum_q")
    return same.unionByName(grown.join(sums, "n").select(F.col("grown").alias("clique"), "sum_q"))


def sized(df: DataFrame) -> DataFrame:
    return df.select("clique", F.size("clique").alias("size"), "sum_q")


def feasible_rows(df: DataFrame, tau_q: int) -> DataFrame:
    return df.where((F.col("size") >= 2) & (2 * F.col("sum_q") >= F.lit(tau_q).cast("long") * F.col("size") * (F.col("size") - 1)))


def maximal_only(found: DataFrame) -> DataFrame:
    """Drop repeated sets and those strictly inside another.

    A superset holds the set's rarest member, so each set is joined with the sets that hold that vertex, and is dropped
    when one is larger and contains it. The rarest member keeps the join small where some vertices are in many sets.
    """
    sets = materialise(found.select("clique", "size", "sum_q").dropDuplicates(["clique"]))
    members = sets.select("clique", "size", F.explode("clique").alias("v"))
    counts = members.groupBy("v").agg(F.count("*").alias("n"))
    rarest = members.join(counts, "v").groupBy("clique").agg(F.min_by("v", F.struct("n", "v")).alias("v"))
    keyed = sets.join(rarest, "clique").withColumn("sig", signature(F.col("clique")))
    # Only vertices that some set is keyed by, and there only sets of three or more can contain another.
    larger = members.where("size > 2").join(keyed.select("v").distinct(), "v", "left_semi").select("v", F.col("clique").alias("b"), F.col("size").alias("b_size"), signature(F.col("clique")).alias("b_sig"))
    inside = (F.col("b_size") > F.col("size")) & (F.col("sig").bitwiseAND(F.col("b_sig")) == F.col("sig")) & within(F.col("clique"), F.col("b"))
    kept = keyed.alias("k").join(larger.alias("l"), (F.col("k.v") == F.col("l.v")) & inside, "left_anti")
    return kept.select("clique", "size", "sum_q")


def layers(sims: DataFrame, tau_q: int, owned: bool = False, max_rounds: int = 1000) -> DataFrame:
    """Feasible sets reached level by level from the feasible pairs, with ``terminal`` for those without a feasible extension by one.

    The plan for data whose neighbourhoods are too large for one task: a level is a join of all members with all
    neighbours and a count of those that all members share. With ``owned`` a set is reached from its parent only
    (see kernels.canonical), which spares the removal of duplicates. Every level is a checkpoint.
    """
    adj = materialise(both_ways(sims, "sim_q").select(F.col("id").alias("m"), F.col("nbr").alias("v"), "sim_q"))
    pair = F.array("u", "v")
    now = materialise(sims.where(F.col("sim_q") >= tau_q).select(pair.alias("clique"), F.col("sim_q").alias("sum_q"), F.array("sim_q", "sim_q").alias("inner")))
    done = None
    for _ in range(max_rounds):
        grown = now.select("clique", "sum_q", "inner", F.posexplode("clique").alias("pos", "m")).join(adj, "m")
        grown = grown.groupBy("clique", "v").agg(F.first("sum_q").alias("sum_q"), F.first("inner").alias("inner"), F.count("*").alias("n"), F.sum("sim_q").alias("add"), F.array_sort(F.collect_list(F.struct("pos", "sim_q"))).alias("links"))
        grown = grown.where("n = size(clique) and not array_contains(clique, v)").where(2 * (F.col("sum_q") + F.col("add")) >= F.lit(tau_q).cast("long") * (F.col("n") + 1) * F.col("n"))
        grown = materialise(grown.withColumn("inner", F.zip_with("inner", F.col("links.sim_q"), lambda a, b: a + b)).select("clique", "v", "sum_q", "inner", "add"))
        ended = now.select("clique", "sum_q").join(grown.select("clique").distinct().withColumn("more", F.lit(True)), "clique", "left").select("clique", "sum_q", F.col("more").isNull().alias("terminal"))
        done = ended if done is None else done.unionByName(ended)
        if owned:
            least = F.array_min(F.zip_with(F.col("inner"), F.col("clique"), lambda s, m: F.struct(s.alias("s"), m.alias("m"))))
            grown = grown.where(F.struct(F.col("add").alias("s"), F.col("v").alias("m")) < least)
        # Members stay sorted, and each one's sum of links with it.
        both = F.array_sort(F.concat(F.arrays_zip(F.col("clique").alias("m"), F.col("inner").alias("s")), F.array(F.struct(F.col("v").alias("m"), F.col("add").alias("s")))))
        after = grown.withColumn("z", both).select(F.col("z.m").alias("clique"), (F.col("sum_q") + F.col("add")).alias("sum_q"), F.col("z.s").alias("inner"))
        now = materialise(after if owned else after.dropDuplicates(["clique"]))
        if not now.limit(1).count():
            return done.select("clique", F.size("clique").alias("size"), "sum_q", "terminal")
    raise RuntimeError(f"layers: sets of more than {max_rounds} members")


def feasible_sets(sims: DataFrame, tau_q: int) -> DataFrame:
    """All feasible sets."""
    return layers(sims, tau_q, owned=True).select("clique", "size", "sum_q")


def hosts_with_pairs(hosts: DataFrame, sims: DataFrame) -> DataFrame:
    """(clique, pairs): each host of two or more with the similarities of its pairs as (i, j, s) by position."""
    h = hosts.where("size >= 2").select("clique")
    two = F.expr("flatten(transform(clique, (a, i) -> transform(slice(clique, i + 2, size(clique)), (b, j) -> struct(i as i, i + j + 1 as j, a as u, b as v))))")
    pairs = h.select("clique", F.explode(two).alias("p")).select("clique", "p.*").join(sims.select("u", "v", "sim_q"), ["u", "v"])
    return pairs.groupBy("clique").agg(F.collect_list(F.struct("i", "j", F.col("sim_q").alias("s"))).alias("pairs"))


def hosts_of_pairs(hosts: DataFrame, sims: DataFrame, tau_q: int) -> DataFrame:
    """(u, v, hosts): for each pair that reaches the threshold how many hosts hold both its ends, which a search from it
    may stay inside; pairs within no host are left out."""
    near = hosts_with_pairs(hosts, sims.where(F.col("sim_q") >= tau_q)).select("clique", F.explode("pairs").alias("p"))
    ends = near.select(F.expr("clique[p.i]").alias("u"), F.expr("clique[p.j]").alias("v"))
    return ends.groupBy("u", "v").agg(F.count("*").alias("hosts"))


def hosts_at_roots(hosts: DataFrame, sims: DataFrame, tau_q: int) -> DataFrame:
    """(id, hosts): for each vertex that a supporting pair starts from, in the order of (degree, id), the hosts that hold
    such a pair. Hosts that are feasible need no search and are left out."""
    pairs = oriented(sims, "sim_q").where(F.col("sim_q") >= tau_q).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("a").alias("id"))
    h = hosts.where((F.col("size") >= 2) & (2 * F.col("sum_q") < F.lit(tau_q).cast("long") * F.col("size") * (F.col("size") - 1))).select("clique")
    two = F.expr("flatten(transform(clique, (a, i) -> transform(slice(clique, i + 2, size(clique)), b -> struct(a as u, b as v))))")
    held = h.select("clique", F.explode(two).alias("p")).select("clique", "p.*").join(pairs, ["u", "v"]).select("id", "clique").distinct()
    return held.groupBy("id").agg(F.collect_list("clique").alias("hosts"))


def _host_rows(hosts: DataFrame, sims: DataFrame, tau_q: int) -> tuple[DataFrame, DataFrame]:
    """(feasible hosts, others as (clique, rows, size, host)); those without a pair that reaches the threshold are in neither.

    ``rows`` has for each member but the last its similarities to the later ones. Pairs travel with their host's number, not
    with its members, and are gathered a member at a time, so the largest row is 8 bytes for each pair of a host.
    """
    h = materialise(hosts.where("size >= 2").select("clique", F.monotonically_increasing_id().alias("host")))
    each = h.select("host", "clique", F.posexplode("clique").alias("i", "u"))
    pairs = each.select("host", "i", "u", F.posexplode(F.expr("slice(clique, i + 2, size(clique))")).alias("j", "v")).join(sims.select("u", "v", "sim_q"), ["u", "v"])
    lines = pairs.groupBy("host", "i").agg(F.array_sort(F.collect_list(F.struct("j", F.col("sim_q").alias("s")))).alias("row"), F.max("sim_q").alias("best"), F.sum("sim_q").alias("sum_q"))
    lines = materialise(lines.select("host", "i", F.col("row.s").alias("row"), "best", "sum_q"))
    sums = h.join(lines.groupBy("host").agg(F.max("best").alias("best"), F.sum("sum_q").alias("sum_q")), "host").withColumn("size", F.size("clique")).where(F.col("best") >= tau_q)
    good = 2 * F.col("sum_q") >= F.lit(tau_q).cast("long") * F.col("size") * (F.col("size") - 1)
    rest = sums.where(~good).select("host", "clique", "size")
    packed = lines.join(rest.select("host"), "host", "left_semi").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("rows"))
    return sums.where(good).select("clique", "sum_q"), materialise(rest.join(packed, "host").select("clique", F.col("rows.row").alias("rows"), "size", "host"))


def _matrix(rows: list[list[int]]) -> list[list[int]]:
    m = len(rows) + 1
    w = [[0] * m for _ in range(m)]
    for i, row in enumerate(rows):
        w[i][i + 1 :] = row
        for j, s in enumerate(row, i + 1):
            w[j][i] = s
    return w


def from_hosts(hosts: DataFrame, sims: DataFrame, tau_q: int, method: str, budget: int = K.BUDGET, split: int = SPLIT, combinations: int = COMBINATIONS, watch: Observation | None = None) -> DataFrame:
    """Candidates of each host. Hosts that are feasible, or have no pair that reaches the threshold, need no search. By the
    canonical method those of ``split`` members or more are searched in SHARES tasks, each with its part of the budget;
    by subsets, those with ``combinations`` or more subsets of a size that their bounds leave open go to layered_subsets()."""
    good, paired = _host_rows(hosts, sims, tau_q)

    def each(b: pa.RecordBatch, counters: dict[str, int]) -> Iterator[tuple[list[int], int]]:
        for at in range(len(b)):  # one host's pairs at a time
            members, rows, k, n = (b.column(x)[at].as_py() for x in range(4))
            for c, s in K.solve_host(members, _matrix(rows), tau_q, method, budget=budget, part=(k, n), counters=counters):
                yield [members[v] for v in c], s

    n = 4 * sims.sparkSession.sparkContext.defaultParallelism
    found = good
    if method == "canonical":
        shares = F.when(F.col("size") >= split, SHARES).otherwise(1)
        dealt = paired.select("clique", "rows", shares.alias("shares"), "host").withColumn("share", F.explode(F.expr("sequence(0, shares - 1)")))
    else:
        # The number of subsets of half the size bounds that of any size.
        large = F.expr(f"aggregate(sequence(1, greatest(1, size div 2)), 1.0D, (c, i) -> c * (size - i + 1) / i) >= {float(combinations)}D")
        found = found.unionByName(layered_subsets(paired.where(large).select("clique", "rows", "host"), tau_q, budget, combinations, watch=None))
        dealt = paired.where(~large).select("clique", "rows", F.lit(1).alias("shares"), F.lit(0).alias("share"), "host")
    return sized(found.unionByName(_searched(dealt.select("clique", "rows", "share", "shares", "host").repartition(n, "host", "share"), each, watch)))


def layered_subsets(paired: DataFrame, tau_q: int, budget: int = K.BUDGET, combinations: int = COMBINATIONS, watch: Observation | None = None) -> DataFrame:
    """(clique, sum_q): the feasible subsets of large hosts(clique, rows, host) that no larger one contains.

    Sizes go down for all hosts together, a job for each size that the bounds of some host leave open. A host with many
    subsets of a size has them dealt out by their first member, one share of the budget each; every task gets the host's
    sets of larger sizes, which are fixed by then. Each size is a checkpoint. A host goes to as many tasks as partitions
    at most, each with several first members.
    """
    rows = paired
    found = rows.select("clique", F.lit(0).cast("long").alias("sum_q"), "host").where("false")
    if not rows.limit(1).count():
        return found.drop("host")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(len(b)):
                host, pairs = b.column(0)[at].as_py(), b.column(1)[at].as_py()
                w, m = _matrix(pairs), len(pairs) + 1
                ks = K.open_layers(w, tau_q)
                K.refuse(w, tau_q, budget * len(ks), ks[0] if ks else 0)
                parts = [m - k + 1 if K.at_least(m, k, combinations) else 1 for k in ks]
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([ks], pa.list_(pa.int32())), pa.array([parts], pa.list_(pa.int32()))], ["host", "layers", "parts"])

    n = 4 * rows.sparkSession.sparkContext.defaultParallelism
    layers = rows.select("host", "rows").repartition(n, "host").mapInArrow(bounds, "host long, layers array<int>, parts array<int>")
    layers = materialise(layers.select("host", F.explode(F.arrays_zip("layers", "parts")).alias("z")).select("host", F.col("z.layers").alias("k"), F.col("z.parts").alias("parts")))

    for k in sorted((r.k for r in layers.select("k").distinct().collect()), reverse=True):  # as many as a host has members at most

        def each(b: pa.RecordBatch, counters: dict[str, int], k: int = k) -> Iterator[tuple[list[int], int]]:
            for at in range(len(b)):
                members, pairs, larger, share, shares, parts = (b.column(x)[at].as_py() for x in range(6))
                place, w = {v: i for i, v in enumerate(members)}, _matrix(pairs)
                masks = [sum(1 << place[v] for v in c) for c in larger or ()]
                for first in range(share, parts, shares):
                    for mask, s in K.subsets_of_size(w, k, tau_q, masks, K.Steps(budget // parts), first if parts > 1 else None, counters=counters):
                        yield [members[v] for v in K.bits(mask)], s

        larger = found.groupBy("host").agg(F.collect_list("clique").alias("larger"))
        task = layers.where(F.col("k") == k).withColumn("shares", F.least("parts", F.lit(n))).withColumn("share", F.explode(F.expr("sequence(0, shares - 1)")))
        task = task.join(rows, "host").join(larger, "host", "left").select("clique", "rows", "larger", "share", "shares", "parts", "host")
        fresh = _with_host(task.repartition(n, "host", "share"), each)
        found = materialise(found.unionByName(fresh))
    return found.drop("host")


def _with_host(task: DataFrame, each) -> DataFrame:
    """Sets with the host they were found in, as (clique, sum_q, host)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                one = b.slice(i, 1)
                for rows in _in_batches(each(one, {})):
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([one.column(6)[0].as_py()] * len(rows), pa.int64())], ["clique", "sum_q", "host"])

    return task.mapInArrow(run, f"{CLIQUE}, host long")


def msc(sims: DataFrame, tau_q: int, algorithm: str = "auto", budget: int = K.BUDGET, watch: Observation | None = None) -> DataFrame:
    """Maximal sets whose average similarity reaches the threshold; clique, size, sum_q. Singletons are never in it.

    layered, layered_canonical: joins level by level. canonical, visited: searches from supporting pairs in the
    neighbourhood of each pair's vertex of smaller degree; owned: likewise, each set from its lowest supporting pair.
    shared_hosts: as canonical, but inside the structural maximal cliques that hold the pair and aren't feasible. strsub,
    host_canonical: searches inside each structural maximal clique. sem_bk: visits all cliques that its bounds leave. auto:
    by the largest degree and the share of pairs that reach the threshold.

    ``watch`` is an Observation that has what the search counted (kernels.COUNTED) once the result has been computed; of
    layered plans states and terminals, and nothing of hosts that strsub splits.
    """
    if algorithm == "auto":
        algorithm = choose(sims, tau_q)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no algorithm {algorithm}; there are {', '.join(ALGORITHMS)}, auto")
    if algorithm in ("layered", "layered_canonical"):
        reached = layers(sims, tau_q, owned=algorithm == "layered_canonical")
        if watch is not None:
            n = {"states": F.count("*"), "terminals": F.count_if("terminal")}
            reached = reached.observe(watch, *(n.get(k, F.lit(0).cast("long")).alias(k) for k in K.COUNTED))
        return maximal_only(reached.where("terminal").drop("terminal"))
    if algorithm in ("strsub", "host_canonical"):
        return maximal_only(from_hosts(structural(sims), sims, tau_q, "subsets" if algorithm == "strsub" else "canonical", budget, watch=watch))
    hosts = materialise(structural(sims)) if algorithm == "shared_hosts" else None
    apart = None
    if hosts is not None and watch is None:
        hosts, apart = _set_apart(hosts)

    def solve(names, adj, w, later, earlier, counters, held):
        steps = K.Steps(budget)
        if algorithm == "sem_bk":
            yield from K.pivot_free(adj, w, 0, later, earlier, tau_q, steps, counters)
            return
        roots = [(0, v) for v in K.bits(later) if w[0][v] >= tau_q]
        if algorithm == "visited":
            yield from K.visited(adj, w, roots, tau_q, steps, counters)
        elif algorithm == "owned":
            yield from K.owned(adj, w, names, roots, tau_q, counters, steps)
        else:
            inside = None
            if held is not None:
                at, inside = {v: k for k, v in enumerate(names)}, [0] * len(names)
                for k, h in enumerate(held):
                    for v in h:
                        inside[at[v]] |= 1 << k
            yield from K.canonical(adj, w, names, roots, tau_q, counters, steps, inside)

    held = hosts_at_roots(hosts, sims, tau_q) if hosts is not None else None
    if apart is not None:
        inside = from_hosts(apart, sims, tau_q, "canonical", budget)
        if not (held := materialise(held)).limit(1).count():
            return maximal_only(inside.unionByName(feasible_rows(hosts, tau_q)))
    found = sized(_over_neighbourhoods(sims, solve, None if algorithm == "sem_bk" else tau_q, watch, held))
    if hosts is not None:
        found = found.unionByName(feasible_rows(hosts, tau_q))
    if apart is not None:
        found = found.unionByName(inside)
    return found if algorithm == "sem_bk" else maximal_only(found)


def _set_apart(hosts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(other hosts, large ones that share no pair with another): a search from a pair of the latter stays in its one host,
    so it takes the host's pairs once for each share of it, not for each of its members."""
    h = materialise(hosts.withColumn("host", F.monotonically_increasing_id()))
    if not h.where(F.col("size") >= SPLIT).limit(1).count():
        return hosts, None
    members = h.select("host", "size", F.explode("clique").alias("x"))
    meet = members.where(F.col("size") >= SPLIT).select("host", "x").join(members.select(F.col("host").alias("other"), "x"), "x").where("host <> other")
    linked = meet.groupBy("host", "other").count().where("count > 1").select("host").distinct()
    apart = materialise(h.where(F.col("size") >= SPLIT).join(linked, "host", "left_anti"))
    if not apart.limit(1).count():
        return hosts, None
    return h.join(apart.select("host"), "host", "left_anti").drop("host"), apart.drop("host")


def choose(sims: DataFrame, tau_q: int, share: float = 0.3, hub: int = HUB) -> str:
    """A vertex whose neighbourhood is too large for a row: levels of joins. Else few supporting pairs: search from them;
    many: search inside structural cliques."""
    n, up = sims.agg(F.count("*"), F.coalesce(F.sum((F.col("sim_q") >= tau_q).cast("long")), F.lit(0))).first()
    if n > hub and degrees(sims).agg(F.max("degree")).first()[0] > hub:
        return "layered_canonical"
    return "canonical" if not n or up / n <= share else "host_canonical"


def counted(sims: DataFrame, tau_q: int, algorithm: str = "canonical", budget: int = K.BUDGET) -> tuple[DataFrame, dict[str, int]]:
    """The result of a plan and what its search counted, from one run."""
    watch = Observation()
    found = materialise(msc(sims, tau_q, algorithm, budget, watch))
    return found, dict(watch.get)


def search_counters(sims: DataFrame, tau_q: int, algorithm: str = "canonical") -> DataFrame:
    """One row of what the search counts."""
    n = counted(sims, tau_q, algorithm)[1]
    return sims.sparkSession.createDataFrame([tuple(n[k] for k in K.COUNTED)], ", ".join(f"{k} long" for k in K.COUNTED))


def pairsim_cliques(sims: DataFrame, vertices: DataFrame, tau_q: int) -> DataFrame:
    """Maximal cliques of the graph of pairs that reach the threshold; vertices without one are singletons."""
    return structural(sims.where(F.col("sim_q") >= tau_q), vertices)


def host_bounds(hosts: DataFrame, sims: DataFrame) -> DataFrame:
    """(clique, k, bound_q): the sum of the k (k - 1) / 2 largest pairs of each host, for each size k."""
    paired = hosts_with_pairs(hosts, sims).withColumn("s", F.reverse(F.array_sort("pairs.s")))
    sizes = F.explode(F.sequence(F.lit(2), F.size("clique"))).alias("k")
    return paired.select("clique", "s", sizes).select("clique", "k", F.expr("aggregate(slice(s, 1, cast(k * (k - 1) / 2 as int)), 0L, (a, x) -> a + x)").alias("bound_q"))


def host_top_edges(hosts: DataFrame, sims: DataFrame, n: int = 3) -> DataFrame:
    """(clique, top): the n largest similarities of each host, falling."""
    return hosts_with_pairs(hosts, sims).select("clique", F.slice(F.reverse(F.array_sort("pairs.s")), 1, n).alias("top"))


def member_sums(found: DataFrame, sims: DataFrame) -> DataFrame:
    """(clique, v, inner): each member's sum of similarities to the others."""
    paired = hosts_with_pairs(found, sims).select("clique", F.explode("pairs").alias("p"))
    ends = F.explode(F.array("p.i", "p.j")).alias("at")
    return paired.select("clique", ends, F.col("p.s").alias("s")).groupBy("clique", "at").agg(F.sum("s").alias("inner")).select("clique", F.expr("clique[at]").alias("v"), "inner")


