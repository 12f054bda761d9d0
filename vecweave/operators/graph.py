"""Undirected simple graphs as edges(u, v) with u < v and vertices(id)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Shelf, few, materialise, side
from .blocks import ENTRIES, blocks_for, shells
from .triples import EDGES, colours_for, counts, packed

#: Edges of a graph that one task may hold (about 200 MB there).
IN_TASK = 2_000_000
#: Bytes of edges out that edges may take along at a time.
AT_ONCE = 1 << 28


def canonical(raw: DataFrame) -> DataFrame:
    """Each undirected edge once, smaller end first; loops and rows with a null end go."""
    return raw.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def checked(raw: DataFrame, vertices: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows whose ends are vertices. FAILFAST raises at the first other row; PERMISSIVE drops it."""
    ids = vertices.select("id")
    bad = raw.join(ids.withColumnRenamed("id", "u"), "u", "left_anti").unionByName(raw.join(ids.withColumnRenamed("id", "v"), "v", "left_anti"))
    if mode == "FAILFAST":
        first = bad.select("u", "v").limit(1).collect()
        if first:
            raise ValueError(f"edge with an end that is no vertex: {first[0].asDict()}")
        return raw
    return raw.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")


def both_ways(edges: DataFrame, *carried: str) -> DataFrame:
    """Every edge from each of its ends: (id, nbr, *carried)."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("id"), F.col("u").alias("nbr")))).alias("e"), *carried).select("e.id", "e.nbr", *carried)


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, degree); with ``vertices`` isolated ones too."""
    d = both_ways(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return d if vertices is None else vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def oriented(edges: DataFrame, *carried: str) -> DataFrame:
    """(a, b, *carried): each edge from the end of smaller (degree, id); no vertex has more than about sqrt(2E) edges out."""
    d = materialise(degrees(edges))
    small = few(d)
    e = edges.join(side(d.select(F.col("id").alias("u"), F.col("degree").alias("du")), small), "u").join(side(d.select(F.col("id").alias("v"), F.col("degree").alias("dv")), small), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    return e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"), *carried)


def common_out(edges: DataFrame) -> DataFrame:
    """(a, b, cs): for each edge the vertices that close a triangle with it, each triangle at its first edge only.

    Every vertex holds its edges out as one array, at most about sqrt(2E) of them, and an edge meets the two arrays of its
    ends: no wedge is a row of its own.
    """
    o = materialise(oriented(edges).select("a", "b"))
    out = materialise(o.groupBy("a").agg(F.collect_list("b").alias("out")))
    sent = out.select("a", "out", F.explode("out").alias("b")).where("size(out) > 1")
    met = sent.join(out.select(F.col("a").alias("b"), F.col("out").alias("theirs")), "b")
    return met.select("a", "b", F.array_intersect("out", "theirs").alias("cs")).where("size(cs) > 0")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) once for each triangle."""
    return common_out(edges).select("a", "b", F.explode("cs").alias("c"))


def triangle_counts(edges: DataFrame, in_task: int = EDGES) -> DataFrame:
    """(id, triangles) of each vertex that is in one; edges are packed, and read by triples of colours (see triples.py)."""
    ids = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    with Shelf(edges.sparkSession, "triangles") as shelf:
        e = shelf.put(ids)
        p = colours_for(e.count(), in_task)
        blocks = shelf.put(packed(e, p))
        shelf.drop(e)
        return materialise(counts(blocks, p).groupBy("id").agg(F.sum("n").alias("triangles")))


def peeled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, core numbers) of a graph in memory: the vertex of smallest remaining degree goes first, time linear in edges."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    both, other = np.concatenate([a, b]), np.concatenate([b, a])
    nbrs = other[np.argsort(both, kind="stable")].astype(np.int32)
    degree = np.bincount(both, minlength=len(ids))
    at = np.concatenate([[0], np.cumsum(degree)]).tolist()
    core, gone = degree.tolist(), [False] * len(ids)
    waiting: list[list[int]] = [[] for _ in range(int(degree.max(initial=0)) + 1)]
    for x, d in enumerate(core):
        waiting[d].append(x)
    d = 0
    while d < len(waiting):
        if not waiting[d]:
            d += 1
            continue
        x = waiting[d].pop()
        if gone[x] or core[x] != d:  # it has moved to a smaller degree since
            continue
        gone[x] = True
        for y in nbrs[at[x] : at[x + 1]].tolist():
            if core[y] > d:
                core[y] -= 1
                waiting[core[y]].append(y)
    return ids, np.array(core, np.int64)


def cores(edges: DataFrame, in_task: int = IN_TASK, block: int = ENTRIES) -> DataFrame:
    """(id, core): each vertex's core number; the largest is the graph's degeneracy.

    A graph of at most ``in_task`` edges, which a count shows, is peeled in one task. In a larger one every vertex holds
    an upper bound, at first its degree, and lowers it to the largest h such that h neighbours hold h or more, until
    nothing changes, however long that takes; a round looks only at vertices with a neighbour that moved in the last
    one. Vertices are in blocks of about ``block`` neighbours; where one has too many for a block, rounds are joins. A
    round's rows go once the next ones are written; the number of rounds is small but where long chains hang on the graph.
    """
    if edges.limit(in_task + 1).count() <= in_task:
        def peel(t: pa.Table) -> pa.Table:
            ids, core = peeled(t.column("u").to_numpy(), t.column("v").to_numpy())
            return pa.table({"id": pa.array(ids), "core": pa.array(core)})

        return edges.select(F.lit(0).alias("one"), "u", "v").groupBy("one").applyInArrow(peel, "id long, core long")
    if n := blocks_for(both_ways(edges), block):
        with Shelf(edges.sparkSession, "cores") as shelf:
            return materialise(shells(shelf, both_ways(edges), n, layers=False).select("id", "core"))
    with Shelf(edges.sparkSession, "cores") as shelf:
        # Sorted by id, so that packed files are small.
        adj = shelf.put(both_ways(edges).repartition("id").sortWithinPartitions("id", "nbr"))
        now = shelf.put(adj.groupBy("id").agg(F.count("*").cast("long").alias("core")))
        loose = None
        while True:
            open_ = adj if loose is None else adj.join(loose, "id", "left_semi")
            seen = open_.join(now.select(F.col("id").alias("nbr"), F.col("core").alias("theirs")), "nbr").groupBy("id", "theirs").agg(F.count("*").alias("n"))
            # Counts by value, from the largest down: h is the largest min(value, neighbours with that value or more).
            at_least = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("theirs")))
            h = seen.withColumn("h", F.least("theirs", at_least)).groupBy("id").agg(F.max("h").alias("h"))
            after = shelf.put(now.join(h, "id", "left").select("id", F.least("core", F.coalesce("h", "core")).alias("core"), F.coalesce(F.col("h") < F.col("core"), F.lit(False)).alias("moved")))
            shelf.drop(now)
            if loose is not None:
                shelf.drop(loose)
            now, moved = after, after.where("moved").select(F.col("id").alias("nbr"))
            if not moved.limit(1).count():
                return materialise(now.select("id", "core"))
            loose = shelf.put(adj.join(moved, "nbr", "left_semi").select("id").distinct())


def triangle_total(shelf: Shelf, edges: DataFrame, degree: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """One row (triangles), where common_out() would need more disk than there is.

    Vertices are numbered by (degree, id), as ints if they fit, and sorted arrays of edges out hold the numbers. An edge
    takes along only what follows its far end there. Edges go in rounds by their far end, so that the arrays of a round
    are ``at_once`` bytes, or 8 bytes for each edge of the graph, whichever is more; a round's shuffles go at its end.
    """
    kind = "int" if degree.count() < 1 << 31 else "long"
    place = placed(degree, [F.col("degree"), F.col("id")]).select("id", F.col("place").cast(kind).alias("place"))
    half = shelf.put(edges.join(place.withColumnRenamed("id", "u").hint("merge"), "u").select(F.col("place").alias("p"), "v"))
    o = half.join(place.withColumnRenamed("id", "v").hint("merge"), "v").select(F.least("p", "place").alias("a"), F.greatest("p", "place").alias("b"))
    out = shelf.put(o.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("out")))
    shelf.drop(half)
    size, k = (4 if kind == "int" else 8), F.size("out").cast("long")
    sums = out.agg(F.coalesce(F.sum(k), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.expr("bigint(size(out)) * (size(out) - 1) div 2")), F.lit(0)).alias("sent")).first()
    rounds = -(-sums.sent * size // max(at_once, 8 * sums.edges, 1)) or 1
    found = None
    for r in range(rounds):
        mine = lambda c, r=r: F.col(c) % rounds == r
        sent = out.select("out", F.posexplode("out").alias("i", "b")).where(mine("b") & (F.col("i") + 1 < F.size("out"))).select("b", F.expr("slice(out, i + 2, size(out))").alias("rest"))
        met = sent.join(out.where(mine("a")).select(F.col("a").alias("b"), F.col("out").alias("theirs")).hint("shuffle_hash"), "b")
        part = shelf.put(met.agg(F.coalesce(F.sum(F.size(F.array_intersect("rest", "theirs"))), F.lit(0)).alias("n")))
        found = part if found is None else found.unionByName(part)
    return found.agg(F.sum("n").alias("triangles"))


def audit(raw: DataFrame, vertices: DataFrame, order: bool = False, in_task: int = IN_TASK, at_once: int = AT_ONCE) -> DataFrame:
    """One row: rows, loops, duplicates, edges, degrees, wedges, triangles, transitivity; with ``order`` the degeneracy and
    the largest forward degree too. ``raw`` is read once; what is kept of it are its different pairs and their counts."""
    with Shelf(raw.sparkSession, "audit") as shelf:
        whole = F.col("u").isNotNull() & F.col("v").isNotNull()
        pairs = raw.select(F.when(whole, F.least("u", "v")).alias("u"), F.when(whole, F.greatest("u", "v")).alias("v"))
        pairs = shelf.put(pairs.groupBy("u", "v").agg(F.count("*").alias("n")).sortWithinPartitions("u", "v"))
        edges = pairs.where("u <> v").select("u", "v")
        rows = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("n"))), F.lit(0)).alias("self_loops"))
        n = vertices.agg(F.countDistinct("id").alias("vertices"))
        degree = shelf.put(degrees(edges))
        d = degree.agg(
            F.coalesce((F.sum("degree") / 2).cast("long"), F.lit(0)).alias("edges"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.sum(F.expr("degree * (degree - 1) div 2")), F.lit(0)).alias("wedges")
        )
        t = triangle_total(shelf, edges, degree, at_once)
        one = rows.join(F.broadcast(n)).join(F.broadcast(d)).join(F.broadcast(t))  # one row each
        more = ["degeneracy", "max_forward_degree"] if order else []
        if order:
            one = one.join(F.broadcast(forward_degree(edges, in_task)))
        return materialise(one.select(
            "vertices", "input_rows", "self_loops", (F.col("input_rows") - F.col("self_loops") - F.col("edges")).alias("duplicate_edges"), "edges",
            F.when(F.col("vertices") > 0, F.round(2.0 * F.col("edges") / F.col("vertices"), 6)).otherwise(0.0).alias("average_degree"), "max_degree", "wedges", "triangles",
            F.when(F.col("wedges") > 0, F.round(3.0 * F.col("triangles") / F.col("wedges"), 6)).otherwise(0.0).alias("transitivity"), *more,
        ))


def order_audit(raw: DataFrame, vertices: DataFrame, in_task: int = IN_TASK, block: int = ENTRIES) -> DataFrame:
    """The row of audit() with ``order``, as far as it needs no triangles: (vertices, edges, degeneracy, max_forward_degree)."""
    n = vertices.agg(F.countDistinct("id").alias("vertices"))
    with Shelf(raw.sparkSession, "audit") as shelf:
        edges = shelf.put(canonical(raw))
        m = edges.agg(F.count("*").alias("edges"))
        return materialise(n.join(F.broadcast(m)).join(F.broadcast(forward_degree(edges, in_task, block))))  # one row each


def degeneracy_order(edges: DataFrame, in_task: int = IN_TASK, block: int = ENTRIES) -> DataFrame:
    """(id, core, layer, position): an order in which no vertex has more than its core number of neighbours after it.

    Core numbers come first. Then all shells, the vertices of one core number, are peeled at the same time: those with no
    more neighbours left than their core number, in the shell or in higher ones, are the next layer. Positions go by core,
    layer and id, from ranges. There are as many rounds as the deepest shell has layers, and a round's rows go once the
    next ones are written; only edges inside a shell are looked at. Blocks and joins are as in cores().
    """
    if n := blocks_for(both_ways(edges), block):
        with Shelf(edges.sparkSession, "order") as shelf:
            order = materialise(shells(shelf, both_ways(edges), n).select("id", "core", "layer"))
        return materialise(placed(order, [F.col("core"), F.col("layer"), F.col("id")]).withColumnRenamed("place", "position"))
    core = materialise(cores(edges, in_task, block))
    with Shelf(edges.sparkSession, "order") as shelf:
        nbrs = both_ways(edges).join(core.withColumnRenamed("core", "c"), "id").join(core.select(F.col("id").alias("nbr"), F.col("core").alias("theirs")), "nbr")
        nbrs = shelf.put(nbrs.where("theirs >= c").select("id", "nbr", (F.col("theirs") == F.col("c")).alias("same")).repartition("id").sortWithinPartitions("id", "nbr"))
        now = shelf.put(core.join(nbrs.groupBy("id").agg(F.count("*").alias("left")), "id").select("id", "core", "left"))
        inside, done, layer = nbrs.where("same").select("id", "nbr"), None, 0
        while True:
            first = F.col("left") <= F.col("core")
            peel = shelf.put(now.where(first).select("id", "core", F.lit(layer).alias("layer")))
            done = peel if done is None else done.unionByName(peel)
            lost = inside.join(peel.select(F.col("id").alias("nbr")), "nbr", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
            after = shelf.put(now.where(~first).join(lost, "id", "left").select("id", "core", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")))
            shelf.drop(now)
            now, layer = after, layer + 1
            if not now.limit(1).count():
                order = [F.col("core"), F.col("layer"), F.col("id")]
                return materialise(placed(done, order).select("id", "core", "layer", F.col("place").alias("position")))


def forward_degree(edges: DataFrame, in_task: int = IN_TASK, block: int = ENTRIES) -> DataFrame:
    """(degeneracy, max_forward_degree): the largest core number, and the most neighbours that come after a vertex in
    degeneracy_order(); they are equal. In blocks neighbours ahead are counted there, by core, layer and id."""
    if n := blocks_for(both_ways(edges), block):
        with Shelf(edges.sparkSession, "order") as shelf:
            found = shells(shelf, both_ways(edges), n)
            return materialise(found.agg(F.coalesce(F.max("core"), F.lit(0)).cast("long").alias("degeneracy"), F.coalesce(F.max("ahead"), F.lit(0)).cast("long").alias("max_forward_degree")))
    order = materialise(degeneracy_order(edges, in_task, block))
    e = edges.join(order.select(F.col("id").alias("u"), F.col("position").alias("pu")), "u").join(order.select(F.col("id").alias("v"), F.col("position").alias("pv")), "v")
    out = e.groupBy(F.when(F.col("pu") < F.col("pv"), F.col("u")).otherwise(F.col("v")).alias("id")).agg(F.count("*").alias("n"))
    top = order.agg(F.coalesce(F.max("core"), F.lit(0)).alias("degeneracy"))
    return top.join(F.broadcast(out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_forward_degree"))))  # one row each


def placed(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``place``, from 0, in the given order, which must tell all rows apart.

    Places come from range partitions and their sizes, so no task holds all rows, nor all that agree in a part of the order.
    """
    dealt = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row for each partition.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_w", within).join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("place", F.col("_before") + F.col("_w")).drop("_p", "_w", "_before")


def compact_ids(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertex_map(orig_id, id), edges) with ids 0, 1, ... in the order of the old ones."""
    ids = vertices.select(F.col("id").alias("orig_id")).distinct()
    mapped = materialise(placed(ids, [F.col("orig_id")]).select("orig_id", F.col("place").alias("id")))
    return mapped, relabelled(edges, mapped)


def relabelled(edges: DataFrame, mapped: DataFrame) -> DataFrame:
    a, b = (mapped.select(F.col("orig_id").alias(k), F.col("id").alias(f"new_{k}")) for k in ("u", "v"))
    return edges.join(a, "u").join(b, "v").select(F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v"))


def induced(edges: DataFrame, some: DataFrame) -> DataFrame:
    """The edges with both ends in ``some(id)``."""
    return edges.join(some.select(F.col("id").alias("u")), "u", "left_semi").join(some.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")


def degree_ranks(edges: DataFrame, vertices: DataFrame, n: int | None = None) -> DataFrame:
    """(id, degree, rank) with ranks from 1 by falling degree, then id; the first ``n`` only if given.

    With ``n`` each task keeps its own first n before they meet. Without, vertices are dealt by ranges of degree and id
    together, so the many vertices of degree one are in many tasks.
    """
    d = degrees(edges, vertices)
    order = [F.desc("degree"), F.asc("id")]
    if n is not None:
        first = d.orderBy(*order).limit(n)
        return placed(first, order).select("id", "degree", (F.col("place") + 1).cast("int").alias("rank"))
    return placed(d, order).select("id", "degree", (F.col("place") + 1).cast("int").alias("rank"))


def nested_graphs(edges: DataFrame, vertices: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, id, orig_id, vec): for each size the first vertices(id, vec) by rank with ids from 0 in the order of the old
    ones, and their vectors with them; nested_levels() has the edges, relabelled() gives them the new ids."""
    r = degree_ranks(edges, vertices).where(F.col("rank") <= max(sizes, default=0)).select("id", "rank")
    level = F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= F.col("rank"))
    rows = vertices.select("id", "vec").join(r, "id").select(F.explode(level).alias("size"), F.col("id").alias("orig_id"), "vec")
    first = placed(rows.select("size", "orig_id"), [F.col("size"), F.col("orig_id")])
    start = first.groupBy("size").agg(F.min("place").alias("start"))  # a row for each size
    return rows.join(first, ["size", "orig_id"]).join(F.broadcast(start), "size").select("size", (F.col("place") - F.col("start")).alias("id"), "orig_id", "vec")


def nested_levels(edges: DataFrame, ranks: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, u, v): the edges of the graph induced by the first ``size`` vertices by rank, for each size."""
    r = ranks.where(F.col("rank") <= max(sizes, default=0)).select("id", "rank")
    e = edges.join(r.select(F.col("id").alias("u"), F.col("rank").alias("ru")), "u").join(r.select(F.col("id").alias("v"), F.col("rank").alias("rv")), "v")
    level = F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= F.greatest("ru", "rv"))
    return e.select(F.explode(level).alias("size"), "u", "v")


def pairs_within(rows: DataFrame, items: str, *carried: str) -> DataFrame:
    """(u, v, *carried) for each two elements of the array ``items``, the earlier first; a row holds the pairs of no more
    than one element at a time."""
    each = rows.select(*carried, F.col(items).alias("_x"), F.posexplode(items).alias("_i", "u"))
    rest = each.select(*carried, "u", F.expr("slice(_x, _i + 2, size(_x))").alias("_r"))
    return rest.select("u", F.explode("_r").alias("v"), *carried)


def co_occurrence(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(u, v) for each two items that share a group. Each group is one row of distinct items, so it is read once."""
    sets = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(F.col(item).cast("long"))).alias("items"))
    return pairs_within(sets, "items").distinct()


def unit_interval(*of) -> Column:
    """A number in [0, 1) from the MD5 of the given columns, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in of))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sampled(vertices: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """The vertices whose hash falls below ``ratio``; the same ones in every run."""
    return vertices.where(unit_interval(F.lit(seed), "id") < ratio)


def bfs_expansion(edges: DataFrame, start: int, checkpoints: list[int]) -> dict[int, DataFrame]:
    """For each edge count, the edges that a breadth-first walk from ``start`` has met in the first level to reach it.

    A level's edges are those with an end in the frontier. Each level is a checkpoint, and the walk goes on for as many
    levels as it takes. If it ends early, as all that can be reached is met, that stands for the counts that are left.
    """
    adj = materialise(both_ways(edges))
    frontier = edges.sparkSession.createDataFrame([(start,)], "id long")
    seen, met, out, n = frontier, None, {}, 0
    while True:
        # An edge is met first from the end that is reached first; between two vertices of one level it is met twice.
        level = adj.join(frontier, "id", "left_semi").join(seen.select(F.col("id").alias("nbr")).join(frontier.select(F.col("id").alias("nbr")), "nbr", "left_anti"), "nbr", "left_anti")
        level = materialise(level.select(F.least("id", "nbr").alias("u"), F.greatest("id", "nbr").alias("v"), "nbr").distinct())
        fresh = level.select("u", "v").distinct()
        n += fresh.count()
        met = fresh if met is None else met.unionByName(fresh)
        out.update({k: met for k in checkpoints if k not in out and n >= k})
        frontier = materialise(level.select(F.col("nbr").alias("id")).distinct().join(seen, "id", "left_anti"))
        if len(out) == len(checkpoints) or not frontier.limit(1).count():
            return {k: out.get(k, met) for k in checkpoints}
        seen = materialise(seen.unionByName(frontier))
        met = materialise(met)
