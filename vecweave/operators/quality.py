"""Measures of a family of vertex sets: labels, density, similarity, coverage.

Families are groups(gid, members array<long>); labels(id, label); edges(u, v) or sims(u, v, sim_q) with u < v.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import pairs_of, size_bin, within

PLACES = 6


def validated(groups: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Each group with ``problem``: null, repeated vertex, unknown vertex or repeated group."""
    g = groups.withColumn("sorted", F.array_sort("members"))
    again = g.groupBy("sorted").agg(F.count("*").alias("n"))
    out = g.join(again, "sorted")
    problem = F.when(F.size(F.array_distinct("members")) != F.size("members"), "repeated vertex")
    if vertices is not None:
        known = g.select("gid", F.explode("members").alias("id")).join(vertices.select("id"), "id", "left_anti").select("gid").distinct().withColumn("unknown", F.lit(True))
        out = out.join(known, "gid", "left")
        problem = problem.when(F.col("unknown"), "unknown vertex")
    return out.select("gid", "members", problem.when(F.col("n") > 1, "repeated group").alias("problem"))


def member_labels(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(gid, label, n): how many members of each group have each label."""
    members = groups.select("gid", F.explode("members").alias("id"))
    return members.join(labels.select("id", "label"), "id").groupBy("gid", "label").agg(F.count("*").alias("n"))


def label_measures(groups: DataFrame, labels: DataFrame, entropy_base: Column | None = None) -> DataFrame:
    """(gid, size, labels, purity, entropy, agreeing, pairs, agreement).

    purity: the largest label's share. entropy: of the shares, over the logarithm of ``entropy_base``, which sees
    ``size`` and ``labels`` (default: size); 0 where that is 1 or less. agreeing: pairs with equal labels.
    """
    per = member_labels(groups, labels).groupBy("gid").agg(
        F.sum("n").alias("size"), F.count("*").alias("labels"), F.max("n").alias("top"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.sum(pairs_of(F.col("n"))).alias("agreeing")
    )
    base = F.col("size") if entropy_base is None else entropy_base
    raw = F.log("size") - F.col("n_log_n") / F.col("size")
    pairs = pairs_of(F.col("size"))
    return per.select(
        "gid", "size", "labels", F.round(F.col("top") / F.col("size"), PLACES).alias("purity"), F.when(base > 1, F.round(F.abs(raw / F.log(base)), PLACES)).otherwise(0.0).alias("entropy"),
        "agreeing", pairs.alias("pairs"), F.when(pairs > 0, F.round(F.col("agreeing") / pairs, PLACES)).alias("agreement"),
    )


def pair_rows(groups: DataFrame) -> DataFrame:
    """(gid, u, v) for each two members, u < v."""
    from .graph import pairs_within

    return pairs_within(groups.select("gid", F.array_sort("members").alias("m")), "m", "gid").select("gid", "u", "v")


def pooled_measures(measured: DataFrame) -> DataFrame:
    """(groups, pooled_density, pooled_avg_q, exact_share) of edge_measures() rows: density and similarity weighted by pairs
    of members, and the share of groups of two or more that have all pairs."""
    pairs = pairs_of(F.col("size"))
    ratio = lambda c: F.round(F.sum(c) / F.sum(pairs), PLACES)
    exact = F.round(F.avg((F.col("inside") == pairs).cast("double")), PLACES)
    return measured.where("size >= 2").agg(F.count("*").alias("groups"), ratio("inside").alias("pooled_density"), ratio("sum_q").alias("pooled_avg_q"), exact.alias("exact_share"))


def edge_measures(groups: DataFrame, sims: DataFrame) -> DataFrame:
    """(gid, size, inside, density, sum_q, avg_q): edges inside each group and their similarity."""
    inside = pair_rows(groups).join(sims.select("u", "v", "sim_q"), ["u", "v"]).groupBy("gid").agg(F.count("*").alias("inside"), F.sum("sim_q").alias("sum_q"))
    g = groups.select("gid", F.size("members").cast("long").alias("size")).join(inside, "gid", "left").na.fill(0, ["inside", "sum_q"])
    pairs = pairs_of(F.col("size"))
    ratio = lambda c: F.when(pairs > 0, F.round(F.col(c) / pairs, PLACES))
    return g.select("gid", "size", "inside", ratio("inside").alias("density"), "sum_q", ratio("sum_q").alias("avg_q"))


def constraint_checks(groups: DataFrame, edges: DataFrame, gamma: float = 0.95, k: int = 2) -> DataFrame:
    """(gid, size, min_degree, is_clique, is_quasi_clique, is_plex).

    Inside a group a clique has all pairs, a gamma quasi-clique degrees of at least ceil(gamma (size - 1)), a k-plex
    degrees of at least size - k.
    """
    from .graph import both_ways

    members = groups.select("gid", F.size("members").cast("long").alias("size"), F.explode("members").alias("id"))
    inside = pair_rows(groups).join(edges.select("u", "v"), ["u", "v"]).select("gid", "u", "v")
    d = both_ways(inside, "gid").groupBy("gid", "id").agg(F.count("*").alias("d"))
    low = members.join(d, ["gid", "id"], "left").groupBy("gid", "size").agg(F.min(F.coalesce("d", F.lit(0))).alias("min_degree"))
    return low.select("gid", "size", "min_degree", (F.col("min_degree") == F.col("size") - 1).alias("is_clique"), (F.col("min_degree") >= F.ceil(F.lit(gamma) * (F.col("size") - 1))).alias("is_quasi_clique"), (F.col("min_degree") >= F.col("size") - k).alias("is_plex"))


def coverage(groups: DataFrame, universe: DataFrame) -> DataFrame:
    """(covered, vertices, fraction): distinct vertices in any group."""
    covered = groups.select(F.explode("members").alias("id")).agg(F.countDistinct("id").alias("covered"))
    n = universe.agg(F.countDistinct("id").alias("vertices"))
    return covered.join(F.broadcast(n)).select("covered", "vertices", F.round(F.col("covered") / F.col("vertices"), PLACES).alias("fraction"))


def pure_coverage(groups: DataFrame, labels: DataFrame, cutoffs: tuple[float, ...] = (0.9, 0.95)) -> DataFrame:
    """(cutoff, groups, covered): groups whose purity reaches the cutoff, and the distinct vertices in them."""
    p = label_measures(groups, labels).select("gid", "purity")
    rows = groups.join(p, "gid").select("gid", "purity", F.explode("members").alias("id"))
    by = rows.select("*", F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")).where("purity >= cutoff")
    return by.groupBy("cutoff").agg(F.countDistinct("gid").alias("groups"), F.countDistinct("id").alias("covered"))


def multi_grain(measured: DataFrame) -> DataFrame:
    """(grain, bin, size, groups, mean_purity, pooled_agreement) by size bin, by size and overall, in one pass.

    ``measured`` has size, purity, agreeing and pairs.
    """
    m = measured.withColumn("bin", size_bin(F.col("size")))
    grain = F.when(F.grouping("bin") == 0, "bin").when(F.grouping("size") == 0, "size").otherwise("all")
    sets = m.groupingSets([["bin"], ["size"], []], "bin", "size")
    found = sets.agg(grain.alias("grain"), F.count("*").alias("groups"), F.round(F.avg("purity"), PLACES).alias("mean_purity"), F.round(F.sum("agreeing") / F.sum("pairs"), PLACES).alias("pooled_agreement"))
    return found.select("grain", "bin", "size", "groups", "mean_purity", "pooled_agreement")


def histogram(groups: DataFrame) -> DataFrame:
    """(size, groups, percent)."""
    h = groups.groupBy("size").agg(F.count("*").alias("groups"))
    # One row for each size.
    return h.select("size", "groups", F.round(100.0 * F.col("groups") / F.sum("groups").over(Window.partitionBy()), PLACES).alias("percent"))


def size_summary(groups: DataFrame) -> DataFrame:
    """(groups, mean_size, median_size, max_size); the median is the lower one, from the histogram."""
    h = groups.groupBy("size").agg(F.count("*").alias("n"))
    run = h.withColumn("upto", F.sum("n").over(Window.orderBy("size"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return run.agg(
        F.sum("n").alias("groups"), F.round(F.sum(F.col("n") * F.col("size")) / F.sum("n"), PLACES).alias("mean_size"),
        F.min(F.when(F.col("upto") >= F.expr("(all + 1) div 2"), F.col("size"))).alias("median_size"), F.max("size").alias("max_size"),
    )


def compare_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(count_ratio, mean_size_ratio) of family a over family b."""
    one = lambda df, k: df.agg(F.count("*").alias(f"n{k}"), F.avg("size").alias(f"m{k}"))
    return one(a, 1).join(F.broadcast(one(b, 2))).select(F.round(F.col("n1") / F.col("n2"), PLACES).alias("count_ratio"), F.round(F.col("m1") / F.col("m2"), PLACES).alias("mean_size_ratio"))


def top_by_average(groups: DataFrame, k: int = 20) -> DataFrame:
    """The k groups (clique, size, sum_q) of the largest average similarity, with it in millionths."""
    pairs = pairs_of(F.col("size"))
    named = groups.where("size >= 2").select(F.array_join("clique", ",").alias("clique"), "size", "sum_q", F.round(F.col("sum_q") / pairs, 3).alias("avg_q"))
    return named.orderBy(F.desc("avg_q"), "clique").limit(k)


def averages_by_size(groups: DataFrame) -> DataFrame:
    """(size, groups, min_avg_q, mean_avg_q, max_avg_q)."""
    avg = F.col("sum_q") / pairs_of(F.col("size"))
    rows = groups.where("size >= 2").withColumn("a", avg)
    return rows.groupBy("size").agg(F.count("*").alias("groups"), *(F.round(f("a"), 3).alias(f"{n}_avg_q") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))))


def cases(groups: DataFrame, sims: DataFrame, tau_q: int, pool: int = 2000, top: int = 3) -> DataFrame:
    """(place, clique, size, below): of the ``pool`` largest groups (then by members), the first with a pair below the threshold."""
    pooled = groups.select("clique", "size").orderBy(F.desc("size"), "clique").limit(pool)
    rows = pair_rows(pooled.select(F.col("clique").alias("gid"), F.col("clique").alias("members"))).join(sims.select("u", "v", "sim_q"), ["u", "v"])
    below = rows.groupBy("gid").agg(F.sum((F.col("sim_q") < tau_q).cast("long")).alias("below")).where("below >= 1").select(F.col("gid").alias("clique"), F.size("gid").alias("size"), "below")
    first = below.orderBy(F.desc("size"), "clique").limit(top)
    return first.select(F.row_number().over(Window.orderBy(F.desc("size"), "clique")).alias("place"), F.array_join("clique", ",").alias("clique"), "size", "below")


def fragmentation(one: DataFrame, others: DataFrame) -> DataFrame:
    """(clique, outputs, intersections, largest, induced): for each set of ``one(clique)`` the sets of ``others(clique)``
    that meet it, the different intersections, the largest of these, and how many of them no other contains.

    Where ``others`` are the maximal cliques of a graph, the last are the maximal cliques of the graph induced on the set.
    """
    a = one.select("clique", F.explode("clique").alias("v"))
    b = others.select(F.col("clique").alias("other"), F.explode("clique").alias("v"))
    met = a.join(b, "v").groupBy("clique", "other").agg(F.array_sort(F.collect_list("v")).alias("both"))
    met = met.groupBy("clique", "both").agg(F.count("*").alias("n"))
    # One that contains another holds its first member.
    member = met.select("clique", F.col("both").alias("wide"), F.explode("both").alias("v"))
    met = met.withColumn("v", F.col("both")[0])
    inner = (F.size("wide") > F.size("both")) & within(F.col("both"), F.col("wide"))
    kept = met.alias("m").join(member.alias("w"), (F.col("m.clique") == F.col("w.clique")) & (F.col("m.v") == F.col("w.v")) & inner, "left_anti").groupBy("clique").agg(F.count("*").alias("induced"))
    found = met.groupBy("clique").agg(F.sum("n").alias("outputs"), F.count("*").alias("intersections"), F.max(F.size("both")).alias("largest"))
    return one.select("clique").join(found, "clique", "left").join(kept, "clique", "left").na.fill(0, ["outputs", "intersections", "largest", "induced"])
