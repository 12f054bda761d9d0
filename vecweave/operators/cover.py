"""Comparison of families of possibly overlapping vertex sets: groups(gid, members)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import PLACES, pair_rows


def projected(groups: DataFrame, universe: DataFrame, min_size: int = 1) -> DataFrame:
    """Groups cut down to the vertices of ``universe(id)``; those left with fewer than ``min_size`` go."""
    rows = groups.select("gid", F.explode("members").alias("id")).join(universe.select("id"), "id", "left_semi")
    return rows.groupBy("gid").agg(F.array_sort(F.collect_set("id")).alias("members")).where(F.size("members") >= min_size)


def _pair_counts(groups: DataFrame, universe: DataFrame, n: str) -> DataFrame:
    """(u, v, n): how many groups hold both, u <= v; a vertex in no group is taken for a group of its own."""
    own = groups.select(F.explode("members").alias("u")).groupBy("u").agg(F.count("*").alias(n)).select("u", F.col("u").alias("v"), n)
    alone = universe.select(F.col("id").alias("u")).join(own.select("u"), "u", "left_anti").select("u", F.col("u").alias("v"), F.lit(1).cast("long").alias(n))
    two = pair_rows(groups).groupBy("u", "v").agg(F.count("*").alias(n))
    return own.unionByName(alone).unionByName(two)


def b_cubed(reference: DataFrame, found: DataFrame, universe: DataFrame) -> DataFrame:
    """(precision, recall, f1) of extended B-cubed over the vertices of ``universe``.

    For vertices a and b (a itself included) the multiplicity of a pair is how many groups hold both. Precision of a
    averages min(found, reference) / found over the b that share a found group with it; recall over reference groups.
    """
    both = _pair_counts(found, universe, "p").join(_pair_counts(reference, universe, "g"), ["u", "v"], "full").na.fill(0, ["p", "g"])
    each = both.select(F.explode(F.when(F.col("u") == F.col("v"), F.array("u")).otherwise(F.array("u", "v"))).alias("id"), "p", "g").join(universe.select("id"), "id", "left_semi")
    low = F.least("p", "g")
    per = each.groupBy("id").agg(F.avg(F.when(F.col("p") > 0, low / F.col("p"))).alias("precision"), F.avg(F.when(F.col("g") > 0, low / F.col("g"))).alias("recall"))
    mean = per.agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return mean.select(F.round("p", PLACES).alias("precision"), F.round("r", PLACES).alias("recall"), F.round(f1, PLACES).alias("f1"))


def overlaps(reference: DataFrame, found: DataFrame) -> DataFrame:
    """(ref, cand, ref_size, cand_size, both) for each two groups that share a vertex; only those meet."""
    a = reference.select(F.col("gid").alias("ref"), F.size("members").alias("ref_size"), F.explode("members").alias("id"))
    b = found.select(F.col("gid").alias("cand"), F.size("members").alias("cand_size"), F.explode("members").alias("id"))
    return a.join(b, "id").groupBy("ref", "cand", "ref_size", "cand_size").agg(F.count("*").alias("both"))


def best_match(reference: DataFrame, found: DataFrame) -> DataFrame:
    """One row: mean best recall, Jaccard and F1 of reference groups, mean best F1 of found ones, their mean, and the
    share of reference groups that lie within a found one. Groups without an overlap count as zero."""
    o = overlaps(reference, found).select(
        "ref", "cand", (F.col("both") / F.col("ref_size")).alias("recall"), (F.col("both") / (F.col("ref_size") + F.col("cand_size") - F.col("both"))).alias("jaccard"),
        (2 * F.col("both") / (F.col("ref_size") + F.col("cand_size"))).alias("f1"), (F.col("both") == F.col("ref_size")).cast("double").alias("intact"),
    )
    names = ("recall", "jaccard", "f1", "intact")
    r = o.groupBy("ref").agg(*(F.max(c).alias(c) for c in names))
    r = reference.select(F.col("gid").alias("ref")).join(r, "ref", "left").na.fill(0.0, list(names)).agg(*(F.avg(c).alias(c) for c in names))
    c = found.select(F.col("gid").alias("cand")).join(o.groupBy("cand").agg(F.max("f1").alias("cand_f1")), "cand", "left").na.fill(0.0, ["cand_f1"]).agg(F.avg("cand_f1").alias("cand_f1"))
    one = r.join(F.broadcast(c))
    return one.select(*(F.round(n, PLACES).alias(f"best_{n}") for n in names[:3]), F.round("cand_f1", PLACES).alias("candidate_f1"), F.round((F.col("f1") + F.col("cand_f1")) / 2, PLACES).alias("symmetric_f1"), F.round("intact", PLACES).alias("intact"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, clique): sets in one family only, repeated ones as often as they are more; members sorted first."""
    x, y = (df.select(F.array_join(F.array_sort("clique"), ",").alias("clique")) for df in (a, b))
    one = x.exceptAll(y).select(F.lit("only_first").alias("side"), "clique")
    return one.unionByName(y.exceptAll(x).select(F.lit("only_second").alias("side"), "clique"))
