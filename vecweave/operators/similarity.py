"""Similarities on edges, thresholds from their quantiles, and graphs of similar pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, normalised, units
from ..session import BROADCAST_ROWS, materialise, side
from .blocks import block_column
from .triples import packed, unsqueezed

PERCENTILES = (1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 97, 99)


#: Bytes of the vectors that a task of a grid holds.
GRID = 96 << 20


def sim_edges(edges: DataFrame, vectors: DataFrame, unit: bool = True, policy: str = "fixed6", small: int = BROADCAST_ROWS) -> DataFrame:
    """(u, v, sim, sim_q) for each edge of which both ends have a vector(id, vec).

    Similarities are computed on edges only. ``unit`` says that vectors have unit length already. policy: fixed6 (the
    product rounded to millionths, as sim_q), float32 (sim cast to float first) or double. Vectors of up to ``small`` rows
    are broadcast; more are dealt by a grid (edges with the smaller end first).
    """
    v = vectors.select("id", "vec" if unit else normalised(F.col("vec")).alias("vec"))
    n = v.limit(small + 1).count()
    if n > small and (p := colours_of(v)):
        value = gridded(edges, v, p)
    else:
        a, b = v.select(F.col("id").alias("u"), F.col("vec").alias("x")), v.select(F.col("id").alias("v"), F.col("vec").alias("y"))
        value = edges.join(side(a, n <= small), "u").join(side(b, n <= small), "v").select("u", "v", dot(F.col("x"), F.col("y")).alias("sim"))
    if policy == "float32":
        value = value.withColumn("sim", F.col("sim").cast("float").cast("double"))
    return value.withColumn("sim_q", units(F.col("sim")))


def colours_of(v: DataFrame) -> int:
    """How many colours vectors must have for two of them to be GRID bytes; 0 where ids repeat, components are missing or
    lengths differ, which only the join takes."""
    whole = F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    r = v.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min(whole).alias("whole"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    return -(-16 * r.n * r.most // GRID) if r.whole and r.n == r.ids and r.least == r.most > 0 else 0


def gridded(edges: DataFrame, v: DataFrame, p: int) -> DataFrame:
    """(u, v, sim) by a grid of vertex colours: a task has the vectors of two colours and the edges between them, packed, so
    a vector goes to p tasks instead of along its edges. Products are summed in order, as by dot()."""

    def pack(batches):
        for b in batches:
            if len(b):
                ids, vec = b.column("id").to_numpy(), b.column("vec")
                x = vec.flatten().to_numpy().reshape(len(b), -1)
                cols = [b.column("i"), pa.array([len(b)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([cols[0].slice(0, 1), *cols[1:]], ["i", "n", "u", "s"])

    def of_colour(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(pack([t.combine_chunks().to_batches()[0]])))

    def products(t: pa.Table) -> pa.Table:
        vectors, rows = t.filter(t.column("v").is_null()), t.filter(t.column("v").is_valid())
        if not len(rows) or not len(vectors):
            return pa.table({k: pa.array([], x) for k, x in (("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64()))})
        ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in vectors.column("u")])
        order = np.argsort(ids)
        ids = ids[order]
        x = np.concatenate([np.frombuffer(c.as_buffer(), np.float64).reshape(n, -1) for c, n in zip(vectors.column("s"), vectors.column("n").to_pylist(), strict=True)])
        x = [np.ascontiguousarray(c[order]) for c in x.T]
        out = []
        for n, u, v in zip(rows.column("n").to_pylist(), rows.column("u"), rows.column("v"), strict=True):
            u, v = np.cumsum(unsqueezed(u, n)), unsqueezed(v, n)
            a, b = (np.minimum(np.searchsorted(ids, e), len(ids) - 1) for e in (u, v))
            have = np.flatnonzero((ids[a] == u) & (ids[b] == v))
            a, b, sim = a[have], b[have], np.zeros(len(have))
            for c in x:
                sim += c[a] * c[b]
            out.append(pa.table({"u": np.minimum(u, v)[have], "v": np.maximum(u, v)[have], "sim": sim}))
        return pa.concat_tables(out)

    blobs = v.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), block_column("id", p).alias("i"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("part"))
    blobs = blobs.groupBy("i", "part").applyInArrow(of_colour, "i int, n int, u binary, s binary")
    cells = F.explode(F.expr(f"transform(sequence(0, {p - 1}), x -> least(i, x) * {p} + greatest(i, x))")).alias("cell")
    every = blobs.select(cells, "n", "u", F.lit(None).cast("binary").alias("v"), "s").unionByName(packed(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), p).select(F.expr(f"i * {p} + j").alias("cell"), "n", "u", "v", "s"))
    return every.repartition(p * (p + 1) // 2, "cell").groupBy("cell").applyInArrow(products, "u long, v long, sim double")


def cosine_edges(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(u, v, sim) by the scalar definition: -1 for unequal lengths, 0 for a vector without length."""
    v = vectors.select("id", "vec")
    return edges.join(v.select(F.col("id").alias("u"), F.col("vec").alias("x")), "u").join(v.select(F.col("id").alias("v"), F.col("vec").alias("y")), "v").select("u", "v", cosine(F.col("x"), F.col("y")).alias("sim"))


def ranked(values: DataFrame, column: str, wanted: dict[str, str]) -> DataFrame:
    """(name, value): the value at each zero-based rank, given as SQL of the count ``n``.

    Equal values are counted first and ranks are running sums of counts by range, so sorting takes distinct values only.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    dealt = counts.repartitionByRange("value").withColumn("p", F.spark_partition_id())
    dealt = materialise(dealt)
    sizes = dealt.groupBy("p").agg(F.sum("c").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("n").over(Window.partitionBy()))
    running = F.sum("c").over(Window.partitionBy("p").orderBy("value"))
    held = dealt.withColumn("upto", running).join(F.broadcast(before), "p").withColumn("upto", F.col("upto") + F.col("before"))
    asked = F.array(*(F.struct(F.lit(k).alias("name"), F.expr(e).cast("long").alias("at")) for k, e in wanted.items()))
    hit = F.filter(asked, lambda a: (a["at"] < F.col("upto")) & (a["at"] >= F.col("upto") - F.col("c")))
    return held.select(F.explode(hit).alias("a"), "value").select("a.name", "value")


def tau_quantiles(sims: DataFrame, percentiles: tuple[int, ...] = PERCENTILES, column: str = "sim_q") -> DataFrame:
    """(p, tau): the value at rank floor(p / 100 * (n - 1)) of the edge similarities."""
    found = ranked(sims, column, {str(p): f"floor({p} * (n - 1) / 100.0)" for p in percentiles})
    return found.select(F.col("name").cast("int").alias("p"), F.col("value").alias("tau"))


def tau_summary(sims: DataFrame, column: str = "sim") -> DataFrame:
    """min, max, mean and upper median (rank n div 2) of the edge similarities, to six places."""
    mid = ranked(sims, column, {"m": "n div 2"}).select(F.col("value").alias("median"))
    rest = sims.agg(F.count(column).alias("edges"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"))
    return rest.join(F.broadcast(mid)).select("edges", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median")))


def tau_value(sims: DataFrame, percentile: float, column: str = "sim_q") -> int | None:
    """The threshold as a number for the driver, to plan with."""
    row = ranked(sims, column, {"tau": f"floor({percentile} * (n - 1) / 100.0)"}).first()
    return None if row is None else row.value


def pairsim(sims: DataFrame, tau_q: int) -> DataFrame:
    """The edges that reach the threshold; all vertices stay, so some become isolated."""
    return sims.where(F.col("sim_q") >= tau_q)


def vertex_best(sims: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, best): each vertex's largest similarity, zero at least."""
    from .graph import both_ways

    best = both_ways(sims, "sim_q").groupBy("id").agg(F.max("sim_q").alias("best"))
    return vertices.select("id").join(best, "id", "left").select("id", F.greatest(F.lit(0), F.coalesce("best", F.lit(0))).alias("best"))


def nearest_quantile(taus: DataFrame, wanted: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(tau, p): for each wanted tau(tau) the percentile of taus(p, tau) nearest to it, null beyond the tolerance.

    ``taus`` is a table of a few percentiles and is gathered into one array.
    """
    table = taus.agg(F.collect_list(F.struct("tau", "p")).alias("t"))
    near = F.array_min(F.transform("t", lambda x: F.struct(F.abs(x["tau"] - F.col("tau")).alias("d"), x["p"].alias("p"))))
    return wanted.join(F.broadcast(table)).select("tau", near.alias("n")).select("tau", F.when(F.col("n.d") <= tolerance, F.col("n.p")).alias("p"))

