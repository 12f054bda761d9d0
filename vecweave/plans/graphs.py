"""Graphs over the test tables: vertices are embeddings (or parts), edges follow from ids, labels or orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import pairs_within
from ..operators.similarity import sim_edges

RING, BAND = 6, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def near(v: DataFrame, gap: int, same_label: bool) -> DataFrame:
    """Edges between ids at most ``gap`` apart: every id meets the ``gap`` next ones by equality."""
    nxt = v.select(F.col("id").alias("u"), F.col("label").alias("lu"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + gap)).alias("v"))
    e = nxt.join(v.select(F.col("id").alias("v"), F.col("label").alias("lv")), "v")
    return (e.where("lu = lv") if same_label else e).select("u", "v")


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(vertices(spark, sf_dir), RING, False)


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same label, at most BAND apart: overlapping hosts."""
    return near(vertices(spark, sf_dir), BAND, True)


def thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of ids that leave the same remainder by three: three hosts of a third of the vertices each."""
    ids = vertices(spark, sf_dir).select("id", (F.col("id") % 3).alias("k"))
    groups = ids.groupBy("k").agg(F.collect_list("id").alias("items"))
    # Three rows of ids go to all tasks, as else a task or two make all pairs.
    dealt = ids.repartition(4 * spark.sparkContext.defaultParallelism, "id").join(F.broadcast(groups), "k")
    return dealt.select(F.col("id").alias("u"), F.explode(F.expr("filter(items, x -> x > id)")).alias("v"))


def sims(spark: SparkSession, sf_dir: str, graph: str = "ring") -> DataFrame:
    edges = {"ring": ring, "band": band, "thirds": thirds}[graph](spark, sf_dir)
    return sim_edges(edges, vertices(spark, sf_dir)).select("u", "v", "sim", "sim_q")


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v) of parts for each two lines of an order, loops and repeats included; an order has a few lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return pairs_within(lines, "x").select(F.col("u.l_partkey").alias("u"), F.col("v.l_partkey").alias("v"))


#: The same in SQL.
E0 = {
    "ring": f"SELECT a.vec_id u, b.vec_id v FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= {RING}",
    "band": f"SELECT a.vec_id u, b.vec_id v FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= {BAND} AND a.label = b.label",
    "thirds": "SELECT a.vec_id u, b.vec_id v FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND a.vec_id % 3 = b.vec_id % 3",
}
RAW_PARTS = (
    "SELECT a.l_partkey u, b.l_partkey v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) r FROM lineitem) a "
    "JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) r FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.r < b.r"
)
PARTS = "SELECT DISTINCT least(a.l_partkey, b.l_partkey) u, greatest(a.l_partkey, b.l_partkey) v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey"


def ctes(graph: str, q: float | None = None) -> str:
    """SQL: e (edges with s), tau, st (all cliques), f (feasible), msc, mce; families have c (list), s, k."""
    tau = q if q is not None else 80
    return f"""WITH RECURSIVE e0 AS MATERIALIZED ({E0[graph]}),
d AS MATERIALIZED (SELECT u, v, list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) sim
  FROM e0 JOIN embeddings a ON a.vec_id = u JOIN embeddings b ON b.vec_id = v),
e AS MATERIALIZED (SELECT u, v, sim, CAST(round(sim * 1000000) AS BIGINT) s FROM d),
tau AS MATERIALIZED (SELECT s t FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 rn, count(*) OVER () n FROM e) WHERE rn = CAST(floor({tau} * (n - 1) / 100.0) AS BIGINT)),
st(c, s, k) AS (SELECT [u, v], s, 2 FROM e UNION ALL
  SELECT list_append(y.c, y.v), CAST(y.s + y.d AS BIGINT), y.k + 1 FROM (
    SELECT st.c, st.s, st.k, n.v, sum(n.s) d FROM st, LATERAL (SELECT unnest(st.c) m) t JOIN e n ON n.u = t.m
    WHERE n.v > st.c[-1] GROUP BY ALL HAVING count(*) = st.k) y),
f AS MATERIALIZED (SELECT c, s, k FROM st, tau WHERE 2 * s >= t * k * (k - 1)),
m AS MATERIALIZED (SELECT c, k, unnest(c) v FROM f),
msc AS MATERIALIZED (SELECT c, s, k FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.v = f.c[1] AND m.k > f.k AND list_has_all(m.c, f.c))),
b AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
ext AS MATERIALIZED (SELECT DISTINCT c FROM (SELECT st.c, st.k, b.v FROM st, LATERAL (SELECT unnest(st.c) m) t JOIN b ON b.u = t.m GROUP BY ALL HAVING count(*) = st.k)),
mce AS MATERIALIZED (SELECT st.c, st.s, st.k FROM st WHERE NOT EXISTS (SELECT 1 FROM ext WHERE ext.c = st.c)),
g AS (SELECT array_to_string(c, ',') gid, c, s, CAST(k AS BIGINT) k FROM msc)
"""


FAMILY = "SELECT array_to_string(c, ',') AS clique, CAST(k AS BIGINT) AS size, CAST(s AS BIGINT) AS sum_q FROM {}"
