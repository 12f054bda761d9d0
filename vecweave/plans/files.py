"""Round trips: what a query's tables give is written in the shared folder, read back, and the files are removed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import one_hot
from ..operators import graph as G
from ..session import materialise, remove_path, shared_path
from ..sources import records
from ..sources import text as T
from ..sources.vectors import filled, read_vector_text, read_vectors, write_vectors
from .graphs import E0, PARTS, ctes, ring, table, vertices
from .queries import family_of, labels, parts, query


def file_query(name: str, sql: str):
    """A query of (spark, sf_dir, path) that leaves nothing at ``path``."""

    def put(f):
        @query(name, sql)
        def run(spark, sf_dir):
            path = shared_path(spark, name)
            try:
                return materialise(f(spark, sf_dir, path))
            finally:
                remove_path(spark, path)

        return f

    return put


@file_query("vector_files", "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def vector_files(spark, sf_dir, path):
    v = vertices(spark, sf_dir)
    back = read_vectors(spark, write_vectors(v, path, rows=300), v.count())
    return back.select("id", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@file_query("vector_text_file", "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4))), 6) AS total FROM embeddings")
def vector_text_file(spark, sf_dir, path):
    v = vertices(spark, sf_dir).select("id", F.transform("vec", lambda x: F.round(x.cast("double"), 4)).alias("vec"))
    v.select(F.concat(F.lit('"'), "id", F.lit('": '), F.to_json("vec")).alias("value")).write.text(path)
    return read_vector_text(spark, path).select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@file_query("chunk_merge", "SELECT p_partkey AS id, CASE WHEN vec_id IS NULL THEN 0.0::DOUBLE ELSE round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) END AS total FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def chunk_merge(spark, sf_dir, path):
    """Vectors in chunks, for vertices of which some have none."""
    v = vertices(spark, sf_dir)
    back = read_vectors(spark, write_vectors(v, path, rows=200))
    every = filled(back, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), len(v.first().vec))
    return every.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@file_query("graph_file", E0["ring"])
def graph_file(spark, sf_dir, path):
    T.write_graph(vertices(spark, sf_dir), ring(spark, sf_dir), path)
    return T.read_graph(spark, path, "FAILFAST")[1]


_NBRS = "b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), n AS (SELECT vec_id, coalesce(string_agg(v, ' ' ORDER BY v), '') l FROM embeddings LEFT JOIN b ON u = vec_id GROUP BY vec_id)"


@file_query("adjacency_file", f"WITH e AS ({E0['ring']}), {_NBRS} SELECT l AS line, count(*) AS vertices FROM n GROUP BY l")
def adjacency_file(spark, sf_dir, path):
    T.write_graph(vertices(spark, sf_dir), ring(spark, sf_dir), path, "adjacency")
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("vertices"))


@file_query("csr_file", E0["ring"])
def csr_file(spark, sf_dir, path):
    T.write_csr(vertices(spark, sf_dir), ring(spark, sf_dir), f"{path}/graph.bin")
    return T.read_csr(spark, f"{path}/graph.bin", rows=128)[1]


@file_query("edge_list_file", PARTS)
def edge_list_file(spark, sf_dir, path):
    e = materialise(parts(spark, sf_dir))
    e.select(F.concat_ws("\t", "v", "u").alias("value")).unionByName(spark.range(1).select(F.lit("# ends").alias("value"))).write.option("compression", "gzip").text(path)
    return T.read_edges(spark, path)


@file_query("publication_file", PARTS)
def publication_file(spark, sf_dir, path):
    """Orders stand for publications, their parts for authors."""
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").write.csv(path, sep="\t")
    return G.co_occurrence(T.read_table(spark, path, [("pub", "long"), ("author", "long")]), "pub", "author")


@file_query("zip_file", "SELECT p_partkey AS id, p_name AS name FROM part")
def zip_file(spark, sf_dir, path):
    """A packed CSV of the parts of each size in archives."""
    rows = table(spark, sf_dir, "part").select("p_size", F.to_csv(F.struct("p_partkey", "p_name")).alias("line"))
    members = rows.groupBy("p_size").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text")).select(F.concat(F.lit("raw/"), "p_size", F.lit("/target.csv.gz")).alias("name"), "text")
    T.write_zip(members, path)
    lines = T.read_zip(spark, path, "target.csv.gz").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(F.from_csv("line", "id long, name string").alias("r")).select("r.*")


@file_query("cover_file", ctes("ring", 80) + "SELECT gid AS clique FROM g")
def cover_file(spark, sf_dir, path):
    T.write_cover(family_of(spark, sf_dir)[0], path, "size")
    return T.read_cover(spark, path, "size").select(F.array_join("members", ",").alias("clique"))


@file_query("label_file", "SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings")
def label_file(spark, sf_dir, path):
    labels(spark, sf_dir).select(F.col("id").alias("vertex"), "label", F.concat(F.lit("class "), "label").alias("name")).write.csv(path, header=True)
    return T.read_labels(spark, path)


@file_query("triple_file", "WITH t AS (SELECT DISTINCT p_brand h, p_type t FROM part), n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 id FROM (SELECT h x FROM t UNION SELECT t FROM t)) SELECT DISTINCT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v FROM t JOIN n a ON a.x = h JOIN n b ON b.x = t.t WHERE a.id <> b.id")
def triple_file(spark, sf_dir, path):
    table(spark, sf_dir, "part").select(F.concat_ws("\t", "p_brand", F.lit("is"), "p_type").alias("value")).write.text(path)
    return T.triple_graph(T.read_triples(spark, path))[1]


@file_query("entity_text_file", "WITH t AS (SELECT p_brand id, list_sort(list(DISTINCT replace(p_name, ' ', ':')))[1:5] t FROM part GROUP BY p_brand) SELECT id, array_to_string(list_filter(string_split(array_to_string(t, ':'), ':'), lambda w: trim(w) <> ''), ' ') AS text FROM t")
def entity_text_file(spark, sf_dir, path):
    """Names stand for colon-parted paths of an entity, its brand."""
    table(spark, sf_dir, "part").select(F.concat_ws("\t", "p_brand", F.lit("path"), F.translate("p_name", " ", ":")).alias("value")).write.text(path)
    return T.entity_texts(T.read_triples(spark, path).select(F.col("h").alias("id"), F.col("t").alias("text")))


@file_query("feature_file", "SELECT p_size AS id, CAST(k AS BIGINT) AS k FROM (SELECT DISTINCT p_size, p_partkey % 64 k FROM part)")
def feature_file(spark, sf_dir, path):
    """Positions of each size's parts, from a JSON object, as dense vectors."""
    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.collect_set((F.col("p_partkey") % 64).cast("int")).alias("k"))
    whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("p_size").cast("string"), "k")))).alias("value"))  # one file is one object
    whole.write.text(path)
    dense = T.read_sparse_features(spark, path).select("id", F.posexplode(one_hot(F.col("indices"), 64)).alias("k", "x"))
    return dense.where("x = 1").select("id", "k")


@file_query("log_files", "SELECT o_orderpriority AS name, count(*) AS results, round(sum(o_totalprice), 1) AS total_ms, CAST(o_orderstatus = 'F' AS BIGINT) AS finished, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS customers FROM orders GROUP BY o_orderpriority, o_orderstatus = 'F'")
def log_files(spark, sf_dir, path):
    """A log for each priority, finished or not."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "F").cast("int").alias("finished")).agg(F.count("*").alias("n"), F.format_string("%.1f", F.sum("o_totalprice").cast("double")).alias("ms"), F.countDistinct("o_custkey").alias("c"))
    log = F.concat_ws("\n", F.concat(F.lit("size 2: "), "n"), F.concat(F.lit("STAT customers="), "c"), F.concat(F.lit("TOTAL: "), "n", F.lit(" sets, "), "ms", F.lit(" ms")))
    o.select(F.hex("name").alias("name"), "finished", log.alias("value")).repartition("name", "finished").write.partitionBy("name", "finished").text(path)
    got = records.read_logs(spark, f"{path}/*/*/")
    name = F.unhex(F.regexp_extract("path", "name=([0-9A-F]+)", 1)).cast("string")
    return got.select(name.alias("name"), "results", F.round("total_ms", 1).alias("total_ms"), F.regexp_extract("path", "finished=([01])", 1).cast("long").alias("finished"), F.element_at("stats", "customers").alias("customers"))


@file_query("manifest_file", "SELECT n_nationkey AS dataset, n_name AS name, CAST(n_regionkey AS BIGINT) AS threads FROM nation")
def manifest_file(spark, sf_dir, path):
    runs = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("dataset"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("threads"))).alias("runs"))
    runs.select(F.to_json(F.struct("runs")).alias("value")).write.text(path)
    return records.read_manifest(spark, path).select("dataset", "name", F.col("threads").cast("long"))


@file_query("csv_file", "SELECT l_returnflag AS flag, round(avg(l_quantity), 4) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY l_returnflag")
def csv_file(spark, sf_dir, path):
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_quantity").cast("double").alias("quantity"), F.avg("l_extendedprice").cast("double").alias("price"))
    records.write_csv(means, path, 4)
    return spark.read.csv(path, header=True, schema="flag string, quantity double, price double")


@file_query("file_fingerprints", "SELECT CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation GROUP BY n_regionkey")
def file_fingerprints(spark, sf_dir, path):
    """One file of names for each region."""
    rows = table(spark, sf_dir, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey")
    rows.select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(path)
    return records.fingerprints(spark, f"{path}/*/").select("bytes", "sha256")


@file_query("dataset_catalog", "SELECT 'ring' AS dataset, (SELECT count(*) FROM (" + E0["ring"] + ")) AS edges, (SELECT count(*) FROM embeddings) AS vectors UNION ALL SELECT 'band', (SELECT count(*) FROM (" + E0["band"] + ")), (SELECT count(*) FROM embeddings)")
def dataset_catalog(spark, sf_dir, path):
    """Two graphs over the same vectors, found by the names of a task's dataset."""
    from .graphs import band

    v, out = vertices(spark, sf_dir), None
    index = write_vectors(v, f"{path}/vectors")
    for name, edges in (("ring", ring), ("band", band)):
        T.write_graph(v, edges(spark, sf_dir), f"{path}/{name}")
    catalog = records.Catalog({n: {"graph": f"{path}/{n}", "vectors": index} for n in ("ring", "band")})
    for n in ("ring", "band"):
        task = catalog.resolve({"dataset": n, "vectors": None})
        e = T.read_graph(spark, task["graph"], "FAILFAST")[1].agg(F.lit(n).alias("dataset"), F.count("*").alias("edges"))
        one = e.join(F.broadcast(read_vectors(spark, task["vectors"]).agg(F.count("*").alias("vectors"))))  # one row each
        out = one if out is None else out.unionByName(one)
    return out
