"""Entry points: every query has a stable schema, and SQL of the same columns where it is claimed."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vecweave.plans import queries as plans

DATA = "/root/testdata/sf0.001"
SOME = ("msc_canonical_ring_q80", "mce_ring", "tau_quantiles", "graph_audit", "b_cubed", "multi_grain", "run_summary", "attempts", "search_counters", "nested_graphs", "vector_files", "graph_file", "cover_file", "triple_file", "random_vectors", "missing_tasks", "normalised_similarity")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in "customer part orders lineitem embeddings".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, views, name):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    norm = lambda rows: sorted((tuple(round(float(x), 5) if isinstance(x, float) or hasattr(x, "as_tuple") else x for x in r) for r in rows), key=repr)
    rel = views.sql(plans.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert norm(df.select(*cols).collect()) == norm(rel.project(",".join(f'"{c}"' for c in cols)).fetchall())


def test_registry():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


def test_stream_of_events(spark, tmp_path):
    from vecweave.streaming.sessions import co_activity

    events = spark.read.parquet(f"{DATA}/events.parquet")
    last = events.agg({"ts": "max"}).first()[0]
    want = sorted(tuple(r) for r in co_activity(events).where(F.col("start") + F.expr("interval 10 minutes") <= F.lit(last)).collect())
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = co_activity(stream, late="0 seconds").writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("pairs").collect()) == want and len(want) > 0
