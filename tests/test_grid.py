"""Similarities by a grid of colours, against the join."""

import pytest
from pyspark.sql import functions as F

from vecweave.operators import similarity as S
from vecweave.sources.vectors import random_vectors


@pytest.mark.parametrize("unit", [True, False])
def test_a_grid_gives_what_the_join_gives(spark, monkeypatch, unit):
    monkeypatch.setattr(S, "GRID", 16 * 8 * 100)
    v = random_vectors(spark.range(-100, 300), 8)
    e = spark.range(-100, 310).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 9)).alias("v"))
    read = lambda small: sorted(map(tuple, S.sim_edges(e, v, unit, small=small).collect()))
    assert S.colours_of(v) > 1 and read(0) == read(1000) and len(read(0)) > 3000


@pytest.mark.parametrize("odd", ["array(1.0D)", "array(1.0D, null)", "null"])
def test_vectors_that_no_grid_takes(spark, odd):
    v = spark.range(5).select("id", F.expr(f"if(id = 3, {odd}, array(0.6D, 0.8D))").alias("vec"))
    e = spark.createDataFrame([(0, 3), (1, 2)], "u long, v long")
    read = lambda small: sorted(map(tuple, S.sim_edges(e, v, small=small).select("u", "v", "sim_q").collect()))
    assert S.colours_of(v) == 0 and read(0) == read(1000)


def test_many_vectors_do_not_travel_along_edges(spark):
    """Before, each edge took the vector of its first end along."""
    v = spark.range(60_000).select("id", F.array(F.lit(0.6), F.lit(0.8)).alias("vec"))
    plan = S.sim_edges(spark.range(9).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), v)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
