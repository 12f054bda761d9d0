import pytest
from pyspark.sql import functions as F

from vecweave.operators import cover as V
from vecweave.operators import quality as Q
from vecweave.operators import runs as R


def groups(spark, *members):
    return spark.createDataFrame([(str(k), list(m)) for k, m in enumerate(members)], "gid string, members array<long>")


def test_labels_and_density(spark):
    g = groups(spark, (1, 2, 3), (3, 4))
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, label int")
    m = {r.gid: r for r in Q.label_measures(g, labels).collect()}
    assert (m["0"].purity, m["0"].agreeing, m["0"].pairs) == (0.666667, 1, 3) and m["1"].purity == 1.0 and m["1"].entropy == 0.0
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (3, 4, 4)], "u long, v long, sim_q long")
    e = {r.gid: r for r in Q.edge_measures(g, edges).collect()}
    assert (e["0"].inside, e["0"].density, e["0"].sum_q) == (2, 0.666667, 6) and e["1"].density == 1.0
    c = {r.gid: r for r in Q.constraint_checks(g, edges, 0.5, 2).collect()}
    assert (c["0"].min_degree, c["0"].is_clique, c["0"].is_quasi_clique, c["0"].is_plex) == (1, False, True, True) and c["1"].is_clique
    assert {r.grain for r in Q.multi_grain(Q.label_measures(g, labels)).collect()} == {"bin", "size", "all"}


def test_validation(spark):
    g = groups(spark, (1, 2), (2, 1), (3, 3), (4, 9))
    got = {r.gid: r.problem for r in Q.validated(g, spark.range(5)).collect()}
    assert got == {"0": "repeated group", "1": "repeated group", "2": "repeated vertex", "3": "unknown vertex"}


def test_lower_median(spark):
    s = spark.createDataFrame([(k,) for k in (2, 2, 3, 9)], "size int")
    r = Q.size_summary(s).first()
    assert (r.median_size, r.mean_size, r.max_size) == (2, 4.0, 9)


def brute_b_cubed(ref, found, universe):
    def mult(gs, a, b):
        n = sum(a in g and b in g for g in gs)
        return n or int(a == b and not any(a in g for g in gs))

    def one(x, y):
        out = []
        for a in universe:
            vals = [min(mult(x, a, b), mult(y, a, b)) / mult(x, a, b) for b in universe if mult(x, a, b)]
            out.append(sum(vals) / len(vals))
        return sum(out) / len(out)

    return round(one(found, ref), 6), round(one(ref, found), 6)


def test_covers(spark):
    ref, found = [(1, 2, 3), (3, 4)], [(1, 2), (2, 3, 4), (2, 3)]
    u = spark.range(1, 6)
    r = V.b_cubed(groups(spark, *ref), groups(spark, *found), u).first()
    assert (r.precision, r.recall) == brute_b_cubed(ref, found, [1, 2, 3, 4, 5])
    b = V.best_match(groups(spark, *ref), groups(spark, *found)).first()
    assert b.intact == 0.5 and b.best_recall == round((2 / 3 + 1) / 2, 6)
    a = spark.createDataFrame([([2, 1],), ([3],)], "clique array<long>")
    c = spark.createDataFrame([([1, 2],), ([4],), ([4],)], "clique array<long>")
    assert sorted(map(tuple, V.differences(a, c).collect())) == [("only_first", "3"), ("only_second", "4"), ("only_second", "4")]
    assert [r.members for r in V.projected(groups(spark, *ref), spark.range(3, 5), 2).collect()] == [[3, 4]]


def test_runs(spark):
    rows = [("a", 1, "completed", 3.0, 1.0, 5, "h"), ("a", 2, "completed", 1.0, 2.0, 5, "h"), ("a", 3, "tle", 9.0, 2.0, 0, ""), ("b", 1, "completed", 2.0, 1.0, 4, "h")]
    runs = spark.createDataFrame(rows, "config string, rep int, status string, seconds double, peak_gib double, results int, histogram string")
    got = {r.config: r for r in R.summary(runs, ["config"]).collect()}
    assert (got["a"].reps, got["a"].median_s, got["a"].max_gib) == (2, 2.0, 2.0)
    bad = runs.withColumn("results", F.col("rep"))
    with pytest.raises(Exception, match="differ"):
        R.summary(bad, ["config"]).collect()
    assert {r.rep for r in R.attempts(runs, ["config"], ["rep"]).where("latest").collect()} == {3, 1}
    grid = R.task_grid(spark, tau=[1, 2, 3], threads=[1, 8])
    plan = R.expand_plan(grid.withColumn("repetitions", F.lit(2)))
    assert plan.count() == 12 and plan.select("task_id").distinct().count() == 12
    s = R.status_of(F.col("code"), F.col("late"), F.col("parsed"), F.col("same"))
    t = spark.createDataFrame([(0, False, True, True), (3, False, True, True), (1, False, True, True), (0, True, True, True), (0, False, False, True), (0, False, True, False)], "code int, late boolean, parsed boolean, same boolean")
    assert [r[0] for r in t.select(s).collect()] == ["completed", "oom", "crash", "tle", "parse_error", "mismatch"]


def test_runs_that_differ_raise(spark):
    from vecweave.operators import runs as R

    rows = [("a", "completed", 1.0, 0.5, 7, "x"), ("a", "completed", 3.0, 0.7, 7, "x"), ("b", "completed", 2.0, 0.1, 8, "x"), ("b", "tle", 9.0, 0.1, 1, "y")]
    d = spark.createDataFrame(rows, "config string, status string, seconds double, peak_gib double, results long, histogram string")
    assert {r.config: (r.reps, r.median_s, r.results) for r in R.summary(d, ["config"]).collect()} == {"a": (2, 2.0, 7), "b": (1, 2.0, 8)}
    for more in (("b", "completed", 2.0, 0.1, 9, "x"), ("b", "completed", 2.0, 0.1, 8, "z")):
        both = d.unionByName(spark.createDataFrame([more], d.schema))
        with pytest.raises(Exception, match="differ in their results"):
            R.summary(both, ["config"]).collect()
        assert R.summary(both, ["config"], strict=False).count() == 2


def test_grid_of_settings_in_a_table(spark):
    from vecweave.operators import runs as R

    t = spark.createDataFrame([("x", 1), ("y", 1), ("x", None)], "a string, b int")
    got = R.task_grid(spark, a=t.select("a"), b=t.select("b"), tau=[0.5, 0.9])
    assert sorted(map(tuple, got.collect())) == [("x", 1, 0.5), ("x", 1, 0.9), ("y", 1, 0.5), ("y", 1, 0.9)]
