import numpy as np

from vecweave.api import VectorGraph
from vecweave.sources import vectors


def test_from_files_to_sets(spark, tmp_path):
    (tmp_path / "g.txt").write_text("5 6\n0 1\n1 2\n0 2\n2 3\n3 4\n2 4\n")
    x = np.array([[1.0, 0], [1, 0.1], [0.9, 0.2], [0, 1], [0.1, 1]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    g = VectorGraph.load(spark, str(tmp_path / "g.txt"), vectors.write_vectors(df, str(tmp_path / "v")))
    assert g.audit().first().edges == 6 and g.structural().count() == 2
    assert {tuple(r.clique) for r in g.msc(0.95).collect()} == {(0, 1, 2), (3, 4)}
    assert g.tau(99) > 0.9 and {tuple(r.clique) for r in g.pairsim(0.99).collect()} >= {(3, 4)}
    found, counts = g.counted(0.95)
    assert {tuple(r.clique) for r in found.collect()} == {(0, 1, 2), (3, 4)} and counts["states"] > 0
    assert g.msc(0.95, seconds=300).count() == 2 and max(r.core for r in g.order().collect()) == 2
