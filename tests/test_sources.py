import gzip
import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecweave.sources import records, text, vectors


def test_graph_text(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("# c\n4 4\n0 1\n1\t2\n# x\n0 2\n2 3\n3 9\n")
    v, e = text.read_graph(spark, str(p))
    assert v.count() == 4 and sorted(map(tuple, e.collect())) == [(0, 1), (0, 2), (1, 2), (2, 3)]
    with pytest.raises(ValueError):
        text.read_graph(spark, str(p), "FAILFAST")
    for form in ("native", "headless", "adjacency"):
        text.write_graph(v, e, str(tmp_path / form), form)
    lines = lambda form: "".join(p.read_text() for p in sorted((tmp_path / form).glob("part-*"))).splitlines()
    assert lines("native") == ["4 4", "0 1", "0 2", "1 2", "2 3"]
    assert lines("adjacency") == ["1 2", "0 2", "0 1 3", "2"]
    text.write_csr(v, e, str(tmp_path / "csr/g.bin"))
    raw = (tmp_path / "csr/g.bin").read_bytes()
    assert struct.unpack("<15I", raw) == (4, 4, 8, 2, 2, 3, 1, 1, 2, 0, 2, 0, 1, 3, 2)


def test_edge_list_and_triples(spark, tmp_path):
    with gzip.open(tmp_path / "e.gz", "wt") as f:
        f.write("# n\n5 3\n3 5\n5 5\n7 3\n")
    assert sorted(map(tuple, text.read_edges(spark, str(tmp_path / "e.gz")).collect())) == [(3, 5), (3, 7)]
    (tmp_path / "t.tsv").write_text("b\tr\ta\na\tr\tc\nbad line\n")
    names, edges = text.triple_graph(text.read_triples(spark, str(tmp_path / "t.tsv")))
    assert {r.name: r.id for r in names.collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (0, 2)]
    t = spark.createDataFrame([(1, "//x:red:fox"), (1, "a"), (2, "//y")], "id long, text string")
    assert {r.id: r.text for r in text.entity_texts(t).collect()} == {1: "red fox a", 2: "unknown entity"}


def test_covers(spark, tmp_path):
    found = spark.createDataFrame([([2, 1],), ([3, 4, 5],)], "clique array<long>")
    for form in ("plain", "size", "solution"):
        text.write_cover(found, str(tmp_path / form), form)
        got = text.read_cover(spark, str(tmp_path / form), form)
        assert sorted(r.members for r in got.collect()) == [[1, 2], [3, 4, 5]]
    (tmp_path / "bad").write_text("3 1 2\n2 7 7\n1 4\n")
    with pytest.raises(Exception, match="bad group"):
        text.read_cover(spark, str(tmp_path / "bad"), "size").collect()
    assert [r.members for r in text.read_cover(spark, str(tmp_path / "bad"), "size", strict=False).collect()] == [[4]]


def test_vectors(spark, tmp_path):
    x = np.arange(12.0).reshape(6, 2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    index = vectors.write_vectors(df, str(tmp_path / "v"))
    got = vectors.read_vectors(spark, index, 6).orderBy("id").collect()
    assert [r.vec for r in got] == x.tolist()
    assert [c[1:3] for c in vectors.chunks(vectors.write_vectors(df, str(tmp_path / "w"), 4))] == [(0, 4), (4, 2)]
    with pytest.raises(ValueError):
        vectors.read_vectors(spark, index, 7)
    (tmp_path / "one.bin").write_bytes(struct.pack("<ii", 6, 2) + x.tobytes())
    assert spark.read.format("vecbin").option("rows", 4).load(str(tmp_path / "one.bin")).orderBy("id").collect() == got
    (tmp_path / "cut.bin").write_bytes(struct.pack("<ii", 6, 2) + x.tobytes()[:-8])
    with pytest.raises(ValueError):
        vectors.read_vectors(spark, str(tmp_path / "cut.bin"))
    (tmp_path / "v.json").write_text('{\n"0": [1, 2.5],\n"7": [3, 4]\n}\n')
    assert [tuple(r) for r in vectors.read_vector_text(spark, str(tmp_path / "v.json"), 5).collect()] == [(0, [1.0, 2.5])]
    assert vectors.filled(df.where("id < 2"), spark.range(3), 2).orderBy("id").collect()[2].vec == [0.0, 0.0]
    r = vectors.random_vectors(spark.range(5), 8)
    assert r.collect() == vectors.random_vectors(spark.range(5).repartition(3), 8).orderBy("id").collect()
    assert r.where(F.exists("vec", lambda v: (v < -1) | (v >= 1))).count() == 0
    t = spark.createDataFrame([(1, "red red fox"), (2, None)], "id long, text string")
    assert {r.id: round(sum(v * v for v in r.vec), 6) for r in vectors.text_vectors(t, 16).collect()} == {1: 1.0, 2: 0.0}
    assert vectors.text_vectors(t, encoder=lambda s: [[float(len(x))] for x in s]).orderBy("id").collect()[0].vec == [11.0]


def test_zip_labels_and_features(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("x/target.csv", "id,name\n1,a\n")
        z.writestr("x/edge.csv.gz", gzip.compress(b"1,2\n"))
    (tmp_path / "a.zip").write_bytes(b.getvalue())
    assert text.read_zip(spark, str(tmp_path / "a.zip"), "edge.csv.gz").first().text == "1,2\n"
    (tmp_path / "l.csv").write_text("vertex,label,name\n0,3,x\n2,1,y\n")
    assert sorted(map(tuple, text.read_labels(spark, str(tmp_path / "l.csv")).collect())) == [(0, 3), (2, 1)]
    (tmp_path / "f.json").write_text(json.dumps({"0": [1, 3], "1": []}))
    assert {r.id: r.indices for r in text.read_sparse_features(spark, str(tmp_path / "f.json")).collect()} == {0: [1, 3], 1: []}


def test_records(spark, tmp_path):
    (tmp_path / "r.log").write_text("size 2: 10\nsize 3: 4\nSTAT states=25\nTOTAL: 14 cliques, 12.5 ms\nPeak memory: 0.39 GiB\n")
    r = records.read_logs(spark, str(tmp_path / "r.log")).first()
    assert (r.results, r.total_ms, r.peak_gib, r.histogram, r.stats) == (14, 12.5, 0.39, {2: 10, 3: 4}, {"states": 25.0})
    (tmp_path / "m.json").write_text(json.dumps({"name": "x", "runs": [{"a": 1}, {"a": 2}]}, indent=1))
    assert [x.a for x in records.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [1, 2]
    f = records.fingerprints(spark, str(tmp_path / "m.json")).first()
    assert len(f.sha256) == 64
    c = records.Catalog({"1": {"graph": "g", "vectors": "v"}})
    assert c.resolve({"dataset": 1, "vectors": "w"})["vectors"] == "w"
    with pytest.raises(KeyError):
        c["9"]
    records.write_csv(spark.createDataFrame([(1, 1 / 3)], "a long, b double"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().b == "0.333333"


def test_csr_in_ranges(spark, tmp_path):
    edges = spark.createDataFrame([(0, 3), (1, 3), (0, 1), (3, 6), (5, 6)], "u long, v long")
    p = str(tmp_path / "c" / "g.bin")
    text.write_csr(spark.range(8), edges, p)
    for rows in (1, 3, 100):
        v, e = text.read_csr(spark, p, rows)
        assert v.count() == 8 and sorted(map(tuple, e.collect())) == [(0, 1), (0, 3), (1, 3), (3, 6), (5, 6)]
    text.write_csr(spark.range(0), edges.limit(0), p + "0")
    assert [x.count() for x in text.read_csr(spark, p + "0")] == [0, 0]
    (tmp_path / "bad.bin").write_bytes(struct.pack("<7I", 4, 2, 2, 1, 1, 9, 0))
    with pytest.raises(Exception, match="aren't those of a graph"):
        text.read_csr(spark, str(tmp_path / "bad.bin"))[1].collect()
    (tmp_path / "cut.bin").write_bytes(struct.pack("<6I", 4, 2, 2, 1, 1, 1))
    with pytest.raises(ValueError, match="don't hold"):
        text.read_csr(spark, str(tmp_path / "cut.bin"))


def test_archives(spark, tmp_path):
    rows = [(f"d/{k}.csv" + (".gz" if k % 2 else ""), f"line {k}\n" * k) for k in range(6)]
    text.write_zip(spark.createDataFrame(rows, "name string, text string").repartition(3), str(tmp_path / "z"))
    got = [tuple(r) for s in (".csv", ".gz") for r in text.read_zip(spark, str(tmp_path / "z"), s).collect()]
    assert sorted(got) == sorted(rows)


def test_dense_vectors(spark):
    from vecweave.functions.vectors import one_hot

    rows = [([3, 0, 3],), ([],), (None,), ([4],), ([9, -1, 2],)]
    got = [r.x for r in spark.createDataFrame(rows, "k array<int>").select(one_hot(F.col("k"), 5).alias("x")).collect()]
    assert got == [[1, 0, 0, 1, 0], [0] * 5, [0] * 5, [0, 0, 0, 0, 1], [0, 0, 1, 0, 0]]


def test_header_is_in_the_first_file_by_name(spark, tmp_path):
    """Spark reads the largest file first; the header is in the first one by name."""
    (tmp_path / "part-00000.txt").write_text("# graph\n9 5\n0 1\n")
    (tmp_path / "part-00001.txt").write_text("".join(f"{k} {k + 1}\n" for k in range(3, 8)))
    vertices, edges = text.read_graph(spark, str(tmp_path), "FAILFAST")
    assert vertices.count() == 9 and sorted(map(tuple, edges.collect())) == [(0, 1), *((k, k + 1) for k in range(3, 8))]
