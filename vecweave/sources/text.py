"""Text formats. Lines that begin with # are comments anywhere; fields are parted by any white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import canonical


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def _fields(df: DataFrame) -> DataFrame:
    return df.select("value", F.split("value", r"\s+").alias("f"))


def _number(field: Column) -> Column:
    return field.try_cast("long")


def read_graph(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame]:
    """(vertices(id), raw edges(u, v)) of a file whose first line is "V E".

    Ends outside 0 .. V - 1 are dropped, or raise with FAILFAST. The header's first number is itself no vertex, so the
    header is told from edges by that; loops and repeated edges stay for the audit.
    """
    # Spark reads the largest files first, so the first line is told by file name, place of the block and row in it.
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    whole = spark.read.text(path).select(F.trim("value").alias("value"), at.alias("at")).where("value <> '' and not startswith(value, '#')")
    head = whole.agg(F.min_by("value", "at").alias("value")).first().value
    if head is None or len(head.split()) < 2:
        raise ValueError(f"{path}: no header with the numbers of vertices and edges")
    n = int(head.split()[0])
    lines = _fields(_lines(spark, path))
    rows = lines.select("value", _number(F.get("f", 0)).alias("u"), _number(F.get("f", 1)).alias("v"))
    fine = "u between 0 and {0} and v between 0 and {0}".format(n - 1)
    if mode == "FAILFAST":
        bad = rows.where(f"not coalesce({fine}, false)").where(F.col("value") != head).limit(1).collect()
        if bad:
            raise ValueError(f"{path}: no edge of {n} vertices: {bad[0].value!r}")
    return spark.range(n), rows.where(fine).select("u", "v")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge list with any ids (gzip by name): canonical edges(u, v)."""
    rows = _fields(_lines(spark, path)).select(_number(F.get("f", 0)).alias("u"), _number(F.get("f", 1)).alias("v"))
    return canonical(rows)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(h, r, t) of tab-separated lines with three fields."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) = 3")
    return f.select(*(F.trim(F.get("f", k)).alias(n) for k, n in enumerate(("h", "r", "t"))))


def triple_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names(name, id), edges(u, v)): entities in the order of their names, relations forgotten."""
    from ..operators.graph import compact_ids

    names = triples.select(F.explode(F.array("h", "t")).alias("id")).distinct()
    mapped, _ = compact_ids(names, triples.select(F.col("h").alias("u"), F.col("t").alias("v")).limit(0))
    rows = triples.join(mapped.select(F.col("orig_id").alias("h"), F.col("id").alias("u")), "h").join(mapped.select(F.col("orig_id").alias("t"), F.col("id").alias("v")), "t")
    return mapped.withColumnRenamed("orig_id", "name"), canonical(rows.select("u", "v"))


def entity_texts(paths: DataFrame, limit: int = 5, unknown: str = "unknown entity") -> DataFrame:
    """(id, text): per entity the tokens of its first ``limit`` texts (by text), of colon-parted paths those not beginning with //."""
    some = paths.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("text")), 1, limit).alias("t"))
    tokens = F.flatten(F.transform("t", lambda x: F.filter(F.split(x, ":"), lambda w: ~w.startswith("//") & (F.trim(w) != ""))))
    return some.select("id", F.coalesce(F.nullif(F.array_join(tokens, " "), F.lit("")), F.lit(unknown)).alias("text"))


def read_table(spark: SparkSession, path: str, columns: list[tuple[str, str]], sep: str = "\t", header: bool = False) -> DataFrame:
    """Delimited columns such as (pub, author), (pub, year, title) or (vertex, label, name); rows that don't fit are dropped."""
    schema = ", ".join(f"{n} {t}" for n, t in columns)
    return spark.read.csv(path, sep=sep, header=header, schema=schema, mode="DROPMALFORMED")


def read_labels(spark: SparkSession, path: str, selected: DataFrame | None = None) -> DataFrame:
    """(id, label) of a CSV with the columns vertex, label, name; with ``selected(orig_id, id)`` under the new ids."""
    rows = read_table(spark, path, [("vertex", "long"), ("label", "int"), ("name", "string")], ",", True).select(F.col("vertex").alias("id"), "label")
    return rows if selected is None else rows.join(selected.select(F.col("orig_id"), F.col("id").alias("new")), F.expr("id = orig_id")).select(F.col("new").alias("id"), "label")


def read_sparse_features(spark: SparkSession, path: str) -> DataFrame:
    """(id, indices) of a JSON object from id to a list of positions."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<int>>")).alias("id", "indices"))
    return whole.select(F.col("id").cast("long").alias("id"), "indices")


def read_zip(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(name, text) of the members of zip files whose name ends so; gzip members are unpacked."""
    import pyarrow as pa

    def run(batches):
        import gzip
        import io
        import zipfile

        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if n.endswith(suffix):
                            raw = z.read(n)
                            text = (gzip.decompress(raw) if n.endswith(".gz") else raw).decode()
                            yield pa.RecordBatch.from_pydict({"name": [n], "text": [text]})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, text string")


def read_cover(spark: SparkSession, path: str, form: str = "plain", strict: bool = True) -> DataFrame:
    """groups(gid, members), gid being the sorted members: "v1 v2 ...", "size" with the count first, or "solution" for lines that begin with Sol:.

    With ``strict`` a wrong count, a repeated vertex or a field that is no number raises.
    """
    lines = _lines(spark, path)
    if form == "solution":
        lines = lines.where(F.col("value").startswith("Sol:")).select(F.trim(F.substring("value", 5, 1 << 30)).alias("value"))
    f = _fields(lines).select("value", F.transform("f", lambda x: x.try_cast("long")).alias("f"))
    if form == "size":
        f = f.select("value", F.get("f", 0).alias("k"), F.slice("f", 2, 1 << 30).alias("f"))
    else:
        f = f.withColumn("k", F.size("f").cast("long"))
    bad = F.exists("f", lambda x: x.isNull()) | F.col("k").isNull() | (F.col("k") != F.size("f")) | (F.size(F.array_distinct("f")) != F.size("f"))
    f = f.withColumn("f", F.when(bad, F.raise_error(F.concat(F.lit("bad group: "), "value")).cast("array<bigint>")).otherwise(F.col("f"))) if strict else f.where(~bad)
    # The members name the group, so that a file read anew gives the same gid.
    return f.select(F.array_join(F.array_sort("f").cast("array<string>"), ",").alias("gid"), F.col("f").alias("members"))


def write_cover(found: DataFrame, path: str, form: str = "plain") -> None:
    """One set of ``found(clique)`` to a line, members sorted."""
    text = F.array_join(F.array_sort("clique").cast("array<string>"), " ")
    text = {"plain": text, "size": F.concat_ws(" ", F.size("clique"), text), "solution": F.concat(F.lit("Sol: "), text)}[form]
    found.select(text.alias("value")).write.mode("overwrite").text(path)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, form: str = "native") -> None:
    """native: "V E", then sorted edges. headless: edges only. adjacency: one line of neighbours for each vertex, by id.

    Ids must be 0 .. V - 1 for native and adjacency. Files are in the order of their names.
    """
    from ..operators.graph import both_ways

    if form == "adjacency":
        nbrs = both_ways(edges).groupBy("id").agg(F.array_sort(F.collect_list("nbr")).alias("n"))
        rows = vertices.join(nbrs, "id", "left").select("id", F.coalesce(F.array_join(F.col("n").cast("array<string>"), " "), F.lit("")).alias("value"))
        rows.orderBy("id").select("value").write.mode("overwrite").text(path)
        return
    rows = edges.select(F.lit(1).alias("o"), "u", "v", F.concat_ws(" ", "u", "v").alias("value"))
    if form == "native":
        head = edges.sparkSession.createDataFrame([(0, -1, -1, f"{vertices.count()} {edges.count()}")], "o int, u long, v long, value string")
        rows = rows.unionByName(head)
    rows.orderBy("o", "u", "v").select("value").write.mode("overwrite").text(path)


def write_csr(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Binary: unsigned 32-bit little-endian 4, V, 2 E, all degrees, all neighbour lists.

    Tasks write degrees and lists of a range of ids each; as the format is one file, their bytes are then strung together
    once, a block at a time, by the order of the ranges. Ids must be 0 .. V - 1.
    """
    import struct
    import uuid

    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from ..operators.graph import both_ways
    from ..session import materialise
    from .vectors import open_fs, open_out

    folder = f"{path}.parts-{uuid.uuid4().hex}"
    d = vertices.join(both_ways(edges).groupBy("id").agg(F.array_sort(F.collect_list("nbr")).alias("n")), "id", "left")
    d = d.select("id", F.coalesce("n", F.array().cast("array<long>")).alias("n")).repartitionByRange("id").sortWithinPartitions("id")

    def write(batches):
        part, name, outs = TaskContext.get().partitionId(), uuid.uuid4().hex, None
        for b in batches:
            if outs is None:
                outs = [open_out(f"{folder}/{name}.{k}") for k in ("degrees", "lists")]
            n = b.column(1)
            outs[0].write(np.diff(n.offsets.to_numpy()).astype("<u4").tobytes())
            outs[1].write(n.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        if outs is not None:
            for o in outs:
                o.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name]})

    parts = materialise(d.mapInArrow(write, "part int, name string")).orderBy("part").collect()  # a row for each task
    fs, base = open_fs(folder)
    with open_out(path) as out:
        out.write(struct.pack("<III", 4, vertices.count(), 2 * edges.count()))
        for kind in ("degrees", "lists"):
            for r in parts:
                with fs.open_input_stream(f"{base}/{r.name}.{kind}", compression=None) as f:
                    while block := f.read(4 << 20):
                        out.write(block)
    if parts:
        fs.delete_dir(base)


def read_csr(spark: SparkSession, path: str, rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(vertices(id), edges(u, v)) of a file that write_csr() wrote, read in ranges of ``rows`` vertices.

    A first pass adds up the degrees of each range, so that the second knows where a range's neighbours begin. Raises where
    the length of the file doesn't fit its header, or a list isn't that of an undirected graph's vertex (out of range or
    not rising).
    """
    import struct

    import numpy as np
    import pyarrow as pa

    from ..session import materialise
    from .vectors import open_fs

    fs, base = open_fs(path)
    with fs.open_input_file(base) as f:
        width, n, ends = struct.unpack("<III", f.read(12))
        if width != 4 or f.size() != 12 + 4 * (n + ends):
            raise ValueError(f"{path}: {f.size()} bytes don't hold {n} vertices with {ends} neighbours of {width} bytes")

    def numbers(f, at: int, count: int) -> np.ndarray:
        f.seek(12 + 4 * at)
        return np.frombuffer(f.read(4 * count), "<u4").astype(np.int64)

    def degrees(batches):
        fs, base = open_fs(path)
        for b in batches:
            with fs.open_input_file(base) as f:
                sums = [int(numbers(f, k * rows, min(rows, n - k * rows)).sum()) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.int64())], ["block", "ends"])

    def lists(batches):
        fs, base = open_fs(path)
        for b in batches:
            with fs.open_input_file(base) as f:
                for k, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    d = numbers(f, k * rows, min(rows, n - k * rows))
                    u, v = np.repeat(np.arange(k * rows, k * rows + len(d)), d), numbers(f, n + start, int(d.sum()))
                    if len(v) and (v.max() >= n or ((np.diff(v) <= 0) & (np.diff(u) == 0)).any()):
                        raise ValueError(f"{path}: the lists of vertices from {k * rows} aren't those of a graph")
                    up = u < v
                    yield pa.RecordBatch.from_arrays([pa.array(u[up]), pa.array(v[up])], ["u", "v"])

    count = -(-n // rows)
    blocks = spark.range(0, count, 1, max(1, min(count, 4096))).withColumnRenamed("id", "block")
    sums = materialise(blocks.mapInArrow(degrees, "block long, ends long"))
    # One row for each range.
    starts = sums.selectExpr("block", "coalesce(sum(ends) over (order by block rows between unbounded preceding and 1 preceding), 0L) as start")
    return spark.range(n), starts.repartition(max(1, min(count, 4096)), "block").mapInArrow(lists, "u long, v long")


def write_zip(members: DataFrame, path: str) -> None:
    """Zip archives of members(name, text), one for each task; a name that ends in .gz is packed before it goes in."""
    import pyarrow as pa

    from ..session import materialise
    from .vectors import open_out

    def write(batches):
        import gzip
        import io
        import uuid
        import zipfile

        held, z, n = io.BytesIO(), None, 0
        for b in batches:
            z = z or zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED)
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                z.writestr(name, gzip.compress(raw) if name.endswith(".gz") else raw)
                n += 1
        if z is not None:
            z.close()
            with open_out(f"{path}/{uuid.uuid4().hex}.zip") as out:
                out.write(held.getvalue())
        yield pa.RecordBatch.from_pydict({"n": [n]})

    materialise(members.select("name", "text").mapInArrow(write, "n long"))
