"""Vector files: binary (int32 V, int32 dim, V * dim float64, little-endian, by row), chunk indexes, text.

The data source "vecbin" reads a binary file or a chunk index in ranges of rows and writes binary files with an index.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS = 100_000


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def open_out(path: str):
    fs, p = open_fs(path)
    fs.create_dir(posixpath.dirname(p) or ".", recursive=True)
    return fs.open_output_stream(p, compression=None)


def header(path: str) -> tuple[int, int]:
    """(rows, dim) of a binary file; raises if its length doesn't fit."""
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        head = f.read(8)
        if len(head) < 8:
            raise ValueError(f"{path}: no header")
        n, dim = struct.unpack("<ii", head)
        if n < 0 or dim <= 0 or f.size() != 8 + 8 * n * dim:
            raise ValueError(f"{path}: {f.size()} bytes don't hold {n} vectors of {dim}")
    return n, dim


def chunks(path: str) -> list[tuple[str, int, int, int]]:
    """(file, first id, rows, dim) of a binary file, or of each file an index names; paths are from the index's folder."""
    if not path.endswith(".index"):
        return [(path, 0, *header(path))]
    fs, p = open_fs(path)
    with fs.open_input_stream(p, compression=None) as f:
        lines = [x.strip() for x in f.read().decode().splitlines() if x.strip()]
    n, dim = map(int, lines[0].split())
    out, at = [], 0
    for name in lines[1:]:
        file = name if name.startswith("/") or "://" in name else posixpath.join(posixpath.dirname(path), name)
        rows, d = header(file)
        if d != dim:
            raise ValueError(f"{file}: dimension {d}, the index says {dim}")
        out.append((file, at, rows, dim))
        at += rows
    if at != n:
        raise ValueError(f"{path}: chunks hold {at} vectors, the index says {n}")
    return out


class Rows(InputPartition):
    def __init__(self, file: str, first: int, skip: int, rows: int, dim: int):
        self.file, self.first, self.skip, self.rows, self.dim = file, first, skip, rows, dim


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        return [Rows(file, first + k, k, min(self.rows, n - k), dim) for file, first, n, dim in chunks(self.path) for k in range(0, n, self.rows)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        fs, p = open_fs(part.file)
        step = max(1, (4 << 20) // (8 * part.dim))
        with fs.open_input_file(p) as f:
            f.seek(8 + 8 * part.dim * part.skip)
            for k in range(0, part.rows, step):
                n = min(step, part.rows - k)
                values = np.frombuffer(f.read(8 * n * part.dim), "<f8")
                if len(values) != n * part.dim:
                    raise ValueError(f"{part.file} is cut short")
                ids = np.arange(part.first + k, part.first + k + n)
                vec = pa.ListArray.from_arrays(np.arange(0, n * part.dim + 1, part.dim, dtype=np.int32), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(ids), vec], ["id", "vec"])


class Message(WriterCommitMessage):
    def __init__(self, part: int, file: str, rows: int, dim: int):
        self.part, self.file, self.rows, self.dim = part, file, rows, dim


class Writer(DataSourceArrowWriter):
    """One file for each task, in the order of tasks; only files of committed tasks are in the index."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, name, out, n, dim = TaskContext.get().partitionId(), "", None, 0, 0
        fs, folder = open_fs(self.path)
        blocks: list[int] = []
        for b in batches:
            vec = b.column(1)
            sizes = np.diff(vec.offsets.to_numpy())
            if not len(sizes):
                continue
            dim = dim or int(sizes[0])
            if vec.null_count or (sizes != dim).any():
                raise ValueError("vectors of different length")
            if out is None:
                fs.create_dir(folder, recursive=True)
                name = f"chunk-{part:06d}-{uuid.uuid4().hex}.bin"
                out = fs.open_output_stream(f"{folder}/{name}.rows", compression=None)
            out.write(vec.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
            blocks.append(len(b))
        n = sum(blocks)
        if out is not None:
            out.close()
            # The header holds the count, which is known only now.
            with fs.open_input_stream(f"{folder}/{name}.rows", compression=None) as rows, fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(struct.pack("<ii", n, dim))
                while piece := rows.read(1 << 22):
                    f.write(piece)
            fs.delete_file(f"{folder}/{name}.rows")
        return Message(part, name, n, dim)

    def commit(self, messages: list[Message | None]) -> None:
        done = sorted((m for m in messages if m and m.rows), key=lambda m: m.part)
        if len({m.dim for m in done}) > 1:
            raise ValueError("vectors of different length")
        with open_out(f"{self.path}/vectors.index") as out:
            out.write("\n".join([f"{sum(m.rows for m in done)} {done[0].dim if done else 1}", *(m.file for m in done)]).encode() + b"\n")


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        return "id long, vec array<double>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options)


def read_vectors(spark: SparkSession, path: str, vertices: int | None = None) -> DataFrame:
    """(id, vec) of a binary file or an .index; raises if ``vertices`` is given and isn't the number of vectors."""
    spark.dataSource.register(VectorSource)
    n = sum(c[2] for c in chunks(path))
    if vertices is not None and n != vertices:
        raise ValueError(f"{path}: {n} vectors for {vertices} vertices")
    return spark.read.format("vecbin").load(path)


def write_vectors(vectors: DataFrame, path: str, rows: int | None = None) -> str:
    """Write (id, vec) in the order of id, ids being 0 .. V - 1; returns the index's path.

    With ``rows`` each chunk holds so many vectors, the last one fewer; else chunks follow the size of the data.
    """
    vectors.sparkSession.dataSource.register(VectorSource)
    own = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    if rows is None:
        dealt = own.repartitionByRange("id")
    else:
        dealt = own.repartitionById(max(1, -(-own.count() // rows)), F.expr(f"cast(id div {rows} as int)"))
    dealt.sortWithinPartitions("id").write.format("vecbin").mode("append").save(path)
    return f"{path}/vectors.index"


def read_vector_text(spark: SparkSession, path: str, vertices: int | None = None) -> DataFrame:
    """(id, vec) of lines such as "3": [0.1, 0.2]; ids outside 0 .. vertices - 1 are left out."""
    line = spark.read.text(path).select(F.regexp_extract("value", r'"\s*(\d+)\s*"\s*:', 1).alias("k"), F.from_json(F.regexp_extract("value", r"(\[[^\]]*\])", 1), "array<double>").alias("vec"))
    rows = line.where("k <> '' and vec is not null").select(F.col("k").cast("long").alias("id"), "vec")
    return rows if vertices is None else rows.where(F.col("id") < vertices)


def filled(vectors: DataFrame, vertices: DataFrame, dim: int) -> DataFrame:
    """One vector for each vertex: zeros where there is none."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return vertices.select("id").join(vectors, "id", "left").select("id", F.coalesce(F.col("vec").cast("array<double>"), zero).alias("vec"))


def random_vectors(vertices: DataFrame, dim: int = 256, seed: int = 42) -> DataFrame:
    """(id, vec) uniform on [-1, 1) from MD5 of seed, id and position; the same in every run, partitioning and engine."""
    from ..operators.graph import unit_interval

    position = F.sequence(F.lit(0), F.lit(dim - 1))
    return vertices.select("id", F.transform(position, lambda j: unit_interval(F.lit(seed), "id", j) * 2.0 - 1.0).alias("vec"))


def text_vectors(texts: DataFrame, dim: int = 256, encoder=None) -> DataFrame:
    """(id, vec) of (id, text): a stand-in for a language model that hashes words into unit vectors, or ``encoder(texts)``.

    ``encoder`` takes a list of strings and returns a matrix of len(texts) rows.
    """
    if encoder is None:
        words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        at = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 13), 16, 10).cast("long"), F.lit(dim)))
        counts = texts.select("id", F.posexplode_outer(at).alias("p", "k")).groupBy("id", "k").agg(F.count("p").alias("n")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n")))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.coalesce(F.try_element_at("m", j.cast("long")), F.lit(0)).cast("double"))
        from ..functions.vectors import normalised

        return counts.select("id", dense.alias("vec")).select("id", normalised(F.col("vec")).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(encoder([t or "" for t in b.column(1).to_pylist()]), float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["id", "vec"])

    return texts.select("id", "text").mapInArrow(run, "id long, vec array<double>")
