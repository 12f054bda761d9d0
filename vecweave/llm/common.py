"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an id list or fingerprint table up to which a join may broadcast it (about 16 bytes a row).
BROADCAST_ROWS = 500_000

#: Rows and bytes of one Arrow batch, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 2 << 20

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that hold whole texts. The session keeps these bounds, as plans read them when they run;
    they are only ever lowered."""
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key)).rstrip("bB")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))
    return spark


def release() -> None:
    """Give freed memory back to the system: Arrow's pool and, with the GNU C library, the heap's free pages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, after which the worker, which waits for other tasks, keeps no more than it needs."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local master may leave it unset, as tests do: elsewhere
    a folder of the driver's machine would be lost to the executors, so this raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints/vecweave")
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder survives lost executors. The shuffle files that led to it
    go at once; else each round's stay until the driver's heap is collected."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, made under the setting
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name beneath the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count shows at most ``rows`` rows; else leave the join to shuffles and AQE's skew handling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text: Column | str = "text") -> Column:
    """What tells the texts of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, key): whole rows in one column, so that no name of theirs meets one of ours, and text_key()."""
    return docs.select(F.struct("*").alias("row"), text_key().alias("key"))


_SAME = "row.doc_id <=> d and key = k"


def without_rows(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id (null is a value) and text are among ``lost(doc_id, key)``.

    A row follows the verdict on its own text: other texts under the same doc_id stay.
    """
    lost = materialise(lost.select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct())  # counted, then joined
    return whole_rows(docs).join(small_side(lost), F.expr(_SAME), "left_anti").select("row.*")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row for each root of ``groups(doc_id, key, root)``, which names the group of every row.

    It is the row of the smallest doc_id, then of the smallest key; a row without a doc_id is kept only where its group
    has none with one. Rows that repeat both are one document and leave one row.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    best = groups.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1").select("root", "first")
    members = groups.join(small_side(materialise(best)), "root")
    kept_pair = F.expr("doc_id <=> first.doc_id and key = first.key")
    kept = without_rows(docs, members.where(~kept_pair))
    again = members.where(kept_pair).groupBy("doc_id", "key").count().where("count > 1")
    again = materialise(again.select(F.col("doc_id").alias("d"), F.col("key").alias("k")))
    if not again.limit(1).count():
        return kept
    twice, rows = small_side(again), whole_rows(kept)
    one = rows.join(twice, F.expr(_SAME), "left_semi").withColumn("d", F.col("row.doc_id")).dropDuplicates(["d", "key"]).select("row")
    return rows.join(twice, F.expr(_SAME), "left_anti").select("row").unionByName(one).select("row.*")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings together, and where each begins (one more entry than strings); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each data[start:end], from prefix sums."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=prefix[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    return mix64((prefix[ends] - prefix[starts]) * _power(inverse, n + 1)[starts] + (ends - starts).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
