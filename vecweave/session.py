"""Session settings and lineage cuts."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side of a join up to which it is broadcast; a row may be a vector.
BROADCAST_ROWS = 50_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, name: str = "vecweave") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, shared by driver and executors. Only a local master may leave it unset, as tests do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints/vecweave")
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name beneath the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go as soon as it has ended; else they stay until the driver's heap is collected."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, which outlives lost executors; the shuffle files
    that led to it go at once."""
    checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own, made under the setting


class Shelf:
    """Intermediate rows as packed Parquet in a folder of their own beneath the shared one, for rounds whose rows must go
    as soon as the next ones are there. What leaves the ``with`` block must be checkpointed: the folder goes at its end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_path(spark, name)
        self._folders: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        remove_path(self.spark, self.path)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._folders[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        remove_path(self.spark, self._folders.pop(id(df))[1])


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def side(df: DataFrame, small: bool | None = None) -> DataFrame:
    """A side of a join: broadcast if a count shows that its rows are few, else sorted and merged. Without a hint the planner
    goes by the size of the files that the rows came from, which says nothing of vectors or pairs made from them."""
    return F.broadcast(df) if (few(df) if small is None else small) else df.hint("merge")


class OutOfTime(RuntimeError):
    """A result wasn't whole within its time."""


def within_time(spark: SparkSession, seconds: float, build: Callable[[], DataFrame]) -> DataFrame:
    """The checkpointed result of ``build()``, or OutOfTime: never a part of it, nor a count of what was found so far.

    All jobs started meanwhile carry a tag, by which a timer cancels them, on every executor, once the time is over. A job
    that ends at that very moment doesn't count either, so the limit alone decides.
    """
    context, tag, over = spark.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event()
    done = threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        over.set()
        while not done.wait(0.5):  # jobs of a later step, too
            context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    timer = threading.Thread(target=watch, daemon=True)
    timer.start()
    try:
        result = materialise(build())
    except (PySparkException, Py4JJavaError) as e:
        if over.is_set():
            raise OutOfTime(f"not whole within {seconds} seconds") from e
        raise
    finally:
        done.set()
        context.removeJobTag(tag)
        timer.join()
    if over.is_set():
        raise OutOfTime(f"not whole within {seconds} seconds")
    return result
