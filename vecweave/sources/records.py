"""Dataset catalog, fingerprints, run logs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Datasets by id: the paths of a graph and of its vectors. Unknown ids raise."""

    def __init__(self, entries: dict[str, dict[str, str]]):
        self.entries = {str(k): dict(v) for k, v in entries.items()}

    def __getitem__(self, dataset: str | int) -> dict[str, str]:
        if str(dataset) not in self.entries:
            raise KeyError(f"no dataset {dataset}; there are {', '.join(sorted(self.entries))}")
        return self.entries[str(dataset)]

    def resolve(self, task: dict) -> dict:
        """The task with graph and vectors from the catalog where it names none."""
        return self[task["dataset"]] | {k: v for k, v in task.items() if v is not None}


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each log: path, total_ms, results, peak_gib, histogram (size to count), stats (name to number).

    Lines are "TOTAL: <n> ... <ms> ms", "Peak memory: <x> GiB", "size <k>: <n>" and "STAT <name>=<number>".
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    pick = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    pairs = lambda a, b, key, kind: F.map_from_entries(F.transform(F.arrays_zip(a.alias("k"), b.alias("v")), lambda x: F.struct(x["k"].cast(key), x["v"].cast(kind))))
    size, stat = r"(?m)^\s*size\s+(\d+)\s*:\s*(\d+)", r"(?m)^\s*STAT\s+(\w+)=([-+0-9.eE]+)"
    every = lambda p, g: F.regexp_extract_all("value", F.lit(p), F.lit(g))
    return whole.select(
        "path", pick(r"(?m)^TOTAL:?\s+(\d+)").cast("long").alias("results"), pick(r"(?m)^TOTAL.*?([0-9.]+)\s*ms").cast("double").alias("total_ms"),
        pick(r"(?i)peak memory:?\s*([0-9.]+)\s*GiB").cast("double").alias("peak_gib"), pairs(every(size, 1), every(size, 2), "int", "long").alias("histogram"), pairs(every(stat, 1), every(stat, 2), "string", "double").alias("stats"),
    )


def read_manifest(spark: SparkSession, path: str, rows: str = "runs") -> DataFrame:
    """The records listed in a JSON document, one to a row."""
    whole = spark.read.json(path, multiLine=True)
    return whole.select(F.explode(rows).alias("r")).select("r.*") if rows in whole.columns else whole


def write_csv(df: DataFrame, path: str, places: int = 6) -> None:
    """CSV with a header; floating numbers are rounded."""
    from pyspark.sql.types import DoubleType, FloatType

    cols = [F.round(f.name, places).alias(f.name) if isinstance(f.dataType, DoubleType | FloatType) else F.col(f.name) for f in df.schema]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def author_audit(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """One row on (author) in ``rows`` against ids in ``listed``: counts, distinct, range, gaps, ids in one only."""
    a, b = rows.select("author").where("author is not null"), listed.select("author").where("author is not null")
    d = a.distinct()
    one = a.agg(F.count("*").alias("n_rows"), F.countDistinct("author").alias("authors"), F.min("author").alias("least"), F.max("author").alias("most"))
    out = one.withColumn("gaps", F.col("most") - F.col("least") + 1 - F.col("authors"))
    for name, df in (("only_rows", d.exceptAll(b.distinct())), ("only_listed", b.distinct().exceptAll(d))):
        out = out.join(F.broadcast(df.agg(F.count("*").alias(name))))  # one row
    return out
