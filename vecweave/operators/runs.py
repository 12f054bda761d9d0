"""Records of runs: summaries, statuses, attempts, ratios.

runs(config, rep, status, seconds, peak_gib, results, histogram, ...): one row for each attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACES = 6


def summary(runs: DataFrame, config: list[str], strict: bool = True) -> DataFrame:
    """Completed runs by configuration: repetitions, min, median and max seconds, median and max peak memory.

    With ``strict`` configurations whose runs differ in result count or histogram raise.
    """
    done = runs.where("status = 'completed'")
    same = F.countDistinct("results", "histogram")
    out = done.groupBy(*config).agg(
        F.count("*").alias("reps"), *(F.round(f, PLACES).alias(n) for n, f in (("min_s", F.min("seconds")), ("median_s", F.percentile("seconds", F.lit(0.5))), ("max_s", F.max("seconds")), ("median_gib", F.percentile("peak_gib", F.lit(0.5))), ("max_gib", F.max("peak_gib")))),
        F.max("results").alias("results"), same.alias("kinds"),
    )
    if strict:
        out = out.withColumn("results", F.when(F.col("kinds") > 1, F.raise_error(F.lit("runs of one configuration differ in their results"))).otherwise(F.col("results")))
    return out.drop("kinds")


def status_of(code: Column, timed_out: Column, parsed: Column, same: Column) -> Column:
    """completed, tle, oom, crash, parse_error or mismatch."""
    return F.when(timed_out, "tle").when(code == 3, "oom").when(code != 0, "crash").when(~parsed, "parse_error").when(~same, "mismatch").otherwise("completed")


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"))


def missing(plan: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """Planned tasks without an attempt."""
    return plan.join(runs.select(*key).distinct(), key, "left_anti")


def attempts(runs: DataFrame, task: list[str], order: list[str]) -> DataFrame:
    """Each run with its number within the task, and whether it is the last."""
    w = Window.partitionBy(*task)
    return runs.withColumn("attempt", F.row_number().over(w.orderBy(*order))).withColumn("latest", F.col("attempt") == F.count("*").over(w))


def best_record(records: DataFrame, key: list[str], completed: str, source_rank: str) -> DataFrame:
    """For each key the record with most completed repetitions, then of the best source."""
    rest = [c for c in records.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(completed), -F.col(source_rank)))
    return records.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def speedup(runs: DataFrame, key: list[str], threads: str, seconds: str) -> DataFrame:
    """Seconds with the fewest threads over seconds, by key."""
    first = F.first_value(F.col(seconds)).over(Window.partitionBy(*key).orderBy(threads))
    return runs.select(*key, threads, seconds, F.round(first / F.col(seconds), PLACES).alias("speedup"))


def geometric_mean(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """exp of the mean logarithm of positive values."""
    return rows.where(F.col(column) > 0).groupBy(*key).agg(F.round(F.exp(F.avg(F.log(column))), PLACES).alias("geo_mean"))


def comparison(runs: DataFrame, key: list[str], algorithm: str, seconds: str, a: str, b: str) -> DataFrame:
    """ratio and log2 ratio of algorithm a's seconds over b's by key."""
    pick = lambda n: F.max(F.when(F.col(algorithm) == n, F.col(seconds)))
    both = runs.groupBy(*key).agg(pick(a).alias("x"), pick(b).alias("y")).where("x is not null and y > 0")
    return both.select(*key, F.round(F.col("x") / F.col("y"), PLACES).alias("ratio"), F.round(F.log2(F.col("x") / F.col("y")), PLACES).alias("log2_ratio"))


def previous_equal(runs: DataFrame, key: list[str], family: str) -> DataFrame:
    """Pairs (run, previous) of completed runs on the same input whose result families can be compared."""
    a = runs.where("status = 'completed'")
    b = a.select(*key, family, F.col("run").alias("previous"), F.col("results").alias("previous_results"))
    return a.join(b, [*key, family]).where("previous < run").select("run", "previous", (F.col("results") == F.col("previous_results")).alias("equal"))


def task_priority(size_rank: Column, weight: Column, bonus: Column) -> Column:
    return weight * (size_rank + 0.5) + bonus


def next_tasks(tasks: DataFrame, n: int = 4) -> DataFrame:
    """The n pending tasks of the smallest priority value."""
    return tasks.where("status = 'pending'").orderBy("priority", "task").limit(n)


def merged_status(tasks: DataFrame, key: list[str], order: tuple[str, ...] = ("completed", "tle", "oom", "crash", "pending")) -> DataFrame:
    """For each key the best status by the given order."""
    rank = F.coalesce(*(F.when(F.col("status") == s, F.lit(k)) for k, s in enumerate(order)), F.lit(len(order)))
    return tasks.groupBy(*key).agg(F.min_by("status", F.struct(rank, "status")).alias("status"))


def expand_plan(tasks: DataFrame) -> DataFrame:
    """One row for each repetition, with a task id that is the hash of its fields."""
    each = tasks.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.coalesce("repetitions", F.lit(1))))).drop("repetitions")
    return each.withColumn("task_id", F.sha2(F.to_json(F.struct(*sorted(each.columns))), 256))


def task_grid(spark: SparkSession, **axes: list | DataFrame) -> DataFrame:
    """All combinations of settings, one column for each axis: a list, or a DataFrame of one column whose different values
    it is. An axis is one row's array, so it should have few values, as settings do; null isn't one of them."""
    out = spark.range(1)
    for name, values in axes.items():
        if isinstance(values, DataFrame):
            held = values.agg(F.array_sort(F.collect_set(values.columns[0])).alias("_axis"))  # one row
            out = out.join(F.broadcast(held)).withColumn(name, F.explode("_axis")).drop("_axis")
        else:
            out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id")
