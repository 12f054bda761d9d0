"""Co-activity edges from a stream: values that one user touches within a window, for the same operators as any graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_activity(events: DataFrame, item: str = "event_type", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, a, b) for each two items that a user has in a tumbling window; works on batches and streams alike.

    On a stream a window is given out once the watermark has passed it; events later than ``late`` behind it are dropped.
    """
    sets = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.array_sort(F.collect_set(item)).alias("x"))
    two = F.expr("flatten(transform(x, (a, i) -> transform(slice(x, i + 2, size(x)), b -> struct(a as a, b as b))))")
    return sets.select(F.col("w.start").alias("start"), F.explode(two).alias("p")).select("start", "p.a", "p.b")
