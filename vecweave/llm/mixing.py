"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with n documents and share w of the target gets the mean repetition rate T w / n, T being the target's number
of documents. Each document's number of copies is the inverse of the Poisson distribution at a uniform number taken
from a hash of seed and doc_id; rates above PIECE are drawn as a sum of equal smaller ones. Copies get hashed keys and
are dealt by key, so the order is a global shuffle that every run repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_side, table

SEED, ALPHA, PIECE = 17, 0.5, 16.0


def terms_of(piece: float) -> int:
    """How far a piece's distribution function is written out: twenty standard deviations above the largest mean, where
    what is left is far below the 2^-52 that tells two uniform numbers apart, so no draw can lie beyond."""
    return int(piece + 20 * max(1.0, piece) ** 0.5)


TERMS = terms_of(PIECE)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, total: float | None = None, piece: float = PIECE) -> DataFrame:
    """(source, n, rate, pieces, cdf) for each source; ``weights`` default to n ** alpha, ``total`` to all documents.

    A source without a weight gets weight zero. cdf holds the Poisson distribution function of one piece at 0, 1, ...
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "name string, w double")
        n = n.join(given, F.expr("source <=> name"), "left").drop("name").withColumn("w", F.coalesce("w", F.lit(0.0)))
    all_w, all_n = n.agg(F.sum("w")).scalar(), n.agg(F.sum("n")).scalar() if total is None else F.lit(float(total))
    n = n.withColumn("rate", all_n * F.col("w") / all_w / F.col("n"))
    n = n.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / piece)).cast("int")).withColumn("part", F.col("rate") / F.col("pieces"))
    step = "struct(s.t * part / k as t, concat(s.c, array(element_at(s.c, -1) + s.t * part / k)) as c)"
    cdf = f"aggregate(sequence(1, {terms_of(piece)}), struct(exp(-part) as t, array(exp(-part)) as c), (s, k) -> {step}, s -> s.c)"
    return n.withColumn("cdf", F.expr(cdf)).select("source", "n", "rate", "pieces", "cdf")


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, draw): whole rows in one column, so that no name of theirs meets one of ours, and what tells each from all
    others: doc_id, text, and a number from 1 among the rows that agree in both.

    Only rows that repeat are numbered: within their partition first, then by the counts of the partitions before, so one
    task never needs all rows of a group, and the numbers of a group are the same however its rows are dealt.
    """
    text = F.coalesce("text", F.lit("")) if "text" in docs.columns else F.lit("")
    held = docs.select(F.struct("*").alias("row"), F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text)).alias("who"))
    again = materialise(held.groupBy("who").count().where("count > 1").select("who"))
    if not again.limit(1).count():
        return held.select("row", F.concat("who", F.lit(":1")).alias("draw"))
    twice = small_side(again)
    some = materialise(held.join(twice, "who", "left_semi").withColumn("p", F.spark_partition_id()))
    before = some.groupBy("who", "p").agg(F.count("*").alias("n"))  # a row for each partition that has some
    before = before.select("who", "p", (F.sum("n").over(Window.partitionBy("who").orderBy("p")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("who", "p").orderBy(F.lit(1)))
    some = some.withColumn("i", place).join(before, ["who", "p"]).select("row", F.concat_ws(":", "who", (F.col("before") + F.col("i")).cast("string")).alias("draw"))
    once = held.join(twice, "who", "left_anti").select("row", F.concat("who", F.lit(":1")).alias("draw"))
    return once.unionByName(some)


def _copies(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """(row, copy, mix_key) in the order of mix_key."""
    spark = docs.sparkSession
    per = small_side(rates(docs, **options).select(F.col("source").alias("name"), "pieces", "cdf"))
    held = _numbered(docs).join(per, F.expr("row.source <=> name"))
    draw = f"transform(sequence(1, pieces), j -> cast(conv(substr(md5(concat_ws(':', '{seed}', draw, cast(j as string))), 1, 13), 16, 10) as bigint) / 4503599627370496.0D)"
    held = held.withColumn("u", F.expr(draw))
    held = held.withColumn("copies", F.expr("aggregate(u, 0, (a, x) -> a + size(filter(cdf, c -> c <= x)))"))
    copies = held.where("copies > 0").select("row", "draw", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), "draw", F.col("copy").cast("string")))
    copies = copies.select("row", "copy", F.substring(key, 1, 16).alias("mix_key"))
    # The key is uniform, so its leading digits deal the rows evenly and in order, without a sampling pass.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = (F.conv(F.substring("mix_key", 1, 6), 16, 10).cast("long") * n / F.lit(1 << 24)).cast("int")
    return copies.repartitionById(n, bucket).sortWithinPartitions("mix_key")


def replicate(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The columns of ``docs`` with ``copy`` (from 1) and ``mix_key``, in the order of mix_key.

    Every row has a draw and a place of its own, also without a doc_id, or where rows share it or repeat as a whole, so
    weights are met and copies spread in any case. Null sources are a source of their own; null, empty and very long texts
    are copied like any other. A column of ``docs`` named copy or mix_key gives way to the new one;
    mixed() keeps it. An empty table gives an empty result.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    return _copies(docs, seed, **options).select(*own, "copy", "mix_key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """As replicate(), with the columns of ``docs`` and their values only, whatever they are named."""
    return _copies(docs, **options).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in its shuffled place: doc_id, copy, mix_key, source, n_chars, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    return replicate(docs).select("doc_id", "copy", "mix_key", "source", "n_chars", "text")


ORACLE = f"""
WITH n AS (SELECT source, count(*) n FROM documents GROUP BY source),
s AS (SELECT sum(sqrt(n)) sw, sum(n) sn FROM n),
r AS (SELECT source, sn * sqrt(n) / sw / n rate FROM n, s),
p AS (SELECT source, rate, CAST(greatest(1, ceil(rate / {PIECE})) AS INTEGER) pieces FROM r),
c AS (SELECT source, pieces, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) cdf FROM (
  SELECT source, pieces, k, exp(-rate / pieces + k * ln(rate / pieces) - lgamma(k + 1)) pmf FROM p, range(0, {TERMS + 1}) t(k))),
i AS MATERIALIZED (SELECT *, doc_id || ':' || md5(coalesce(text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, text) AS draw FROM documents),
d AS (SELECT draw, source, unnest(range(1, pieces + 1)) j FROM i JOIN p USING (source)),
u AS (SELECT draw, source, CAST('0x' || substr(md5('{SEED}:' || draw || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0 u FROM d),
m AS (SELECT draw, count(*) copies FROM u JOIN c USING (source) WHERE c.cdf <= u.u GROUP BY draw)
SELECT doc_id, CAST(copy AS INTEGER) AS copy, substr(md5('{SEED}:order:' || draw || ':' || copy), 1, 16) AS mix_key, source, n_chars, text
FROM (SELECT draw, unnest(range(1, copies + 1)) copy FROM m) JOIN i USING (draw)
"""
