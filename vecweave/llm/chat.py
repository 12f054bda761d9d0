"""Conversations in reply order, without quotes, with DataFrame functions only.

A line that begins with > marks is quoted; the number of marks is its level. Runs of lines of equal level are passages.
A passage and each of its lines of LINE_WORDS words or more (shorter ones say too little of where they are from, unless
they are the whole passage), in lower case and with white space squeezed, are hashed and joined, within the conversation,
with the earliest message whose own text or own line has that hash. A message replies to the latest of
the originals at its lowest quote level that has one; following replies gives its thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

_MARKS = r"^[ \t]*>[> \t]*"
_PLAIN = "trim(regexp_replace(lower({}), '\\\\s+', ' '))"
LINE_WORDS = 3
#: How the line above a quote ends, in several languages; fixed values.
HEADERS = "wrote|writes|said|schrieb|schreibt|écrit|escribió|escribe|ha scritto|escreveu|skrev|schreef"


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines (array of level and text) and own (the text of level 0, quote headers left out)."""
    text = F.coalesce("text", F.lit(""))
    df = messages.select("conv_id", "turn", "role", F.contains(text, F.lit(">")).alias("marked"), F.split(text, "\r?\n").alias("raw"))
    level = f"length(regexp_extract(l, '{_MARKS}', 0)) - length(replace(regexp_extract(l, '{_MARKS}', 0), '>', ''))"
    df = df.withColumn("lines", F.expr(f"transform(raw, l -> struct({level} as level, regexp_replace(l, '{_MARKS}', '') as text))").alias("lines"))
    # A header such as "X wrote:" belongs to the quote that follows it.
    head = f"x.level = 0 and coalesce(get(lines, i + 1).level, 0) > 0 and rtrim(x.text) rlike '(?i)(?:{HEADERS})[ \u00a0]?:$'"
    df = df.withColumn("lines", F.expr(f"transform(lines, (x, i) -> struct(if({head}, -1, x.level) as level, x.text as text))"))
    own = r"regexp_replace(regexp_replace(array_join(transform(filter(lines, x -> x.level = 0), x -> x.text), '\n'), '\\n{3,}', '\n\n'), '^\\s++|(?<!\\s)\\s++$', '')"
    return df.withColumn("own", F.expr(own)).select("conv_id", "turn", "role", "marked", "lines", "own")


def _units(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashes of own passages (conv_id, h, turn) and of quoted ones (conv_id, turn, level, h)."""
    hashed = lambda x: f"md5({_PLAIN.format(x)})"
    own = f"transform(array_union(array(own), transform(filter(lines, x -> x.level = 0), x -> x.text)), t -> {_PLAIN.format('t')})"
    mine = df.select("conv_id", "turn", F.explode_outer(F.expr(own)).alias("t")).where("t <> ''").select("conv_id", "turn", F.md5("t").alias("h"))
    # A filter on lines, or one that explode() infers, would be pushed below and compute them anew for every element.
    quoting = df.where("marked")
    # Passages: a run of lines of one level starts where the level changes. Every step takes time in proportion to the lines.
    quoting = quoting.withColumn("starts", F.expr("filter(sequence(0, size(lines) - 1), i -> i = 0 or lines[i].level <> lines[i - 1].level)"))
    run = "slice(lines, s + 1, coalesce(get(starts, k + 1), size(lines)) - s)"
    runs = f"transform(starts, (s, k) -> struct(lines[s].level as level, array_join(transform({run}, x -> x.text), '\n') as text))"
    lines = f"filter(lines, x -> x.level > 0 and size(split({_PLAIN.format('x.text')}, ' ')) >= {LINE_WORDS})"
    both = f"concat(filter({runs}, x -> x.level > 0), {lines})"
    theirs = quoting.select("conv_id", "turn", F.explode_outer(F.expr(both)).alias("q")).where("q is not null")
    theirs = theirs.where(F.expr(f"{_PLAIN.format('q.text')} <> ''")).select("conv_id", "turn", "q.level", F.expr(hashed("q.text")).alias("h"))
    return mine, theirs.distinct()


def link(messages: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, role, text (without quotes), quote_level, parent_turn, root_turn, depth.

    Further columns of ``messages`` aren't read, so their names don't matter; texts of any length are read whole.
    Messages without a link are roots of depth 0. Null text counts as empty; messages with a null conv_id or turn have
    no links and are roots. Rows with equal (conv_id, turn) share their links. Rows are in the order of conv_id, root_turn, depth,
    turn, so that each reply comes after its parent. An empty table gives an empty result.
    """
    df = parse(messages)
    mine, theirs = _units(df)
    quoting = materialise(theirs)
    found = df.withColumn("quote_level", F.expr("greatest(0, array_max(lines.level))"))
    out = ["conv_id", "turn", "role", F.col("own").alias("text"), "quote_level"]
    if not quoting.limit(1).count():
        rooted = found.select(*out, F.lit(None).cast("long").alias("parent_turn"), F.col("turn").alias("root_turn"), F.lit(0).alias("depth"))
    else:
        # Only hashes that something quotes; a hash has one original, so the join gives one row for each quote.
        first = mine.join(quoting.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("first"))
        hits = quoting.join(first, ["conv_id", "h"]).where("first < turn")
        parents = hits.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "first")).alias("m")).select("conv_id", "turn", F.col("m.first").alias("parent_turn"))
        parents = materialise(parents)
        threads = _threads(parents)
        rooted = found.join(parents.join(threads, ["conv_id", "turn"]), ["conv_id", "turn"], "left").select(*out, F.col("parent_turn").cast("long").alias("parent_turn"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))
    return rooted.repartitionByRange("conv_id", "root_turn", "depth", "turn").sortWithinPartitions("conv_id", "root_turn", "depth", "turn")


def _threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) by pointer doubling; a parent's turn is smaller, so there are no cycles."""
    now = materialise(parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("up"), F.col("depth").alias("more"))
        joined = now.join(up, ["conv_id", "root_turn"], "left")
        after = materialise(joined.select("conv_id", "turn", F.coalesce("up", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")))
        now = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return now


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with its parent and thread."""
    return link(table(spark, sf_dir, "conversations")).withColumns({c: F.col(c).cast("long") for c in ("quote_level", "depth")})


_SQL_PLAIN = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
ORACLE = rf"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () rid, conv_id, turn, role, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) x FROM conversations),
l AS (SELECT rid, conv_id, turn, unnest(range(1, len(string_split(x, chr(10))) + 1)) i, unnest(string_split(x, chr(10))) raw FROM m),
v AS (SELECT *, regexp_extract(raw, '^[ \t]*>[> \t]*') q, regexp_replace(raw, '^[ \t]*>[> \t]*', '') t FROM l),
w AS (SELECT *, len(q) - len(replace(q, '>', '')) lv FROM v),
g AS MATERIALIZED (SELECT rid, conv_id, turn, i, t, CAST(CASE WHEN lv = 0 AND coalesce(lead(lv) OVER (PARTITION BY rid ORDER BY i), 0) > 0 AND regexp_matches(rtrim(t), '(?i)(?:{HEADERS})[ \x{{00a0}}]?:$') THEN -1 ELSE lv END AS BIGINT) lv FROM w),
own AS MATERIALIZED (SELECT rid, conv_id, turn, coalesce(regexp_replace(regexp_replace(string_agg(t, chr(10) ORDER BY i) FILTER (lv = 0), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') own, greatest(0, max(lv)) ql FROM g GROUP BY ALL),
r AS (SELECT *, sum(CAST(moved AS INTEGER)) OVER (PARTITION BY rid ORDER BY i) run FROM (SELECT *, lv IS DISTINCT FROM lag(lv) OVER (PARTITION BY rid ORDER BY i) moved FROM g)),
u AS (SELECT DISTINCT conv_id, turn, lv, {_SQL_PLAIN.format("t")} h FROM (
  SELECT conv_id, turn, lv, t FROM g WHERE lv > 0 AND len(string_split({_SQL_PLAIN.format("t")}, ' ')) >= {LINE_WORDS} UNION ALL SELECT conv_id, turn, lv, string_agg(t, chr(10) ORDER BY i) FROM r WHERE lv > 0 GROUP BY rid, conv_id, turn, lv, run)),
o AS (SELECT conv_id, {_SQL_PLAIN.format("t")} h, min(turn) first FROM (SELECT conv_id, turn, own t FROM own UNION ALL SELECT conv_id, turn, t FROM g WHERE lv = 0) GROUP BY ALL),
p AS MATERIALIZED (SELECT u.conv_id, u.turn, arg_min(first, (lv, -first)) parent FROM u JOIN o ON o.conv_id = u.conv_id AND o.h = u.h WHERE u.h <> '' AND first < u.turn GROUP BY ALL),
c(conv_id, turn, root, depth) AS (SELECT conv_id, turn, parent, 1 FROM p UNION ALL SELECT c.conv_id, c.turn, p.parent, c.depth + 1 FROM c JOIN p ON p.conv_id = c.conv_id AND p.turn = c.root),
z AS (SELECT conv_id, turn, arg_max(root, depth) root, max(depth) depth FROM c GROUP BY ALL)
SELECT own.conv_id, own.turn, m.role, own.own AS text, CAST(ql AS BIGINT) AS quote_level, CAST(p.parent AS BIGINT) AS parent_turn, coalesce(z.root, own.turn) AS root_turn, CAST(coalesce(z.depth, 0) AS BIGINT) AS depth
FROM own JOIN m ON m.rid = own.rid LEFT JOIN p ON p.conv_id = own.conv_id AND p.turn = own.turn LEFT JOIN z ON z.conv_id = own.conv_id AND z.turn = own.turn
"""
