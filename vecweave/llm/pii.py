"""Personal data and the terms that give it away, with DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. What they stand for is protected on
several levels: the value itself, the part of it that names a group (a domain or local part, a network, an issuer, an
area), and its kind. A term is a whole word of letters outside of addresses. Over all documents, the pointwise mutual
information PMI(entity; term) = log2(n_et N / (n_e n_t)) measures how much of the entity's information content
IC(entity) = log2(N / n_e) the term discloses; n counts documents. A term is generalised, wherever it stands, if for some
entity PMI reaches DISCLOSURE of IC, what it leaves open, IC - PMI = log2(n_t / n_et), is at most RESIDUAL bits, and the
two meet more often than chance explains: met at random, n_et would exceed its mean m = n_e n_t / N so far with
probability below exp(-(n_et ln(n_et / m) - n_et + m)), Chernoff's bound for a Poisson count, and that must be below CHANCE
shared among all pairs counted. So the support that is needed follows from the corpus, and no number of documents is
fixed; and as an entity is in a fixed share at least of the documents that hold a term it gives away, what is generalised
grows with what is protected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_side, table, text_key

#: A term discloses an entity if it tells half of what there is to know of it and leaves a guess of one in four (2 bits);
#: chance that any pair passes by accident.
DISCLOSURE, RESIDUAL, CHANCE = 0.5, 2.0, 0.01

#: Patterns whose attempts can't start inside a run that has already failed, and which never give back what they took,
#: so that long runs of letters or digits take linear time; they find what the plain patterns find.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A whole word of letters and their marks. Digits belong to the patterns: no pattern but an address holds a letter.
TERM = r"(?<![\p{L}\p{M}\p{N}])\p{L}[\p{L}\p{M}]*+(?!\p{N})"

_DIGITS = "regexp_extract_all({}, '[0-9]', 0)"
_LUHN = (
    "aggregate(transform(reverse(" + _DIGITS + "), (c, i) -> cast(c as int) * (1 + i % 2) - if(i % 2 = 1 and cast(c as int) > 4, 9, 0)), 0, (a, b) -> a + b) % 10 = 0"
)
#: kind: pattern, what a text must hold, what a match must meet.
KINDS = {
    "email": (EMAIL, "contains(text, '@')", "true"),
    "ip": (IP, "contains(text, '.')", "forall(split({}, '[.]'), p -> coalesce(try_cast(p as int), 256) <= 255)"),
    "card": (CARD, "true", _LUHN),
    "phone": (PHONE, "contains(text, '+')", "size(" + _DIGITS + ") between 8 and 15"),
}
#: kind: names of the parts of a value v that name a group, and their SQL.
PARTS = {
    "email": {"domain": "split_part(v, '@', 2)", "local": "split_part(v, '@', 1)"},
    "ip": {"net": "substring_index(v, '.', 2)"},
    "card": {"issuer": "substring(regexp_replace(v, '[^0-9]', ''), 1, 6)"},
    "phone": {"area": "substring(regexp_replace(v, '[^0-9]', ''), 1, 4)"},
}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(df: DataFrame, items: str, value: str, fold: str, out: str) -> DataFrame:
    """Add ``out``: for each element x of the array ``items`` the fold of ``value`` (SQL of x) over the elements before it.

    ``fold`` is SQL of a and b, associative, zero for none. An array that grows by one is copied each time, so this works
    in chunks of about the cube root of the number: the copies are n ^ (4/3) elements, not n squared.
    """
    step = lambda a, b: fold.format(a=a, b=b)
    # Separate projections: an expression that a lambda refers to would be computed anew for every element.
    df = df.withColumn("_w", F.expr(f"greatest(16, cast(ceil(cbrt(size({items}))) as int))"))
    df = df.withColumn("_t", F.expr(f"if(size({items}) > 0, transform(sequence(0, (size({items}) - 1) div _w), c -> aggregate(slice({items}, c * _w + 1, _w), 0, (a, x) -> {step('a', value)})), array())"))
    df = df.withColumn("_o", F.expr(f"aggregate(_t, array(0), (a, x) -> concat(a, array({step('element_at(a, -1)', 'x')})))"))
    inner = f"aggregate(slice({items}, c * _w + 1, _w), array(o), (a, x) -> concat(a, array({step('element_at(a, -1)', value)})), a -> slice(a, 1, size(a) - 1))"
    return df.withColumn(out, F.expr(f"flatten(transform(slice(_o, 1, size(_o) - 1), (o, c) -> {inner}))")).drop("_w", "_t", "_o")


def located(df: DataFrame, text: str, out: str, pattern: str, when: str = "true", ok: str = "true") -> DataFrame:
    """Add ``out``: code-point spans (s, e) and strings v of the pattern's matches in column ``text`` that meet ``ok``."""
    df = df.withColumn("_m", F.expr(f"if({when}, regexp_extract_all({text}, {_sql(pattern)}, 0), array())"))
    df = df.withColumn("_g", F.expr(f"if(size(_m) > 0, split({text}, {_sql(pattern)}), array())"))
    df = df.withColumn("_z", F.expr("zip_with(_m, slice(_g, 1, size(_m)), (v, g) -> struct(v as v, length(g) as before, length(v) as n))"))
    df = running(df, "_z", "x.before + x.n", "{a} + {b}", "_p")
    spans = "zip_with(_z, _p, (z, p) -> struct(p + z.before as s, p + z.before + z.n as e, z.v as v))"
    kept = spans if ok == "true" else f"filter({spans}, x -> {ok.format('x.v', 'x.v')})"
    return df.withColumn(out, F.expr(f"if(size(_m) > 0, {kept}, array())")).drop("_m", "_g", "_z", "_p")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and an array of spans for each kind."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, (pattern, when, ok) in KINDS.items():
        df = located(df, "text", kind, pattern, when, ok)
    return df


def _listed(column: str, kind: str) -> Column:
    return F.transform(F.col(column), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def _entities(kind: str) -> str:
    """SQL: what the matches of a kind stand for, on every level."""
    parts = ", ".join([f"concat('{kind}:', v)", *(f"concat('{name}:', {part})" for name, part in PARTS[kind].items())])
    return f"if(size({kind}) > 0, array_append(flatten(transform(transform({kind}, x -> lower(x.v)), v -> array({parts}))), '{kind}'), array())"


def without_addresses(text: Column) -> Column:
    """The text with blanks in the place of addresses, as long as it was."""
    gaps, found = F.split(text, EMAIL), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    blank = lambda g, v: F.concat(F.coalesce(g, F.lit("")), F.coalesce(F.repeat(F.lit(" "), F.length(v)), F.lit("")))
    return F.when(F.contains(text, F.lit("@")), F.array_join(F.zip_with(gaps, found, blank), "")).otherwise(text)


def _words(text: Column) -> Column:
    """The different terms of a text, lower-cased after they are cut, as they are when they are marked."""
    return F.array_distinct(F.transform(F.regexp_extract_all(without_addresses(text), F.lit(TERM), F.lit(0)), F.lower))


def disclosing(pairs: DataFrame, n: int, tests: int, disclosure: float, residual: float, chance: float) -> DataFrame:
    """The rows of ``pairs(entity, term, n_et, n_e, n_t)`` whose term discloses the entity, with pmi and ic."""
    mean = F.col("n_e") * F.col("n_t") / F.lit(float(max(1, n)))
    told = pairs.withColumn("ic", F.log2(F.lit(float(max(1, n))) / F.col("n_e"))).withColumn("pmi", F.log2(F.col("n_et") / mean))
    told = told.withColumn("evidence", F.when(F.col("n_et") > mean, F.col("n_et") * F.log(F.col("n_et") / mean) - F.col("n_et") + mean).otherwise(0.0))
    enough = F.col("evidence") >= F.log(F.lit(max(1, tests) / chance))
    return told.where((F.col("n_e") < n) & (F.col("pmi") >= disclosure * F.col("ic")) & (F.log2(F.col("n_t") / F.col("n_et")) <= residual) & enough)


def find(docs: DataFrame, disclosure: float = DISCLOSURE, residual: float = RESIDUAL, chance: float = CHANCE) -> DataFrame:
    """(doc_id, h, base, spans) for each row of ``docs``; h is the text's hash, spans hold kind, s, e in code points.

    ``base`` has the pattern matches by kind, then start; ``spans`` has these and, as kind term, the disclosing terms,
    which overlap none of them. Null and empty texts have none; texts of any length are read whole; rows with equal doc_id
    and text have equal spans, and each counts in the statistics once; a null doc_id is a value like any other. Further
    columns of ``docs`` aren't read, so their names don't matter. An empty table gives an empty result.
    """
    df = base_spans(docs).withColumn("h", text_key())
    df = df.withColumn("base", F.concat(*(_listed(k, k) for k in KINDS)))
    rows = materialise(df.select("doc_id", "h", "base", F.expr(f"array_distinct(concat({', '.join(map(_entities, KINDS))}))").alias("entities")))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", text_key())
    same = F.expr("doc_id <=> d and h = k")
    n = rows.count()
    held = rows.where("size(entities) > 0").select("doc_id", "h", F.explode("entities").alias("entity")).distinct()
    n_e = materialise(held.groupBy("entity").agg(F.count("*").alias("n_e")))
    # Entities too rare for any term to give evidence, were each of them met with one term only, have no pairs to count.
    able = n_e.where(F.col("n_e") * F.log(F.lit(float(max(1, n))) / F.col("n_e")) - F.col("n_e") + F.col("n_e") * F.col("n_e") / F.lit(float(max(1, n))) >= F.log(F.lit(max(1, n_e.count()) / chance)))
    able = materialise(able)
    met = materialise(held.join(small_side(able), "entity").groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.collect_set("entity").alias("met")))
    seen = own.join(small_side(met), same).dropDuplicates(["doc_id", "h"]).select("met", _words(F.col("text")).alias("words"))
    pairs = seen.select(F.explode("met").alias("entity"), "words").select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    pairs = materialise(pairs)
    tests = pairs.count()
    each = own.dropDuplicates(["doc_id", "h"]) if _repeated(rows) else own
    each = each.select("doc_id", "h", F.explode(_words(F.col("text"))).alias("term"))
    # Every word is counted where it stands before counts meet the pairs, so the join has one row for each pair at most.
    n_t = each.groupBy("term").agg(F.count("*").alias("n_t"))
    told = disclosing(pairs.join(n_t, "term").join(small_side(able), "entity"), n, tests, disclosure, residual, chance)
    told = small_side(materialise(told.select("term").distinct()))
    hits = each.join(told, "term", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.collect_set("term").alias("told"))
    marked = own.join(small_side(materialise(hits)), same).dropDuplicates(["doc_id", "h"]).withColumn("text", without_addresses(F.col("text")))
    marked = located(marked, "text", "terms", TERM, "true", "array_contains(told, lower({}))").select("d", "k", "terms")
    found = rows.join(marked, same, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<s:int,e:int,v:string>>")))
    return found.select("doc_id", "h", "base", F.concat("base", _listed("terms", "term")).alias("spans"))


def _repeated(rows: DataFrame) -> bool:
    return bool(rows.groupBy("doc_id", "h").count().where("count > 1").limit(1).count())


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; columns stay, null texts stay null.

    Spans that overlap are replaced together, by the kind of the first.
    """
    found = find(docs, **options).select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "spans").distinct()
    # Whole rows travel in one column, so that no name of theirs meets one of ours.
    own = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("t"), text_key().alias("h"))
    held = own.join(found, F.expr("row.doc_id <=> d and h = k"), "left")
    held = held.withColumn("_s", F.expr("array_sort(transform(spans, x -> struct(x.s as s, x.e as e, x.kind as kind)))"))
    held = running(held, "_s", "x.e", "greatest({a}, {b})", "_b")
    # Groups of overlapping spans: where each starts, and how far the spans before it went.
    held = held.withColumn("_q", F.expr("filter(zip_with(_s, _b, (x, b) -> struct(b as past, x.s as s, x.kind as kind)), x -> x.s >= x.past)"))
    held = held.withColumn("_w", F.expr("greatest(16, cast(ceil(cbrt(size(_q))) as int))"))
    # The text is cut in two steps, so that a place is looked for within a short piece.
    held = held.withColumn("_c", F.expr("transform(sequence(0, (size(_q) - 1) div _w), c -> struct(_q[c * _w].past as at, slice(_q, c * _w + 1, _w) as q))"))
    held = held.withColumn("_p", F.expr("transform(_c, x -> struct(x.at as at, x.q as q, substring(t, x.at + 1, element_at(x.q, -1).s - x.at) as t))"))
    cut = "flatten(transform(_p, x -> transform(x.q, y -> concat(substring(x.t, y.past - x.at + 1, y.s - y.past), '[', upper(y.kind), ']'))))"
    held = held.withColumn("_x", F.expr(f"concat(array_join({cut}, ''), substring(t, array_max(_s.e) + 1))"))
    text = F.when(F.col("row.text").isNull() | (F.size("spans") == 0), F.col("row.text")).otherwise(F.col("_x"))
    return held.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, with counts and a digest of the pattern matches."""
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
