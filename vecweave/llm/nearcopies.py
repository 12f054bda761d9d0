"""Near copies for the pipeline: near_duplicates for five-word shingles and a similarity of 0.8, checked exactly.

Fingerprints within 2 bits, found by neardup's vantage-point trees, and texts that agree in a band of MinHash values are
candidates. The trees alone reach nearly unchanged copies only (see README for what they find and prune at wider radii).
Of two texts of Jaccard similarity 0.8, a band of ROWS values agrees with chance 0.8^6 = 0.26, so all 42 miss with chance
3 in a million; of 0.3, one agrees with chance 0.03.

Candidates come in buckets of texts that share a band or a tree's group. First each text is compared, by its whole
shingle set, with the text that leads most of its buckets, which is one comparison for each text however large a bucket
is. What hangs together then counts as one, and only in buckets of which some texts still stand apart are these compared
with the others, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_first, lean, materialise, mix64, release, small_side, text_bytes, text_key, tune
from .components import components
from .neardup import RADIUS, fingerprint_of, near_groups

WORDS, SIMILAR, BANDS, ROWS, SEED = 5, 0.8, 42, 6, 42
#: Texts and characters of a block of candidates; a task holds two blocks.
BLOCK_ROWS, BLOCK_CHARS = 1_000, 8 << 20
#: Bytes of a group of blocks beyond which a worker gives memory back after it.
RELEASED = 4 << 20
#: Leaders whose shingles a worker remembers.
LEADERS = 16

_SALTS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of lower-cased word shingles; fewer words, or none, are one shingle."""
    w, h = text.lower().split(), xxhash.xxh64_intdigest
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def bands(x: np.ndarray) -> np.ndarray:
    """BANDS hashes of a shingle set."""
    low = np.full(len(_SALTS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(x), 256):
        part = x[a : a + 256]
        # The upper half is folded in before and after the product, so that the order depends on all bits.
        y = (part ^ (part >> np.uint64(32)))[None, :] * _SALTS[:, None]
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, y.min(1), out=low)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + column)
    return out


def exact_links(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """A forest over the sets: every two whose Jaccard similarity is at least ``similar`` hang together."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(ids.max()) + 1, bool)
    open_ = np.arange(len(sets))
    flat, starts = ids, np.cumsum(sizes) - sizes
    free, found = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed], front = False, [seed]
        while front:
            k = front.pop()
            if 2 * free[open_].sum() < len(open_):
                open_ = open_[free[open_]]
                if not len(open_):
                    return found
                flat = np.concatenate([of[i] for i in open_])
                starts = np.cumsum(sizes[open_]) - sizes[open_]
            mark[of[k]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[of[k]] = False
            near = free[open_] & (both >= similar * (sizes[k] + sizes[open_] - both) - 1e-9)
            new = open_[near].tolist()
            free[new] = False
            found += [(k, i) for i in new]
            front += new
    return found


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, fp, bands) for each row of ``docs(key, text)``."""
    tune(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(1))
            raw, at = data.tobytes(), at.tolist()
            sets = [shingles(raw[s:e], words) for s, e in zip(at, at[1:], strict=False)]
            got = np.array([bands(x) for x in sets], np.uint64).reshape(-1, BANDS)
            fp = np.array([fingerprint_of(x) for x in sets], np.uint64)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * BANDS), pa.array(got.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), each], ["key", "fp", "bands"])

    return docs.select("key", "text").mapInArrow(lean(sign), "key long, fp long, bands array<long>")


def buckets(signed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(band, key, least): the texts of each band or tree's group that has two or more, and the least of them."""
    by_band = signed.select(F.explode("bands").alias("band"), "key").distinct()
    trees = near_groups(signed.select("fp"), radius)
    fps = signed.select("fp", "key").distinct()
    by_tree = fps.join(trees, "fp", "left").select(F.xxhash64(F.lit("tree"), F.coalesce("root", "fp")).alias("band"), "key")
    each = by_band.unionByName(by_tree)
    shared = each.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("band", "least")
    return each.join(small_side(materialise(shared)), "band").select("band", "key", "least")


def with_leaders(members: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """(a, b): every text and the one that leads most of its buckets, where these two are similar."""
    pairs = members.where("key <> least").groupBy("key", "least").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("key").agg(F.max_by("least", F.struct("n", -F.col("least"))).alias("lead"))
    led = pairs.join(texts, "key").join(texts.select(F.col("key").alias("lead"), F.col("text").alias("first")), "lead")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            a, c = [], []
            for key, lead, text, first in zip(*(b.column(k) for k in range(4)), strict=True):
                key, lead = key.as_py(), lead.as_py()
                if lead not in known:
                    if len(known) >= LEADERS:
                        known.clear()
                    known[lead] = shingles(first.as_py().encode(), words)
                x, y = shingles(text.as_py().encode(), words), known[lead]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similar * (len(x) + len(y) - both) - 1e-9:
                    a.append(key)
                    c.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return led.select("key", "lead", "text", "first").mapInArrow(lean(check), "a long, b long")


def standing_apart(members: DataFrame, found: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """(a, b): links of the texts that are in a bucket but not in ``found(key, root)``'s largest group of it."""
    placed = members.select("band", "key").join(small_side(found), "key", "left").select("band", "key", F.coalesce("root", "key").alias("v"))
    placed = materialise(placed)
    groups = placed.groupBy("band", "v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("h"))
    mixed = groups.groupBy("band").agg(F.count("*").alias("groups"), F.max_by("v", F.struct("n", "v")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("h").alias("h"))
    # Bands whose buckets hold the same texts are one bucket.
    mixed = mixed.where("groups > 1").groupBy("n", "h").agg(F.min_by(F.struct("band", "largest", "most"), "band").alias("b")).select("b.*")
    mixed = small_side(materialise(mixed))
    rows = placed.join(mixed, "band").join(texts, "key").withColumn("apart", F.col("v") != F.col("largest"))
    rows = materialise(rows.select("band", "key", "text", "apart"))
    blocks = lambda of: F.greatest(F.lit(1), F.ceil(F.count(of) / BLOCK_ROWS), F.ceil(F.sum(F.when(of, F.length("text"))) / BLOCK_CHARS)).cast("int")
    sizes = rows.groupBy("band").agg(blocks(F.when(F.lit(True), F.lit(True))).alias("all"), blocks(F.when(F.col("apart"), F.lit(True))).alias("some"))
    dealt = rows.join(small_side(materialise(sizes)), "band")
    place = lambda n: F.pmod(F.xxhash64("key", F.lit("block")), F.col(n)).cast("int")
    every = dealt.withColumn("i", place("all")).withColumn("j", F.explode(F.expr("sequence(0, some - 1)")))
    apart = dealt.where("apart").withColumn("j", place("some")).withColumn("i", F.explode(F.expr("sequence(0, all - 1)")))
    # Small buckets share a task.
    packs = 1 + rows.count() // BLOCK_ROWS
    pack = F.when((F.col("all") == 1) & (F.col("some") == 1), F.pmod("band", F.lit(packs))).otherwise(F.col("band"))
    out = [pack.alias("pack"), (F.col("all") + F.col("some") > 2).alias("large"), "i", "j", "band", "key", "text"]
    dealt = every.select(*out).unionByName(apart.where("all > 1 or some > 1").select(*out))

    def search(t: pa.Table) -> pa.Table:
        band, key, texts = t.column("band").to_numpy(), t.column("key").to_numpy(), t.column("text")
        order = np.lexsort((key, band))
        order = order[np.concatenate([[True], (np.diff(band[order]) != 0) | (np.diff(key[order]) != 0)])] if len(order) else order
        a, b = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            sets = [shingles(texts[int(i)].as_py().encode(), words) for i in rows]
            for x, y in exact_links(sets, similar) if sets else ():
                a.append(int(key[rows[x]]))
                b.append(int(key[rows[y]]))
        if t.nbytes > RELEASED:
            release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("pack", "large", "i", "j").applyInArrow(search, "a long, b long")


def near_copy_groups(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """(key, root) for every distinct text of ``docs`` with another in its group; key is text_key()."""
    own = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    members = materialise(buckets(materialise(signatures(own, words))))
    texts = own.join(small_side(materialise(members.select("key").distinct())), "key").dropDuplicates(["key"])
    texts = materialise(texts)
    near = materialise(with_leaders(members, texts, words, similar))
    found = materialise(components(near).select(F.col("node").alias("key"), "root"))
    edges = near.unionByName(standing_apart(members, found, texts, words, similar))
    return components(edges).select(F.col("node").alias("key"), "root")


def keep_one_near(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, as common.keep_first() chooses it.

    Rows are told apart by doc_id and text together. Null, empty and blank texts are copies of each other; texts of any
    length are compared whole. Columns keep their names and values. An empty table gives an empty result.
    """
    grouped = small_side(materialise(near_copy_groups(docs, **options)))
    ids = docs.select("doc_id", text_key().alias("key"))
    named = ids.join(grouped, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))
    return keep_first(docs, materialise(named))
