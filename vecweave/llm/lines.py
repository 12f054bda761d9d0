"""Line dedup by a sharded minimal perfect hash over the hashes of repeated lines.

Each document gives the 128-bit hashes of its different keys (a key is a line without the white space at its ends, A-Z
lower-cased), and counting them leaves the distinct hashes that enough documents hold. These are dealt to shards by hash,
and each shard becomes a minimal perfect hash: bit arrays in levels, where a hash that is alone at its bit stays and the
others go on to the next level. The number of set bits before a hash's own is its place in three arrays: fingerprints
(the other 64 bits, which tell foreign lines), numbers of documents, and the largest doc_id. Documents probe the arrays.

All shards together take about 20 bytes a repeated line. While that is at most ARRAYS_BYTES, as a sum over the shards
shows, every task holds all of them and a document is read, probed and written in one pass. Beyond, the hashes of
documents are dealt to the shards (hot ones over SALTS tasks), probed there as a stream, and only hits travel back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import lean, materialise, mix64, table, text_key, tune

MIN_DOCS, MIN_CHARS = 3, 20
#: Hashes a shard aims at, and bits for each hash that a level starts with.
SHARD_KEYS, ROOM = 65_536, 2
#: Bytes of all shards up to which each task holds them all, and how many tasks share a shard beyond.
ARRAYS_BYTES, SALTS = 32 << 20, 16

SPACE = b" \t\n\x0b\x0c\r"
_CONTINUES = bytes(range(0x80, 0xC0))  # bytes that begin no code point
_ARRAYS = "shard int, n long, sizes array<int>, bits binary, prints binary, counts binary, keepers binary"


def line_keys(text: bytes, least: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and the 16-byte hash of each one's key, None where the key has fewer than ``least`` code points."""
    lines, hashes = text.split(b"\n"), []
    for line in text.lower().split(b"\n"):  # of bytes, lower() changes A-Z only
        key = line.strip(SPACE)
        short = len(key) < least or (len(key) < 4 * least and len(key.translate(None, _CONTINUES)) < least)
        hashes.append(None if short else xxhash.xxh3_128_digest(key))
    return lines, hashes


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    return (mix64(mix64(h1.view(np.uint64) + seed) + h2.view(np.uint64)) % np.uint64(size)).astype(np.int64)


class Shard:
    """A minimal perfect hash of distinct hashes and the arrays it indexes."""

    def __init__(self, sizes: list[int], bits: np.ndarray, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts, self.keepers = sizes, bits, prints, counts, keepers
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray, room: int = ROOM) -> Shard:
        h1, h2 = np.ascontiguousarray(h1), np.ascontiguousarray(h2)
        sizes, levels, left = [], [], np.arange(len(h1))
        while len(left):
            size = -(-room * len(left) // 64) * 64
            at = _places(h1[left], h2[left], len(sizes), size)
            taken = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(taken, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~taken[at]]
        out = cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"), h2, counts, keepers)
        order = np.argsort(out.index(h1, h2))
        out.prints, out.counts, out.keepers = h2[order], np.minimum(counts, 2**32 - 1).astype("<u4")[order], keepers[order]
        return out

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each hash's place; of a foreign hash some place or -1."""
        out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = base + _places(h1[left], h2[left], level, size)
            word, low = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> low & np.uint64(1)).astype(bool)
            inside = np.bitwise_count(word[hit] & ((np.uint64(1) << low[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + inside
            left, base = left[~hit], base + size
        return out

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of documents, keeper) of each hash, zero and no keeper for those that aren't indexed."""
        if not len(self.prints):
            return np.zeros(len(h1), np.int64), np.full(len(h1), NOBODY)
        at = self.index(h1, h2)
        known = (at >= 0) & (self.prints[at] == h2)
        return np.where(known, self.counts[at], 0).astype(np.int64), np.where(known, self.keepers[at], NOBODY)

    def row(self) -> dict:
        return {"n": len(self.prints), "sizes": self.sizes, "bits": self.bits.tobytes(), "prints": self.prints.astype("<i8").tobytes(), "counts": self.counts.tobytes(), "keepers": self.keepers.astype("<i8").tobytes()}

    @classmethod
    def of_row(cls, r: dict) -> Shard:
        return cls(r["sizes"], np.frombuffer(r["bits"], "<u8"), np.frombuffer(r["prints"], "<i8"), np.frombuffer(r["counts"], "<u4"), np.frombuffer(r["keepers"], "<i8"))


#: Stands for no doc_id in the arrays of keepers; a keeper of a line that only documents without an id hold.
NOBODY = np.iinfo(np.int64).min


def _hashed(docs: DataFrame, least: int) -> DataFrame:
    """(d, k, h1, h2): each different key of each row once; k tells the texts of a doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(2)):
                mine = {h for h in line_keys(text.as_py() or b"", least)[1] if h}
                found += mine
                at += [i] * len(mine)
            rows = pa.array(at, pa.int32())
            h1, h2 = halves(found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(h1), pa.array(h2)], ["d", "k", "h1", "h2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), text_key().alias("k"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "d long, k long, h1 long, h2 long")


def line_index(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row for each shard: its minimal perfect hash and arrays, over the distinct hashes of lines in at least ``min_docs`` rows."""
    counted = _hashed(docs, least).groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("d").alias("keeper"))
    keys = materialise(counted.where(F.col("docs") >= min_docs))
    shards = max(1, -(-keys.count() // shard_keys))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        h1, h2, docs, keeper = (rows.column(c).to_numpy() for c in ("h1", "h2", "docs", "keeper"))
        shard = Shard.build(h1, h2, docs, keeper)
        return pa.Table.from_pylist([{"shard": key[0].as_py(), **shard.row()}], _SCHEMA)

    keys = keys.select(F.expr(f"cast(pmod(h1, {shards}) as int)").alias("shard"), "h1", "h2", "docs", F.coalesce("keeper", F.lit(int(NOBODY))).alias("keeper"))
    return materialise(keys.groupBy("shard").applyInArrow(build, _ARRAYS).withColumn("shards", F.lit(shards)))


_SCHEMA = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("keepers", pa.binary())])


def _lost(counts: np.ndarray, keepers: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
    return (counts >= min_docs) & (keepers != ids)


def _rewriter(decide, schema: StructType, least: int):
    """Rows (row, d, text, ...) with their lines cut down by ``decide(batch, at, hashes)``, which says of each hashed line,
    the at-th row's, whether it goes."""
    out = pa.schema([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [line_keys(x.as_py() or b"", least) for x in b.column(2)]
            at = np.array([i for i, (_, hs) in enumerate(whole) for h in hs if h], np.int64)
            gone = iter(decide(b, at, [h for _, hs in whole for h in hs if h]).tolist())
            kept = [[x for x, h in zip(lines, hs, strict=True) if not (h and next(gone))] for lines, hs in whole]
            n = [len(lines) for lines, _ in whole]
            new = [pa.array(n, out.field(0).type), pa.array([a - len(k) for a, k in zip(n, kept, strict=True)], out.field(1).type), pa.array([b"\n".join(k) for k in kept], out.field(2).type)]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], ["row", *out.names])

    return lean(run), StructType([schema["row"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("text", BinaryType())])


def _probed_here(rows: DataFrame, index: DataFrame, shards: int, min_docs: int, least: int) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast({r.shard: r.asDict() for r in index.drop("shards", "n").collect()})  # counted to be small
    made: dict[int, Shard] = {}

    def decide(b: pa.RecordBatch, at: np.ndarray, hashes: list[bytes]) -> np.ndarray:
        if not made:
            made.update({k: Shard.of_row(r) for k, r in held.value.items()})
        h1, h2 = halves(hashes)
        ids = b.column(1).fill_null(int(NOBODY)).to_numpy()[at]
        of, gone = np.mod(h1, shards), np.zeros(len(h1), bool)
        for k in np.unique(of).tolist():
            if k in made:
                mine = np.flatnonzero(of == k)
                gone[mine] = _lost(*made[k].probe(h1[mine], h2[mine]), ids[mine], min_docs)
        return gone

    run, schema = _rewriter(decide, rows.schema, least)
    return rows.mapInArrow(run, schema)


def _probed_at_shards(rows: DataFrame, docs: DataFrame, index: DataFrame, shards: int, min_docs: int, least: int, salts: int = SALTS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = shard = None
        for b in batches:
            cuts = [i for i, x in enumerate(b.column(6)) if x.is_valid]
            for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
                part = b.slice(lo, hi - lo)
                if len(part) and part.column(6)[0].is_valid:
                    name, shard, part = part.column(0)[0].as_py(), Shard.of_row(part.column(6)[0].as_py()), part.slice(1)
                part = part.filter(pc.equal(part.column(0), name)) if shard else part.slice(0, 0)  # a shard may have no arrays
                if len(part):
                    h1, h2 = part.column(4).to_numpy(), part.column(5).to_numpy()
                    gone = pa.array(_lost(*shard.probe(h1, h2), part.column(2).fill_null(int(NOBODY)).to_numpy(), min_docs))
                    hit = part.filter(gone)
                    digest = [a.to_bytes(8, "little", signed=True) + c.to_bytes(8, "little", signed=True) for a, c in zip(hit.column(4).to_pylist(), hit.column(5).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([hit.column(2), hit.column(3), pa.array(digest, pa.binary())], ["d", "k", "digest"])

    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *(F.lit(None).cast("long").alias(c) for c in ("d", "k", "h1", "h2")), F.struct("sizes", "bits", "prints", "counts", "keepers").alias("arrays"))
    lines = _hashed(docs, least).select(F.expr(f"cast(pmod(h1, {shards}) as int)").alias("shard"), F.pmod(F.hash("d", "k"), F.lit(salts)).alias("salt"), "d", "k", "h1", "h2", F.lit(None).cast(arrays.schema["arrays"].dataType).alias("arrays"))
    dealt = arrays.unionByName(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("arrays").isNull())
    # A row's hits come together again by what tells it apart; rows alike in that are alike in their hits.
    hits = dealt.mapInArrow(lean(run), "d long, k long, digest binary").groupBy("d", "k").agg(F.collect_set("digest").alias("lost"))

    def decide(b: pa.RecordBatch, at: np.ndarray, hashes: list[bytes]) -> np.ndarray:
        lost = [frozenset(x or ()) for x in b.column(3).to_pylist()]
        return np.array([h in lost[i] for i, h in zip(at.tolist(), hashes, strict=True)], bool)

    with_hits = rows.join(hits.select(F.col("d").alias("hd"), F.col("k").alias("hk"), "lost"), F.expr("d <=> hd and k = hk"), "left").select("row", "d", "text", "lost")
    rewrite, schema = _rewriter(decide, with_hits.schema, least)
    return with_hits.mapInArrow(rewrite, schema)


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = MIN_CHARS, arrays_bytes: int = ARRAYS_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with every line gone whose key has at least ``least`` code points and is found in at least ``min_docs``
    rows, but for the lines of the largest doc_id that holds it; n_lines (before) and n_dropped are added.

    A document is a row. Null or empty text is one empty line and comes back as empty text; texts of any length are read
    whole. Rows that share the largest doc_id, repeated rows among them, all keep the line. A null doc_id is smaller than
    any other, so where only rows without one hold a line, all of them keep it. All other columns come back as they are;
    columns named n_lines or n_dropped give way to the new ones. An empty table gives an empty table.
    """
    tune(docs.sparkSession)
    index = line_index(docs, min_docs, least, shard_keys)
    size, shards = index.agg(F.coalesce(F.sum(F.expr("length(bits) + length(prints) + length(counts) + length(keepers)")), F.lit(0)), F.coalesce(F.max("shards"), F.lit(1))).first()
    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), F.col("doc_id").cast("long").alias("d"), F.col("text").cast("binary").alias("text"), text_key().alias("k"))
    out = _probed_here(rows.select("row", "d", "text"), index, shards, min_docs, least) if size <= arrays_bytes else _probed_at_shards(rows, docs, index, shards, min_docs, least)
    return out.select(*rest, F.col("text").cast("string").alias("text"), "n_lines", "n_dropped")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after, and a digest of what is left."""
    found = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH x AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents),
y AS MATERIALIZED (SELECT doc_id, i, l[i] AS line, translate(trim(l[i], {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM x)),
c AS (SELECT k, max(doc_id) keeper FROM y WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
z AS (SELECT y.doc_id, i, line, c.k IS NOT NULL AND y.doc_id <> c.keeper AS gone FROM y LEFT JOIN c ON c.k = y.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM z GROUP BY doc_id
"""
