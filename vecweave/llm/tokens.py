"""Token ids in binary files of independent zstandard frames.

A file is a zstandard stream in the public seekable format: one frame for each document (with zstandard's own content
checksum), a skippable frame with the doc_ids and a JSON header, and last a skippable frame that holds the seek table:
compressed size, decompressed size and the low 32 bits of XXH64 of the decompressed bytes of every frame, then the
number of frames, a descriptor byte and the magic number. A reader finds a document's frame by the table and
decompresses nothing else.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise, shared_path, table, tune

END_ID = 2
LEVEL = 1
#: Pieces whose ids a Python worker remembers, for one task or from task to task, in each of two generations; when the younger is full it becomes the older
#: one, and pieces met again move back to the younger, so frequent ones are never forgotten.
PIECES, KEPT_PIECES = 200_000, 600_000
#: Fixed values of zstandard's seekable format.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC, WITH_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Whole texts to ids with one tokenizer file.

    Where the file asks for byte-level pre-tokenization and nothing else, texts are cut by that fixed pattern and each
    distinct piece goes through the library's model once; a worker remembers the PIECES latest at least. Texts that hold a special
    token's string, and all texts of any other kind of tokenizer, go to the library whole.
    """

    #: The pattern of byte-level pre-tokenization, and the same for texts of Latin-1 letters without NUMBERS, where it is faster.
    cuts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    latin_cuts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    numbers = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0100-\U0010ffff]")

    def __init__(self, path: str, remembered: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        pre = about.get("pre_tokenizer") or {}
        self.direct = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not about.get("normalizer")
        self.added = [t["content"] for t in about.get("added_tokens") or []]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letters, self.pieces, self.older, self.remembered = byte_letters(), {}, {}, remembered

    def learn(self, piece: str) -> bytes:
        got = self.pieces.get(piece) or self.older.get(piece)
        if got is None:
            ids = [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            got = np.array(ids, self.dtype).tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= self.remembered:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def __call__(self, text: str) -> bytes:
        if not self.direct or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        cut = (self.cuts if self.numbers.search(text) else self.latin_cuts).findall(text)
        ids = list(map(self.pieces.get, cut))
        if None in ids:
            for k, got in enumerate(ids):
                if got is None:
                    ids[k] = self.learn(cut[k])
        return b"".join(ids)


_kept: dict[str, Encoder] = {}


def encoder(path: str, keep: bool) -> Encoder:
    """An encoder for one task, or the one that this worker keeps from task to task, with the pieces it remembers."""
    if not keep:
        return Encoder(path)
    if path not in _kept:
        _kept.clear()
        _kept[path] = Encoder(path, KEPT_PIECES)
    return _kept[path]


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def skippable(body: bytes, magic: int = SKIPPABLE) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class SeekWriter:
    """Appends frames to a stream and closes it with the ids and the seek table."""

    def __init__(self, out, dtype: np.dtype, level: int = LEVEL):
        self.out, self.dtype, self.table, self.ids, self.n_ids = out, dtype, [], [], 0
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.n_ids += len(raw) // self.dtype.itemsize

    def close(self) -> None:
        ids = np.array([0 if x is None else x for x in self.ids], "<i8").tobytes()
        null = [k for k, x in enumerate(self.ids) if x is None]
        head = json.dumps({"dtype": self.dtype.str, "docs": len(self.ids), "null_ids": null}).encode()
        index = skippable(struct.pack("<I", len(head)) + head + ids)
        self.out.write(index)
        rows = [*self.table, (len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *x) for x in rows) + struct.pack("<IBI", len(rows), WITH_CHECKSUM, SEEK_MAGIC)
        self.out.write(skippable(body, SEEK_SKIPPABLE))


class SeekReader:
    """Random access to the documents of one file; each is checked against the table and zstandard's own checksum."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or not flags & WITH_CHECKSUM:
            raise ValueError("no seek table with checksums at the end of the file")
        file.seek(size - 9 - 12 * n)
        rows = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = rows[:-1, 0], rows[:-1, 1], rows[:-1, 2]
        self.at = np.concatenate([[0], np.cumsum(rows[:, 0])])
        file.seek(int(self.at[n - 1]))
        magic, length = struct.unpack("<II", file.read(8))
        body = file.read(length)
        head_size = struct.unpack("<I", body[:4])[0]
        head = json.loads(body[4 : 4 + head_size])
        self.dtype = np.dtype(head["dtype"])
        self.ids = np.frombuffer(body[4 + head_size :], "<i8").tolist()
        for k in head["null_ids"]:
            self.ids[k] = None
        self.starts = np.concatenate([[0], np.cumsum(self.raw // self.dtype.itemsize)])
        self.unpack = zstandard.ZstdDecompressor()

    def check(self, k: int, frame: bytes) -> np.ndarray:
        raw = self.unpack.decompress(frame, max_output_size=max(1, int(self.raw[k])))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} doesn't match the seek table")
        return np.frombuffer(raw, self.dtype)

    def get(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file; no other frame is read."""
        self.file.seek(int(self.at[k]))
        return self.check(k, self.file.read(int(self.sizes[k])))

    def all(self, block: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every document in order, reading about ``block`` bytes at a time."""
        k, n = 0, len(self.ids)
        while k < n:
            upto = max(k + 1, int(np.searchsorted(self.at, self.at[k] + block, "right")) - 1)
            upto = min(upto, n)
            self.file.seek(int(self.at[k]))
            part = self.file.read(int(self.at[upto] - self.at[k]))
            for i in range(k, upto):
                a = int(self.at[i] - self.at[k])
                yield i, self.check(i, part[a : a + int(self.sizes[i])])
            k = upto


def write_tokens(docs: DataFrame, out_dir: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, keep: bool = False) -> DataFrame:
    """Encode (doc_id, text) and write the files; returns the manifest: part, path, n_docs, n_ids, start.

    ``start`` counts the ids of all files before it. Rows are dealt by ranges of doc_id (null first), each range is
    sorted and goes to one file. A file's name holds the task's attempt, and only files of successful attempts get into
    the manifest, so lost or repeated tasks leave no wrong data. Null text counts as empty: only the end id is written.
    Rows with equal doc_id stand next to each other. Further columns of ``docs`` aren't read, so their names don't matter.
    An empty table gives an empty manifest. With ``keep`` workers keep the tokenizer and up to about 250 MB of pieces between
    tasks, which saves a third of the time; without, they are free for what comes next.
    """
    spark = tune(docs.sparkSession)
    out_dir = out_dir or shared_path(spark, "tokens")
    path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, keep)
        end = np.array([end_id], encode.dtype).tobytes()
        out, sink, name = None, None, ""
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), map(encode, [x or "" for x in b.column(1).to_pylist()]), strict=True):
                if sink is None:
                    fs, base = open_fs(out_dir)
                    fs.create_dir(base, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                    sink = SeekWriter(out, encode.dtype)
                sink.add(doc_id, ids + end)
        if sink is not None:
            sink.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{out_dir}/{name}"], "n_docs": [len(sink.ids)], "n_ids": [sink.n_ids]})

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = materialise(dealt.mapInArrow(lean(write), "part int, path string, n_docs long, n_ids long"))
    # One row for each file, so a running sum over the manifest is small.
    start = F.expr("coalesce(sum(n_ids) over (order by part rows between unbounded preceding and 1 preceding), 0L)")
    return materialise(files.withColumn("start", start))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: doc_id, start, ids (unsigned 32-bit, little-endian, as binary) of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, base = open_fs(path)
                with fs.open_input_file(base) as f:
                    reader, held, size = SeekReader(f), [], 0
                    for k, ids in reader.all():
                        held.append((reader.ids[k], start + int(reader.starts[k]), ids.astype("<u4").tobytes()))
                        size += len(held[-1][2])
                        if size > 4 << 20:
                            yield batch(held)
                            held, size = [], 0
                    if held:
                        yield batch(held)

    def batch(rows):
        a, s, x = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.binary())], ["doc_id", "start", "ids"])

    files = manifest.select("path", "start")
    return spread(files).mapInArrow(lean(read), "doc_id long, start long, ids binary")


def spread(files: DataFrame) -> DataFrame:
    """One task for each few files."""
    n = max(1, files.count())
    return files.repartition(min(n, 4096))


def digest_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, computed from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, base = open_fs(path)
                with fs.open_input_file(base) as f:
                    reader = SeekReader(f)
                    sums = [zlib.crc32(ids.astype("<u4")) for _, ids in reader.all()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.ids, pa.int64()), pa.array(reader.starts[:-1] + start, pa.int64()), pa.array(np.diff(reader.starts), pa.int64()), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spread(manifest.select("path", "start")).mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the files.

    Null or empty text gives the end id alone; an empty table gives no row; repeated rows each get a place of their own.
    """
    return digest_tokens(write_tokens(table(spark, sf_dir, "documents"), keep=True))
