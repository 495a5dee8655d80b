"""Token-id files with a shared zstandard dictionary.

A data set is a folder of shards in ascending doc_id order. Each shard is one file:

    magic "TIDS0001", 1 byte id width (2 or 4), 32 bytes sha256 of the dictionary
    one zstandard frame a document: its ids as little-endian unsigned integers, compressed with the shared dictionary
    index: for each document doc_id int64, null flag uint8, offset uint64, length uint64, ids uint64 (column after column)
    trailer: index offset uint64, documents uint64, magic

The dictionary is trained on the serialized ids of a bounded sample. A short document is read by one seek: its frame stands at its
offset, and the dictionary hash tells whether the dictionary at hand is the right one. The folder also holds the dictionary and a
small Parquet table of the shards with the ids before each.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .token_count import split_at_spaces

MAGIC = b"TIDS0001"
END_ID = 2
LEVEL = 3
SAMPLE_DOCS, PIECE, PIECES, DICTIONARY_BYTES = 2_000, 4_096, 4_000, 65_536  # bounds of what the dictionary is trained on
RANGE_BYTES = 64 << 20  # text of a shard, about
KEPT = 800_000  # remembered chunks of a worker
#: Letters below U+0250, digits and marks of ASCII; over these and line feeds the byte-level pattern is PRE_TOKENS.
_LETTERS, _MARKS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~"
KNOWN = re.compile(rf" ?[{_LETTERS}0-9{_MARKS}][{_LETTERS}0-9{_MARKS}\n]*")
PRE_TOKENS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n+(?!\S)|\n+")
SHARDS = "_shards"


class _Ids(dict):
    """Serialized ids of chunks, encoded by the library when first asked for."""

    def __init__(self, encode, lead: str, kept: int):
        super().__init__()
        self.encode, self.lead, self.kept = encode, lead, kept

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(self.lead + chunk)
        if len(self) < self.kept and len(chunk) <= 64:
            self[chunk] = ids
        return ids


class IdEncoder:
    """Serialized ids of whole texts as ``tokenizers`` gives them.

    With the byte-level pattern a text is encoded chunk by chunk between spaces, each chunk by the library once for each worker; the ids are
    the same, as such a space always starts a pre-token. Texts with the string of an added token go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.code = "H" if self.width == 2 else "I"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_spaces = "ByteLevel(add_prefix_space=False" in repr(self.tokenizer.pre_tokenizer) and "use_regex=True" in repr(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.first, self.later, self.pieces = _Ids(self.chunk, "", KEPT // 20), _Ids(self.chunk, " ", KEPT), _Ids(self.piece, "", KEPT // 2)
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in own)
        self.alphabet = dict(zip(own, own, strict=True)) | {b: 256 + k for k, b in enumerate(rest)}
        self.merge = self.tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, led by its space if it has one: where its pre-tokens are known, each by the library's model once, which spares its pattern."""
        if not KNOWN.fullmatch(chunk):
            return self.whole(chunk)
        return b"".join(map(self.pieces.__getitem__, PRE_TOKENS.findall(chunk)))

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        return array(self.code, [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_spaces or any(t in text for t in self.added):
            return self.whole(text)
        chunks = split_at_spaces(text)
        return self.first[chunks[0]] + b"".join(map(self.later.__getitem__, chunks[1:]))


_ENCODERS: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI that all executors reach (file on a shared folder, hdfs, s3, gs), and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def train_dictionary(docs: DataFrame, tokenizer_path: str, count: int | None = None) -> bytes:
    """A dictionary from the ids of a seeded sample of documents; b"" where nothing can be trained.

    About SAMPLE_DOCS documents are drawn by id and text, equal rows once; their whole ids are cut into pieces of PIECE bytes, of which a
    draw by hash keeps about PIECES. The dictionary shapes the size of the files alone, never what is read from them.
    """
    import zstandard

    count = docs.count() if count is None else count
    below = lambda share: int(min(1.0, share) * (1 << 30))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < below(SAMPLE_DOCS / max(count, 1))
    sample = docs.filter(drawn & F.col("text").isNotNull()).select("text").dropDuplicates()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            whole = [encode(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([w[i : i + PIECE] for w in whole for i in range(0, len(w), PIECE)], pa.binary())], names=["ids"])

    pieces = written(sample.mapInArrow(ids, "ids binary").dropDuplicates(), "dictionary-sample")
    kept = pieces.filter(F.pmod(F.xxhash64("ids", F.lit("piece")), F.lit(1 << 30)) < below(PIECES / max(pieces.count(), 1)))
    samples = sorted(bytes(r.ids) for r in kept.collect())
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(512, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes themselves serve
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) to the folder ``path`` and returns its table of shards.

    Texts are encoded whole, null as empty, and each ends with ``end_id``. doc_id ascends over the shards, null first; rows with one doc_id
    stand by a hash of their text, by which such a row may also fall into the next shard, then by text. A text is one row of a task, however long: its ids
    and its frame stand in memory at once, and nothing else of that length does. A shard is written under a name of its attempt and then renamed, so a
    task that runs again replaces its file whole; attempts that were cut off leave hidden files, which readers never open. Shards hold about RANGE_BYTES
    of text where the session's shuffle partitions would hold more. Other columns are not read.
    """
    spark = docs.sparkSession
    sizes = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    dictionary = train_dictionary(docs, tokenizer_path, sizes.n)
    digest = hashlib.sha256(dictionary).digest()
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/dictionary.zstd") as f:
        f.write(dictionary)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True).compress
        store, folder = _store(path)
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}.tids"
        attempt = f"{folder}/.{name}.{uuid.uuid4().hex}"
        out, at, index = None, 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    out = store.open_output_stream(attempt)
                    at = out.write(MAGIC + bytes([enc.width]) + digest)
                ids = enc.encode(text.as_py()) + end
                frame = pack(ids)
                out.write(frame)
                index.append((doc_id or 0, doc_id is None, at, len(frame), len(ids) // enc.width))
                at += len(frame)
        if out is None:
            return
        columns = zip(*index, strict=True)
        for column, kind in zip(columns, ("<i8", "u1", "<u8", "<u8", "<u8"), strict=True):
            out.write(np.array(column, kind).tobytes())
        out.write(struct.pack("<QQ", at, len(index)) + MAGIC)
        out.close()
        store.move(attempt, f"{folder}/{name}")
        row = [number], [name], [len(index)], [sum(i[4] for i in index)]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())], names=["number", "name", "docs", "ids"])

    ranges = (sizes.bytes or 0) // RANGE_BYTES
    some = [ranges] if ranges > int(spark.conf.get("spark.sql.shuffle.partitions")) else []  # else Spark merges small ones by itself
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    ordered = keyed.repartitionByRange(*some, "doc_id", "key").sortWithinPartitions("doc_id", "key", "text").drop("key")
    ordered.mapInArrow(shard, "number int, name string, docs long, ids long").write.parquet(posixpath.join(path, SHARDS))
    return shards(spark, path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """number, name, docs, ids and ids_before of each shard; one row a file, so its running sum is small."""
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema("number int, name string, docs long, ids long").parquet(posixpath.join(path, SHARDS))
    return rows.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class Shard:
    """One open shard: its index, and documents by place."""

    def __init__(self, store: pafs.FileSystem, file: str, dictionary: bytes):
        import zstandard

        self.f = store.open_input_file(file)
        size = self.f.size()
        head = self.f.read_at(9 + 32, 0)
        index_at, n = struct.unpack("<QQ", self.f.read_at(16, size - 24))
        if head[:8] != MAGIC or self.f.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{file} is not a whole token-id file")
        if head[9:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file} was written with another dictionary")
        self.dtype, self.n, rest = f"<u{head[8]}", n, self.f.read_at(size - 24 - index_at, index_at)
        kinds, at = (("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u8"), ("ids", "<u8")), 0
        self.index = {}
        for name, kind in kinds:
            self.index[name] = np.frombuffer(rest, kind, n, at)
            at += n * np.dtype(kind).itemsize
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress

    def read(self, first: int, last: int) -> list[np.ndarray]:
        """Ids of the documents in places first to last, exclusive, by one read."""
        at, length = self.index["offset"][first:last], self.index["length"][first:last]
        start = int(at[0])
        data = self.f.read_at(int(at[-1] + length[-1]) - start, start)
        view = memoryview(data)
        return [np.frombuffer(self.unpack(view[int(a) - start : int(a) - start + int(m)]), self.dtype) for a, m in zip(at, length, strict=True)]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the data set), n_tokens and ids_crc32 (over 32-bit ids) of every document, from the files."""
    import zlib

    table = shards(spark, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        with store.open_input_file(f"{folder}/dictionary.zstd") as f:
            dictionary = f.read()
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = Shard(store, f"{folder}/{name}", dictionary)
                starts = before + np.concatenate(([0], np.cumsum(one.index["ids"].astype(np.int64))[:-1]))
                for first in range(0, one.n, 512):
                    last = min(one.n, first + 512)
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in one.read(first, last)]
                    ids = pa.array(one.index["doc_id"][first:last], mask=one.index["null"][first:last].astype(bool))
                    n = pa.array(one.index["ids"][first:last].astype(np.int64))
                    columns = [ids, pa.array(starts[first:last]), n, pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, table.count())
    dealt = table.select("name", "ids_before").repartition(n)
    return dealt.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes the documents' ids to files under ``path`` (a new folder of the shared one if None) and returns what reading them gives."""
    path = path or scratch(docs.sparkSession, "token-ids")
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(docs.sparkSession, path)
