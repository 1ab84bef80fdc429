"""Token ids in sorted-string-table shards.

File: data blocks, then the Bloom filter, then the index, then a footer of fixed size. A key is a document's id as
eight bytes, big-endian with the sign turned, so that byte order is the order of ids; a null id is the empty key and
comes first. Inside a block a key is stored as the length of the prefix shared with the key before it and the rest;
every block starts with a whole key. The index has each block's last key, place, size, CRC-32 and the ids before it
in the shard. Documents are dealt by ranges of ids, so a shard holds one range and the shards' order is the ids'.

Defined results: a null or empty text is its end token alone; equal ids are stored one after the other, by text;
an empty table makes no shard; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, written
from .tokens import default_path, encoder

MAGIC = b"CHTSST01"
BLOCK_BYTES = 1 << 16
FOOTER = struct.Struct("<QQQQQQ8s")  # bloom place, index place, blocks, documents, ids, Bloom hashes, magic
BITS_A_KEY, HASHES = 10, 7


def filesystem(uri: str):
    """(file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Takes keys in order; close() ends the file."""

    def __init__(self, sink):
        self.sink, self.at, self.block, self.last = sink, 0, bytearray(), b""
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.n_ids = self.block_ids = 0

    def put(self, key: bytes, ids: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys out of order")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids) // 2
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = bytes(self.block)
            self.index.append((self.last, self.at, len(data), zlib.crc32(data), self.block_ids))
            self.sink.write(data)
            self.at += len(data)
            self.block, self.block_ids = bytearray(), self.n_ids

    def close(self) -> None:
        self.flush()
        bits = max(64, BITS_A_KEY * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[bloom_places(k, bits, HASHES)] = 1
        packed = np.packbits(bloom).tobytes()
        index = b"".join(varint(len(k)) + k + struct.pack("<QQIQ", *rest) for k, *rest in self.index)
        self.sink.write(packed + index + FOOTER.pack(self.at, self.at + len(packed), len(self.index), len(self.keys), self.n_ids, HASHES, MAGIC))


class Reader:
    """A shard: scan() gives (key, ids) in order; get(key) reads one block at most."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.bloom_at, index_at, blocks, self.n_docs, self.n_ids, self.hashes, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom_bytes = index_at - self.bloom_at
        data, at, self.index = source.read_at(size - FOOTER.size - index_at, index_at), 0, []
        for _ in range(blocks):
            n, at = read_varint(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QQIQ", data, at + n)))
            at += n + 28
        self.bloom: bytes | None = None

    def may_have(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self.source.read_at(self.bloom_bytes, self.bloom_at)
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_places(key, 8 * self.bloom_bytes, self.hashes))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, size, crc, _ = self.index[i]
        data, at, key = self.source.read_at(size, place), 0, b""
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        while at < len(data):
            shared, at = read_varint(data, at)
            more, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            yield key, data[at + more : at + more + n]
            at += more + n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, key: bytes) -> bytes | None:
        if not self.may_have(key):
            return None
        i = bisect_left(self.index, key, key=lambda x: x[0])
        return next((ids for k, ids in self.block(i) if k == key), None) if i < len(self.index) else None


def write_shards(documents: DataFrame, path: str, tokenizer: str | None = None, end: int = 0) -> DataFrame:
    """Writes the shards into path; gives their table: shard, file, n_docs, n_tokens, first and last key, base (ids in the shards before)."""
    spark = documents.sparkSession
    small_batches(spark)
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    vocabulary = tokenizer or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stop, writer = encoder(vocabulary, "runs"), np.array([end], "<u2").tobytes(), None
        shard = TaskContext.get().partitionId()
        file = f"{path}/{shard:06d}-{uuid.uuid4().hex}.sst"  # a task that runs again writes a file of its own
        fs, place = filesystem(file)
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text")), strict=True):
                if writer is None:
                    sink = fs.open_output_stream(place)
                    writer = Writer(sink)
                writer.put(key_of(doc_id), ids + stop)
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [file], "n_docs": [len(writer.keys)], "n_tokens": [writer.n_ids], "first": [writer.keys[0]], "last": [writer.keys[-1]]})

    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = written(rows.mapInArrow(run, "shard long, file string, n_docs long, n_tokens long, first binary, last binary"), "shards")
    return made.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))  # a row a shard


def read_shards(spark: SparkSession, shards: DataFrame, digests: bool = False) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, and ids (little-endian 16-bit) or their ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, place = filesystem(file)
                with fs.open_input_file(place) as source:
                    reader = Reader(source)
                    for i in range(len(reader.index)):
                        keys, ids = zip(*reader.block(i), strict=True)
                        n = np.array([len(x) // 2 for x in ids], np.int64)
                        last = pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], pa.int64()) if digests else pa.array(ids, pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array([id_of(k) for k in keys], pa.int64()), pa.array(base + reader.index[i][4] + np.cumsum(n) - n), pa.array(n), last], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"]
    return shards.select("file", "base").repartition(max(1, shards.count()), "file").mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digests else 'ids binary'}")


def lookup(shards: DataFrame, doc_id: int) -> bytes | None:
    """One document's ids: the shard by the keys that it begins and ends with, the block by Bloom filter and binary search."""
    key = key_of(doc_id)
    for r in shards.filter((F.col("first") <= F.lit(key)) & (F.col("last") >= F.lit(key))).select("file").collect():  # one row at most
        fs, place = filesystem(r["file"])
        with fs.open_input_file(place) as source:
            return Reader(source).get(key)
    return None


def round_trip(documents: DataFrame, tokenizer: str | None = None, end: int = 0) -> DataFrame:
    """Writes documents to new shards and gives, read from them: doc_id, start, n_tokens, ids_crc32."""
    spark = documents.sparkSession
    shards = write_shards(documents, new_path(spark, "sstables"), tokenizer, end)
    return read_shards(spark, shards, digests=True)
