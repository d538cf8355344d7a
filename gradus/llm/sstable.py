"""Token ids in sorted-string-table shards.

A shard holds its documents by ascending key in blocks. An entry stores only
the part of its key that differs from the entry before it. After the blocks
come a sparse index (last key, place and length of each block), a Bloom filter
of the keys and a fixed-size footer, so one document is found by a binary
search and one block read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm._memory import tidy
from gradus.llm._tokens import encoded, encoder
from gradus.plans.scratch import Scratch, partitions

MAGIC = b"GRADSST1"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES = 1 << 14
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = raw[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_HASHES)]


class TableWriter:
    """Writes entries that come by ascending key; equal keys may follow each other."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.at, self.block, self.last = 0, bytearray(), b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_ids = 0
        self._write(MAGIC)

    def _write(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.astype(f"<u{self.width}").tobytes()
        same = 0
        if self.block:
            while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
                same += 1
        self.block += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.index.append((self.last, self.at, len(self.block)))
            self._write(bytes(self.block))
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._write(b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index))
        bloom_at, bits = self.at, max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = True
        self._write(struct.pack("<Q", bits) + np.packbits(bloom).tobytes())
        self._write(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, len(self.keys), self.n_ids, self.width, MAGIC))
        self.sink.close()


def open_uri(uri: str, mode: str):
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    if mode == "w":
        where.create_dir(path.rpartition("/")[0], recursive=True)
        return where.open_output_stream(path)
    return where.open_input_file(path)


class TableReader:
    """Looks up or scans one shard; only the footer, index and filter stay in memory."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        source.seek(index_at)
        raw, at = source.read(index_n), 0
        self.last_keys, self.blocks = [], []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.last_keys.append(raw[at : at + n])
            self.blocks.append(struct.unpack_from("<QQ", raw, at + n))
            at += n + 16
        source.seek(bloom_at)
        raw = source.read(bloom_n)
        (self.bits,) = struct.unpack_from("<Q", raw)
        self.bloom = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8)).astype(bool)

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        place, n = self.blocks[block]
        self.source.seek(place)
        raw, at, key = self.source.read(n), 0, b""
        while at < n:
            same, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:same] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, f"<u{self.width}", size // self.width, at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.blocks)):
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of this key; none if it isn't there."""
        key, found = key_of(doc_id), []
        if not self.bloom[_bloom_places(key, self.bits)].all():
            return found
        for block in range(bisect_left(self.last_keys, key), len(self.blocks)):
            for k, ids in self._entries(block):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode whole texts and write them as shards in ascending doc_id order.

    Returns one row a shard that isn't empty: shard (their order is the ids'),
    path, n_docs, n_ids. A retried task writes under another name and only the
    finished one's is returned, so a lost executor leaves no half-written shard
    in use. Null doc_ids come first, repeated ones stand by text; null text is
    empty; other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = source.repartitionByRange(shards or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId(), None
        path = f"{folder}/{shard:08d}-{uuid.uuid4().hex}.sst"
        for b in batches:
            names = b.column(0).to_pylist()
            for i, ids in encoded(b, "text", tokenizer):
                if writer is None:
                    wide = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) > 65536
                    writer = TableWriter(open_uri(path, "w"), 4 if wide else 2, block_bytes)
                writer.add(names[i], np.append(ids, np.uint32(end_id)))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids]})

    return dealt.mapInArrow(tidy(run, tokenizer), "shard long, path string, n_docs long, n_ids long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' files.

    start counts the ids of all documents before it. The running sum spans one
    row a shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed = placed.select("shard", "path", "base").repartitionByRange(partitions(manifest.sparkSession), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                with open_uri(path, "r") as f:
                    rows = []
                    for doc_id, ids in TableReader(f).scan():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the shards to the shared folder, then give what is read back from them."""
    scratch = Scratch(spark, "sstable")
    manifest = scratch.save(write_shards(docs, scratch.path("shards"), tokenizer, end_id), "manifest")
    return read_shards(manifest)
