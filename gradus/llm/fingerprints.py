"""One-permutation MinHash fingerprints with optimal densification and packed low bits."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm._words import mix, prefix_hash, shingles, slices, span_hash, strings, words
from gradus.plans.scratch import partitions

BINS, BITS, WIDTH = 512, 4, 5
_EMPTY = np.uint64(2**64 - 1)


def _probe(bins: int, attempt: int) -> np.ndarray:
    at = np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt * 0xD1B54A32D192ED03 % 2**64)
    return (mix(at) % np.uint64(bins)).astype(np.int64)


def densify(table: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first non-empty bin of its own fixed random walk.

    The walk depends on the bin alone, so two sets borrow alike. Rows without
    any value stay empty.
    """
    full = table != _EMPTY
    n_full = full.sum(1)
    single = n_full == 1
    table[single] = table[single].min(1, keepdims=True)
    row, bin_ = np.nonzero(~full & (n_full > 1)[:, None])
    source, attempt = table.copy(), 1
    while len(row):
        other = _probe(table.shape[1], attempt)[bin_]
        hit = full[row, other]
        table[row[hit], bin_[hit]] = source[row[hit], other[hit]]
        row, bin_, attempt = row[~hit], bin_[~hit], attempt + 1
    return table


def signatures(shingle: np.ndarray, doc: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """(n, bins) least shingle hash of each bin, densified; all ones where a text has no word."""
    table = np.full(n * bins, _EMPTY, np.uint64)
    bin_ = (shingle >> np.uint64(64 - int(bins).bit_length() + 1)).astype(np.int64)
    np.minimum.at(table, doc * bins + bin_, mix(shingle) & np.uint64(2**63 - 1))
    return densify(table.reshape(n, bins))


def low_bits(table: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of every bin's value, mixed with the bin, so that bins that borrow one value agree by chance one by one."""
    own = np.arange(table.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(table ^ own) & np.uint64(2**bits - 1)).astype(np.uint8)


def text_shingles(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(buf, offsets)
    return shingles(span_hash(prefix_hash(buf), start, end), first, width)


def fingerprint_arrays(buf: np.ndarray, offsets: np.ndarray, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(n, bins) low ``bits`` of the signature of each text, and which texts have words."""
    n = len(offsets) - 1
    low, some = np.zeros((n, bins), np.uint8), np.zeros(n, bool)
    for lo, hi in slices(offsets):
        for at in range(lo, hi, 1000):
            to = min(hi, at + 1000)
            shingle, doc = text_shingles(buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            table = signatures(shingle, doc, to - at, bins)
            some[at:to] = table[:, 0] != _EMPTY
            low[at:to] = low_bits(table, bits)
    low[~some] = 0
    return low, some


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Base64 of the low bits of all bins; '' for a text without words."""
    wide = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), -1)
    return [base64.b64encode(x.tobytes()).decode() if y else "" for x, y in zip(np.packbits(wide, axis=1), some)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Jaccard estimate corrected for low bits that agree by chance, in [0, 1].

    Two texts without words are alike (1), one without and one with are not (0).
    """
    chance = 2.0**-bits
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below key, by binary search (bounds ascend)."""
    if not bounds:
        return F.lit(0)
    array = F.array(*(F.lit(b).cast("long") for b in bounds))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(array, mid) < key
        done = acc["lo"] >= acc["hi"]
        return F.struct(F.when(done | ~below, acc["lo"]).otherwise(mid + 1).alias("lo"), F.when(done | below, acc["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(steps, start, step, lambda acc: acc["lo"])


def with_next(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """Documents in runs of ascending doc_id, each run closed by a copy of the next run's first.

    Columns bucket, closing, doc_id, text; partitions hold whole buckets, sorted.
    The last run is closed by the first document of all. Bounds and first ids
    are lists of one number a bucket; texts move once.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    n = partitions(spark) * buckets_per_partition
    shares = [i / n for i in range(1, n)]
    found = source.agg(F.percentile_approx("key", shares, 20 * n).alias("b")).first()["b"] or []
    key_bucket = _bucket(F.col("key"), sorted(set(found)))
    firsts = {r["bucket"]: r["first"] for r in source.select("key", key_bucket.alias("bucket")).groupBy("bucket").agg(F.min("key").alias("first")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    size = max(order, default=0) + 1
    first_of = F.array(*(F.lit(firsts.get(b)).cast("long") for b in range(size)))
    prior_of = F.array(*(F.lit(before.get(b)).cast("int") for b in range(size)))
    here = source.withColumn("own", key_bucket)
    also = F.when(F.get(first_of, F.col("own")) == F.col("key"), F.get(prior_of, F.col("own")))
    places = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("closing")), F.when(also.isNotNull(), F.struct(also.alias("bucket"), F.lit(1).alias("closing")))))
    moved = here.withColumn("place", F.explode(places)).select("place.bucket", "place.closing", "key", "doc_id", "text")
    return moved.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "closing", "key", F.col("doc_id").isNotNull(), "text").drop("key")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def _judge(bucket: list[int], closing: list[int], doc_id: list, text: list[str], low: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
    at = [i for i in range(len(text) - 1) if not closing[i]]
    own, after = np.array(at, int), np.array(at, int) + 1
    edited = [text[i][: len(text[i]) - len(text[i]) // 2] + text[i + 1][: len(text[i]) // 2] for i in at]
    e_low, e_some = fingerprint_arrays(*_joined(edited))
    columns = {
        "doc_id": pa.array([doc_id[i] for i in at], pa.int64()),
        "n_chars": pa.array([len(text[i]) for i in at], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        "fingerprint": pa.array(packed(low[own], some[own]), pa.string()),
        "edited_fingerprint": pa.array(packed(e_low, e_some), pa.string()),
        "near_edited": pa.array(likeness(low[own], e_low, some[own], e_some), pa.float64()),
        "near_next": pa.array(likeness(low[own], low[after], some[own], some[after]), pa.float64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.RecordBatch | None = None
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            b = whole.slice(lo, 1000)
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            low, some = fingerprint_arrays(*strings(b, "text"))
            yield _judge(*(b.column(i).to_pylist() for i in range(4)), low, some)
            held = b.slice(b.num_rows - 1)


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and three-way likeness.

    The edited text ends in as many code points of the next document (ascending
    doc_id; null first, equal ids by text, after the last the first) as were cut
    off. Shingles are five words between ASCII white space; a shorter text is one
    shingle; a text without words has fingerprint ''. Null text is empty, an
    empty table gives no rows, other columns are ignored.
    """
    return with_next(docs).mapInArrow(_run, RESULT)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint alone, without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, some = fingerprint_arrays(*strings(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed(low, some), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")
