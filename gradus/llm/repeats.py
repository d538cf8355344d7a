"""Removal of bytes that repeat 50-byte strings of earlier documents, by suffix sorting in content-dealt shards.

1. Each 50-byte window is named by the least hash of its 18-byte strings. Windows
   of one text with the same name form a segment. Equal windows have equal names
   wherever they stand, so dealing segments by name brings them together.
2. A shard keeps names that occur twice. Where all segments of a name are equal
   the earliest document decides at once; the texts of other segments, each
   distinct one once, are fetched from their documents.
3. A shard's names are dealt to parts of bounded bytes (a frequent name may exceed
   them). A part's distinct segments are sorted by external induced sorting;
   neighbours with a common-prefix value of 50 share a class, whose earliest
   document decides.
4. Removed stretches go back to their documents.

Segments travel as compressed columns of many rows, so a table row moves for
every batch and shard, not for every window.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm._groups import grouped
from gradus.llm._memory import tidy
from gradus.llm.induced import BLOCK, ORDERED, Queue, Sorter, Store, Tape, tuples
from gradus.llm._words import BASE, POWERS, mix, prefix_hash, slices, span_hash, strings
from gradus.plans.scratch import Scratch, partitions

WINDOW, SEED = 50, 18
FLUSH = 400_000
#: Text bytes that a shard of windows and a bucket of documents stand for; bytes of a sorted part, and memory of its sort.
SHARD_BYTES, BUCKET_BYTES, PART_BYTES, SORT_MEMORY = 16 << 20, 8 << 20, 2 << 20, 32 << 20
#: Windows of a segment, and windows (of all occurrences) that a shard looks at together.
MOST, TOGETHER = 64, 2_000_000
#: A document: its id (null is the least) and the hash of its text, so that rows of one id stay apart.
DOC = [("doc", "<i8"), ("text", "<i8")]
SPAN = [*DOC, ("pos", "<u4"), ("len", "<u4")]
#: A segment's name within its shard and 48 bits of its hash: 80 bits tell it from others.
SEGMENT = [*SPAN, ("name", "<u4"), ("same", "48")]
RAW = [("name", "<u4"), ("same", "48"), ("doc", "<i8"), ("len", "<u4")]


def _kept(kind: str) -> tuple[str, int]:
    """numpy type and bytes kept of it."""
    return ("<u8", 6) if kind == "48" else (kind, np.dtype(kind).itemsize)


def dump(columns: dict[str, np.ndarray], dtype: list) -> bytes:
    """Columns byte plane by byte plane, compressed."""
    n, planes = len(columns[dtype[0][0]]), []
    for k, kind in dtype:
        t, size = _kept(kind)
        planes.append(np.ascontiguousarray(columns[k].astype(t)).view(np.uint8).reshape(n, -1).T[:size].tobytes())
    return struct.pack("<Q", n) + zstandard.compress(b"".join(planes), 1)


def load(raws: list[bytes], dtype: list) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {k: [np.zeros(0, _kept(t)[0])] for k, t in dtype}
    for raw in raws:
        (n,) = struct.unpack_from("<Q", raw)
        body, at = zstandard.decompress(raw[8:], n * sum(_kept(t)[1] for _, t in dtype) or 1), 0
        for k, kind in dtype:
            t, size = _kept(kind)
            planes = np.zeros((n, np.dtype(t).itemsize), np.uint8)
            planes[:, :size] = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n).T
            parts[k].append(planes.view(t).ravel())
            at += n * size
    return {k: np.concatenate(v) for k, v in parts.items()}


def take(columns: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in columns.items()}


def split(columns: dict[str, np.ndarray], key: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    order = np.argsort(key, kind="stable")
    names, at = np.unique(key[order], return_index=True)
    for name, which in zip(names.tolist(), np.split(order, at[1:]) if len(names) else []):
        yield name, take(columns, which)


def segments(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """text number (doc), pos, len, 64-bit name and hash of every segment of the texts."""
    none = {k: np.zeros(0, np.int64) for k in ("doc", "pos", "len")} | {k: np.zeros(0, np.uint64) for k in ("name", "same")}
    if len(buf) < WINDOW:
        return none
    prefix = prefix_hash(buf)
    _, down = POWERS.of(len(prefix))
    n = len(buf) - SEED + 1
    least = mix((prefix[SEED:] - prefix[:-SEED]) * down[:n])
    wide, span = WINDOW - SEED + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    # a window that runs over its text's end doesn't count
    valid = np.zeros(len(buf) + 1, np.int32)
    whole = np.diff(offsets) >= WINDOW
    np.add.at(valid, offsets[:-1][whole], 1)
    np.add.at(valid, offsets[1:][whole] - WINDOW + 1, -1)
    valid = np.cumsum(valid)[: len(least)] > 0
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    edge = offsets[:-1][whole]
    begin[edge] = True
    start = np.flatnonzero(begin)
    # periodic text keeps one name for long: its segment is cut, so that none has more than MOST windows
    reach = np.minimum(np.append(start[1:], len(valid)), np.append(np.flatnonzero(~valid), len(valid))[np.searchsorted(np.flatnonzero(~valid), start)])
    parts = -(-(reach - start) // MOST)
    start = np.repeat(start, parts) + MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    text = np.searchsorted(offsets, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(buf)), offsets[text + 1] - WINDOW + 1) + WINDOW - 1
    # least hashes are small numbers: mixed again, they spread over the shards
    return {"doc": text, "pos": start - offsets[text], "len": stop - start, "name": mix(least[start] + np.uint64(1)), "same": span_hash(prefix, start, stop) >> np.uint64(16)}


def _deal(shards: int):
    """doc, text_hash, text → shard, columns of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                all_ = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
                held.clear()
                shard = ((all_["name"] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                rows = [(s, dump(c, SEGMENT)) for s, c in split(all_, shard.astype(np.int64))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "raw"])

        for b in batches:
            doc, text = np.asarray(b.column(0)), np.asarray(b.column(1))
            buf, offsets = strings(b, "text")
            for lo, hi in slices(offsets):
                got = segments(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                got["text"] = text[lo + got["doc"]]
                got["doc"] = doc[lo + got["doc"]]
                held.append(got)
                if sum(len(h["pos"]) for h in held) >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _bucket(columns: dict[str, np.ndarray], buckets: int) -> np.ndarray:
    return np.mod(columns["doc"].astype(np.int64) ^ columns["text"].astype(np.int64), buckets)


#: What a row of the shards' output holds.
DROP, FETCH, HELD = 0, 1, 2
PACKED = "kind long, at long, raw binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "at", "raw"])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _meet(buckets: int, part_bytes: int):
    """A shard's segments → stretches to drop (by document), segments to fetch (by document), mixed segments (by part).

    Names that must be sorted are dealt to as many parts as hold ``part_bytes`` each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 1):
            shard = t.column(0)[0].as_py()
            s = load(t.column("raw").to_pylist(), SEGMENT)
            order = np.argsort(s["name"], kind="stable")
            count = np.bincount(_runs(s["name"][order])) if len(order) else np.zeros(0, int)
            order = order[np.repeat(count > 1, count)]
            if not len(order):
                continue
            s = take(s, order)
            s = take(s, np.lexsort((s["text"], s["doc"], s["same"], s["name"])))
            name, same = _runs(s["name"]), _runs(s["name"], s["same"])
            first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
            kinds = np.bincount(name[first])
            mixed = kinds[name] > 1
            later = ~mixed & (s["doc"] > s["doc"][first][same])
            rows = []
            drop = take(s, later)
            rows += [(DROP, b, dump(c, SPAN)) for b, c in split(drop, _bucket(drop, buckets))]
            fetch, held = take(s, first[mixed[first]]), take(s, mixed)
            parts = 1 + int(fetch["len"].sum()) // part_bytes
            for kind, columns in ((FETCH, fetch), (HELD, held)):
                for part, own in split(columns, (columns["name"].astype(np.int64) * parts) >> 32):
                    at = shard << 24 | part
                    if kind == HELD:
                        rows.append((HELD, at, dump(own, SEGMENT)))
                    else:
                        rows += [(FETCH, b, struct.pack("<q", at) + dump(c, SEGMENT)) for b, c in split(own, _bucket(own, buckets))]
            if rows:
                yield _rows(rows)

    return run


def _documents(t: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    docs = t.filter(pa.compute.equal(t.column("kind"), 9))
    yield from zip(docs.column("doc").to_pylist(), docs.column("text_hash").to_pylist(), docs.column("raw").to_pylist())


def _by_document(columns: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    order = np.lexsort((columns["pos"], columns["text"], columns["doc"]))
    runs = _runs(columns["doc"][order], columns["text"][order]) if len(order) else order
    starts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(order) else order
    return {(int(columns["doc"][p[0]]), int(columns["text"][p[0]])): p for p in np.split(order, starts[1:]) if len(p)}


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's documents and requests → the segments' texts, by part."""
    for t in grouped(batches, 1):
        raws = t.filter(pa.compute.equal(t.column("kind"), FETCH)).column("raw").to_pylist()
        if not raws:
            continue
        parts = [load([r[8:]], SEGMENT) for r in raws]
        want = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        want["part"] = np.repeat([struct.unpack_from("<q", r)[0] for r in raws], [len(p["pos"]) for p in parts])
        at = _by_document(want)
        texts: list[bytes] = [b""] * len(want["pos"])
        for doc, text_hash, raw in _documents(t):
            for i in at.get((doc, text_hash), ()):
                texts[i] = raw[want["pos"][i] : want["pos"][i] + want["len"][i]]
        order = np.argsort(want["part"], kind="stable")
        part = want["part"][order]
        rows = []
        for p in np.split(order, np.flatnonzero(part[1:] != part[:-1]) + 1):
            head = dump(take(want, p), RAW)
            rows.append((FETCH, int(want["part"][p[0]]), struct.pack("<Q", len(head)) + head + zstandard.compress(b"".join(texts[i] for i in p), 1)))
        yield _rows(rows)


class Classes:
    """Suffixes with a common prefix of 50 bytes share a class; the earliest document of each, by position.

    Gets suffixes in order with the length of the prefix shared with the one
    before. What it keeps of them is on tapes and in a queue by position.
    """

    def __init__(self, store: Store, n: int, begin: np.ndarray, windows: np.ndarray, doc: np.ndarray):
        self.store, self.begin, self.windows, self.doc = store, begin, windows, doc
        width = max(BLOCK, n // 256 + 1)
        self.by_place = Queue(store, np.append(np.arange(0, n + 1, width), n + 1), ORDERED)
        self.earliest = Tape(store, "<i8")
        self.number, self.least = -1, np.iinfo(np.int64).max

    def add(self, pos: np.ndarray, shared: np.ndarray) -> None:
        kind = self.number + np.cumsum((shared < WINDOW) | (np.arange(len(pos)) + self.number < 0))
        if not len(pos):
            return
        owner = np.searchsorted(self.begin, pos, "right") - 1
        starts = pos - self.begin[owner] < self.windows[owner]  # else fewer than 50 bytes of its segment are left
        doc = np.where(starts, self.doc[owner], np.iinfo(np.int64).max)
        least = np.full(kind[-1] - max(self.number, 0) + 1, np.iinfo(np.int64).max)
        least[0] = self.least
        np.minimum.at(least, kind - max(self.number, 0), doc)
        self.earliest.append(least[:-1])
        self.number, self.least = int(kind[-1]), int(least[-1])
        self.by_place.push(tuples(ORDERED, pos[starts], kind[starts], 0))

    def finish(self) -> Tape:
        """The earliest document of every window, in the order of their places."""
        self.earliest.append(np.array([self.least]))
        self.earliest.finish()
        out = Tape(self.store, "<i8")
        for a in self.by_place.sorted_parts():
            out.append(self.earliest.gather(a["pos"].astype(np.int64)))
        self.earliest.drop()
        return out.finish()


def earliest_documents(store: Store, text: Tape, begin: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> Tape:
    """For each window of segments laid one after the other on a tape, the earliest document that has it."""
    classes = Classes(store, text.n, begin, windows, doc)
    Sorter(store, WINDOW, max(1, store.memory // 32)).sort(text, classes.add)
    return classes.finish()


def _sort(buckets: int, folder: str, memory: int):
    """A part's distinct segments and all occurrences of them → stretches to drop, by document."""

    def part_drops(t: pa.Table, store: Store) -> Iterator[pa.RecordBatch]:
        heads, text = [], Tape(store, np.uint8)
        for r in t.filter(pa.compute.equal(t.column("kind"), FETCH)).column("raw"):
            r = r.as_py()
            (n,) = struct.unpack_from("<Q", r)
            heads.append(load([r[8 : 8 + n]], RAW))
            text.append(np.frombuffer(zstandard.decompress(r[8 + n :], int(heads[-1]["len"].sum()) or 1), np.uint8))
        if not heads:
            return
        text.finish()
        seg = {k: np.concatenate([h[k] for h in heads]) for k in heads[0]}
        windows = seg["len"].astype(np.int64) - WINDOW + 1
        base = np.cumsum(windows) - windows
        least = earliest_documents(store, text, np.cumsum(seg["len"].astype(np.int64)) - seg["len"], windows, seg["doc"])
        own_key = mix(seg["same"] + seg["name"].astype(np.uint64) * np.uint64(BASE))
        order = np.argsort(own_key)
        own_key = own_key[order]
        for r in t.filter(pa.compute.equal(t.column("kind"), HELD)).column("raw"):
            held = load([r.as_py()], SEGMENT)
            which = order[np.searchsorted(own_key, mix(held["same"] + held["name"].astype(np.uint64) * np.uint64(BASE)))]
            steps = np.cumsum(windows[which]) // TOGETHER
            edges = [0, *(np.flatnonzero(steps[1:] != steps[:-1]) + 1).tolist(), len(which)]
            for lo, hi in zip(edges, edges[1:]):
                w = which[lo:hi]
                part = {k: v[lo:hi] for k, v in held.items()}
                n = windows[w]
                owner = np.repeat(np.arange(len(w)), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                gone = least.gather(np.repeat(base[w], n) + inner) < part["doc"][owner]
                start = gone.copy()
                start[1:] &= ~gone[:-1] | (owner[1:] != owner[:-1])
                stop = gone.copy()
                stop[:-1] &= ~gone[1:] | (owner[1:] != owner[:-1])
                a, z = np.flatnonzero(start), np.flatnonzero(stop)
                own = owner[a]
                drop = {"doc": part["doc"][own], "text": part["text"][own], "pos": part["pos"][own] + inner[a], "len": inner[z] - inner[a] + WINDOW}
                if len(own):
                    yield _rows([(DROP, b, dump(c, SPAN)) for b, c in split(drop, _bucket(drop, buckets))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 1):
            store = Store(folder, memory)
            try:
                yield from part_drops(t, store)
            finally:
                store.close()

    return run


def cut(raw: bytes, pos: np.ndarray, length: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and maximal removed runs."""
    if not len(pos):
        return raw, 0, 0
    order = np.argsort(pos, kind="stable")
    pos, end = pos[order].astype(np.int64), np.maximum.accumulate(pos[order].astype(np.int64) + length[order])
    new = np.append(True, pos[1:] > end[:-1])
    starts = pos[new]
    ends = end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    kept = b"".join(raw[a:z] for a, z in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)]))
    return kept, int((ends - starts).sum()), len(starts)


def _apply(text_back: bool, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 1):
            spans = load(t.filter(pa.compute.equal(t.column("kind"), DROP)).column("raw").to_pylist(), SPAN)
            at = _by_document(spans)
            docs = t.filter(pa.compute.equal(t.column("kind"), 9)).combine_chunks()
            kept, removed, runs, sizes = [], [], [], []
            for doc, text_hash, raw in _documents(t):
                which = at.get((doc, text_hash), np.zeros(0, int))
                left, n, spans_n = cut(raw, spans["pos"][which], spans["len"][which])
                kept.append(left.decode("utf-8", "ignore") if text_back else hashlib.sha256(left).hexdigest())
                removed.append(n)
                runs.append(spans_n)
                sizes.append(len(raw))
            names = ["n_bytes", "n_removed", "n_spans"]
            own = [docs.column(i) for i in range(docs.num_columns - extra, docs.num_columns)]
            arrays = [pa.chunked_array([pa.array(x, pa.int64())]) for x in (sizes, removed, runs)] + [pa.chunked_array([pa.array(kept, pa.string())])]
            yield from pa.table([*arrays, *own], names=[*names, "kept", *docs.schema.names[docs.num_columns - extra :]]).combine_chunks().to_batches()

    return run


def without_repeats(docs: DataFrame, text_back: bool = True, part_bytes: int = PART_BYTES, memory: int = SORT_MEMORY) -> DataFrame:
    """Every document with its n_bytes, n_removed, n_spans and ``kept`` in addition to its own columns.

    A byte goes if a 50-byte string over it also starts in a document of smaller
    doc_id; all strings are judged on the input. ``kept`` is what is left as text
    (an incomplete UTF-8 character at a cut is left out) or, with text_back
    False, the SHA-256 of the bytes left.

    Null text is empty; null doc_ids count as one smallest id; rows of equal
    doc_id don't remove from each other; an empty table gives no rows. Own columns
    named like the results are replaced. Shards and buckets follow the bytes of
    the texts. A sorted part holds ``part_bytes`` of distinct segments unless one
    name has more; beyond ``memory`` its lists and queues go to the shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    n = partitions(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards, buckets = max(n, size // SHARD_BYTES), max(4 * n, size // BUCKET_BYTES)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"), *(F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns) if c != "text")
    )
    own = [c for c in named.columns if c.startswith("own_")]
    # copies of one text differ in doc, so they spread
    placed = named.withColumn("bucket", F.pmod(F.col("doc").bitwiseXOR(F.col("text_hash")), F.lit(buckets)))
    none = F.lit(None).cast("long")

    def sorted_by(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(n, key).sortWithinPartitions(key)

    def texts(*more: str) -> DataFrame:
        return placed.select("bucket", F.lit(9).cast("long").alias("kind"), F.col("text").cast("binary").alias("raw"), "doc", "text_hash", *more)

    def meet() -> DataFrame:
        return sorted_by(named.select("doc", "text_hash", "text").mapInArrow(tidy(_deal(shards)), "shard long, raw binary"), "shard").mapInArrow(tidy(_meet(buckets, part_bytes)), PACKED)

    def fetch() -> DataFrame:
        asked = met.where(F.col("kind") == FETCH).select(F.col("at").alias("bucket"), "kind", "raw", none.alias("doc"), none.alias("text_hash"))
        return sorted_by(texts().unionByName(asked), "bucket").mapInArrow(tidy(_fetch), PACKED)

    # no name holds a finished step's plan, so its shuffle files can go before the next
    met = scratch.save(meet(), "met")
    scratch.release()
    fetched = scratch.save(fetch(), "fetched")
    scratch.release()
    part = fetched.union(met.where(F.col("kind") == HELD)).select(F.col("at").alias("part"), "kind", "raw")
    late = scratch.save(sorted_by(part, "part").mapInArrow(tidy(_sort(buckets, scratch.path("sort"), memory)), PACKED), "sorted")
    drops = met.where(F.col("kind") == DROP).union(late).select(F.col("at").alias("bucket"), "kind", "raw")
    schema = "n_bytes long, n_removed long, n_spans long, kept string" + "".join(f", {c} {named.schema[c].dataType.simpleString()}" for c in own)
    out = sorted_by(texts(*own).unionByName(drops, allowMissingColumns=True), "bucket").mapInArrow(tidy(_apply(text_back, len(own))), schema)
    results = ["n_bytes", "n_removed", "n_spans", "kept"]
    return out.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns) if c != "text" and c not in results), *results)

