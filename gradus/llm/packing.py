"""Packing token streams into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm._memory import tidy
from gradus.llm._tokens import encoded
from gradus.plans.scratch import partitions

#: Pairs are looked at among items up to this many places apart in their part; an overflow is passed on so many times.
PAIRED, PASSES, FAR = 8, 32, np.iinfo(np.int64).max
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _merge(a: list, b: list, k: int, left: list, right: list) -> list:
    """Add two k-part partitions, largest parts of one to smallest of the other.

    A partition is its non-empty parts, largest first, as (size, node); a node
    below 0 is an item (~index), any other a pair in left/right.
    """
    over = max(0, len(a) + len(b) - k)
    out = a[: len(a) - over] + b[: len(b) - over]
    for (x, p), (y, q) in zip(a[len(a) - over :], reversed(b[len(b) - over :])):
        left.append(p)
        right.append(q)
        out.append((x + y, len(left) - 1))
    out.sort(reverse=True)
    return out


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into k parts of near-equal sums (largest differencing method).

    Always merges the two partial partitions with the widest spread. Ties go by
    order of making, so equal inputs give equal parts.
    """
    left: list[int] = []
    right: list[int] = []
    heap = [(-s, i, [(s, ~i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        c = _merge(a, b, k, left, right)
        heapq.heappush(heap, (-(c[0][0] - (c[-1][0] if len(c) == k else 0)), made, c))
        made += 1
    parts = []
    for _, node in heap[0][2] if heap else []:
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < 0:
                items.append(~x)
            else:
                stack += [right[x], left[x]]
        parts.append(items)
    return parts


def settled(parts: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]] | None:
    """Parts with the overflow of over-full ones exchanged for room of others; None where some stays.

    One or two items change places with none, one or two of another part so that the whole overflow falls; where
    nothing does, the overflow passes to another part, at most PASSES times.
    """
    nothing, k = len(sizes), len(parts)
    size = np.append(np.array(sizes, np.int64), 0)
    part_of = np.empty(nothing, np.int64)
    for p, items in enumerate(parts):
        part_of[items] = p
    room = capacity - np.bincount(part_of, size[:-1], k).astype(np.int64)

    def sets(pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two items (or nothing) each, and their part."""
        a, b = [np.arange(nothing), np.full(k, nothing)], [np.full(nothing + k, nothing)]
        if pairs:
            order = np.argsort(part_of, kind="stable")
            for gap in range(1, PAIRED):
                i = np.flatnonzero(part_of[order[gap:]] == part_of[order[:-gap]])
                a.append(order[i])
                b.append(order[i + gap])
        a, b = np.concatenate(a), np.concatenate(b)
        return a, b, np.where(a < nothing, part_of[np.minimum(a, nothing - 1)], np.arange(len(a)) - nothing)

    passed = 0
    while room[p := int(room.argmin())] < 0:
        for pairs in (False, True):
            a, b, part = sets(pairs)
            sums = size[a] + size[b]
            own = np.flatnonzero((part == p) & (a < nothing))
            moved = sums[own][:, None] - sums
            left = np.maximum(-room[p] - moved, 0) + np.maximum(moved - room[part], 0) - np.maximum(-room[part], 0)
            left[:, part == p] = FAR
            if left.min() < -room[p]:
                break
        else:  # it stays as much: another part, made up otherwise, takes the overflow
            passed += 1
            if passed > PASSES:
                return None
            left[moved < -room[p]] = FAR
        i, j = np.unravel_index(int(left.argmin()), left.shape)
        if left[i, j] == FAR:
            return None
        i, by, q = own[i], moved[i, j], int(part[j])
        room[p] += by
        room[q] -= by
        part_of[[x for x in (a[i], b[i]) if x < nothing]] = q
        part_of[[x for x in (a[j], b[j]) if x < nothing]] = p
    order = np.argsort(part_of, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(part_of, minlength=k))[:-1]) if len(x)]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity``: the fewest that differencing can fill, one more whenever a part overflows.

    An overflow is first put into other parts' room by exchanges.
    """
    k = max(1, -(-sum(sizes) // capacity))
    while sizes:
        parts = settled(differencing(sizes, k), sizes, capacity)
        if parts is not None:
            return parts
        k += 1
    return []


def _assign(capacity: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 40, 0

        def packed(part: pa.Table) -> pa.RecordBatch:
            nonlocal done
            sizes = part.column("length").to_pylist()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for items in windows(sizes, capacity):
                at = 0
                for i in items:
                    sequence[i], offset[i] = base + done, at
                    at += sizes[i]
                done += 1
            out = part.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            return out.combine_chunks().to_batches()[0]

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= 2 * batch:  # so that the last problem is never a small one
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, batch))
                held, rows = table.slice(batch).to_batches(), rows - batch
        if rows:
            yield packed(pa.Table.from_batches(held))

    return run


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Whole texts as pieces of at most ``capacity`` ids: full ones from the start, then the rest."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids_of = b.column(0).to_pylist()
            rows: list[list] = [[] for _ in range(6)]
            for i, ids in encoded(b, "text", tokenizer):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    for column, x in zip(rows, (ids_of[i], start, len(part), zlib.crc32(part.tobytes()), len(ids), part if keep_ids else None)):
                        column.append(x)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            arrays = [pa.array(x, pa.int64()) for x in rows[:5]]
            if keep_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array([x.astype(np.int64) for x in rows[5]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(tidy(run, tokenizer), PIECE + (", ids array<long>" if keep_ids else ""))


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 4096,
    batch: int = 2048,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Texts are cut into full windows, which stand alone, and a rest. The rests
    (a few numbers each, whatever the text's length) are dealt evenly by a hash
    of (doc_id, start) and packed in problems of ``batch`` to 2 * ``batch``
    pieces by multiway differencing. Nothing depends on the number of rows but
    the number of problems.

    Null text is empty (its one piece is the end id); a null doc_id stays null;
    repeated rows are packed once each; an empty table gives no rows; other
    columns are ignored. sequence_id is unique, not dense; offset is gapless
    from 0 in each sequence. ``keep_ids`` adds the ids themselves.
    """
    pieces = tokenized(docs, tokenizer, end_id, capacity, keep_ids)
    n = partitions(docs.sparkSession)
    dealt = pieces.repartition(n, F.xxhash64("doc_id", "start")).sortWithinPartitions("doc_id", "start", "ids_crc32")
    schema = pieces.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return dealt.mapInArrow(tidy(_assign(capacity, batch)), ", ".join(x.replace(":", " ", 1) for x in schema.split(",")) + ", sequence_id long, offset long")
