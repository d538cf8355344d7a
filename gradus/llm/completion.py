"""Packing whole documents into the fewest windows by bin completion.

There are no more distinct piece lengths than the capacity, so a corpus of any size is one problem of counts by length.
It is solved in full by branch and bound: the largest length left is completed to a bin by an undominated filling, which is
used as often as the counts allow; best-fit decreasing gives the first incumbent, and a branch ends where its waste rules out
a better one. What comes out is a list of fillings with how often each is used. Pieces find their places in it by their
length and their number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm._memory import tidy
from gradus.llm._tokens import encoded
from gradus.plans.scratch import Scratch

#: Fillings that a search looks at after its first incumbent; the best packing met by then is the result.
LOOKS = 5_000
#: A filling is (length, how many) by descending length; a solution is (how often, filling).
Filling = tuple[tuple[int, int], ...]


def bins(solution: list[tuple[int, Filling]]) -> int:
    return sum(times for times, _ in solution)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing, bins of equal content at once."""
    open_: list[tuple[int, int, Filling]] = []  # room, how many, content
    for size in sorted(counts, reverse=True):
        left, after = counts[size], []
        for room, times, content in sorted(open_):
            each = room // size
            full = min(times, left // each) if each else 0
            if full:
                after.append((room - each * size, full, (*content, (size, each))))
                left, times = left - full * each, times - full
            if each and left and times:  # the rest goes to one more of these
                after.append((room - left * size, 1, (*content, (size, left))))
                left, times = 0, times - 1
            if times:
                after.append((room, times, content))
        each = capacity // size
        if left // each:
            after.append((capacity - each * size, left // each, ((size, each),)))
        if left % each:
            after.append((capacity - left % each * size, 1, ((size, left % each),)))
        open_ = after
    return [(times, content) for _, times, content in open_]


def fewest(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: pieces over half a bin never meet, and what doesn't fit beside them needs bins of its own."""
    sizes = sorted(counts)
    number = np.array([counts[s] for s in sizes], np.int64)
    n, total = np.append(0, np.cumsum(number)), np.append(0, np.cumsum(number * np.array(sizes, np.int64)))
    up_to = lambda x: int(np.searchsorted(sizes, x, "right"))
    half, low = up_to(capacity // 2), -(-int(total[-1]) // capacity)
    for k in [0, *(s for s in sizes if s <= capacity // 2)]:
        # over capacity - k: alone; to the half: one a bin; k and more up to the half: into their rooms
        wide, small = up_to(capacity - k), up_to(k - 1)
        beside = int((n[wide] - n[half]) * capacity - (total[wide] - total[half]))
        more = max(0, -(-(int(total[half] - total[small]) - beside) // capacity))
        low = max(low, int(n[-1] - n[half]) + more)
    return low


def _dominated(filling: Filling, left: dict[int, int], room: int) -> bool:
    """Whether one unused length could take the place of some of the filling, or of nothing, and use more of the room with fewer pieces left or no less."""
    none, one, more = 1, 0, 0
    for size, n in filling:
        for _ in range(n):
            more |= (more | one) << size
            one |= none << size
    unused = 0
    for size, n in left.items():
        if size <= room and n:
            unused |= 1 << size
    for size, n in filling:
        if left[size] == n:
            unused &= ~(1 << size)
    if more & unused:
        return True
    slack = room - sum(size * n for size, n in filling)
    sums = none | one | more
    return any((sums << d) & unused for d in range(1, slack + 1))


def fillings(left: dict[int, int], room: int, waste: int) -> Iterator[Filling]:
    """Undominated fillings of a room from the lengths left that waste at most so much, fullest first, then those of the longest pieces."""
    sizes = [s for s in sorted(left, reverse=True) if s <= room and left[s]]
    full = (1 << (room + 1)) - 1
    reach = [1]  # sums that the lengths from the k-th on can make
    for size in reversed(sizes):
        sums, n, chunk = reach[-1], min(left[size], room // size), 1
        while n:
            chunk = min(chunk, n)
            sums |= (sums << (chunk * size)) & full
            n, chunk = n - chunk, 2 * chunk
        reach.append(sums)
    reach.reverse()

    def make(k: int, rest: int) -> Iterator[Filling]:
        if not rest:
            yield ()
            return
        while k < len(sizes) and (reach[k] >> rest) & 1:
            size = sizes[k]
            for n in range(min(left[size], rest // size), 0, -1):
                if (reach[k + 1] >> (rest - n * size)) & 1:
                    for others in make(k + 1, rest - n * size):
                        yield ((size, n), *others)
            k += 1

    for total in range(room, max(room - waste, 0) - 1, -1):
        if (reach[0] >> total) & 1:
            yield from make(0, total)


def complete(counts: dict[int, int], capacity: int, looks: int = LOOKS) -> list[tuple[int, Filling]]:
    """The best packing that bin completion finds: fillings of at most ``capacity`` and how often each is used, every piece in one.

    Optimal where the bins equal ``fewest`` or the search ends before it has looked at ``looks`` fillings.
    """
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    low, total, used = fewest(counts, capacity), sum(s * n for s, n in counts.items()), bins(best)

    def branches(left: dict[int, int], wasted: int) -> Iterator[tuple[int, Filling]]:
        nonlocal looks
        size = max(left)
        beside = left | {size: left[size] - 1}
        room = capacity - size
        for times_most in (True, False):
            for more in fillings(beside, room, (used - 1) * capacity - total - wasted):
                looks -= 1
                if looks < 0:
                    return
                spare = room - sum(s * n for s, n in more)
                allowed = (used - 1) * capacity - total - wasted
                if spare > allowed:
                    break
                if _dominated(more, beside, room):
                    continue
                whole: dict[int, int] = dict(more)
                whole[size] = whole.get(size, 0) + 1
                times = min(left[s] // n for s, n in whole.items())
                if spare:
                    times = min(times, allowed // spare)
                if times_most or times > 1:
                    yield (times if times_most else 1), tuple(sorted(whole.items(), reverse=True))

    made: list[tuple[int, Filling]] = []
    stack = [(counts, 0, branches(counts, 0))] if counts else []
    while stack and used > low and looks >= 0:
        left, wasted, more = stack[-1]
        branch = next(more, None)
        if branch is None:
            stack.pop()
            if made:
                made.pop()
            continue
        times, filling = branch
        after = left.copy()
        for size, n in filling:
            after[size] -= n * times
            if not after[size]:
                del after[size]
        made.append(branch)
        if not after:
            best, used = made.copy(), bins(made)
            made.pop()
        elif bins(made) + fewest(after, capacity) >= used:
            made.pop()
        else:
            gone = wasted + times * (capacity - sum(s * n for s, n in filling))
            stack.append((after, gone, branches(after, gone)))
    return best


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, a longer one's first piece the shorter; part and nth number the pieces of a length in a task."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * keep_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            ids_of, rows = b.column(0).to_pylist(), []
            for i, ids in encoded(b, "text", tokenizer):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                starts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity)]
                for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    own = ids[lo:hi]
                    rows.append((ids_of[i], k, lo, hi - lo, zlib.crc32(own.tobytes()), part, seen[hi - lo], *[own.astype(np.int64)] * keep_ids))
                    seen[hi - lo] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names)

    return source.mapInArrow(tidy(run, tokenizer), PIECE + ", part int, nth long" + (", ids array<long>" if keep_ids else ""))


SLOT = "length long, first long, base long, each long, offset long"


def _solve(capacity: int, looks: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for frame in frames:
            counts |= dict(zip(frame["length"].tolist(), frame["n"].tolist()))
        first, base, slots = dict.fromkeys(counts, 0), 0, []
        for times, filling in complete(counts, capacity, looks):
            offset = 0
            for length, each in filling:
                slots.append((length, first[length], base, each, offset))
                first[length] += times * each
                offset += each * length
            base += times
        yield pd.DataFrame(slots, columns=[c.split()[0] for c in SLOT.split(", ")], dtype="int64")

    return run


def _place(slots: np.ndarray):
    """slots: length, first, base, each, offset, sorted; adds sequence_id and offset by length and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts = np.unique(slots[:, 0], return_index=True)
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = np.zeros(len(length), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                k = int(np.searchsorted(lengths, size))
                lo, hi = starts[k], starts[k + 1] if k + 1 < len(starts) else len(slots)
                at[own] = lo + np.searchsorted(slots[lo:hi, 1], rank[own], "right") - 1
            _, first, base, each, offset = slots[at].T
            within = rank - first
            kept = [c for c in b.schema.names if c != "rank"]
            placed = [pa.array(base + within // each), pa.array(offset + within % each * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *placed], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, looks: int = LOOKS, keep_ids: bool = False) -> DataFrame:
    """Pack all documents, cut only where longer than ``capacity`` tokens, into as few sequences as bin completion finds.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; sequence_id counts from 0. Texts stay where
    they are read. The counts by length (at most ``capacity`` rows) go to one task, which searches; a solution has at most
    some sqrt(2 * capacity) lengths in each of its fillings, of which there are a few thousand, whatever the corpus. Pieces
    are numbered within their length by the counts of each task, so a length that a third of all pieces have is dealt evenly.

    Null text is empty (its one piece is the end id); a null doc_id stays null; repeated rows are packed once each; an empty
    table gives no rows; other columns are ignored. ``keep_ids`` adds the ids themselves.
    """
    scratch = Scratch(docs.sparkSession, "completion")
    cut = scratch.save(pieces(docs, tokenizer, end_id, capacity, keep_ids), "pieces")
    runs = scratch.save(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    lengths = runs.groupBy("length").agg(F.sum("n").alias("n"))
    slots = scratch.save(lengths.coalesce(1).mapInPandas(_solve(capacity, looks), SLOT), "slots")
    table = np.array([tuple(r) for r in slots.orderBy("length", "first").collect()], np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * keep_ids
    ranked = cut.join(bases, ["length", "part"]).select(*kept, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(table), PIECE + (", ids array<long>" if keep_ids else "") + ", sequence_id long, offset long")
