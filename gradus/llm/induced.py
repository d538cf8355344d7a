"""External induced suffix sorting with common-prefix values.

A text's suffixes are S if smaller than the next suffix, else L; an S suffix
after an L one is starred. The substrings between starred suffixes are named,
the text of names is sorted by recursion, and two scans induce all suffixes
from the starred ones: each popped suffix pushes its left neighbour, first the
L suffixes upward, then the S suffixes downward. A pushed suffix comes after
all earlier ones of its first symbol, so the queue is monotone.

The queue, the lists between the scans and the texts of all levels live in
files beyond a bound of memory. A tuple is (key, position, value): the key is
the first symbol, and the value is the length of the prefix shared with the
tuple before it (or, while substrings are named, the substring's hash).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyarrow import fs

from gradus.llm._words import BASE, mix

#: Elements of a list's block, and of a queue's part that holds several symbols.
BLOCK, GROUP = 1 << 17, 1 << 12
ORDERED = np.dtype([("key", "<u4"), ("pos", "<u4"), ("value", "u1")])
HASHED = np.dtype([("key", "<u4"), ("pos", "<u4"), ("value", "<u8")])


class Store:
    """Arrays of one task: up to ``memory`` bytes of lists and as much of queues in memory, the rest in files of a shared folder."""

    def __init__(self, folder: str, memory: int):
        self.uri, self.memory = f"{folder}/{uuid.uuid4().hex}", memory
        self.lists = self.queues = self.files = self.spilled = 0
        self.fs: fs.FileSystem | None = None

    def write(self, a: np.ndarray) -> tuple[str, np.dtype]:
        if self.fs is None:
            self.fs, self.path = fs.FileSystem.from_uri(self.uri)
            self.fs.create_dir(self.path, recursive=True)
        name = f"{self.path}/{self.files}"
        self.files += 1
        self.spilled += a.nbytes
        with self.fs.open_output_stream(name) as f:
            f.write(np.ascontiguousarray(a).view(np.uint8))
        return name, a.dtype

    def read(self, handle: tuple[str, np.dtype]) -> np.ndarray:
        with self.fs.open_input_file(handle[0]) as f:
            return np.frombuffer(f.read(), handle[1])

    def put(self, a: np.ndarray):
        if self.lists + a.nbytes > self.memory:
            return self.write(a)
        self.lists += a.nbytes
        return a

    def get(self, handle) -> np.ndarray:
        return handle if isinstance(handle, np.ndarray) else self.read(handle)

    def free(self, handle) -> None:
        if isinstance(handle, np.ndarray):
            self.lists -= handle.nbytes
        else:
            self.fs.delete_file(handle[0])

    def close(self) -> None:
        if self.fs is not None:
            self.fs.delete_dir(self.path)
            self.fs = None


class Tape:
    """A sequence that grows at its end and is read block by block, or at any places once it is finished."""

    def __init__(self, store: Store, dtype, block: int = BLOCK):
        self.store, self.dtype, self.block, self.n = store, np.dtype(dtype), block, 0
        self.handles: list = []
        self.tail: list[np.ndarray] = []
        self.waiting = 0
        self.whole: np.ndarray | None = None
        self.cache: dict[int, np.ndarray] = {}

    def append(self, a: np.ndarray) -> None:
        if len(a):
            self.tail.append(a)
            self.n += len(a)
            self.waiting += len(a)
            if self.waiting >= self.block:
                self._flush(self.waiting // self.block * self.block)

    def _flush(self, most: int) -> None:
        a = np.concatenate(self.tail).astype(self.dtype, copy=False)
        for at in range(0, most, self.block):
            self.handles.append(self.store.put(a[at : min(most, at + self.block)].copy()))
        self.waiting = len(a) - most
        self.tail = [a[most:].copy()] if self.waiting else []

    def finish(self) -> Tape:
        """No more is appended; in memory as one array if there is room."""
        if self.waiting:
            self._flush(self.waiting)
        if all(isinstance(h, np.ndarray) for h in self.handles):
            self.whole = np.concatenate(self.handles) if self.handles else np.zeros(0, self.dtype)
            self.handles = [self.whole[at : at + self.block] for at in range(0, self.n, self.block)]
        return self

    def blocks(self, backward: bool = False, consume: bool = False) -> Iterator[np.ndarray]:
        """Blocks in order; backward, each block is turned round too. consume: they are let go."""
        order = range(len(self.handles))
        for i in reversed(order) if backward else order:
            a = self.store.get(self.handles[i])
            yield a[::-1] if backward else a
            if consume:
                self.store.free(self.handles[i])
                self.handles[i] = a[:0]
        if consume:
            self.whole, self.handles = None, []

    def _block(self, i: int) -> np.ndarray:
        if i not in self.cache:
            if len(self.cache) >= 4:
                self.cache.pop(next(iter(self.cache)))
            self.cache[i] = self.store.get(self.handles[i])
        return self.cache[i]

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Values at places; from files each block that holds some is read once."""
        if self.whole is not None:
            return self.whole[at]
        out = np.zeros(len(at), self.dtype)
        order = np.argsort(at, kind="stable")
        block = at[order] // self.block
        for part in np.split(order, np.flatnonzero(block[1:] != block[:-1]) + 1) if len(order) else []:
            i = int(at[part[0]]) // self.block
            out[part] = self._block(i)[at[part] - i * self.block]
        return out

    def drop(self) -> None:
        for h in self.handles:
            self.store.free(h)
        self.handles, self.whole, self.cache = [], None, {}


class Queue:
    """A monotone priority queue: equal keys leave in the order they came.

    Keys between two edges share a part. A part of one key is a plain sequence
    read block by block; a part of several keys is small and sorted when its
    turn comes. Beyond the bound of memory the longest parts go to files.
    """

    def __init__(self, store: Store, edges: np.ndarray, dtype: np.dtype):
        self.store, self.edges, self.dtype = store, edges, dtype
        self.direct = len(edges) == int(edges[-1]) + 1
        parts = len(edges) - 1
        self.tail: list[list[np.ndarray]] = [[] for _ in range(parts)]
        self.size = np.zeros(parts, np.int64)
        self.files: list[list] = [[] for _ in range(parts)]
        self.at = 0
        self.front: np.ndarray | None = None

    def push(self, a: np.ndarray) -> None:
        if not len(a):
            return
        part = a["key"].astype(np.int64) if self.direct else np.searchsorted(self.edges, a["key"], "right") - 1
        order = np.argsort(part.astype(np.uint16) if len(self.size) < 65536 else part, kind="stable")
        part, a = part[order], a[order]
        cut = np.flatnonzero(part[1:] != part[:-1]) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(a)]):
            p = int(part[lo])
            self.tail[p].append(a[lo:hi])
            self.size[p] += hi - lo
        self.store.queues += a.nbytes
        if self.store.queues > self.store.memory:
            self._spill()

    def _spill(self) -> None:
        for p in np.argsort(-self.size, kind="stable").tolist():
            if self.store.queues <= self.store.memory // 2 or not self.size[p]:
                break
            self.files[p].append(self.store.write(np.concatenate(self.tail[p])))
            self._let_go(p)

    def _let_go(self, p: int) -> None:
        self.store.queues -= int(self.size[p]) * self.dtype.itemsize
        self.tail[p], self.size[p] = [], 0

    def pop_block(self, p: int) -> np.ndarray | None:
        """The oldest block of a part."""
        if self.files[p]:
            handle = self.files[p].pop(0)
            a = self.store.read(handle)
            self.store.free(handle)
            return a
        if not self.tail[p]:
            return None
        a = np.concatenate(self.tail[p]) if len(self.tail[p]) > 1 else self.tail[p][0]
        self._let_go(p)
        return a

    def blocks(self, p: int) -> Iterator[np.ndarray]:
        """A part's blocks, oldest first; what is pushed meanwhile comes too."""
        while (a := self.pop_block(p)) is not None:
            yield a

    def _whole_part(self, p: int) -> np.ndarray:
        got = list(self.blocks(p))
        return np.concatenate(got) if got else np.zeros(0, self.dtype)

    def scan(self, induce: Callable[[np.ndarray], tuple[np.ndarray, int]]) -> None:
        """Give batches in key order to ``induce``; it returns what to push and how many of the batch it took."""
        for p in range(len(self.size)):
            if self.edges[p + 1] - self.edges[p] == 1:
                for a in self.blocks(p):
                    for at in range(0, len(a), BLOCK):
                        self.push(induce(a[at : at + BLOCK])[0])
                continue
            a = self._whole_part(p)
            a = a[np.argsort(a["key"], kind="stable")]
            while len(a):
                pushed, taken = induce(a)
                self.push(pushed)
                a = a[taken:]
                if self.size[p] or self.files[p]:
                    a = np.concatenate([a, self._whole_part(p)])
                    a = a[np.argsort(a["key"], kind="stable")]

    def sorted_parts(self) -> Iterator[np.ndarray]:
        """Everything, part by part and sorted by key; for queues that nothing is pushed to any more."""
        for p in range(len(self.size)):
            a = self._whole_part(p)
            if len(a):
                yield a[np.argsort(a["key"], kind="stable")]


def tuples(dtype: np.dtype, key: np.ndarray, pos: np.ndarray, value) -> np.ndarray:
    out = np.empty(len(pos), dtype)
    out["key"], out["pos"], out["value"] = key, pos, value
    return out


class Prefixes:
    """Common-prefix values of pushed suffixes: one more than the least value since the last push to the same key."""

    def __init__(self, keys: int, most: int):
        self.since, self.most = np.zeros(keys, np.int64), most

    def of(self, target: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """target, at: keys pushed to and the places in the batch that push; values: the batch's."""
        low = np.append(values.astype(np.int64), 0)  # the last is never part of a range
        order = np.argsort(target.astype(np.uint16), kind="stable")
        key, place = target[order], at[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        start = np.where(first, 0, np.append(0, place[:-1]) + 1)
        least = np.minimum.reduceat(low, np.stack([start, place + 1], 1).ravel())[::2] if len(key) else low[:0]
        least[first] = np.minimum(least[first], self.since[key[first]])
        out = np.empty(len(key), np.int64)
        out[order] = np.minimum(least + 1, self.most)
        self.since = np.minimum(self.since, low[:-1].min())
        last = np.flatnonzero(np.append(first[1:], True)) if len(key) else order
        tail = np.append(np.minimum.accumulate(low[:-1][::-1])[::-1], self.most)
        self.since[key[last]] = tail[place[last] + 1]
        return out


class Sorter:
    """Sorts the suffixes of a text held on a tape (unsigned integers); ``depth`` bounds the common-prefix values."""

    def __init__(self, store: Store, depth: int, base: int):
        self.store, self.depth, self.base, self.levels = store, depth, base, 0

    def sort(self, text: Tape, sink: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Call ``sink`` with positions of all suffixes, largest first, and the prefix each shares with the one before it."""
        if text.n:
            self._sort(text, 256, np.zeros(0, np.int64), sink)

    def _starred(self, text: Tape) -> Iterator[np.ndarray]:
        """Positions of starred suffixes, block by block from the end."""
        after, smaller, at = -1, False, text.n  # the next symbol, and whether its suffix is S
        blocks = list(range(len(text.handles)))
        for i in reversed(blocks):
            a = text.store.get(text.handles[i]).astype(np.int64)
            at -= len(a)
            step = np.append(a[1:], after) - a
            place = np.where(step != 0, np.arange(len(a)), len(a))
            place = np.minimum.accumulate(place[::-1])[::-1]
            is_s = np.where(place < len(a), np.append(step, 1 if smaller else -1)[place] > 0, smaller)
            left = int(text.gather(np.array([at - 1]))[0]) if at else -1
            before = np.append(left, a[:-1])
            yield at + np.flatnonzero(is_s & (before > a))
            after, smaller = int(a[0]), bool(is_s[0])

    def _edges(self, symbols: int, hot: np.ndarray, up: bool) -> np.ndarray:
        """Parts of the queue: every key of a byte text; groups of names, with a part for each key of a frequent one."""
        top = 2 * symbols + 3
        if symbols <= 256:
            return np.arange(top + 1)
        own = 2 * (hot + 1 if up else symbols - hot)
        return np.unique(np.concatenate([np.arange(0, top, 2 * GROUP), own, own + 1, own + 2, [top]]))

    def _scan(self, text: Tape, queue: Queue, up: bool, symbols: int, emit, prefixes: Prefixes | None) -> None:
        """Pop everything in order; each suffix pushes its left neighbour if that is of the scan's type.

        up: keys rise with the symbol, else they fall. Even keys are induced
        suffixes, odd keys those that the scan began with. ``emit`` gets each
        batch, its keys of the left neighbours and which of them were pushed.
        """
        held = [-1, 0]  # key and position of the last suffix

        def induce(a: np.ndarray) -> tuple[np.ndarray, int]:
            pos, key = a["pos"].astype(np.int64), a["key"].astype(np.int64)
            left = text.gather(np.maximum(pos - 1, 0)).astype(np.int64)
            left = 2 * (left + 1 if up else symbols - left)
            pushes = (pos > 0) & (left >= key)
            if key[0] != key[-1]:
                # what is pushed must not belong before a suffix of the same batch
                bound = np.minimum.accumulate(np.where(pushes, left, np.iinfo(np.int64).max))
                early = np.flatnonzero(key[1:] > bound[:-1])
                if len(early):
                    n = int(early[0]) + 1
                    a, pos, key, left, pushes = a[:n], pos[:n], key[:n], left[:n], pushes[:n]
            at = np.flatnonzero(pushes)
            value = a["value"]
            if prefixes is not None:
                if key[0] != held[0]:
                    value = value.copy()
                    value[0] = self.shared(text, pos[:1], np.array([held[1]]))[0] if key[0] >> 1 == held[0] >> 1 else 0
                    a = tuples(ORDERED, a["key"], a["pos"], value)
                held[:] = int(key[-1]), int(pos[-1])
                given = prefixes.of(left[at], at, value)
            elif queue.dtype is HASHED:
                given = mix(value[at] * np.uint64(BASE) + left[at].astype(np.uint64))
            else:
                given = 0
            emit(a, left, pushes)
            return tuples(queue.dtype, left[at], pos[at] - 1, given), len(a)

        queue.scan(induce)

    def shared(self, text: Tape, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the prefix that suffixes a and b share, at most ``depth``."""
        out, todo = np.zeros(len(a), np.int64), np.arange(len(a))
        for step in range(0, self.depth, 8):
            if not len(todo):
                break
            width = min(8, self.depth - step)
            reach = np.arange(step, step + width)
            same = np.ones((len(todo), width), bool)
            for c, r in enumerate(reach):
                x, y = a[todo] + r, b[todo] + r
                inside = (x < text.n) & (y < text.n)
                same[:, c] = inside & (text.gather(np.where(inside, x, 0)) == text.gather(np.where(inside, y, 0)))
            n = np.where(same.all(1), width, same.argmin(1))
            out[todo] += n
            todo = todo[n == width]
        return out

    def _named(self, text: Tape, symbols: int, hot: np.ndarray) -> tuple[Tape, Tape, np.ndarray, bool]:
        """Starred positions, largest substring first; the text of names with its positions; frequent names; are all different?"""
        store, count = self.store, 0
        queue = Queue(store, self._edges(symbols, hot, True), HASHED)
        queue.push(tuples(HASHED, np.array([1]), np.array([text.n]), 1))
        for pos in self._starred(text):
            key = 2 * (text.gather(pos).astype(np.int64) + 1) + 1
            queue.push(tuples(HASHED, key, pos, mix(key.astype(np.uint64))))
            count += len(pos)
        ends = Tape(store, HASHED)

        def keep_ends(a: np.ndarray, left: np.ndarray, pushes: np.ndarray) -> None:
            which = ~pushes & (a["key"] % 2 == 0) & (a["pos"] > 0)
            ends.append(a[which])

        self._scan(text, queue, True, symbols, keep_ends, None)
        ends.finish()
        queue = Queue(store, self._edges(symbols, hot, False), HASHED)
        for a in ends.blocks(backward=True, consume=True):
            # keys rose with the symbol: 2 (s + 1); now they fall: 2 (symbols - s) + 1
            queue.push(tuples(HASHED, 2 * (symbols + 1) - a["key"].astype(np.int64) + 1, a["pos"], a["value"]))
        order = Tape(store, "<u4")
        width = max(BLOCK, text.n // 256 + 1)
        names = Queue(store, np.append(np.arange(0, text.n + 1, width), text.n + 1), ORDERED_NAMES)
        seen, last, group, frequent = 0, None, 0, []

        def keep_starred(a: np.ndarray, left: np.ndarray, pushes: np.ndarray) -> None:
            nonlocal seen, last, group
            a = a[~pushes & (a["key"] % 2 == 0) & (a["pos"] > 0)]
            if not len(a):
                return
            new = np.ones(len(a), bool)
            new[1:] = a["value"][1:] != a["value"][:-1]
            new[0] = last is None or a["value"][0] != last
            place = np.where(new, count - 1 - (seen + np.arange(len(a))), count)
            name = np.minimum(np.minimum.accumulate(place), group if last is not None else count)
            # a name is the place of the group's largest suffix, so the names of n suffixes lie below n
            first = np.flatnonzero(new)
            lengths = np.diff(np.append(first, len(a)))
            frequent.extend(name[first[lengths > GROUP]].tolist())
            if not new[0] and count - 1 - seen - (first[0] if len(first) else len(a)) < group - GROUP:
                frequent.append(group)
            seen, last, group = seen + len(a), a["value"][-1], int(name[-1])
            order.append(a["pos"])
            names.push(tuples(ORDERED_NAMES, a["pos"], name, 0))
            different[0] += int(new.sum())

        different = [0]
        self._scan(text, queue, False, symbols, keep_starred, None)
        return order.finish(), names, np.unique(np.array(frequent, np.int64)), different[0] == count

    def _order(self, text: Tape, symbols: int, hot: np.ndarray) -> Tape:
        """Starred positions by their suffixes, largest first."""
        order, names, frequent, done = self._named(text, symbols, hot)
        if done:
            return order
        order.drop()
        reduced, places = Tape(self.store, "<u4"), Tape(self.store, "<u4")
        for a in names.sorted_parts():
            reduced.append(a["pos"])
            places.append(a["key"])
        reduced.finish()
        places.finish()
        out = Tape(self.store, "<u4")
        if reduced.n <= self.base:
            out.append(places.gather(doubled(np.concatenate(list(reduced.blocks())))[::-1]))
        else:
            self.levels += 1
            self._sort(reduced, reduced.n, frequent, lambda pos, _: out.append(places.gather(pos)))
        reduced.drop()
        places.drop()
        return out.finish()

    def _sort(self, text: Tape, symbols: int, hot: np.ndarray, sink) -> None:
        order = self._order(text, symbols, hot)
        bottom = text.dtype == np.uint8
        keys = 2 * symbols + 4
        queue = Queue(self.store, self._edges(symbols, hot, True), ORDERED)
        queue.push(tuples(ORDERED, np.array([1]), np.array([text.n]), 0))
        before = np.array([text.n])
        for pos in order.blocks(backward=True, consume=True):
            pos = pos.astype(np.int64)
            value = self.shared(text, pos, np.append(before, pos[:-1])) if bottom else 0
            queue.push(tuples(ORDERED, 2 * (text.gather(pos).astype(np.int64) + 1) + 1, pos, value))
            before = pos[-1:].copy()
        rising = Tape(self.store, ORDERED)
        self._scan(text, queue, True, symbols, lambda a, *_: rising.append(a[a["key"] % 2 == 0]), Prefixes(keys, self.depth) if bottom else None)
        rising.finish()
        queue = Queue(self.store, self._edges(symbols, hot, False), ORDERED)
        carried = 0
        for a in rising.blocks(backward=True, consume=True):
            # downward, a suffix shares with the one before it what that one shared with it
            value = np.append(np.uint8(carried), a["value"][:-1])
            carried = a["value"][-1]
            queue.push(tuples(ORDERED, 2 * (symbols + 1) - a["key"].astype(np.int64) + 1, a["pos"], value))
        self._scan(text, queue, False, symbols, lambda a, *_: sink(a["pos"].astype(np.int64), a["value"]), Prefixes(keys, self.depth) if bottom else None)


#: While a text of names is put in order, the key is the place and the position is the name.
ORDERED_NAMES = ORDERED


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a small text by doubling ranks."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    step = 1
    while n and rank.max() < n - 1:
        pair = rank * (n + 1)
        pair[: n - step] += rank[step:] + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out
