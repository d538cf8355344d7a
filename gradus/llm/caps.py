"""Near-duplicate vectors by spherical-cap filters with a structured random product code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm._groups import grouped, matrix, roots
from gradus.operators.components import connected_components
from gradus.plans.scratch import Scratch, partitions

#: Most vectors of a filter that one task takes at a time, the chance that a pair at the cut shares a filter, and product codes tried.
CHUNK, RECALL, ROTATIONS = 2048, 0.999, 6
#: Random pairs that set the caps' height.
PAIRS = 1000
BLOCK = 512


class ProductCode:
    """Filter directions are all concatenations of one codeword from each block of a rotated vector."""

    def __init__(self, dim: int, filters: int, seed: int = 20_24):
        rng = np.random.default_rng(seed)
        bits = min(max(2, int(np.ceil(np.log2(filters)))), 2 * dim)  # few directions fill a space of few dimensions
        self.blocks = 1 if dim < 2 else 2  # lists of more blocks differ more in length
        bits = min(bits, 15 * self.blocks)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        each = -(-bits // self.blocks)
        edges = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.spans = list(zip(edges[:-1], edges[1:]))
        self.words = []
        for lo, hi in self.spans:
            w = rng.standard_normal((hi - lo, 1 << each))
            self.words.append(w / np.linalg.norm(w, axis=0))
        self.each = each

    @staticmethod
    def _best(score: np.ndarray, name: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        most = min(most, score.shape[1])
        at = np.argpartition(-score, most - 1, axis=1)[:, :most]
        return np.take_along_axis(score, at, 1), np.take_along_axis(name, at, 1)

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, lo:hi] @ w for (lo, hi), w in zip(self.spans, self.words)]

    def best(self, unit: np.ndarray, most: int) -> np.ndarray:
        """(n, most) filters of the largest inner products with each vector.

        The best sums of two lists are sums of each list's best, so merging the
        blocks' lists two by two finds them exactly.
        """
        parts = [self._best(score, np.broadcast_to(np.arange(score.shape[1]), score.shape), most) for score in self.scores(unit)]
        while len(parts) > 1:
            merged = []
            for (s, a), (t, b) in zip(parts[::2], parts[1::2]):
                wide = 1 << (self.each * (self.blocks // len(parts)))
                score = (s[:, :, None] + t[:, None, :]).reshape(len(s), -1)
                name = (a[:, :, None] * wide + b[:, None, :]).reshape(len(s), -1)
                merged.append(self._best(score, name, most))
            parts = merged
        return np.sort(parts[0][1], axis=1)

    def height(self, cut: float, recall: float, pairs: int = PAIRS) -> float:
        """Inner product above which a direction's cap holds a vector; one for all vectors.

        The largest at which ``recall`` of random pairs at cosine ``cut`` share a
        cap. The rotation makes any given pair such a random pair, so it doesn't
        depend on the data. The best caps of a pair's middle are tried as shared ones.
        """
        dim = len(self.rotation)
        if dim < 2:
            return -1.0  # every cap holds every vector
        rng = np.random.default_rng(7)
        shared = []
        for n in np.diff(np.linspace(0, pairs, 11).astype(int)):
            x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, n, dim)))
            y -= (x * y).sum(1, keepdims=True) * x
            y = cut * x + np.sqrt(1 - cut * cut) * y / np.linalg.norm(y, axis=1, keepdims=True)
            names = self.best(x + y, 64)
            sides = []
            for v in (x, y):
                total = np.zeros(names.shape)
                for i, score in enumerate(self.scores(v)):
                    total += np.take_along_axis(score, (names >> (self.each * (self.blocks - 1 - i))) & ((1 << self.each) - 1), 1)
                sides.append(total)
            shared.append(np.minimum(*sides).max(1))
        return float(np.quantile(np.concatenate(shared), 1 - recall))

    def above(self, unit: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of every filter whose cap of this height holds the vector, in ascending order.

        A codeword that the best of the other blocks can't lift above the height is
        left out; then the blocks' lists are joined two by two under the same rule.
        """
        scores = self.scores(unit)
        top = np.stack([score.max(1) for score in scores])  # block, vector
        parts = []
        for i, score in enumerate(scores):
            row, name = np.nonzero(score >= (height - (top.sum(0) - top[i]))[:, None] - 1e-12)
            parts.append((row, name, score[row, name], top[i]))
        while len(parts) > 1:
            whole, merged = sum(p[3] for p in parts), []
            wide = 1 << (self.each * (self.blocks // len(parts)))
            for (r, a, s, p), (q, b, t, o) in zip(parts[::2], parts[1::2]):
                first, held = np.searchsorted(q, np.arange(len(unit))), np.bincount(q, minlength=len(unit))
                times = held[r]
                left = np.repeat(np.arange(len(r)), times)
                right = first[r][left] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
                score = s[left] + t[right]
                keep = score >= (height - (whole - p - o))[r[left]] - 1e-12
                merged.append((r[left][keep], a[left][keep] * wide + b[right][keep], score[keep], p + o))
            parts = merged
        row, name, score, _ = parts[0]
        keep = score >= height
        row, name = row[keep], name[keep]
        order = np.lexsort((name, row))
        return row[order], name[order]


@lru_cache(8)
def codes(dim: int, filters: int, cut: float, recall: float, rotations: int = ROTATIONS) -> list[tuple[ProductCode, float]]:
    """Product codes of rotations of their own, of ``filters`` directions together, and the height of each.

    A code's lists differ much in length, so one code of a high recall needs a low
    height and long lists; a pair that one rotation parts, another joins.
    """
    each = [ProductCode(dim, -(-filters // rotations), 20_24 + i) for i in range(rotations)]
    return [(code, code.height(cut, 1 - (1 - recall) ** (1 / rotations))) for code in each]


def filters_of(unit: np.ndarray, filters: int, cut: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) in ascending order, over all codes."""
    row, name, base = [], [], 0
    for code, height in codes(unit.shape[1], filters, cut, recall):
        r, a = code.above(unit, height)
        row.append(r)
        name.append(a + base)
        base += 1 << (code.each * code.blocks)
    row, name = np.concatenate(row), np.concatenate(name)
    order = np.argsort(row, kind="stable")
    return row[order], name[order]


def _decode(filters: int, cut: float, recall: float):
    """id, h, weight, label, dim, embedding → a row with the vector and its filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                b = whole.slice(at, 250)
                dims = np.asarray(b.column("dim"))
                for dim in np.unique(dims):
                    part = b.take(pa.array(np.flatnonzero(dims == dim)))
                    v = matrix(part.column("embedding"), np.float64)
                    v = v / np.abs(v).max(1, keepdims=True)
                    row, name = filters_of(v / np.linalg.norm(v, axis=1, keepdims=True), filters, cut, recall)
                    ends = np.searchsorted(row, np.arange(len(v) + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(ends, pa.array(name, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "filters"])

    return run


def _links(v: np.ndarray, norm: np.ndarray, row: np.ndarray, smaller: np.ndarray, half: np.ndarray, cut: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, at or above the cut that have no smaller filter in common.

    row, smaller: the vectors' filters under this one. half: 0 for all pairs, else only pairs of a 1 with a 2.
    """
    n = len(v)
    names, column, held = np.unique(smaller, return_inverse=True, return_counts=True)
    keep = held[column] > 1
    row, column = row[keep], column[keep]
    names, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        near = (v[lo:hi] @ v[lo:].T) / (norm[lo:hi, None] * norm[None, lo:]) >= cut
        near &= np.arange(lo, n)[None, :] > np.arange(lo, hi)[:, None]
        if half.any():
            near &= half[lo:hi, None] != half[None, lo:]
        for at in range(0, len(names), 4096):
            if not near.any():
                break
            p, q = np.searchsorted(column, [at, at + 4096])
            r, c = row[p:q], column[p:q] - at
            x = np.zeros((n - lo, min(4096, len(names) - at)), np.float32)
            x[r[r >= lo] - lo, c[r >= lo]] = 1
            near &= (x[: hi - lo] @ x.T) == 0
        a, b = np.nonzero(near)
        yield a + lo, b + lo


def _verify(cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 5):
            own, ca, cb = (t.column(i)[0].as_py() for i in (2, 3, 4))
            v = matrix(t.column("embedding"), np.float64)
            v = v / np.abs(v).max(1, keepdims=True)
            half = np.zeros(len(v), int) if ca == cb else np.where(np.asarray(t.column("chunk")) == ca, 1, 2)
            norm, ids, weight = np.linalg.norm(v, axis=1), np.asarray(t.column("id")), np.asarray(t.column("weight"))
            lists = t.column("filters").combine_chunks()
            row, smaller = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
            order = np.argsort(ids, kind="stable")
            place = np.argsort(order)
            row, smaller = place[row[smaller < own]], smaller[smaller < own]
            v, norm, ids, weight, half = v[order], norm[order], ids[order], weight[order], half[order]
            links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for a, b in _links(v, norm, row, smaller, half, cut):
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                label = label[roots(len(ids), np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, label]))]
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[label[some]])], ["id", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, cut: float = 0.98, per_vector: int = 16, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """Links of cosine >= cut (double precision) among vectors of equal labels.

    Equal vectors of a label are first made one with a weight. Each is decoded to
    all filters whose caps hold it; there are about ``per_vector`` filters a vector
    (the code grows with the table, so filters don't fill up), and their one height
    is set so that a pair at the cut shares a filter with a chance of ``recall``,
    nearer ones with a higher one. Filters with one
    vector are dropped, and in each other one all pairs are compared in blocks. A
    pair counts only in its smallest common filter, so what leaves a task is a
    link count and one forest edge a vector, never the pairs. A filter of more
    than ``chunk`` vectors is split into chunks whose pairs are dealt to tasks.

    Returns a row for each input row: vec_id, n_links (other vectors linked
    directly, equal ones too), component_id (smallest vec_id reachable), kept
    (vec_id = component_id). Vectors that are null, empty, zero or hold null or
    non-finite parts, and rows of null label, link with nothing; vectors of
    different lengths never link. Rows of one vec_id are vectors of their own
    that share a component only if they link; a row of null vec_id is returned
    with its links, and its component_id is its component's smallest vec_id that
    isn't null. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    e = F.col("embedding")
    number = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), number.alias("embedding"))
    base = base.withColumn("ok", F.coalesce(usable, F.lit(False)))
    # two 64-bit hashes name a vector; the label is part of both
    h = lambda salt: F.xxhash64(F.lit(salt), "label", F.transform("embedding", lambda x: x + F.lit(0.0)))
    base = base.withColumn("h", F.when(F.col("ok"), h("a"))).withColumn("g", F.when(F.col("ok"), h("b")))
    same = base.where("ok").groupBy("h", "g").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    same = same.select(F.col("h").alias("id"), "g", "weight", "least", F.xxhash64("label").alias("label"), F.size("embedding").cast("long").alias("dim"), "embedding")
    same = scratch.save(same, "same")
    count = same.count()
    filters = 1 << max(6, int(np.ceil(np.log2(max(1, count) * per_vector))))
    listed = same.select("id", "weight", "label", "dim", "embedding").mapInArrow(_decode(filters, cut, recall), "id long, weight long, label long, dim long, embedding array<double>, filters array<long>")
    listed = scratch.save(listed, "listed")
    places = listed.select("label", "dim", F.explode("filters").alias("filter"), "id")
    shared = places.groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(chunk)).cast("long")
    met = places.join(shared, ["label", "dim", "filter"]).select("id", "filter", chunks.alias("c"))
    need = met.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("c"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    need = need.select("id", "filter", "chunk", F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb"))
    dealt = need.join(listed, "id").select("label", "dim", "filter", "ca", "cb", "id", "weight", "chunk", "embedding", "filters")
    keys = ["label", "dim", "filter", "ca", "cb"]
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    found = scratch.save(dealt.mapInArrow(_verify(cut), "id long, links long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(spark, found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch=scratch)
    known = same.select("id", "g", "weight", "least").join(links, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    known = scratch.save(known.withColumn("component", F.coalesce("component", "id")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(F.col("id").alias("h"), "g", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = base.select("vec_id", "h", "g").join(known, ["h", "g"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
