"""N-gram Jaccard self-join of documents: MinHash LSH forest, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm._groups import grouped, matrix, roots
from gradus.llm._memory import tidy
from gradus.llm._words import BASE, mix, slices, strings
from gradus.llm.fingerprints import low_bits, signatures, text_shingles
from gradus.operators.components import connected_components
from gradus.plans.scratch import Scratch, partitions

TREES, DEPTH, BINS = 32, 6, 256
#: Bins whose low byte estimates likeness inside a prefix group, and the estimate that keeps a pair (0.8 less over four deviations).
SKETCH, ESTIMATE = 128, 0.64
#: Members of a group that one task compares at a time.
CHUNK = 1024
#: A member table of this many rows (about 60 bytes each) may be broadcast.
BROADCAST_MEMBERS = 400_000
BLOCK = 256


def prefix_length(n_shingles: np.ndarray, cut: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """Signature prefix two texts must share, for texts of n distinct shingles.

    Starts at the full depth and is shortened until the chance that some tree
    joins a pair at the cut reaches the target. A short text's bins repeat few
    values, so it counts as fewer trees (one for each two shingles).
    """
    n = np.asarray(n_shingles)
    own = np.clip(n // 2, 1, trees)
    length = np.full(n.shape, depth)
    while True:
        short = ((1 - cut ** length.astype(float)) ** own > 1 - recall) & (length > 1)
        if not short.any():
            return length
        length = length - short


def _sketch(cut: float, recall: float):
    """doc_id, h, g, text → one row a text: signature prefixes (hashed) and likeness sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = strings(b, "text")
            for a, z in slices(offsets):
                for lo in range(a, z, 1000):
                    hi = min(z, lo + 1000)
                    shingle, doc = text_shingles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    sig = signatures(shingle, doc, hi - lo, BINS)
                    count = np.bincount(doc, minlength=hi - lo)
                    prefixes = []
                    # a pair at the cut has sizes of a ratio of at least the cut, so it has a length in common
                    lengths = [prefix_length(np.maximum(1, x), cut, recall) for x in (np.ceil(count * cut).astype(int), count, (count / cut).astype(int))]
                    trees = sig[:, : TREES * DEPTH].reshape(hi - lo, TREES, DEPTH) if TREES * DEPTH <= BINS else None
                    state = np.zeros((hi - lo, TREES), np.uint64) + np.arange(TREES, dtype=np.uint64)
                    at_depth = []
                    for k in range(DEPTH):
                        state = mix(state * np.uint64(BASE) + trees[:, :, k])
                        at_depth.append(state)
                    at_depth = np.stack(at_depth, 1)  # text, length - 1, tree
                    for i in range(hi - lo):
                        keep = sorted({int(x[i]) for x in lengths}) if count[i] else []
                        prefixes.append(at_depth[i, [k - 1 for k in keep]].ravel().view(np.int64))
                    flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                    ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                    low = low_bits(sig[:, :SKETCH], 8)
                    part = b.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array([x.tobytes() for x in low], pa.binary())],
                        names=["doc_id", "h", "g", "prefixes", "sketch"],
                    )

    return run


def _candidates(estimate: float):
    """Groups of equal prefix → a forest edge for every member that looks like another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            ca, cb = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            ids, chunk = np.asarray(t.column("id")), np.asarray(t.column("chunk"))
            order = np.argsort(ids, kind="stable")
            ids, chunk = ids[order], chunk[order]
            raw = b"".join(t.column("sketch").to_pylist())
            low = np.frombuffer(raw, np.uint8).reshape(len(ids), -1)[order]
            n, edges = len(ids), []
            need = (estimate + (1 - estimate) / 256) * low.shape[1]
            for lo in range(0, n, 64):
                hi = min(n, lo + 64)
                near = (low[lo:hi, None, :] == low[None, lo:, :]).sum(2) >= need
                near &= np.arange(lo, n)[None, :] > np.arange(lo, hi)[:, None]
                if ca != cb:
                    near &= chunk[lo:hi, None] != chunk[None, lo:]
                edges.append([x + lo for x in np.nonzero(near)])
            a, b = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
            label = roots(n, a, b)
            some = np.flatnonzero(label != np.arange(n))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[label[some]]), pa.array(ids[some])], ["a", "b"])

    return run


def shared_counts(shingle: np.ndarray, doc: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, counts) of distinct shingles shared by texts lo…hi and all texts from lo on."""
    _, column = np.unique(shingle, return_inverse=True)
    held = np.bincount(column)
    keep = held[column] > 1
    row, column = doc[keep], column[keep]
    names, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        counts = np.zeros((hi - lo, n - lo), np.float32)
        for at in range(0, len(names), 4096):
            p, q = np.searchsorted(column, [at, at + 4096])
            r, c = row[p:q], column[p:q] - at
            x = np.zeros((n - lo, min(4096, len(names) - at)), np.float32)
            here = r >= lo
            x[r[here] - lo, c[here]] = 1
            counts += x[: hi - lo] @ x.T
        yield lo, hi, counts


def _exact(cut: float):
    """Components' texts → links of every text and its smallest linked one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            t = t.combine_chunks()
            ca, cb = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            _, one = np.unique(np.asarray(t.column("id")), return_index=True)  # by id; a repeated row counts once
            b = t.take(pa.array(one)).combine_chunks().to_batches()[0]
            ids, weight, chunk = (np.asarray(b.column(c)) for c in ("id", "weight", "chunk"))
            n = len(ids)
            shingle, doc = [], []
            buf, offsets = strings(b, "text")
            for lo, hi in slices(offsets):
                s, d = text_shingles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                order = np.lexsort((s, d))
                s, d = s[order], d[order]
                first = np.ones(len(s), bool)
                first[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
                shingle.append(s[first])
                doc.append(d[first] + lo)
            shingle, doc = np.concatenate(shingle), np.concatenate(doc)
            size = np.bincount(doc, minlength=n)
            links, label = np.zeros(n, np.int64), np.arange(n)
            for lo, hi, both in shared_counts(shingle, doc, n):
                union = size[lo:hi, None] + size[None, lo:] - both
                near = (both >= cut * union - 1e-6) & (both > 0)
                near &= np.arange(lo, n)[None, :] > np.arange(lo, hi)[:, None]
                if ca != cb:
                    near &= chunk[lo:hi, None] != chunk[None, lo:]
                a, z = (x + lo for x in np.nonzero(near))
                np.add.at(links, a, weight[z])
                np.add.at(links, z, weight[a])
                label = label[roots(n, np.concatenate([a, np.arange(n)]), np.concatenate([z, label]))]
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[label[some]])], ["id", "links", "root"])

    return run


def _chunked(groups: DataFrame, key: str, n: str, chunk: int) -> DataFrame:
    """Members of a group dealt to tasks: whole groups, or pairs of chunks of a large one."""
    count = F.ceil(F.col(n) / F.lit(chunk)).cast("long")
    out = groups.withColumn("chunk", F.pmod(F.xxhash64("id"), count)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return out.withColumns({"ca": F.least("chunk", "other"), "cb": F.greatest("chunk", "other")}).drop("other", n)


def near_documents(docs: DataFrame, cut: float = 0.8, recall: float = 0.9999, chunk: int = CHUNK) -> DataFrame:
    """doc_id, copy_of, n_links, class_id and kept of every document; see classes()."""
    return classes(docs, cut, recall, chunk).drop("h", "g", "class")


def one_of_each(docs: DataFrame, cut: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The documents with one of each class: that of the smallest doc_id (null last, then by text hash), once.

    What decides is a table of one id and hash a class, broadcast only if counted
    to hold at most BROADCAST_MEMBERS rows.
    """
    spark = docs.sparkSession
    found = Scratch(spark, "classes").save(classes(docs, cut, recall), "classes")
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), "h", "g")
    chosen = found.groupBy("class").agg(F.min(key).alias("k")).select(F.col("k.d").alias("c_id"), F.col("k.h").alias("c_h"), F.col("k.g").alias("c_g"))
    chosen = Scratch(spark, "classes").save(chosen, "chosen")
    n = chosen.count()
    columns = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("r_id"), F.xxhash64(text).alias("r_h"), F.xxhash64(F.lit("g"), text).alias("r_g"), *(F.col(c).alias(f"own_{i}") for i, c in enumerate(columns)))
    same = lambda a: F.col(f"{a}_id").eqNullSafe(F.col("c_id")) & (F.col(f"{a}_h") == F.col("c_h")) & (F.col(f"{a}_g") == F.col("c_g"))
    right = F.broadcast(chosen) if n <= BROADCAST_MEMBERS else chosen
    out = named.join(right, same("r"), "left_semi")
    ids = found.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), F.col("g").alias("r_g"))
    if ids.join(right, same("r"), "left_semi").count() > n:  # the very rows repeat
        out = out.dropDuplicates(["r_id", "r_h", "r_g"])
    return out.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(columns)))


def classes(docs: DataFrame, cut: float = 0.8, recall: float = 0.9999, chunk: int = CHUNK) -> DataFrame:
    """Documents linked by Jaccard likeness >= cut of their sets of five-word shingles.

    Equal texts are first made one with a weight. A signature of 256 bins gives
    32 trees of depth 6; a text's prefix in each tree is as long as the target
    recall allows for its size. Prefixes of one text are dropped, the rest meet
    in groups where a sketch of 128 bytes drops unlike pairs, and each group
    leaves a forest edge a member. The components of that forest hold every
    candidate pair, so each text travels once to its component, where all pairs
    are compared exactly with the sets themselves. Prefix groups and components
    above ``chunk`` members are split into pairs of chunks; nothing is capped.
    What leaves a task is a link count and a forest edge a text.

    Returns one row a document: doc_id, copy_of (smallest doc_id of the same
    text), n_links (documents it is linked to, copies too), class_id (smallest
    doc_id reachable), kept (doc_id = class_id). Null text is empty; equal empty
    texts are copies; texts without words link only to equal ones; a text of
    under five words is one shingle. Rows of equal doc_id and text are copies,
    of equal doc_id and other text different texts. A null doc_id never names a
    class unless all its members are null. An empty table gives no rows; other
    columns are ignored. h, g (the text's hashes) and class (a key) are for joins.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "forest")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit("g"), "text").alias("g"), "text")
    sketched = base.mapInArrow(tidy(_sketch(cut, recall)), "doc_id long, h long, g long, prefixes array<long>, sketch binary")
    sketched = scratch.save(sketched, "sketched")
    same = sketched.groupBy("h", "g").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.first("prefixes").alias("prefixes"), F.first("sketch").alias("sketch"))
    same = scratch.save(same.withColumnRenamed("h", "id"), "same")
    places = same.select("id", F.explode("prefixes").alias("prefix"))
    shared = places.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    met = _chunked(places.join(shared, "prefix"), "prefix", "n", chunk)
    keys = ["prefix", "ca", "cb"]
    dealt = met.join(same.select("id", "sketch"), "id").select(*keys, "id", "chunk", "sketch")
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    edges = dealt.mapInArrow(tidy(_candidates(ESTIMATE)), "a long, b long").distinct()
    component = connected_components(spark, edges, scratch=scratch)
    component = scratch.save(component.toDF("id", "component"), "component")
    sizes = component.groupBy("component").agg(F.count("*").alias("n"))
    member = component.join(sizes, "component").join(same.select("id", "g", "weight", "least"), "id")
    member = scratch.save(member, "member")
    small = member.count() <= BROADCAST_MEMBERS
    right = member.select(F.col("id").alias("h"), "g", F.col("least").alias("doc_id"), "component", "n", "weight")
    texts = base.alias("t").join(F.broadcast(right).alias("m") if small else right.alias("m"), (F.col("t.h") == F.col("m.h")) & (F.col("t.g") == F.col("m.g")) & F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")))
    texts = texts.select(F.col("t.h").alias("id"), "component", "n", "weight", "text")
    keys = ["component", "ca", "cb"]
    dealt = _chunked(texts, "component", "n", chunk).select(*keys, "id", "weight", "chunk", "text")
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    found = scratch.save(dealt.mapInArrow(tidy(_exact(cut)), "id long, links long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = connected_components(spark, found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch=Scratch(spark, "forest"))
    known = same.select("id", "g", "weight", "least").join(links, "id", "left").join(linked.toDF("id", "class"), "id", "left")
    known = scratch.save(known.withColumn("class", F.coalesce("class", "id")), "known")
    least = known.groupBy("class").agg(F.min("least").alias("class_id"))
    known = known.join(least, "class").select(F.col("id").alias("h"), "g", F.col("least").alias("copy_of"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "class", "class_id")
    out = sketched.select("doc_id", "h", "g").join(known, ["h", "g"])
    return out.select("doc_id", "copy_of", "n_links", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"), "h", "g", "class")
