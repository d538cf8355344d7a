"""Levels above the first: recursion of sequences, graphs of clusters, comparison of hierarchies."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters
from gradus.functions.compare import guarded, signed_min
from gradus.operators import graph, params
from gradus.operators.components import components_within
from gradus.plans.scratch import Scratch, partitions, rounds


LEVEL = "fork string, param string, sign_fork string, seg long, L long, I double, D double, M double, Rdn long, x0 long, ix0 long, flay boolean, line_id long, path string, taken boolean"


def sequence_levels(spark: SparkSession, runs: DataFrame, filters: Filters = DEFAULT, levels: int | None = None) -> DataFrame:
    """The second level's comparison applied again to its own groups.

    A group is the sequence of runs of one (line, path, fork, param, sign); its path
    names the groups above it. Only groups of at least three runs whose summed
    match exceeds 4 * ave are taken up, so levels don't grow by eight each time.
    Ends when no group qualifies (or at ``levels``).
    """
    scratch, out = Scratch(spark, "levels"), []
    current = runs.select("line_id", F.lit("").alias("path"), "fork", "seg", "L", "I", "D", "M", "Rdn", "x0")
    for level in rounds(2, levels):
        # a level is one shuffle by line; many lines are worked on at once, and each tells itself which of its groups are taken up
        by_line = current.repartition("line_id").sortWithinPartitions("line_id", "path", "fork", "seg")
        pps = by_line.mapInArrow(params.second_level_of_lines(filters), LEVEL).withColumn("level", F.lit(level))
        pps = scratch.save(pps, f"level{level}")
        out.append(pps.drop("taken"))
        current = pps.where("taken").select("line_id", F.concat("path", "fork", "param").alias("path"), F.col("sign_fork").alias("fork"), "seg", "L", "I", "D", "M", "Rdn", "x0")
        if current.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def splice_runs(derts_by_run: DataFrame, derps: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Runs of a line's fork that are alike over a step of two but not over one, summed into one.

    Neighbours k and k + 2 whose match over two steps exceeds ave_splice times that
    over one step (1 at least) join, with the run between them; chains merge.
    """
    w = Window.partitionBy("line_id", "fork").orderBy("pos")
    two = derps.where("step = 2").select("line_id", "fork", "pos", F.col("m").alias("m2"))
    one = derps.where(((F.col("fork") == "d") & (F.col("param") == "D") | (F.col("fork") == "m") & (F.col("param") == "M")) & (F.col("step") == 1)).select("line_id", "fork", "pos", F.col("m").alias("m1"))
    good = two.join(one, ["line_id", "fork", "pos"]).where(F.col("m2") / F.greatest(F.abs("m1"), F.lit(1.0)) > filters.ave_splice)
    marks = derts_by_run.select("line_id", "fork", F.col("seg").alias("pos"), "L", "I", "D", "M", "Rdn", "x0").join(good.withColumn("hit", F.lit(1)).select("line_id", "fork", "pos", "hit"), ["line_id", "fork", "pos"], "left")
    tied = F.coalesce(F.lag("hit", 1).over(w), F.lag("hit", 2).over(w), F.lit(0))
    grouped = marks.withColumn("new", 1 - tied).withColumn("group", F.sum("new").over(w) - 1)
    return grouped.groupBy("line_id", "fork", "group").agg(F.count("*").alias("n_runs"), *(F.sum(c).alias(c) for c in ("L", "I", "D", "M", "Rdn")), F.min("x0").alias("x0"))


def derivation_of_comparisons(derps: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Second-order comparison: consecutive |d| inside qualifying runs of comparisons (|D| / L over its cost)."""
    key = ["line_id", "fork", "param"]
    w = Window.partitionBy(*key).orderBy("pos")
    seg = derps.withColumn("c", F.coalesce((F.col("d") > 0) != F.lag(F.col("d") > 0).over(w), F.lit(True)).cast("long")).withColumn("seg", F.sum("c").over(w) - 1)
    run = Window.partitionBy(*key, "seg")
    big = seg.withColumns({"sum_d": F.sum("d").over(run), "n": F.count("*").over(run)}).where((F.col("n") > 1) & (F.abs("sum_d") / F.col("n") > filters.pp_D))
    before = F.lag(F.abs("d")).over(run.orderBy("pos"))
    own = big.withColumn("prior", before).where("prior is not null")
    dd = F.abs("d") - F.col("prior")
    return own.select(*key, "seg", "pos", (F.abs("d") + F.col("prior")).alias("p"), dd.alias("d"), (F.least(F.abs("d"), F.col("prior")) - F.abs(dd) / 2 - filters.pp_D).alias("m"))


def fork_sums(links: DataFrame, membership: DataFrame) -> DataFrame:
    """Of every cluster: c-weighted mean vectors of its inner links (kind L) and of the links over its border (kind B)."""
    side = lambda s: membership.select(F.col("node_id").alias(s), F.col("root").alias(f"k_{s}"))
    met = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    inner = met.where("k_a = k_b").withColumn("root", F.col("k_a")).withColumn("kind", F.lit("L"))
    cross = met.where("k_a is distinct from k_b").withColumn("root", F.explode(F.array_compact(F.array("k_a", "k_b")))).withColumn("kind", F.lit("B"))
    long = inner.unionByName(cross).withColumn("root_kind", F.struct("root", "kind"))
    return graph.weighted_sums(long, "root_kind").select("root_kind.*", "c", "m", "d", *(f"{p}_{k}" for p in "md" for k in graph.PARAMS))


def combined_forks(forks: DataFrame) -> DataFrame:
    """Inner and border forks of each cluster compared (signed minima and differences of their d rows)."""
    pick = lambda kind, p: forks.where(F.col("kind") == kind).select("root", F.col("c").alias(f"{p}c"), *(F.col(f"d_{k}").alias(f"{p}_{k}") for k in graph.PARAMS))
    met = pick("L", "l").join(pick("B", "b"), "root")
    m = sum((signed_min(f"l_{k}", f"b_{k}") for k in graph.PARAMS), F.lit(0.0))
    d = sum((F.abs(F.col(f"l_{k}") - F.col(f"b_{k}")) for k in graph.PARAMS), F.lit(0.0))
    return met.select("root", m.alias("m"), d.alias("d"), (F.col("lc") + F.col("bc")).alias("c"))


def trace_edges(spark: SparkSession, nodes: DataFrame, links: DataFrame, membership: DataFrame, least: float) -> DataFrame:
    """Clusters with a border link between them, compared as nodes; (node_id, root) of clusters joined by a match over ``least``."""
    side = lambda s: membership.select(F.col("node_id").alias(s), F.col("root").alias(f"k_{s}"))
    met = links.select("group", "a", "b").join(side("a"), "a").join(side("b"), "b").where("k_a <> k_b")
    pairs = met.select("group", F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b")).distinct().withColumn("dist", F.lit(0.0))
    compared = graph.compare_nodes(pairs, graph.as_nodes(graph.aggregate_nodes(nodes, membership)))
    return components_within(spark, compared.where(F.col("m") > least), ["group"]).select("node", "component").toDF("node_id", "root")


def level_order(levels: DataFrame, by: str = "m") -> DataFrame:
    """Levels of each group (group, level, m, d) ranked by value; shift is how far a level moved from its place."""
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc(by), "level"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("level"))
    return levels.withColumn("rank", rank).withColumn("shift", place - rank)


def compare_hierarchies(levels: DataFrame) -> DataFrame:
    """Pairs of neighbouring groups compared level by level: signed minima and differences of m and d, c-weighted over levels."""
    after = levels.select((F.col("group") - 1).alias("group"), "level", F.col("c").alias("c2"), F.col("m").alias("m2"), F.col("d").alias("d2"))
    met = levels.join(after, ["group", "level"]).withColumn("w", F.least("c", "c2"))
    mean = lambda x: F.sum(x * F.col("w")) / guarded(F.sum("w"))
    return met.groupBy("group").agg(F.count("*").alias("n_levels"), mean(signed_min("m", "m2") + signed_min("d", "d2")).alias("m"), mean(F.abs(F.col("m") - F.col("m2")) + F.abs(F.col("d") - F.col("d2"))).alias("d"))


#: Entries of a range's lists held before they are summed up, and products of them summed up at once.
HELD, AT_ONCE = 1 << 22, 1 << 21


def _summed(a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of a pair brought together: the first value summed, the others kept."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[heads], b[heads], np.add.reduceat(values[0][order], heads), *(v[order][heads] for v in values[1:])


def _products(lists: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """Pairs (a, b, shared, t_a, t_b) of the lists of a range: each of a list's first sets, which have weights, with every set after it."""
    flat = lambda c: np.concatenate([x[c].flatten().to_numpy(zero_copy_only=False) for x in lists])
    sizes = lambda c: np.concatenate([x[c].value_lengths().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
    ids, t, w, size, own = flat("set_id"), flat("t"), flat("w"), sizes("set_id"), sizes("w")
    sets, at = np.unique(ids, return_inverse=True)
    total = np.empty(len(sets), t.dtype)
    total[at] = t
    row = np.repeat(np.arange(len(own)), own)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
    place, after = (np.cumsum(size) - size)[row] + nth, size[row] - nth - 1
    order = np.argsort(at[place], kind="stable")
    place, after, w, a = place[order], after[order], w[order], at[place[order]]
    heads = np.flatnonzero(np.diff(a, prepend=-1))
    block = np.cumsum(np.add.reduceat(after, heads)) // AT_ONCE
    cuts = np.r_[heads[np.flatnonzero(np.diff(block, prepend=-1))], len(a)]
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        n = after[lo:hi]
        other = at[np.repeat(place[lo:hi] + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())]
        code, weight = np.repeat((a[lo:hi] - a[lo]) * len(sets), n) + other, np.repeat(w[lo:hi], n)
        cells = (a[hi - 1] - a[lo] + 1) * len(sets)
        if cells <= 4 * len(code):  # a table of all cells, else only those met
            met, shared = np.zeros(cells, bool), np.zeros(cells, w.dtype)
            met[code] = True
            np.add.at(shared, code, weight)
            pair = np.flatnonzero(met)
            shared = shared[pair]
        else:
            pair, to = np.unique(code, return_inverse=True)
            shared = np.zeros(len(pair), w.dtype)
            np.add.at(shared, to, weight)
        i, j = a[lo] + pair // len(sets), pair % len(sets)
        out.append((sets[i], sets[j], shared, total[i], total[j]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _range_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of range after range, from lists that come in order of their range."""

    def pairs(done: list) -> Iterator[pa.RecordBatch]:
        cols = done[0] if len(done) == 1 else _summed(*(np.concatenate(c) for c in zip(*done)))
        for i in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], ["a", "b", "shared", "t_a", "t_b"])

    current, lists, held, done = None, [], 0, []
    for batch in batches:
        of = batch["range"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if lists and (of[lo] != current or held >= HELD):
                done.append(_products(lists))
                lists, held = [], 0
            if done and of[lo] != current:
                yield from pairs(done)
                done = []
            current, part = of[lo], batch.slice(lo, hi - lo)
            lists.append(part)
            held += len(part["set_id"].flatten())
    if lists:
        done.append(_products(lists))
    if done:
        yield from pairs(done)


#: Entries of members' lists that a task packs at once, and rows of members that a range has at most where there are more ranges than partitions.
PACKED, IN_RANGE = 1 << 20, 125_000


def _packed(values: np.ndarray) -> bytes:
    """An array's bytes, the first of all values, then the second of all, …, compressed: small numbers take little."""
    if values.dtype == object:
        return pickle.dumps(values)
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: np.dtype, n: int) -> np.ndarray:
    if kind == object:
        return pickle.loads(data)
    planes = np.frombuffer(pa.decompress(data, n * kind.itemsize, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


PARCEL = "range int, lists long, size binary, own binary, w binary, first binary, steps binary"


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members' lists (set_id, range, w by set_id) as a row for each range that holds one of their sets: all lists from their first such set on."""
    names = [c.split()[0] for c in PARCEL.split(", ")]

    def parcels(lists: list[pa.RecordBatch]) -> pa.RecordBatch:
        of = pa.chunked_array([x["of"] for x in lists]).combine_chunks()
        size, (ids, to, w) = of.value_lengths().to_numpy(), (of.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("set_id", "range", "w"))
        start = np.cumsum(size) - size
        head = np.ones(len(ids), bool)
        head[1:] = to[1:] != to[:-1]
        head[start] = True
        head = np.flatnonzero(head)
        own, left = np.diff(np.r_[head, len(ids)]), np.repeat(start + size, size)[head] - head
        head, own, left = (c[left > 1] for c in (head, own, left))
        order = np.argsort(to[head], kind="stable")
        head, own, left = head[order], own[order], left[order]
        rows = []
        for part in np.split(np.arange(len(head)), np.flatnonzero(np.diff(to[head])) + 1):
            flat = lambda n: np.repeat(head[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            set_, begin = ids[flat(left[part])], np.cumsum(left[part]) - left[part]
            # only an integer's step from the one before it is sent
            steps = set_ if set_.dtype.kind not in "iu" else np.diff(set_, prepend=set_[:1])
            if set_.dtype.kind in "iu":
                steps[begin] = 0
            rows.append((to[head[part[0]]], len(part), *map(_packed, (left[part], own[part], w[flat(own[part])], set_[begin], steps))))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    lists, held = [], 0
    for batch in batches:
        lists.append(batch)
        held += len(batch["of"].flatten())
        if held >= PACKED:
            yield parcels(lists)
            lists, held = [], 0
    if held:
        yield parcels(lists)


def _listed(batches: Iterator[pa.RecordBatch], totals: str, set_kind: np.dtype, w_kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """The lists of parcels, with the sets' total weights out of the shared folder."""
    sets = t = None
    for batch in batches:
        for row in batch.to_pylist():
            if sets is None:
                where, path = fs.FileSystem.from_uri(totals) if ":" in totals else (fs.LocalFileSystem(), totals)
                table = pq.read_table(path, filesystem=where).sort_by("set_id")
                sets, t = (table[c].to_numpy() for c in ("set_id", "t"))
            size, own = (_unpacked(row[c], np.dtype(np.int64), row["lists"]) for c in ("size", "own"))
            w, ids = _unpacked(row["w"], w_kind, own.sum()), _unpacked(row["steps"], set_kind, size.sum())
            if set_kind.kind in "iu":
                first, begin = _unpacked(row["first"], set_kind, len(size)), np.cumsum(size) - size
                ids = np.cumsum(ids, dtype=set_kind)
                ids += np.repeat(first - ids[begin], size)
            lists = lambda n, c: pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), row["range"])), lists(size, ids), lists(size, t[np.searchsorted(sets, ids)]), lists(own, w)], ["range", "set_id", "t", "w"])


def weighted_overlap(members: DataFrame) -> DataFrame:
    """For sets (set_id, member, w): pairs that share a member, with shared weight over unshared weight.

    Pairs come from the members they share, never from a cross join; the weights of
    repeated rows add up, null ones count nothing. Sets are dealt to ranges. A member's list goes once to each
    range that holds one of its sets, from the first such set on, and a pair is summed
    where its lower set lies: lists are shuffled, not a row for each pair and member. They are packed, the
    lists of a task and range in one row (some two bytes a set); total weights lie in the shared folder, 16 bytes a set.
    """
    spark = members.sparkSession
    known = members.where("set_id IS NOT NULL")
    ranges = max(partitions(spark), known.count() // IN_RANGE)
    # whole sets lie in a range, and ranges ascend with set_id
    sets = known.repartitionByRange(ranges, "set_id").groupBy("set_id", "member").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"))
    scratch, summed = Scratch(spark, "overlap"), known.groupBy("set_id").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("t"))
    scratch.save(summed, "totals")
    dealt = sets.withColumn("range", F.spark_partition_id()).where("member IS NOT NULL")
    lists = dealt.groupBy("member").agg(F.sort_array(F.collect_list(F.struct("set_id", "range", "w"))).alias("of")).where(F.size("of") > 1)
    met = lists.select("of").mapInArrow(_parcels, PARCEL).repartition(ranges, "range").sortWithinPartitions("range")
    kind = {f.name: f.dataType.simpleString() for f in [*sets.schema, *summed.schema]}
    fixed = {"bigint": "i8", "int": "i4", "smallint": "i2", "tinyint": "i1", "double": "f8", "float": "f4"}
    totals, set_kind, w_kind = scratch.path("totals"), *(np.dtype(fixed.get(kind[c], "O")) for c in ("set_id", "w"))
    schema = f"a {kind['set_id']}, b {kind['set_id']}, shared {kind['w']}, t_a {kind['t']}, t_b {kind['t']}"
    shared = met.mapInArrow(lambda batches: _range_pairs(_listed(batches, totals, set_kind, w_kind)), schema)
    return shared.select("a", "b", "shared", (F.col("shared") / guarded(F.col("t_a") + F.col("t_b") - 2 * F.col("shared"))).alias("overlap"))


def prune_overlaps(membership: DataFrame, ave: float) -> DataFrame:
    """Members of overlapping clusters (centroid, node_id, match) kept where match > ave * rank among the node's clusters."""
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("match"), "centroid"))
    return membership.withColumn("rank", rank).where(F.col("match") > ave * F.col("rank"))
