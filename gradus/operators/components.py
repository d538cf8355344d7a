"""Connected components of an edge table, labelled by the smallest node.

Every partition first contracts its own edges to a spanning forest, which
leaves at most one edge per node and partition. A forest of at most
``one_task_edges`` edges (counted first) is finished by one task; a larger one
by alternating large-star and small-star rounds, each written to the shared
folder, until the edge set is a set of stars.

Components that never leave a frame, line or group (``within``) need no rounds:
each group's edges meet in one task, which joins them group after group. Groups
over a bound (counted first) go the first way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.plans.scratch import Scratch

ONE_TASK_EDGES = 200_000
MAX_ROUNDS = 60
#: Edges of a group that one task joins.
GROUP_EDGES = 2_000_000
#: Rows of a batch that such a task puts out.
BATCH = 50_000


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a, b) -> None:
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        a, b = self.find(a), self.find(b)
        if a < b:
            self.parent[b] = a
        elif b < a:
            self.parent[a] = b


def _values(column: pa.Array) -> list:
    """A column's values; structs as tuples, which compare as Spark compares structs."""
    if pa.types.is_struct(column.type):
        return list(zip(*(c.to_pylist() for c in column.flatten())))
    return column.to_pylist()


def _column(values: list, type_: pa.DataType) -> pa.Array:
    if pa.types.is_struct(type_):
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values), type_)], fields=list(type_))
    return pa.array(values, type_)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, schema = Forest(), None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(_values(batch.column(0)), _values(batch.column(1))):
            forest.union(a, b)
    nodes = list(forest.parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [_column(part, schema.field(0).type), _column([forest.find(x) for x in part], schema.field(1).type)],
            schema=schema,
        )


def _contract_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys…, node, component) out of edges (keys…, u, v) in order of their keys, a group at a time."""
    forest, now, ready, schema = Forest(), None, [], None
    n_ready = 0

    def flush() -> pa.RecordBatch:
        columns = [[k for key, nodes, _ in ready for k in [key[c]] * len(nodes)] for c in range(len(schema) - 2)]
        columns += [[x for part in ready for x in part[c]] for c in (1, 2)]
        ready.clear()
        return pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def end() -> None:
        if forest.parent:
            nodes = list(forest.parent)
            ready.append((now, nodes, [forest.find(x) for x in nodes]))

    for batch in batches:
        schema, n = batch.schema, batch.num_rows
        if not n:
            continue
        keys = batch.columns[:-2]
        changed = np.zeros(n, bool)
        changed[0] = True
        for k in keys:
            changed[1:] |= pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(changed)
        heads = list(zip(*(k.take(pa.array(at)).to_pylist() for k in keys)))
        u, v = (_values(c) for c in batch.columns[-2:])
        for head, first, last in zip(heads, at.tolist(), [*at[1:].tolist(), n]):
            if head != now:
                end()
                n_ready += len(forest.parent)
                forest, now = Forest(), head
                if n_ready >= BATCH:
                    n_ready = 0
                    yield flush()
            for k in range(first, last):
                forest.union(u[k], v[k])
    end()
    if ready:
        yield flush()


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    low = _min_neighbour(both)
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components_within(
    spark: SparkSession,
    edges: DataFrame,
    within: list[str],
    a: str = "a",
    b: str = "b",
    group_edges: int = GROUP_EDGES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(within…, node, component) of edges that don't leave a group (columns ``within``, not null); component is the group's smallest node in it.

    As connected_components() with names of (within…, node), but a group of at most ``group_edges`` edges is joined by the task it is
    dealt to, so work and shuffle grow with the edges and there are no rounds.
    """
    scratch = scratch or Scratch(spark, "components")
    whole = edges.select(*within, F.col(a).alias("node"), F.col(b).alias("component")).where("node is not null and component is not null")
    pairs = scratch.save(whole, "edges")
    big = scratch.save(pairs.groupBy(*within).agg(F.count("*").alias("n")).where(F.col("n") > group_edges).select(*within), "big")
    any_big = not big.isEmpty()
    small = pairs.join(big, within, "left_anti") if any_big else pairs
    out = small.repartition(*within).sortWithinPartitions(*within).mapInArrow(_contract_groups, pairs.schema)
    if not any_big:
        return out
    key = lambda c: F.struct(*within, F.col(c).alias("id"))
    found = connected_components(spark, pairs.join(big, within, "left_semi").select(key("node").alias("a"), key("component").alias("b")), scratch=Scratch(spark, "components"))
    return out.unionByName(found.select(*(F.col(f"node.{c}").alias(c) for c in within), F.col("node.id").alias("node"), F.col("component.id").alias("component")))


def connected_components(
    spark: SparkSession,
    edges: DataFrame,
    a: str = "a",
    b: str = "b",
    one_task_edges: int = ONE_TASK_EDGES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Edges with a null end are ignored; loops make a node a component of its own;
    repeated edges and an empty table are fine. A node may be a struct of values that aren't null.
    """
    scratch = scratch or Scratch(spark, "components")
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    forest = scratch.save(pairs.mapInArrow(_contract, pairs.schema), "forest")
    size = forest.count()
    nodes = forest.select(F.col("u").alias("node")).distinct()
    if size <= one_task_edges:
        return forest.coalesce(1).mapInArrow(_contract, pairs.schema).toDF("node", "component")
    edges = forest.where("u <> v")
    seen, name = None, "forest"
    for round_ in range(MAX_ROUNDS):
        edges = scratch.save(_small_star(_large_star(edges)), f"round{round_}")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if round_:
            scratch.drop(f"round{round_ - 1}")
        if mark == seen:
            break
        seen, name = mark, f"round{round_}"
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds; last table: {name}")
    return nodes.join(edges, nodes["node"] == edges["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
