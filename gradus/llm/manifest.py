"""Merkle manifest of a dataset: a tree of hashes over its rows, with a proof for every row by coordinate lookup.

The materialised node table has a row (g, level, i, h) for node i of a level of group g's tree. A row's siblings follow
from its index, the group's size and the arity alone, so a proof is a list of coordinates, a join with the node table
and a fold.

A tree is made in tiers of ``SPAN`` levels: a block of arity^SPAN consecutive nodes becomes one node of the next tier.
Leaves look up the siblings in their block, blocks those in theirs, and so on, as the siblings above a block are the same for
all its leaves. No node is so asked for by more than one block's rows, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm._order import numbered
from gradus.plans.scratch import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a tier: blocks of 256 nodes for an arity of 2.
SPAN = 8
PATH = "array<struct<left:string,right:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of the values as text: - for null, else the length in UTF-8 bytes, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def siblings(path: Column) -> Column:
    """All hashes of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def _levels(arity: int) -> Column:
    """Levels that a tier of n nodes takes: until one remains, SPAN at most."""
    return sum((F.when(F.col("n") > arity**k, 1).otherwise(0) for k in range(SPAN)), F.lit(0))


def _nodes(units: DataFrame, arity: int) -> DataFrame:
    """(g, n, b, level, i, h, levels) of all nodes of a tier over its units (g, n, i, h)."""
    block = units.groupBy("g", "n", F.expr(f"i div {arity**SPAN}").alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("s"))
    hashes = F.col("s")["h"]

    def parents(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
        return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(nodes, j * arity + 1, F.lit(arity)), ""), 256))

    grown = F.aggregate(F.sequence(F.lit(1), F.col("levels")), F.array(hashes), lambda made, _: F.concat(made, F.array(parents(F.element_at(made, -1)))))
    tree = block.withColumn("levels", _levels(arity)).withColumn("tree", F.when(F.col("levels") > 0, grown).otherwise(F.array(hashes)))
    level = tree.select("g", "n", "b", "levels", F.posexplode("tree").alias("level", "row"))
    node = level.select("g", "n", "b", "levels", "level", F.posexplode("row").alias("j", "h"))
    first = F.col("b") * F.pow(F.lit(arity), F.lit(SPAN) - F.col("level")).cast("long")
    return node.select("g", "n", "levels", "level", (first + F.col("j")).alias("i"), "h")


def tiers(units: DataFrame, largest: int, arity: int, scratch: Scratch, name: str) -> list[tuple[DataFrame, DataFrame]]:
    """(units, node table) of every tier, from the leaves (g, n, i, h) up; ``largest`` is the largest n."""
    out = []
    while True:
        nodes = scratch.save(_nodes(units, arity), f"{name}{len(out)}")
        out.append((units, nodes))
        if largest <= arity**SPAN:
            return out
        largest = -(-largest // arity**SPAN)
        above = nodes.where((F.col("n") > arity**SPAN) & (F.col("level") == SPAN))
        units = above.select("g", F.expr(f"(n - 1) div {arity**SPAN} + 1").alias("n"), "i", "h")


def tops(made: list[tuple[DataFrame, DataFrame]], arity: int) -> DataFrame:
    """(g, h) of every group's last node."""
    last = [nodes.where((F.col("n") <= arity**SPAN) & (F.col("level") == F.col("levels"))).select("g", "h") for _, nodes in made]
    out = last[0]
    for x in last[1:]:
        out = out.unionByName(x)
    return out


def _own_paths(units: DataFrame, nodes: DataFrame, arity: int) -> DataFrame:
    """units with own, the path within their tier: coordinates exploded, joined with the nodes, ordered and concatenated."""
    at = "cast(pow({}, {}) as bigint)"
    power = at.format(arity, "l")
    first = f"i div {power} div {arity} * {arity}"
    run = f"transform(sequence({first}, least({first} + {arity - 1}, (n - 1) div {power})), j -> named_struct('level', l, 'at', j))"
    others = f"filter(flatten(transform(sequence(0, levels - 1), l -> {run})), x -> x.at <> i div {at.format(arity, 'x.level')})"
    asked = units.withColumn("levels", _levels(arity)).where("levels > 0").select("g", "i", F.explode(F.expr(others)).alias("x"))
    node = nodes.select("g", F.col("level").alias("at_level"), F.col("i").alias("at"), "h")
    met = asked.select("g", "i", "x.level", "x.at").join(node.withColumnRenamed("at_level", "level"), ["g", "level", "at"])
    found = met.groupBy("g", "i").agg(F.sort_array(F.collect_list(F.struct("level", "at", "h"))).alias("found"))
    side = "array_join(transform(filter(found, x -> x.level = l and x.at {} i div " + power + "), x -> x.h), '')"
    path = f"transform(sequence(0, levels - 1), l -> named_struct('left', {side.format('<')}, 'right', {side.format('>')}))"
    none = f"cast(array() as {PATH})"
    empty = f"transform(sequence(0, levels - 1), l -> named_struct('left', '', 'right', ''))"
    own = F.expr(f"case when levels = 0 then {none} when found is null then {empty} else {path} end")
    return units.join(found, ["g", "i"], "left").withColumn("levels", _levels(arity)).withColumn("own", own).drop("found", "levels")


def paths(made: list[tuple[DataFrame, DataFrame]], ends: DataFrame, arity: int) -> DataFrame:
    """The leaves with path, their siblings up to the end of ends (g, path, …), and the other columns of ends."""
    rest = [c for c in ends.columns if c not in ("g", "path")]
    upper = None
    for units, nodes in reversed(made):
        own = _own_paths(units, nodes, arity)
        end = ends.join(nodes.where((F.col("n") <= arity**SPAN) & (F.col("level") == F.col("levels"))).select("g"), "g")
        over = end.select("g", F.lit(0).cast("long").alias("b"), F.col("path").alias("above"), *rest)
        if upper is not None:
            over = over.unionByName(upper.select("g", F.col("i").alias("b"), F.col("path").alias("above"), *rest))
        b = F.expr(f"i div {arity**SPAN}")
        upper = own.withColumn("b", b).join(over, ["g", "b"]).withColumn("path", F.concat("own", "above")).drop("own", "above", "b")
    return upper


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", arity: int = 2, carried: dict[str, Column] | None = None) -> DataFrame:
    """(order column, group column, carried columns, leaf, subroot, root, path) of every row.

    Every row is a leaf. The leaves of a group, in ascending order (nulls first), make a tree: while there are several
    nodes, each run of ``arity`` consecutive ones (the last run may be shorter, even one node) is hashed into one. The
    groups' last nodes, in order of the group's value (null first, else bytewise), make the top tree in the same way.
    ``carried`` gives further columns by expressions over docs.

    A null group is a group. Rows of equal order value go by their leaf; equal rows are leaves of their own. An empty table
    gives no rows. Columns that aren't named are ignored, whatever their names; a text is hashed whole.
    """
    spark, scratch, carried = docs.sparkSession, Scratch(docs.sparkSession, "manifest"), carried or {}
    named = docs.select(
        F.col(group).alias("grp"), F.col(order).alias("ord"), leaf_hash([F.col(c) for c in fields]).alias("h"),
        F.monotonically_increasing_id().alias("row"), *(x.alias(f"c_{c}") for c, x in carried.items()),
    )
    leaves = scratch.save(named, "leaves")
    groups = numbered(leaves.groupBy("grp").agg(F.count("*").alias("size")), ["grp"], [], scratch, "groups")
    groups = scratch.save(groups.select("grp", "size", F.col("i").alias("g"), F.col("n").alias("groups")), "group_numbers")
    number, largest = groups.agg(F.count("*"), F.max("size")).first()
    placed = numbered(leaves, ["grp", "ord", "h", "row"], ["grp"], scratch, "ordered", groups.select("grp", "g"))
    placed = scratch.save(placed.drop("row"), "units")
    made = tiers(placed.select("g", "n", "i", "h"), largest or 0, arity, scratch, "nodes")
    top = tops(made, arity).join(groups.select("g", "groups"), "g")
    units = scratch.save(top.select(F.lit(0).cast("long").alias("g"), F.col("groups").alias("n"), F.col("g").alias("i"), "h"), "subroots")
    over = tiers(units, number, arity, scratch, "top")
    ends = tops(over, arity).select("g", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("h").alias("root"))
    ends = scratch.save(paths(over, ends, arity).select(F.col("i").alias("g"), "path", F.col("h").alias("subroot"), "root"), "ends")
    made[0] = (placed, made[0][1])
    out = paths(made, ends, arity)
    return out.select(F.col("ord").alias(order), F.col("grp").alias(group), *(F.col(f"c_{c}").alias(c) for c in carried), F.col("h").alias("leaf"), "subroot", "root", "path")
