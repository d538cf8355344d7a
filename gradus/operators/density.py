"""Values of a graph's nodes by their neighbourhoods, and graphs grown over links by those values.

Links are (group, a, b, m, r, dist); only those with m > ave_node * r take part. A link passes on decay ^ dist of a value.
Groups settle one by one: a settled group leaves the later rounds, whose tables hold the others only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters
from gradus.operators.components import components_within
from gradus.operators.graph import ends
from gradus.plans.scratch import Scratch, rounds

#: A change is none under this part of the value.
SETTLED = 1e-9
#: Part of a kernel's relative value that goes back to the one under it.
RIM_COEF = 0.5


def positive(links: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    return links.where(F.col("m") > F.lit(filters.ave_node) * F.col("r"))


def _rims(links: DataFrame, filters: Filters) -> DataFrame:
    """Positive links from both their nodes, with the part of a value that they pass on."""
    both = ends(positive(links, filters).select("group", "a", "b", "m", "r", "dist"))
    return both.select("group", "node_id", "other", "m", "r", F.pow(F.lit(filters.decay), F.col("dist")).alias("passed"))


def _unsettled(change: Column, level: Column) -> Column:
    return F.abs(change) > F.lit(SETTLED) * F.greatest(F.abs(level), F.lit(1.0))


def connectivity(links: DataFrame, filters: Filters = DEFAULT, least_change: float | None = None) -> DataFrame:
    """(group, node_id, n, v, w, round): how well each node is connected, over ever longer ways.

    v and w start as the sums of the node's positive links' m and r. In a round each becomes the mean of itself and the mean, over those links, of what
    the other nodes' values pass on. A group settles in the round in which the total passed on gains no more than ave_node times what
    the total of w gains (as values mostly fade on their way, that is soon), or, with ``least_change``, in which it changes by no more than that a node.
    The values are those of that round. Nodes without a positive link have no row.
    """
    scratch = Scratch(links.sparkSession, "connectivity")
    rims = scratch.save(_rims(links, filters), "rims")
    state = rims.groupBy("group", "node_id").agg(F.count("*").alias("n"), F.sum("m").alias("v"), F.sum("r").alias("w"))
    state = scratch.save(state, "start")
    totals = state.select("group").distinct().withColumns({"before_v": F.lit(0.0), "before_w": F.lit(0.0)})
    out = []
    for k in rounds():
        told = rims.join(state.select("group", F.col("node_id").alias("other"), F.col("v").alias("v_other"), F.col("w").alias("w_other")), ["group", "other"])
        sums = told.groupBy("group", "node_id").agg(F.sum(F.col("v_other") * F.col("passed")).alias("gain_v"), F.sum(F.col("w_other") * F.col("passed")).alias("gain_w"))
        new = state.join(sums, ["group", "node_id"])
        half = lambda x: ((F.col(x) + F.col(f"gain_{x}") / F.col("n")) / 2).alias(x)
        new = scratch.save(new.select("group", "node_id", "n", half("v"), half("w"), "gain_v", "gain_w"), f"values{k}")
        now = new.groupBy("group").agg(F.sum("gain_v").alias("now_v"), F.sum("gain_w").alias("now_w"), F.count("*").alias("nodes")).join(totals, "group")
        gain_v, gain_w = F.col("now_v") - F.col("before_v"), F.col("now_w") - F.col("before_w")
        open_ = gain_v > F.lit(filters.ave_node) * gain_w if least_change is None else F.abs(gain_v) > F.lit(least_change) * F.col("nodes")
        open_ = open_ & _unsettled(gain_v, F.col("before_v"))
        judged = scratch.save(now.select("group", F.col("now_v").alias("before_v"), F.col("now_w").alias("before_w"), open_.alias("open")), f"groups{k}")
        values = new.drop("gain_v", "gain_w").join(judged.select("group", "open"), "group")
        out.append(values.where("not open").drop("open").withColumn("round", F.lit(k)))
        totals = judged.where("open").drop("open")
        if totals.isEmpty():
            break
        state = values.where("open").drop("open")
        rims = rims.join(totals.select("group"), "group", "left_semi")
    return reduce(DataFrame.unionByName, out)


def convolved(links: DataFrame, layers: int = 3, filters: Filters = DEFAULT) -> DataFrame:
    """(group, node_id, v, round): values of nodes summed over their widening neighbourhoods and set right by them from the top down.

    v starts as the sum of a node's positive links' m. Forward, ``layers`` times: a node's kernel is the mean of its own and its
    neighbours' kernels of the layer below (these times what the link passes on). Back, from the top: each kernel is scaled by 1 + RIM_COEF * (s - 1), where s,
    the lesser over the greater of it and the kernel above it, says how alike they are; the lowest scaled kernel is the new v. A group settles when its total v
    falls by less than ave_node times its number of nodes, or nothing changes. Values never grow (s is at most 1), so every group settles.
    """
    scratch = Scratch(links.sparkSession, "convolved")
    rims = scratch.save(_rims(links, filters), "rims")
    state = scratch.save(rims.groupBy("group", "node_id").agg(F.sum("m").alias("v")), "start")
    out = []
    for k in rounds():
        forward = state.withColumn("k0", F.col("v"))
        for layer in range(1, layers + 1):
            below = f"k{layer - 1}"
            near = rims.join(forward.select("group", F.col("node_id").alias("other"), F.col(below).alias("theirs")), ["group", "other"])
            sums = near.groupBy("group", "node_id").agg(F.sum(F.col("theirs") * F.col("passed")).alias("s"), F.sum("passed").alias("p"))
            forward = forward.join(sums, ["group", "node_id"]).withColumn(f"k{layer}", (F.col(below) + F.col("s")) / (F.lit(1.0) + F.col("p"))).drop("s", "p")
        scaled = F.col(f"k{layers}")
        for layer in reversed(range(layers)):
            own = F.col(f"k{layer}")
            alike = F.when(F.greatest(own, scaled) > 0, F.least(own, scaled) / F.greatest(own, scaled)).otherwise(F.lit(1.0))
            scaled = own * (F.lit(1.0) + F.lit(RIM_COEF) * (alike - F.lit(1.0)))
        new = scratch.save(forward.select("group", "node_id", "v", scaled.alias("new")), f"values{k}")
        judged = new.groupBy("group").agg(F.count("*").alias("n"), F.sum("v").alias("before"), F.sum("new").alias("after"))
        fall = F.col("before") - F.col("after")
        judged = scratch.save(judged.select("group", ((fall > F.lit(filters.ave_node) * F.col("n")) & _unsettled(fall, F.col("before"))).alias("open")), f"groups{k}")
        values = new.select("group", "node_id", F.col("new").alias("v")).join(judged, "group")
        out.append(values.where("not open").drop("open").withColumn("round", F.lit(k)))
        left = judged.where("open").select("group")
        if left.isEmpty():
            break
        state, rims = values.where("open").drop("open"), rims.join(left, "group", "left_semi")
    return reduce(DataFrame.unionByName, out)


def segmented(spark: SparkSession, links: DataFrame, nodes: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """(group, node_id, graph, kept): graphs grown over positive links whose match and the connectivity that their ends share pass the gate.

    nodes holds (group, node_id, v, w), as of connectivity(). At first each node is a graph. The links between two graphs have the mean m and r of all links between
    their nodes; a merge passes if mean m plus the lesser of both graphs' mean v exceeds ave_node times (mean r plus the mean of both graphs' mean w). In each
    round every graph picks the passing neighbour with the highest excess (then the least name), all at once; graphs joined by picks become one, and
    sums, links between graphs and so the gate are computed again. It ends when nothing passes. A graph is kept if its v exceeds ave_node times its w.

    Every graph with a passing neighbour merges in every round, so rounds grow with the logarithm of the nodes. Links inside a graph leave
    the table, the others are summed by pair of graphs, which takes a node of very many links apart before it is joined.
    """
    scratch = Scratch(spark, "segmented")
    graphs = scratch.save(nodes.select("group", F.col("node_id").alias("graph"), F.lit(1).cast("long").alias("n"), "v", "w"), "graphs0")
    member = scratch.save(nodes.select("group", "node_id", F.col("node_id").alias("graph")), "member0")
    good = positive(links, filters).groupBy("group", "a", "b").agg(F.count("*").alias("k"), F.sum("m").alias("m"), F.sum("r").alias("r"))
    between = scratch.save(good, "between0")
    for k in rounds():
        side = lambda s: graphs.select("group", F.col("graph").alias(s), (F.col("v") / F.col("n")).alias(f"v_{s}"), (F.col("w") / F.col("n")).alias(f"w_{s}"))
        met = between.join(side("a"), ["group", "a"]).join(side("b"), ["group", "b"])
        value = F.col("m") / F.col("k") + F.least("v_a", "v_b")
        cost = F.col("r") / F.col("k") + (F.col("w_a") + F.col("w_b")) / 2
        passing = met.withColumn("excess", value - F.lit(filters.ave_node) * cost).where("excess > 0")
        best = ends(passing.select("group", "a", "b", "excess")).groupBy("group", "node_id").agg(F.min(F.struct((-F.col("excess")).alias("x"), F.col("other").alias("to"))).alias("p"))
        picks = scratch.save(best.select("group", F.col("node_id").alias("a"), F.col("p.to").alias("b")), f"picks{k}")
        if picks.isEmpty():
            break
        moved = scratch.save(components_within(spark, picks, ["group"]).toDF("group", "graph", "into"), f"moved{k}")
        up = lambda df, c: df.join(moved.select("group", F.col("graph").alias(c), "into"), ["group", c], "left").withColumn(c, F.coalesce("into", c)).drop("into")
        graphs = scratch.save(up(graphs, "graph").groupBy("group", "graph").agg(*(F.sum(c).alias(c) for c in ("n", "v", "w"))), f"graphs{k}")
        member = scratch.save(up(member, "graph"), f"member{k}")
        lifted = up(up(between, "a"), "b").where("a <> b").select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "k", "m", "r")
        between = scratch.save(lifted.groupBy("group", "a", "b").agg(*(F.sum(c).alias(c) for c in ("k", "m", "r"))), f"between{k}")
    kept = graphs.select("group", "graph", (F.col("v") > F.lit(filters.ave_node) * F.col("w")).alias("kept"))
    return member.join(kept, ["group", "graph"]).select("group", "node_id", "graph", "kept")
