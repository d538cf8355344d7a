"""Nodes and links: pair generation, comparison, clustering, aggregation, projection.

Node table: node_id, group (pairs form within it), y, x, c, r, span, n, M, D, I, G,
dy, dx. Links: group, a, b (a < b), m_* and d_* of nine parameters M, D, C, I, G, A,
L, S, E, dist, c, m, d.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters
from gradus.functions.compare import guarded, signed_min
from gradus.operators.blobs import STRIDE
from gradus.operators.components import components_within
from gradus.plans.scratch import MOST_ROUNDS, Scratch, rounds

PARAMS = ("M", "D", "C", "I", "G", "A", "L", "S", "E")
#: Weights of the nine parameters, by name (fixed values).
WEIGHT = {"M": 10, "D": 10, "C": 20, "I": 5, "G": 20, "A": 20, "L": 2, "S": 1, "E": 1}
#: Average difference that weights of differences are relative to.
AVE_D = 20


def node_name(frame: str, blob: str) -> Column:
    """A blob's name over all frames: frame_id * 2^33 + y * 2^16 + x of its first pixel where they fit (frame ids under
    2^29, y under 2^17, x under 2^16), which rises with frame and place; else a negative hash of 63 bits (among 10^9
    such blobs 0.05 pairs are expected to share one).
    """
    f, y, x = F.col(frame), F.floor(F.col(blob) / STRIDE), F.pmod(F.col(blob), F.lit(STRIDE))
    fits = (f >= 0) & (f < 1 << 29) & (y < 1 << 17) & (x < 1 << 16)
    return F.when(fits, f * (1 << 33) + y * (1 << 16) + x).otherwise(-1 - F.shiftrightunsigned(F.xxhash64(f, blob), 1))


def nodes_from_blobs(blobs: DataFrame, ave_g: float) -> DataFrame:
    """A node a blob: centre, area as c, match against the average gradient."""
    per = lambda c: F.col(c) / F.col("area")
    return blobs.select(
        F.col("frame_id").alias("group"), node_name("frame_id", "blob_id").alias("node_id"), per("Y").alias("y"), per("X").alias("x"),
        F.col("area").cast("double").alias("c"), F.lit(1.0).alias("r"), F.sqrt(F.col("area").cast("double")).alias("span"), F.col("area").cast("double").alias("n"),
        (F.lit(1000 * ave_g) * F.col("area") - F.col("G1000")).cast("double").alias("M"), F.col("G1000").cast("double").alias("D"), F.col("I").cast("double").alias("I"), F.col("G1000").cast("double").alias("G"),
        F.col("Dy4").cast("double").alias("dy"), F.col("Dx4").cast("double").alias("dx"),
    )


def range_pairs(nodes: DataFrame, max_dist: float) -> DataFrame:
    """Pairs of a group nearer than max_dist: an equi-join on grid cells of that size (one side goes to the nine around it), then the distance."""
    at = lambda c: F.floor(F.col(c) / max_dist)
    slim = nodes.select("group", F.col("node_id"), "y", "x", at("y").alias("cy"), at("x").alias("cx"))
    around = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)))
    right = slim.withColumn("o", F.explode(around)).select("group", F.col("node_id").alias("b"), F.col("y").alias("by"), F.col("x").alias("bx"), (F.col("cy") + F.col("o.p")).alias("cy"), (F.col("cx") + F.col("o.q")).alias("cx"))
    met = slim.withColumnRenamed("node_id", "a").join(right, ["group", "cy", "cx"]).where("a < b")
    dist2 = (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")) + (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx"))
    return met.where(dist2 < max_dist * max_dist).select("group", "a", "b", F.sqrt(dist2).alias("dist"))


def _sides(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    cols = ["c", "r", "span", "n", "M", "D", "I", "G", "dy", "dx"]
    side = lambda s: nodes.select("group", F.col("node_id").alias(s), *(F.col(k).alias(f"{k}_{s}") for k in cols))
    return pairs.join(side("a"), ["group", "a"]).join(side("b"), ["group", "b"])


def value_of(m: dict[str, Column], d: dict[str, Column]) -> tuple[Column, Column]:
    """(match, difference) of a vector: weighted m / (m + |d|), and weighted |d| relative to the average times half the match."""
    vm = sum((F.lit(float(WEIGHT[k])) * m[k] / guarded(m[k] + F.abs(d[k])) for k in m), F.lit(0.0))
    vd = sum((F.lit(float(WEIGHT[k])) * F.abs(d[k]) for k in d), F.lit(0.0)) * vm / F.lit(2.0)
    return vm, vd


def compare_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with nine compared parameters; the first node's masses are scaled by rn = c_b / c_a; I and S are massless.

    A link's difference is up to 10^9 times the last digit of its angle's cosine, so that digit shows in thousandths.
    """

    @F.pandas_udf("cosine double, turn double")
    def turned(ya: pd.Series, xa: pd.Series, yb: pd.Series, xb: pd.Series) -> pd.DataFrame:
        """Cosine and wrapped difference of two vectors' angles by the C library, as in other engines; Java's last digits are others."""
        delta = [math.atan2(p, q) - math.atan2(r, s) for p, q, r, s in zip(ya, xa, yb, xb)]
        turn = [math.atan2(math.sin(t), math.cos(t)) for t in delta]
        return pd.DataFrame({"cosine": np.array([math.cos(t) for t in turn], float), "turn": np.array(turn, float)})

    both = _sides(pairs, nodes).withColumn("_turn", turned("dy_a", "dx_a", "dy_b", "dx_b"))
    rn = F.col("c_b") / F.col("c_a")
    m: dict[str, Column] = {}
    d: dict[str, Column] = {}
    for k, name, scaled in (("M", "M", True), ("D", "D", True), ("C", "c", False), ("I", "I", True), ("G", "G", True), ("L", "n", True), ("S", "span", False)):
        a = F.col(f"{name}_a") * rn if scaled else F.col(f"{name}_a")
        b = F.col(f"{name}_b")
        d[k] = a - b
        m[k] = F.lit(float(WEIGHT[k])) - F.abs(a - b) if k in ("I", "S") else signed_min(a, b)
    m["A"], d["A"] = (F.col("_turn.cosine") + 1) / 2, F.col("_turn.turn") / F.lit(math.pi)
    m["E"], d["E"] = F.lit(0.0), F.lit(0.0)
    out = both.select("group", "a", "b", "dist", F.least("c_a", "c_b").alias("c"), ((F.col("r_a") + F.col("r_b")) / 2).alias("r"), *(m[k].alias(f"m_{k}") for k in PARAMS), *(d[k].alias(f"d_{k}") for k in PARAMS))
    vm, vd = value_of({k: F.col(f"m_{k}") for k in PARAMS}, {k: F.col(f"d_{k}") for k in PARAMS})
    return out.withColumn("m", vm).withColumn("d", vd)


def compare_derivatives(links: DataFrame) -> DataFrame:
    """Signed minima and differences of the d rows of two links with a common first node."""
    a = links.select("group", "a", F.col("b").alias("p"), *(F.col(f"d_{k}").alias(f"p_{k}") for k in PARAMS))
    b = links.select("group", "a", F.col("b").alias("q"), *(F.col(f"d_{k}").alias(f"q_{k}") for k in PARAMS))
    met = a.join(b, ["group", "a"]).where("p < q")
    return met.select("group", "a", "p", "q", *(signed_min(f"p_{k}", f"q_{k}").alias(f"m_{k}") for k in PARAMS), *((F.col(f"p_{k}") - F.col(f"q_{k}")).alias(f"d_{k}") for k in PARAMS))


def ends(links: DataFrame) -> DataFrame:
    """Each link once for each of its nodes (node_id, other)."""
    both = F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("other")))
    return links.withColumn("_e", F.explode(both)).select("_e.*", *[c for c in links.columns])


def rim_sums(links: DataFrame) -> DataFrame:
    """Of every node: links, c-weighted mean match, sum of positive matches, and of differences where the match isn't positive."""
    pos = F.when(F.col("m") > 0, F.col("m")).otherwise(0.0)
    neg = F.when((F.col("m") <= 0) & (F.col("d") > 0), F.col("d")).otherwise(0.0)
    return ends(links).groupBy("group", "node_id").agg(F.count("*").alias("n_links"), (F.sum(F.col("m") * F.col("c")) / F.sum("c")).alias("rim_m"), F.sum("c").alias("rim_c"), F.sum(pos).alias("M"), F.sum(neg).alias("D"))


def match_decay(links: DataFrame) -> DataFrame:
    """Minus the mean slope of m / c over distance, along a group's links by distance."""
    w = Window.partitionBy("group").orderBy("dist", "a", "b")
    v = F.col("m") / F.col("c")
    slope = (v - F.lag(v).over(w)) / guarded(F.col("dist") - F.lag("dist").over(w))
    return links.withColumn("s", slope).groupBy("group").agg((-F.avg("s")).alias("decay"))


def progressive_gate(value: Column, weights: list[float]) -> Column:
    """Number of gates a value passes: it must exceed the running product of the weights."""
    out, cost, open_ = F.lit(0), 1.0, F.lit(True)
    for w in weights:
        cost *= w
        open_ = open_ & (value > cost)
        out = out + open_.cast("int")
    return out


def exemplars(nodes: DataFrame, links: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Strongest nodes of each group, suppressing what they link to: accepted while rim match * c exceeds ave * (r + rank + overlap).

    Walks a group in one task, strongest first (ties by id), and stops at the first
    failure; a group without gain keeps its first node.
    """
    near = ends(links).groupBy("group", "node_id").agg(F.collect_set("other").alias("near"), F.max_by("m", "m").alias("top"))
    strong = nodes.select("group", "node_id", "c", "r").join(rim_sums(links), ["group", "node_id"]).join(near, ["group", "node_id"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rim_m", "node_id"], ascending=[False, True])
        blocked: set = set()
        kept = []
        for rank, row in enumerate(pdf.itertuples(), 1):
            held = row.node_id in blocked
            overlap = 1.0 if held else 0.0
            if row.rim_m * row.c > filters.ave_node * (row.r + rank + overlap):
                kept.append((row.group, row.node_id, rank, held))
                blocked |= set(row.near)
            else:
                break
        if not kept and len(pdf):
            first = pdf.iloc[0]
            kept.append((int(first.group), int(first.node_id), 1, False))
        return pd.DataFrame(kept, columns=["group", "node_id", "rank", "inhibited"])

    return strong.groupBy("group").applyInPandas(one, "group long, node_id long, rank long, inhibited boolean")


def connectivity_clusters(spark: SparkSession, nodes: DataFrame, links: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Components over links whose two rims' positive match passes; then members whose match inside is under the mean * density fall out.

    One pass each (components first, density on the finished component), so the
    result doesn't depend on the order of visits. Every node is in one cluster at most.
    """
    rims = rim_sums(links).select("node_id", F.col("M").alias("rM"))
    side = lambda s: rims.select(F.col("node_id").alias(s), F.col("rM").alias(f"rM_{s}"))
    good = links.join(side("a"), "a").join(side("b"), "b").where((F.col("rM_a") + F.col("rM_b") > filters.ave_node * (F.col("r") + 1)) & (F.col("m") > 0))
    found = components_within(spark, good, ["group"]).select("node", "component").toDF("node_id", "root")
    inner = ends(good.select("group", "a", "b", "m")).groupBy("node_id").agg(F.sum("m").alias("inner_m"))
    sized = found.join(inner, "node_id").withColumn("size", F.count("*").over(Window.partitionBy("root"))).withColumn("mean_m", F.avg("inner_m").over(Window.partitionBy("root")))
    dense = (F.sqrt(F.col("size").cast("double")) <= 3) | (F.col("inner_m") / F.sqrt(F.col("size").cast("double")) > filters.ave_node * F.col("mean_m") / F.col("size"))
    return nodes.select("group", "node_id").join(sized.where(dense), "node_id").select("group", "node_id", "root", "inner_m")


def aggregate_nodes(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Sum of c, c-weighted means of everything else, centre, box and the c-weighted mean distance to the centre (span)."""
    own = nodes.join(membership.select("node_id", "root"), "node_id")
    mean = lambda k: (F.sum(F.col(k) * F.col("c")) / F.sum("c")).alias(k)
    sums = own.groupBy("group", "root").agg(
        F.count("*").alias("n_members"), F.sum("c").alias("C"), *(mean(k) for k in ("r", "M", "D", "I", "G", "dy", "dx")), (F.sum(F.col("y") * F.col("c")) / F.sum("c")).alias("cy"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("cx"),
        F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("yn"), F.max("x").alias("xn"), F.max("span").alias("own_span"),
    )
    away = own.join(sums.select("group", "root", "cy", "cx"), ["group", "root"]).groupBy("group", "root").agg((F.sum(F.hypot(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")) * F.col("c")) / F.sum("c")).alias("span"))
    out = sums.join(away, ["group", "root"])
    return out.withColumn("span", F.when(F.col("n_members") == 1, F.col("own_span")).otherwise(F.col("span"))).drop("own_span")


def as_nodes(aggregates: DataFrame) -> DataFrame:
    """Clusters as the next level's nodes."""
    return aggregates.select("group", F.col("root").alias("node_id"), F.col("cy").alias("y"), F.col("cx").alias("x"), F.col("C").alias("c"), "r", "span", F.col("n_members").cast("double").alias("n"), "M", "D", "I", "G", "dy", "dx")


def weighted_sums(links: DataFrame, by: str = "group") -> DataFrame:
    """c-weighted mean of the nine matches and differences, and its value."""
    mean = lambda k: (F.sum(F.col(k) * F.col("c")) / F.sum("c")).alias(k)
    out = links.groupBy(by).agg(F.sum("c").alias("c"), *(mean(f"{p}_{k}") for p in "md" for k in PARAMS))
    vm, vd = value_of({k: F.col(f"m_{k}") for k in PARAMS}, {k: F.col(f"d_{k}") for k in PARAMS})
    return out.withColumn("m", vm).withColumn("d", vd)


def merge_matches(spark: SparkSession, nodes: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Nodes joined where a link's match passes ``least``, as (node_id, root); the merge of a range comparison."""
    return components_within(spark, links.where(F.col("m") > least), ["group"]).select("node", "component").toDF("node_id", "root")


def prediction_error(links: DataFrame) -> DataFrame:
    """Relative difference of each link's match from what its two nodes' other links lead to expect."""
    rims = rim_sums(links).select("node_id", "n_links", (F.col("rim_m") * F.col("rim_c")).alias("s"), "rim_c")
    side = lambda t: rims.select(F.col("node_id").alias(t), F.col("s").alias(f"s_{t}"), F.col("rim_c").alias(f"c_{t}"))
    met = links.join(side("a"), "a").join(side("b"), "b")
    rest_c = F.col("c_a") + F.col("c_b") - 2 * F.col("c")
    expected = F.when(rest_c > 1e-9, (F.col("s_a") + F.col("s_b") - 2 * F.col("m") * F.col("c")) / rest_c).otherwise(F.col("m"))
    return met.select("group", "a", "b", "m", expected.alias("expected"), (F.abs(F.col("m") - expected) / guarded(F.abs(expected))).alias("error"))


def feature_weights(links: DataFrame, last: int = MOST_ROUNDS) -> DataFrame:
    """Weights of each link's nine matches and nine differences: inverse deviation from their weighted mean, mean 1, iterated until the link's own weights have settled.

    A link settles when its weights change by under 1e-6 in all, or are (to three digits) those of an earlier round: most come round every second one.
    A few never do either; ``settled`` is false for those, and their weights are those of round ``last``.
    """

    @F.pandas_udf("weights array<double>, settled boolean")
    def fit(*cols: pd.Series) -> pd.DataFrame:
        v = np.abs(np.stack([c.to_numpy(float) for c in cols], 1)).reshape(-1, 2, 9)
        total = v.sum(1, keepdims=True)
        total[total == 0] = 1e-7
        w, settled = np.ones_like(v), np.zeros(len(v), bool)
        seen: list[set[bytes]] = [set() for _ in v]
        for _ in range(last):
            share = v / total * w
            mean = share.mean(2, keepdims=True)
            mean[mean == 0] = 1e-7
            safe = np.where(share == 0, 1e-7, share)
            inverse = np.minimum(share / mean, mean / safe)
            new = inverse / np.maximum(inverse.mean(2, keepdims=True), 1e-7)
            settled |= np.abs(new - w).sum((1, 2)) < 1e-6
            for at in np.flatnonzero(~settled):
                state = np.round(w[at], 3).tobytes()
                settled[at] = state in seen[at]
                seen[at].add(state)
            if settled.all():
                break
            w = np.where(settled[:, None, None], w, new)
        return pd.DataFrame({"weights": list(w.reshape(-1, 18)), "settled": settled})

    return links.select("group", "a", "b", fit(*(F.col(f"{p}_{k}") for p in "md" for k in PARAMS)).alias("f")).select("group", "a", "b", "f.*")


#: What a centroid averages over its members.
FEATURES = ["c", "r", "span", "n", "M", "D", "I", "G", "dy", "dx", "y", "x"]
CHANGE = 0.05


def _means(weighed: DataFrame) -> DataFrame:
    """(group, centroid, …) means of the members' features by their weight w."""
    return weighed.groupBy("group", "centroid").agg(*((F.sum(F.col(f) * F.col("w")) / F.sum("w")).alias(f) for f in FEATURES))


def _against_centroids(pairs: DataFrame, means: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group, centroid, node_id, m, d, c, r) of pairs (group, centroid, node_id); c and r are the node's."""
    named = means.select("group", F.col("centroid").alias("node_id"), *FEATURES)
    found = _compare_tables(pairs.select("group", F.col("centroid").alias("a"), F.col("node_id").alias("b")), named, nodes)
    found = found.select("group", F.col("a").alias("centroid"), F.col("b").alias("node_id"), "m", "d")
    return found.join(nodes.select("group", "node_id", "c", "r"), ["group", "node_id"])


def _signature(members: DataFrame) -> DataFrame:
    """(group, signature): which members a group's centroids have."""
    name = F.xxhash64("centroid", "node_id").cast("decimal(38,0)")
    return members.groupBy("group").agg(F.concat_ws(":", F.count("*"), F.sum(name)).alias("signature"))


def _judged(now: DataFrame, before: DataFrame | None, seen: DataFrame | None, change: float) -> DataFrame:
    """(group, signature, settled): whether a group's matches and differences changed by at most that part, or its memberships are those of an earlier round."""
    sizes = now.select("group", "centroid", "node_id", F.abs("m").alias("m"), F.abs("d").alias("d"))
    if before is None:
        moved = sizes.groupBy("group").agg((F.sum("m") + F.sum("d")).alias("moved"), (F.sum("m") + F.sum("d")).alias("total"))
    else:
        old = before.select("group", "centroid", "node_id", F.col("m").alias("old_m"), F.col("d").alias("old_d"))
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        both = now.select("group", "centroid", "node_id", "m", "d").join(old, ["group", "centroid", "node_id"], "full")
        step = F.abs(zero(F.col("m")) - zero(F.col("old_m"))) + F.abs(zero(F.col("d")) - zero(F.col("old_d")))
        moved = both.groupBy("group").agg(F.sum(step).alias("moved"), F.sum(F.abs(zero(F.col("m"))) + F.abs(zero(F.col("d")))).alias("total"))
    out = moved.join(_signature(now), "group", "left")
    if seen is not None:
        out = out.join(seen.select("group", "signature", F.lit(True).alias("again")).distinct(), ["group", "signature"], "left")
        known = F.coalesce("again", F.lit(False))
    else:
        known = F.lit(False)
    gone = F.col("signature").isNull()
    return out.select("group", "signature", (gone | known | (F.col("moved") <= F.lit(change) * F.col("total"))).alias("settled"))


def centroids(spark: SparkSession, nodes: DataFrame, seeds: DataFrame, links: DataFrame, filters: Filters = DEFAULT, change: float = CHANGE, last: int | None = None) -> DataFrame:
    """Overlapping centroid clusters (group, centroid, node_id, m, d, round, stable): each seed gathers its linked nodes, becomes their mean and looks again.

    In a round every open centroid is compared with its members and with the nodes linked to them; those with m > ave_node * r are its members now.
    A centroid whose members' mean m (by c) doesn't exceed ave_cent times their mean r is given up. One whose members' mean |d| is under ave_cent_d is stable:
    it is put out and leaves the later rounds. The others become the means of their members, weighted by c * m. A group ends by itself: when matches and
    differences of its open centroids changed by at most ``change`` of their sum, or their memberships are those of an earlier round (a cycle), or none is open;
    its open centroids are then put out. Groups that have ended take no part in later rounds. ``last`` ends the rounds for all groups; settled is false for those
    that hadn't ended by themselves.
    """
    scratch = Scratch(spark, "centroids")
    near = ends(links.select("group", "a", "b")).select("group", F.col("node_id").alias("member"), "other")
    near = scratch.save(near.union(nodes.select("group", "node_id", "node_id")), "near")
    current = nodes.join(seeds.select("group", "node_id"), ["group", "node_id"], "left_semi").withColumn("centroid", F.col("node_id"))
    front = current.select("group", "centroid", F.col("node_id").alias("member"))
    before = seen = None
    out = []
    for k in rounds(last=last):
        reach = front.join(near, ["group", "member"]).select("group", "centroid", F.col("other").alias("node_id")).distinct()
        compared = scratch.save(_against_centroids(reach, current, nodes), f"compared{k}").where(F.col("m") > F.lit(filters.ave_node) * F.col("r"))
        own = Window.partitionBy("group", "centroid")
        mean = lambda x: F.sum(x * F.col("c")).over(own) / F.sum("c").over(own)
        worth = mean(F.col("m")) > F.lit(filters.ave_cent) * mean(F.col("r"))
        rated = compared.withColumns({"worth": worth, "stable": mean(F.abs("d")) < filters.ave_cent_d}).where("worth").drop("worth")
        rated = scratch.save(rated, f"members{k}")
        going = rated.where("not stable")
        judged = scratch.save(_judged(going, before, seen, change), f"groups{k}")
        ended = going.join(judged.where("settled").select("group"), "group", "left_semi")
        left = judged.where("not settled")
        cut = [(going.join(left.select("group"), "group", "left_semi"), False)] if k == last else []
        out += [x.select("group", "centroid", "node_id", "m", "d", F.lit(k).alias("round"), "stable", F.lit(by_itself).alias("settled")) for x, by_itself in [(rated.where("stable"), True), (ended, True), *cut]]
        if cut or left.isEmpty():
            return reduce(DataFrame.unionByName, out)
        before = going.join(left.select("group"), "group", "left_semi")
        seen = left.select("group", "signature") if seen is None else seen.unionByName(left.select("group", "signature"))
        weighed = before.select("group", "centroid", "node_id", F.col("m").alias("match")).join(nodes, ["group", "node_id"]).withColumn("w", F.col("c") * F.col("match"))
        current = scratch.save(_means(weighed), f"means{k}")
        front = before.select("group", "centroid", F.col("node_id").alias("member"))


def _compare_tables(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """compare_nodes() of pairs whose first node is in another table."""
    shared = left.select("group", (-F.col("node_id") - 1).alias("node_id"), *[c for c in left.columns if c not in ("group", "node_id")])
    cols = [c for c in shared.columns if c in right.columns]
    nodes = shared.select(*cols).unionByName(right.select(*cols))
    named = pairs.select("group", (-F.col("a") - 1).alias("a"), "b").withColumn("dist", F.lit(0.0))
    return compare_nodes(named, nodes).withColumn("a", -F.col("a") - 1)


def fuzzy_centroids(spark: SparkSession, nodes: DataFrame, members: DataFrame, links: DataFrame, filters: Filters = DEFAULT, change: float = CHANGE, last: int | None = None) -> DataFrame:
    """Mean shift of overlapping centroids (group, centroid, node_id, m, share, dist, round): members, as of centroids(), are shared out, and centroids merged and pruned.

    In a round every centroid is the mean of its members, weighted by c * m * share, share being a membership's part of its node's positive m. It is compared
    with its members and the nodes linked to them; m > 0 makes a member. A centroid is pruned unless its members' mean m (by c) exceeds ave_node times
    their mean r plus its overlap, the mean number of centroids that match a member better. Two centroids of a group with a common member
    are merged, into the lesser name, if their own comparison passes ave_cent (all such pairs at once); that starts the group's test anew. A group
    ends when nothing was merged and m changed by at most ``change`` of its sum, or its memberships are those of an earlier round, or no centroid is left. Then members with
    m * c > ave_node * r stay, with their distance from the centroid. ``last`` ends the rounds for all groups; settled is false for those that hadn't ended by themselves.

    Nodes meet only centroids that reach them over members and links, not all of their group's.
    """
    scratch = Scratch(spark, "fuzzy")
    near = ends(links.select("group", "a", "b")).select("group", F.col("node_id").alias("member"), "other")
    near = scratch.save(near.union(nodes.select("group", "node_id", "node_id")), "near")
    now = members.select("group", "centroid", "node_id", "m").where("m > 0")
    before = seen = None
    out = []
    for k in rounds(last=last):
        of_node = Window.partitionBy("group", "node_id")
        shared = now.select("group", "centroid", "node_id", (F.col("m") * F.col("m") / F.sum("m").over(of_node)).alias("shared"))
        weighed = shared.join(nodes, ["group", "node_id"]).withColumn("w", F.col("c") * F.col("shared"))
        means = scratch.save(_means(weighed), f"means{k}")
        reach = now.select("group", "centroid", F.col("node_id").alias("member")).join(near, ["group", "member"]).select("group", "centroid", F.col("other").alias("node_id")).distinct()
        met = scratch.save(_against_centroids(reach, means, nodes), f"compared{k}").where("m > 0").withColumn("better", F.rank().over(of_node.orderBy(F.desc("m"))) - 1)
        own = Window.partitionBy("group", "centroid")
        mean = lambda x: F.sum(x * F.col("c")).over(own) / F.sum("c").over(own)
        good = mean(F.col("m")) > F.lit(filters.ave_node) * (mean(F.col("r")) + F.avg("better").over(own))
        kept = scratch.save(met.withColumn("good", good).where("good").drop("good", "better"), f"kept{k}")
        held = kept.select("group", "centroid", "node_id")
        common = held.join(held.withColumnRenamed("centroid", "other"), ["group", "node_id"]).where("centroid < other").select("group", "centroid", "other").distinct()
        pairs = _against_centroids(common.withColumnRenamed("other", "node_id"), means, means.withColumnRenamed("centroid", "node_id"))
        alike = pairs.where(F.col("m") > F.lit(filters.ave_cent) * F.col("r"))
        merged = components_within(spark, alike, ["group"], "centroid", "node_id").toDF("group", "centroid", "into")
        merged = scratch.save(merged.where("centroid <> into"), f"merged{k}")
        named = kept.join(merged, ["group", "centroid"], "left").withColumn("centroid", F.coalesce("into", "centroid")).drop("into")
        one = named.groupBy("group", "centroid", "node_id").agg(F.max("m").alias("m"), F.first("c").alias("c"), F.first("r").alias("r"))
        now = scratch.save(one.withColumn("d", F.lit(0.0)), f"members{k}")
        judged = _judged(now, before, seen, change).join(merged.select("group", F.lit(True).alias("joined")).distinct(), "group", "left")
        judged = scratch.save(judged.select("group", "signature", (F.col("settled") & F.col("joined").isNull()).alias("settled")), f"groups{k}")
        ended = now.join(judged.where(F.col("settled") | F.lit(k == last)).select("group", "settled"), "group")
        place = means.select("group", "centroid", F.col("y").alias("cy"), F.col("x").alias("cx"))
        final = ended.withColumn("share", F.col("m") / F.sum("m").over(of_node)).where(F.col("m") * F.col("c") > F.lit(filters.ave_node) * F.col("r"))
        final = final.join(place, ["group", "centroid"]).join(nodes.select("group", "node_id", "y", "x"), ["group", "node_id"])
        out.append(final.select("group", "centroid", "node_id", "m", "share", F.hypot(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")).alias("dist"), F.lit(k).alias("round"), "settled"))
        left = judged.where("not settled")
        if k == last or left.isEmpty():
            return reduce(DataFrame.unionByName, out)
        before = now = now.join(left.select("group"), "group", "left_semi")
        seen = left.select("group", "signature") if seen is None else seen.unionByName(left.select("group", "signature"))


def distance_bands(links: DataFrame, max_dist: float) -> DataFrame:
    """Links by multiples of a distance: number, mean match."""
    return links.groupBy("group", F.floor(F.col("dist") / max_dist).cast("long").alias("band")).agg(F.count("*").alias("n"), F.avg("m").alias("m"))


def distance_gaps(links: DataFrame, gap: float) -> DataFrame:
    """Segments of a group's links in order of distance, cut where the distance jumps by over ``gap``."""
    w = Window.partitionBy("group").orderBy("dist", "a", "b")
    cut = F.coalesce(F.col("dist") - F.lag("dist").over(w) > gap, F.lit(True)).cast("long")
    return links.withColumn("_c", cut).withColumn("seg", F.sum("_c").over(w) - 1).groupBy("group", "seg").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))


def nearest_by_direction(nodes: DataFrame, links: DataFrame, sectors: int = 8) -> DataFrame:
    """Each node's nearest link in each of ``sectors`` directions.

    Many links lie on a sector's border (diagonals), so the last digit of an angle decides: it is the C library's, as in other engines, not Java's.
    """

    @F.pandas_udf("double")
    def atan2(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(list(map(math.atan2, y, x)), dtype=float)

    place = lambda s: nodes.select(F.col("node_id").alias(s), F.col("y").alias(f"y_{s}"), F.col("x").alias(f"x_{s}"))
    met = ends(links.select("group", "a", "b", "dist")).select("group", "node_id", "other", "dist").join(place("node_id"), "node_id").join(place("other"), "other")
    angle = atan2(F.col("y_other") - F.col("y_node_id"), F.col("x_other") - F.col("x_node_id"))
    sector = F.pmod(F.floor(angle / (2 * math.pi / sectors)), F.lit(sectors)).cast("int")
    rank = F.row_number().over(Window.partitionBy("group", "node_id", "sector").orderBy("dist", "other"))
    return met.withColumn("sector", sector).withColumn("_r", rank).where("_r = 1").select("group", "node_id", "sector", "other", "dist")


def local_maxima(nodes: DataFrame, links: DataFrame, value: str = "M") -> DataFrame:
    """Nodes whose value no linked node exceeds, with how many nodes they are linked to."""
    v = lambda s: nodes.select(F.col("node_id").alias(s), F.col(value).alias(f"v_{s}"))
    met = ends(links.select("group", "a", "b")).select("group", "node_id", "other").join(v("node_id"), "node_id").join(v("other"), "other")
    return met.groupBy("group", "node_id").agg(F.max("v_other").alias("most"), F.first("v_node_id").alias("own"), F.count("*").alias("n")).where("own >= most").select("group", "node_id", "n")


def cosine_to_mean(nodes: DataFrame) -> DataFrame:
    """(cos + 1) / 2 of each node's parameters to its group's mean."""
    names = ["M", "D", "I", "G"]
    w = Window.partitionBy("group")
    named = nodes.withColumns({f"c_{k}": F.avg(k).over(w) for k in names})
    dot = sum((F.col(k) * F.col(f"c_{k}") for k in names), F.lit(0.0))
    norm = lambda p: F.sqrt(sum((F.col(p + k) * F.col(p + k) for k in names), F.lit(0.0)))
    return named.select("group", "node_id", ((dot / guarded(norm("") * norm("c_")) + 1) / 2).alias("cos"))


def project_node(nodes: DataFrame, links: DataFrame, dist: float, angle: tuple[float, float], decay: float) -> DataFrame:
    """What a node's links promise at a distance and direction: m times decay, d times decay and the cosine to the link's direction."""
    place = lambda s: nodes.select(F.col("node_id").alias(s), F.col("y").alias(f"y_{s}"), F.col("x").alias(f"x_{s}"), F.col("span").alias(f"s_{s}"))
    met = ends(links.select("group", "a", "b", "m", "d", "c")).select("group", "node_id", "other", "m", "d", "c").join(place("node_id"), "node_id").join(place("other"), "other")
    dy, dx = F.col("y_other") - F.col("y_node_id"), F.col("x_other") - F.col("x_node_id")
    cos = (dy * angle[0] + dx * angle[1]) / guarded(F.hypot(dy, dx) * math.hypot(*angle))
    fall = F.pow(F.lit(decay), F.lit(dist) / F.greatest(F.col("s_node_id"), F.lit(1.0)))
    return met.groupBy("group", "node_id").agg((F.sum(F.col("m") * fall * F.col("c")) / F.sum("c")).alias("m"), (F.sum(F.col("d") * fall * cos * F.col("c")) / F.sum("c")).alias("d"))


def focus_map(values: DataFrame, decay: float, reach: int) -> DataFrame:
    """Value a tile (group, ty, tx, v) gives to the rings around it, falling with distance, summed over tiles."""
    offsets = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(decay ** max(abs(y), abs(x))).alias("k")) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1) if y or x))
    sent = values.withColumn("o", F.explode(offsets)).select("group", (F.col("ty") + F.col("o.y")).alias("ty"), (F.col("tx") + F.col("o.x")).alias("tx"), (F.col("v") * F.col("o.k")).alias("v"))
    return sent.groupBy("group", "ty", "tx").agg(F.sum("v").alias("focus"))


def expand_frame(spark: SparkSession, values: DataFrame, start: tuple[int, int], ave: float, decay: float = 0.5) -> DataFrame:
    """Tiles reached from the start over four neighbours whose focus exceeds ave, with the round they were reached in."""
    scratch = Scratch(spark, "frame")
    focus = scratch.save(focus_map(values, decay, 1).where(F.col("focus") > ave), "focus")
    got = values.select("group").distinct().select("group", F.lit(start[0]).alias("ty"), F.lit(start[1]).alias("tx"), F.lit(0).alias("round"))
    four = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((-1, 0), (0, 1), (1, 0), (0, -1))))
    for k in rounds():
        edge = got.where(F.col("round") == k - 1).withColumn("o", F.explode(four)).select("group", (F.col("ty") + F.col("o.y")).alias("ty"), (F.col("tx") + F.col("o.x")).alias("tx")).distinct()
        new = edge.join(focus, ["group", "ty", "tx"], "left_semi").join(got, ["group", "ty", "tx"], "left_anti").withColumn("round", F.lit(k))
        new = scratch.save(new, f"round{k}")
        if new.isEmpty():
            break
        got = got.union(new)
    return got


def next_filters(metrics: DataFrame, filters: Filters) -> Filters:
    """Thresholds after a run: the average match of what was compared, if it drifted by over a half."""
    row = metrics.agg(F.sum(F.col("gain") * F.col("calls")).alias("g"), F.sum("calls").alias("n")).first()
    if not row["n"]:
        return filters
    from dataclasses import replace

    ave = row["g"] / row["n"]
    return replace(filters, ave_node=ave) if abs(ave - filters.ave_node) > filters.ave_node / 2 else filters


def operator_metrics(links: DataFrame, gate: float) -> DataFrame:
    """Calls, gain of what passed and value lost at the gate, by group."""
    return links.groupBy("group").agg(F.count("*").alias("calls"), F.sum(F.when(F.col("m") > gate, F.col("m")).otherwise(0.0)).alias("gain"), F.sum(F.when(F.col("m") <= gate, F.col("m")).otherwise(0.0)).alias("lost"))


def drift_segments(levels: DataFrame, ave: float) -> DataFrame:
    """Levels of a group (level, c, v) cut where |v - previous v| exceeds ave * c: number, first level, sums."""
    w = Window.partitionBy("group").orderBy("level")
    cut = F.coalesce(F.abs(F.col("v") - F.lag("v").over(w)) > F.col("c") * ave, F.lit(True)).cast("long")
    return levels.withColumn("_c", cut).withColumn("seg", F.sum("_c").over(w) - 1).groupBy("group", "seg").agg(F.min("level").alias("first"), F.count("*").alias("n"), F.sum("v").alias("v"))


def node_levels(spark: SparkSession, nodes: DataFrame, filters: Filters = DEFAULT, levels: int | None = None) -> DataFrame:
    """Compare, cluster, aggregate, repeat: membership of every level (level, group, node_id, root). Stops when a level has no cluster (or at ``levels``)."""
    scratch, out = Scratch(spark, "levels"), None
    for k in rounds(last=levels):
        links = scratch.save(compare_nodes(range_pairs(nodes, filters.max_dist * k), nodes), f"links{k}")
        members = scratch.save(connectivity_clusters(spark, nodes, links, filters).withColumn("level", F.lit(k)), f"members{k}")
        out = members if out is None else out.unionByName(members)
        if members.isEmpty():
            break
        nodes = scratch.save(as_nodes(aggregate_nodes(nodes, members)), f"nodes{k}")
    return out
