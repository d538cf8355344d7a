"""Edges cut into slices across the gradient, their links and clusters of links.

An edge is a negative blob of high gradient. Slices of stronger maxima go before
weaker ones (ties by position), so an edge lies in one task, which works on arrays of many edges;
all steps after it are joins and grouped sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters
from gradus.functions.compare import signed_min, wrapped
from gradus.operators.blobs import STRIDE
from gradus.operators.components import components_within
from gradus.operators.stencil import PIXEL

EDGE = ["frame_id", "blob_id"]


def _dealt(side: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, never broadcast: these tables grow with the pixels, and written ones are many times their file's size in the driver."""
    return side.hint("merge")


def edge_pixels(labelled: DataFrame, blobs: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Pixels of the negative blobs with G > ave_G * area."""
    edges = blobs.where(~F.col("s") & (F.col("G1000") > 1000 * filters.ave_G * F.col("area"))).select(*EDGE)
    return labelled.join(_dealt(edges), EDGE, "left_semi").select(*PIXEL, "blob_id", "i", "dy4", "dx4", "g")


def edge_maxima(pixels: DataFrame) -> DataFrame:
    """Pixels of an edge that no pixel one rounded step along or against the gradient exceeds; whole numbers decide (dy4² + dx4²)."""
    square = F.col("dy4") * F.col("dy4") + F.col("dx4") * F.col("dx4")
    step = lambda c: F.bround(F.col(c) / F.greatest(F.sqrt(square.cast("double")), F.lit(1e-7))).cast("int")
    named = pixels.select(*PIXEL, "blob_id", "dy4", "dx4", square.alias("q"), step("dy4").alias("sy"), step("dx4").alias("sx"))
    sides = F.array(F.lit(-1), F.lit(1))
    asked = named.withColumn("side", F.explode(sides)).select(*PIXEL, "blob_id", "q", (F.col("y") + F.col("side") * F.col("sy")).alias("ny"), (F.col("x") + F.col("side") * F.col("sx")).alias("nx"))
    other = named.select("frame_id", "blob_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("q").alias("nq"))
    beaten = asked.join(_dealt(other), ["frame_id", "blob_id", "ny", "nx"]).where("q < nq").select(*PIXEL).distinct()
    return named.join(_dealt(beaten), PIXEL, "left_anti").select(*PIXEL, "blob_id", "dy4", "dx4")


def interpolate(points: DataFrame, pixels: DataFrame, value: str = "i") -> DataFrame:
    """Bilinear value at (py, px) over the existing corners of the same edge; points without any corner are left out."""
    spread = lambda c: F.when(F.floor(c) == F.col(c), F.array(F.floor(c))).otherwise(F.array(F.floor(c), F.floor(c) + 1))
    corner = points.withColumn("y", F.explode(spread("py"))).withColumn("x", F.explode(spread("px")))
    k = (F.lit(1.0) - F.abs(F.col("y") - F.col("py"))) * (F.lit(1.0) - F.abs(F.col("x") - F.col("px")))
    met = corner.withColumn("k", k).join(_dealt(pixels.select(*PIXEL, "blob_id", F.col(value).alias("v"))), [*PIXEL, "blob_id"])
    return met.groupBy(*points.columns).agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias(value))


def angle_likeness(ay, ax, by, bx):
    """(0 … 1, -0.5 … 0.5) likeness and signed difference of the angles of vectors, by arrays."""
    d = np.arctan2(ay, ax) - np.arctan2(by, bx)
    d -= 2 * np.pi * np.round(d / (2 * np.pi))
    return (np.cos(d) + 1) / 2, d / (2 * np.pi)


def crossed(p1, p2, p3, p4):
    """Whether the segments p1 p2 and p3 p4 meet (touching counts); points are (y, x), numbers or arrays."""

    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])

    return (side(p1, p2, p3) * side(p1, p2, p4) <= 0) & (side(p3, p4, p1) * side(p3, p4, p2) <= 0)


#: A step of a walk: its place, the value there, its match with and difference from the step before.
STEP = np.dtype([("walk", int), ("k", int), ("pixel", int), ("y", float), ("x", float), *((c, float) for c in ("I", "G", "Dy", "Dx", "M", "D"))])


class _Edge:
    """The pixels of an edge, or of several that are worked on at once, sorted by place, as arrays.

    A pixel's place is its number in its edge's box with a margin of two, so that neighbours never wrap; boxes follow
    each other, so edges never meet.
    """

    def __init__(self, pdf: pd.DataFrame, filters: Filters):
        self.f = filters
        y, x = pdf.y.to_numpy(np.int64), pdf.x.to_numpy(np.int64)
        edge = pdf.groupby(EDGE).ngroup().to_numpy()
        by_edge = pd.DataFrame({"y": y, "x": x}).groupby(edge).agg(["min", "max"]).to_numpy()
        self.y0, self.x0 = by_edge[:, 0] - 2, by_edge[:, 2] - 2
        self.y_most, self.wide = by_edge[:, 1] + 2, by_edge[:, 3] + 3 - self.x0
        area = (self.y_most - self.y0 + 1) * self.wide
        self.base = np.cumsum(area) - area
        place = self.base[edge] + (y - self.y0[edge]) * self.wide[edge] + x - self.x0[edge]
        order = np.argsort(place)
        self.place, self.y, self.x, self.edge = place[order], y[order], x[order], edge[order]
        self.number = None
        if area.sum() <= 16 * len(place):  # a table of all places, else they are looked up among the pixels'
            self.number = np.full(area.sum(), -1)
            self.number[self.place] = np.arange(len(place))
        self.values = np.stack([pdf.i, pdf.g, pdf.dy4 / 4, pdf.dx4 / 4], 1).astype(float)[order]
        self.axis = self.values[:, 2:] / np.maximum(self.values[:, 1:2], 1e-7)

    def at(self, y: np.ndarray, x: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Numbers of the pixels of the edges at whole places, -1 outside them."""
        y, x = y.astype(np.int64) - self.y0[edge], x.astype(np.int64) - self.x0[edge]
        wide = self.wide[edge]
        inside = (y >= 0) & (y <= (self.y_most - self.y0)[edge]) & (x >= 0) & (x < wide)
        key = np.where(inside, self.base[edge] + y * wide + x, 0)  # a box begins with its margin, which has no pixel
        if self.number is not None:
            return self.number[key]
        n = np.minimum(np.searchsorted(self.place, key), len(self.place) - 1)
        return np.where(self.place[n] == key, n, -1)

    def interpolated(self, y: np.ndarray, x: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Values between the existing ones of four corners; not a number where there is none."""
        total, out = np.zeros(len(y)), np.zeros((len(y), 4))
        fy, fx = np.floor(y), np.floor(x)
        for cy, ky in ((fy, 1 - y + fy), (fy + 1, y - fy)):
            for cx, kx in ((fx, 1 - x + fx), (fx + 1, x - fx)):
                n = self.at(cy, cx, edge)
                k = np.where(n >= 0, ky * kx, 0.0)
                total += k
                out += k[:, None] * self.values[n]
        return np.where(total[:, None] > 0, out / np.where(total > 0, total, 1.0)[:, None], np.nan)

    def maxima(self) -> np.ndarray:
        """Pixels that neither neighbour along the axis exceeds, the strongest first, ties by place."""
        g, top = self.values[:, 1], np.ones(len(self.place), bool)
        for sign in (-1, 1):
            n = self.at(np.rint(self.y + sign * self.axis[:, 0]), np.rint(self.x + sign * self.axis[:, 1]), self.edge)
            top &= (n < 0) | (g[n] <= g)
        found = np.flatnonzero(top)
        return found[np.argsort(-g[found], kind="stable")]

    def walks(self, seeds: np.ndarray) -> np.ndarray:
        """Steps of where each seed's slice could reach if it were alone, all seeds a step a round.

        Walk 2k goes against the axis of seed k, walk 2k + 1 along it; step 0 is the seed itself (walk 2k has it).
        A walk ends where the rounded place is outside the edge or was on the walk before, or where a value doesn't
        match the one before it.
        """
        f, need = self.f, self.f.ave_I + self.f.ave_G + self.f.ave_dangle
        walk = np.arange(2 * len(seeds))
        seed = np.repeat(seeds, 2)
        step = np.where(walk % 2, 1, -1)[:, None] * self.axis[seed]
        y, x, prior, pixel, edge = self.y[seed].astype(float), self.x[seed].astype(float), self.values[seed], seed, self.edge[seed]
        zero = np.zeros(len(seeds))
        rows = [(walk[::2], zero.astype(int), seeds, y[::2], x[::2], *prior[::2].T, zero, zero)]
        live, k = np.abs(step).max(1, initial=0) > 0, 0
        while live.any():
            walk, step, prior, pixel, edge, k = walk[live], step[live], prior[live], pixel[live], edge[live], k + 1
            y, x = y[live] + step[:, 0], x[live] + step[:, 1]
            # unit steps along a line come back to a rounded place only in the very next step
            next_ = self.at(np.rint(y), np.rint(x), edge)
            now = self.interpolated(y, x, edge)
            like, turn = angle_likeness(prior[:, 2], prior[:, 3], now[:, 2], now[:, 3])
            m = np.minimum(prior[:, :2], now[:, :2]).sum(1) + like
            d = np.abs(prior[:, :2] - now[:, :2]).sum(1) + turn
            live = (next_ >= 0) & (next_ != pixel) & (like >= f.ave_dangle) & (m >= need)
            rows.append(tuple(c[live] for c in (walk, np.full(len(walk), k), next_, y, x, *now.T, m, d)))
            prior, pixel = now, next_
        columns = [np.concatenate(c) for c in zip(*rows)]
        order = np.lexsort((columns[1], columns[0]))
        out = np.empty(len(order), STEP)
        for name, c in zip(STEP.names, columns):
            out[name] = c[order]
        return out

    def grown(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The walks' steps that remain when stronger seeds go first, and each pixel's seed (-1: none).

        A pixel goes to the first walk that still reaches it; a walk ends before a pixel of an earlier one, and a seed
        on an earlier walk is dropped with both its walks. Cuts depend only on earlier walks, so the first k walks are
        right after k rounds at most: repeating until nothing changes ends at the one solution.
        """
        steps = self.walks(seeds)
        walk, pixel = steps["walk"], steps["pixel"]
        begin = np.flatnonzero(np.r_[True, walk[1:] != walk[:-1]])
        group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(walk)]))
        seed_at = np.searchsorted(walk, walk // 2 * 2)  # the seed's own step
        kept, none = np.ones(len(walk), bool), 2 * len(seeds)
        while True:
            owner = np.full(len(self.place), none)
            np.minimum.at(owner, pixel[kept], walk[kept])
            lost = np.cumsum(owner[pixel] < walk)
            before = np.r_[0, lost][begin]
            now = lost == before[group]
            now &= now[seed_at]
            if (now == kept).all():
                break
            kept = now
        return steps[kept], np.where(owner < none, owner // 2, -1)

    def met(self, owner: np.ndarray) -> np.ndarray:
        """Slices that touch when all grow over the edge at once, by steps to four neighbours; cells claimed in the same round go to the strongest."""
        owner, pairs = owner.copy(), []
        sides = [self.at(self.y + dy, self.x + dx, self.edge) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        front = np.flatnonzero(owner >= 0)
        free = len(self.place)
        while len(front):
            claim = np.full(len(owner), free)
            for side in sides:
                n = side[front]
                open_ = (n >= 0) & (owner[n] < 0)
                np.minimum.at(claim, n[open_], owner[front[open_]])
            front = np.flatnonzero(claim < free)
            owner[front] = claim[front]
        for side in (sides[1], sides[3]):
            a, b = owner, owner[side]
            touch = (side >= 0) & (a >= 0) & (b >= 0) & (a != b)
            pairs.append(np.sort(np.stack([a[touch], b[touch]], 1), 1))
        pairs, n = np.concatenate(pairs), len(owner)
        return np.stack(np.divmod(np.unique(pairs[:, 0] * n + pairs[:, 1]), n), 1)


def uncrossed(slices: dict[str, np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The links (a, b) that no other link's slice lies across.

    Of two links of one slice, that goes whose line between centres meets the other far slice, extended by a unit at
    both ends; if each does, the longer line goes (of equal ones, that of the weaker far slice). All are judged on the
    links as found, so the order of work doesn't matter. ``slices`` are columns over the slices: y, x and the extended
    ends ey0, ex0, ey1, ex1; ``pairs`` rows (a, b) of their numbers, a < b.
    """
    n = len(pairs)
    if n < 2:
        return pairs
    near, far, link = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]]), np.tile(np.arange(n), 2)
    order = np.lexsort((far, near))
    near, far, link = near[order], far[order], link[order]
    after = np.searchsorted(near, near, "right") - np.arange(len(near)) - 1  # later links of the same slice
    i = np.repeat(np.arange(len(near)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    at = lambda k, y="y", x="x": (slices[y][k], slices[x][k])
    over = lambda k, other: crossed(at(far[k]), at(near[k]), at(far[other], "ey0", "ex0"), at(far[other], "ey1", "ex1"))
    long_ = lambda k: np.hypot(*(p - q for p, q in zip(at(far[k]), at(near[k]))))
    first, second = over(i, j), over(j, i)
    longer = long_(i) > long_(j)
    gone = np.zeros(n, bool)
    gone[link[i[first & (~second | longer)]]] = True
    gone[link[j[second & (~first | ~longer)]]] = True
    return pairs[~gone]


SLICE = "frame_id long, blob_id long, kind string, slice_id long, other long, y double, x double, ay double, ax double, I double, G double, Dy double, Dx double, M double, D double, L double"


#: Pixels of whole edges that are worked on at once.
AT_ONCE = 1 << 16


def _sliced(pdf: pd.DataFrame, filters: Filters) -> pd.DataFrame:
    """Rows of slice_edges() of the edges whose pixels these are; edges don't touch each other's arrays' entries."""
    edge = _Edge(pdf, filters)
    seeds = edge.maxima()
    steps, owner = edge.grown(seeds)
    rank, first, group = np.unique(steps["walk"] // 2, return_index=True, return_inverse=True)
    own = seeds[rank]
    ay, ax = edge.axis[own].T
    kept = {"slice_id": edge.y[own] * STRIDE + edge.x[own], "ay": ay, "ax": ax, "L": np.bincount(group).astype(float)}
    for name in ("I", "G", "Dy", "Dx", "M", "D"):
        kept[name] = np.maximum(np.bincount(group, steps[name]), 1e-7)
    last = np.flatnonzero(np.r_[steps["walk"][1:] != steps["walk"][:-1], True])
    for c, axis in (("y", ay), ("x", ax)):
        ends = np.stack([steps[c][first]] * 2)  # a walk without steps ends at the seed
        ends[steps["walk"][last] % 2, group[last]] = steps[c][last]
        kept[c], kept[f"e{c}0"], kept[f"e{c}1"] = ends.mean(0), ends[0] - axis, ends[1] + axis
    pairs = uncrossed(kept, np.searchsorted(rank, edge.met(owner)))
    order = np.empty(len(rank), int)
    order[np.lexsort((kept["slice_id"], kept["x"], kept["y"]))] = np.arange(len(rank))
    upper, lower = (np.where((order[pairs[:, 0]] > order[pairs[:, 1]]) == up, pairs[:, 0], pairs[:, 1]) for up in (True, False))
    of = np.concatenate([edge.edge[own], edge.edge[own][upper]])
    head = {c: v[of] for c, v in pdf[EDGE].drop_duplicates().sort_values(EDGE).to_dict("series").items() for v in [v.to_numpy()]}
    columns, n = [c.split()[0] for c in SLICE.split(", ")], len(pairs)
    out = {c: np.concatenate([kept[c], np.full(n, np.nan)]) for c in columns if c in kept and c != "slice_id"}
    out["kind"] = ["slice"] * len(rank) + ["link"] * n
    out["slice_id"] = np.concatenate([kept["slice_id"], kept["slice_id"][upper]])
    out["other"] = pd.array([None] * len(rank) + kept["slice_id"][lower].tolist(), "Int64")
    return pd.DataFrame(head | out)[columns]


def slice_edges(pixels: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Slices ('slice' rows: centre, axis, sums) and their links ('link' rows: slice_id above other) of every edge.

    A slice is named by its first maximum's place, as blobs are. Edges come one after another to a task, which works on
    many small ones at once.
    """

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, due = [], AT_ONCE
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < due:
                continue
            rows = pd.concat(held, ignore_index=True)
            before = np.flatnonzero((rows[EDGE] != rows[EDGE].iloc[-1]).any(axis=1))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield _sliced(rows.iloc[:cut], filters)
            held = [rows.iloc[cut:]]
            due = max(AT_ONCE, 2 * len(held[0]))  # a large edge isn't looked at again for each batch
        if sum(map(len, held)):
            yield _sliced(pd.concat(held, ignore_index=True), filters)

    # the window brings an edge's pixels together, without another shuffle where they already are
    together = pixels.withColumn("_n", F.row_number().over(Window.partitionBy(*EDGE).orderBy("y", "x")))
    return together.mapInPandas(sliced, SLICE)


def compare_slices(found: DataFrame, filters: Filters = DEFAULT, rng: float = 1) -> DataFrame:
    """Linked slices at most 2 * rng apart (sum of coordinates): matches and differences of M, D, I, G, angle and L, their sums m and d, and c."""
    side = lambda c: found.where("kind = 'slice'").select(*EDGE, F.col("slice_id").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("y", "x", "I", "G", "Dy", "Dx", "M", "D", "L")))
    links = found.where("kind = 'link'").select(*EDGE, F.col("slice_id").alias("a"), F.col("other").alias("b"))
    met = links.join(_dealt(side("a")), [*EDGE, "a"]).join(_dealt(side("b")), [*EDGE, "b"])
    met = met.where(F.abs(F.col("y_a") - F.col("y_b")) + F.abs(F.col("x_a") - F.col("x_b")) <= 2 * rng)
    rn = F.col("L_a") / F.col("L_b")
    m, d = {}, {}
    for k in ("M", "D", "I", "G", "L"):
        a, b = F.col(f"{k}_a"), F.col(f"{k}_b") * rn
        d[k] = a - b
        m[k] = F.lit(20.0) - F.abs(a - b) if k == "I" else signed_min(a, b)
    turn = wrapped(F.atan2("Dy_a", "Dx_a") - F.atan2("Dy_b", "Dx_b"))
    m["A"], d["A"] = F.cos(turn), turn / F.lit(math.pi)
    out = met.select(*EDGE, "a", "b", F.least("L_a", "L_b").alias("c"), F.hypot(F.col("y_a") - F.col("y_b"), F.col("x_a") - F.col("x_b")).alias("span"), *(v.alias(f"m_{k}") for k, v in m.items()), *(v.alias(f"d_{k}") for k, v in d.items()))
    total = lambda p, f=lambda c: c: sum((f(F.col(f"{p}_{k}")) for k in m), F.lit(0.0))
    return out.withColumn("m", total("m")).withColumn("d", total("d", F.abs))


def compare_links(links: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Links of high difference against the links that rise from their upper slice: signed minima of their differences."""
    d_ = [c for c in links.columns if c.startswith("d_")]
    low = links.where(F.col("d") / F.col("c") > filters.ave_slice_d).select(*EDGE, "a", "b", *(F.col(c).alias(f"l{c}") for c in d_))
    up = links.select(*EDGE, F.col("b").alias("a"), F.col("a").alias("top"), *(F.col(c).alias(f"u{c}") for c in d_))
    met = low.join(_dealt(up), [*EDGE, "a"])
    m = sum((signed_min(F.col(f"l{c}"), F.col(f"u{c}")) for c in d_), F.lit(0.0))
    d = sum((F.abs(F.col(f"l{c}") - F.col(f"u{c}")) for c in d_), F.lit(0.0))
    return met.select(*EDGE, "b", "a", "top", m.alias("m"), d.alias("d"))


def slice_clusters(spark: SparkSession, links: DataFrame, filters: Filters = DEFAULT, by: str = "m") -> DataFrame:
    """Slices joined by links over the average, with the cluster's name: its smallest slice."""
    ave = filters.ave_slice_m if by == "m" else filters.ave_slice_d
    kept = links.where(F.col(by) > ave * F.col("c"))
    return components_within(spark, kept, EDGE).toDF(*EDGE, "slice_id", "cluster_id")


def cluster_sums(clusters: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """Sums, box and number of slices of each cluster, its inner links' m and d (link_m, link_d), and how many links cross its border."""
    slices = found.where("kind = 'slice'")
    whole = slices.join(_dealt(clusters), [*EDGE, "slice_id"])
    key = [*EDGE, "cluster_id"]
    out = whole.groupBy(*key).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("I", "G", "Dy", "Dx", "M", "D", "L")), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("yn"), F.max("x").alias("xn"))
    side = lambda c: clusters.select(*EDGE, F.col("slice_id").alias(c), F.col("cluster_id").alias(f"k_{c}"))
    met = links.join(_dealt(side("a")), [*EDGE, "a"], "left").join(_dealt(side("b")), [*EDGE, "b"], "left")
    inner = met.where("k_a = k_b").groupBy(*EDGE, F.col("k_a").alias("cluster_id")).agg(F.sum("m").alias("link_m"), F.sum("d").alias("link_d"))
    ends = met.where("k_a is distinct from k_b").select(*EDGE, F.explode(F.array("k_a", "k_b")).alias("cluster_id")).where("cluster_id is not null")
    border = ends.groupBy(*key).agg(F.count("*").alias("n_border"))
    return out.join(_dealt(inner), key, "left").join(_dealt(border), key, "left").na.fill(0, ["n_border"])


def segment_slices(segments: DataFrame) -> DataFrame:
    """Row segments of adjacent rows that overlap (diagonally too): match and difference of their lengths and intensities."""
    up = segments.select("frame_id", (F.col("y") + 1).alias("y"), "s", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("n").alias("a_n"), F.col("I").alias("a_I"))
    met = up.join(segments.select("frame_id", "y", "s", "lo", "hi", "n", "I"), ["frame_id", "y", "s"]).where((F.col("a_lo") <= F.col("hi") + 1) & (F.col("lo") <= F.col("a_hi") + 1))
    shift = F.abs((F.col("lo") + F.col("hi")) - (F.col("a_lo") + F.col("a_hi")))
    return met.select("frame_id", "y", "a_lo", "lo", (F.col("n") - F.col("a_n")).alias("dL"), F.least("n", "a_n").alias("mL"), (F.col("I") - F.col("a_I")).alias("dI"), F.least("I", "a_I").alias("mI"), shift.cast("long").alias("shift2"))


def same_sign_chains(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """Overlapping segments chained where consecutive length differences have one sign.

    A row a pair of segments: frame_id, y (of the upper one), up and down (where the two begin) and its chain's first pair.
    """
    up, down = F.struct("frame_id", (F.col("y") - 1).alias("y"), F.col("a_lo").alias("x")), F.struct("frame_id", "y", F.col("lo").alias("x"))
    named = pairs.select(up.alias("up"), down.alias("down"), (F.col("dL") > 0).alias("sign"), F.struct("frame_id", (F.col("y") - 1).alias("y"), F.col("a_lo").alias("up"), F.col("lo").alias("down")).alias("pair"))
    a = named.select(F.col("down").alias("mid"), "sign", F.col("pair").alias("a"))
    b = named.select(F.col("up").alias("mid"), "sign", F.col("pair").alias("b"))
    found = components_within(spark, a.join(b, ["mid", "sign"]).select("mid.frame_id", "a", "b"), ["frame_id"])
    return found.select("node.*", F.struct("component.y", "component.up", "component.down").alias("first"))


def inner_dx(derts: DataFrame) -> DataFrame:
    """Consecutive dx of a row segment: sums of differences and of signed minima."""
    w = Window.partitionBy("frame_id", "y").orderBy("x")
    joined = (F.lag("s").over(w) == F.col("s")) & (F.lag("x").over(w) == F.col("x") - 1)
    change = F.coalesce(~joined, F.lit(True)).cast("long")
    before: Column = F.when(joined, F.lag("dx4").over(w))
    named = derts.withColumn("c", change).withColumn("prior", before).withColumn("seg", F.sum("c").over(w) - 1)
    return named.groupBy("frame_id", "y", "seg").agg(F.coalesce(F.sum(F.col("dx4") - F.col("prior")), F.lit(0)).cast("long").alias("Ddx4"), F.coalesce(F.sum(F.when(F.col("prior").isNotNull(), signed_min("prior", "dx4"))), F.lit(0)).cast("long").alias("Mdx4"))
