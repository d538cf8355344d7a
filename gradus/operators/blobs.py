"""Blobs: connected pixels of one sign, their sums, adjacency and comparison.

Positive pixels connect to eight neighbours, negative ones to four. A blob is
named by its first pixel in row order (y * STRIDE + x), so names don't depend on
the order of work.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters
from gradus.functions.compare import angle_match, direct_match, inverse_match
from gradus.operators.components import components_within
from gradus.operators.stencil import PIXEL, _ring
from gradus.plans.scratch import Scratch, rounds

#: Places are y * STRIDE + x, so y and x may be any non-negative int; across frames keys are (frame_id, place).
STRIDE = 1 << 31


def row_segments(derts: DataFrame, *more: Column, within: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Runs of one sign within a row (a missing pixel ends a run): seg_id, y, lo, hi and the sums of its pixels, and any further sums.

    ``within`` names what a run, link or component doesn't leave: the frame, or the frame and a region's root.
    """
    w = Window.partitionBy(*within, "y").orderBy("x")
    new = F.coalesce((F.col("s") != F.lag("s").over(w)) | (F.col("x") != F.lag("x").over(w) + 1), F.lit(True))
    cut = derts.withColumn("_new", new.cast("long")).withColumn("seg", F.sum("_new").over(w) - 1)
    return cut.groupBy(*within, "y", "seg", "s").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), F.sum("i").alias("I"), *more).withColumn("seg_id", F.col("y") * STRIDE + F.col("lo"))


def segment_links(segments: DataFrame, within: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Pairs of segments of equal sign on adjacent rows that touch: for + diagonally too, for - by overlap."""
    up = segments.select(*within, (F.col("y") + 1).alias("y"), "s", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("seg_id").alias("a"))
    reach = F.when(F.col("s"), 1).otherwise(0)
    met = up.join(segments.select(*within, "y", "s", "lo", "hi", F.col("seg_id").alias("b")), [*within, "y", "s"])
    return met.where((F.col("a_lo") <= F.col("hi") + reach) & (F.col("lo") <= F.col("a_hi") + reach)).select(*within, "a", "b")


def label_by_segments(spark: SparkSession, derts: DataFrame, within: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """blob_id of every pixel: components over row segments, for frames of any size.

    Pixels are written once with their segment, so what they are computed from runs once.
    """
    scratch = Scratch(spark, "labels")
    w = Window.partitionBy(*within, "y").orderBy("x")
    new = F.coalesce((F.col("s") != F.lag("s").over(w)) | (F.col("x") != F.lag("x").over(w) + 1), F.lit(True))
    start = F.last(F.when(new, F.col("x")), ignorenulls=True).over(w)
    own = scratch.save(derts.withColumn("seg_id", F.col("y") * STRIDE + start), "pixels")
    segs = own.groupBy(*within, "y", "s", "seg_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    segs = scratch.save(segs, "segments")
    # shuffled joins: the tables grow with the pixels, and written ones are many times their file's size in the driver
    edges = segment_links(segs.hint("merge"), within).union(segs.select(*within, "seg_id", "seg_id"))
    found = components_within(spark, edges, list(within)).toDF(*within, "seg_id", "blob_id")
    return own.join(found.hint("merge"), [*within, "seg_id"]).drop("seg_id")


def _label_frame(y: np.ndarray, x: np.ndarray, s: np.ndarray, region: np.ndarray | None = None) -> np.ndarray:
    """First pixels of the components of one frame, by spreading the least name over its neighbours; pixels of different regions don't connect."""
    y0, x0 = y.min(), x.min()
    name = np.full((y.max() - y0 + 3, x.max() - x0 + 3), -1, np.int64)
    sign = np.zeros(name.shape, np.int8)
    name[y - y0 + 1, x - x0 + 1] = y * STRIDE + x
    sign[y - y0 + 1, x - x0 + 1] = np.where(s, 1, -1)
    part = np.full(name.shape, -1, np.int64)
    part[y - y0 + 1, x - x0 + 1] = 0 if region is None else region
    at = np.flatnonzero(name.ravel() >= 0)
    flat, part, wide = sign.ravel(), part.ravel(), name.shape[1]
    a, b = [], []
    for step in (1, wide, wide + 1, wide - 1):
        other = np.minimum(at + step, flat.size - 1)
        ok = (flat[at] == flat[other]) & (part[at] == part[other])
        if step in (wide + 1, wide - 1):
            ok &= flat[at] > 0
        a.append(at[ok])
        b.append(other[ok])
    a, b, out = np.concatenate(a), np.concatenate(b), name.ravel().copy()
    label = np.arange(flat.size)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return out[label[(y - y0 + 1) * wide + x - x0 + 1]]


def label_by_frame(derts: DataFrame) -> DataFrame:
    """blob_id of every pixel, a frame in one task: for frames (or tiles) of bounded size."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in derts.schema)}, blob_id long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(blob_id=_label_frame(pdf.y.to_numpy(np.int64), pdf.x.to_numpy(np.int64), pdf.s.to_numpy(bool)))

    return derts.groupBy("frame_id").applyInPandas(one, schema)


def blob_sums(labelled: DataFrame) -> DataFrame:
    """Area and sums of every blob (G in thousandths, Dy and Dx times four), its box and whether it lies on the frame's border."""
    edge = Window.partitionBy("frame_id")
    blobs = labelled.groupBy("frame_id", "blob_id").agg(
        F.first("s").alias("s"), F.count("*").alias("area"), F.sum("i").alias("I"), F.sum(F.round(F.col("g") * 1000).cast("long")).alias("G1000"), F.sum("dy4").alias("Dy4"), F.sum("dx4").alias("Dx4"),
        F.sum(F.col("y").cast("long")).alias("Y"), F.sum(F.col("x").cast("long")).alias("X"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("yn"), F.max("x").alias("xn"),
    )
    box = {"fy0": F.min("y0").over(edge), "fx0": F.min("x0").over(edge), "fyn": F.max("yn").over(edge), "fxn": F.max("xn").over(edge)}
    on = (F.col("y0") == F.col("fy0")) | (F.col("x0") == F.col("fx0")) | (F.col("yn") == F.col("fyn")) | (F.col("xn") == F.col("fxn"))
    return blobs.withColumns(box).withColumn("open", on).drop("fy0", "fx0", "fyn", "fxn")


def frame_sums(blobs: DataFrame) -> DataFrame:
    return blobs.groupBy("frame_id").agg(F.count("*").alias("n_blobs"), *(F.sum(c).alias(c) for c in ("area", "I", "G1000", "Dy4", "Dx4")))


def adjacency(labelled: DataFrame, conn: int = 8, within: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Pairs of opposite-sign blobs with touching pixels, in both directions.

    Pixels are first gathered to row segments. Segments of a row that follow each other without a gap touch; those of a
    row and of the next are swept together by their starts: of each row and sign at most one segment is open where another begins
    (segments of a sign lie at least a pixel apart), so one window finds the touching ones, and rows grow with the segments.
    """
    reach = 1 if conn == 8 else 0
    segments = row_segments(labelled, F.first("blob_id").alias("blob"), within=within).select(*within, "y", "s", F.col("lo").cast("long").alias("lo"), "hi", "blob")
    along = Window.partitionBy(*within, "y").orderBy("lo")
    beside = segments.select(*within, F.col("blob").alias("a"), F.when((F.lead("lo").over(along) == F.col("hi") + 1) & (F.lead("s").over(along) != F.col("s")), F.lead("blob").over(along)).alias("b")).where("b is not null")
    both = segments.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("y", F.col("y") - F.col("r"))
    sweep = Window.partitionBy(*within, "y").orderBy("lo").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda row, sign: F.last(F.when((F.col("r") == row) & (F.col("s") == sign), F.struct("hi", "blob")), ignorenulls=True).over(sweep)
    open_ = both.withColumns({f"o{r}{int(s)}": last(r, s) for r in (0, 1) for s in (False, True)})
    other = F.when((F.col("r") == 0) & F.col("s"), F.col("o10")).when(F.col("r") == 0, F.col("o11")).when(F.col("s"), F.col("o00")).otherwise(F.col("o01"))
    above = open_.withColumn("o", other).where(F.col("o.hi") + reach >= F.col("lo")).select(*within, F.col("blob").alias("a"), F.col("o.blob").alias("b"))
    met = beside.unionByName(above)
    return met.union(met.select(*within, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def bind_pairs(pairs: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Unordered pairs, once each."""
    return pairs.select(*keys, F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a) != F.col(b)).distinct()


def lift_pairs(pairs: DataFrame, parent: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Pairs of members as pairs of their parents (member, root)."""
    k = list(keys)
    up = lambda c: parent.select(*k, F.col("member").alias(c), F.col("root").alias(f"{c}_root"))
    lifted = pairs.join(up("a"), [*k, "a"]).join(up("b"), [*k, "b"]).select(*k, F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    return bind_pairs(lifted, keys=keys)


def _ends(pairs: DataFrame, blobs: DataFrame, cols: list[str]) -> DataFrame:
    side = lambda c: blobs.select("frame_id", F.col("blob_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in cols))
    return pairs.join(side("a"), ["frame_id", "a"]).join(side("b"), ["frame_id", "b"])


def adjacency_pose(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """pose of b to a: 0 internal, 1 external, 2 open (both on the border, or neither box inside the other)."""
    both = _ends(pairs, blobs, ["y0", "x0", "yn", "xn", "open"])
    inside = lambda i, o: (F.col(f"y0_{i}") > F.col(f"y0_{o}")) & (F.col(f"x0_{i}") > F.col(f"x0_{o}")) & (F.col(f"yn_{i}") < F.col(f"yn_{o}")) & (F.col(f"xn_{i}") < F.col(f"xn_{o}"))
    pose = F.when(F.col("open_a") & F.col("open_b"), 2).when(inside("b", "a"), 0).when(inside("a", "b"), 1).otherwise(2)
    return both.select("frame_id", "a", "b", pose.cast("int").alias("pose"))


def compare_blobs(pairs: DataFrame, blobs: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Adjacent blobs compared once each: mean intensity (inverse), gradient angle, mean gradient and area (direct); m and d summed."""
    both = _ends(pairs.where("a < b"), blobs, ["area", "I", "G1000", "Dy4", "Dx4"])
    per = lambda x, c, k=1.0: F.col(f"{x}_{c}") / F.col(f"area_{c}") / F.lit(k)
    angle = lambda c: F.atan2(F.col(f"Dy4_{c}").cast("double"), F.col(f"Dx4_{c}").cast("double"))
    d_i, d_g = per("I", "b") - per("I", "a"), per("G1000", "b", 1000.0) - per("G1000", "a", 1000.0)
    m_i = inverse_match(d_i, filters.ave_g)
    m_a, m_g = angle_match(angle("a"), angle("b")), direct_match(per("G1000", "a", 1000.0), per("G1000", "b", 1000.0), 0)
    m_s = direct_match(F.log1p(F.col("area_a").cast("double")), F.log1p(F.col("area_b").cast("double")), 0)
    m = m_i + m_a + m_g + m_s
    d = F.abs(d_i) + (F.lit(1.0) - m_a) + F.abs(d_g)
    return both.select("frame_id", "a", "b", F.round(m, 4).alias("m"), F.round(d, 4).alias("d"))


def blob_graphs(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Components over links whose ends' matches sum above 0: frame_id, blob_id, graph_id and the graph's size."""
    ends = links.select("frame_id", "a", "m").union(links.select("frame_id", F.col("b").alias("a"), "m")).groupBy("frame_id", "a").agg(F.sum("m").alias("M"))
    side = lambda c: ends.select("frame_id", F.col("a").alias(c), F.col("M").alias(f"M_{c}"))
    kept = links.join(side("a"), ["frame_id", "a"]).join(side("b"), ["frame_id", "b"]).where("M_a + M_b > 0")
    out = components_within(spark, kept, ["frame_id"]).toDF("frame_id", "blob_id", "graph_id")
    return out.withColumn("n", F.count("*").over(Window.partitionBy("frame_id", "graph_id")))


def _ring_sums(y: np.ndarray, x: np.ndarray, i: np.ndarray, cy: np.ndarray, cx: np.ndarray, rng: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ry and rx of ring_compare() at the places (cy, cx) of one frame's pixels, and whether the whole ring is there."""
    y0, x0 = min(y.min(), cy.min()) - rng, min(x.min(), cx.min()) - rng
    shape = (max(y.max(), cy.max()) + rng + 1 - y0, max(x.max(), cx.max()) + rng + 1 - x0)
    value, there = np.zeros(shape, i.dtype), np.zeros(shape, bool)
    value[y - y0, x - x0], there[y - y0, x - x0] = i, True
    ry, rx, whole = np.zeros(len(cy), i.dtype), np.zeros(len(cy), i.dtype), np.ones(len(cy), bool)
    for oy, ox, n in _ring(rng):
        at = (cy + oy - y0, cx + ox - x0)
        ry += value[at] * round(1e6 * oy / n)
        rx += value[at] * round(1e6 * ox / n)
        whole &= there[at]
    return ry, rx, whole


def _ringed(rows: DataFrame, inner: DataFrame, rng: int, filters: Filters, olp: float) -> DataFrame:
    """ring_compare() of the pixels of ``inner`` (with root) only, and their blobs within a root; a frame in one task, as in label_by_frame().

    rows are the frames' pixels, a row of a frame in one (frame_id, y, row_x, row_i).
    """
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in inner.schema]
    schema = ", ".join([*kept, "g double", "s boolean", "blob_id long"])
    columns = [*inner.columns, "g", "s", "blob_id"]

    def one(frame: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not (len(frame) and len(centres)):
            return pd.DataFrame(columns=columns)
        y = np.repeat(frame["y"].to_numpy(np.int64), frame["row_x"].map(len))
        x, i = (np.concatenate(frame[c].to_list()) for c in ("row_x", "row_i"))
        ry, rx, whole = _ring_sums(y, x, i, centres.y.to_numpy(np.int64), centres.x.to_numpy(np.int64), rng)
        out = centres[whole].copy()
        dy, dx = ((out[c].to_numpy() * 250_000 + r[whole]) / 1e6 for c, r in (("dy4", ry), ("dx4", rx)))
        out["g"] = np.sqrt(dy * dy + dx * dx)
        out["s"] = out.g < filters.ave_g * (olp + 1)
        found = _label_frame(out.y.to_numpy(np.int64), out.x.to_numpy(np.int64), out.s.to_numpy(bool), out.root.to_numpy(np.int64)) if len(out) else []
        return out.assign(blob_id=found)[columns]

    return rows.groupBy("frame_id").cogroup(inner.groupBy("frame_id")).applyInPandas(one, schema)


def intra_blob(spark: SparkSession, pixels: DataFrame, derts: DataFrame, filters: Filters = DEFAULT, depth: int | None = None) -> DataFrame:
    """Blobs of all depths: inside + blobs of low gradient the kernel's radius grows by one a depth and pixels are clustered again.

    All blobs of a depth at once; root is the blob of the depth above. A blob
    qualifies if s and G < ave * area + ave_r * olp, with olp = 1 + 1.5 a depth. Ends when none qualifies (or at ``depth``).
    Rings are summed around the pixels of qualifying blobs only, in the task that labels the frame.
    """
    scratch = Scratch(spark, "intra")
    rows = scratch.save(pixels.groupBy("frame_id", "y").agg(F.collect_list("x").alias("row_x"), F.collect_list("i").alias("row_i")), "rows")
    out, level, olp = [], scratch.save(label_by_frame(derts).withColumn("root", F.lit(-1).cast("long")), "level1"), 1.0
    # each depth keeps the first level's derivatives; the ring is added to them
    for k in rounds(last=depth):
        sums = level.groupBy("frame_id", "root", "blob_id").agg(F.first("s").alias("s"), F.count("*").alias("area"), F.sum(F.round(F.col("g") * 1000).cast("long")).alias("G1000"), F.sum("i").alias("I"))
        sums = scratch.save(sums, f"sums{k}")
        out.append(sums.withColumn("depth", F.lit(k)))
        if k == depth:
            break
        good = sums.where(F.col("s") & (F.col("G1000") < 1000 * (filters.ave_g * F.col("area") + filters.ave_r * olp))).select("frame_id", "root", "blob_id")
        inner = level.join(good, ["frame_id", "root", "blob_id"]).select(*PIXEL, "i", "dy4", "dx4", F.col("blob_id").alias("root"))
        near = rows.join(good.select("frame_id").distinct(), "frame_id", "left_semi")
        level = scratch.save(_ringed(near, inner, k + 1, filters, olp + 1.5), f"level{k + 1}")
        if level.isEmpty():
            break
        olp += 1.5
    return reduce(DataFrame.unionByName, out)


def direction_blobs(derts: DataFrame) -> DataFrame:
    """Pixels labelled by the components of |dy| > |dx| (eight neighbours where it holds, four where not)."""
    return label_by_frame(derts.withColumn("s", F.abs("dy4") > F.abs("dx4")))


def flow_successors(derts: DataFrame) -> DataFrame:
    """Each pixel's neighbour in the direction of its gradient (one of eight) and how many pixels lead into it; 0 marks the start of a chain."""
    turn = F.bround(F.atan2(F.col("dy4").cast("double"), F.col("dx4").cast("double")) / F.lit(np.pi / 4)).cast("int")
    step = F.pmod(turn, F.lit(8))
    table = lambda v: F.get(F.array(*(F.lit(x) for x in v)), step)
    moved = derts.select(*PIXEL, (F.col("y") + table([0, 1, 1, 1, 0, -1, -1, -1])).alias("ty"), (F.col("x") + table([1, 1, 0, -1, -1, -1, 0, 1])).alias("tx"))
    into = moved.join(derts.select("frame_id", F.col("y").alias("ty"), F.col("x").alias("tx")), ["frame_id", "ty", "tx"]).groupBy("frame_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.count("*").alias("n_in"))
    return moved.join(into, PIXEL, "left").select(*PIXEL, "ty", "tx", F.coalesce("n_in", F.lit(0)).alias("n_in"))


def angle_deviation(labelled: DataFrame) -> DataFrame:
    """Mean 1 - cosine of a pixel's gradient to its neighbours' of the same blob."""
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))
    slim = labelled.select(*PIXEL, "blob_id", "dy4", "dx4")
    sent = slim.withColumn("o", F.explode(offsets)).select("frame_id", "blob_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("dy4").alias("dy_b"), F.col("dx4").alias("dx_b"))
    dot = F.col("dy4") * F.col("dy_b") + F.col("dx4") * F.col("dx_b")
    norm = F.sqrt((F.col("dy4") * F.col("dy4") + F.col("dx4") * F.col("dx4")).cast("double")) * F.sqrt((F.col("dy_b") * F.col("dy_b") + F.col("dx_b") * F.col("dx_b")).cast("double"))
    met = slim.join(sent, [*PIXEL, "blob_id"])
    return met.groupBy(*PIXEL, "blob_id").agg(F.round(F.avg(F.when(norm > 0, F.lit(1.0) - dot / norm).otherwise(0.0)), 6).alias("da"), F.count("*").alias("n"))
