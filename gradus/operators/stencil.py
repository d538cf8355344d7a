"""Grids: gradient stencils on pixel tables (frame_id, y, x, i).

Neighbours come from two chains of leads within a frame (along x, then along y),
so one shuffle by frame_id and two sorts serve every stencil of up to 3 x 3. A lead
counts only if it is the adjacent pixel, so frames may have holes. Rings of
larger radius are a shift (one row for each offset) and a grouped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters

PIXEL = ["frame_id", "y", "x"]


def windows(pixels: DataFrame, size: int, cols: tuple[str, ...] = ("i",)) -> DataFrame:
    """Adds c_rk for row r and column k of the size x size window whose top left is the pixel; incomplete windows go."""
    along_x = Window.partitionBy("frame_id", "y").orderBy("x")
    along_y = Window.partitionBy("frame_id", "x").orderBy("y")
    out = pixels.repartition("frame_id")
    names, step = list(cols), {}
    for k in range(size):
        for c in cols:
            step[f"{c}_0{k}"] = F.col(c) if k == 0 else F.when(F.lead("x", k).over(along_x) == F.col("x") + k, F.lead(c, k).over(along_x))
    out = out.withColumns(step)
    down = {}
    for r in range(1, size):
        for k in range(size):
            for c in names:
                down[f"{c}_{r}{k}"] = F.when(F.lead("y", r).over(along_y) == F.col("y") + r, F.lead(f"{c}_0{k}", r).over(along_y))
    out = out.withColumns(down)
    whole = F.lit(True)
    for c in [f"{c}_{r}{k}" for c in names for r in range(size) for k in range(size)]:
        whole = whole & F.col(c).isNotNull()
    return out.where(whole)


def _c(r: int, k: int, c: str = "i") -> Column:
    return F.col(f"{c}_{r}{k}")


def magnitude(y: Column, x: Column) -> Column:
    y, x = y.cast("double"), x.cast("double")
    return F.sqrt(y * y + x * x)


def gradient_3x3(pixels: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """dy4 = 4 dy and dx4 = 4 dx (exact for whole pixels), g and sign s = ave > g; i is the top left pixel."""
    w = windows(pixels, 3)
    dy4 = (_c(2, 0) - _c(0, 2)) + 2 * (_c(2, 1) - _c(0, 1)) + (_c(2, 2) - _c(0, 0))
    dx4 = (_c(0, 2) - _c(2, 0)) + 2 * (_c(1, 2) - _c(1, 0)) + (_c(2, 2) - _c(0, 0))
    out = w.select(*PIXEL, "i", dy4.alias("dy4"), dx4.alias("dx4"))
    square = F.col("dy4") * F.col("dy4") + F.col("dx4") * F.col("dx4")
    return out.select(*PIXEL, "i", "dy4", "dx4", (F.sqrt(square.cast("double")) / 4).alias("g"), (square < (4 * filters.ave_g) ** 2).alias("s"))


def gradient_2x2(pixels: DataFrame) -> DataFrame:
    """dy and dx of sums over 2 x 2, g, and m = sum of absolute diagonal differences."""
    w = windows(pixels, 2)
    dy = (_c(1, 0) + _c(1, 1)) - (_c(0, 0) + _c(0, 1))
    dx = (_c(0, 1) + _c(1, 1)) - (_c(0, 0) + _c(1, 0))
    m = F.abs(_c(0, 0) - _c(1, 1)) + F.abs(_c(0, 1) - _c(1, 0))
    return w.select(*PIXEL, "i", magnitude(dy, dx).alias("g"), dy.alias("dy"), dx.alias("dx"), m.alias("m"))


def hybrid_match(pixels: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Of a 3 x 3 window's centre: rotated 2 x 2 gradient to the lower right, its deviation G, and M = 1.2 ave - sum of eight differences."""
    w = windows(pixels, 3)
    dy, dx = _c(2, 2) - _c(1, 1), _c(1, 2) - _c(2, 1)
    sad = sum((F.abs(_c(1, 1) - _c(r, k)) for r in range(3) for k in range(3) if (r, k) != (1, 1)), F.lit(0))
    g = magnitude(dy, dx) - filters.ave_g
    return w.select(*PIXEL, _c(1, 1).alias("i"), dy.alias("dy"), dx.alias("dx"), F.when(g < 0, F.ceil(g)).otherwise(F.floor(g)).cast("long").alias("G"), (F.lit(int(filters.ave_g * 1.2)) - sad).cast("long").alias("M"))


def ternary(pixels: DataFrame) -> DataFrame:
    """2 x 2 means and gradients (p, g, dy, dx) and 3 x 3 ones (p3, g3, dy3, dx3) of every 3 x 3 window."""
    w = windows(pixels, 3)
    p = (_c(0, 0) + _c(0, 1) + _c(1, 0) + _c(1, 1)) * 0.25
    dy = ((_c(1, 1) - _c(0, 1)) + (_c(1, 0) - _c(0, 0))) * 0.5
    dx = ((_c(1, 1) - _c(1, 0)) + (_c(0, 1) - _c(0, 0))) * 0.5
    down, up = _c(2, 2) - _c(0, 0), _c(2, 0) - _c(0, 2)
    dy3 = (_c(2, 1) - _c(0, 1)) * 0.25 + (down + up) * 0.125
    dx3 = (_c(1, 2) - _c(1, 0)) * 0.25 + (down - up) * 0.125
    num = lambda c, n: c.cast("double").alias(n)
    return w.select(*PIXEL, num(p, "p"), magnitude(dy, dx).alias("g"), num(dy, "dy"), num(dx, "dx"), num(_c(1, 1), "p3"), magnitude(dy3, dx3).alias("g3"), num(dy3, "dy3"), num(dx3, "dx3"))


def ring_offsets(spark: SparkSession, rng: int) -> DataFrame:
    """Border of the (2 rng + 1) square: oy, ox and n = oy² + ox²; the coefficients are oy / n and ox / n."""
    return spark.createDataFrame(_ring(rng), "oy int, ox int, n int")


def ring_compare(pixels: DataFrame, derts: DataFrame, rng: int, filters: Filters = DEFAULT, olp: float = 1) -> DataFrame:
    """Adds the ring's coefficients times its pixels to each dert's dy and dx (in 10⁻⁶ units, exact sums); the whole ring must be in the frame.

    Every pixel is sent to the derts it rings (8 rng rows, the offsets are a
    literal table) and summed on the map side before the shuffle.
    """
    offsets = F.array(*(F.struct(F.lit(oy).alias("oy"), F.lit(ox).alias("ox"), F.lit(round(1e6 * oy / n)).cast("long").alias("cy"), F.lit(round(1e6 * ox / n)).cast("long").alias("cx")) for oy, ox, n in _ring(rng)))
    sent = pixels.withColumn("o", F.explode(offsets)).select("frame_id", (F.col("y") - F.col("o.oy")).alias("y"), (F.col("x") - F.col("o.ox")).alias("x"), (F.col("i") * F.col("o.cy")).alias("ry"), (F.col("i") * F.col("o.cx")).alias("rx"))
    ring = sent.groupBy(*PIXEL).agg(F.sum("ry").alias("ry"), F.sum("rx").alias("rx"), F.count("*").alias("n")).where(F.col("n") == 8 * rng)
    out = derts.join(ring, PIXEL)
    dy, dx = F.col("dy4") * 250_000 + F.col("ry"), F.col("dx4") * 250_000 + F.col("rx")
    out = out.select(*PIXEL, "i", dy.alias("dy6"), dx.alias("dx6"))
    g = magnitude(F.col("dy6") / F.lit(1e6), F.col("dx6") / F.lit(1e6))
    return out.select(*PIXEL, "i", "dy6", "dx6", g.alias("g"), (g < filters.ave_g * (olp + 1)).alias("s"))


def _ring(rng: int) -> list[tuple[int, int, int]]:
    return [(oy, ox, oy * oy + ox * ox) for oy in range(-rng, rng + 1) for ox in range(-rng, rng + 1) if max(abs(oy), abs(ox)) == rng]


def sparse_sobel(pixels: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Stride 2 windows of 3 x 3: Sobel dy, dx, g - ave, and m = 1.2 ave - weighted absolute differences; coordinates are halved."""
    w = windows(pixels, 3).where("y % 2 = 0 and x % 2 = 0")
    dy = (_c(2, 2) - _c(0, 0)) + 2 * (_c(2, 1) - _c(0, 1)) + (_c(2, 0) - _c(0, 2))
    dx = (_c(2, 2) - _c(0, 0)) + 2 * (_c(1, 2) - _c(1, 0)) + (_c(0, 2) - _c(2, 0))
    sad = sum((F.abs(_c(1, 1) - _c(r, k)) * (1 if (r + k) % 2 == 0 else 2) for r in range(3) for k in range(3) if (r, k) != (1, 1)), F.lit(0))
    return w.select("frame_id", (F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), _c(1, 1).alias("i"), dy.alias("dy"), dx.alias("dx"), (magnitude(dy, dx) - filters.ave_g).alias("g"), (F.lit(int(filters.ave_g * 1.2)) - sad).cast("long").alias("m"))


def angle_compare(derts: DataFrame) -> DataFrame:
    """Unit gradients of a 2 x 2 window compared over both diagonals: sines and cosines, ma, and the components of day and dax."""
    norm = magnitude(F.col("dy"), F.col("dx"))
    unit = derts.select(*PIXEL, F.when(norm > 0, F.col("dy") / norm).otherwise(0.0).alias("u"), F.when(norm > 0, F.col("dx") / norm).otherwise(0.0).alias("v"))
    w = windows(unit, 2, ("u", "v"))

    def difference(a: tuple[int, int], b: tuple[int, int]) -> tuple[Column, Column]:
        s1, c1, s2, c2 = _c(*b, "u"), _c(*b, "v"), _c(*a, "u"), _c(*a, "v")
        return c1 * s2 - s1 * c2, c1 * c2 + s1 * s2

    sin0, cos0 = difference((1, 0), (0, 1))
    sin1, cos1 = difference((1, 1), (0, 0))
    return w.select(*PIXEL, (cos0 + 1 + cos1 + 1).alias("ma"), (-sin0 - sin1).alias("day_sin"), (-sin0 + sin1).alias("dax_sin"), (cos0 + cos1).alias("da_cos"))


#: Rows of 3 x 3 weights: edges and lines in four directions, and the mean (fixed values).
BANK = {
    "edge_h": (-1, -1, -1, 0, 0, 0, 1, 1, 1),
    "edge_v": (-1, 0, 1, -1, 0, 1, -1, 0, 1),
    "edge_d": (-1, -1, 0, -1, 0, 1, 0, 1, 1),
    "edge_u": (0, -1, -1, 1, 0, -1, 1, 1, 0),
    "line_h": (-1, -1, -1, 2, 2, 2, -1, -1, -1),
    "line_v": (-1, 2, -1, -1, 2, -1, -1, 2, -1),
    "line_d": (2, -1, -1, -1, 2, -1, -1, -1, 2),
    "line_u": (-1, -1, 2, -1, 2, -1, 2, -1, -1),
    "mean": (1, 1, 1, 1, 1, 1, 1, 1, 1),
}


def filter_bank(pixels: DataFrame) -> DataFrame:
    """Nine 3 x 3 filters of every whole window, and the name of the strongest of the eight directed ones."""
    w = windows(pixels, 3)
    cells = [_c(r, k) for r in range(3) for k in range(3)]
    out = w.select(*PIXEL, *(sum((F.lit(int(a)) * c for a, c in zip(weights, cells)), F.lit(0)).cast("long").alias(name) for name, weights in BANK.items()))
    best = F.array_max(F.array(*(F.struct(F.abs(F.col(n)).alias("v"), F.lit(-k).alias("k")) for k, n in enumerate(BANK) if n != "mean")))
    names = F.array(*(F.lit(n) for n in BANK))
    return out.withColumn("axis", F.get(names, -best["k"]))


def gradient_of_gradient(derts: DataFrame) -> DataFrame:
    """Over both diagonals of a 2 x 2 window g minus the other g times the cosine of their angle; decomposed to dgy, dgx, and gg."""
    norm = magnitude(F.col("dy"), F.col("dx"))
    unit = derts.select(*PIXEL, norm.alias("g"), F.when(norm > 0, F.col("dy") / norm).otherwise(0.0).alias("u"), F.when(norm > 0, F.col("dx") / norm).otherwise(0.0).alias("v"))
    w = windows(unit, 2, ("g", "u", "v"))
    cos = lambda a, b: _c(*a, "u") * _c(*b, "u") + _c(*a, "v") * _c(*b, "v")
    d0 = _c(1, 0, "g") - _c(0, 1, "g") * cos((1, 0), (0, 1))
    d1 = _c(1, 1, "g") - _c(0, 0, "g") * cos((1, 1), (0, 0))
    dgy, dgx = (d1 + d0) / 2, (d1 - d0) / 2
    return w.select(*PIXEL, dgy.alias("dgy"), dgx.alias("dgx"), magnitude(dgy, dgx).alias("gg"))
