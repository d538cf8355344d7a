"""Registered queries over grids and blobs, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.filters import Filters
from gradus.operators import blobs, merge, reach, stencil
from gradus.plans.scratch import Scratch
from gradus.sources import tables

GRID = Filters(ave_g=15)
#: Blobs of sizeable match search on past their neighbours.
REACH = Filters(ave_g=15, ave_mB=20)


def _pixels(spark, sf):
    return tables.embedding_frames(spark, sf)


def _derts(spark, sf):
    return stencil.gradient_3x3(_pixels(spark, sf), GRID)


def _labelled(spark, sf):
    derts = _derts(spark, sf)
    return blobs.label_by_segments(spark, derts)


def _blobs(spark, sf):
    labelled = Scratch(spark, "blobs").save(_labelled(spark, sf), "labelled")
    return labelled, blobs.blob_sums(labelled)


def _thousandths(df, *names):
    """Doubles as whole thousandths, so that engines agree on them."""
    return df.withColumns({c: F.round(F.col(c) * 1000).cast("long") for c in names})


def px_gradient_3x3(spark, sf):
    return _thousandths(_derts(spark, sf), "g")


def px_gradient_2x2(spark, sf):
    return _thousandths(stencil.gradient_2x2(_pixels(spark, sf)), "g")


def px_ternary(spark, sf):
    return _thousandths(stencil.ternary(_pixels(spark, sf)), "p", "g", "dy", "dx", "p3", "g3", "dy3", "dx3")


def px_hybrid_match(spark, sf):
    return stencil.hybrid_match(_pixels(spark, sf), GRID)


def px_ring_compare(spark, sf):
    return _thousandths(stencil.ring_compare(_pixels(spark, sf), _derts(spark, sf), 2, GRID, olp=1), "g")


def px_sparse_sobel(spark, sf):
    return _thousandths(stencil.sparse_sobel(_pixels(spark, sf), GRID), "g")


def px_angle(spark, sf):
    derts = stencil.gradient_2x2(_pixels(spark, sf)).select("frame_id", "y", "x", "dy", "dx")
    return _thousandths(stencil.angle_compare(derts), "ma", "day_sin", "dax_sin", "da_cos")


def px_gradient_of_gradient(spark, sf):
    derts = stencil.gradient_2x2(_pixels(spark, sf)).select("frame_id", "y", "x", "dy", "dx")
    return _thousandths(stencil.gradient_of_gradient(derts), "dgy", "dgx", "gg")


def px_filter_bank(spark, sf):
    return stencil.filter_bank(_pixels(spark, sf))


def px_tile(spark, sf):
    return tables.tile(_pixels(spark, sf), 16, 16, 32, 32)


def px_splice_rows(spark, sf):
    return tables.spliced(_pixels(spark, sf))


def blob_labels(spark, sf):
    return _labelled(spark, sf).select("frame_id", "y", "x", "s", "blob_id")


def blob_params(spark, sf):
    return _blobs(spark, sf)[1]


def blob_frame_sums(spark, sf):
    return blobs.frame_sums(_blobs(spark, sf)[1])


def blob_adjacency(spark, sf):
    return blobs.adjacency(_blobs(spark, sf)[0])


def blob_pose(spark, sf):
    labelled, sums = _blobs(spark, sf)
    return blobs.adjacency_pose(blobs.adjacency(labelled), sums)


def row_segments(spark, sf):
    return blobs.row_segments(_derts(spark, sf)).drop("seg_id")


def segment_links(spark, sf):
    return blobs.segment_links(blobs.row_segments(_derts(spark, sf)))


def blob_pair_compare(spark, sf):
    labelled, sums = _blobs(spark, sf)
    return blobs.compare_blobs(blobs.adjacency(labelled), sums, GRID).select("frame_id", "a", "b", F.round(F.col("m") * 100).cast("long").alias("m"))


def blob_reach(spark, sf):
    labelled, sums = _blobs(spark, sf)
    found = reach.decayed_search(blobs.adjacency(labelled), sums, REACH)
    return found.withColumns({c: F.round(c, 4) + 0.0 for c in ("distance", "neg", "m", "d")})


def blob_graphs(spark, sf):
    labelled, sums = _blobs(spark, sf)
    return blobs.blob_graphs(spark, blobs.compare_blobs(blobs.adjacency(labelled), sums, GRID))


def blob_intra(spark, sf):
    return blobs.intra_blob(spark, _pixels(spark, sf), _derts(spark, sf), GRID)


def blob_direction(spark, sf):
    return blobs.direction_blobs(_derts(spark, sf)).groupBy("frame_id", "blob_id").agg(F.count("*").alias("area"), F.first("s").alias("s"))


def blob_direction_merged(spark, sf):
    return merge.merged_directions(spark, _blobs(spark, sf)[0], GRID)


def blob_flow(spark, sf):
    return blobs.flow_successors(_derts(spark, sf))


def blob_angle_deviation(spark, sf):
    return blobs.angle_deviation(_blobs(spark, sf)[0])


QUERIES = {
    f.__name__: f
    for f in (
        px_gradient_3x3, px_gradient_2x2, px_ternary, px_hybrid_match, px_ring_compare, px_sparse_sobel, px_angle, px_gradient_of_gradient, px_filter_bank, px_tile, px_splice_rows,
        blob_labels, blob_params, blob_frame_sums, blob_adjacency, blob_pose, row_segments, segment_links, blob_pair_compare, blob_reach, blob_graphs, blob_intra, blob_direction, blob_direction_merged, blob_flow, blob_angle_deviation,
    )
}

PX = """px AS (
  SELECT vec_id // 64 AS frame_id, (vec_id % 64)::INT AS y, (k - 1)::INT AS x, floor(embedding[k]::DOUBLE * 128 + 128)::BIGINT AS i
  FROM embeddings, range(1, 65) AS r(k))"""


def window_sql(size: int, source: str = "px", cols: tuple[str, ...] = ("i",), out: str = "w") -> str:
    """Windows of frames without holes, by leads along x and then y."""
    along = ", ".join(f"lead({c}, {k}) OVER (PARTITION BY frame_id, y ORDER BY x) AS {c}0{k}" for c in cols for k in range(size))
    down = ", ".join(f"lead({c}0{k}, {r}) OVER (PARTITION BY frame_id, x ORDER BY y) AS {c}{r}{k}" for c in cols for r in range(1, size) for k in range(size))
    whole = " AND ".join(f"{c}{r}{k} IS NOT NULL" for c in cols for r in range(size) for k in range(size))
    return f"""{out}x AS (SELECT frame_id, y, x, {along} FROM {source}),
{out}y AS (SELECT *, {down} FROM {out}x),
{out} AS (SELECT * FROM {out}y WHERE {whole})"""


_W3, _W2 = f"{PX},\n{window_sql(3)}", f"{PX},\n{window_sql(2)}"
_DERT = f"""{_W3},
d0 AS (SELECT frame_id, y, x, i00 AS i, (i20 - i02) + 2 * (i21 - i01) + (i22 - i00) AS dy4, (i02 - i20) + 2 * (i12 - i10) + (i22 - i00) AS dx4 FROM w),
dert AS (SELECT *, sqrt((dy4 * dy4 + dx4 * dx4)::DOUBLE) / 4 AS g, dy4 * dy4 + dx4 * dx4 < {(4 * GRID.ave_g) ** 2} AS s FROM d0)"""
_HALF = "(VALUES (0, 1), (1, 0), (1, 1), (1, -1)) AS o(oy, ox)"
_LABEL = f"""WITH RECURSIVE {_DERT},
n AS (SELECT *, y * 2147483648 + x AS own, frame_id::HUGEINT * 4611686018427387904 + y * 2147483648 + x AS id FROM dert),
e0 AS (
  SELECT a.id AS a, b.id AS b FROM n a, {_HALF} JOIN n b ON b.frame_id = a.frame_id AND b.y = a.y + oy AND b.x = a.x + ox AND b.s = a.s
  WHERE a.s OR oy = 0 OR ox = 0),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
cc(id, comp) USING KEY (id) AS (
  SELECT id, id AS comp FROM n
  UNION
  SELECT e.b, min(c.comp) FROM cc c JOIN e ON e.a = c.id JOIN recurring.cc r ON r.id = e.b WHERE c.comp < r.comp GROUP BY e.b),
lab AS (SELECT n.*, (cc.comp - frame_id::HUGEINT * 4611686018427387904)::BIGINT AS blob_id FROM n JOIN cc USING (id))"""
_SUMS = f"""{_LABEL},
b0 AS (
  SELECT frame_id, blob_id, any_value(s) AS s, count(*) AS area, sum(i)::BIGINT AS I, sum(round(g * 1000)::BIGINT)::BIGINT AS G1000, sum(dy4)::BIGINT AS Dy4, sum(dx4)::BIGINT AS Dx4,
         sum(y)::BIGINT AS Y, sum(x)::BIGINT AS X, min(y) AS y0, min(x) AS x0, max(y) AS yn, max(x) AS xn
  FROM lab GROUP BY ALL),
blob AS (SELECT *, y0 = min(y0) OVER f OR x0 = min(x0) OVER f OR yn = max(yn) OVER f OR xn = max(xn) OVER f AS open FROM b0 WINDOW f AS (PARTITION BY frame_id))"""
_ADJ = f"""{_SUMS},
a0 AS (SELECT DISTINCT p.frame_id, p.blob_id AS a, q.blob_id AS b FROM lab p, {_HALF} JOIN lab q ON q.frame_id = p.frame_id AND q.y = p.y + oy AND q.x = p.x + ox AND q.s <> p.s),
adj AS (SELECT * FROM a0 UNION SELECT frame_id, b, a FROM a0)"""
_SEG = f"""WITH {_DERT},
sc AS (SELECT *, coalesce(s <> lag(s) OVER v OR x <> lag(x) OVER v + 1, true)::INT AS c FROM dert WINDOW v AS (PARTITION BY frame_id, y ORDER BY x)),
sn AS (SELECT *, sum(c) OVER (PARTITION BY frame_id, y ORDER BY x) - 1 AS seg FROM sc),
seg AS (SELECT frame_id, y, seg::BIGINT AS seg, s, min(x) AS lo, max(x) AS hi, count(*) AS n, sum(i)::BIGINT AS I, y * 2147483648 + min(x) AS seg_id FROM sn GROUP BY frame_id, y, seg, s)"""
_PAIR = f"""{_ADJ},
pr AS (
  SELECT adj.*, p.area AS aa, q.area AS ab, q.I / q.area / 1.0::DOUBLE - p.I / p.area / 1.0::DOUBLE AS di, p.G1000 / p.area / 1000.0::DOUBLE AS ga, q.G1000 / q.area / 1000.0::DOUBLE AS gb,
         cos(atan2(q.Dy4::DOUBLE, q.Dx4::DOUBLE) - atan2(p.Dy4::DOUBLE, p.Dx4::DOUBLE)) AS co
  FROM adj JOIN blob p ON p.frame_id = adj.frame_id AND p.blob_id = a JOIN blob q ON q.frame_id = adj.frame_id AND q.blob_id = b WHERE a < b),
pc AS (
  SELECT frame_id, a, b, round({GRID.ave_g} - abs(di) + (co + 1) / 2 + least(ga, gb) - abs(gb - ga) / 2
         + least(ln(1 + aa::DOUBLE), ln(1 + ab::DOUBLE)) - abs(ln(1 + ab::DOUBLE) - ln(1 + aa::DOUBLE)) / 2, 4) AS m FROM pr)"""
_B = [f"{float(x)}::DOUBLE" for x in REACH.ave_blob]
#: Ways by the best first: open ends of the last round meet neighbours that their blob hasn't met.
_REACH = f"""{_ADJ},
ft AS (
  SELECT frame_id, blob_id, area::DOUBLE AS area, {float(REACH.ave_g)}::DOUBLE * area - G1000 / 1000.0::DOUBLE AS M, I / area::DOUBLE AS i, atan2(Dy4::DOUBLE, Dx4::DOUBLE) AS angle,
         G1000 / area::DOUBLE / 1000.0::DOUBLE AS g, ln(1 + area::DOUBLE) AS size FROM blob),
met(frame_id, a, b, hop, distance, neg, m, d, goes, live) USING KEY (frame_id, a, b) AS (
  SELECT frame_id, blob_id, blob_id, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, true FROM ft
  UNION
  SELECT frame_id, a, b, hop, distance, neg, m, d, q.distance + sqrt(b_area), m <= 0 AND a_M + neg + m > {REACH.ave_mB} FROM (
    SELECT w.*, p.M AS a_M, t.area AS b_area,
           ({_B[0]} * k - abs(t.i - p.i)) + ((cos(t.angle - p.angle) + 1) / 2 - {_B[1]} * k) + (least(p.g, t.g) - abs(t.g - p.g) / 2 - {_B[2]} * k) + (least(p.size, t.size) - abs(t.size - p.size) / 2 - {_B[3]} * k) AS m,
           abs(t.i - p.i) + (1.0::DOUBLE - (cos(t.angle - p.angle) + 1) / 2) + abs(t.g - p.g) AS d
    FROM (
      SELECT *, pow({REACH.ave_rM}::DOUBLE, (1 + distance) / sqrt((SELECT area FROM ft WHERE ft.frame_id = x.frame_id AND blob_id = a))) AS k FROM (
        SELECT c.frame_id, c.a, adj.b, c.hop + 1 AS hop, arg_min(c.goes, (-(c.neg + c.m), c.goes, c.b)) AS distance, arg_min(c.neg + c.m, (-(c.neg + c.m), c.goes, c.b)) AS neg
        FROM met c JOIN adj ON adj.frame_id = c.frame_id AND adj.a = c.b LEFT JOIN recurring.met r ON r.frame_id = c.frame_id AND r.a = c.a AND r.b = adj.b
        WHERE c.live AND r.a IS NULL GROUP BY c.frame_id, c.a, adj.b, c.hop) x) w
    JOIN ft p ON p.frame_id = w.frame_id AND p.blob_id = w.a JOIN ft t ON t.frame_id = w.frame_id AND t.blob_id = w.b) q)"""
_k = lambda e, n: f"round(({e}) * 1000)::BIGINT AS {n}"
_UNIT = f"""{PX}, {window_sql(2)},
gd AS (SELECT frame_id, y, x, (i10 + i11) - (i00 + i01) AS dy, (i01 + i11) - (i00 + i10) AS dx FROM w),
un AS (SELECT frame_id, y, x, sqrt(dy::DOUBLE * dy + dx::DOUBLE * dx) AS g, CASE WHEN dy <> 0 OR dx <> 0 THEN dy / sqrt(dy::DOUBLE * dy + dx::DOUBLE * dx) ELSE 0.0 END AS u, CASE WHEN dy <> 0 OR dx <> 0 THEN dx / sqrt(dy::DOUBLE * dy + dx::DOUBLE * dx) ELSE 0.0 END AS v FROM gd),
{window_sql(2, "un", ("g", "u", "v"), "q")}"""
_RING = ", ".join(f"({oy}, {ox}, {round(1e6 * oy / n)}, {round(1e6 * ox / n)})" for oy, ox, n in stencil._ring(2))
_BANK = {n: " + ".join(f"({a}) * i{j // 3}{j % 3}" for j, a in enumerate(w)) for n, w in stencil.BANK.items()}
_DIRECTED = [n for n in stencil.BANK if n != "mean"]

ORACLES = {
    "px_gradient_3x3": f"WITH {_DERT} SELECT frame_id, y, x, i, dy4, dx4, {_k('g', 'g')}, s FROM dert",
    "px_gradient_2x2": f"""WITH {_W2}, d AS (SELECT frame_id, y, x, i00 AS i, (i10 + i11) - (i00 + i01) AS dy, (i01 + i11) - (i00 + i10) AS dx, abs(i00 - i11) + abs(i01 - i10) AS m FROM w)
SELECT frame_id, y, x, i, {_k("sqrt(dy::DOUBLE * dy + dx::DOUBLE * dx)", "g")}, dy, dx, m FROM d""",
    "px_ternary": f"""WITH {_W3}, d AS (SELECT frame_id, y, x, (i00 + i01 + i10 + i11) * 0.25::DOUBLE AS p, ((i11 - i01) + (i10 - i00)) * 0.5::DOUBLE AS dy, ((i11 - i10) + (i01 - i00)) * 0.5::DOUBLE AS dx, i11 AS p3,
  (i21 - i01) * 0.25::DOUBLE + ((i22 - i00) + (i20 - i02)) * 0.125::DOUBLE AS dy3, (i12 - i10) * 0.25::DOUBLE + ((i22 - i00) - (i20 - i02)) * 0.125::DOUBLE AS dx3 FROM w)
SELECT frame_id, y, x, {_k('p', 'p')}, {_k('sqrt(dy * dy + dx * dx)', 'g')}, {_k('dy', 'dy')}, {_k('dx', 'dx')}, {_k('p3', 'p3')}, {_k('sqrt(dy3 * dy3 + dx3 * dx3)', 'g3')}, {_k('dy3', 'dy3')}, {_k('dx3', 'dx3')} FROM d""",
    "px_hybrid_match": f"""WITH {_W3} SELECT frame_id, y, x, i11 AS i, i22 - i11 AS dy, i12 - i21 AS dx, trunc(sqrt((i22 - i11)::DOUBLE * (i22 - i11) + (i12 - i21)::DOUBLE * (i12 - i21)) - {GRID.ave_g})::BIGINT AS G,
  {int(GRID.ave_g * 1.2)} - ({" + ".join(f"abs(i11 - i{r}{k})" for r in range(3) for k in range(3) if (r, k) != (1, 1))}) AS M FROM w""",
    "px_ring_compare": f"""WITH {_DERT}, ring AS (SELECT d.frame_id, d.y, d.x, sum(p.i * cy)::BIGINT AS ry, sum(p.i * cx)::BIGINT AS rx, count(*) AS n
  FROM dert d, (VALUES {_RING}) AS o(oy, ox, cy, cx) JOIN px p ON p.frame_id = d.frame_id AND p.y = d.y + oy AND p.x = d.x + ox GROUP BY ALL),
r AS (SELECT d.frame_id, d.y, d.x, d.i, dy4 * 250000 + ry AS dy6, dx4 * 250000 + rx AS dx6 FROM dert d JOIN ring USING (frame_id, y, x) WHERE n = 16),
g AS (SELECT *, sqrt((dy6 / 1e6::DOUBLE) * (dy6 / 1e6::DOUBLE) + (dx6 / 1e6::DOUBLE) * (dx6 / 1e6::DOUBLE)) AS g FROM r)
SELECT frame_id, y, x, i, dy6, dx6, {_k('g', 'g')}, g < {GRID.ave_g * 2} AS s FROM g""",
    "px_sparse_sobel": f"""WITH {_W3}, d AS (SELECT frame_id, (y // 2)::INT AS y, (x // 2)::INT AS x, i11 AS i, (i22 - i00) + 2 * (i21 - i01) + (i20 - i02) AS dy, (i22 - i00) + 2 * (i12 - i10) + (i02 - i20) AS dx,
  {int(GRID.ave_g * 1.2)} - ({" + ".join(f"{1 if (r + k) % 2 == 0 else 2} * abs(i11 - i{r}{k})" for r in range(3) for k in range(3) if (r, k) != (1, 1))}) AS m FROM w WHERE y % 2 = 0 AND x % 2 = 0)
SELECT frame_id, y, x, i, dy, dx, {_k(f'sqrt(dy::DOUBLE * dy + dx::DOUBLE * dx) - {GRID.ave_g}', 'g')}, m FROM d""",
    "px_angle": f"""WITH {_UNIT}, d AS (SELECT frame_id, y, x, v01 * u10 - u01 * v10 AS s0, v01 * v10 + u01 * u10 AS c0, v00 * u11 - u00 * v11 AS s1, v00 * v11 + u00 * u11 AS c1 FROM q)
SELECT frame_id, y, x, {_k('c0 + 1 + c1 + 1', 'ma')}, {_k('-s0 - s1', 'day_sin')}, {_k('-s0 + s1', 'dax_sin')}, {_k('c0 + c1', 'da_cos')} FROM d""",
    "px_filter_bank": f"""WITH {_W3}, f AS (SELECT frame_id, y, x, {", ".join(f"({e})::BIGINT AS {n}" for n, e in _BANK.items())} FROM w)
SELECT *, CASE {" ".join(f"WHEN abs({n}) = greatest({', '.join(f'abs({m})' for m in _DIRECTED)}) THEN '{n}'" for n in _DIRECTED)} END AS axis FROM f""",
    "px_tile": f"WITH {PX} SELECT * FROM px WHERE y BETWEEN 16 AND 47 AND x BETWEEN 16 AND 47",
    "px_splice_rows": f"WITH {PX} SELECT frame_id AS line_id, row_number() OVER (PARTITION BY frame_id ORDER BY y, x) - 1 AS x, i FROM px",
    "blob_labels": f"{_LABEL} SELECT frame_id, y, x, s, blob_id FROM lab",
    "blob_params": f"{_SUMS} SELECT * FROM blob",
    "blob_frame_sums": f"{_SUMS} SELECT frame_id, count(*) AS n_blobs, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('area', 'I', 'G1000', 'Dy4', 'Dx4'))} FROM blob GROUP BY frame_id",
    "blob_adjacency": f"{_ADJ} SELECT frame_id, a, b FROM adj",
    "blob_pose": f"""{_ADJ} SELECT adj.frame_id, a, b, (CASE WHEN p.open AND q.open THEN 2 WHEN q.y0 > p.y0 AND q.x0 > p.x0 AND q.yn < p.yn AND q.xn < p.xn THEN 0
  WHEN p.y0 > q.y0 AND p.x0 > q.x0 AND p.yn < q.yn AND p.xn < q.xn THEN 1 ELSE 2 END)::INT AS pose
FROM adj JOIN blob p ON p.frame_id = adj.frame_id AND p.blob_id = a JOIN blob q ON q.frame_id = adj.frame_id AND q.blob_id = b""",
    "row_segments": f"{_SEG} SELECT frame_id, y, seg, s, lo, hi, n, I FROM seg",
    "segment_links": f"{_SEG} SELECT a.frame_id, a.seg_id AS a, b.seg_id AS b FROM seg a JOIN seg b ON a.frame_id = b.frame_id AND b.y = a.y + 1 AND a.s = b.s AND a.lo <= b.hi + a.s::INT AND b.lo <= a.hi + a.s::INT",
    "blob_pair_compare": f"{_PAIR} SELECT frame_id, a, b, round(m * 100)::BIGINT AS m FROM pc",
    "blob_reach": f"""{_REACH} SELECT frame_id, a, b, hop::INT AS hop, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("distance", "neg", "m", "d"))} FROM met WHERE hop > 0""",
    "blob_flow": f"""WITH {_DERT}, t AS (SELECT *, ((round_even(atan2(dy4::DOUBLE, dx4::DOUBLE) / (pi() / 4), 0)::INT % 8) + 8) % 8 AS k FROM dert),
m AS (SELECT frame_id, y, x, y + [0, 1, 1, 1, 0, -1, -1, -1][k + 1] AS ty, x + [1, 1, 0, -1, -1, -1, 0, 1][k + 1] AS tx FROM t),
c AS (SELECT frame_id, ty AS y, tx AS x, count(*) AS n_in FROM m GROUP BY ALL)
SELECT m.*, coalesce(n_in, 0) AS n_in FROM m LEFT JOIN c USING (frame_id, y, x)""",
    "px_gradient_of_gradient": f"""WITH {_UNIT}, d AS (SELECT frame_id, y, x, g10 - g01 * (u10 * u01 + v10 * v01) AS d0, g11 - g00 * (u11 * u00 + v11 * v00) AS d1 FROM q),
e AS (SELECT frame_id, y, x, (d1 + d0) / 2 AS dgy, (d1 - d0) / 2 AS dgx FROM d)
SELECT frame_id, y, x, {_k('dgy', 'dgy')}, {_k('dgx', 'dgx')}, {_k('sqrt(dgy * dgy + dgx * dgx)', 'gg')} FROM e""",
    "blob_direction": f"""{_LABEL.replace(f"dy4 * dy4 + dx4 * dx4 < {(4 * GRID.ave_g) ** 2} AS s", "abs(dy4) > abs(dx4) AS s")}
SELECT frame_id, blob_id, count(*) AS area, any_value(s) AS s FROM lab GROUP BY ALL""",
}
