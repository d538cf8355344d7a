"""Registered queries over edges, slices and node graphs, with their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.filters import Filters
from gradus.operators import blobs, density, graph, hierarchy, params, slices, stencil
from gradus.plans.grid_queries import _DERT, _SEG, _SUMS, _blobs, _derts
from gradus.plans.scratch import Scratch
from gradus.plans.sequence_queries import EVENTS, _event_runs

EDGES = Filters(ave_g=15, ave_G=15, ave_I=5, ave_dangle=0.8, ave_slice_m=5, ave_slice_d=1)
GRAPH = Filters(ave_g=15, ave_node=5.0, ave_cent=8.0, ave_cent_d=2000.0, max_dist=6)
#: Groups of centroids that haven't ended by then are marked.
CENTROID_ROUNDS = 6
#: Connectivity sums links; a merge must be worth more than the mean of them.
SEGMENTS = Filters(ave_g=15, ave_node=20.0, max_dist=6)


def _edge_pixels(spark, sf):
    labelled, sums = _blobs(spark, sf)
    return slices.edge_pixels(labelled, sums, EDGES)


def _slices(spark, sf):
    return Scratch(spark, "slices").save(slices.slice_edges(_edge_pixels(spark, sf), EDGES), "slices")


def _slice_links(spark, sf):
    found = _slices(spark, sf)
    return found, Scratch(spark, "slices").save(slices.compare_slices(found, EDGES), "links")


def _rounded(df, keep):
    """Doubles to six digits, so that the order of sums doesn't show."""
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema if f.dataType.simpleString() == "double" and f.name not in keep})


def edge_maxima(spark, sf):
    return slices.edge_maxima(_edge_pixels(spark, sf))


def edge_slices(spark, sf):
    return _slices(spark, sf).where("kind = 'slice'").drop("kind", "other")


def slice_links(spark, sf):
    return _slice_links(spark, sf)[1]


def slice_link_pairs(spark, sf):
    return slices.compare_links(_slice_links(spark, sf)[1], EDGES)


def pp_clusters(spark, sf):
    found, links = _slice_links(spark, sf)
    clusters = Scratch(spark, "slices").save(slices.slice_clusters(spark, links, EDGES), "clusters")
    return slices.cluster_sums(clusters, found, links)


def interpolated_points(spark, sf):
    pixels = _edge_pixels(spark, sf)
    points = pixels.select("frame_id", "blob_id", (F.col("y") + 0.25).alias("py"), (F.col("x") + 0.5).alias("px"))
    return slices.interpolate(points, pixels).select("frame_id", "blob_id", "py", "px", F.round(F.col("i") * 1000).cast("long").alias("i"))


def segment_slices(spark, sf):
    return slices.segment_slices(blobs.row_segments(_derts(spark, sf)))


def segment_chains(spark, sf):
    return slices.same_sign_chains(spark, slices.segment_slices(blobs.row_segments(_derts(spark, sf))))


def segment_dx(spark, sf):
    return slices.inner_dx(_derts(spark, sf))


def _nodes(spark, sf):
    return graph.nodes_from_blobs(_blobs(spark, sf)[1], GRAPH.ave_g)


def _graph(spark, sf):
    scratch = Scratch(spark, "graph")
    nodes = scratch.save(_nodes(spark, sf), "nodes")
    return nodes, scratch.save(graph.compare_nodes(graph.range_pairs(nodes, GRAPH.max_dist), nodes), "links")


def _thousandths(df):
    """Doubles to three digits (no -0.0), so that engines agree on them.

    Thousandths are rounded whole: Spark's round to three digits looks at the shortest decimal (-2113485.2375 goes down), other engines at the product.
    """
    return df.withColumns({f.name: F.round(F.col(f.name) * 1000) / 1000 + 0.0 for f in df.schema if f.dataType.simpleString() == "double"})


def pair_range(spark, sf):
    pairs = graph.range_pairs(_nodes(spark, sf), GRAPH.max_dist)
    return pairs.select("group", "a", "b", F.round(F.col("dist") * 1000).cast("long").alias("dist"))


def pair_range_links(spark, sf):
    return _thousandths(_graph(spark, sf)[1]).drop("dist", "r")


def link_rims(spark, sf):
    return _thousandths(graph.rim_sums(_graph(spark, sf)[1]))


def node_connectivity(spark, sf):
    found = density.connectivity(_graph(spark, sf)[1], GRAPH, GRAPH.ave_node)
    return found.withColumns({c: F.round(c, 4) + 0.0 for c in "vw"})


def node_convolution(spark, sf):
    found = density.convolved(_graph(spark, sf)[1], 3, GRAPH)
    return found.withColumn("v", F.round("v", 4) + 0.0)


def graph_segments(spark, sf):
    links = _graph(spark, sf)[1]
    nodes = Scratch(spark, "segments").save(density.connectivity(links, SEGMENTS), "nodes")
    return density.segmented(spark, links, nodes, SEGMENTS)


def link_decay(spark, sf):
    return graph.match_decay(_graph(spark, sf)[1])


def link_gates(spark, sf):
    links = _graph(spark, sf)[1]
    return links.select("group", "a", "b", graph.progressive_gate(F.col("m"), [20, 1.5, 1.2]).alias("gates"))


def link_derivatives(spark, sf):
    return graph.compare_derivatives(_graph(spark, sf)[1])


def link_errors(spark, sf):
    return graph.prediction_error(_graph(spark, sf)[1])


def link_weights(spark, sf):
    return graph.feature_weights(_graph(spark, sf)[1])


def link_sums(spark, sf):
    return _thousandths(graph.weighted_sums(_graph(spark, sf)[1]))


def link_bands(spark, sf):
    return graph.distance_bands(_graph(spark, sf)[1], 2.0).select("group", "band", "n")


def link_gaps(spark, sf):
    return graph.distance_gaps(_graph(spark, sf)[1], 0.05)


def link_sectors(spark, sf):
    return graph.nearest_by_direction(*_graph(spark, sf))


def node_maxima(spark, sf):
    return graph.local_maxima(*_graph(spark, sf))


def node_cosines(spark, sf):
    return graph.cosine_to_mean(_nodes(spark, sf))


def node_projection(spark, sf):
    nodes, links = _graph(spark, sf)
    return graph.project_node(nodes, links, 5.0, (0.0, 1.0), GRAPH.decay)


def node_aggregate(spark, sf):
    nodes = _nodes(spark, sf).withColumn("root", F.floor(F.col("node_id") / 1024) * 1024)
    out = graph.aggregate_nodes(nodes.drop("root"), nodes.select("node_id", "root"))
    return out.select("group", "root", "n_members", "C", *(F.round(c, 4).alias(c) for c in ("M", "I", "G", "cy", "cx", "span")))


def exemplars(spark, sf):
    nodes, links = _graph(spark, sf)
    return graph.exemplars(nodes, links, GRAPH)


def conn_clusters(spark, sf):
    nodes, links = _graph(spark, sf)
    return graph.connectivity_clusters(spark, nodes, links, GRAPH)


def merged_nodes(spark, sf):
    nodes, links = _graph(spark, sf)
    return graph.merge_matches(spark, nodes, links, 40.0)


def _centroids(spark, sf):
    nodes, links = _graph(spark, sf)
    found = graph.centroids(spark, nodes, graph.exemplars(nodes, links, GRAPH), links, GRAPH, last=CENTROID_ROUNDS)
    return nodes, links, Scratch(spark, "centroids").save(found, "found")


def centroids(spark, sf):
    return _thousandths(_centroids(spark, sf)[2])


def fuzzy_centroids(spark, sf):
    nodes, links, found = _centroids(spark, sf)
    return _thousandths(graph.fuzzy_centroids(spark, nodes, found, links, GRAPH, last=CENTROID_ROUNDS))


def node_levels(spark, sf):
    return graph.node_levels(spark, _nodes(spark, sf), GRAPH)


def _tiles(spark, sf):
    tile = lambda c: F.floor(F.col(c) / 8).cast("int")
    return _derts(spark, sf).groupBy(F.col("frame_id").alias("group"), tile("y").alias("ty"), tile("x").alias("tx")).agg(F.sum(F.col("g") - stencil.DEFAULT.ave_g / 2).alias("v"))


def focus_map(spark, sf):
    return graph.focus_map(_tiles(spark, sf), 0.5, 2).withColumn("focus", F.round(F.col("focus") * 100).cast("long"))


def frame_expansion(spark, sf):
    return graph.expand_frame(spark, _tiles(spark, sf), (3, 3), 0.0)


def operator_metrics(spark, sf):
    return graph.operator_metrics(_graph(spark, sf)[1], 30.0)


def drift_segments(spark, sf):
    levels = _tiles(spark, sf).groupBy("group", F.col("ty").cast("long").alias("level")).agg(F.count("*").cast("double").alias("c"), F.round(F.sum("v"), 3).alias("v"))
    return graph.drift_segments(levels, 4.0)


def l3_levels(spark, sf):
    return hierarchy.sequence_levels(spark, _event_runs(spark, sf), Filters(ave=35, pp_M=1, ave_params=(0.5, -60, -60, -60)))


def l2_spliced_runs(spark, sf):
    runs = _event_runs(spark, sf)
    low = Filters(ave=35, ave_splice=0.5)
    return hierarchy.splice_runs(runs, params.cross_compare(runs, low, defining_step1=True), low)


def l2_derivations(spark, sf):
    return hierarchy.derivation_of_comparisons(params.cross_compare(_event_runs(spark, sf), EVENTS), EVENTS)


def _clusters(spark, sf):
    nodes, links = _graph(spark, sf)
    members = graph.connectivity_clusters(spark, nodes, links, GRAPH)
    return nodes, links, Scratch(spark, "clusters").save(members, "members")


def cluster_forks(spark, sf):
    _, links, members = _clusters(spark, sf)
    return hierarchy.fork_sums(links, members)


def combined_forks(spark, sf):
    _, links, members = _clusters(spark, sf)
    return hierarchy.combined_forks(hierarchy.fork_sums(links, members))


def traced_edges(spark, sf):
    nodes, links, members = _clusters(spark, sf)
    return hierarchy.trace_edges(spark, nodes, links, members, 20.0)


def _level_values(spark, sf):
    return _tiles(spark, sf).groupBy("group", F.col("ty").cast("long").alias("level")).agg(F.count("*").alias("c"), F.round(F.sum("v"), 3).alias("m"), F.round(F.max("v"), 3).alias("d"))


def level_order(spark, sf):
    return hierarchy.level_order(_level_values(spark, sf))


def compared_hierarchies(spark, sf):
    return hierarchy.compare_hierarchies(_level_values(spark, sf))


def weighted_overlap(spark, sf):
    """Suppliers as sets of the parts they ship, a line item a unit of weight."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    sets = items.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("member"), F.lit(1).alias("w"))
    return hierarchy.weighted_overlap(sets).select("a", "b", F.col("shared").cast("long").alias("shared"), F.round("overlap", 6).alias("overlap"))


QUERIES = {
    f.__name__: f
    for f in (
        edge_maxima, edge_slices, slice_links, slice_link_pairs, pp_clusters, interpolated_points, segment_slices, segment_chains, segment_dx,
        pair_range, pair_range_links, link_rims, node_connectivity, node_convolution, graph_segments, link_decay, link_gates, link_derivatives, link_errors, link_weights, link_sums, link_bands, link_gaps, link_sectors,
        node_maxima, node_cosines, node_projection, node_aggregate, exemplars, conn_clusters, merged_nodes, centroids, fuzzy_centroids, node_levels,
        focus_map, frame_expansion, operator_metrics, drift_segments, l3_levels, l2_spliced_runs, l2_derivations, cluster_forks, combined_forks, traced_edges,
        level_order, compared_hierarchies, weighted_overlap,
    )
}

_EDGE = f"""{_SUMS},
ep AS (SELECT lab.frame_id, lab.y, lab.x, lab.blob_id, lab.i, lab.dy4, lab.dx4, lab.dy4 * lab.dy4 + lab.dx4 * lab.dx4 AS q FROM lab JOIN blob b USING (frame_id, blob_id) WHERE NOT b.s AND b.G1000 > 1000 * {EDGES.ave_G} * b.area),
st AS (SELECT *, round_even(dy4 / greatest(sqrt(q::DOUBLE), 1e-7::DOUBLE), 0)::INT AS sy, round_even(dx4 / greatest(sqrt(q::DOUBLE), 1e-7::DOUBLE), 0)::INT AS sx FROM ep)"""
_NODE = f"""{_SUMS},
node AS (SELECT frame_id AS "group", frame_id * 8589934592 + blob_id // 2147483648 * 65536 + blob_id % 2147483648 AS node_id, Y / area AS y, X / area AS x, area::DOUBLE AS c, sqrt(area::DOUBLE) AS span, area::DOUBLE AS n,
  ({1000 * GRAPH.ave_g} * area - G1000)::DOUBLE AS M, G1000::DOUBLE AS D, I::DOUBLE AS I, G1000::DOUBLE AS G, Dy4::DOUBLE AS dy, Dx4::DOUBLE AS dx FROM blob),
pair AS (
  SELECT p."group", p.node_id AS a, q.node_id AS b, sqrt((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x)) AS dist FROM node p JOIN node q ON p."group" = q."group" AND p.node_id < q.node_id
  WHERE (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) < {GRAPH.max_dist**2})"""


def _signed(a: str, b: str) -> str:
    return f"CASE WHEN ({a} < 0) <> ({b} < 0) THEN -least(abs({a}), abs({b})) ELSE least(abs({a}), abs({b})) END"


_TURN = "(atan2(p.dy, p.dx) - atan2(q.dy, q.dx))"


def _terms() -> dict[str, tuple[str, str]]:
    """Match and difference of each of the nine parameters."""
    out = {}
    for k, name, scaled in (("M", "M", 1), ("D", "D", 1), ("C", "c", 0), ("I", "I", 1), ("G", "G", 1), ("L", "n", 1), ("S", "span", 0)):
        a, b = (f"p.{name} * (q.c / p.c)" if scaled else f"p.{name}"), f"q.{name}"
        out[k] = f"{float(graph.WEIGHT[k])}::DOUBLE - abs({a} - {b})" if k in ("I", "S") else _signed(a, b), f"{a} - {b}"
    out["A"] = f"(cos(atan2(sin({_TURN}), cos({_TURN}))) + 1) / 2", f"atan2(sin({_TURN}), cos({_TURN})) / pi()"
    return {k: out.get(k, ("0.0::DOUBLE", "0.0::DOUBLE")) for k in graph.PARAMS}


def _value(m: str = "m_{}", d: str = "d_{}") -> str:
    """Columns m and d of a link out of its nine matches and differences."""
    part = lambda k: f"{m.format(k)} + abs({d.format(k)})"
    match = " + ".join(f"{float(graph.WEIGHT[k])}::DOUBLE * {m.format(k)} / CASE WHEN {part(k)} = 0 THEN 1e-7::DOUBLE ELSE {part(k)} END" for k in graph.PARAMS)
    return f"{match} AS m, ({' + '.join(f'{float(graph.WEIGHT[k])}::DOUBLE * abs({d.format(k)})' for k in graph.PARAMS)}) * ({match}) / 2 AS d"


_LINK = f"""{_NODE},
l0 AS (SELECT pair."group", a, b, dist, least(p.c, q.c) AS c, 1.0::DOUBLE AS r, {", ".join(f"{m} AS m_{k}, {d} AS d_{k}" for k, (m, d) in _terms().items())} FROM pair JOIN node p ON p.node_id = a JOIN node q ON q.node_id = b),
link AS (SELECT *, {_value()} FROM l0),
en0 AS (SELECT "group", a AS node_id, b AS other, m, d, c, r, dist FROM link UNION ALL SELECT "group", b, a, m, d, c, r, dist FROM link),
en AS (SELECT "group", node_id, other, m, r, pow({GRAPH.decay}::DOUBLE, dist) AS w FROM en0 WHERE m > {GRAPH.ave_node}::DOUBLE * r)"""
_SETTLED = "{}::DOUBLE * greatest(abs({}), 1.0::DOUBLE)"
_CONNECTIVITY = f"""{_LINK},
st(k, "group", node_id, n, v, w, tv, tw, live) AS (
  SELECT 0, "group", node_id, count(*), sum(m), sum(r), 0.0::DOUBLE, 0.0::DOUBLE, true FROM en GROUP BY "group", node_id
  UNION ALL
  SELECT k + 1, "group", node_id, n, (v + gv / n) / 2, (w + gw / n) / 2, nv, nw, abs(nv - tv) > {GRAPH.ave_node}::DOUBLE * nn AND abs(nv - tv) > {_SETTLED.format(density.SETTLED, "tv")}
  FROM (
    SELECT *, sum(gv) OVER (PARTITION BY "group") AS nv, sum(gw) OVER (PARTITION BY "group") AS nw, count(*) OVER (PARTITION BY "group") AS nn FROM (
      SELECT c.k, c."group", c.node_id, c.n, c.v, c.w, c.tv, c.tw, sum(o.v * e.w) AS gv, sum(o.w * e.w) AS gw
      FROM st c JOIN en e ON e."group" = c."group" AND e.node_id = c.node_id JOIN st o ON o."group" = e."group" AND o.node_id = e.other WHERE c.live GROUP BY ALL)))"""


def _convolution(layers: int) -> str:
    """The rounds of density.convolved: kernels of all layers forward, then scaled from the top down."""
    kernels = ['n0 AS (SELECT k, "group", node_id, v, v AS k0 FROM st WHERE live)']
    for x in range(1, layers + 1):
        kernels.append(f"""n{x} AS (SELECT c.*, (c.k{x - 1} + s) / (1.0::DOUBLE + p) AS k{x} FROM n{x - 1} c JOIN (
        SELECT e."group", e.node_id, sum(o.k{x - 1} * e.w) AS s, sum(e.w) AS p FROM en e JOIN n{x - 1} o ON o."group" = e."group" AND o.node_id = e.other GROUP BY ALL) t USING ("group", node_id))""")
    scaled = f"k{layers}"
    for x in reversed(range(layers)):
        kernels.append(f"""s{x} AS (SELECT * REPLACE (k{x} * (1.0::DOUBLE + {density.RIM_COEF}::DOUBLE * (CASE WHEN greatest(k{x}, {scaled}) > 0 THEN least(k{x}, {scaled}) / greatest(k{x}, {scaled}) ELSE 1.0::DOUBLE END - 1.0::DOUBLE)) AS k{x}) FROM {f's{x + 1}' if x + 1 < layers else f'n{layers}'})""")
        scaled = f"k{x}"
    return f"""{_LINK},
st(k, "group", node_id, v, live) AS (
  SELECT 0, "group", node_id, sum(m), true FROM en GROUP BY "group", node_id
  UNION ALL (
  WITH {", ".join(kernels)}
  SELECT k + 1, "group", node_id, k0, sum(v) OVER g - sum(k0) OVER g > {GRAPH.ave_node}::DOUBLE * count(*) OVER g AND abs(sum(v) OVER g - sum(k0) OVER g) > {_SETTLED.format(density.SETTLED, "sum(v) OVER g")}
  FROM s0 WINDOW g AS (PARTITION BY "group")))"""


ORACLES = {
    "edge_maxima": f"""{_EDGE} SELECT e.frame_id, e.y, e.x, e.blob_id, e.dy4, e.dx4 FROM st e WHERE NOT EXISTS (
  SELECT 1 FROM st o WHERE o.frame_id = e.frame_id AND o.blob_id = e.blob_id AND o.q > e.q AND ((o.y = e.y + e.sy AND o.x = e.x + e.sx) OR (o.y = e.y - e.sy AND o.x = e.x - e.sx)))""",
    "pair_range": f"""{_NODE} SELECT "group", a, b, round(dist * 1000)::BIGINT AS dist FROM pair""",
    "pair_range_links": f"""{_LINK} SELECT "group", a, b, c, {", ".join(f"round({x}_{k}, 3) + 0.0 AS {x}_{k}" for x in "md" for k in graph.PARAMS)}, round(m, 3) + 0.0 AS m, round(d, 3) + 0.0 AS d FROM link""",
    "link_rims": f"""{_LINK} SELECT "group", node_id, count(*) AS n_links, round(sum(m * c) / sum(c), 3) + 0.0 AS rim_m, sum(c) AS rim_c, round(sum(CASE WHEN m > 0 THEN m ELSE 0 END), 3) + 0.0 AS M, round(sum(CASE WHEN m <= 0 AND d > 0 THEN d ELSE 0 END), 3) + 0.0 AS D FROM en0 GROUP BY "group", node_id""",
    "link_gates": f"""{_LINK} SELECT "group", a, b, (CASE WHEN m > 20 THEN CASE WHEN m > 30 THEN CASE WHEN m > 36 THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END)::INT AS gates FROM link""",
    "link_sums": f"""{_LINK},
s AS (SELECT "group", sum(c) AS c, {", ".join(f"sum({x}_{k} * c) / sum(c) AS {x}_{k}" for x in "md" for k in graph.PARAMS)} FROM link GROUP BY "group"),
v AS (SELECT *, {_value()} FROM s)
SELECT "group", c, {", ".join(f"round({x}_{k}, 3) + 0.0 AS {x}_{k}" for x in "md" for k in graph.PARAMS)}, round(m, 3) + 0.0 AS m, round(d, 3) + 0.0 AS d FROM v""",
    "node_connectivity": f"""{_CONNECTIVITY} SELECT "group", node_id, n, round(v, 4) + 0.0 AS v, round(w, 4) + 0.0 AS w, k::INT AS round FROM st WHERE NOT live""",
    "node_convolution": f"""{_convolution(3)} SELECT "group", node_id, round(v, 4) + 0.0 AS v, k::INT AS round FROM st WHERE NOT live""",
    "link_bands": f"""{_NODE} SELECT "group", floor(dist / 2.0::DOUBLE)::BIGINT AS band, count(*) AS n FROM pair GROUP BY ALL""",
    "node_aggregate": f"""{_NODE},
own AS (SELECT *, node_id // 1024 * 1024 AS root FROM node),
a AS (SELECT "group", root, count(*) AS n_members, sum(c) AS C, sum(M * c) / sum(c) AS M, sum(I * c) / sum(c) AS I, sum(G * c) / sum(c) AS G, sum(y * c) / sum(c) AS cy, sum(x * c) / sum(c) AS cx, max(span) AS own_span FROM own GROUP BY ALL),
s AS (SELECT o."group", o.root, sum(sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) * o.c) / sum(o.c) AS span FROM own o JOIN a USING ("group", root) GROUP BY ALL)
SELECT "group", root, n_members, C, round(M, 4) AS M, round(I, 4) AS I, round(G, 4) AS G, round(cy, 4) AS cy, round(cx, 4) AS cx, round(CASE WHEN n_members = 1 THEN own_span ELSE span END, 4) AS span FROM a JOIN s USING ("group", root)""",
    "weighted_overlap": """WITH s AS (SELECT l_suppkey AS set_id, l_partkey AS member, count(*) AS w FROM lineitem GROUP BY ALL),
t AS (SELECT set_id, sum(w) AS t FROM s GROUP BY set_id),
p AS (SELECT x.set_id AS a, y.set_id AS b, sum(x.w) AS shared FROM s x JOIN s y ON x.member = y.member AND x.set_id < y.set_id GROUP BY ALL)
SELECT a, b, shared::BIGINT AS shared, round(shared / CASE WHEN ta.t + tb.t - 2 * shared = 0 THEN 1e-7::DOUBLE ELSE ta.t + tb.t - 2 * shared END, 6) AS overlap
FROM p JOIN t ta ON ta.set_id = a JOIN t tb ON tb.set_id = b""",
    "segment_slices": f"""{_SEG} SELECT b.frame_id, b.y, a.lo AS a_lo, b.lo, b.n - a.n AS dL, least(b.n, a.n) AS mL, b.I - a.I AS dI, least(b.I, a.I) AS mI, abs((b.lo + b.hi) - (a.lo + a.hi))::BIGINT AS shift2
FROM seg a JOIN seg b ON a.frame_id = b.frame_id AND b.y = a.y + 1 AND a.s = b.s AND a.lo <= b.hi + 1 AND b.lo <= a.hi + 1""",
    "segment_dx": f"""{_SEG}, pr AS (SELECT *, lag(dx4) OVER (PARTITION BY frame_id, y, seg ORDER BY x) AS prior FROM sn)
SELECT frame_id, y, seg::BIGINT AS seg, coalesce(sum(dx4 - prior), 0)::BIGINT AS Ddx4, coalesce(sum(CASE WHEN prior IS NULL THEN NULL WHEN (prior < 0) <> (dx4 < 0) THEN -least(abs(prior), abs(dx4)) ELSE least(abs(prior), abs(dx4)) END), 0)::BIGINT AS Mdx4
FROM pr GROUP BY ALL""",
    "interpolated_points": f"""{_EDGE}, pt AS (SELECT DISTINCT frame_id, blob_id, y + 0.25::DOUBLE AS py, x + 0.5::DOUBLE AS px FROM ep),
c AS (SELECT pt.*, e.i, (1 - abs(e.y - py)) * (1 - abs(e.x - px)) AS k FROM pt JOIN ep e ON e.frame_id = pt.frame_id AND e.blob_id = pt.blob_id AND e.y BETWEEN floor(py) AND floor(py) + 1 AND e.x BETWEEN floor(px) AND floor(px) + 1)
SELECT frame_id, blob_id, py, px, round(sum(i * k) / sum(k) * 1000)::BIGINT AS i FROM c GROUP BY ALL""",
    "focus_map": f"""WITH {_DERT}, t AS (SELECT frame_id AS "group", y // 8 AS ty, x // 8 AS tx, sum(g - {stencil.DEFAULT.ave_g / 2}) AS v FROM dert GROUP BY ALL)
SELECT "group", (ty + oy)::INT AS ty, (tx + ox)::INT AS tx, round(sum(v * power(0.5::DOUBLE, greatest(abs(oy), abs(ox)))) * 100)::BIGINT AS focus FROM t, range(-2, 3) AS a(oy), range(-2, 3) AS b(ox) WHERE oy <> 0 OR ox <> 0 GROUP BY ALL""",
    "link_gaps": f"""{_NODE}, o AS (SELECT *, coalesce(dist - lag(dist) OVER w > 0.05::DOUBLE, true)::INT AS c FROM pair WINDOW w AS (PARTITION BY "group" ORDER BY dist, a, b)),
s AS (SELECT *, sum(c) OVER (PARTITION BY "group" ORDER BY dist, a, b) - 1 AS seg FROM o)
SELECT "group", seg::BIGINT AS seg, count(*) AS n, min(dist) AS lo, max(dist) AS hi FROM s GROUP BY ALL""",
    "node_maxima": f"""{_NODE}, en AS (SELECT "group", a AS node_id, b AS other FROM pair UNION ALL SELECT "group", b, a FROM pair)
SELECT e."group", e.node_id, count(*) AS n FROM en e JOIN node p ON p.node_id = e.node_id JOIN node q ON q.node_id = e.other GROUP BY ALL HAVING max(q.M) <= any_value(p.M)""",
    "link_sectors": f"""{_NODE}, en AS (SELECT "group", a AS node_id, b AS other, dist FROM pair UNION ALL SELECT "group", b, a, dist FROM pair),
s AS (SELECT e.*, ((floor(atan2(q.y - p.y, q.x - p.x) / (2 * pi() / 8))::INT % 8) + 8) % 8 AS sector FROM en e JOIN node p ON p.node_id = e.node_id JOIN node q ON q.node_id = e.other)
SELECT "group", node_id, sector, other, dist FROM s QUALIFY row_number() OVER (PARTITION BY "group", node_id, sector ORDER BY dist, other) = 1""",
}
