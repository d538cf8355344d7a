import math
import random
import struct
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from gradus.filters import Filters
from gradus.operators import blobs, graph, slices, stencil
from gradus.operators.components import connected_components
from gradus.sources.tables import images

#: Fixed images of known gradients.
VERTICAL = [[0, 50, 100, 150, 200]] * 5
HORIZONTAL = [[v] * 5 for v in (200, 150, 100, 50, 0)]
SMILEY = [[255 if c == "#" else 0 for c in row] for row in (
    "##......##", "#.######.#", ".########.", ".#..##..#.", ".#..##..#.", ".########.", ".#.####.#.", ".##....##.", "#.######.#", "##......##",
)]


def frame(spark, image, frame_id=0):
    rows = [(frame_id, y, x, v) for y, row in enumerate(image) for x, v in enumerate(row) if v is not None]
    return spark.createDataFrame(rows, "frame_id long, y int, x int, i long")


def signs(spark, text):
    rows = [(0, y, x, 1, c == "+") for y, row in enumerate(text) for x, c in enumerate(row) if c != " "]
    return spark.createDataFrame(rows, "frame_id long, y int, x int, i long, s boolean")


def test_known_gradients(spark):
    for image, p, dy, dx in ((VERTICAL, {25, 75, 125}, 0, 50), (HORIZONTAL, {175, 125, 75}, -50, 0)):
        got = stencil.ternary(frame(spark, image)).collect()
        assert len(got) == 9 and {r.p for r in got} == p
        assert {(r.g, r.dy, r.dx, r.g3, r.dy3, r.dx3) for r in got} == {(50, dy, dx, 50, dy, dx)}
        full = stencil.gradient_3x3(frame(spark, image)).collect()
        assert {(r.dy4, r.dx4) for r in full} == {(8 * dy, 8 * dx)}  # twice the ternary's, times four
    got = {(r.y, r.x): r for r in stencil.ternary(frame(spark, SMILEY)).collect()}
    first, second = got[0, 0], got[0, 1]
    assert (first.p, round(first.g, 4), first.dy, first.dx) == (191.25, 180.3122, -127.5, -127.5)
    assert (second.p3, round(second.g3, 4), second.dy3, second.dx3) == (255, 100.7976, 95.625, 31.875)


def test_holes_and_small_grids(spark):
    assert stencil.gradient_3x3(frame(spark, [[1, 2, 3, 4]])).count() == 0
    assert stencil.gradient_3x3(frame(spark, [[1], [2], [3], [4]])).count() == 0
    image = [[1] * 5 for _ in range(5)]
    image[2][2] = None
    assert stencil.gradient_3x3(frame(spark, image)).count() == 0


def test_angle_differences(spark):
    rows = [(0, 0, 0, 1.0, 0.0), (0, 0, 1, 1.0, 0.0), (0, 1, 0, 0.0, 1.0), (0, 1, 1, -1.0, 0.0)]
    got = stencil.angle_compare(spark.createDataFrame(rows, "frame_id long, y int, x int, dy double, dx double")).first()
    assert math.isclose(got.ma, 0 + 1 - 1 + 1, abs_tol=1e-12) and math.isclose(got.da_cos, -1, abs_tol=1e-12)


@pytest.mark.parametrize("text, n", [
    (["+-", "-+"], 3),  # diagonal + join, diagonal - don't
    (["+++++", "+---+", "+-+-+", "+---+", "+++++"], 3),
    (["+-+-", "-+-+"], 5),
    (["+"], 1),
    (["+ +"], 2),
    (["---"], 1),
])
def test_labels_by_both_strategies(spark, text, n):
    derts = signs(spark, text)
    a = {(r.y, r.x): r.blob_id for r in blobs.label_by_frame(derts).collect()}
    b = {(r.y, r.x): r.blob_id for r in blobs.label_by_segments(spark, derts).collect()}
    assert a == b and len(set(a.values())) == n
    assert all(label == min(y * blobs.STRIDE + x for (y, x), other in a.items() if other == label) for label in a.values())


def test_adjacency_is_symmetric_and_of_opposite_signs(spark):
    rng = random.Random(5)
    labelled = blobs.label_by_frame(signs(spark, ["".join(rng.choice("+-") for _ in range(12)) for _ in range(12)])).cache()
    pairs = {(r.a, r.b) for r in blobs.adjacency(labelled).collect()}
    sign = {r.blob_id: r.s for r in labelled.collect()}
    assert pairs and all((b, a) in pairs and sign[a] != sign[b] for a, b in pairs)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components_by_both_ways(spark, limit):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = connected_components(spark, spark.createDataFrame(edges, "a long, b long").repartition(5), one_task_edges=limit)
    assert {r.node: r.component for r in found.collect()} == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_range_pairs_need_no_nested_loop(spark):
    rng = random.Random(2)
    rows = [(k % 2, k, rng.random() * 30, rng.random() * 30, 1.0) for k in range(150)]
    nodes = spark.createDataFrame(rows, "group long, node_id long, y double, x double, c double")
    pairs = graph.range_pairs(nodes, 4.0)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) < 4}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def some_edge(seed, size=14):
    """A smooth random field with gaps, as one edge's pixels."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size]
    a, b, c = rng.uniform(0.2, 0.7, 3)
    dy, dx = 60 * np.cos(a * y + b * x) + 5 * rng.normal(size=y.shape), 60 * np.sin(c * y - a * x) + 5 * rng.normal(size=y.shape)
    held = rng.random(y.shape) < 0.9
    columns = {"frame_id": 3, "blob_id": 7, "y": y[held], "x": x[held] + 70000, "i": rng.integers(20, 90, held.sum()), "dy4": 4 * dy[held], "dx4": 4 * dx[held]}
    return pd.DataFrame(columns).assign(g=np.hypot(dy, dx)[held]).sample(frac=1, random_state=seed)


SLICES = Filters(ave_I=5, ave_G=5, ave_dangle=0.7)


@pytest.mark.parametrize("seed", range(6))
def test_slices_give_way_to_stronger_ones_only(seed):
    edge = slices._Edge(some_edge(seed), SLICES)
    seeds = edge.maxima()
    strength = edge.values[seeds, 1]
    assert len(seeds) > 4 and (strength[1:] <= strength[:-1]).all()
    free, (kept, owner) = edge.walks(seeds), edge.grown(seeds)
    free, kept = pd.DataFrame(free), pd.DataFrame(kept)
    holder = dict(zip(kept.pixel, kept.walk))
    assert len(holder) == len(kept) < len(free)  # a pixel has one walk, and some walks were cut
    assert {p: w // 2 for p, w in holder.items()} == {p: o for p, o in enumerate(owner) if o >= 0}
    alive = set(kept.walk[kept.k == 0] // 2)
    for k, place in enumerate(seeds):
        assert (k in alive) == (holder[place] // 2 == k) and holder[place] // 2 <= k
    for walk, steps in free.groupby("walk"):
        own = kept[kept.walk == walk]
        assert own.k.tolist() == steps.k.tolist()[: len(own)]
        if walk // 2 in alive and len(own) < len(steps):
            assert holder[steps.pixel.iloc[len(own)]] < walk


@pytest.mark.parametrize("seed", range(3))
def test_slices_meet_where_their_growth_does(seed):
    edge = slices._Edge(some_edge(seed), SLICES)
    owner = edge.grown(edge.maxima())[1]
    at = {(y, x): k for k, (y, x) in enumerate(zip(edge.y, edge.x))}
    near = lambda k: [at[n] for n in ((edge.y[k] + dy, edge.x[k] + dx) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))) if n in at]
    reach = [{k: 0 for k in np.flatnonzero(owner >= 0)}]
    final = {k: int(owner[k]) for k in reach[0]}
    while True:  # one whole ring after another
        ring = {n: min(final[m] for m in near(n) if m in final) for k in final for n in near(k) if n not in final}
        if not ring:
            break
        final.update(ring)
    want = {tuple(sorted((final[k], final[n]))) for k in final for n in near(k) if final[n] != final[k]}
    assert {tuple(p) for p in edge.met(owner).tolist()} == want and want


def test_crossing_links_go():
    row = lambda y, x, *ends: dict(zip(("y", "x", "ey0", "ex0", "ey1", "ex1"), (y, x, *ends)))
    # 1 lies between 0 and 2: the link 0-2 passes over it, its own don't pass over anything
    found = pd.DataFrame([row(0.0, 0.0, 0, -2, 0, 2), row(2.0, 0.0, 2, -2, 2, 2), row(4.0, 0.0, 4, -2, 4, 2)])
    kept = lambda found, *pairs: slices.uncrossed({c: found[c].to_numpy() for c in found}, np.array(pairs).reshape(-1, 2)).tolist()
    assert kept(found, (0, 1), (0, 2), (1, 2)) == [[0, 1], [1, 2]]
    # side by side nothing crosses, and no links are fine
    beside = pd.DataFrame([row(0.0, 3.0 * k, -1, 3 * k, 1, 3 * k) for k in range(3)])
    assert kept(beside, (0, 1), (1, 2)) == [[0, 1], [1, 2]] and kept(beside) == []


@pytest.mark.parametrize("seed", range(4))
def test_crossing_links_by_each_pair(seed):
    rng = np.random.default_rng(seed)
    n = 9
    found = {c: rng.uniform(0, 10, n) for c in ("y", "x", "ey0", "ex0", "ey1", "ex1")}
    pairs = np.array([p for p in combinations(range(n), 2) if rng.random() < 0.5])
    gone = set()
    for k in range(n):
        for p, q in combinations([pair for pair in map(tuple, pairs.tolist()) if k in pair], 2):
            a, b = sum(p) - k, sum(q) - k
            at = lambda s: (found["y"][s], found["x"][s])
            reach = lambda s: ((found["ey0"][s], found["ex0"][s]), (found["ey1"][s], found["ex1"][s]))
            over = {p: slices.crossed(at(a), at(k), *reach(b)), q: slices.crossed(at(b), at(k), *reach(a))}
            if over[p] and over[q]:
                gone.add(max((math.dist(at(a), at(k)), a, p), (math.dist(at(b), at(k)), b, q))[2])
            else:
                gone |= {link for link, yes in over.items() if yes}
    assert slices.uncrossed(found, pairs).tolist() == [list(p) for p in map(tuple, pairs.tolist()) if p not in gone] and gone


def test_places_beyond_16_bits_and_hashed_frames(spark):
    far = 7806203349216723968
    rows = [(f, y, x, 1, s) for f in (far, -far) for y, x, s in ((0, 65536, True), (1, 0, True), (1, 65536, True), (70000, 3, False))]
    derts = spark.createDataFrame(rows, "frame_id long, y int, x int, i long, s boolean")
    got = blobs.label_by_segments(spark, derts).collect()
    assert len(got) == 8 and {(r.frame_id, r.blob_id) for r in got} == {(f, b) for f in (far, -far) for b in (65536, blobs.STRIDE, 70000 * blobs.STRIDE + 3)}


def test_crossed_segments():
    assert slices.crossed((0, 0), (2, 2), (0, 2), (2, 0)) and not slices.crossed((0, 0), (1, 0), (0, 2), (1, 2))
    assert slices.crossed((0, 0), (0, 2), (0, 1), (2, 1))  # touching counts


def test_slices_of_a_ramp(spark):
    image = [[min(200, max(0, 25 * (x - 4))) for x in range(16)] for _ in range(10)]
    derts = stencil.gradient_3x3(frame(spark, image), Filters(ave_g=15))
    labelled = blobs.label_by_frame(derts).cache()
    found = slices.slice_edges(slices.edge_pixels(labelled, blobs.blob_sums(labelled), Filters(ave_g=15, ave_G=10)), Filters(ave_I=0, ave_G=0)).collect()
    own = [r for r in found if r.kind == "slice"]
    assert len(own) == 8 and all(r.L >= 6 for r in own)  # one slice a row, across the ramp
    assert len([r for r in found if r.kind == "link"]) == 7


def test_images_to_blobs_and_nodes(spark, tmp_path):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    for name, shade in (("a", 200), ("b", 90)):
        rows = [[shade if 3 <= x < 7 and 2 <= y < 6 else 10 for x in range(11)] for y in range(8)]
        body = zlib.compress(b"".join(b"\0" + bytes(v for p in row for v in (p, p, p)) for row in rows))
        head = chunk(b"IHDR", struct.pack(">IIBBBBB", 11, 8, 8, 2, 0, 0, 0))
        (tmp_path / f"{name}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", body) + chunk(b"IEND", b""))
    pixels = images(spark, str(tmp_path)).cache()
    assert pixels.count() == 176 and {(r.y, r.x, r.i) for r in pixels.where("i = 200").collect()} == {(y, x, 200.0) for y in range(2, 6) for x in range(3, 7)}
    derts = stencil.gradient_3x3(pixels.withColumn("i", pixels.i.cast("long")), Filters(ave_g=15))
    found = blobs.blob_sums(blobs.label_by_segments(spark, derts)).cache()
    assert found.groupBy("frame_id").sum("area").collect()[0][1] == 54 and found.select("frame_id").distinct().count() == 2
    nodes = graph.nodes_from_blobs(found, 15).collect()
    assert len({r.node_id for r in nodes}) == found.count() > 2 and all(r.node_id < 0 for r in nodes)


def test_weights_of_a_link_dont_depend_on_its_batch(spark):
    rng = random.Random(4)
    names = [f"{p}_{k}" for p in "md" for k in graph.PARAMS]
    rows = [(0, k, k + 1, *(rng.uniform(-9, 9) for _ in names)) for k in range(40)] + [(0, 99, 100, *([1.0] * 18))]
    links = spark.createDataFrame(rows, "group long, a long, b long, " + ", ".join(f"{n} double" for n in names)).repartition(1)
    whole = {r.a: r.weights for r in graph.feature_weights(links, 400).collect()}
    alone = {a: graph.feature_weights(links.where(f"a = {a}"), 400).first().weights for a in (0, 7, 99)}
    assert all(whole[a] == w for a, w in alone.items()) and whole[99] == [1.0] * 18


def test_aggregate_keeps_mass(spark):
    rows = [(0, k, float(k), 0.0, float(k + 1), 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 1.0) for k in range(6)]
    nodes = spark.createDataFrame(rows, "group long, node_id long, y double, x double, c double, r double, span double, n double, M double, D double, I double, G double, dy double, dx double")
    member = spark.createDataFrame([(k, k // 3) for k in range(6)], "node_id long, root long")
    got = graph.aggregate_nodes(nodes, member).collect()
    assert sum(r.C for r in got) == 21 and all(r.M == 2.0 and r.n_members == 3 for r in got)


def test_a_frame_expands_along_its_whole_path(spark):
    tiles = [(0, 0, x, 1.0) for x in range(40)]
    got = graph.expand_frame(spark, spark.createDataFrame(tiles, "group long, ty int, tx int, v double").repartition(2), (0, 0), 0.9)
    assert {(r.tx, r.round) for r in got.where("ty = 0").collect()} >= {(x, x) for x in range(39)}


def test_many_edges_at_once(spark, monkeypatch):
    """Edges that are worked on together give the rows of each by itself, and a task does work on them together."""
    edges = [some_edge(seed, 9 + seed).assign(frame_id=seed // 3, blob_id=seed % 3, g=lambda e: e.g.round(3)) for seed in range(9)]
    plain = lambda found: sorted(tuple(None if pd.isna(v) else v for v in r) for r in found.itertuples(index=False))
    want = sorted((r for e in edges for r in plain(slices._sliced(e, SLICES))), key=str)
    assert sorted(plain(slices._sliced(pd.concat(edges).sample(frac=1, random_state=0), SLICES)), key=str) == want
    assert len(want) > 100 and {r[2] for r in want} == {"slice", "link"}
    pixels = spark.createDataFrame(pd.concat(edges).astype({"y": "int32", "x": "int32"}))
    assert sorted(plain(slices.slice_edges(pixels, SLICES).toPandas()), key=str) == want
    plan = slices.slice_edges(pixels, SLICES)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInPandas" in plan
    monkeypatch.setattr(slices, "AT_ONCE", 40)
    assert sorted(plain(slices.slice_edges(pixels, SLICES).toPandas()), key=str) == want
