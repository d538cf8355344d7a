"""Search beyond neighbours and direction regions, against plain loops on small frames."""

import math
import random

from pyspark.sql import functions as F

from gradus.filters import Filters
from gradus.operators import blobs, merge, reach
from gradus.operators.blobs import STRIDE

BLOB = "frame_id long, blob_id long, area long, I long, G1000 long, Dy4 long, Dx4 long"


def plain_search(rows, pairs, f):
    at = {(r[0], r[1]): dict(zip(("area", "I", "G", "dy", "dx"), r[2:])) for r in rows}

    def match(a, b, distance):
        k = f.ave_rM ** ((1 + distance) / math.sqrt(a["area"]))
        g = lambda x: x["G"] / x["area"] / 1000
        size = lambda x: math.log1p(x["area"])
        near = lambda x, y: min(x, y) - abs(y - x) / 2
        angle = (math.cos(math.atan2(b["dy"], b["dx"]) - math.atan2(a["dy"], a["dx"])) + 1) / 2
        ci, ca, cg, cs = (x * k for x in f.ave_blob)
        return ci - abs(b["I"] / b["area"] - a["I"] / a["area"]) + angle - ca + near(g(a), g(b)) - cg + near(size(a), size(b)) - cs

    out = {}
    for (frame, a), own in at.items():
        M, met, ends, hop = f.ave_g * own["area"] - own["G"] / 1000, {a}, {a: (0.0, 0.0)}, 0
        while ends:
            hop += 1
            ways = {}
            for via, (distance, neg) in ends.items():
                for fr, x, b in pairs:
                    if fr == frame and x == via and b not in met:
                        ways[b] = min(ways.get(b, (math.inf,)), (-neg, distance, via))
            ends = {}
            for b, (loss, distance, _) in ways.items():
                met.add(b)
                m = match(own, at[frame, b], distance)
                out[frame, a, b] = (hop, distance, -loss, m)
                if m <= 0 and M - loss + m > f.ave_mB:
                    ends[b] = (distance + math.sqrt(at[frame, b]["area"]), m - loss)
    return out


def test_decayed_search_as_loops(spark):
    rnd = random.Random(4)
    rows = [(fr, k, rnd.randint(1, 40), rnd.randint(0, 4000), rnd.randint(0, 90_000), rnd.randint(-300, 300), rnd.randint(-300, 300)) for fr in (0, 5) for k in range(14)]
    pairs = {(fr, *rnd.sample(range(14), 2)) for fr in (0, 5) for _ in range(22)}
    pairs |= {(fr, b, a) for fr, a, b in pairs}
    f = Filters(ave_g=5, ave_mB=-400)
    got = {(r.frame_id, r.a, r.b): r for r in reach.decayed_search(spark.createDataFrame(list(pairs), "frame_id long, a long, b long"), spark.createDataFrame(rows, BLOB), f).collect()}
    want = plain_search(rows, pairs, f)
    assert got.keys() == want.keys() and max(v[0] for v in want.values()) >= 3
    for k, (hop, distance, neg, m) in want.items():
        assert got[k].hop == hop and all(math.isclose(x, y, abs_tol=1e-7) for x, y in ((got[k].distance, distance), (got[k].neg, neg), (got[k].m, m)))


def test_search_of_nothing(spark):
    assert reach.decayed_search(spark.createDataFrame([], "frame_id long, a long, b long"), spark.createDataFrame([(0, 1, 2, 3, 4, 5, 6)], BLOB)).count() == 0


def components(items, linked):
    left, out = set(items), []
    while left:
        todo, own = [min(left)], set()
        while todo:
            x = todo.pop()
            if x in left:
                left.discard(x)
                own.add(x)
                todo += [y for y in left if linked(x, y)]
        out.append(own)
    return out


def plain_merge(pixels, f):
    """pixels: (frame, root, y, x) -> (i, g, dy4, dx4); the merged and spliced regions."""
    steep = {k: abs(v[2]) > abs(v[3]) for k, v in pixels.items()}

    def same(p, q):
        dy, dx = abs(p[2] - q[2]), abs(p[3] - q[3])
        return p[:2] == q[:2] and steep[p] == steep[q] and max(dy, dx) == 1 and (steep[p] or dy + dx == 1)

    regions = {}  # (frame, root, name) -> pixels
    for own in components(pixels, same):
        first = min(own, key=lambda k: k[2:])
        regions[(*first[:2], first[2] * STRIDE + first[3])] = [own, 1]
    name = {p: k for k, (own, _) in regions.items() for p in own}
    touch = {(name[p], name[q]) for p in pixels for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (q := (*p[:2], p[2] + dy, p[3] + dx)) in name and name[p] != name[q] and steep[p] != steep[q]}
    total = lambda k, c: sum(pixels[p][c] for p in regions[k][0])
    power = lambda k: max(abs(total(k, 2)), abs(total(k, 3)))
    strong = {k: power(k) >= 4 * f.ave_dir * len(regions[k][0]) for k in regions}

    def alike(a, b):
        u, v = (total(a, 2), total(a, 3)), (total(b, 2), total(b, 3))
        n = math.sqrt(u[0] ** 2 + u[1] ** 2) * math.sqrt(v[0] ** 2 + v[1] ** 2)
        return (u[0] * v[0] + u[1] * v[1]) / n if n else 0.0

    while picks := {a: min((round(-alike(a, b), 12), -len(regions[b][0]), b) for x, b in touch if x == a)[2] for a in regions if not strong[a] and any(x == a for x, _ in touch)}:
        into = {}
        for own in components(regions, lambda x, y: picks.get(x) == y or picks.get(y) == x):
            into |= dict.fromkeys(own, min(own))
        merged, held = {}, {}
        for k, (own, parts) in regions.items():
            there = merged.setdefault(into[k], [set(), 0])
            there[0] |= own
            there[1] += parts
            held[into[k]] = held.get(into[k], False) or strong[k]
        regions = merged
        strong = {k: held[k] or power(k) >= 4 * f.ave_dir * len(regions[k][0]) for k in regions}
        touch = {(into[a], into[b]) for a, b in touch if into[a] != into[b]}
    box = {k: (min(p[2] for p in own), min(p[3] for p in own), max(p[2] for p in own), max(p[3] for p in own)) for k, (own, _) in regions.items()}

    def splice(a, b):
        if a[:2] != b[:2] or max(power(a), power(b)) <= 4 * f.ave_dir_splice:
            return False
        if box[a][2] + 1 != box[b][0]:
            a, b = b, a
        return box[a][2] + 1 == box[b][0] and box[a][1] - 1 < box[b][3] and box[a][3] + 1 > box[b][1]

    out = {}
    for own in components(regions, splice):
        for k in own:
            out[k] = (regions[k][1], len(regions[k][0]), total(k, 0), total(k, 2), total(k, 3), *box[k], min(own)[2])
    return out


def test_merged_directions_as_loops(spark):
    rnd, rows = random.Random(9), []
    for frame in (0, 3):
        for y in range(9):
            for x in range(11):
                if rnd.random() < 0.93:
                    rows.append((frame, y, x, rnd.randint(0, 255), rnd.random() * 40, rnd.randint(-90, 90), rnd.randint(-90, 90), rnd.random() < 0.7))
    derts = spark.createDataFrame(rows, "frame_id long, y int, x int, i long, g double, dy4 long, dx4 long, s boolean").repartition(3)
    labelled = blobs.label_by_segments(spark, derts).cache()
    f = Filters(ave_dir=9, ave_dir_splice=60)
    root = {(r.frame_id, r.y, r.x): r.blob_id for r in labelled.collect()}
    want = plain_merge({(fr, root[fr, y, x], y, x): (i, g, dy, dx) for fr, y, x, i, g, dy, dx, _ in rows}, f)
    got = merge.merged_directions(spark, labelled, f).collect()
    assert {(r.frame_id, r.root, r.region): (r.parts, r.area, r.I, r.Dy4, r.Dx4, r.y0, r.x0, r.yn, r.xn, r.spliced) for r in got} == want
    assert any(v[0] > 1 for v in want.values()) and any(k[2] != v[-1] for k, v in want.items())


def test_adjacency_as_pixel_neighbours(spark):
    rnd = random.Random(3)
    rows = [(fr, y, x, 1, rnd.random() < 0.5) for fr in (0, 1) for y in range(12) for x in range(15) if rnd.random() < 0.9]
    labelled = blobs.label_by_segments(spark, spark.createDataFrame(rows, "frame_id long, y int, x int, i long, s boolean")).cache()
    at = {(r.frame_id, r.y, r.x): (r.s, r.blob_id) for r in labelled.collect()}
    for conn in (4, 8):
        want = {(fr, b, at[q][1]) for (fr, y, x), (s, b) in at.items() for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (conn == 8 or abs(dy) + abs(dx) == 1) and (q := (fr, y + dy, x + dx)) in at and at[q][0] != s}
        got = [tuple(r) for r in blobs.adjacency(labelled, conn).select("frame_id", "a", "b").collect()]
        assert set(got) == want and len(got) == len(want)
    assert blobs.adjacency(labelled.where(F.lit(False))).count() == 0
