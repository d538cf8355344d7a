"""Centroid clusters and mean shift against plain loops."""

import math
import random

import pytest

from gradus.filters import Filters
from gradus.operators import graph

NODE = "group long, node_id long, y double, x double, c double, r double, span double, n double, M double, D double, I double, G double, dy double, dx double"
NAMES = [x.split()[0] for x in NODE.split(", ")]


def least(a, b):
    v = min(abs(a), abs(b))
    return -v if (a < 0) != (b < 0) else v


def compared(p, q):
    """m and d of node q against p."""
    rn, m, d = q["c"] / p["c"], {}, {}
    for k, name, scaled in (("M", "M", 1), ("D", "D", 1), ("C", "c", 0), ("I", "I", 1), ("G", "G", 1), ("L", "n", 1), ("S", "span", 0)):
        a, b = p[name] * (rn if scaled else 1), q[name]
        d[k] = a - b
        m[k] = graph.WEIGHT[k] - abs(a - b) if k in ("I", "S") else least(a, b)
    turn = math.atan2(p["dy"], p["dx"]) - math.atan2(q["dy"], q["dx"])
    turn = math.atan2(math.sin(turn), math.cos(turn))
    m["A"], d["A"], m["E"], d["E"] = (math.cos(turn) + 1) / 2, turn / math.pi, 0.0, 0.0
    part = lambda k: (m[k] + abs(d[k])) or 1e-7
    match = sum(graph.WEIGHT[k] * m[k] / part(k) for k in m)
    return match, sum(graph.WEIGHT[k] * abs(d[k]) for k in d) * match / 2


def world(seed, groups=2, n=16):
    rnd, rows, links = random.Random(seed), [], set()
    for g in range(groups):
        for k in range(n):
            base = 1 + k % 3 * 4
            rows.append((g, 100 * g + k, *(rnd.uniform(0, 30) for _ in "yx"), base + rnd.random(), rnd.choice([1.0, 1.2]), base + rnd.random(), base + rnd.random(), *(10 * base * rnd.uniform(0.8, 1.2) for _ in "MDIG"), rnd.uniform(-5, 5), rnd.uniform(-5, 5)))
        links |= {(g, *sorted(100 * g + x for x in rnd.sample(range(n), 2))) for _ in range(2 * n)}
    return rows, sorted(links)


def neighbours(nodes, links):
    near = {k: {k[1]} for k in nodes}
    for g, a, b in links:
        near[g, a].add(b)
        near[g, b].add(a)
    return near


def mean_of(g, own, nodes, weight):
    total = sum(weight.values())
    return {f: sum(nodes[g, x][f] * w for x, w in weight.items()) / total for f in graph.FEATURES}


def settled(now, before, seen, change):
    """By group: whether it changed little or repeats an earlier membership. now: (group, centroid, node) -> (m, d)."""
    out = {}
    for g in {k[0] for k in now} | {k[0] for k in before or ()}:
        own = {k: v for k, v in now.items() if k[0] == g}
        old = {k: v for k, v in (before or {}).items() if k[0] == g}
        total = sum(abs(m) + abs(d) for m, d in own.values())
        moved = total if before is None else sum(abs(own.get(k, (0, 0))[i] - old.get(k, (0, 0))[i]) for k in own.keys() | old.keys() for i in (0, 1))
        sign = frozenset(own)
        out[g] = not own or (g, sign) in seen or moved <= change * total
        if not out[g]:
            seen.add((g, sign))
    return out


def by_centroid(members):
    out = {}
    for (g, c, x), v in members.items():
        out.setdefault((g, c), {})[x] = v
    return out


def plain_centroids(nodes, near, seeds, f, change):
    current = {(g, s): {k: nodes[g, s][k] for k in graph.FEATURES} for g, s in seeds}
    front = {(g, s): {s} for g, s in seeds}
    before, seen, out, k = None, set(), {}, 0
    while True:
        k += 1
        rated, stable = {}, {}
        for (g, c), mean in current.items():
            own = {x: compared(mean, nodes[g, x]) for m in front[g, c] for x in near[g, m]}
            own = {x: v for x, v in own.items() if v[0] > f.ave_node * nodes[g, x]["r"]}
            mass = sum(nodes[g, x]["c"] for x in own)
            if own and sum(v[0] * nodes[g, x]["c"] for x, v in own.items()) / mass > f.ave_cent * sum(nodes[g, x]["r"] * nodes[g, x]["c"] for x in own) / mass:
                there = stable if sum(abs(v[1]) * nodes[g, x]["c"] for x, v in own.items()) / mass < f.ave_cent_d else rated
                there |= {(g, c, x): v for x, v in own.items()}
        done = settled(rated, before, seen, change)
        out |= {key: (*v, k, True) for key, v in stable.items()}
        out |= {key: (*v, k, False) for key, v in rated.items() if done[key[0]]}
        if all(done.values()):
            return out
        before = {key: v for key, v in rated.items() if not done[key[0]]}
        current, front = {}, {}
        for (g, c), own in by_centroid(before).items():
            current[g, c] = mean_of(g, own, nodes, {x: nodes[g, x]["c"] * v[0] for x, v in own.items()})
            front[g, c] = set(own)


def plain_fuzzy(nodes, near, members, f, change):
    now, before, seen, out, k = {key: v[0] for key, v in members.items() if v[0] > 0}, None, set(), {}, 0
    while True:
        k += 1
        total = {}
        for (g, _, x), m in now.items():
            total[g, x] = total.get((g, x), 0) + m
        groups = by_centroid(now)
        means = {(g, c): mean_of(g, own, nodes, {x: nodes[g, x]["c"] * m * m / total[g, x] for x, m in own.items()}) for (g, c), own in groups.items()}
        met = {}
        for (g, c), own in groups.items():
            for x in {y for mem in own for y in near[g, mem]}:
                if (m := compared(means[g, c], nodes[g, x])[0]) > 0:
                    met[g, c, x] = m
        better = {key: sum(o[0] == key[0] and o[2] == key[2] and v > m for o, v in met.items()) for key, m in met.items()}
        kept = {}
        for (g, c), own in by_centroid(met).items():
            mass = sum(nodes[g, x]["c"] for x in own)
            mean = lambda v: sum(v(x) * nodes[g, x]["c"] for x in own) / mass  # noqa: B023, E731
            if mean(lambda x: own[x]) > f.ave_node * (mean(lambda x: nodes[g, x]["r"]) + sum(better[g, c, x] for x in own) / len(own)):
                kept |= {(g, c, x): m for x, m in own.items()}
        groups = by_centroid(kept)
        into = {key: key[1] for key in groups}
        joined = set()
        pairs = [(g, a, b) for g, a in groups for h, b in groups if g == h and a < b and groups[g, a].keys() & groups[g, b].keys() and compared(means[g, a], means[g, b])[0] > f.ave_cent * means[g, b]["r"]]
        for _ in groups:
            for g, a, b in pairs:
                into[g, a] = into[g, b] = min(into[g, a], into[g, b])
                joined.add(g)
        now = {}
        for (g, c, x), m in kept.items():
            now[g, into[g, c], x] = max(m, now.get((g, into[g, c], x), -math.inf))
        done = settled({key: (m, 0.0) for key, m in now.items()}, before and {key: (m, 0.0) for key, m in before.items()}, seen, change)
        done = {g: v and g not in joined for g, v in done.items()}
        share = {}
        for (g, _, x), m in now.items():
            share[g, x] = share.get((g, x), 0) + (m if done[g] else 0)
        for (g, c, x), m in now.items():
            node = nodes[g, x]
            if done[g]:
                total = sum(v for key, v in now.items() if (key[0], key[2]) == (g, x))
                if m * node["c"] > f.ave_node * node["r"]:
                    out[g, c, x] = (m, m / total, math.hypot(node["y"] - means[g, c]["y"], node["x"] - means[g, c]["x"]), k)
        if all(done.values()):
            return out
        before = now = {key: v for key, v in now.items() if not done[key[0]]}


@pytest.mark.parametrize("seed,gates,shift", [(1, (22.0, 24.0, 4000.0), (5.0, 60.0)), (7, (45.0, 48.0, 1200.0), (2.0, 95.0))])
def test_centroids_as_loops(spark, seed, gates, shift):
    rows, links = world(seed)
    nodes = {(r[0], r[1]): dict(zip(NAMES, r)) for r in rows}
    near = neighbours(nodes, links)
    seeds = [(g, 100 * g + k) for g in (0, 1) for k in (0, 1, 2, 7)]
    f = Filters(ave_node=gates[0], ave_cent=gates[1], ave_cent_d=gates[2])
    table, linked = spark.createDataFrame(rows, NODE), spark.createDataFrame(links, "group long, a long, b long")
    found = graph.centroids(spark, table, spark.createDataFrame(seeds, "group long, node_id long"), linked, f, 0.02).cache()
    got = {(r.group, r.centroid, r.node_id): (r.m, r.d, r["round"], r.stable) for r in found.collect()}
    want = plain_centroids(nodes, near, seeds, f, 0.02)
    assert got.keys() == want.keys() and max(v[2] for v in want.values()) > 2
    for k, v in want.items():
        assert got[k][2:] == v[2:] and got[k][:2] == pytest.approx(v[:2], rel=1e-6, abs=1e-6)
    f = Filters(ave_node=shift[0], ave_cent=shift[1])
    shifted = {(r.group, r.centroid, r.node_id): (r.m, r.share, r.dist, r["round"]) for r in graph.fuzzy_centroids(spark, table, found, linked, f, 0.02).collect()}
    want = plain_fuzzy(nodes, near, want, f, 0.02)
    assert shifted.keys() == want.keys()
    for k, v in want.items():
        assert shifted[k][3] == v[3] and shifted[k][:3] == pytest.approx(v[:3], rel=1e-6, abs=1e-6)


def test_no_seeds(spark):
    rows, links = world(1)
    none = spark.createDataFrame([], "group long, node_id long")
    table, linked = spark.createDataFrame(rows, NODE), spark.createDataFrame(links, "group long, a long, b long")
    found = graph.centroids(spark, table, none, linked)
    assert found.count() == 0 and graph.fuzzy_centroids(spark, table, found, linked).count() == 0
