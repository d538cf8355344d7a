"""Connectivity, convolution and segmentation of graphs against plain loops."""

import math
import random

from gradus.filters import Filters
from gradus.operators import density

LINK = "group long, a long, b long, m double, r double, dist double"


def random_links(seed, groups=3, n=14, links=30):
    rnd, rows = random.Random(seed), {}
    for g in range(groups):
        for _ in range(links):
            a, b = sorted(rnd.sample(range(n), 2))
            rows[g, a, b] = (g, 100 * g + a, 100 * g + b, rnd.uniform(-2, 9) * (1 + 3 * g), rnd.choice([1.0, 1.5]), rnd.uniform(0, 5))
    return list(rows.values())


def rims(rows, f):
    out = {}
    for g, a, b, m, r, dist in rows:
        if m > f.ave_node * r:
            out.setdefault((g, a), []).append((b, m, r, f.decay**dist))
            out.setdefault((g, b), []).append((a, m, r, f.decay**dist))
    return out


def plain_connectivity(rows, f, least=None):
    near, out = rims(rows, f), {}
    for g in {k[0] for k in near}:
        own = {k[1]: v for k, v in near.items() if k[0] == g}
        v = {x: sum(e[1] for e in es) for x, es in own.items()}
        w = {x: sum(e[2] for e in es) for x, es in own.items()}
        before_v = before_w = 0.0
        for k in range(1, 999):
            gain_v = {x: sum(v[e[0]] * e[3] for e in es) for x, es in own.items()}
            gain_w = {x: sum(w[e[0]] * e[3] for e in es) for x, es in own.items()}
            v = {x: (v[x] + gain_v[x] / len(es)) / 2 for x, es in own.items()}
            w = {x: (w[x] + gain_w[x] / len(es)) / 2 for x, es in own.items()}
            now_v, now_w = sum(gain_v.values()), sum(gain_w.values())
            goes_on = now_v - before_v > f.ave_node * (now_w - before_w) if least is None else abs(now_v - before_v) > least * len(own)
            if not goes_on or abs(now_v - before_v) <= 1e-9 * max(abs(before_v), 1):
                break
            before_v, before_w = now_v, now_w
        out |= {(g, x): (len(own[x]), v[x], w[x], k) for x in own}
    return out


def plain_convolution(rows, layers, f):
    near, out = rims(rows, f), {}
    for g in {k[0] for k in near}:
        own = {k[1]: v for k, v in near.items() if k[0] == g}
        v = {x: sum(e[1] for e in es) for x, es in own.items()}
        for k in range(1, 999):
            kernels = [v]
            for _ in range(layers):
                low = kernels[-1]
                kernels.append({x: (low[x] + sum(low[e[0]] * e[3] for e in es)) / (1 + sum(e[3] for e in es)) for x, es in own.items()})
            top = kernels.pop()
            while kernels:
                low = kernels.pop()
                top = {x: low[x] * (1 + 0.5 * ((min(low[x], top[x]) / max(low[x], top[x]) if max(low[x], top[x]) > 0 else 1) - 1)) for x in own}
            fall = sum(v.values()) - sum(top.values())
            done = not fall > f.ave_node * len(own) or abs(fall) <= 1e-9 * max(abs(sum(v.values())), 1)
            v = top
            if done:
                break
        out |= {(g, x): (v[x], k) for x in own}
    return out


def plain_segments(rows, nodes, f):
    """nodes: (group, node) -> (v, w)."""
    graph = {k: k[1] for k in nodes}
    good = [r for r in rows if r[3] > f.ave_node * r[4]]
    while True:
        sums, links = {}, {}
        for k, (v, w) in nodes.items():
            n, sv, sw = sums.get((k[0], graph[k]), (0, 0.0, 0.0))
            sums[k[0], graph[k]] = n + 1, sv + v, sw + w
        for g, a, b, m, r, _ in good:
            pair = (g, *sorted((graph[g, a], graph[g, b])))
            if pair[1] != pair[2]:
                n, sm, sr = links.get(pair, (0, 0.0, 0.0))
                links[pair] = n + 1, sm + m, sr + r
        picks = {}
        for (g, a, b), (n, m, r) in links.items():
            (na, va, wa), (nb, vb, wb) = sums[g, a], sums[g, b]
            excess = m / n + min(va / na, vb / nb) - f.ave_node * (r / n + (wa / na + wb / nb) / 2)
            if excess > 0:
                for x, y in ((a, b), (b, a)):
                    picks[g, x] = min(picks.get((g, x), (math.inf, 0)), (-excess, y))
        if not picks:
            return {k: (graph[k], sums[k[0], graph[k]][1] > f.ave_node * sums[k[0], graph[k]][2]) for k in nodes}
        into = {}
        for start in sums:
            own, todo = set(), [start]
            while todo:
                x = todo.pop()
                if x not in own:
                    own.add(x)
                    todo += [(x[0], picks[x][1])] if x in picks else []
                    todo += [y for y, (_, to) in picks.items() if y[0] == x[0] and to == x[1]]
            into[start] = min(own)[1]
        graph = {k: into[k[0], g] for k, g in graph.items()}


def test_connectivity_and_convolution_as_loops(spark):
    rows = random_links(1) + [(9, 900, 901, 50.0, 1.0, 0.0)]
    f = Filters(ave_node=1.5, decay=0.9)
    links = spark.createDataFrame(rows, LINK).repartition(3)
    for least in (None, 2.0):
        got = {(r.group, r.node_id): r for r in density.connectivity(links, f, least).collect()}
        want = plain_connectivity(rows, f, least)
        assert got.keys() == want.keys() and (least is None or len({x[3] for x in want.values()}) > 1)  # groups settle in different rounds
        assert all((got[k].n, got[k]["round"]) == (n, last) and math.isclose(got[k].v, v, rel_tol=1e-6) and math.isclose(got[k].w, w, rel_tol=1e-6) for k, (n, v, w, last) in want.items())
    got = {(r.group, r.node_id): r for r in density.convolved(links, 2, f).collect()}
    want = plain_convolution(rows, 2, f)
    assert got.keys() == want.keys() and len({x[1] for x in want.values()}) > 1
    assert all(got[k]["round"] == last and math.isclose(got[k].v, v, rel_tol=1e-6) for k, (v, last) in want.items())


def test_segments_as_loops(spark):
    some = 0
    for seed in (2, 3):
        rows = random_links(seed, groups=2, n=24, links=34)
        f = Filters(ave_node=4.0, decay=0.9)
        near = rims(rows, f)
        nodes = {k: (sum(e[1] for e in es), float(len(es))) for k, es in near.items()}
        table = spark.createDataFrame([(*k, *v) for k, v in nodes.items()], "group long, node_id long, v double, w double")
        got = {(r.group, r.node_id): (r.graph, r.kept) for r in density.segmented(spark, spark.createDataFrame(rows, LINK), table, f).collect()}
        assert got == plain_segments(rows, nodes, f)
        sizes = [sum(v[0] == g for v in got.values()) for g in {v[0] for v in got.values()}]
        some += max(sizes) > 2 and len(sizes) > 3
    assert some


def test_no_positive_links(spark):
    links = spark.createDataFrame([(0, 1, 2, -1.0, 1.0, 1.0)], LINK)
    assert density.connectivity(links).count() == density.convolved(links).count() == 0
    assert density.segmented(spark, links, density.connectivity(links)).count() == 0
