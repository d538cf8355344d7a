"""Sub-runs searched by nearness and overlapping runs, against plain loops."""

import random

import pytest

from gradus.filters import Filters
from gradus.operators import params, sublayers

RUN = "line_id long, parent string, fork string, seg long, L long, I long, D long, M double, Rdn long, x0 long, depth int"
PAIRS = "line_id long, rf string, n long, least_L long, rdn long, root_v double, value_m double, value_d double"


def sub_run(rnd, parent, fork, seg, x0):
    n = rnd.randint(1, 5)
    return (1, parent, fork, seg, n, rnd.randint(-50, 50), rnd.randint(-30, 30), rnd.uniform(-4, 12), 1, x0, 2)


def searched(a_runs, b_runs, root_v, fork, f):
    """The pairs that one search after another reaches, nearest first, until the gate fails."""
    stop = f.pp_M * f.stop_D if fork == "d" else 0
    centre = lambda r: r[9] + r[4] / 2
    out = set()
    for a in a_runs:
        right = sorted((b for b in b_runs if centre(b) >= centre(a)), key=lambda b: (centre(b), b[3]))
        left = sorted((b for b in b_runs if centre(b) < centre(a)), key=lambda b: (centre(b), b[3]), reverse=True)
        for side, others in ((1, right), (-1, left)):
            for step, b in enumerate(others):
                length = (a[4] + b[4]) / 2
                v = (abs((a[6] + b[6]) / 2) - f.pp_D * length if fork == "d" else (a[7] + b[7]) / 2) + root_v
                if not v * (abs(centre(b) - centre(a)) / length) * 2 > stop:
                    break
                out.add((a[3], b[3], side, step))
    return out


@pytest.mark.parametrize("fork,root_v", [("m", 4.5), ("d", 40.0), ("m", 60.0)])
def test_sub_pairs_as_loops(spark, fork, root_v):
    rnd, f = random.Random(7), Filters(stop_D=1)
    a = [sub_run(rnd, "m0r", fork, k, rnd.randint(0, 90)) for k in range(40)]
    b = [sub_run(rnd, "m1r", fork, k, rnd.randint(0, 90)) for k in range(55)]
    other = [sub_run(rnd, "m1d", fork, k, 3 * k) for k in range(5)]  # of another kind: never met
    levels = spark.createDataFrame(a + b + other, RUN)
    pairs = spark.createDataFrame([(1, "m", 0, 9, 1, root_v, 500.0, 500.0)], PAIRS)
    got = sublayers.sub_pairs(levels, pairs, f).collect()
    want = searched(a, b, root_v, fork, f)
    assert {(r.seg_a, r.seg_b, r.side, r.step) for r in got} == want and len(got) == len(want)
    assert {r.kind for r in got} == {"r"}
    if root_v == 60.0:
        assert max(r.step for r in got) > 2 * sublayers.FIRST_LOOK  # several rounds took part


def test_gates_of_pairs(spark):
    rnd = random.Random(1)
    levels = spark.createDataFrame([sub_run(rnd, f"m{n}r", "m", k, 3 * k) for n in (0, 1) for k in range(6)], RUN)
    for row, some in (((1, "m", 0, 9, 1, 30.0, 1.0, 0.0), True), ((1, "m", 0, 3, 1, 30.0, 1.0, 0.0), False), ((1, "m", 0, 9, 1, 0.0, 0.0, 0.0), False), ((1, "d", 0, 9, 1, 30.0, 1.0, 0.0), False)):
        assert (sublayers.sub_pairs(levels, spark.createDataFrame([row], PAIRS)).count() > 0) is some
    assert sublayers.sub_pairs(levels.where("false"), spark.createDataFrame([], PAIRS)).count() == 0


def test_runs_and_values_of_sub_pairs(spark):
    schema = "line_id long, rf string, n long, kind string, fork string, seg_a long, seg_b long, side int, step long, " + ", ".join(f"d_{p} double, m_{p} double" for p in params.PARAMS)
    row = lambda seg_b, side, step, m: (1, "m", 0, "r", "m", 0, seg_b, side, step, *[x for k in range(4) for x in (5.0, m if k == 0 else 1.0)])
    found = spark.createDataFrame([row(3, -1, 0, 2.0), row(4, 1, 0, 1.0), row(5, 1, 1, -1.0), row(2, -1, 1, 4.0)], schema)
    got = {(r.param, r.pp): (r.L, r.M) for r in sublayers.sub_runs(found).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "L"} == {0: (1, 1.0), 1: (1, -1.0), 2: (2, 6.0)} and got["I", 0] == (4, 4.0)
    pairs = spark.createDataFrame([(1, "m", 0, 9, 1, 0.5, 10.0, 20.0), (1, "m", 1, 9, 1, 0.0, 1.0, 2.0)], PAIRS)
    values = {r.n: r for r in sublayers.pair_values(pairs, found).collect()}
    assert (values[0].match, values[0].difference, values[0].n_subs) == (10 + 7 + 4 * 3, 20 + 4 * 4 * 3, 4)
    assert (values[1].match, values[1].difference, values[1].n_subs) == (1, 2, 0)


def test_overlap_sweep_as_all_pairs(spark):
    rnd, rows = random.Random(2), []
    for line in range(6):
        for p in params.PARAMS:
            x = rnd.randint(0, 3)
            for seg in range(12):
                n = rnd.choice([1, 1, 2, 3, 40])
                rows.append((line, "m", "m", p, seg, n, rnd.randint(-9, 9), float(rnd.randint(-9, 9)), float(rnd.randint(-9, 9)), x))
                x += n
    pps = spark.createDataFrame(rows, "line_id long, fork string, sign_fork string, param string, seg long, L long, I long, D double, M double, x0 long")
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and params.PARAMS.index(a[3]) < params.PARAMS.index(b[3]):
                olp = min(a[9] + a[5], b[9] + b[5]) - max(a[9], b[9])
                if olp > 0 and olp / ((a[5] + b[5]) / 2) > 0.2:
                    want.add((a[0], a[3], a[4], b[3], b[4], olp, b[5] - a[5]))
    found = params.overlap_pairs(pps, 0.2)
    got = [(r.line_id, r.param_a, r.seg_a, r.param_b, r.seg_b, r.overlap, r.dL) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Join" not in found._jdf.queryExecution().toString()


def test_overlap_clusters_gather_and_start_again(spark):
    row = lambda line, p, match, ratio: (line, "m", "m", p, match, 1.0, ratio)
    pairs = [row(1, "L", 30.0, 1.0), row(1, "I", 5.0, 1.0), row(1, "D", 2.0, 1.0), row(2, "L", 1.0, 1.0), row(2, "D", 90.0, 1.0), row(3, "L", 50.0, 1.0), row(3, "D", 0.0, 0.5), row(4, "I", 1.0, 1.0)]
    df = spark.createDataFrame(pairs, "line_id long, fork string, sign_fork string, param_a string, match double, difference double, ratio double")
    got = sorted((r.line_id, r.params, r.n, r.match, r.overlap) for r in params.overlap_clusters(df, Filters(pp_M=10)).collect())
    assert got == [(1, "L", 1, 30.0, 1.0), (1, "LI", 2, 35.0, 2.0), (1, "LID", 3, 37.0, 3.0), (2, "D", 1, 90.0, 2.0), (3, "L", 1, 50.0, 1.0), (3, "LD", 2, 50.0, 1.5)]
