"""Registered queries against brute force on small tables: nothing of the input may be left out."""

import random
import tempfile
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gradus.operators import hierarchy
from gradus.plans import graph_queries


def test_weighted_overlap_of_all_line_items(spark, tmp_path):
    rng = random.Random(3)
    items = [(rng.randint(0, 9), rng.randint(0, 14), float(rng.randint(1, 50))) for _ in range(120)]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    weight = Counter((s, p) for s, p, _ in items)
    total = Counter(s for s, _, _ in items)
    want = {}
    for a, b in combinations(sorted(total), 2):
        common = [p for p in range(15) if (a, p) in weight and (b, p) in weight]
        if common:
            shared = sum(weight[a, p] for p in common)
            want[a, b] = (shared, round(shared / ((total[a] + total[b] - 2 * shared) or 1e-7), 6))
    got = {(r.a, r.b): (r.shared, r.overlap) for r in graph_queries.weighted_overlap(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_weighted_overlap_shuffles_lists_not_pairs(spark, tmp_path):
    rng = random.Random(4)
    some = lambda top: rng.choice([None, *range(-3, top)])
    items = [(some(30) if i % 3 else 5, some(12)) for i in range(600)]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = graph_queries.weighted_overlap(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 3
    with duckdb.connect() as engine:
        engine.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = engine.sql(graph_queries.ORACLES["weighted_overlap"]).fetchall()
    got = [tuple(r) for r in found.collect()]
    assert len(want) > 400 and sorted(got) == sorted(want)


def test_pairs_of_ranges_in_parts(monkeypatch):
    rng = random.Random(5)
    total = {s: rng.randint(1, 99) for s in range(0, 400, 7)}
    rows = []
    for place in sorted(rng.randint(0, 3) for _ in range(60)):
        ids = sorted(rng.sample([s for s in total if s >= 100 * place], rng.randint(2, 6)))
        own = max(1, sum(s < 100 * place + 100 for s in ids))
        rows.append((place, ids, [total[s] for s in ids], [rng.randint(1, 9) for _ in range(own)]))
    want = Counter()
    for place, ids, _, w in rows:
        for i, x in enumerate(w):
            for b in ids[i + 1 :]:
                want[place, ids[i], b] += x
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 8])], ["range", "set_id", "t", "w"]) for i in range(0, len(rows), 8)]
    for held, at_once in ((1 << 22, 1 << 21), (20, 3), (1, 1)):
        monkeypatch.setattr(hierarchy, "HELD", held)
        monkeypatch.setattr(hierarchy, "AT_ONCE", at_once)
        got = [tuple(r.values()) for b in hierarchy._range_pairs(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted((a, b, n, total[a], total[b]) for (_, a, b), n in want.items())


def test_a_point_at_every_edge_pixel(spark):
    sf = "/root/testdata/sf0.001"
    value = {(r.frame_id, r.blob_id, r.y, r.x): r.i for r in graph_queries._edge_pixels(spark, sf).collect()}
    want = {}
    for frame, blob, y, x in value:
        near = [((1 - dy) * (1 - dx), value[frame, blob, y + oy, x + ox]) for oy, dy in ((0, 0.25), (1, 0.75)) for ox, dx in ((0, 0.5), (1, 0.5)) if (frame, blob, y + oy, x + ox) in value]
        want[frame, blob, y + 0.25, x + 0.5] = 1000 * sum(k * v for k, v in near) / sum(k for k, _ in near)
    got = {(r.frame_id, r.blob_id, r.py, r.px): r.i for r in graph_queries.interpolated_points(spark, sf).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - want[k]) < 0.501 for k in want)


def test_weighted_overlap_sends_small_parcels(monkeypatch):
    """A range's lists take some two bytes a set, not sixteen; what comes out is what went in."""
    rng = random.Random(6)
    total = {s: rng.randint(1, 999) for s in range(-5000, 55000)}
    lists = [[{"set_id": s, "range": (s + 5000) // 600, "w": rng.randint(1, 3)} for s in sorted(rng.sample(sorted(total), 30))] for _ in range(400)]
    sent = list(hierarchy._parcels(iter([pa.RecordBatch.from_pylist([{"of": x} for x in lists[i : i + 90]]) for i in range(0, 400, 90)])))
    with tempfile.TemporaryDirectory() as folder:
        pq.write_table(pa.table({"set_id": list(total), "t": list(total.values())}), f"{folder}/t.parquet")
        got = [tuple(r.values()) for b in hierarchy._listed(iter(sent), folder, np.dtype("i8"), np.dtype("i8")) for r in b.to_pylist()]
    want = []
    for of in lists:
        for i, x in enumerate(of[:-1]):
            if not i or of[i - 1]["range"] != x["range"]:
                ids = [e["set_id"] for e in of[i:]]
                want.append((x["range"], ids, [total[s] for s in ids], [e["w"] for e in of[i:] if e["range"] == x["range"]]))
    assert sorted(got) == sorted(want)
    monkeypatch.setattr(hierarchy, "PACKED", 1)
    assert sum(len(b) for b in hierarchy._parcels(iter([pa.RecordBatch.from_pylist([{"of": x}]) for x in lists]))) == len(want)
