import random

import numpy as np
from pyspark.sql import functions as F

from gradus.filters import Filters
from gradus.operators import blobs, components, stencil

KEYS = ["line_id", "fork"]


def _edges(spark, seed=5):
    rng = random.Random(seed)
    rows = [(g // 2, "md"[g % 2], rng.randrange(40), rng.randrange(40)) for g in range(12) for _ in range(rng.choice((0, 1, 25)))]
    return rows, spark.createDataFrame(rows, "line_id long, fork string, u long, v long").repartition(5)


def _found(rows):
    forests = {}
    for line, fork, u, v in rows:
        forests.setdefault((line, fork), components.Forest()).union(u, v)
    return {(*key, x, f.find(x)) for key, f in forests.items() for x in f.parent}


def test_components_of_groups(spark):
    rows, edges = _edges(spark)
    got = [tuple(r) for r in components.components_within(spark, edges, KEYS, "u", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == _found(rows)
    # groups over the bound go by rounds, the others by task
    some = [tuple(r) for r in components.components_within(spark, edges, KEYS, "u", "v", group_edges=5).collect()]
    assert sorted(some) == sorted(got)


def test_components_of_groups_have_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", 0)
    monkeypatch.setattr(components, "_large_star", None)
    derts = spark.createDataFrame([(f, y, x, 1, (x + y + f) % 3 > 0) for f in range(4) for y in range(6) for x in range(6)], "frame_id long, y int, x int, i long, s boolean")
    by_segments = {tuple(r) for r in blobs.label_by_segments(spark, derts).select("frame_id", "y", "x", "blob_id").collect()}
    assert by_segments == {tuple(r) for r in blobs.label_by_frame(derts).select("frame_id", "y", "x", "blob_id").collect()}


def test_struct_nodes_and_batches(spark, monkeypatch):
    monkeypatch.setattr(components, "BATCH", 1)
    edges = spark.createDataFrame([(g, k, k + 1) for g in range(3) for k in range(50) if k % 10], "g long, u long, v long")
    node = lambda c: F.struct((F.col(c) + 0).alias("p"), F.lit(1).alias("q")).alias(c)
    got = components.components_within(spark, edges.select("g", node("u"), node("v")), ["g"], "u", "v").collect()
    assert {(r.g, r.node.p, r.component.p) for r in got} == {(g, k, (k - 1) // 10 * 10 + 1) for g in range(3) for k in range(1, 51)}


def test_rings_around_some_pixels(spark):
    rng = np.random.default_rng(3)
    pixels = spark.createDataFrame([(f, y, x, int(rng.integers(256))) for f in range(2) for y in range(11) for x in range(12) if rng.random() > 0.02], "frame_id long, y int, x int, i long")
    derts = stencil.gradient_3x3(pixels, Filters(ave_g=15))
    whole = {(r.frame_id, r.y, r.x): (r.g, r.s) for r in stencil.ring_compare(pixels, derts, 3, Filters(ave_g=15), 2.5).collect()}
    inner = derts.where("y % 2 = 0").select("frame_id", "y", "x", "i", "dy4", "dx4", F.lit(0).cast("long").alias("root"))
    rows = pixels.groupBy("frame_id", "y").agg(F.collect_list("x").alias("row_x"), F.collect_list("i").alias("row_i"))
    got = {(r.frame_id, r.y, r.x): (r.g, r.s) for r in blobs._ringed(rows, inner, 3, Filters(ave_g=15), 2.5).collect()}
    assert got and got == {k: v for k, v in whole.items() if k[1] % 2 == 0}


def test_regions_dont_connect():
    y, x = (a.ravel() for a in np.mgrid[0:2, 0:4])
    assert blobs._label_frame(y, x, np.ones(8, bool), x // 2).tolist() == [0, 0, 2, 2] * 2
