from gradus.operators import slices
from gradus.plans.scratch import Scratch

LINK = "frame_id long, blob_id long, a long, b long, m double, d double, c double"


def test_cluster_sums_broadcast_nothing(spark):
    """Tables that grow with the pixels don't pass through the driver, however small their files are."""
    scratch = Scratch(spark, "test")
    found = scratch.save(spark.createDataFrame([(0, 0, "slice", k, None, *([1.0] * 11)) for k in range(6)], slices.SLICE), "found")
    links = scratch.save(spark.createDataFrame([(0, 0, k + 1, k, 30.0 if k != 2 else 0.0, 1.0, 1.0) for k in range(5)], LINK), "links")
    clusters = scratch.save(slices.slice_clusters(spark, links), "clusters")
    sums = slices.cluster_sums(clusters, found, links)
    assert "Broadcast" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.cluster_id, r.n, r.link_m, r.n_border) for r in sums.collect()) == [(0, 3, 60.0, 1), (3, 3, 60.0, 1)]
