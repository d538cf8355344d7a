"""Blobs compared with others beyond their neighbours, at costs that decay with distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters
from gradus.functions.compare import angle_match, direct_match
from gradus.plans.scratch import Scratch, rounds

FEATURES = ["area", "i", "angle", "g", "size"]


def features(blobs: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """frame_id, blob_id, area, M (match of its gradient against the average) and what is compared: mean intensity, angle, mean gradient, log of area."""
    area = F.col("area").cast("double")
    return blobs.select(
        "frame_id", "blob_id", area.alias("area"), (F.lit(float(filters.ave_g)) * area - F.col("G1000") / F.lit(1000.0)).alias("M"), (F.col("I") / area).alias("i"),
        F.atan2(F.col("Dy4").cast("double"), F.col("Dx4").cast("double")).alias("angle"), (F.col("G1000") / area / F.lit(1000.0)).alias("g"), F.log1p(area).alias("size"),
    )


def decayed_match(distance: Column, filters: Filters = DEFAULT) -> tuple[Column, Column]:
    """(match, difference) of the blobs a and b in columns a_… and b_…: each cost times ave_rM ^ ((1 + distance) / sqrt(area of a))."""
    decay = F.pow(F.lit(filters.ave_rM), (F.lit(1.0) + distance) / F.sqrt("a_area"))
    of_i, of_angle, of_g, of_size = (F.lit(float(x)) * decay for x in filters.ave_blob)
    d_i, d_g = F.col("b_i") - F.col("a_i"), F.col("b_g") - F.col("a_g")
    alike = angle_match("a_angle", "b_angle")
    match = (of_i - F.abs(d_i)) + (alike - of_angle) + (direct_match("a_g", "b_g", 0) - of_g) + (direct_match("a_size", "b_size", 0) - of_size)
    return match, F.abs(d_i) + (F.lit(1.0) - alike) + F.abs(d_g)


def decayed_search(pairs: DataFrame, blobs: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """(frame_id, a, b, hop, distance, neg, m, d): what every blob a meets when it searches on through neighbours that don't match it.

    pairs is the adjacency in both directions. A blob is compared with its neighbours at distance 0. From a neighbour b of match
    m <= 0 it searches on to b's neighbours while M of a plus all match met on the way, m included, is over ave_mB; the way's distance
    grows by sqrt(area of b), and costs decay with it. A positive match ends the way. Nothing is met twice by a blob: whoever is met by several ways
    at once is met by the best (most match on the way, then least distance, then least name of the last blob).

    All blobs search at once, a round a hop: the open ends are joined with the adjacency, known pairs drop out, each round is written to the shared
    folder. Match on the way falls with every hop, so a search ends by itself; blobs that nothing touches have no rows.
    """
    scratch = Scratch(pairs.sparkSession, "reach")
    side = lambda x: blobs.select("frame_id", F.col("blob_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in FEATURES), *([F.col("M").alias("a_M")] if x == "a" else []))
    known = scratch.save(features(blobs, filters), "features")
    blobs, steps = known, scratch.save(pairs.select("frame_id", F.col("a").alias("via"), "b"), "pairs")
    open_ = blobs.select("frame_id", F.col("blob_id").alias("a"), F.col("blob_id").alias("via"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("neg"))
    met: list[DataFrame] = []
    for hop in rounds():
        ways = open_.join(steps, ["frame_id", "via"]).where("a <> b")
        if met:
            ways = ways.join(reduce(DataFrame.unionByName, [x.select("frame_id", "a", "b") for x in met]), ["frame_id", "a", "b"], "left_anti")
        best = ways.groupBy("frame_id", "a", "b").agg(F.min(F.struct((-F.col("neg")).alias("loss"), "distance", "via")).alias("w"))
        both = best.select("frame_id", "a", "b", F.col("w.distance").alias("distance"), (-F.col("w.loss")).alias("neg")).join(side("a"), ["frame_id", "a"]).join(side("b"), ["frame_id", "b"])
        match, difference = decayed_match(F.col("distance"), filters)
        found = both.select("frame_id", "a", "b", F.lit(hop).alias("hop"), "distance", "neg", match.alias("m"), difference.alias("d"), "a_M", "b_area")
        met.append(scratch.save(found, f"hop{hop}"))
        on = (F.col("m") <= 0) & (F.col("a_M") + F.col("neg") + F.col("m") > filters.ave_mB)
        open_ = met[-1].where(on).select("frame_id", "a", F.col("b").alias("via"), (F.col("distance") + F.sqrt("b_area")).alias("distance"), (F.col("neg") + F.col("m")).alias("neg"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, met).drop("a_M", "b_area")
