"""Regions of one gradient direction inside a blob, weak ones merged into their most alike neighbours, strong ones spliced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters
from gradus.operators.blobs import adjacency, label_by_segments
from gradus.operators.components import components_within
from gradus.plans.scratch import Scratch, rounds

ROOT = ("frame_id", "root")
SUMS = ("area", "I", "G1000", "Dy4", "Dx4")


def direction_regions(spark: SparkSession, labelled: DataFrame) -> DataFrame:
    """Pixels of labelled blobs with root, their blob, and blob_id, the component of equal |dy| > |dx| inside it (eight neighbours where it holds, four where not)."""
    inside = labelled.withColumnRenamed("blob_id", "root").withColumn("s", F.abs("dy4") > F.abs("dx4"))
    return label_by_segments(spark, inside, ROOT)


def region_sums(labelled: DataFrame) -> DataFrame:
    """Sums and box of every region; parts counts the regions merged into it."""
    return labelled.groupBy(*ROOT, F.col("blob_id").alias("region")).agg(
        F.lit(1).cast("long").alias("parts"), F.count("*").alias("area"), F.sum("i").alias("I"), F.sum(F.round(F.col("g") * 1000).cast("long")).alias("G1000"), F.sum("dy4").alias("Dy4"), F.sum("dx4").alias("Dx4"),
        F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("yn"), F.max("x").alias("xn"),
    )


def strength(cost: float) -> Column:
    """Four times the larger of a region's |Dy| and |Dx|, less cost a pixel."""
    return F.greatest(F.abs("Dy4"), F.abs("Dx4")) - F.lit(4 * cost) * F.col("area")


def _alike() -> Column:
    """Cosine of the angle between two regions' summed gradients, 0 where one has none."""
    norm = lambda x: F.sqrt((F.col(f"{x}_Dy") * F.col(f"{x}_Dy") + F.col(f"{x}_Dx") * F.col(f"{x}_Dx")).cast("double"))
    dot = (F.col("a_Dy") * F.col("b_Dy") + F.col("a_Dx") * F.col("b_Dx")).cast("double")
    return F.when((norm("a") > 0) & (norm("b") > 0), dot / (norm("a") * norm("b"))).otherwise(0.0)


def _gathered(regions: DataFrame) -> DataFrame:
    """regions with a column ``into`` summed by it; strong if one of them is."""
    return regions.groupBy(*ROOT, F.col("into").alias("region")).agg(
        F.max("strong").alias("strong"), F.sum("parts").alias("parts"), *(F.sum(c).alias(c) for c in SUMS), *(F.min(c).alias(c) for c in ("y0", "x0")), *(F.max(c).alias(c) for c in ("yn", "xn"))
    )


def _components(spark: SparkSession, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(frame_id, root, region, into) of the regions in pairs (a, b): the least region that they reach."""
    return components_within(spark, pairs, list(ROOT)).toDF(*ROOT, "region", "into")


def merge_weak(spark: SparkSession, regions: DataFrame, pairs: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Regions after weak ones have gone into neighbours: sums, box and the number of parts; region is the least merged name.

    pairs are touching regions of a root, both ways. A region is weak if max(|Dy|, |Dx|) < ave_dir * area. In each round every weak
    region picks the neighbour whose summed gradient has the most alike direction (then the larger area, then the least name), all at once;
    regions joined by picks become one, with their sums and all their neighbours. One that holds a strong region is strong for good (opposite
    directions in its sums don't weaken it again); one of weak regions only is tested by its sums. It ends when no weak region has a neighbour.

    Picks look at one state only, so the order of rows doesn't matter. Every weak region with a neighbour merges in every round, so
    at least half of those that have one are gone after it, and rounds grow with the logarithm of the regions of a root.
    """
    scratch = Scratch(spark, "merge")
    tested = lambda x: x.withColumn("strong", F.col("strong") | (strength(filters.ave_dir) >= 0))
    regions, pairs = scratch.save(tested(regions.withColumn("strong", F.lit(False))), "regions0"), scratch.save(pairs.select(*ROOT, "a", "b"), "pairs0")
    for k in rounds():
        weak = regions.where("not strong").select(*ROOT, F.col("region").alias("a"), F.col("Dy4").alias("a_Dy"), F.col("Dx4").alias("a_Dx"))
        near = pairs.join(weak, [*ROOT, "a"]).join(regions.select(*ROOT, F.col("region").alias("b"), "area", F.col("Dy4").alias("b_Dy"), F.col("Dx4").alias("b_Dx")), [*ROOT, "b"])
        best = near.groupBy(*ROOT, "a").agg(F.min(F.struct((-_alike()).alias("unlike"), (-F.col("area")).alias("small"), "b")).alias("p"))
        picks = scratch.save(best.select(*ROOT, "a", F.col("p.b").alias("b")), f"picks{k}")
        if picks.isEmpty():
            return regions.drop("strong")
        moved = scratch.save(_components(spark, picks, scratch), f"moved{k}")
        into = F.coalesce("into", "region").alias("into")
        regions = scratch.save(tested(_gathered(regions.join(moved, [*ROOT, "region"], "left").withColumn("into", into))), f"regions{k}")
        lifted = pairs
        for c in ("a", "b"):
            to = moved.select(*ROOT, F.col("region").alias(c), F.col("into").alias(f"{c}_into"))
            lifted = lifted.join(to, [*ROOT, c], "left").withColumn(c, F.coalesce(f"{c}_into", c)).drop(f"{c}_into")
        pairs = scratch.save(lifted.where("a <> b").distinct(), f"pairs{k}")


def splice_strong(spark: SparkSession, regions: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Adds spliced, the least region of a root that a region reaches over splices (itself where it isn't spliced).

    Two regions are spliced if the strength of one is over ave_dir_splice (without a cost a pixel), one's box ends in the row above the other's first
    row, and their boxes overlap in x or lie side by side there.
    """
    strong = (strength(0) > 4 * filters.ave_dir_splice).alias("strong_a")
    upper = regions.select(*ROOT, F.col("region").alias("a"), (F.col("yn") + 1).alias("y"), F.col("x0").alias("a0"), F.col("xn").alias("an"), strong)
    lower = regions.select(*ROOT, F.col("region").alias("b"), F.col("y0").alias("y"), F.col("x0").alias("b0"), F.col("xn").alias("bn"), strong.alias("strong_b"))
    met = upper.join(lower, [*ROOT, "y"]).where((F.col("strong_a") | F.col("strong_b")) & (F.col("a0") - 1 < F.col("bn")) & (F.col("an") + 1 > F.col("b0")))
    found = _components(spark, met.select(*ROOT, "a", "b"), Scratch(spark, "splice"))
    return regions.join(found, [*ROOT, "region"], "left").withColumn("spliced", F.coalesce("into", "region")).drop("into")


def merged_directions(spark: SparkSession, labelled: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Direction regions of labelled blobs, weak ones merged and strong ones spliced."""
    regions = Scratch(spark, "directions").save(direction_regions(spark, labelled), "regions")
    merged = merge_weak(spark, region_sums(regions), adjacency(regions, within=ROOT), filters)
    return splice_strong(spark, merged, filters)
