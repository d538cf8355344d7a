"""Mixing sources to target weights with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEEDS = 32
#: A table of this many sources (a few hundred bytes each) may be broadcast.
BROADCAST_SOURCES = 20_000
DRAW = 2**28


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _draws(seeds: int) -> list[Column]:
    """Draws in [0, 1) of every seed from one hash of the document."""
    return [((F.col("h1") + F.lit(s) * F.col("h2")) % DRAW) / F.lit(float(DRAW)) for s in range(seeds)]


def sized(docs: DataFrame) -> DataFrame:
    """Size, source key and two 28-bit hash values of every document."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))
    return docs.withColumns(
        {
            "size": word_count("text"),
            "no_source": F.col("source").isNull(),
            "source_key": F.coalesce(F.col("source"), F.lit("")),
            "h1": F.conv(F.substring(digest, 1, 7), 16, 10).cast("long"),
            "h2": F.conv(F.substring(digest, 8, 7), 16, 10).cast("long") * 2 + 1,
        }
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Target words per source.

    Sources in code point order, null last, take the weights in turn. A source's
    target is its weight's share of all words, at most ``most`` times its own
    words; what is cut off is shared among the rest by weight. With the sources
    in order of cap per weight this is one level for all: the largest of
    (words - caps before) / (weights from here on). The window spans one row a source.
    """
    own = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "source_key")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    own = own.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return own.select("no_source", "source_key", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_REPEATS,
    seeds: int = SEEDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Copies of each document that bring its source to its target.

    A document is taken floor(rate) times plus once more if a draw from its hash
    is below the rate's fraction, so reruns agree. Of ``seeds`` draws each source
    uses the one whose sum comes nearest to its target (the lowest in a tie).
    Returns doc_id, size, source_size, target, copies, taken and the columns in
    ``keep``.

    Sums per source are pre-aggregated before the shuffle, so a hot source costs
    a row a task. The table of sources is broadcast only if counted to hold at
    most BROADCAST_SOURCES rows; beyond that documents join it salted.
    Null text has size 0 and takes part; a null source is a source of its own;
    null and repeated doc_ids are kept, equal rows share a draw; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    names = list(dict.fromkeys(["doc_id", *keep]))
    base = sized(docs.select(*dict.fromkeys([*names, "text", "source"])))
    kept = {f"k{i}": c for i, c in enumerate(names)}
    base = base.select(*(F.col(c).alias(k) for k, c in kept.items()), "size", "no_source", "source_key", "h1", "h2")
    base = scratch.save(base, "sizes")
    plan = scratch.save(targets(base, weights, most), "targets")
    small = plan.count() <= BROADCAST_SOURCES
    key = ["no_source", "source_key"]

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        if small:
            return left.join(F.broadcast(right), key)
        salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        return left.withColumn("salt", F.pmod(F.col("h1"), F.lit(64)).cast("int")).join(salted, [*key, "salt"]).drop("salt")

    sums = [F.sum(F.when(u < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{i}") for i, u in enumerate(_draws(seeds))]
    tried = with_source(base, plan).groupBy(*key, "source_size", "target", "whole", "part").agg(*sums)
    miss = F.array(*(F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{i}") - F.col("target")).alias("miss"), F.lit(i).alias("seed")) for i in range(seeds)))
    chosen = tried.select(*key, "source_size", "target", "whole", "part", F.array_min(miss)["seed"].alias("seed"))
    chosen = scratch.save(chosen, "chosen")
    draw = ((F.col("h1") + F.col("seed") * F.col("h2")) % DRAW) / F.lit(float(DRAW))
    copies = (F.col("whole") + (draw < F.col("part")).cast("long")).alias("copies")
    out = with_source(base, chosen).select(*kept, "size", "source_size", "target", copies)
    renamed = [F.col(k).alias(c) for k, c in kept.items()]
    return out.select(*renamed, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    columns = docs.columns
    # renamed, so that no column of the documents clashes with the operator's own
    inner = docs.select("doc_id", "text", "source", *(F.col(c).alias(f"own_{i}") for i, c in enumerate(columns)))
    taken = mix(inner, keep=[f"own_{i}" for i in range(len(columns))], **options)
    taken = taken.where("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(columns)))
