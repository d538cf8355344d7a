"""Sub-runs of two compared runs searched against each other by nearness.

Runs come as rows of all levels (``runs.run_levels``); a pair is two consecutive top runs of a fork, and its sub-runs
are those of the first sublayer that came about in the same way (range or derivation), match runs against match runs and
difference runs against difference runs. Positions are within a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters
from gradus.operators.params import PARAMS, compare_param
from gradus.operators.runs import segment
from gradus.plans.scratch import Scratch, rounds

#: A pair of top runs: n and n + 1 of fork rf; its sub-runs: kind of increment, fork.
PAIR = ["line_id", "rf", "n"]
SUB = [*PAIR, "kind", "fork"]
#: Sub-runs looked at in the first round of a search; twice as many in each later one.
FIRST_LOOK, MOST_LOOKS = 8, 1024


def _over(d: Column, filters: Filters) -> Column:
    return F.greatest(F.abs(d) - F.lit(float(filters.pp_D)), F.lit(0.0))


def compared_pairs(levels: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Pairs of consecutive top runs of a fork: root_v, the summed positive match of their own parameters' means, and value_m, value_d, the
    positive matches and differences over cost of their layers' sums, of match sub-runs and of difference sub-runs.
    """
    top = levels.where("depth = 1").select("line_id", F.col("fork").alias("rf"), F.col("seg").alias("n"), "L", "Rdn", *(F.col(p).cast("double").alias(f"p_{p}") for p in PARAMS))
    w = Window.partitionBy("line_id", "rf").orderBy("n")
    mean = lambda p, x: F.col(f"{x}_{p}") / (F.lit(1.0) if p == "L" else F.col(f"{x}_L"))
    both = top.withColumns({f"q_{p}": F.lead(f"p_{p}").over(w) for p in PARAMS}).withColumns({"next_rdn": F.lead("Rdn").over(w), "least_L": F.least("L", F.lead("L").over(w))}).where("q_L is not null")
    matches = [compare_param(p, mean(p, "p"), mean(p, "q"), ave)[1] for p, ave in zip(PARAMS, filters.ave_params)]
    pairs = both.select("line_id", "rf", "n", "least_L", F.col("next_rdn").alias("rdn"), sum((F.greatest(m, F.lit(0.0)) for m in matches), F.lit(0.0)).alias("root_v"))

    root = F.regexp_extract("parent", r"^([md])(\d+)", 1), F.regexp_extract("parent", r"^([md])(\d+)", 2).cast("long")
    sums = levels.where("depth > 1").groupBy("line_id", root[0].alias("rf"), root[1].alias("n"), "depth", "fork").agg(*(F.sum(p).cast("double").alias(p) for p in PARAMS))
    after = sums.select("line_id", "rf", (F.col("n") - 1).alias("n"), "depth", "fork", *(F.col(p).alias(f"{p}_b") for p in PARAMS))
    met = sums.join(after, ["line_id", "rf", "n", "depth", "fork"])
    value = F.lit(0.0)
    for p, ave in zip(PARAMS, filters.ave_params):
        d, m = compare_param(p, F.col(p), F.col(f"{p}_b"), ave)
        value = value + F.when(F.col("fork") == "m", F.greatest(m, F.lit(0.0))).otherwise(_over(d, filters))
    values = met.groupBy(*PAIR).agg(*(F.coalesce(F.sum(F.when(F.col("fork") == f, value)), F.lit(0.0)).alias(f"value_{f}") for f in "md"))
    return pairs.join(values, PAIR)


def _stop(filters: Filters) -> Column:
    """What a search in the fork must exceed."""
    return F.when(F.col("fork") == "d", F.lit(float(filters.pp_M * filters.stop_D))).otherwise(F.lit(0.0))


def sub_pairs(levels: DataFrame, pairs: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Proximity-gated comparison of sub-runs (line_id, rf, n, kind, fork, seg_a, seg_b, side, step, and d_ and m_ of L, I, D, M).

    A pair of runs longer than ave_Ls takes part with a fork whose value + root_v exceeds the gate (stop, times Rdn). Each
    sub-run a of the first run is compared with those of the second whose centre isn't left of its own, nearest first (side 1),
    then with those left of it (side -1); equal centres go by seg. A search ends before the first b where V * distance / mean L * 2 isn't
    over stop; V is the mean M of both, or |mean D| - ave_d * mean L, plus root_v.

    Each round looks at the next 8, 16, 32, … sub-runs of the searches still open (an equi-join on their rank) and keeps those before
    the first that fails (a running minimum over the rank), so rows grow with what is compared, not with the product of both.
    """
    scratch = Scratch(levels.sparkSession, "sublayers")
    stop = _stop(filters)
    root = r"^([md])(\d+)([rd])$"
    part = lambda k: F.regexp_extract("parent", root, k)
    subs = levels.where((F.col("depth") == 2) & F.col("parent").rlike(root))
    subs = subs.select("line_id", part(1).alias("rf"), part(2).cast("long").alias("run"), part(3).alias("kind"), "fork", "seg", *(F.col(p).cast("double").alias(p) for p in PARAMS), (F.col("x0") + F.col("L") / 2).alias("centre"))
    value = F.when(F.col("fork") == "d", F.col("value_d")).otherwise(F.col("value_m"))
    open_ = pairs.where(F.col("least_L") > filters.ave_Ls).withColumnRenamed("n", "pair")
    side = lambda shift: subs.withColumn("pair", F.col("run") - shift).drop("run").join(open_, ["line_id", "rf", "pair"]).where(value + F.col("root_v") > stop * F.col("rdn")).withColumnRenamed("pair", "n")
    a, b = side(0), side(1)
    # how many b lie left of each a, in one pass over both
    both = a.select(*SUB, "seg", "centre", F.lit(0).alias("second")).unionByName(b.select(*SUB, "seg", "centre", F.lit(1).alias("second")))
    order = Window.partitionBy(*SUB).orderBy("centre", "second", "seg")
    placed = both.withColumn("rank", F.sum("second").over(order))
    first = placed.where("second = 0").select(*SUB, "seg", F.col("rank").alias("start"))
    ranked = scratch.save(
        b.select(*SUB, "seg", "centre", *PARAMS).join(placed.where("second = 1").select(*SUB, "seg", (F.col("rank") - 1).alias("rank")), [*SUB, "seg"])
        .select(*SUB, "rank", F.col("seg").alias("seg_b"), F.col("centre").alias("centre_b"), *(F.col(p).alias(f"{p}_b") for p in PARAMS)), "second",
    )
    sides = F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    left = a.select(*SUB, "seg", "centre", "root_v", *PARAMS).join(first, [*SUB, "seg"]).withColumnRenamed("seg", "seg_a").select("*", sides, F.lit(0).cast("long").alias("done"))
    left = scratch.save(left, "open0")
    found, look, out = None, FIRST_LOOK, []
    for k in rounds():
        step = F.explode(F.sequence(F.col("done"), F.col("done") + look - 1)).alias("step")
        asked = left.select("*", step).withColumn("rank", F.when(F.col("side") == 1, F.col("start") + F.col("step")).otherwise(F.col("start") - 1 - F.col("step")))
        met = asked.join(ranked, [*SUB, "rank"])
        length = (F.col("L") + F.col("L_b")) / 2
        worth = F.when(F.col("fork") == "d", F.abs((F.col("D") + F.col("D_b")) / 2) - F.lit(float(filters.pp_D)) * length).otherwise((F.col("M") + F.col("M_b")) / 2) + F.col("root_v")
        near = worth * (F.abs(F.col("centre_b") - F.col("centre")) / length) * 2 > stop
        search = Window.partitionBy(*SUB, "seg_a", "side").orderBy("step")
        passed = met.withColumn("ok", F.min(near.cast("int")).over(search)).where("ok = 1").drop("ok")
        passed = scratch.save(passed, f"passed{k}")
        out.append(passed)
        whole = passed.where(F.col("step") == F.col("done") + look - 1)
        left = scratch.save(whole.select(*SUB, "seg_a", "centre", "root_v", *PARAMS, "start", "side", (F.col("step") + 1).alias("done")), f"open{k}")
        look = min(2 * look, MOST_LOOKS)
        if left.isEmpty():
            break
    for x in out:
        found = x if found is None else found.unionByName(x)
    columns = []
    for p, ave in zip(PARAMS, filters.ave_params):
        d, m = compare_param(p, F.col(p), F.col(f"{p}_b"), ave)
        columns += [d.alias(f"d_{p}"), m.alias(f"m_{p}")]
    return found.select(*SUB, "seg_a", "seg_b", "side", "step", *columns)


def pair_values(pairs: DataFrame, found: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """What comparing the sublayers adds to a pair of runs: match and difference of the layers' sums and of the sub-runs, and how many of these."""
    m = sum((F.greatest(F.col(f"m_{p}"), F.lit(0.0)) for p in PARAMS), F.lit(0.0))
    d = sum((_over(F.col(f"d_{p}"), filters) for p in PARAMS), F.lit(0.0))
    sums = found.groupBy(*PAIR).agg(F.sum(m).alias("m"), F.sum(d).alias("d"), F.count("*").alias("n_subs"))
    out = pairs.join(sums, PAIR, "left")
    total = lambda v, c: F.col(v) + F.coalesce(F.col(c), F.lit(0.0))
    return out.select(*PAIR, "root_v", total("value_m", "m").alias("match"), total("value_d", "d").alias("difference"), F.coalesce("n_subs", F.lit(0)).alias("n_subs"))


def sub_runs(found: DataFrame) -> DataFrame:
    """The comparisons of each sub-run a and parameter, in the order of its search, as runs of equal sign of match: their count, sums and first place."""
    long = found.select(*SUB, "seg_a", F.struct((-F.col("side")).alias("side"), "step").alias("at"), F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(f"d_{p}").alias("d"), F.col(f"m_{p}").alias("m")) for p in PARAMS))).alias("x"))
    long = long.select(*SUB, "seg_a", "at", "x.*")
    cut = segment(long, [*SUB, "seg_a", "param"], "at", F.col("m") > 0, "pp")
    return cut.groupBy(*SUB, "seg_a", "param", "pp").agg(F.count("*").alias("L"), F.sum("d").alias("D"), F.sum("m").alias("M"))
