"""Patterns of patterns: runs compared by their parameters, and runs of those comparisons.

Tables: derps (line_id, fork, param, pos, step, i, p, d, m, rdn), one row for each
compared pair of runs and parameter; pps (line_id, fork, param, sign_fork, seg, …).
Everything stays within a line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.filters import DEFAULT, Filters
from gradus.functions.compare import direct_match, division_match, inverse_match

PARAMS = ("L", "I", "D", "M")
LINE = ["line_id", "fork"]


def normalised(runs: DataFrame) -> DataFrame:
    """I, D and M of every run as means over its length; pos counts a fork's runs."""
    mean = lambda c: F.col(c).cast("double") / F.col("L")
    return runs.select(*LINE, F.col("seg").alias("pos"), F.col("L").cast("double").alias("L"), mean("I").alias("I"), mean("D").alias("D"), mean("M").alias("M"), F.col("Rdn").alias("run_rdn"), "x0")


def compare_param(param: str, a: Column, b: Column, ave: float) -> tuple[Column, Column]:
    """(d, m) of a parameter's pair: ratio and division match for L, inverse match for I, direct for D and M."""
    if param == "L":
        return b / a, division_match(a, b, ave)
    return b - a, inverse_match(b - a, ave) if param == "I" else direct_match(a, b, ave)


def _step(param: str, fork: str) -> int:
    """Runs of one sign alternate, so the parameter that defines a fork is compared over two."""
    return 2 if (fork, param) in (("d", "D"), ("m", "M")) else 1


def cross_compare(runs: DataFrame, filters: Filters = DEFAULT, defining_step1: bool = False) -> DataFrame:
    """Comparisons of consecutive runs, all parameters in one pass, in long form.

    With defining_step1 the defining parameter's comparisons over one step too
    (column step tells them apart). Pairs that run over the line's end don't exist.
    """
    w = Window.partitionBy(*LINE).orderBy("pos")
    nexts = {f"{p}{k}": F.lead(p, k).over(w) for p in PARAMS for k in (1, 2)}
    wide = normalised(runs).withColumns(nexts)
    rows = []
    for p, ave in zip(PARAMS, filters.ave_params):
        for fork in "md":
            for step in sorted({_step(p, fork), 1} if defining_step1 else {_step(p, fork)}):
                a, b = F.col(p), F.col(f"{p}{step}")
                d, m = compare_param(p, a, b, ave)
                rows.append(F.when((F.col("fork") == fork) & b.isNotNull(), F.struct(F.lit(p).alias("param"), F.lit(step).alias("step"), a.alias("i"), (a + b).alias("p"), d.alias("d"), m.alias("m"))))
    return wide.withColumn("c", F.explode(F.array_compact(F.array(*rows)))).select(*LINE, "pos", "run_rdn", "x0", "c.*")


def redundancy(derps: DataFrame) -> DataFrame:
    """Adds rdn: over the pairs of parameters a comparison is in, 1 wherever it is the weaker, and the pair's preset.

    Strength is |d| in the d fork, else m; a missing comparison counts as 0; in a tie the first of a pair is weaker.
    """
    at = [*LINE, "pos"]
    w = Window.partitionBy(*at)
    strength = F.when(F.col("fork") == "d", F.abs("d")).otherwise(F.col("m"))
    main = derps.where(F.col("step") == F.when(((F.col("fork") == "d") & (F.col("param") == "D")) | ((F.col("fork") == "m") & (F.col("param") == "M")), 2).otherwise(1))
    valued = main.withColumn("s", strength)
    valued = valued.withColumns({f"s{p}": F.coalesce(F.max(F.when(F.col("param") == p, F.col("s"))).over(w), F.lit(0.0)) for p in PARAMS})
    f = F.when(F.col("fork") == "d", 1).otherwise(0)
    one, zero = F.lit(1), F.lit(0)
    alt = F.when(F.col("fork") == "d", F.lit("M")).otherwise(F.lit("D"))
    alt_s = F.when(F.col("fork") == "d", F.col("sM")).otherwise(F.col("sD"))
    pairs = [("I", F.lit("L"), F.col("sI"), F.col("sL"), f, zero), ("I", F.lit("D"), F.col("sI"), F.col("sD"), f, one - f), ("I", F.lit("M"), F.col("sI"), F.col("sM"), f, f), ("L", alt, F.col("sL"), alt_s, zero, one), ("D", F.lit("M"), F.col("sD"), F.col("sM"), one - f, f)]
    rdn = F.lit(0)
    for first, second, a, b, preset_a, preset_b in pairs:
        stronger = a > b
        rdn = rdn + F.when(F.col("param") == first, preset_a + F.when(stronger, 0).otherwise(1)).when(F.col("param") == second, preset_b + F.when(stronger, 1).otherwise(0)).otherwise(0)
    return valued.withColumn("rdn", rdn.cast("long")).drop("s", *(f"s{p}" for p in PARAMS))


def form_pps(derps: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Same-sign runs of comparisons, by match and by difference: 16 groups a line in one pass.

    Sums of L, I (p), D, M and Rdn, first position x0 and the first run's x0 (ix0).
    flay: the run is worth less than its members, V / (0.7 L) < V - L * ave; Rdn then counts L once more.
    """
    key = [*LINE, "param"]
    w = Window.partitionBy(*key).orderBy("pos")
    both = derps
    for s in "md":
        sign = F.col(s) > 0
        change = F.coalesce(sign != F.lag(sign).over(w), F.lit(True)).cast("long")
        both = both.withColumn(f"c{s}", change)
    both = both.withColumns({f"seg_{s}": F.sum(f"c{s}").over(w) - 1 for s in "md"})
    forks = F.array(*(F.struct(F.lit(s).alias("sign_fork"), F.col(f"seg_{s}").alias("seg")) for s in "md"))
    long = both.withColumn("_f", F.explode(forks)).select(*key, "_f.*", "pos", "x0", "p", "d", "m", (F.col("rdn") + F.col("run_rdn")).alias("r"))
    pps = long.groupBy(*key, "sign_fork", "seg").agg(
        F.count("*").alias("L"), F.sum("p").alias("I"), F.sum("d").alias("D"), F.sum("m").alias("M"), F.sum("r").alias("Rdn"), F.min("pos").alias("x0"), F.min_by("x0", "pos").alias("ix0")
    )
    v = F.when(F.col("sign_fork") == "d", F.abs("D")).otherwise(F.col("M"))
    cost = F.col("L") * filters.pp_M * F.when(F.col("sign_fork") == "d", F.lit(filters.pp_D)).otherwise(F.lit(0))
    pps = pps.withColumn("flay", v / (F.col("L") * 0.7) < v - cost)
    return pps.withColumn("Rdn", F.col("Rdn") + F.col("L") + F.col("L") * F.col("flay").cast("long"))


def second_level(runs: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Normalise, compare, weigh redundancy, form runs: the whole second level."""
    return form_pps(redundancy(cross_compare(runs, filters)), filters)


#: Rows of whole lines that are worked on at once.
AT_ONCE = 1 << 15


def _sweep(runs: pa.RecordBatch, filters: Filters) -> pa.RecordBatch:
    """second_level() of whole lines, each step of it on all their rows at once; whether a group is taken up (at least three runs, summed match over 4 * pp_M) comes with its rows.

    A value that isn't a number stands for null here, as no other comes up: sums pass it over, and it begins and ends a run.
    """
    pos, ix0, length = runs["seg"].to_numpy(), runs["x0"].to_numpy(), runs["L"].to_numpy().astype(float)
    n, by_d = len(pos), np.asarray(runs["fork"].to_numpy(zero_copy_only=False) == "d")
    new = np.ones(n, bool)
    new[1:] = by_d[1:] != by_d[:-1]
    for c in ("line_id", "path"):
        code = runs[c].dictionary_encode("encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    group = np.cumsum(new) - 1
    value = {"L": length} | {c: runs[c].to_numpy(zero_copy_only=False).astype(float) / length for c in "IDM"}
    rdn_own, counted = runs["Rdn"].fill_null(0).to_numpy(), runs["Rdn"].is_valid().to_numpy(zero_copy_only=False)
    there, p, d, m, s = {}, {}, {}, {}, {}
    for name, ave in zip(PARAMS, filters.ave_params):
        step = np.where(by_d, _step(name, "d"), _step(name, "m"))
        to = np.minimum(np.arange(n) + step, n - 1)
        a, b = value[name], value[name][to]
        there[name] = (np.arange(n) + step < n) & (group[to] == group) & ~np.isnan(b)
        p[name] = a + b
        if name == "L":
            d[name] = b / a
            r = np.maximum(d[name], 1.0 / d[name])
            m[name] = np.floor(r) * np.minimum(a, b) - (np.floor(r) * (r - np.floor(r))) / 2 - ave
        else:
            d[name] = b - a
            m[name] = ave - np.abs(d[name]) if name == "I" else np.minimum(a, b) - np.abs(b - a) / 2 - ave
        s[name] = np.where(there[name] & ~np.isnan(d[name]), np.where(by_d, np.abs(d[name]), m[name]), 0.0)
    f = by_d.astype(np.int64)
    rdn = {name: np.zeros(n, np.int64) for name in PARAMS}
    for a, b, preset_a, preset_b in (("I", "L", f, 0), ("I", "D", f, 1 - f), ("I", "M", f, f), ("D", "M", 1 - f, f)):
        stronger = s[a] > s[b]
        rdn[a] += preset_a + ~stronger
        rdn[b] += preset_b + stronger
    stronger = s["L"] > np.where(by_d, s["M"], s["D"])
    rdn["L"] += ~stronger
    rdn["M"] += by_d * (1 + stronger)
    rdn["D"] += ~by_d * (1 + stronger)
    out = []
    for k, name in enumerate(PARAMS):
        at = np.flatnonzero(there[name])
        if not len(at):
            continue
        of, r, void = group[at], np.where(counted[at], rdn[name][at] + rdn_own[at], 0), np.isnan(d[name][at])
        own = np.ones(len(at), bool)
        own[1:] = of[1:] != of[:-1]
        for by, sign in (("m", m[name][at] > 0), ("d", d[name][at] > 0)):
            change = own.copy()
            change[1:] |= (sign[1:] != sign[:-1]) | void[1:] | void[:-1]
            run, head = np.cumsum(change) - 1, np.flatnonzero(change)
            # sums in order of place, as those over rows are
            I, D, M = (np.where(void[head], np.nan, np.bincount(run, np.where(void, 0.0, x[name][at]))) for x in (p, d, m))
            L, rdn_of = np.bincount(run), np.add.reduceat(r, head)
            without = void[head] | (np.add.reduceat(counted[at].astype(int), head) == 0)
            first = run[np.flatnonzero(own)]
            part = np.cumsum(own[head]) - 1
            v, cost = (np.abs(D), L * filters.pp_M * filters.pp_D) if by == "d" else (M, 0)
            flay = v / (L * 0.7) < v - cost
            taken = ((np.bincount(part) >= 3) & (np.bincount(part, np.nan_to_num(M)) > 4 * filters.pp_M))[part]
            row, count = at[head], len(head)
            out.append((row, np.full(count, k), np.full(count, by == "d"), np.arange(count) - first[part], L, I, D, M, rdn_of + L + L * flay, pos[row], ix0[row], flay, taken, void[head], without))
    if not out:
        out = [tuple(np.empty(0, t) for t in (int, int, bool, int, int, float, float, float, int, int, int, bool, bool, bool, bool))]
    row, param, by, seg, L, I, D, M, Rdn, x0, ix0, flay, taken, void, without = (np.concatenate(c) for c in zip(*out))
    named = lambda codes, names: pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int8)), pa.array(names)).cast(pa.string())
    row = pa.array(row)
    sums = [pa.array(x, mask=void) for x in (I, D, M)]
    columns = [runs["fork"].take(row), named(param, PARAMS), named(by, ("m", "d")), pa.array(seg), pa.array(L), *sums, pa.array(Rdn, mask=without), pa.array(x0), pa.array(ix0)]
    columns += [pa.array(flay, mask=void), runs["line_id"].take(row), runs["path"].take(row), pa.array(taken)]
    return pa.RecordBatch.from_arrays(columns, ["fork", "param", "sign_fork", "seg", "L", "I", "D", "M", "Rdn", "x0", "ix0", "flay", "line_id", "path", "taken"])


def second_level_of_lines(filters: Filters = DEFAULT) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: second_level() of runs that come by line, path, fork and place; a line's rows are held together."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        due = AT_ONCE
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < due:
                continue
            rows = pa.concat_batches(held)
            line = rows["line_id"].dictionary_encode("encode").indices.to_numpy()
            cut = int(np.flatnonzero(line != line[-1])[-1]) + 1 if line[0] != line[-1] else 0
            if cut:
                yield _sweep(rows.slice(0, cut), filters)
            held = [rows.slice(cut)]
            due = max(AT_ONCE, 2 * len(held[0]))  # a long line isn't looked at again for each batch
        if sum(map(len, held)):
            yield _sweep(pa.concat_batches(held), filters)

    return sweep


#: Weights of the parameters' matches where runs of different parameters are compared (fixed values, L, I, D, M).
OVERLAP_WEIGHTS = (0.25, 0.5, 0.25, 0.5)


def overlap_pairs(pps: DataFrame, least: float = 0.5, filters: Filters = DEFAULT) -> DataFrame:
    """Runs of different parameters whose spans overlap by over ``least`` of their mean length, compared by L, I, D and M.

    One sweep over the starts: runs of a parameter don't overlap, so of each other parameter at most one run is open where a run starts, the last that
    started, and two runs overlap only if one is open at the other's start. One window finds it (runs that start together meet once),
    so rows grow with the runs, however long one of them is. match weighs inverse match of I and direct matches of the others.
    """
    order = {p: k for k, p in enumerate(PARAMS)}
    spans = pps.select("line_id", "fork", "sign_fork", "param", "seg", F.col("x0").alias("lo"), (F.col("x0") + F.col("L")).alias("hi"), "L", *(F.col(c).cast("double").alias(c) for c in "IDM"))
    sweep = Window.partitionBy("line_id", "fork", "sign_fork").orderBy("lo").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct("param", "seg", "lo", "hi", "L", "I", "D", "M")
    opened = spans.withColumns({f"open_{p}": F.last(F.when(F.col("param") == p, own), ignorenulls=True).over(sweep) for p in PARAMS})
    rank = F.create_map(*(x for p, k in order.items() for x in (F.lit(p), F.lit(k))))
    met = opened.withColumn("own", own).withColumn("o", F.explode(F.array(*(F.col(f"open_{p}") for p in PARAMS))))
    met = met.where((F.col("o.hi") > F.col("lo")) & (F.col("o.param") != F.col("param")) & ((F.col("o.lo") < F.col("lo")) | (rank[F.col("o.param")] < rank[F.col("param")])))
    first = rank[F.col("o.param")] < rank[F.col("param")]
    both = met.select("line_id", "fork", "sign_fork", F.when(first, F.col("o")).otherwise(F.col("own")).alias("a"), F.when(first, F.col("own")).otherwise(F.col("o")).alias("b"))
    olp = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    ratio = olp / ((F.col("a.L") + F.col("b.L")) / F.lit(2.0))
    match = difference = F.lit(0.0)
    for p, weight in zip(PARAMS, OVERLAP_WEIGHTS):
        x, y = F.col(f"a.{p}").cast("double"), F.col(f"b.{p}").cast("double")
        match = match + F.lit(weight) * (inverse_match(y - x, filters.ave) if p == "I" else direct_match(x, y, filters.ave_min))
        difference = difference + F.lit(weight) * (y - x)
    return both.where(ratio > least).select(
        "line_id", "fork", "sign_fork", F.col("a.param").alias("param_a"), F.col("a.seg").alias("seg_a"), F.col("b.param").alias("param_b"), F.col("b.seg").alias("seg_b"),
        olp.cast("long").alias("overlap"), (F.col("b.L") - F.col("a.L")).cast("long").alias("dL"), ratio.alias("ratio"), match.alias("match"), difference.alias("difference"),
    )


def overlap_clusters(pairs: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Overlapping pairs gathered over the parameters of their first runs, L, I and D in turn, while their match beats pp_M times all overlap so far.

    After each parameter that has pairs the gathered match is tested: if it beats the sum of all pairs' overlap ratios up to there, a cluster of the parameters
    gathered is put out and gathering goes on; else it starts again with nothing (the sum of overlap stays). Everything is a few
    sums a line and sign, so pairs are pre-aggregated where they are.
    """
    key, firsts = ["line_id", "fork", "sign_fork"], PARAMS[:-1]
    of = lambda c, p: F.coalesce(F.sum(F.when(F.col("param_a") == p, c)), F.lit(0))
    sums = pairs.groupBy(*key).agg(*(of(F.lit(1), p).alias(f"n_{p}") for p in firsts), *(of(F.col(c), p).cast("double").alias(f"{c}_{p}") for c in ("match", "ratio", "difference") for p in firsts))
    n, match, difference, ratio, gathered, kept = F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(""), []
    for p in firsts:
        some = F.col(f"n_{p}") > 0
        n, match, difference, ratio = n + F.col(f"n_{p}"), match + F.col(f"match_{p}"), difference + F.col(f"difference_{p}"), ratio + F.col(f"ratio_{p}")
        gathered = F.when(some, F.concat(gathered, F.lit(p))).otherwise(gathered)
        good = match > F.lit(float(filters.pp_M)) * ratio
        kept.append(F.when(some & good, F.struct(gathered.alias("params"), n.alias("n"), match.alias("match"), difference.alias("difference"), ratio.alias("overlap"))))
        goes_on = good | ~some
        n, match, difference, gathered = (F.when(goes_on, x).otherwise(F.lit(zero)) for x, zero in ((n, 0), (match, 0.0), (difference, 0.0), (gathered, "")))
    return sums.select(*key, F.explode(F.array_compact(F.array(*kept))).alias("c")).select(*key, "c.*")


def layer_sums(levels: DataFrame) -> DataFrame:
    """L, I, D, M of every top run's layers, by depth and fork."""
    root = F.when(F.col("parent") == "", F.concat("fork", F.col("seg").cast("string"))).otherwise(F.regexp_extract("parent", r"^([md]\d+)", 1))
    return levels.groupBy("line_id", root.alias("root"), "depth", "fork").agg(F.sum("L").alias("L"), F.sum("I").alias("I"), F.sum("D").cast("double").alias("D"), F.sum("M").cast("double").alias("M"))


def compare_layers(sums: DataFrame, filters: Filters = DEFAULT) -> DataFrame:
    """Consecutive top runs of a fork compared by their layers' sums: positive match and difference over cost."""
    fork, number = F.substring("root", 1, 1), F.substring("root", 2, 20).cast("long")
    named = sums.select("line_id", fork.alias("rf"), number.alias("n"), "depth", "fork", *(F.col(p).cast("double").alias(p) for p in PARAMS))
    after = named.select("line_id", "rf", (F.col("n") - 1).alias("n"), "depth", "fork", *(F.col(p).alias(f"{p}_b") for p in PARAMS))
    met = named.join(after, ["line_id", "rf", "n", "depth", "fork"])
    mv = dv = F.lit(0.0)
    for p, ave in zip(PARAMS, filters.ave_params):
        d, m = compare_param(p, F.col(p), F.col(f"{p}_b"), ave)
        mv, dv = mv + F.greatest(m, F.lit(0.0)), dv + F.greatest(F.abs(d) - F.lit(filters.pp_D), F.lit(0.0))
    return met.groupBy("line_id", "rf", "n").agg(F.sum(mv).alias("match"), F.sum(dv).alias("difference"), F.count("*").alias("n_layers"))


def search_range(derps: DataFrame, rng: int, filters: Filters = DEFAULT) -> DataFrame:
    """Each comparison against the next ones less than rng away, to the right only."""
    w = Window.partitionBy(*LINE, "param").orderBy("pos")
    out = F.array_compact(F.array(*(F.when(F.lead("i", k).over(w).isNotNull(), F.struct(F.lit(k).alias("dist"), F.lead("i", k).over(w).alias("j"))) for k in range(1, rng))))
    near = derps.withColumn("_n", out).withColumn("_n", F.explode("_n"))
    d = F.col("_n.j") - F.col("i")
    return near.select(*LINE, "param", "pos", F.col("_n.dist").alias("dist"), (F.col("i") + F.col("_n.j")).alias("p"), d.alias("d"), inverse_match(d, filters.pp_M).alias("m"))


def fixed_range(derps: DataFrame, rng: int, filters: Filters = DEFAULT) -> DataFrame:
    """Element k against k + rng; both ends gather the match and difference (mean over their links)."""
    w = Window.partitionBy(*LINE, "param").orderBy("pos")
    links = derps.select(*LINE, "param", "pos", "i", F.lead("pos", rng).over(w).alias("other"), F.lead("i", rng).over(w).alias("j")).where("other is not null")
    d = F.col("j") - F.col("i")
    links = links.select(*LINE, "param", "pos", "other", d.alias("d"), inverse_match(d, filters.pp_M).alias("m"))
    ends = links.select(*LINE, "param", F.explode(F.array("pos", "other")).alias("pos"), "d", "m")
    return ends.groupBy(*LINE, "param", "pos").agg(F.count("*").alias("n"), F.avg("d").alias("d"), F.avg("m").alias("m"))


def linked_clusters(spark, derps: DataFrame, rng: int = 1, filters: Filters = DEFAULT) -> DataFrame:
    """Single linkage over fixed-range links of positive match whose both ends match well on the mean."""
    from gradus.operators.components import components_within

    ends = fixed_range(derps, rng, filters).where(F.col("m") > filters.pp_M * 0.4).select(*LINE, "param", "pos")
    w = Window.partitionBy(*LINE, "param").orderBy("pos")
    links = derps.select(*LINE, "param", "pos", "i", F.lead("pos", rng).over(w).alias("other"), F.lead("i", rng).over(w).alias("j")).where("other is not null")
    good = links.where(inverse_match(F.col("j") - F.col("i"), filters.pp_M) > 0)
    good = good.join(ends, [*LINE, "param", "pos"]).join(ends.withColumnRenamed("pos", "other"), [*LINE, "param", "other"])
    return components_within(spark, good, [*LINE, "param"], "pos", "other").toDF(*LINE, "param", "pos", "first")
