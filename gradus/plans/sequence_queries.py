"""Registered queries over sequences, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.filters import Filters
from gradus.operators import params, runs, sublayers
from gradus.plans.scratch import Scratch
from gradus.sources.tables import event_lines, order_lines, vector_lines

#: Median absolute step of the events is about 35.
EVENTS = Filters(ave=35)
#: Low costs, so that both increments take place on these data.
LOW = Filters(ave=35, ave_M=-30, ave_D=1)
ORDERS = Filters(ave=60)
#: Steps of the vectors' values are about 20.
VECTORS = Filters(ave=20, ave_M=-30, ave_D=1)
#: Overlaps of runs of different parameters seldom match at the usual cost.
OVERLAPS = Filters(ave=20, ave_min=0, pp_M=-2)

EV = "line AS (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x, round(value)::BIGINT AS i FROM events)"
OR = "line AS (SELECT o_custkey AS line_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS x, floor(o_totalprice / 1000)::BIGINT AS i FROM orders)"

VE = "line AS (SELECT vec_id AS line_id, k - 1 AS x, floor(embedding[k]::DOUBLE * 128 + 128)::BIGINT AS i FROM embeddings, range(1, 65) AS r(k))"


def derts_sql(source: str, ave: int) -> str:
    return f"""{source},
pair AS (SELECT *, lag(i) OVER (PARTITION BY line_id ORDER BY x) AS prior FROM line),
dert AS (SELECT line_id, '' AS parent, x - 1 AS pos, i, i + prior AS p, i - prior AS d, {ave} - abs(i - prior) AS m, {ave} - abs(i - prior) < 0 AS mrdn FROM pair WHERE prior IS NOT NULL)"""


def runs_sql(source: str, ave: int, of: str = "dert", out: str = "") -> str:
    """CTEs member{out} (derts by fork and seg) and run{out}."""
    head = derts_sql(source, ave) + ",\n" if source else ""
    return head + f"""chg{out} AS (
  SELECT *, coalesce((m > 0) <> lag(m > 0) OVER w, true)::INT AS cm, coalesce((d > 0) <> lag(d > 0) OVER w, true)::INT AS cd
  FROM {of} WINDOW w AS (PARTITION BY line_id, parent ORDER BY pos)),
sg{out} AS (
  SELECT *, sum(cm) OVER w - 1 AS seg_m, sum(cd) OVER w - 1 AS seg_d FROM chg{out} WINDOW w AS (PARTITION BY line_id, parent ORDER BY pos)),
member{out} AS (
  SELECT line_id, parent, 'm' AS fork, seg_m::BIGINT AS seg, pos, i, p, d, m, mrdn FROM sg{out}
  UNION ALL SELECT line_id, parent, 'd', seg_d::BIGINT, pos, i, p, d, m, mrdn FROM sg{out}),
run{out} AS (
  SELECT line_id, parent, fork, seg, count(*) AS L, sum(p)::BIGINT AS I, sum(d)::BIGINT AS D, sum(m) AS M, (1 + sum(mrdn::INT))::BIGINT AS Rdn, min(pos) AS x0
  FROM member{out} GROUP BY ALL)"""


RUN_COLUMNS = "line_id, fork, seg, L, I, D, M::BIGINT AS M, Rdn, x0"
SUB_COLUMNS = "line_id, parent, fork, seg, L, I, D, M::DOUBLE AS M, Rdn, x0"


def _increment(kind: str, f: Filters, name: str) -> str:
    """CTEs up to {name}: derts of the range (r) or derivation (d) increment of the runs that qualify."""
    gate = range_gate_sql(f) if kind == "r" else derivation_gate_sql(f)
    out = f"""ok{kind} AS (SELECT * FROM run WHERE {gate}),
own{kind} AS (
  SELECT mem.*, row_number() OVER (PARTITION BY mem.line_id, mem.parent, mem.fork, mem.seg ORDER BY pos) - 1 AS nth
  FROM member mem JOIN ok{kind} USING (line_id, parent, fork, seg)),
"""
    if kind == "r":
        return out + f"""taken{kind} AS (SELECT *, lag(i) OVER (PARTITION BY line_id, parent, fork, seg ORDER BY pos) AS prior FROM own{kind} WHERE nth % 2 = 0),
{name} AS (SELECT line_id, parent || fork || seg || 'r' AS parent, nth // 2 - 1 AS pos, i, p + prior AS p, d + i - prior AS d,
         {2 * f.ave} - abs(d + i - prior) AS m, {2 * f.ave} - abs(d + i - prior) < 0 AS mrdn FROM taken{kind} WHERE prior IS NOT NULL),
"""
    return out + f"""taken{kind} AS (SELECT *, abs(d) AS a, lag(abs(d)) OVER (PARTITION BY line_id, parent, fork, seg ORDER BY pos) AS prior FROM own{kind}),
{name} AS (SELECT line_id, parent || fork || seg || 'd' AS parent, nth - 1 AS pos, d AS i, a + prior AS p, a - prior AS d,
         least(a, prior) - abs((a - prior) / 2.0::DOUBLE) - {f.ave_min} AS m, least(a, prior) - abs((a - prior) / 2.0::DOUBLE) - {f.ave_min} < 0 AS mrdn FROM taken{kind} WHERE prior IS NOT NULL),
"""


def range_gate_sql(f: Filters) -> str:
    return f"M - Rdn * ({f.ave_M}) * L > ({f.ave_M}) AND L > 2"


def derivation_gate_sql(f: Filters) -> str:
    return f"abs(D) - (L - Rdn) * {f.ave_D} * L > {f.ave_D} AND L > 1"


def _sub(kind: str) -> str:
    return runs_sql(EV, LOW.ave) + ",\n" + _increment(kind, LOW, "sub") + runs_sql("", 0, "sub", "2")


RANGE_GATE = range_gate_sql(LOW)
DERIVATION_GATE = derivation_gate_sql(LOW)


def _event_runs(spark, sf, f=EVENTS):
    return runs.form_runs(runs.adjacent_compare(event_lines(spark, sf), f))


def l1_derts(spark, sf):
    return runs.adjacent_compare(event_lines(spark, sf), EVENTS).drop("parent")


def l1_pm_runs(spark, sf):
    return _event_runs(spark, sf).where("fork = 'm'").drop("parent")


def l1_pd_runs(spark, sf):
    return _event_runs(spark, sf).where("fork = 'd'").drop("parent")


def l1_order_runs(spark, sf):
    return runs.form_runs(runs.adjacent_compare(order_lines(spark, sf), ORDERS)).drop("parent")


def l1_rng_gate(spark, sf):
    return _event_runs(spark, sf, LOW).where(runs.range_gate(LOW)).drop("parent")


def l1_der_gate(spark, sf):
    return _event_runs(spark, sf, LOW).where(runs.derivation_gate(LOW)).drop("parent")


def _sub_runs(derts):
    return runs.form_runs(derts).withColumn("M", F.col("M").cast("double"))


def l1_rng2_runs(spark, sf):
    return _sub_runs(runs.range_compare(runs.adjacent_compare(event_lines(spark, sf), LOW), LOW))


def l1_der2_runs(spark, sf):
    return _sub_runs(runs.derivative_compare(runs.adjacent_compare(event_lines(spark, sf), LOW), LOW))


def l1_levels(spark, sf):
    return runs.run_levels(runs.adjacent_compare(event_lines(spark, sf), LOW), LOW)


def l1_exclusive(spark, sf):
    return runs.exclusive_levels(runs.adjacent_compare(event_lines(spark, sf), LOW), LOW)


def l1_adjacent_match(spark, sf):
    return runs.adjacent_match(_event_runs(spark, sf).where("fork = 'm'")).select("line_id", "seg", "M", "adj_M")


def l1_splice_value(spark, sf):
    return runs.splice_value(_event_runs(spark, sf)).select("line_id", "fork", "seg", F.round("splice", 6).alias("splice"))


def l1_merged(spark, sf):
    return runs.merge_triples(_event_runs(spark, sf), Filters(ave_splice=0.5)).drop("parent")


def l1_merged_in_order(spark, sf):
    return runs.merge_triples(_event_runs(spark, sf), Filters(ave_splice=0.5), order="position").drop("parent")


def l1_bilateral(spark, sf):
    return runs.bilateral_compare(event_lines(spark, sf), EVENTS)


def l1_fuzzy(spark, sf):
    return runs.fuzzy_compare(event_lines(spark, sf), EVENTS, rng=3)


def l1_rval_clusters(spark, sf):
    return runs.relative_value_runs(_event_runs(spark, sf, LOW), LOW).drop("parent")


def l1_length_percentiles(spark, sf):
    return runs.length_percentiles(_event_runs(spark, sf))


def l1_recursion_counts(spark, sf):
    return runs.recursion_counts(l1_levels(spark, sf))


def l2_param_derps(spark, sf):
    return params.cross_compare(_event_runs(spark, sf), EVENTS).select("line_id", "fork", "param", "pos", "i", "p", "d", "m")


def l2_redundancy(spark, sf):
    return params.redundancy(params.cross_compare(_event_runs(spark, sf), EVENTS)).select("line_id", "fork", "param", "pos", "rdn")


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 4) + 0.0 for c in names})


def l2_pp_runs(spark, sf):
    return params.second_level(_event_runs(spark, sf), EVENTS).select("line_id", "fork", "param", "sign_fork", "seg", "L", "Rdn", "x0", "ix0", "flay")


def l2_overlap_pairs(spark, sf):
    found = params.overlap_pairs(params.second_level(_event_runs(spark, sf), EVENTS))
    return found.drop("ratio", "match", "difference")


def _vector_levels(spark, sf):
    """Top runs of the vectors' lines and their first sublayer."""
    levels = runs.run_levels(runs.adjacent_compare(vector_lines(spark, sf), VECTORS), VECTORS, depth=2)
    return Scratch(spark, "vectors").save(levels, "levels")


def l2_sub_pairs(spark, sf):
    levels = _vector_levels(spark, sf)
    found = sublayers.sub_pairs(levels, sublayers.compared_pairs(levels, VECTORS), VECTORS)
    return _rounded(found, *(f"{v}_{p}" for v in "dm" for p in params.PARAMS))


def l2_sublayers(spark, sf):
    scratch, levels = Scratch(spark, "sublayers"), _vector_levels(spark, sf)
    pairs = scratch.save(sublayers.compared_pairs(levels, VECTORS), "pairs")
    found = scratch.save(sublayers.sub_pairs(levels, pairs, VECTORS), "found")
    positive = sublayers.sub_runs(found).where("M > 0").groupBy(*sublayers.PAIR).agg(F.count("*").alias("n_runs"), F.sum("L").alias("runs_L"))
    out = sublayers.pair_values(pairs, found, VECTORS).join(positive, sublayers.PAIR, "left").fillna(0, ["n_runs", "runs_L"])
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("root_v", "match", "difference")})


def _vector_overlaps(spark, sf):
    found = params.form_pps(params.redundancy(params.cross_compare(runs.form_runs(runs.adjacent_compare(vector_lines(spark, sf), VECTORS)), VECTORS)), VECTORS)
    return params.overlap_pairs(found, filters=OVERLAPS)


def l2_overlap_values(spark, sf):
    return _vector_overlaps(spark, sf).withColumns({c: F.round(c, 6) + 0.0 for c in ("ratio", "match", "difference")})


def l2_overlap_clusters(spark, sf):
    found = params.overlap_clusters(_vector_overlaps(spark, sf), OVERLAPS)
    return found.withColumns({c: F.round(c, 6) + 0.0 for c in ("match", "difference", "overlap")})


def l2_fixed_range(spark, sf):
    return _rounded(params.fixed_range(params.cross_compare(_event_runs(spark, sf), EVENTS), 2), "d", "m")


def l2_search_range(spark, sf):
    return params.search_range(params.cross_compare(_event_runs(spark, sf), EVENTS), 3)


def l2_linked_clusters(spark, sf):
    return params.linked_clusters(spark, params.cross_compare(_event_runs(spark, sf), EVENTS))


def l2_layer_match(spark, sf):
    return params.compare_layers(params.layer_sums(l1_levels(spark, sf)), EVENTS)


QUERIES = {
    f.__name__: f
    for f in (
        l1_derts, l1_pm_runs, l1_pd_runs, l1_order_runs, l1_rng_gate, l1_der_gate, l1_rng2_runs, l1_der2_runs, l1_levels, l1_exclusive,
        l1_adjacent_match, l1_splice_value, l1_merged, l1_merged_in_order, l1_bilateral, l1_fuzzy, l1_rval_clusters, l1_length_percentiles,
        l1_recursion_counts, l2_param_derps, l2_redundancy, l2_pp_runs, l2_overlap_pairs, l2_fixed_range, l2_search_range, l2_linked_clusters, l2_layer_match,
        l2_sub_pairs, l2_sublayers, l2_overlap_values, l2_overlap_clusters,
    )
}

_EV_RUNS = "WITH " + runs_sql(EV, EVENTS.ave)
_VE_RUNS = "WITH " + runs_sql(VE, VECTORS.ave)
_LOW_RUNS = "WITH " + runs_sql(EV, LOW.ave)
_A = EVENTS.ave_params
_DERPS = _EV_RUNS + f""",
n AS (SELECT line_id, fork, seg AS pos, L::DOUBLE AS L, I::DOUBLE / L AS I, D::DOUBLE / L AS D, M::DOUBLE / L AS M, Rdn AS run_rdn, x0 FROM run),
nx AS (
  SELECT *, lead(L) OVER w AS L1, lead(I) OVER w AS I1, lead(D, CASE fork WHEN 'd' THEN 2 ELSE 1 END) OVER w AS D1, lead(M, CASE fork WHEN 'm' THEN 2 ELSE 1 END) OVER w AS M1
  FROM n WINDOW w AS (PARTITION BY line_id, fork ORDER BY pos)),
derp AS (
  SELECT line_id, fork, 'L' AS param, pos, run_rdn, x0, L AS i, L + L1 AS p, L1 / L AS d,
         floor(greatest(L1 / L, 1.0::DOUBLE / (L1 / L))) * least(L, L1) - (floor(greatest(L1 / L, 1.0::DOUBLE / (L1 / L))) * (greatest(L1 / L, 1.0::DOUBLE / (L1 / L)) - floor(greatest(L1 / L, 1.0::DOUBLE / (L1 / L))))) / 2.0::DOUBLE - {_A[0]}::DOUBLE AS m
  FROM nx WHERE L1 IS NOT NULL
  UNION ALL SELECT line_id, fork, 'I', pos, run_rdn, x0, I, I + I1, I1 - I, {_A[1]}::DOUBLE - abs(I1 - I) FROM nx WHERE I1 IS NOT NULL
  UNION ALL SELECT line_id, fork, 'D', pos, run_rdn, x0, D, D + D1, D1 - D, least(D, D1) - abs(D1 - D) / 2.0::DOUBLE - {_A[2]}::DOUBLE FROM nx WHERE D1 IS NOT NULL
  UNION ALL SELECT line_id, fork, 'M', pos, run_rdn, x0, M, M + M1, M1 - M, least(M, M1) - abs(M1 - M) / 2.0::DOUBLE - {_A[3]}::DOUBLE FROM nx WHERE M1 IS NOT NULL)"""
_RDN = _DERPS + """,
st AS (SELECT *, CASE fork WHEN 'd' THEN abs(d) ELSE m END AS s FROM derp),
pv AS (
  SELECT line_id, fork, pos, coalesce(max(s) FILTER (param = 'L'), 0) AS sl, coalesce(max(s) FILTER (param = 'I'), 0) AS si,
         coalesce(max(s) FILTER (param = 'D'), 0) AS sd, coalesce(max(s) FILTER (param = 'M'), 0) AS sm FROM st GROUP BY ALL),
w AS (
  SELECT *, (fork = 'd')::INT AS f, (si > sl)::INT AS il, (si > sd)::INT AS id, (si > sm)::INT AS im, (sl > CASE fork WHEN 'd' THEN sm ELSE sd END)::INT AS la, (sd > sm)::INT AS dm FROM pv),
rd AS (
  SELECT line_id, fork, pos, 'L' AS param, il + (1 - la) AS rdn FROM w
  UNION ALL SELECT line_id, fork, pos, 'I', 3 * f + (1 - il) + (1 - id) + (1 - im) FROM w
  UNION ALL SELECT line_id, fork, pos, 'D', (1 - f + id) + (1 - f + 1 - dm) + CASE fork WHEN 'm' THEN 1 + la ELSE 0 END FROM w
  UNION ALL SELECT line_id, fork, pos, 'M', (f + im) + (f + dm) + CASE fork WHEN 'd' THEN 1 + la ELSE 0 END FROM w),
dr AS (SELECT st.*, rd.rdn::BIGINT AS rdn FROM st JOIN rd USING (line_id, fork, pos, param))"""
_PPS = _RDN + f""",
c2 AS (
  SELECT *, coalesce((m > 0) <> lag(m > 0) OVER w, true)::INT AS cm, coalesce((d > 0) <> lag(d > 0) OVER w, true)::INT AS cd
  FROM dr WINDOW w AS (PARTITION BY line_id, fork, param ORDER BY pos)),
s2 AS (SELECT *, sum(cm) OVER w - 1 AS seg_m, sum(cd) OVER w - 1 AS seg_d FROM c2 WINDOW w AS (PARTITION BY line_id, fork, param ORDER BY pos)),
lg AS (SELECT *, 'm' AS sign_fork, seg_m::BIGINT AS seg FROM s2 UNION ALL SELECT *, 'd', seg_d::BIGINT FROM s2),
pp0 AS (
  SELECT line_id, fork, param, sign_fork, seg, count(*) AS L, sum(d ORDER BY pos) AS D, sum(m ORDER BY pos) AS M, sum(rdn + run_rdn)::BIGINT AS r, min(pos) AS x0, arg_min(x0, pos) AS ix0 FROM lg GROUP BY ALL),
pp1 AS (SELECT *, CASE sign_fork WHEN 'd' THEN abs(D) ELSE M END AS v FROM pp0),
pp2 AS (SELECT *, v / (L * 0.7::DOUBLE) < v - L * {EVENTS.pp_M} * CASE sign_fork WHEN 'd' THEN {EVENTS.pp_D} ELSE 0 END AS flay FROM pp1),
pp AS (SELECT *, r + L + L * flay::INT AS Rdn FROM pp2)"""
_VALUE = f"CASE fork WHEN 'm' THEN (M - Rdn * ({LOW.ave_M}) * L)::DOUBLE ELSE (abs(D) - (L - Rdn) * {LOW.ave_D} * L)::DOUBLE END"
_SPLICE = _EV_RUNS + """,
v AS (SELECT line_id, fork, seg, (CASE fork WHEN 'm' THEN M ELSE D END)::DOUBLE AS v2, L FROM run),
a AS (SELECT *, v2 / L AS a2 FROM v),
n AS (SELECT *, lag(v2) OVER w AS v1, lead(v2) OVER w AS v3, lag(a2) OVER w AS a1, lead(a2) OVER w AS a3 FROM a WINDOW w AS (PARTITION BY line_id, fork ORDER BY seg)),
g AS (SELECT *, abs((v1 + v3) / CASE WHEN v2 = 0 THEN 0.1::DOUBLE ELSE v2 END) AS cont, abs((least(a1, a2) - abs(a2 - a1) / 2) + (least(a2, a3) - abs(a3 - a2) / 2)) AS gap FROM n WHERE v1 IS NOT NULL AND v3 IS NOT NULL)
SELECT line_id, fork, seg, round((least(a1, a3) - abs(a3 - a1) / 2) * cont / CASE WHEN gap = 0 THEN 0.1::DOUBLE ELSE gap END, 6) AS splice FROM g"""
_DIST = "(VALUES (1), (2), (3)) AS k(k)"

def _match(p: str, a: str, b: str, ave: float) -> str:
    """Match of parameter p of two runs."""
    if p == "L":
        r = f"greatest({b} / {a}, 1.0::DOUBLE / ({b} / {a}))"
        return f"floor({r}) * least({a}, {b}) - (floor({r}) * ({r} - floor({r}))) / 2.0::DOUBLE - {ave}::DOUBLE"
    return f"{ave}::DOUBLE - abs({b} - {a})" if p == "I" else f"least({a}, {b}) - abs({b} - {a}) / 2.0::DOUBLE - {ave}::DOUBLE"


def _difference(p: str, a: str, b: str) -> str:
    return f"{b} / {a}" if p == "L" else f"{b} - {a}"


_P = list(zip(params.PARAMS, VECTORS.ave_params))
_CUT = float(VECTORS.pp_D)
_MV = " + ".join(f"greatest({_match(p, f'a.{p}', f'b.{p}', v)}, 0.0::DOUBLE)" for p, v in _P)
_DV = " + ".join(f"greatest(abs({_difference(p, f'a.{p}', f'b.{p}')}) - {_CUT}::DOUBLE, 0.0::DOUBLE)" for p, _ in _P)
_OWN = " + ".join(f"greatest({_match(p, *((f'a.{p}::DOUBLE', f'b.{p}::DOUBLE') if p == 'L' else (f'(a.{p}::DOUBLE / a.L)', f'(b.{p}::DOUBLE / b.L)')), v)}, 0.0::DOUBLE)" for p, v in _P)
_STOP = f"CASE fork WHEN 'd' THEN {VECTORS.pp_M * VECTORS.stop_D}::DOUBLE ELSE 0.0::DOUBLE END"
_VALUE_SUB = f"(CASE fork WHEN 'd' THEN abs((a.D + b.D) / 2) - {_CUT}::DOUBLE * ((a.L + b.L) / 2) ELSE (a.M + b.M) / 2 END + a.root_v)"
_SUB_PAIRS = f"""{_VE_RUNS},
{_increment("r", VECTORS, "subr")}{_increment("d", VECTORS, "subd")}sub AS (SELECT line_id, parent, pos, i, p, d, m::DOUBLE AS m, mrdn FROM subr UNION ALL SELECT line_id, parent, pos, i, p, d, m::DOUBLE, mrdn FROM subd),
{runs_sql("", 0, "sub", "2")},
own AS (SELECT a.line_id, a.fork AS rf, a.seg AS n, least(a.L, b.L) AS least_L, b.Rdn AS rdn, {_OWN} AS root_v FROM run a JOIN run b ON b.line_id = a.line_id AND b.fork = a.fork AND b.seg = a.seg + 1),
sr AS (
  SELECT line_id, regexp_extract(parent, '^([md])(\\d+)([rd])$', 1) AS rf, regexp_extract(parent, '^([md])(\\d+)([rd])$', 2)::BIGINT AS run, regexp_extract(parent, '^([md])(\\d+)([rd])$', 3) AS kind, fork, seg,
         L::DOUBLE AS L, I::DOUBLE AS I, D::DOUBLE AS D, M::DOUBLE AS M, x0 + L / 2 AS centre FROM run2),
ly AS (SELECT line_id, rf, run, fork, sum(L) AS L, sum(I) AS I, sum(D) AS D, sum(M) AS M FROM sr GROUP BY ALL),
lv AS (
  SELECT a.line_id, a.rf, a.run AS n, coalesce(sum(CASE a.fork WHEN 'm' THEN {_MV} END), 0) AS value_m, coalesce(sum(CASE a.fork WHEN 'd' THEN {_DV} END), 0) AS value_d
  FROM ly a JOIN ly b ON b.line_id = a.line_id AND b.rf = a.rf AND b.run = a.run + 1 AND b.fork = a.fork GROUP BY ALL),
pairs AS (SELECT own.*, value_m, value_d FROM own JOIN lv USING (line_id, rf, n)),
sa AS (SELECT sr.*, run AS n, root_v FROM sr JOIN pairs ON pairs.line_id = sr.line_id AND pairs.rf = sr.rf AND pairs.n = run WHERE least_L > {VECTORS.ave_Ls} AND CASE fork WHEN 'd' THEN value_d ELSE value_m END + root_v > ({_STOP}) * rdn),
sc AS (
  SELECT a.line_id, a.rf, a.n, a.kind, fork, a.seg AS seg_a, b.seg AS seg_b, CASE WHEN b.centre >= a.centre THEN 1 ELSE -1 END AS side, b.centre AS cb,
         {_VALUE_SUB} * (abs(b.centre - a.centre) / ((a.L + b.L) / 2)) * 2 > {_STOP} AS ok, {", ".join(f"{_difference(p, f'a.{p}', f'b.{p}')} AS d_{p}, {_match(p, f'a.{p}', f'b.{p}', v)} AS m_{p}" for p, v in _P)},
         {_MV} AS mv, {_DV} AS dv
  FROM sa a JOIN sr b USING (fork) WHERE b.line_id = a.line_id AND b.rf = a.rf AND b.run = a.n + 1 AND b.kind = a.kind),
sw AS (
  SELECT *, min(ok::INT) OVER s AS open, row_number() OVER s - 1 AS step FROM sc
  WINDOW s AS (PARTITION BY line_id, rf, n, kind, fork, seg_a, side ORDER BY side * cb, side * seg_b)),
found AS (SELECT * FROM sw WHERE open = 1)"""


def _pps_sql(runs_of: str) -> str:
    """The CTEs of _PPS over other runs."""
    return _PPS.replace(_EV_RUNS, runs_of)


_OLP = " + ".join(
    f"{w}::DOUBLE * ({f'{OVERLAPS.ave} - abs(b.I - a.I)' if p == 'I' else f'least(a.{p}::DOUBLE, b.{p}::DOUBLE) - abs(b.{p} - a.{p}) / 2.0::DOUBLE - {OVERLAPS.ave_min}'})" for p, w in zip(params.PARAMS, params.OVERLAP_WEIGHTS)
)
_OLD = " + ".join(f"{w}::DOUBLE * (b.{p} - a.{p})" for p, w in zip(params.PARAMS, params.OVERLAP_WEIGHTS))
_OVERLAPS = f"""{_pps_sql(_VE_RUNS).replace("sum(d ORDER BY pos) AS D", "sum(p ORDER BY pos) AS I, sum(d ORDER BY pos) AS D")},
sp AS (SELECT *, x0 AS lo, x0 + L AS hi, position(param IN 'LIDM') AS o FROM pp),
olp AS (
  SELECT a.line_id, a.fork, a.sign_fork, a.param AS param_a, a.seg AS seg_a, b.param AS param_b, b.seg AS seg_b, (least(a.hi, b.hi) - greatest(a.lo, b.lo))::BIGINT AS overlap, (b.L - a.L)::BIGINT AS dL,
         (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / ((a.L + b.L) / 2.0::DOUBLE) AS ratio, {_OLP} AS match, {_OLD} AS difference
  FROM sp a JOIN sp b ON a.line_id = b.line_id AND a.fork = b.fork AND a.sign_fork = b.sign_fork AND a.o < b.o AND greatest(a.lo, b.lo) < least(a.hi, b.hi)
  WHERE (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / ((a.L + b.L) / 2.0::DOUBLE) > 0.5)"""


def _clusters_sql() -> str:
    """The gathering over L, I and D, one CTE a parameter."""
    sums = ", ".join(f"coalesce(sum({c}) FILTER (param_a = '{p}'), 0) AS {n}_{p}" for p in "LID" for c, n in (("1", "n"), ("match", "m"), ("difference", "d"), ("ratio", "r")))
    out = f"{_OVERLAPS},\nt0 AS (SELECT line_id, fork, sign_fork, 0 AS n, 0.0::DOUBLE AS match, 0.0::DOUBLE AS difference, 0.0::DOUBLE AS overlap, '' AS params, false AS good, {sums} FROM olp GROUP BY ALL)"
    for k, p in enumerate("LID", 1):
        out += f""",
u{k} AS (SELECT * REPLACE (n + n_{p} AS n, match + m_{p} AS match, difference + d_{p} AS difference, overlap + r_{p} AS overlap, params || CASE WHEN n_{p} > 0 THEN '{p}' ELSE '' END AS params, match + m_{p} > {float(OVERLAPS.pp_M)} * (overlap + r_{p}) AS good) FROM t{k - 1}),
t{k} AS (SELECT * REPLACE (CASE WHEN good OR n_{p} = 0 THEN n ELSE 0 END AS n, CASE WHEN good OR n_{p} = 0 THEN match ELSE 0 END AS match, CASE WHEN good OR n_{p} = 0 THEN difference ELSE 0 END AS difference, CASE WHEN good OR n_{p} = 0 THEN params ELSE '' END AS params) FROM u{k})"""
    return out + "\n" + " UNION ALL ".join(f"SELECT line_id, fork, sign_fork, params, n::BIGINT AS n, round(match, 6) + 0.0 AS match, round(difference, 6) + 0.0 AS difference, round(overlap, 6) + 0.0 AS overlap FROM u{k} WHERE good AND n_{p} > 0" for k, p in enumerate("LID", 1))


ORACLES = {
    "l2_sub_pairs": f"""{_SUB_PAIRS} SELECT line_id, rf, n, kind, fork, seg_a, seg_b, side::INT AS side, step::BIGINT AS step, {", ".join(f"round({v}_{p}, 4) + 0.0 AS {v}_{p}" for v in "dm" for p, _ in _P)} FROM found""",
    "l2_sublayers": f"""{_SUB_PAIRS},
s AS (SELECT line_id, rf, n, sum(mv) AS m, sum(dv) AS d, count(*) AS n_subs FROM found GROUP BY ALL),
lo AS (SELECT line_id, rf, n, kind, fork, seg_a, side, step, unnest(['L', 'I', 'D', 'M']) AS param, unnest([m_L, m_I, m_D, m_M]) AS m FROM found),
lc AS (SELECT *, coalesce((m > 0) <> lag(m > 0) OVER w, true)::INT AS c FROM lo WINDOW w AS (PARTITION BY line_id, rf, n, kind, fork, seg_a, param ORDER BY -side, step)),
ln AS (SELECT *, sum(c) OVER (PARTITION BY line_id, rf, n, kind, fork, seg_a, param ORDER BY -side, step) AS pp FROM lc),
lr AS (SELECT line_id, rf, n, count(*) AS L, sum(m) AS M FROM ln GROUP BY line_id, rf, n, kind, fork, seg_a, param, pp),
lp AS (SELECT line_id, rf, n, count(*) AS n_runs, sum(L)::BIGINT AS runs_L FROM lr WHERE M > 0 GROUP BY ALL)
SELECT pairs.line_id, pairs.rf, pairs.n, round(root_v, 6) + 0.0 AS root_v, round(value_m + coalesce(m, 0), 6) + 0.0 AS match, round(value_d + coalesce(d, 0), 6) + 0.0 AS difference,
       coalesce(n_subs, 0)::BIGINT AS n_subs, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(runs_L, 0)::BIGINT AS runs_L
FROM pairs LEFT JOIN s USING (line_id, rf, n) LEFT JOIN lp USING (line_id, rf, n)""",
    "l2_overlap_values": f"{_OVERLAPS} SELECT * REPLACE (round(ratio, 6) + 0.0 AS ratio, round(match, 6) + 0.0 AS match, round(difference, 6) + 0.0 AS difference) FROM olp",
    "l2_overlap_clusters": _clusters_sql(),
    "l1_derts": f"WITH {derts_sql(EV, EVENTS.ave)} SELECT line_id, pos, i, p, d, m, mrdn FROM dert",
    "l1_pm_runs": f"{_EV_RUNS} SELECT {RUN_COLUMNS} FROM run WHERE fork = 'm'",
    "l1_pd_runs": f"{_EV_RUNS} SELECT {RUN_COLUMNS} FROM run WHERE fork = 'd'",
    "l1_order_runs": f"WITH {runs_sql(OR, ORDERS.ave)} SELECT {RUN_COLUMNS} FROM run",
    "l1_rng_gate": f"{_LOW_RUNS} SELECT {RUN_COLUMNS} FROM run WHERE {RANGE_GATE}",
    "l1_der_gate": f"{_LOW_RUNS} SELECT {RUN_COLUMNS} FROM run WHERE {DERIVATION_GATE}",
    "l1_rng2_runs": f"WITH {_sub('r')} SELECT {SUB_COLUMNS} FROM run2",
    "l1_der2_runs": f"WITH {_sub('d')} SELECT {SUB_COLUMNS} FROM run2",
    "l1_adjacent_match": f"""{_EV_RUNS} SELECT line_id, seg, M::BIGINT AS M,
  (coalesce(abs(lag(M) OVER w), 0) + coalesce(abs(lead(M) OVER w), 0))::DOUBLE / 2 AS adj_M
FROM run WHERE fork = 'm' WINDOW w AS (PARTITION BY line_id ORDER BY seg)""",
    "l1_splice_value": _SPLICE,
    "l1_bilateral": f"""WITH {EV}, b AS (SELECT *, {EVENTS.ave} - abs(i - lag(i) OVER w) AS l, {EVENTS.ave} - abs(lead(i) OVER w - i) AS r FROM line WINDOW w AS (PARTITION BY line_id ORDER BY x))
SELECT line_id, x, i, (coalesce(l, 0.5 * r) + coalesce(r, 0.5 * l))::DOUBLE AS m FROM b WHERE l IS NOT NULL OR r IS NOT NULL""",
    "l1_fuzzy": f"""WITH {EV}, t AS (SELECT a.line_id, a.x, a.i, b.i AS j FROM line a LEFT JOIN line b ON a.line_id = b.line_id AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.x <> a.x)
SELECT line_id, x, i, coalesce(sum(i - j), 0)::BIGINT AS d, coalesce(sum({EVENTS.ave} - abs(i - j)), 0)::BIGINT AS m, count(j) AS n FROM t GROUP BY ALL""",
    "l1_rval_clusters": f"""{_LOW_RUNS}, v AS (SELECT *, {_VALUE} AS value FROM run),
c AS (SELECT *, coalesce((value > 0) <> lag(value > 0) OVER w, true)::INT AS c FROM v WINDOW w AS (PARTITION BY line_id, fork ORDER BY seg)),
s AS (SELECT *, sum(c) OVER (PARTITION BY line_id, fork ORDER BY seg) - 1 AS rseg FROM c)
SELECT line_id, fork, rseg::BIGINT AS rseg, count(*) AS n_runs, sum(L)::BIGINT AS L, sum(value) AS value, sum(I)::BIGINT AS I, sum(D)::BIGINT AS D, sum(M)::BIGINT AS M, min(x0) AS x0 FROM s GROUP BY ALL""",
    "l1_length_percentiles": f"{_EV_RUNS} SELECT fork, quantile_cont(L, 0.05) AS p5, quantile_cont(L, 0.16) AS p16, quantile_cont(L, 0.84) AS p84, quantile_cont(L, 0.95) AS p95 FROM run GROUP BY fork",
    "l2_param_derps": f"{_DERPS} SELECT line_id, fork, param, pos, i, p, d, m FROM derp",
    "l2_redundancy": f"{_RDN} SELECT line_id, fork, param, pos, rdn FROM dr",
    "l2_pp_runs": f"{_PPS} SELECT line_id, fork, param, sign_fork, seg, L, Rdn, x0, ix0, flay FROM pp",
    "l2_overlap_pairs": f"""{_PPS}, sp AS (SELECT line_id, fork, sign_fork, param, seg, x0 AS lo, x0 + L AS hi, L, position(param IN 'LIDM') AS o FROM pp)
SELECT a.line_id, a.fork, a.sign_fork, a.param AS param_a, a.seg AS seg_a, b.param AS param_b, b.seg AS seg_b, (least(a.hi, b.hi) - greatest(a.lo, b.lo))::BIGINT AS overlap, (b.L - a.L)::BIGINT AS dL
FROM sp a JOIN sp b ON a.line_id = b.line_id AND a.fork = b.fork AND a.sign_fork = b.sign_fork AND a.o < b.o AND greatest(a.lo, b.lo) < least(a.hi, b.hi)
WHERE (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / ((a.L + b.L) / 2.0::DOUBLE) > 0.5""",
    "l2_search_range": f"""{_DERPS}, k AS (SELECT *, unnest([1, 2]) AS dist, unnest([lead(i, 1) OVER w, lead(i, 2) OVER w]) AS j FROM derp WINDOW w AS (PARTITION BY line_id, fork, param ORDER BY pos))
SELECT line_id, fork, param, pos, dist::INT AS dist, i + j AS p, j - i AS d, {EVENTS.pp_M} - abs(j - i) AS m FROM k WHERE j IS NOT NULL""",
    "l2_fixed_range": f"""{_DERPS}, k AS (SELECT line_id, fork, param, pos, lead(pos, 2) OVER w AS other, lead(i, 2) OVER w - i AS d FROM derp WINDOW w AS (PARTITION BY line_id, fork, param ORDER BY pos)),
e AS (SELECT line_id, fork, param, unnest([pos, other]) AS pos, d, {EVENTS.pp_M} - abs(d) AS m FROM k WHERE other IS NOT NULL)
SELECT line_id, fork, param, pos, count(*) AS n, round(avg(d), 4) + 0.0 AS d, round(avg(m), 4) + 0.0 AS m FROM e GROUP BY ALL""",
}
