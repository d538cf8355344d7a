import random
from collections import Counter

from pyspark.sql import functions as F

from gradus.filters import Filters
from gradus.operators import hierarchy, params
from gradus.plans import graph_queries, sequence_queries

SMALL = "/root/testdata/sf0.001"


def test_lines_are_merged_a_batch_at_a_time(spark):
    plan = sequence_queries.l1_merged(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_a_level_is_one_shuffle(spark, monkeypatch):
    plans = []
    save = hierarchy.Scratch.save

    def seen(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name)

    monkeypatch.setattr(hierarchy.Scratch, "save", seen)
    got = graph_queries.l3_levels(spark, SMALL)
    assert len(plans) > 2 and all(p.count("Exchange") <= 1 and "Join" not in p for p in plans[1:])
    assert got.where("level > 2 and path = ''").count() == 0 and got.where("level = 2").count() > 0


def test_levels_of_many_lines_at_once(spark, monkeypatch):
    """Lines swept together give the rows of second_level(), nulls in values, redundancies and line names included."""
    rng = random.Random(3)
    some = lambda v: None if rng.random() < 0.1 else v
    runs = [
        (line, path, fork, seg, rng.randint(1, 5), some(rng.randint(-90, 900)), some(rng.randint(-99, 99)), some(rng.randint(-99, 99)), some(rng.randint(0, 9)), 3 * seg)
        for line in (None, 3, 7, 8) for path in ("", "mI") for fork in "md" for seg in range(rng.choice((1, 2, 40)))
    ]
    table = spark.createDataFrame(runs, "line_id long, path string, fork string, seg long, L long, I long, D long, M long, Rdn long, x0 long")
    filters = Filters(ave=35, pp_M=1, ave_params=(0.5, -60, -60, -60))
    want = params.second_level(table.withColumn("line_id", F.struct("line_id", "path")), filters).select("line_id.*", "*").drop("line_id")
    names = ["path", "fork", "param", "sign_fork", "seg", "L", "I", "D", "M", "Rdn", "x0", "ix0", "flay"]
    plain = lambda rows: Counter(tuple(r[c] for c in names) for r in rows)
    ordered = table.coalesce(1).sortWithinPartitions("line_id", "path", "fork", "seg").toArrow()
    for at_once, size in ((1 << 15, 1000), (1, 7), (30, 11)):
        monkeypatch.setattr(params, "AT_ONCE", at_once)
        got = [r for b in params.second_level_of_lines(filters)(iter(ordered.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert plain(got) == plain(want.collect()) and len(got) > 200
        assert {r["line_id"] for r in got} <= {None, 3, 7, 8}
