import math

from gradus.operators import graph
from gradus.plans import graph_queries


def test_angles_on_a_sector_border(spark):
    """Angles whose last digit Java's atan2 has otherwise than the C library."""
    others = [(y, x) for n in range(1, 60) for k in range(1, 60) for y, x in ((n / k, (n / k) * (1 + 2.2e-16)), (n / k, -(n / k) * (1 - 2.2e-16)), (-(n / k), (n / k) * (1 - 2.2e-16)))]
    nodes = spark.createDataFrame([(g, 2 * g + k, *(at if k else (0.0, 0.0))) for g, at in enumerate(others) for k in (0, 1)], "group long, node_id long, y double, x double")
    links = spark.createDataFrame([(g, 2 * g, 2 * g + 1, 1.0) for g in range(len(others))], "group long, a long, b long, dist double")
    got = {r.node_id: r.sector for r in graph.nearest_by_direction(nodes, links).collect()}
    assert {2 * g: got[2 * g] for g in range(len(others))} == {2 * g: math.floor(math.atan2(y, x) / (2 * math.pi / 8)) % 8 for g, (y, x) in enumerate(others)}


def test_thousandths_of_decimal_ties(spark):
    values = [-2113485.2375, -1063039.9625, -531294.7625, 0.0005, -0.0001, 1.5]
    got = [r.v for r in graph_queries._thousandths(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    assert got == [-2113485.237, -1063039.962, -531294.762, 0.001, 0.0, 1.5] and math.copysign(1, got[4]) == 1


def test_angles_of_links_are_the_c_librarys(spark):
    """Cosines and turns to the last digit: a link's difference multiplies it by up to 10^9 before it is rounded."""
    nodes = [(0, k, 0.0, float(k), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, float(k * k % 97 - 40), float(k * 31 % 89 - 50)) for k in range(60)]
    names = ("group", "node_id", "y", "x", "c", "r", "span", "n", "M", "D", "I", "G", "dy", "dx")
    table = spark.createDataFrame(nodes, ", ".join(f"{c} {'long' if c in ('group', 'node_id') else 'double'}" for c in names))
    pairs = spark.createDataFrame([(0, a, b, 1.0) for a in range(60) for b in range(a + 1, 60)], "group long, a long, b long, dist double")
    for r in graph.compare_nodes(pairs, table).collect():
        turn = math.atan2(*nodes[r.a][-2:]) - math.atan2(*nodes[r.b][-2:])
        turn = math.atan2(math.sin(turn), math.cos(turn))
        assert (r.m_A, r.d_A) == ((math.cos(turn) + 1) / 2, turn / math.pi)
