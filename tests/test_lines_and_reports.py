"""Running order with branches and loops against a plain walk, waits, geometry and reports."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from crowdloom.operators import journeys as J
from crowdloom.operators import quality as Q


def plain_walk(follows, start, ends):
    """follows: {node: [(rank, node), ...]}."""
    path = [start]
    while len(path) == 1 or path[-1] not in ends:
        free = sorted((v in ends, rank, v) for rank, v in follows.get(path[-1], []) if v not in path)
        if not free:
            break
        path.append(free[0][2])
    return path


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_running_order_is_the_plain_walk(spark, seed):
    random.seed(seed)
    lines, rows, starts, ends = {}, [], [], []
    for k in range(12):
        nodes = [f"n{i:02d}" for i in range(random.choice([2, 5, 14, 30]))]
        pairs = {(a, b) for a, b in zip(nodes, nodes[1:])} | {(b, a) for a, b in zip(nodes, nodes[1:]) if random.random() < 0.7}
        pairs |= {tuple(random.sample(nodes, 2)) for _ in range(len(nodes) // 3)}
        follows = {}
        for a, b in sorted(pairs):
            rank = random.randrange(4)
            follows.setdefault(a, []).append((rank, b))
            rows.append((f"l{k}", a, b, rank))
        stop = set(random.sample(nodes, random.choice([0, 1, 2])))
        start = random.choice(nodes)
        lines[f"l{k}"] = plain_walk(follows, start, stop)
        starts.append((f"l{k}", start))
        ends += [(f"l{k}", x) for x in stop]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    out = J.running_order(frame(starts, "line_id string, node string"), frame(rows, "line_id string, from_node string, to_node string, rank int"), frame(ends, "line_id string, node string"))
    got = {}
    for r in out.orderBy("pos").collect():
        got.setdefault(r["line_id"], []).append((r["pos"], r["node"]))
    assert got == {k: list(enumerate(path)) for k, path in lines.items()}


def test_walk_passes_a_ring_once_and_enters_the_end_last(spark):
    """On a ring whose end is beside its start the walk goes round; a node met again is left out."""
    ring = ["a", "b", "c", "d"]
    rows = [("2", x, y, 0) for x, y in zip(ring, ring[1:] + ring[:1])] + [("2", y, x, -1) for x, y in zip(ring, ring[1:] + ring[:1])]
    follows = spark.createDataFrame([(p, x, y, x, y, r) for p in ("2/up",) for _, x, y, r in rows], "pattern string, from_node string, to_node string, from_station string, to_station string, rank int")
    asked = spark.createDataFrame([("2/up", "a", "d"), ("2/none", "a", "d"), ("2/lost", "a", "x")], "pattern string, start string, end string")
    out = J.line_patterns(asked, follows).orderBy("pos").collect()
    assert [(r["pattern"], r["node"]) for r in out] == [("2/up", x) for x in "abcd"]
    assert J.line_patterns(asked, follows.limit(0)).count() == 0


def test_waits_fall_back_are_held_and_count_only_after_a_walk(spark):
    segments = spark.createDataFrame(
        [(1, 1, 1, "A", "s1", "up", 0), (1, 1, 2, "walk", "s2", None, 0), (1, 1, 3, "B", "s2", "up", 0), (1, 1, 4, "walk", "s3", None, 0), (1, 1, 5, "C", "s3", "down", 0), (1, 1, 6, "D", "s4", "down", 0),
         (1, 2, 1, "A", "s1", "up", 0), (2, 1, 1, "A", "s1", "up", 1), (2, 1, 2, "walk", "s2", None, 1), (2, 1, 3, "B", "s2", "up", 1), (2, 1, 4, "walk", "s9", None, 1), (2, 1, 5, "E", "s9", "up", 1)],
        "request_id long, rank int, segment long, line string, from_station string, direction string, day_type int",
    )
    at_station = spark.createDataFrame([("A", "s1", "up", 0, 5.0), ("B", "s2", "up", 0, 2.26), ("B", "s2", "up", 1, None)], "line string, from_station string, direction string, day_type int, wait double")
    of_line = spark.createDataFrame([("B", "up", 0, 9.0), ("B", "up", 1, 3.0), ("C", "down", 0, 40.0), ("D", "down", 0, 1.0)], "line string, direction string, day_type int, wait double")
    out = J.chained_waits(segments, [(at_station, ["line", "from_station", "direction", "day_type"]), (of_line, ["line", "direction", "day_type"])])
    assert {tuple(r) for r in out.collect()} == {(1, 1, 2, 14.3, 0), (1, 2, 0, 0.0, 0), (2, 1, 2, 3.0, 1)}


def test_edge_geometry_rings_returns_and_connectors(spark):
    order = spark.createDataFrame([("2", "main", k, f"2_{x}") for k, x in enumerate("abcd")] + [("6", "main", k, f"6_{x}") for k, x in enumerate("ax")] + [("6", "side", 1, "6_s")], "line_id string, branch string, path_order int, node string")
    points = spark.createDataFrame([(n, i, 2 * i) for i, n in enumerate(["2_a", "2_b", "2_d", "6_a", "6_x", "6_s"])], "node string, x int, y int")
    rings = spark.createDataFrame([("2", "main")], "line_id string, branch string")
    returns = spark.createDataFrame([("2", "2_a", "2_b", "2_d"), ("6", "6_x", "6_a", "6_s")], "line_id string, after_node string, next_node string, node string")
    links = spark.createDataFrame([("2_a", "6_a"), ("2_c", "6_a")], "from_node string, to_node string")
    out = J.edge_geometry(order, points, rings, returns, links)
    got = {(r["kind"], r["from_node"], r["to_node"], r["x0"], r["y1"]) for r in out.collect()}
    assert got == {("line", "2_a", "2_d", 0, 4), ("line", "2_d", "2_b", 2, 2), ("line", "2_d", "2_a", 2, 0), ("line", "6_a", "6_x", 3, 8), ("connector", "2_a", "6_a", 0, 6), ("connector", "2_c", "6_a", None, 6)}


def test_names_scope_and_one_way_stations(spark):
    day = datetime.date
    cells = spark.createDataFrame(
        [(1, 10, "x", "up", day(2020, 1, 1)), (1, 10, "x", "down", day(2021, 1, 1)), (1, 10, "y", "up", day(2021, 1, 1)), (1, 11, "z", "up", day(2020, 1, 1)), (1, 11, "z", "down", day(2021, 1, 1)), (2, 11, "z", "up", day(2021, 1, 1)), (2, 11, None, "down", day(2020, 1, 1))],
        "line int, code int, name string, direction string, seen date",
    )
    names = Q.alias_candidates(cells, ["line", "code"], "name", "seen")
    assert {tuple(r) for r in names.collect()} == {(1, 10, "x", day(2020, 1, 1), day(2021, 1, 1), 2, 2), (1, 10, "y", day(2021, 1, 1), day(2021, 1, 1), 1, 2)}
    assert {tuple(r) for r in Q.scope_check(cells, "line", "code", "direction").collect()} == {(1, 2, 10, 11, "down|up"), (2, 1, 11, 11, "down|up")}
    assert {tuple(r) for r in Q.single_direction(cells, ["line", "code"], "direction", "seen").collect()} == {(1, 11, "down"), (2, 11, "up")}
    assert Q.alias_candidates(cells.where(F.lit(False)), ["line", "code"], "name", "seen").count() == 0
