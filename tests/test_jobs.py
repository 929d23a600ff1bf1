"""Jobs on small tables worked out by hand or by brute force."""

import hashlib
import random

import pytest
from crowdloom.operators import evaluation, impact, journeys, marts, network, routes
from crowdloom.sources.scratch import written
from pyspark.sql import functions as F


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 10), ("b", 20), ("c", 20), ("d", None)], "n string, v int")
    got = {r["n"]: r["r"] for r in marts.average_rank(df, "v", "r").collect()}
    assert got["a"] == 1 / 3 and got["b"] == got["c"] == 2.5 / 3 and got["d"] is None
    assert marts.average_rank(df.where("v is null"), "v", "r").collect()[0]["r"] is None
    random.seed(2)
    values = [random.randrange(400) for _ in range(900)]
    for r in marts.average_rank(spark.createDataFrame([(v,) for v in values], "v int"), "v", "r", buckets=7).collect():
        lower, ties = sum(v < r["v"] for v in values), values.count(r["v"])
        assert abs(r["r"] - (lower + 1 + (ties - 1) / 2) / 900) < 1e-12


def test_hold_out_against_a_full_sort(spark):
    units = spark.createDataFrame([(k % 500,) for k in range(700)], "u int")
    order = sorted(range(500), key=lambda u: (hashlib.md5(f"{u}s".encode()).hexdigest(), u))
    got = marts.hold_out(units, "u", 0.31, "s").collect()
    assert len(got) == 700 and {r["u"] for r in got if r["held_out"]} == set(order[:155])
    assert marts.hold_out(units.where("u < 0"), "u", 0.31, "s").count() == 0


def test_look_back_months(spark):
    monthly = spark.sql("select explode(sequence(date'2024-10-01', date'2025-05-01', interval 1 month)) as ym, 1 as k, 2.0 as m")
    snaps = spark.sql("select date'2025-03-31' as snapshot_date")
    assert marts.look_back(monthly, snaps, ["k"], "m").first()["n_months"] == 4  # December to March


def test_baseline_needs_samples(spark):
    days = [(1, "up", f"2024-01-{d:02d}", 10) for d in (1, 8, 15, 22, 29)]
    daily = spark.createDataFrame(days, "station_code int, direction string, date string, x int").withColumn("date", F.to_date("date"))
    busy = daily.where("date = '2024-01-15'").select("station_code", "date")
    base = impact.baselines(busy.withColumn("direction", F.lit("up")), daily, busy, ["station_code", "direction"], "x")
    row = base.first()
    assert row["n_samples"] == 4 and row["base"] == 10 and row["mad"] == 0
    assert impact.baselines(busy.withColumn("direction", F.lit("up")), daily, busy, ["station_code", "direction"], "x", least=5).isEmpty()


def test_pareto(spark):
    rows = spark.createDataFrame([(1, 1, 30.0, 120.0, 2.0), (1, 2, 31.0, 122.0, 0.0)], "q int, r int, t double, c double, p double")
    three = {x["r"]: x["is_pareto"] for x in network.pareto(rows, "q", "r", ["t", "c", "p"]).collect()}
    two = {x["r"]: x["is_pareto"] for x in network.pareto(rows, "q", "r", ["t", "c"]).collect()}
    assert three == {1: True, 2: True} and two == {1: True, 2: False}


def test_average_precision_ties(spark):
    rows = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "s double, h boolean")
    got = evaluation.average_precision(rows, "s", "h", buckets=4).first()
    assert abs(got["average_precision"] - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12 and got["recall_at_half"] == 1.0
    none = evaluation.average_precision(rows.withColumn("h", F.lit(False)), "s", "h").first()
    assert none["average_precision"] is None


def all_routes(edges, o, d):
    out, todo = [], [([o], 0)]
    while todo:
        path, cost = todo.pop()
        if path[-1] == d:
            out.append((cost, ">".join(path)))
            continue
        todo += [([*path, y], cost + m) for (x, y), m in edges.items() if x == path[-1] and y not in path]
    return sorted(out)


def test_k_routes_against_enumeration(spark):
    """Networks of all densities, with ties, names that begin others, ends that are not there."""
    asked, table, want = [], [], {}
    for net in range(24):
        random.seed(net)
        names = list(dict.fromkeys(random.choice(["n", "n x", "n@l", "m"]) + "y" * (i // 3) + random.choice(["", " ", "z"]) for i in range(random.randint(4, 9))))
        edges = {(x, y): random.randint(1, random.choice([1, 4, 40])) for x in names for y in names if x != y and random.random() < random.choice([0.2, 0.5, 1.0])}
        table += [(net, x, y, m) for (x, y), m in edges.items()] + [(net, x, y, m + 1) for (x, y), m in list(edges.items())[:2]]
        there = {n for e in edges for n in e}
        for q in range(5):
            o, d = random.choice(names), random.choice([*names, "nowhere"])
            asked.append((net, q, o, d))
            want[(net, q)] = all_routes(edges, o, d)[:4] if {o, d} <= there else []
    frame = spark.createDataFrame(asked, "net int, request_id long, origin string, destination string")
    steps = spark.createDataFrame(table, "net int, node string, next string, weight long")
    for k, widths in ((4, (0.5, None)), (1, (None,))):
        got = {}
        for r in routes.k_routes(frame, steps, k, widths).collect():
            got.setdefault((r["net"], r["request_id"]), {})[r["rank"]] = (r["cost"], ">".join(r["path"]))
        assert {x: [g[i + 1] for i in range(len(g))] for x, g in got.items()} == {x: w[:k] for x, w in want.items() if w}
    assert {(r["net"], r["request_id"]): (r["cost"], ">".join(r["path"])) for r in routes.least_routes(frame, steps).collect()} == {x: w[0] for x, w in want.items() if w}


def test_k_paths_in_a_dense_network_and_past_dead_ends(spark):
    """Ten nodes all joined have 100,000 loop-free routes between two; a long dead end has to be
    walked back from; one-way and unconnected requests have one route and none."""
    nodes = [f"n{i}" for i in range(10)]
    random.seed(8)
    edges = {(x, y): random.randint(1, 9) for x in nodes for y in nodes if x != y}
    tail = [f"s{i:02d}" for i in range(12)]
    edges |= {e: 5 for a, b in zip(["n0", *tail], tail) for e in ((a, b), (b, a))} | {("one", "way"): 3, ("s03", "x"): 30, ("x", "s04"): 30}
    table = spark.createDataFrame([(a, b, m) for (a, b), m in edges.items()], "from_node string, to_node string, minutes int")
    asked = [(1, "n0", "n7"), (2, "s11", "n5"), (3, "one", "way"), (4, "way", "one"), (5, "s02", "s06"), (6, "n4", "n4")]
    got = {}
    for r in routes.k_paths(spark.createDataFrame(asked, "request_id int, origin string, destination string"), table, 5).collect():
        got.setdefault(r["request_id"], []).append((r["minutes"], ">".join(r["path"])))
    for q, o, d in asked:
        assert sorted(got.get(q, [])) == all_routes(edges, o, d)[:5]
    assert len(got[5]) == 2 and 4 not in got


def test_route_searches_send_nothing_to_the_driver(spark, monkeypatch):
    """Neither edges nor corridors nor routes are collected or broadcast, however small."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(routes, "written", seen)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda df: pytest.fail("collected"))
    edges = spark.createDataFrame([(0, f"n{a}", f"n{b}", 1 + (a + b) % 3) for a in range(8) for b in range(8) if a != b], "net int, node string, next string, weight long")
    asked = spark.createDataFrame([(0, k, f"n{k}", f"n{(k + 3) % 8}") for k in range(8)] + [(0, 9, "n1", "nowhere")], "net int, request_id long, origin string, destination string")
    got = routes.k_routes(asked, edges, 3).collect()
    assert sorted((r["request_id"], r["rank"]) for r in got) == [(k, n) for k in range(8) for n in (1, 2, 3)]
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


def test_route_queries_broadcast_one_row_at_most(spark, tmp_path):
    """From the parts to the last join: of each run the plan as it was carried out."""
    from crowdloom.plans import network as plans
    from crowdloom.plans.registry import QUERIES

    spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_brand in ('Brand#11', 'Brand#12')").write.parquet(f"{tmp_path}/part.parquet")
    store = spark._jsparkSession.sharedState().statusStore()
    runs = lambda: [r.apply(k) for r in [store.executionsList()] for k in range(r.size())]
    known = max((r.executionId() for r in runs()), default=-1)
    for name in ("R10_through_pass", "R11_seat_score", "R9_path_evaluation", "R14_pareto", "R16_diverse", "R15_overlap"):
        assert QUERIES[name](spark, str(tmp_path)).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    said = [r.physicalPlanDescription() for r in runs() if r.executionId() > known]
    assert len(said) > 20 and not [p for p in said if "BroadcastHashJoin" in p]


def test_route_queries_ask_every_request(spark):
    from crowdloom.plans import network as plans
    from crowdloom.plans.registry import ORACLES

    seq = sorted((r["line_id"], r["seq"], r["station_name"]) for r in plans.line_sequence(spark, "/root/testdata/sf0.001").collect())
    want = {a[1] for a, b in zip(seq, seq[3:]) if a[0] == b[0] and a[2] != b[2]}
    assert {r["request_id"] for r in plans.requests(spark, "/root/testdata/sf0.001").collect()} == want and len(want) > 100
    assert {"R6_k_paths_whole", "R7_station_requests_whole", "R9_path_evaluation_whole", "R17_alternatives_whole", "R19_mode_summary_whole"} <= set(ORACLES)


def test_kept_searches_follow_the_data(spark, tmp_path):
    """A table rewritten under the same path is searched anew; forget deletes what was kept."""
    from crowdloom.plans import network as plans

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    d = str(tmp_path)
    part.where("p_brand in ('Brand#11', 'Brand#12')").write.parquet(f"{d}/part.parquet")
    first = plans.kept(spark, d, "edges", lambda: plans.all_edges(spark, d))
    n, files = first.count(), first.inputFiles()
    assert plans.kept(spark, d, "edges", lambda: 1 / 0).inputFiles() == files
    part.where("p_brand = 'Brand#11'").write.mode("overwrite").parquet(f"{d}/part.parquet")
    second = plans.kept(spark, d, "edges", lambda: plans.all_edges(spark, d))
    assert 0 < second.count() < n and second.inputFiles() != files
    plans.forget(spark)
    assert not any(plans.exists(spark, f) for f in files + second.inputFiles())


def test_temporary_rounds_are_deleted(spark):
    from crowdloom.sources import scratch

    with scratch.temporary(spark) as keep:
        gone = scratch.written(spark.range(3))
        with scratch.temporary(spark) as inner:
            also, stays = scratch.written(spark.range(4)), inner(spark.range(5))
        assert not scratch.exists(spark, also.inputFiles()[0]) and stays.count() == 5
        result = keep(gone.unionByName(stays))
    assert result.count() == 8 and not any(scratch.exists(spark, df.inputFiles()[0]) for df in (gone, stays))


def test_whole_active_events_and_distances(spark):
    from crowdloom.plans import impact as plans
    from crowdloom.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    events = plans.events(spark, d).collect()
    orders = plans.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")).collect()
    want = sorted((o["o_orderkey"], e["event_id"]) for o in orders for e in events if e["start_date"] <= o["date"] <= e["end_date"] and o["o_orderkey"] % 8 in (1, 2, 7))  # in the events' hours
    assert sorted(map(tuple, QUERIES["C9_active_events"](spark, d).collect())) == want and any(k % 10 for k, _ in want)
    steps = [(f"n{i}", f"n{i + 1}", 5) for i in range(5)]
    seeds = spark.createDataFrame([("n0", "n0", 0), ("n3", "n3", 0)], "source string, node string, cost int")
    got = network.distances(seeds, spark.createDataFrame(steps, "from_node string, to_node string, minutes int"), None).collect()
    assert {(r["source"], r["node"], r["cost"]) for r in got} == {("n0", f"n{i}", 5 * i) for i in range(6)} | {("n3", f"n{i}", 5 * i - 15) for i in range(3, 6)}


def test_entry_works_without_optional_parts(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "D7_station_profile" in names and set(entry.oracle_sql()) <= set(names)


def test_wait_is_null_where_no_level_has_it(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "line string, station string")
    station, line = spark.createDataFrame([("1", "a", 30.0)], "line string, station string, wait double"), spark.createDataFrame([("1", 4.26)], "line string, wait double")
    got = {(r["line"], r["station"]): r["wait"] for r in journeys.chained(rows, [(station, ["line", "station"]), (line, ["line"])], "wait", 12.0).collect()}
    assert got == {("1", "a"): 12.0, ("1", "b"): 4.3, ("2", "c"): None}


def test_seat_score_is_the_fall_to_what_follows(spark):
    edges = spark.createDataFrame([("a", "b", "ride", 90.0), ("b", "c", "ride", 40.0), ("b", "d", "ride", 20.0), ("b", "x", "ride", None)], "from_node string, to_node string, kind string, cong double")
    steps = edges.where("from_node = 'a'").withColumn("request_id", F.lit(1)).withColumn("rank", F.lit(1))
    assert journeys.seat_scores(steps, edges).first()["seat_score"] == (90 - 30) / 10
    assert journeys.seat_scores(steps.withColumn("to_node", F.lit("z")), edges).first()["seat_score"] == 0


LINE = [("5", k, s, 2) for k, s in enumerate(["a", "b", "c", "d", "e"], 1)]


def line(spark, rows=LINE):
    return spark.createDataFrame(rows, "line_id string, pos int, station_name string, minutes int")


def test_breaks_one_way_and_branches(spark):
    breaks = spark.createDataFrame([("5", "e", "b")], "line_id string, station_name string, prev string")
    plain = network.ride_edges(line(spark), breaks, F.lit("main"), F.col("station_name") == "c").collect()
    assert {(r["from_node"], r["to_node"]) for r in plain} == {("5_a", "5_b"), ("5_b", "5_a"), ("5_b", "5_c"), ("5_c", "5_d"), ("5_d", "5_c"), ("5_b", "5_e"), ("5_e", "5_b")}  # never d-e, never c-b
    forked = network.ride_edges(line(spark), breaks, F.when(F.col("station_name") == "e", "side").otherwise("main"), F.lit(False)).collect()
    assert ("5_b@side", "5_e") in {(r["from_node"], r["to_node"]) for r in forked} and ("5_e", "5_b@side") in {(r["from_node"], r["to_node"]) for r in forked}


def test_loop_needs_a_new_train(spark):
    none = spark.createDataFrame([], "line_id string, station_name string, prev string")
    edges = network.ride_edges(line(spark), none, F.lit("main"), F.lit(False))
    looped = network.split_loop_end(edges, spark.createDataFrame([("5", "c", "d", "b")], "line_id string, entry string, last string, exit string"))
    pairs = {(r["from_node"], r["to_node"]) for r in looped.collect()}
    assert ("5_d", "5_c@loop") in pairs and ("5_c@loop", "5_b") in pairs and ("5_d", "5_c") not in pairs and ("5_c", "5_d") in pairs
    walks = network.transfer_edges(looped, spark.createDataFrame([], "station_name string, volume double"), 4, 3).collect()
    assert [(r["from_node"], r["to_node"], r["is_bidirectional"]) for r in walks] == [("5_c@loop", "5_c", 0)]


def test_through_running_is_no_transfer(spark):
    """b - c rides on to the branch node c@side: a pass with b before, a change with d before."""
    kinds = [("ride", 2, "5_b", "5_c"), ("transfer", 3, "5_c", "5_c@side"), ("ride", 2, "5_c@side", "5_e"), ("ride", 2, "5_e", "5_f")]
    rows = [(1, 1, k, a, b, kind, m, 1000 * m, 0, 50.0 if kind == "ride" else None) for k, (kind, m, a, b) in enumerate(kinds)]
    rows += [(2, 1, k, "5_d" if k == 0 else a, b, kind, m, 1000 * m, 0, 50.0 if kind == "ride" else None) for k, (kind, m, a, b) in enumerate(kinds)]
    steps = spark.createDataFrame(rows, "request_id int, rank int, pos int, from_node string, to_node string, kind string, minutes int, cost_m int, event_m int, cong double")
    marked = journeys.through_pass(steps, spark.createDataFrame([("5_c", "5_c@side", "5_b")], "node string, own string, trunk string"))
    parts = network.segments(marked, F.when(F.col("kind") == "transfer", "walk").otherwise("5"))
    high = spark.createDataFrame([(100.0,)], "p95 double")
    keys = ["request_id", "rank"]
    seats = marked.select(*keys).distinct().withColumn("seat_score", F.lit(0.0))
    got = {r["request_id"]: r for r in journeys.evaluate(parts, marked.groupBy(*keys).agg(F.count("*").alias("n_edges")), seats, high).collect()}
    assert (got[1]["transfers"], got[1]["dwell_stops"], got[1]["actual"], got[1]["walking"]) == (0, 2, 7.0, 0)
    assert (got[2]["transfers"], got[2]["dwell_stops"], got[2]["actual"], got[2]["walking"]) == (1, 1, 9.5, 3)
    for r in got.values():  # parts add up to the total
        assert r["running"] + r["walking"] + r["dwell"] == r["actual"]


def test_near_duplicates_pareto_first(spark):
    a, b = [f"e{k}" for k in range(100)], [f"e{k}" for k in range(34, 134)]
    rows = spark.createDataFrame([(1, 0, 1, a), (1, 1, 2, a[:66]), (1, 0, 3, b)], "q int, later int, rank int, ks array<string>")
    got = {r["rank"]: r["is_near_duplicate"] for r in network.diverse(rows, ["q"], ["later", "rank"], "ks", 0.65).collect()}
    assert got == {1: False, 2: True, 3: False}
    limit = spark.createDataFrame([(1, 1, a), (1, 2, a[:65]), (1, 3, [*a[:66]])], "q int, rank int, ks array<string>")
    assert {r["rank"]: r["is_near_duplicate"] for r in network.diverse(limit, ["q"], ["rank"], "ks", 0.65).collect()} == {1: False, 2: False, 3: True}


def test_shortest_paths_against_enumeration(spark):
    random.seed(5)
    nodes = ["1_a", "1_b", "1_c", "2_a", "2_c", "2_d"]
    steps = [(x, y, random.randint(1, 5)) for x in nodes for y in nodes if x != y and random.random() < 0.5]
    seeds = spark.createDataFrame([(x, x, 0) for x in nodes], "source string, node string, cost int")
    got = {(r["source"], r["node"]): r for r in network.shortest_paths(seeds, spark.createDataFrame(steps, "from_node string, to_node string, minutes int"), None).collect()}
    cost = {(x, y): m for x, y, m in steps}
    best, todo = {}, [([x], 0) for x in nodes]
    while todo:
        path, spent = todo.pop()
        best[(path[0], path[-1])] = min(best.get((path[0], path[-1]), 99), spent)
        todo += [([*path, y], spent + cost[(path[-1], y)]) for y in nodes if (path[-1], y) in cost and y not in path]
    assert {k: r["cost"] for k, r in got.items()} == best
    for r in got.values():
        path = r["path"].split(">")
        assert sum(cost[p] for p in zip(path, path[1:], strict=False)) == r["cost"] and r["stops"] == len(path) - 1
        assert r["transfers"] == sum(x.split("_")[1] == y.split("_")[1] for x, y in zip(path, path[1:], strict=False))
