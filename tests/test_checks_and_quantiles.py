"""Checks that fail where they should, strong components and exact quantiles by brute force."""

import math
import random
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdloom.operators import evaluation, impact, marts, network, quality
from crowdloom.operators.quantiles import exact_quantiles
from crowdloom.plans import checks, views
from crowdloom.sources import scratch

ROWS = [("5", k, s, 2, "side" if s == "e" else "main") for k, s in enumerate("abcde", 1)] + [("6", 1, "a", 3, "main"), ("6", 2, "x", 3, "main"), ("6", 3, "y", 3, "main")]


def network_of(spark):
    sequence = spark.createDataFrame(ROWS, "line_id string, pos int, station_name string, minutes int, kind string")
    breaks = spark.createDataFrame([("5", "e", "b")], "line_id string, station_name string, prev string")
    edges = network.ride_edges(sequence, breaks, F.col("kind"), F.lit(False))
    walks = network.transfer_edges(edges, spark.createDataFrame([], "station_name string, volume double"), 4, 3)
    return sequence, breaks, edges, walks


def failures(sequence, breaks, edges, walks, scope=None):
    out = quality.graph_checks(sequence, breaks, F.col("kind"), edges, walks, F.lit(True) if scope is None else scope)
    return {r["check"]: r["failures"] for r in out.collect() if r["failures"]}


def test_each_graph_check_can_fail(spark):
    sequence, breaks, edges, walks = network_of(spark)
    assert failures(sequence, breaks, edges, walks) == {}
    far = edges.where("from_node = '5_a'").withColumn("to_pos", F.lit(4)).withColumn("to_station", F.lit("d")).withColumn("to_node", F.lit("5_d")).withColumn("is_bidirectional", F.lit(0))
    one_gone = edges.where("not (from_node = '5_c' and to_node = '5_b')")
    assert failures(sequence, breaks, one_gone.union(far), walks.where("station_name <> 'a'"), F.col("line_id") == "5") == {"phantom_edges": 1, "required_transfers": 2, "out_of_scope_nodes": 3, "asymmetric_times": 1}
    slower = edges.withColumn("minutes", F.when(F.col("from_node") == "5_c", 9).otherwise(F.col("minutes")))
    assert failures(sequence, breaks, slower.where("not contains(from_node, '@') and not contains(to_node, '@')"), walks) == {"asymmetric_times": 4, "branch_nodes": 1}


def test_wanted_branch_nodes_come_from_the_rules(spark):
    sequence, breaks, _, _ = network_of(spark)
    assert [r["node"] for r in quality.wanted_branch_nodes(sequence, breaks, F.col("kind")).collect()] == ["5_b@side"]
    assert quality.wanted_branch_nodes(sequence, breaks.limit(0), F.col("kind")).first()["node"] == "5_d@side"


def test_open_loops(spark):
    sequence, breaks, edges, _ = network_of(spark)
    rules = spark.createDataFrame([("5", "c", "d", "b"), ("6", None, "x", None)], "line_id string, entry string, last string, exit string")
    looped = network.split_loop_end(edges, rules)
    assert quality.open_loops(rules, looped).count() == 0
    assert [r["line_id"] for r in quality.open_loops(rules, looped.where("to_node <> '5_c@loop'")).collect()] == ["5"]
    back = looped.where("to_node = '5_c@loop'").withColumn("from_node", F.lit("5_c@loop")).withColumn("to_node", F.lit("5_d"))
    assert [r["line_id"] for r in quality.open_loops(rules, looped.union(back)).collect()] == ["5"]


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_against_reachability(spark, seed):
    random.seed(seed)
    nodes = [f"n{i:02d}" for i in range(26)]
    edges = {(x, y) for x in nodes[:24] for y in nodes[:24] if random.random() < 0.05}
    edges |= {(b, a) for a, b in list(edges)[::3]} | {("n01", "n01")}
    reach = {x: {x} for x in nodes}
    changed = True
    while changed:
        changed = False
        for x in nodes:
            more = set().union(*(reach[b] for a, b in edges if a in reach[x])) | reach[x]
            changed, reach[x] = changed or more != reach[x], more
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in nodes}
    got = network.strong_components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(sorted(edges), "from_node string, to_node string"))
    assert {r["node"]: r["strong_component"] for r in got.collect()} == want and 3 < len(set(want.values())) < 26


def test_exact_quantiles(spark):
    random.seed(3)
    rows = [("hot", random.gauss(0, 1)) for _ in range(900)] + [("hot", None), ("hot", float("nan"))] + [("ties", float(random.randint(0, 2))) for _ in range(500)] + [("one", 7.5)] + [(None, float(i)) for i in range(4)] + [("none", None)]
    rows += [("wide", s * 10.0 ** random.randint(-4, 4)) for s in (1, -1) for _ in range(60)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"low": 0.0, "med": 0.5, "p95": 0.95, "top": 1.0, "odd": 1 / 3}
    for cells, few in ((32, 2), (4096, 4096)):
        got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", wanted, cells, few).collect()}
        assert set(got) == {"hot", "ties", "one", "wide", None}
        for k, r in got.items():
            v = [x for g, x in rows if g == k and x is not None and not math.isnan(x)]
            for name, q in wanted.items():
                assert math.isclose(r[name], np.quantile(v, q), rel_tol=1e-9, abs_tol=1e-12), (k, name)
    everything = [x for _, x in rows if x is not None and not math.isnan(x)]
    assert math.isclose(exact_quantiles(df, [], "v", {"m": 0.5}, 8, 3).first()["m"], np.median(everything))
    assert exact_quantiles(df.where("k = 'none'"), [], "v", {"m": 0.5}).collect() == []


def test_no_task_holds_the_group_of_a_quantile(spark):
    """Nothing is exchanged but counts of cells: no row of the data itself, but for the last few."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    plan = exact_quantiles(df, ["k"], "v", {"m": 0.5})
    assert plan.first()["m"] == float(np.median((np.arange(200_000) * 7919) % 200_003))


def test_threshold_and_imputation_fall_back(spark):
    cells = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("b", None)], "g string, v double")
    assert {(r["g"], r["t"]) for r in marts.with_group_quantile(cells, cells, ["g"], "v", 0.5, "t").collect()} == {("a", 2.0), ("b", 2.0)}
    assert sorted(r["x"] for r in marts.imputed(cells, ["g"], "v", "x").collect()) == [1.0, 2.0, 2.0, 3.0]
    none = cells.where("g = 'b'")
    assert [r["x"] for r in marts.imputed(none, ["g"], "v", "x").collect()] == [None, None]


def brute_controls(scale, treated, most, gap):
    out = set()
    for line, code, x in scale:
        if code not in treated:
            continue
        pool = sorted((round(abs(math.log1p(x) - math.log1p(y)), 12), c) for li, c, y in scale if c not in treated and not (li == line and abs(c - code) <= gap))
        out |= {(code, c, k + 1, d) for k, (d, c) in enumerate(pool[:most])}
    return out


def test_nearest_controls_without_a_cross_join(spark):
    random.seed(4)
    for n, ties in ((60, False), (60, True), (4, False)):
        scale = [(str(k % 3), k, float(random.randint(1, 6)) if ties else random.lognormvariate(3, 1)) for k in range(n)]
        treated = {k for k in range(n) if k % 7 == 0}
        frame = spark.createDataFrame(scale, "line_id string, station_code int, scale double")
        got = impact.controls(frame, spark.createDataFrame([(k,) for k in treated], "station_code int"), buckets=5)
        assert {(r["station_code"], r["control"], r["rank"], r["distance"]) for r in got.collect()} == brute_controls(scale, treated, 5, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_importances_and_curves_of_nested_sets(spark):
    """One tree of depth one against the best single cut found by trying all."""
    random.seed(5)
    rows = [(("train", "valid")[k % 4 == 0], random.randint(0, 9), random.choice("uv"), random.randint(0, 3)) for k in range(400)]
    rows = [(s, a, b, c, 10.0 * (a >= 6) + (3.0 if b == "v" else 0.0) + 0.1 * c) for s, a, b, c in rows]
    df = spark.createDataFrame(rows, "split string, a int, b string, c int, label double").withColumn("high", F.col("label") > 9)
    got = evaluation.trained_sets(df, {"c": ["c"], "c+b": ["c", "b"], "c+b+a": ["c", "b", "a"]}, texts=["b"], trees=1, depth=1).collect()
    assert len(got) == 6 and len({r["features"] for r in got}) == 3
    train = [r for r in rows if r[0] == "train"]
    valid = [r for r in rows if r[0] == "valid"]
    spread = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) if v else 0.0
    names = {"a": 1, "b": 2, "c": 3}
    for which in ({"c"}, {"c", "b"}, {"a", "b", "c"}):
        mine = {r["feature"]: r for r in got if set(r["features"].split("+")) == which}
        assert set(mine) == which and math.isclose(sum(r["importance"] for r in mine.values()), 1.0)
        cuts = [(spread([r[4] for r in train if r[names[f]] <= x]) + spread([r[4] for r in train if r[names[f]] > x]), f, x) for f in which for x in sorted({r[names[f]] for r in train})[:-1]]
        _, best, at = min(cuts)
        assert mine[best]["importance"] == 1.0 and mine[best]["importance_rank"] == 1
        low, high = ([r[4] for r in train if (r[names[best]] <= at) == side] for side in (True, False))
        said = [sum(low) / len(low) if r[names[best]] <= at else sum(high) / len(high) for r in valid]
        assert math.isclose(mine[best]["mae"], sum(abs(p - r[4]) for p, r in zip(said, valid, strict=True)) / len(valid), rel_tol=1e-6)
        assert 0 <= mine[best]["average_precision"] <= 1


def test_absent_periods(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("x", 3)], "k string, p int")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "k string")
    assert sorted(map(tuple, marts.absent(seen, wanted, ["k"], "p").collect())) == [("a", 3), ("b", 1), ("b", 3), ("c", 1), ("c", 2), ("c", 3)]
    more = spark.createDataFrame([(2,), (9,)], "p int")
    assert sorted(map(tuple, marts.absent(seen, wanted.where("k = 'a'"), ["k"], "p", more).collect())) == [("a", 9)]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_a_mart_written_again_keeps_its_other_partitions(spark, tmp_path, kind):
    from crowdloom.sources import files

    path = f"{tmp_path}/mart"
    df = spark.createDataFrame([(k, f"s{k}", 202400 + k % 3) for k in range(30)], "v int, s string, ym int")
    files.write_mart(df, path, ["ym"], kind)
    held = lambda ym: {f.name: f.read_bytes() for f in (tmp_path / "mart" / f"ym={ym}").iterdir()}
    before = {ym: held(ym) for ym in (202400, 202401, 202402)}
    files.write_mart(df.where("ym = 202401").withColumn("v", F.col("v") + 100), path, ["ym"], kind)
    assert held(202400) == before[202400] and held(202402) == before[202402] and held(202401) != before[202401]
    back = files.read_mart(spark, path, ["v", "ym"], {"ym": [202401, 202402], "s": [f"s{k}" for k in range(9)]}, "v int, s string, ym int" if kind == "csv" else None)
    assert sorted(map(tuple, back.collect())) == [(2, 202402), (5, 202402), (8, 202402), (101, 202401), (104, 202401), (107, 202401)]
    assert all(f.endswith(".csv.gz" if kind == "csv" else ".parquet") for f in map(str, (tmp_path / "mart").glob("ym=*/part-*")))


def test_components_of_long_lines_in_few_rounds(spark, tmp_path, monkeypatch):
    """A shuffled line of 300 nodes, a ring, a lone node and an empty table; rounds go at the end."""
    names = [f"n{k:03d}" for k in range(300)]
    random.Random(5).shuffle(names)
    edges = list(pairwise(names)) + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x1", "x1")]
    nodes = spark.createDataFrame([(n,) for n in [*names, "x1", "x2", "x3", "z"]], "node string")
    steps, rounds, write = spark.createDataFrame(edges, "from_node string, to_node string"), [], scratch.written
    monkeypatch.setattr(network, "written", lambda df, name="round": rounds.append(1) or write(df, name))
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    found = network.reachable(nodes, steps)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {**dict.fromkeys(names, "n000"), **dict.fromkeys(("x1", "x2", "x3"), "x1"), "z": "z"}
    assert len(rounds) <= 14 and len(list(tmp_path.iterdir())) == 1
    assert network.reachable(nodes.limit(0), steps.limit(0)).count() == 0
    assert network.reachable(nodes, steps.limit(0)).where("node = component").count() == 304


def test_ruled_tables_join_shipments_to_stations_twice(spark, monkeypatch):
    """Once for each fact, not for every table, rule and pass."""
    made = []
    stations = views.stations
    monkeypatch.setattr(views, "stations", lambda *args: made.append(args) or stations(*args))
    tables = checks.ruled_tables(spark, "/root/testdata/sf0.001")
    assert len(made) == 2
    plans = [tables[n]._jdf.queryExecution().optimizedPlan().toString() for n in ("station_master", "stg_congestion", "congestion_mart", "training_mart", "event_spike")]
    assert not [p for p in plans if "l_suppkey" in p or "o_orderkey" in p]
