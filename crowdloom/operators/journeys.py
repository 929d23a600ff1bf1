"""Steps along given routes: waits, through passes, seats, profiles, order of running."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import node_station
from ..sources.scratch import tidy, written
from .routes import shuffled

ROUTE = ["request_id", "rank"]


def along(name: str, way: str) -> Column:
    f = F.lag if way == "before" else F.lead
    return f(name).over(W.partitionBy(*ROUTE).orderBy("pos"))


def chained(rows: DataFrame, levels: list[tuple[DataFrame, list[str]]], value: str, most: float) -> DataFrame:
    """The first level of tables that has a value for the row's key, held to at most; null
    where no level has one."""
    out, found = rows, []
    for k, (table, keys) in enumerate(levels):
        out = out.join(table.select(*keys, F.col(value).alias(f"v{k}")), keys, "left")
        found.append(f"v{k}")
    return out.withColumn(value, F.when(F.coalesce(*found).isNotNull(), F.round(F.least(F.coalesce(*found), F.lit(most)), 1))).drop(*found)


def through_pass(steps: DataFrame, junctions: DataFrame) -> DataFrame:
    """Marks transfer steps between the two nodes of a registered junction (node, own, trunk)
    whose node before or after is the trunk: the train itself goes on, nobody changes."""
    out = steps.withColumn("before_node", along("from_node", "before")).withColumn("after_node", along("to_node", "after"))
    both = junctions.select(F.least("node", "own").alias("x"), F.greatest("node", "own").alias("y"), "trunk")
    marked = out.withColumn("x", F.least("from_node", "to_node")).withColumn("y", F.greatest("from_node", "to_node")).join(shuffled(both), ["x", "y"], "left")
    meets = F.coalesce(F.col("before_node") == F.col("trunk"), F.lit(False)) | F.coalesce(F.col("after_node") == F.col("trunk"), F.lit(False))
    return marked.withColumn("is_through", F.coalesce(F.col("kind") == "transfer", F.lit(False)) & meets).drop("x", "y", "trunk", "before_node", "after_node")


def evaluate(parts: DataFrame, n_edges: DataFrame, seats: DataFrame, high: DataFrame, dwell: float = 0.5) -> DataFrame:
    """What a route costs, from its steps with segments: riding, dwelling (at stops inside a
    ride, `dwell` minutes each), walking, actual and perceived minutes, average and worst
    crowding, rides at or over the high mark, transfers and their penalty, event risk, seats,
    stops. n_edges: all edges of the route; high: one row with the mark p95."""
    ride, walk = F.col("kind") == "ride", F.col("kind") == "transfer"
    per = parts.join(F.broadcast(high)).groupBy(*ROUTE).agg(
        F.coalesce(F.sum(F.when(ride, F.col("minutes"))), F.lit(0)).alias("running"), F.coalesce(F.sum(F.when(walk, F.col("minutes"))), F.lit(0)).alias("walking"), F.sum("cost_m").alias("felt"),
        (F.count(F.when(ride, 1)) - F.count_distinct(F.when(ride, F.col("segment")))).alias("dwell_stops"), F.avg(F.when(ride, F.col("cong"))).alias("avg_cong"), F.max(F.when(ride, F.col("cong"))).alias("max_cong"),
        F.count(F.when(ride & (F.col("cong") >= F.col("p95")), 1)).alias("exposures"), F.count(F.when(walk, 1)).alias("transfers"), F.coalesce(F.sum(F.when(walk, F.col("cost_m"))), F.lit(0)).alias("penalty"),
        F.sum(F.coalesce("event_m", F.lit(0))).alias("event"),
    )
    minutes = lambda x: F.round(x / 1000.0, 3)
    out = per.join(shuffled(n_edges), ROUTE).join(shuffled(seats), ROUTE, "left")
    return out.select(
        *ROUTE, "running", (F.col("dwell_stops") * dwell).alias("dwell"), "walking", (F.col("running") + F.col("walking") + F.col("dwell_stops") * dwell).alias("actual"), (minutes(F.col("felt")) + F.col("dwell_stops") * dwell).alias("perceived"),
        "dwell_stops", F.round("avg_cong", 6).alias("avg_cong"), F.round("max_cong", 6).alias("max_cong"), "exposures", "transfers", minutes(F.col("penalty")).alias("transfer_penalty"), minutes(F.col("event")).alias("event_risk"),
        F.round(F.coalesce("seat_score", F.lit(0.0)), 6).alias("seat_score"), (F.col("n_edges") - F.col("transfers")).alias("n_stops"),
    )


def transfer_waits(parts: DataFrame, waits: DataFrame) -> DataFrame:
    """Wait added before each ride segment that follows another segment."""
    order = W.partitionBy(*ROUTE).orderBy("segment")
    after = parts.withColumn("previous", F.lag("line").over(order)).where((F.col("line") != "walk") & F.col("previous").isNotNull())
    sums = after.join(shuffled(waits), "line", "left").groupBy(*ROUTE).agg(F.sum(F.coalesce("wait", F.lit(0.0))).alias("wait"))
    return parts.select(*ROUTE).distinct().join(shuffled(sums), ROUTE, "left").withColumn("wait", F.coalesce("wait", F.lit(0.0)))


def chained_waits(segments: DataFrame, levels: list[tuple[DataFrame, list[str]]], most: float = 12.0) -> DataFrame:
    """For each route the boardings after a walk between lines (the first boarding is none),
    the waits of those whose segment has one at any of the levels, nearest first, each held
    to most and at one place, and how many have none. segments: described ones with the
    columns that the levels ask for; a level's table has a column wait, null where nothing
    runs."""
    order = W.partitionBy(*ROUTE).orderBy("segment")
    boarded = segments.withColumn("previous", F.lag("line").over(order)).where("line <> 'walk' and previous = 'walk'")
    sums = chained(boarded, [(shuffled(t), keys) for t, keys in levels], "wait", most).groupBy(*ROUTE).agg(F.count("*").alias("boardings"), F.sum("wait").alias("wait"), F.count(F.when(F.col("wait").isNull(), 1)).alias("unknown"))
    out = segments.select(*ROUTE).distinct().join(shuffled(sums), ROUTE, "left").na.fill(0, ["boardings", "unknown"])
    return out.select(*ROUTE, "boardings", F.round(F.coalesce("wait", F.lit(0.0)), 1).alias("wait"), "unknown")


def seat_scores(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """How far crowding falls along a route: a ride's rate less the mean of the rides that
    leave its end, averaged over the rides with both, / 10; 0 where there is none."""
    known = "kind = 'ride' and cong is not null"
    after = edges.where(known).groupBy(F.col("from_node").alias("to_node")).agg(F.avg("cong").alias("mean_after"))
    drops = steps.where(known).join(shuffled(after), "to_node").groupBy(*ROUTE).agg((F.avg(F.col("cong") - F.col("mean_after")) / 10).alias("s"))
    return steps.select(*ROUTE).distinct().join(shuffled(drops), ROUTE, "left").select(*ROUTE, F.coalesce("s", F.lit(0.0)).alias("seat_score"))


def described(parts: DataFrame, dwell: float = 0.5) -> DataFrame:
    """Structured segments of a route: line, ends, stops, minutes with dwell, worst crowding,
    the direction and branch of most of its rides (the lesser of equals), the next station and
    a label that names it unless it is the segment's end."""
    keys = [*ROUTE, "segment", "line"]

    def majority(c: str) -> DataFrame:
        counted = parts.where("kind = 'ride'").groupBy(*keys, c).agg(F.count("*").alias("n"))
        order = W.partitionBy(*keys).orderBy(F.desc("n"), c)
        return counted.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(*keys, c)

    base = parts.groupBy(*keys).agg(
        F.min_by("from_node", "pos").alias("a"), F.max_by("to_node", "pos").alias("b"), F.min_by("to_node", "pos").alias("first_to"), F.count("*").alias("stops"), F.sum("minutes").alias("running"), F.max("cong").alias("max_cong"),
    )
    ride = F.col("line") != "walk"
    out = base.join(shuffled(majority("direction")), keys, "left").join(shuffled(majority("branch")), keys, "left")
    name = lambda c: node_station(F.col(c))
    more = F.when(ride, (F.col("stops") - 1) * dwell).otherwise(0.0)
    return out.select(
        *keys, name("a").alias("from_station"), name("b").alias("to_station"), "stops", (F.col("running") + more).alias("minutes"), F.round("max_cong", 6).alias("max_cong"), "direction", "branch",
        F.when(ride, name("first_to")).alias("next_station"), F.when(ride & (F.col("stops") > 1), F.concat(F.lit("toward "), name("first_to"))).otherwise("").alias("direction_label"),
    )


def policies(ranked: DataFrame, group: list[str], max_loss: float = 15.0, min_drop: float = 15.0, max_excess: float = 5.0) -> tuple[DataFrame, dict[str, Column]]:
    """Conditions and labels for ranked routes with time_loss, cong_drop, perceived_gain,
    is_near_duplicate and violations: primary, meaningful_alternative, near_duplicate,
    rejected, or no_meaningful_alternative for all but the first."""
    conditions = {"not_near_dup": ~F.col("is_near_duplicate"), "time_loss": F.col("time_loss") <= max_loss, "cong_drop": F.coalesce(F.col("cong_drop") >= min_drop, F.lit(False)), "perceived": F.col("perceived_gain") >= -max_excess}
    ok = (F.col("route_rank") > 1) & (F.col("violations") == 0)
    for c in conditions.values():
        ok = ok & c
    out = ranked.withColumn("is_alternative", ok).withColumn("has_alternative", F.bool_or("is_alternative").over(W.partitionBy(*group)))
    label = F.when(F.col("route_rank") == 1, "primary").when(~F.col("has_alternative"), "no_meaningful_alternative").when(F.col("is_alternative"), "meaningful_alternative").when(F.col("is_near_duplicate"), "near_duplicate").otherwise("rejected")
    return out.withColumn("policy", label), conditions


def blockers(routes: DataFrame, conditions: dict[str, Column], group: list[str]) -> DataFrame:
    """For each group and condition the rows that would pass if it alone were dropped."""
    sums = []
    for name in conditions:
        others = F.col("route_rank") > 1
        for n, c in conditions.items():
            if n != name:
                others = others & c
        sums.append(F.count(F.when(others & ~conditions[name], 1)).alias(name))
    out = routes.groupBy(*group).agg(*sums)
    return out.withColumn("blocking", F.concat_ws(";", *[F.when(F.col(n) > 0, F.concat(F.lit(f"{n}("), F.col(n).cast("string"), F.lit(")"))) for n in conditions]))


def departure_alternatives(rides: DataFrame, lookup: DataFrame, keys: list[str], current: int, reach: int, gain: float) -> DataFrame:
    """The bin within reach whose worst crowding along the route's rides is least (the
    earliest on a tie), where it is at least gain below the current bin's."""
    near = lookup.where((F.abs(F.col("bin") - current) <= reach) & F.col("rate").isNotNull())
    bins = rides.select(*ROUTE, *keys).join(shuffled(near), keys).groupBy(*ROUTE, "bin").agg(F.max("rate").alias("worst"))
    out = bins.groupBy(*ROUTE).agg(F.min_by(F.struct("bin", "worst"), F.struct("worst", "bin")).alias("best"), F.max(F.when(F.col("bin") == current, F.col("worst"))).alias("now"))
    return out.select(*ROUTE, F.col("best.bin").alias("bin"), F.col("best.worst").alias("worst"), "now").where(F.col("now") - F.col("worst") >= gain)


def profile_along(parts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Crowding at each station of a route's rides: the value of the train leaving it, and at
    a ride's last station of the train that arrived. lookup: line_id, from_station, direction,
    rate at the bin asked for."""
    rides = parts.where("kind = 'ride'").withColumn("from_station", node_station(F.col("from_node"))).join(shuffled(lookup), ["line_id", "from_station", "direction"], "left")
    order = W.partitionBy(*ROUTE, "segment").orderBy("pos")
    ends = rides.withColumn("is_last", F.lead("pos").over(order).isNull())
    leaving = ends.select(*ROUTE, "segment", "pos", "line_id", F.col("from_station").alias("station"), "rate")
    arriving = ends.where("is_last").select(*ROUTE, "segment", (F.col("pos") + 1).alias("pos"), "line_id", node_station(F.col("to_node")).alias("station"), "rate")
    return leaving.unionByName(arriving)


def _walk(at: DataFrame, follows: DataFrame) -> DataFrame:
    """(line_id, node, pos) after each line's node and pos in at: from a step (a, b) on to the
    first of b's followers but a, and no further from an end, until a step comes again. A
    step's next one hangs on that step alone, so jumps are doubled: log2(n) rounds."""
    order = W.partitionBy("line_id", "from_node").orderBy("is_end", "rank", "to_node")
    two = follows.withColumn("n", F.row_number().over(order)).where("n <= 2")
    pick = lambda k: F.max(F.when(F.col("n") == k, F.col("to_node"))).alias(f"next{k}")
    best = written(two.groupBy("line_id", F.col("from_node").alias("b")).agg(pick(1), pick(2)))
    steps = follows.where("not is_end").select("line_id", F.col("from_node").alias("a"), F.col("to_node").alias("b")).distinct()
    onward = F.when(F.col("next1") != F.col("a"), F.col("next1")).otherwise(F.col("next2"))
    jumps = written(steps.join(best, ["line_id", "b"]).select("line_id", "a", "b", F.col("b").alias("x"), onward.alias("y")).where("y is not null"))
    placed = written(at.withColumnRenamed("node", "b").join(best, ["line_id", "b"]).select("line_id", F.col("b").alias("a"), F.col("next1").alias("b"), (F.col("pos") + 1).alias("pos")))
    hop = 1
    while True:
        ahead = placed.join(jumps, ["line_id", "a", "b"]).select("line_id", F.col("x").alias("a"), F.col("y").alias("b"), (F.col("pos") + hop).alias("pos"))
        both = written(placed.union(ahead).groupBy("line_id", "a", "b").agg(F.min("pos").alias("pos")))
        if both.count() == placed.count():
            return both.select("line_id", F.col("b").alias("node"), "pos")
        placed, hop = both, 2 * hop
        then = jumps.select("line_id", F.col("a").alias("x"), F.col("b").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        jumps = written(jumps.join(then, ["line_id", "x", "y"]).select("line_id", "a", "b", F.col("x2").alias("x"), F.col("y2").alias("y")))


@tidy
def running_order(starts: DataFrame, follows: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(line_id, node, pos): each line, or pattern of one, walked from its start node. From a
    node it goes to the first by rank, then name, of the followers (line_id, from_node,
    to_node and, if there is more than one, rank) where it has not been; to one of ends
    (line_id, node) only if no other is left, and stops there, or where nothing follows.

    A walk that meets itself is cut there and goes on from its last node, all nodes that it
    passed taken out, so a line of n nodes takes log2(n) rounds for each such meeting."""
    left = follows.select("line_id", "from_node", "to_node", F.col("rank") if "rank" in follows.columns else F.lit(0).alias("rank"))
    if ends is None:
        left = left.withColumn("is_end", F.lit(False))
    else:
        marks = ends.select("line_id", F.col("node").alias("to_node"), F.lit(True).alias("is_end")).distinct()
        left = left.join(marks, ["line_id", "to_node"], "left").withColumn("is_end", F.coalesce("is_end", F.lit(False)))
    left = written(left)
    at = done = written(starts.select("line_id", "node", F.lit(0).alias("pos")))
    while True:
        walk = _walk(at, left)
        again = walk.union(at).withColumn("n", F.row_number().over(W.partitionBy("line_id", "node").orderBy("pos"))).where("n > 1")
        cuts = written(again.groupBy("line_id").agg(F.min("pos").alias("cut")))
        fresh = walk.join(cuts, "line_id", "left").where("cut is null or pos < cut")
        done = written(done.unionByName(fresh.select("line_id", "node", "pos")))
        if cuts.isEmpty():
            return done
        cut = done.join(cuts, "line_id", "left_semi")
        at = written(cut.groupBy("line_id").agg(F.max_by("node", "pos").alias("node"), F.max("pos").alias("pos")))
        passed = done.select("line_id", F.col("node").alias("to_node"))
        left = written(left.join(cuts, "line_id", "left_semi").join(passed, ["line_id", "to_node"], "left_anti"))


@tidy
def line_patterns(patterns: DataFrame, follows: DataFrame) -> DataFrame:
    """Running order of patterns (pattern, start, end: stations) over the followers in each
    one's scope (pattern, from_node, to_node, from_station, to_station, rank): from the least
    node of the start to any of the end. A pattern whose start or end has no node in its
    scope has no rows."""
    ends = ("from", "to")
    nodes = written(follows.select("pattern", F.explode(F.array(*[F.struct(F.col(f"{x}_node").alias("node"), F.col(f"{x}_station").alias("station")) for x in ends])).alias("n")).select("pattern", "n.*").distinct())
    of = lambda end: nodes.join(patterns.select("pattern", F.col(end).alias("station")), ["pattern", "station"]).select(F.col("pattern").alias("line_id"), "node")
    stops = written(of("end"))
    starts = of("start").groupBy("line_id").agg(F.min("node").alias("node")).join(stops, "line_id", "left_semi")
    return running_order(starts, follows.withColumnRenamed("pattern", "line_id"), stops).withColumnRenamed("line_id", "pattern")


def tips(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Direction-aware transfer tip: prefer rows whose departing direction has the next
    station, then rows whose arriving direction lacks the previous one; a preference that
    no row meets is dropped; least time, then car."""
    j = requests.join(rows, ["station_name", "from_line", "to_line"])
    w = W.partitionBy("request_id")
    j = j.withColumn("a", F.coalesce(F.contains("depart_toward", "next_station"), F.lit(False)).cast("int")).withColumn("keep", F.col("a") == F.max("a").over(w)).where("keep")
    j = j.withColumn("b", (~F.coalesce(F.contains("arrive_toward", "previous_station"), F.lit(False))).cast("int")).withColumn("keep", F.col("b") == F.max("b").over(w)).where("keep")
    return j.withColumn("rn", F.row_number().over(w.orderBy("minutes", "car"))).where("rn = 1").select("request_id", "car", "minutes")


def station_requests(requests: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests between stations as requests between nodes: every node of either end is
    opened at no cost by a virtual node (O>station, D>station). Requests of unknown or equal
    stations are left out. Returns the node requests and the edges with the virtual ones."""
    known = nodes.select("station_name").distinct()
    good = requests.where("origin <> destination").join(known.toDF("origin"), "origin", "left_semi").join(known.toDF("destination"), "destination", "left_semi")
    out = nodes.select(F.concat(F.lit("O>"), "station_name").alias("from_node"), F.col("node").alias("to_node"), F.lit(0).alias("minutes"))
    into = nodes.select(F.col("node").alias("from_node"), F.concat(F.lit("D>"), "station_name").alias("to_node"), F.lit(0).alias("minutes"))
    asked = good.select("request_id", F.concat(F.lit("O>"), "origin").alias("origin"), F.concat(F.lit("D>"), "destination").alias("destination"))
    return asked, edges.select("from_node", "to_node", "minutes").unionByName(out).unionByName(into)


def coordinates(paths: DataFrame, points: DataFrame, station: Column) -> DataFrame:
    """Each path's points in order: the node's own, else its station's least node's, else
    none; equal neighbours collapse. points: node, station, x, y."""
    own = points.select("node", F.struct("x", "y").alias("own"))
    any_of = points.groupBy("station").agg(F.min_by(F.struct("x", "y"), "node").alias("fallback"))
    long = paths.select(*ROUTE, F.posexplode("path").alias("pos", "node")).withColumn("station", station)
    placed = long.join(own, "node", "left").join(any_of, "station", "left").withColumn("p", F.coalesce("own", "fallback")).where("p is not null")
    order = W.partitionBy(*ROUTE).orderBy("pos")
    return placed.withColumn("before", F.lag("p").over(order)).where("before is null or before <> p").select(*ROUTE, "pos", "p.x", "p.y")


def edge_geometry(order: DataFrame, points: DataFrame, rings: DataFrame, returns: DataFrame, connectors: DataFrame) -> DataFrame:
    """Lines to draw between the points (node, x, y) of neighbours in order (line_id, branch,
    path_order, node): a ring (line_id, branch) also closes, and where two neighbours are a
    return's (line_id, after_node, next_node, node) the line passes node between them. Lines
    need both points; connectors (from_node, to_node) stay without."""
    w = W.partitionBy("line_id", "branch").orderBy("path_order")
    keys = ["line_id", "branch"]
    near = order.select(*keys, F.col("node").alias("from_node"), F.lead("node").over(w).alias("to_node"), "path_order")
    ends = near.groupBy(*keys).agg(F.max_by("from_node", "path_order").alias("from_node"), F.min_by("from_node", "path_order").alias("to_node"))
    closing = ends.join(rings.select(*keys).distinct(), keys, "left_semi")
    by = returns.select("line_id", F.col("after_node").alias("from_node"), F.col("next_node").alias("to_node"), F.col("node").alias("via"))
    pairs = near.where("to_node is not null").join(by, ["line_id", "from_node", "to_node"], "left")
    ways = F.when(F.col("via").isNull(), F.array(F.struct("from_node", "to_node"))).otherwise(F.array(F.struct(F.col("from_node"), F.col("via").alias("to_node")), F.struct(F.col("via").alias("from_node"), F.col("to_node"))))
    lines = pairs.select(*keys, F.explode(ways).alias("e")).select(*keys, "e.*").unionByName(closing)
    both = lines.withColumn("kind", F.lit("line")).unionByName(connectors.select("from_node", "to_node", F.lit("connector").alias("kind")), allowMissingColumns=True)
    at = lambda end, k: points.select(F.col("node").alias(f"{end}_node"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    out = both.join(at("from", 0), "from_node", "left").join(at("to", 1), "to_node", "left")
    return out.where("kind = 'connector' or (x0 is not null and x1 is not null)").select("kind", *keys, "from_node", "to_node", "x0", "y0", "x1", "y1")
