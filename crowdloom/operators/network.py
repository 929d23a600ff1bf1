"""Network and route jobs, for many requests at once.

Edges are a table of hundreds to thousands of rows, whatever the requests; rounds broadcast it
only below a counted limit, all that routes are made from and judged by is shuffled. Searches are rounds of joins over all requests together; each
round is written out, so that plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import node_id, node_station
from ..sources.scratch import tidy, written
from .routes import shuffled

SMALL_EDGES = 20_000


def small(edges: DataFrame) -> DataFrame:
    """A broadcast hint for edge tables whose size is counted and small; larger ones are
    shuffled, also where their files are small: in memory they take some 30 times as much."""
    return F.broadcast(edges) if edges.count() <= SMALL_EDGES else edges.hint("merge")


def ride_edges(sequence: DataFrame, breaks: DataFrame, branch: Column, one_way: Column) -> DataFrame:
    """Edges between consecutive stations of a line. sequence: line_id, pos, station_name,
    minutes; breaks (line_id, station_name, prev) name another station before it; branch and
    one_way are read from the later station's row. Both directions unless one-way. The
    station at which a branch leaves the main line is a node of its own there (@branch)."""
    order = W.partitionBy("line_id").orderBy("pos")
    rows = sequence.withColumn("branch", branch).withColumn("one_way", one_way).withColumn("before", F.lag("station_name").over(order))
    rows = rows.join(shuffled(breaks), ["line_id", "station_name"], "left").withColumn("before", F.coalesce("prev", "before"))
    steps = rows.where("before is not null and before <> station_name").dropDuplicates(["line_id", "before", "station_name"])
    own = sequence.select("line_id", F.col("station_name").alias("before"), F.col("pos").alias("before_pos"), branch.alias("before_branch"))
    steps = steps.join(shuffled(own), ["line_id", "before"])
    split = F.when((F.col("branch") != "main") & (F.col("before_branch") == "main"), F.col("branch"))
    a = F.struct(node_id(F.col("line_id"), F.col("before"), split).alias("node"), F.col("before").alias("station"), F.col("before_pos").alias("pos"))
    b = F.struct(node_id(F.col("line_id"), F.col("station_name")).alias("node"), F.col("station_name").alias("station"), F.col("pos").alias("pos"))
    ways = F.when(F.col("one_way"), F.array(F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b"))))
    out = steps.select("line_id", "minutes", "branch", (~F.col("one_way")).cast("int").alias("is_bidirectional"), F.explode(ways).alias("e"))
    return out.select("line_id", F.col("e.a.node").alias("from_node"), F.col("e.b.node").alias("to_node"), F.col("e.a.station").alias("from_station"), F.col("e.b.station").alias("to_station"), F.col("e.a.pos").alias("from_pos"), F.col("e.b.pos").alias("to_pos"), "minutes", "branch", "is_bidirectional")


def split_loop_end(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """Where a one-way loop ends at the station that it began at, a train that comes round
    arrives at a node of its own (@loop) and leaves from there only to the loop's exit, so
    nobody rides on into the loop again. loops: line_id, entry, last, exit (station names)."""
    rule = loops.select("line_id", "entry", "last", "exit")
    out = edges.join(shuffled(rule), "line_id", "left")
    arrives = (F.col("from_station") == F.col("last")) & (F.col("to_station") == F.col("entry"))
    leaves = (F.col("from_station") == F.col("entry")) & (F.col("to_station") == F.col("exit"))
    end = node_id(F.col("line_id"), F.col("entry"), F.lit("loop"))
    out = out.withColumn("to_node", F.when(arrives, end).otherwise(F.col("to_node"))).withColumn("from_node", F.when(leaves, end).otherwise(F.col("from_node")))
    return out.withColumn("is_bidirectional", F.when(leaves, 0).otherwise(F.col("is_bidirectional"))).select(*edges.columns)


def transfer_edges(rides: DataFrame, volumes: DataFrame, minutes: int, again: int, most: float = 3.0, rate: float = 50_000.0) -> DataFrame:
    """Transfers inside a station: between its nodes of different lines (main nodes that
    rides leave from), between a line's main and branch node, and, one way, from a loop's end
    back to its main node. The penalty is the minutes and a crowd part by the station's volume."""
    nodes = rides.select("line_id", F.col("from_station").alias("station_name"), F.col("from_node").alias("node")).distinct()
    kinds = nodes.withColumn("suffix", F.try_element_at(F.split("node", "@"), F.lit(2)))
    main, other = kinds.where("suffix is null").drop("suffix"), kinds.where("suffix is not null").withColumnRenamed("node", "own")
    lines = main.join(shuffled(main.toDF("to_line", "station_name", "to_node")), "station_name").where("line_id <> to_line").select("station_name", F.col("node").alias("from_node"), "to_node", F.lit(minutes).alias("minutes"), F.lit(0).alias("is_branch_transfer"), F.lit(1).alias("is_bidirectional"))
    same = other.join(shuffled(main), ["line_id", "station_name"])
    way = lambda a, b, both: same.where(F.lit(True) if both is None else both).select("station_name", F.col(a).alias("from_node"), F.col(b).alias("to_node"), F.lit(again).alias("minutes"), F.lit(1).alias("is_branch_transfer"), (F.col("suffix") != "loop").cast("int").alias("is_bidirectional"))
    out = lines.unionByName(way("own", "node", None)).unionByName(way("node", "own", F.col("suffix") != "loop"))
    crowd = F.round(F.least(F.lit(most), F.coalesce("volume", F.lit(0.0)) / rate), 3)
    return out.join(shuffled(volumes), "station_name", "left").withColumn("volume_penalty", crowd).drop("volume").withColumn("penalty", F.round(F.col("minutes") + F.col("volume_penalty"), 3))


def edge_direction(ring: Column, fold: int = 10) -> Column:
    """A ride's direction by rules in order: one-way edges go down; branch edges by their
    order on the branch; on a ring the name flips where the numbering closes (a jump of more
    than `fold`); else by ascending or descending number."""
    up = F.col("to_pos") > F.col("from_pos")
    closing = F.abs(F.col("to_pos") - F.col("from_pos")) > fold
    return (
        F.when(F.col("is_bidirectional") == 0, "down")
        .when(F.col("branch") != "main", F.when(up, F.concat("branch", F.lit("_up"))).otherwise(F.concat("branch", F.lit("_down"))))
        .when(F.col("from_pos").isNull() | F.col("to_pos").isNull(), None)
        .when(ring, F.when(up != closing, "inner").otherwise("outer"))
        .otherwise(F.when(up, "up").otherwise("down"))
    )


def crowded(rides: DataFrame, lookup: DataFrame, events: DataFrame, kappa: float = 0.5, floor: float = 80.0) -> DataFrame:
    """Rides with the crowding of trains leaving from_station in their direction (their line
    and direction's median where unknown, else all rides'), the station's event multiplier,
    and perceived minutes in thousandths (cost_m) with the events' part of it (event_m)."""
    out = rides.join(shuffled(lookup), ["line_id", "from_station", "direction"], "left")
    groups = out.groupBy("line_id", "direction").agg(F.median("rate").alias("m1"))
    out = out.join(shuffled(groups), ["line_id", "direction"], "left").join(F.broadcast(out.agg(F.median("rate").alias("m2")))).join(shuffled(events.withColumnRenamed("station_name", "from_station")), "from_station", "left")
    usual = F.coalesce("rate", "m1", "m2")
    felt = lambda c: F.round(F.col("minutes") * (1000 + 10 * kappa * F.greatest(c - floor, F.lit(0.0)))).cast("int")
    out = out.withColumn("usual", usual).withColumn("cong", F.col("usual") * F.coalesce("mult", F.lit(1.0)))
    return out.withColumn("cost_m", felt(F.col("cong"))).withColumn("event_m", F.col("cost_m") - felt(F.col("usual"))).drop("m1", "m2", "mult", "usual")


@tidy
def distances(seeds: DataFrame, edges: DataFrame, horizon: int | None) -> DataFrame:
    """Least minutes from each source to each node within the horizon, or to all nodes that
    can be reached where it is None. seeds: source, node, cost. Only nodes improved in a round are extended in the next."""
    step = small(edges.select(F.col("from_node").alias("node"), "to_node", "minutes"))
    known = written(seeds.groupBy("source", "node").agg(F.min("cost").alias("cost")).withColumn("fresh", F.lit(True)))
    while True:
        ahead = known.where("fresh").join(step, "node").select("source", F.col("to_node").alias("node"), (F.col("cost") + F.col("minutes")).alias("cost"))
        ahead = ahead if horizon is None else ahead.where(F.col("cost") <= horizon)
        both = known.select("source", "node", "cost", F.lit(0).alias("new")).unionByName(ahead.withColumn("new", F.lit(1)))
        best = both.groupBy("source", "node").agg(F.min(F.struct("cost", "new")).alias("b"))
        known = written(best.select("source", "node", "b.cost", (F.col("b.new") == 1).alias("fresh")))
        if known.where("fresh").isEmpty():
            return known.select("source", "node", "cost")


@tidy
def reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is connected, ignoring direction. In a round a
    node takes the least label of its neighbours' labels, offers it to the node that it is
    labelled by as well, and jumps to its label's label. So whole trees of labels are joined
    at once, and rounds grow with the logarithm of the longest way, whatever the names."""
    both = written(edges.select("from_node", "to_node").union(edges.select("to_node", "from_node")).where("from_node <> to_node").distinct())
    label = written(nodes.select("node", F.col("node").alias("component")))
    while True:
        grand = label.join(label.toDF("component", "grand"), "component")
        near = both.join(grand.select(F.col("node").alias("from_node"), "grand"), "from_node").groupBy(F.col("to_node").alias("node")).agg(F.min("grand").alias("near"))
        nearer = grand.join(near, "node", "left").select("node", "component", F.least("component", "grand", "near").alias("least"))
        offers = nearer.select("node", "least", F.col("component").alias("was")).unionByName(nearer.select(F.col("component").alias("node"), "least"), allowMissingColumns=True)
        new, seen = offers.groupBy("node").agg(F.min("least").alias("component"), F.max("was").alias("was")), Observation()
        label = written(new.observe(seen, F.count(F.when(F.col("component") != F.col("was"), 1)).alias("moved")).select("node", "component"))
        if not seen.get.get("moved"):
            return label


@tidy
def reached(roots: DataFrame, edges: DataFrame, squarings: int = 3) -> DataFrame:
    """The nodes that some root (column node) reaches along the edges, roots included. Edges
    are first joined with themselves a few times, so that a round takes 2**squarings steps;
    meant for sparse networks, where that adds few edges."""
    jumps = edges.select(F.col("from_node").alias("node"), "to_node").distinct()
    for _ in range(squarings):
        onward = jumps.select(F.col("node").alias("to_node"), F.col("to_node").alias("next"))
        jumps = written(jumps.union(jumps.join(onward, "to_node").select("node", "next")).distinct())
    step = small(jumps.select(F.col("node"), "to_node").withColumnRenamed("to_node", "next"))
    known = fresh = written(roots.select("node").distinct())
    while not fresh.isEmpty():
        ahead = fresh.join(step, "node").select(F.col("next").alias("node")).distinct()
        fresh = written(ahead.join(known, "node", "left_anti"))
        known = written(known.union(fresh))
    return known


@tidy
def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, strong_component): the least node that is reached and reaches back. Nodes joined
    by edges both ways are merged first, by labels that jump, so that long two-way lines take
    few rounds. Then, over all that is left at once: nodes without a way in or out are alone
    (trimming); every other gets the least label that reaches it, and of the nodes of a label
    those that reach its node are its component (forward and backward); these leave."""
    pairs = edges.select("from_node", "to_node").where("from_node <> to_node").distinct()
    mutual = pairs.join(pairs.toDF("to_node", "from_node"), ["from_node", "to_node"], "left_semi")
    merged = written(reachable(nodes, mutual).withColumnRenamed("component", "own"))
    a, b = merged.toDF("from_node", "a"), merged.toDF("to_node", "b")
    live = written(pairs.join(a, "from_node").join(b, "to_node").where("a <> b").select("a", "b").distinct())
    # What no merged edge touches is a component as it is.
    left = written(live.select(F.explode(F.array("a", "b")).alias("own")).distinct())
    done = merged.select("own").distinct().join(left, "own", "left_anti").select("own", F.col("own").alias("strong"))
    while not left.isEmpty():
        alone = left.join(live.select(F.col("a").alias("own")), "own", "left_anti").union(left.join(live.select(F.col("b").alias("own")), "own", "left_anti")).distinct()
        found = written(alone.select("own", F.col("own").alias("strong")))
        if found.isEmpty():
            label = written(left.select("own", F.col("own").alias("label")))
            while True:
                near = label.join(live, label["own"] == live["a"]).groupBy(F.col("b").alias("own")).agg(F.min("label").alias("near"))
                new = written(label.join(near, "own", "left").select("own", F.least("label", "near").alias("label"), F.col("label").alias("was")))
                label = new.select("own", "label")
                if new.where("label <> was").isEmpty():
                    break
            inside = live.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").where("la = lb").select(F.col("b").alias("to_node"), F.col("a").alias("from_node"))
            home = written(inside)
            roots = label.where("own = label").select(F.col("own").alias("node"))
            back = reached(roots, home.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node")), 0)
            found = written(label.join(back.withColumnRenamed("node", "own"), "own", "left_semi").select("own", F.col("label").alias("strong")))
        done = done.unionByName(found)
        left = written(left.join(found, "own", "left_anti"))
        live = written(live.join(left.toDF("a"), "a", "left_semi").join(left.toDF("b"), "b", "left_semi"))
    parts = merged.join(done, "own")
    least = parts.groupBy("strong").agg(F.min("node").alias("strong_component"))
    return parts.join(least, "strong").select("node", "strong_component")


@tidy
def shortest_paths(seeds: DataFrame, edges: DataFrame, horizon: int | None) -> DataFrame:
    """distances with one least path each: its nodes, stops and transfers (neighbours of one
    station name). Of equal minutes the path of the least text counts, so results repeat."""
    near = written(distances(seeds, edges, horizon))
    step = small(edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("next"), "minutes").groupBy("node", "next").agg(F.min("minutes").alias("minutes")))
    # Edges that lie on a least path: from each source a tree is grown along them.
    tight = near.join(step, "node").select("source", "node", F.col("next"), (F.col("cost") + F.col("minutes")).alias("reached"))
    tight = written(tight.join(near.select("source", F.col("node").alias("next"), F.col("cost").alias("reached")), ["source", "next", "reached"]).groupBy("source", "next").agg(F.min("node").alias("node")))
    grown = written(near.where("source = node").select("source", "node", F.array("node").alias("path")))
    done = grown
    while not grown.isEmpty():
        grown = written(grown.join(tight, ["source", "node"]).where(~F.array_contains("path", F.col("next"))).select("source", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")))
        done = done.unionByName(grown)
    names = F.transform("path", node_station)
    changes = F.size(F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: (i > 1) & (F.element_at(names, i) == F.element_at(names, F.greatest(i - 1, F.lit(1))))))
    out = near.join(done, ["source", "node"]).withColumn("transfers", changes).withColumn("stops", F.size("path") - 1)
    return out.withColumn("path", F.array_join("path", ">")).select("source", "node", "cost", "path", "stops", "transfers")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths exploded to their edges in order, with the edges' attributes."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("from_node"), F.element_at("path", i + 1).alias("to_node")))
    long = paths.where(F.size("path") > 1).select("request_id", "rank", F.posexplode(pairs).alias("pos", "e")).select("request_id", "rank", "pos", "e.*")
    return long.join(shuffled(edges), ["from_node", "to_node"], "left")


def segments(steps: DataFrame, line: Column) -> DataFrame:
    """Gaps and islands: a step's segment on its path, a stretch on one line. Through passes
    (is_through) are no steps of their own: the ride goes on."""
    order = W.partitionBy("request_id", "rank").orderBy("pos")
    lined = steps.where("not is_through").withColumn("line", line)
    new = (F.lag("line").over(order).isNull()) | (F.lag("line").over(order) != F.col("line"))
    return lined.withColumn("is_new", new.cast("int")).withColumn("segment", F.sum("is_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("is_new")


def segment_sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("request_id", "rank", "segment", "line").agg(F.count("*").alias("n_edges"), F.sum("minutes").alias("minutes"), F.when(F.col("line") == "walk", 0).otherwise(F.count("*") - 1).cast("long").alias("dwell_stops"))


def pareto(routes: DataFrame, request: str, route: str, costs: list[str]) -> DataFrame:
    """Marks routes that no other of the request beats in one cost and equals or beats in
    all; nulls count as worst. A request has few routes, so the pairs are few."""
    worst = {c: F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))) for c in costs}
    a = routes.select(request, route, *[x.alias(c) for c, x in worst.items()])
    b = a.toDF(request, "other", *[f"b_{c}" for c in costs])
    all_le, any_lt = F.lit(True), F.lit(False)
    for c in costs:
        all_le, any_lt = all_le & (F.col(f"b_{c}") <= F.col(c)), any_lt | (F.col(f"b_{c}") < F.col(c))
    beaten = a.join(shuffled(b), request).where(all_le & any_lt).select(request, route).distinct().withColumn("beaten", F.lit(True))
    return routes.join(shuffled(beaten), [request, route], "left").withColumn("is_pareto", F.col("beaten").isNull()).drop("beaten")


def edge_keys(path: str = "path") -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.concat(F.element_at(path, i), F.lit(">"), F.element_at(path, i + 1)))


def jaccard(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def diverse(routes: DataFrame, request: list[str], order: list[str], keys: str, limit: float, keep: int | None = None, reach: bool = False) -> DataFrame:
    """Greedy per request in the given order: is_near_duplicate where the overlap with a
    route that stayed is over the limit (reach: or equal to it); with `keep`, what comes
    after so many have stayed counts as one too. The fold runs inside one small row."""
    rows = routes.groupBy(*request).agg(F.sort_array(F.collect_list(F.struct(*order, keys))).alias("all"))
    over = lambda both, every: (both >= limit * every) if reach else (both > limit * every)
    near = lambda kept, x: F.exists(kept, lambda y: over(F.size(F.array_intersect(y, x[keys])), F.size(F.array_union(y, x[keys]))))
    full = (lambda kept: F.lit(False)) if keep is None else (lambda kept: F.size(kept) >= keep)
    start = F.struct(F.expr(f"filter(transform(all, x -> x.{keys}), x -> false)").alias("kept"), F.expr("filter(transform(all, x -> false), x -> x)").alias("dup"))

    def fold(state: Column, x: Column) -> Column:
        again = full(state["kept"]) | near(state["kept"], x)
        return F.struct(F.when(again, state["kept"]).otherwise(F.concat(state["kept"], F.array(x[keys]))).alias("kept"), F.concat(state["dup"], F.array(again)).alias("dup"))

    marked = rows.withColumn("dup", F.aggregate("all", start, fold)["dup"]).select(*request, F.explode(F.arrays_zip("all", "dup")).alias("z"))
    return marked.select(*request, "z.all.*", F.col("z.dup").alias("is_near_duplicate"))
