"""Least and K least routes of many requests at once, without a horizon.

The network is a dimension (at most MOST_EDGES edges, counted), the requests are the data.
Each request first gets its corridor: the nodes on some walk from its origin to its
destination that costs at most the least cost and a slack, with the least cost to go and the
least completion of each. Corridors come from tasks that hold the network as arrays and relax
all destinations of a batch together. Within the corridors the K least loop-free routes are
found by deviations (Yen's, with Lawler's rule that a route is left no earlier than where it
left its parent), for all requests in the same joins: a deviation is completed by the least
way to go where that meets no node of its beginning; only where it does, the completion is
searched for, node by node, by joins that keep the best way to each node. So work grows with
K times the routes' length, never with the number of partial routes. What costs more than the
slack allows is left to a next attempt with a wider one, until all requests have K routes or
their corridors are whole.

Of equal costs the least text of the route (nodes joined by ">") goes first. Weights are whole
numbers from 0; of parallel edges the least counts. A request whose ends are not connected
gets no row; one whose ends are the same node gets the route of that node alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import tidy, written

MOST_EDGES = 5_000_000
#: Requests relaxed together; numbers in one block of work.
TOGETHER, BLOCK = 64, 4_000_000
KEY = ["net", "request_id"]
FAR = np.iinfo(np.int64).max // 4


class Network:
    """Edges of one network in arrays, from the node and to it."""

    def __init__(self, a: list[str], b: list[str], w: list[int]):
        self.nodes = sorted({*a, *b})
        self.index = {n: i for i, n in enumerate(self.nodes)}
        at = np.array([[self.index[x] for x in a], [self.index[x] for x in b], w], np.int64).reshape(3, -1)
        at = at[:, np.lexsort((at[2], at[1], at[0]))]
        if at.shape[1]:
            at = at[:, np.concatenate([[True], (at[:2, 1:] != at[:2, :-1]).any(axis=0)])]
        self.out = self._sorted(at[0], at[1], at[2])
        self.back = self._sorted(at[1], at[0], at[2])

    @staticmethod
    def _sorted(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(a, kind="stable")
        a, b, w = a[order], b[order], w[order]
        ends, starts = np.unique(a, return_index=True)
        return ends, starts, b, w

    def least(self, targets: np.ndarray, out: bool) -> np.ndarray:
        """Least costs, a row for each target: to it (out) or from it, for every node."""
        ends, starts, other, w = self.out if out else self.back
        cost = np.full((len(targets), len(self.nodes)), FAR, np.int64)
        cost[np.arange(len(targets)), targets] = 0
        step = max(1, BLOCK // max(1, len(other)))
        for first in range(0, len(targets) if len(other) else 0, step):
            part = cost[first : first + step]
            while True:
                near = np.minimum(np.minimum.reduceat(part[:, other] + w, starts, axis=1), part[:, ends])
                if (near == part[:, ends]).all():
                    break
                part[:, ends] = near
        return np.minimum(cost, FAR)

    def completions(self, inside: np.ndarray, to_go: np.ndarray, target: int) -> dict[int, tuple[int, ...]]:
        """For each node of inside the least completion: the nodes after it."""
        ends, starts, other, w = self.out
        stops = np.concatenate([starts[1:], [len(other)]])
        found: dict[int, tuple[int, ...]] = {target: ()}
        text = {target: self.nodes[target]}
        order = inside[np.argsort(to_go[inside], kind="stable")]
        changed = True
        while changed:  # once, but for edges of weight 0
            changed = False
            for x in order.tolist():
                if x == target:
                    continue
                k = np.searchsorted(ends, x)
                near, cost = other[starts[k] : stops[k]], w[starts[k] : stops[k]]
                tight = near[to_go[near] + cost == to_go[x]].tolist()
                ways = [(text[y], y) for y in tight if y in text and x not in found[y]]
                if ways and (said := f"{self.nodes[x]}>{(best := min(ways))[0]}") != text.get(x):
                    found[x], text[x], changed = (best[1], *found[best[1]]), said, True
            if not (w == 0).any():
                break
        return found


CORRIDOR = "net int, request_id long, node string, to_go long, tail array<string>, tail_at array<long>, bound long, whole boolean, is_origin boolean"


def corridors(requests: DataFrame, edges: DataFrame, slack_of: dict[int, int | None], origin_only: bool = False) -> DataFrame:
    """Corridor rows of each request. requests: net, request_id, origin, destination; edges:
    net, node, next, weight; slack_of: the slack of each net, None for no limit. The edges are
    dealt to every task in front of its requests, by the shuffle: none pass the driver."""
    if edges.count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges: not a network to be held by every task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table, net, some = None, [], None, []

        def found(rows: list[dict]) -> pa.RecordBatch:
            known = [r for r in rows if r["origin"] in net.index and r["destination"] in net.index]
            return pa.RecordBatch.from_pylist(list(_corridor_rows(net, known, slack_of[key[1]], origin_only)) if known else [], SCHEMA)

        for batch in batches:
            at = np.stack([*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "net", "asks"))])
            starts = np.flatnonzero(np.concatenate([[batch.num_rows > 0], (at[:, 1:] != at[:, :-1]).any(axis=0)]))
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = (int(at[0, lo]), int(at[1, lo]))
                if here != key:
                    if some:
                        yield found(some)
                    key, table, net, some = here, [], None, []
                rows = batch.slice(lo, hi - lo)
                if not at[2, lo]:
                    table.append(rows)
                elif table or net:
                    if net is None:
                        net, table = Network(*(pa.Table.from_batches(table).column(c).to_pylist() for c in ("origin", "destination", "weight"))), []
                    some += rows.to_pylist()
                    while len(some) >= TOGETHER:
                        yield found(some[:TOGETHER])
                        some = some[TOGETHER:]
        if some:
            yield found(some)

    asked = requests.select("net", F.col("request_id").cast("long").alias("request_id"), "origin", "destination")
    # A number of its own: joined ones would put a small table's work into one task.
    n = asked.count()
    parts = max(1, min(-(-n // 8), max(2 * asked.sparkSession.sparkContext.defaultParallelism, n // 10_000)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("net", "destination"), F.lit(parts)).cast("int")).withColumn("weight", F.lit(None).cast("long")).withColumn("asks", F.lit(1))
    copies = edges.select("net", F.lit(None).cast("long").alias("request_id"), F.col("node").alias("origin"), F.col("next").alias("destination"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col("weight").cast("long").alias("weight"), F.lit(0).alias("asks"))
    rows = asked.unionByName(copies).repartitionById(parts, "part")
    return rows.sortWithinPartitions("part", "net", "asks", "destination").mapInArrow(run, CORRIDOR)


SCHEMA = pa.schema([("net", pa.int32()), ("request_id", pa.int64()), ("node", pa.string()), ("to_go", pa.int64()), ("tail", pa.list_(pa.string())), ("tail_at", pa.list_(pa.int64())), ("bound", pa.int64()), ("whole", pa.bool_()), ("is_origin", pa.bool_())])


def _corridor_rows(net: Network, some: list[dict], slack: int | None, origin_only: bool) -> Iterator[dict]:
    targets = sorted({net.index[r["destination"]] for r in some})
    to = dict(zip(targets, net.least(np.array(targets), True), strict=True))
    starts = sorted({net.index[r["origin"]] for r in some})
    since = dict(zip(starts, net.least(np.array(starts), False), strict=True))
    for r in some:
        a, b = net.index[r["origin"]], net.index[r["destination"]]
        to_go = to[b]
        if to_go[a] >= FAR:
            continue
        total = since[a] + to_go
        limit = FAR - 1 if slack is None else int(to_go[a]) + slack
        inside = np.flatnonzero(total <= limit)
        found = net.completions(inside, to_go, b)
        whole = bool((total < FAR).sum() == len(inside))
        limit = FAR - 1 if whole else limit  # nothing outside: no route is beyond it
        for x in [a] if origin_only else inside.tolist():
            tail = found[x]
            yield {"net": r["net"], "request_id": r["request_id"], "node": net.nodes[x], "to_go": int(to_go[x]), "tail": [net.nodes[y] for y in tail], "tail_at": [int(to_go[x] - to_go[y]) for y in tail], "bound": limit, "whole": whole, "is_origin": x == a}


def shuffled(df: DataFrame) -> DataFrame:
    """df, which joins may not broadcast: corridors and routes take some 30 times their files'
    size in memory, so by that size Spark would send them through the driver in every round."""
    return df.hint("merge")


def text(path: str = "path") -> F.Column:
    return F.array_join(path, ">")


def least_routes(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """The least route of each request of each net: net, request_id, cost, path."""
    found = corridors(requests, edges, {r[0]: 0 for r in edges.select("net").distinct().collect()}, origin_only=True)
    return found.select(*KEY, F.col("to_go").alias("cost"), F.concat(F.array("node"), "tail").alias("path"))


def _first(rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """The row of least cost, then text, for each of keys."""
    return rows.groupBy(*keys).agg(F.min(F.struct("cost", text().alias("text"), *keep)).alias("b")).select(*keys, "b.cost", *[f"b.{c}" for c in keep])


def _completed(spurs: DataFrame, inside: DataFrame, steps: DataFrame, known: DataFrame, wanted: int) -> DataFrame:
    """The least completion of each spur (net, request_id, spur, path, at, banned) that avoids
    its nodes, then its banned next nodes: rows with cost, path and at. Spurs that can't be
    among the request's `wanted` least, with the costs of known, may be left out. A round
    writes the nodes newly come to, those whose least completion meets their beginning go on."""
    one = [*KEY, "spur"]
    starts = spurs.withColumn("node", F.element_at("path", -1)).join(shuffled(steps), ["net", "node"]).where(~F.array_contains("banned", F.col("next")))
    rounds: list[DataFrame] = []
    while True:
        grown = starts.where(~F.array_contains("path", F.col("next"))).select(*one, F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.concat("at", F.array(F.element_at("at", -1) + F.col("weight"))).alias("at"))
        seen = grown.join(shuffled(inside), [*KEY, "node"]).withColumn("cost", F.element_at("at", -1) + F.col("to_go")).where("cost <= bound")
        seen = seen.select(*one, "node", "path", "at", "cost", "tail", "tail_at", F.arrays_overlap("path", "tail").alias("meets"), F.lit(len(rounds)).alias("round"))
        rounds.append(written(seen))
        every = rounds[0]
        for r in rounds[1:]:
            every = every.unionByName(r)
        g = F.element_at("at", -1)
        done = every.where("not meets").select(*one, "cost", F.concat("path", "tail").alias("path"), F.concat("at", F.transform("tail_at", lambda x: g + x)).alias("at"))
        arrived = _first(done, one, ["path", "at"])
        if rounds[-1].where("meets").isEmpty():
            return arrived
        # Of all ways to a spur's node the least stays; it goes on in the round that found it,
        # unless it costs more than the spur's best or than the wanted-th of what is known.
        stuck = every.where("meets").withColumn("o", F.struct(F.element_at("at", -1).alias("g"), F.concat(text(), F.lit(">")).alias("text")))
        least = stuck.groupBy(*one, "node").agg(F.min(F.struct("o", "round", "path", "at", "cost")).alias("b")).select(*one, "node", "b.round", "b.path", "b.at", "b.cost").where(F.col("round") == len(rounds) - 1)
        costs = arrived.select(*KEY, "cost").unionByName(known.select(*KEY, "cost"))
        limit = costs.withColumn("n", F.row_number().over(W.partitionBy(*KEY).orderBy("cost"))).where(F.col("n") == wanted).select(*KEY, F.col("cost").alias("upper"))
        fresh = least.join(shuffled(arrived.select(*one, F.col("cost").alias("own"))), one, "left").join(shuffled(limit), KEY, "left").where("cost <= coalesce(own, cost) and cost <= coalesce(upper, cost)")
        starts = fresh.select(*one, "node", "path", "at").join(shuffled(steps), ["net", "node"])


def _deviations(inside: DataFrame, steps: DataFrame, k: int) -> DataFrame:
    """The k least routes inside the corridors: net, request_id, rank, path, cost."""
    origin = inside.where("is_origin").select(*KEY, F.col("to_go").alias("cost"), F.concat(F.array("node"), "tail").alias("path"), F.concat(F.array(F.lit(0).cast("long")), "tail_at").alias("at"))
    last = written(origin.withColumn("dev", F.lit(1)).withColumn("rank", F.lit(1)))
    taken, waiting = last, last.limit(0).drop("rank")
    for rank in range(1, k):
        spurs = last.where(F.size("path") > 1).select(*KEY, "path", "at", F.explode(F.sequence(F.col("dev"), F.size("path") - 1)).alias("spur"))
        spurs = spurs.select(*KEY, "spur", F.slice("path", 1, F.col("spur")).alias("path"), F.slice("at", 1, F.col("spur")).alias("at"))
        others = taken.select(*KEY, F.col("path").alias("other"))
        shared = spurs.join(shuffled(others), KEY).where((F.size("other") > F.col("spur")) & (F.slice("other", 1, F.col("spur")) == F.col("path")))
        banned = shared.groupBy(*KEY, "spur").agg(F.collect_set(F.element_at("other", F.col("spur") + 1)).alias("banned"), F.first("path").alias("path"), F.first("at").alias("at"))
        found = _completed(banned, inside, steps, waiting, k - rank).withColumnRenamed("spur", "dev")
        pool = waiting.unionByName(found).withColumn("n", F.row_number().over(W.partitionBy(*KEY).orderBy("cost", text()))).where(F.col("n") <= k - rank)
        pool = written(pool)
        last = pool.where("n = 1").drop("n").withColumn("rank", F.lit(rank + 1))
        waiting, taken = pool.where("n > 1").drop("n"), taken.unionByName(last)
    return taken.select(*KEY, "rank", "path", "cost")


def k_routes(requests: DataFrame, edges: DataFrame, k: int, widths: tuple[float | None, ...] = (2.0, 8.0, None)) -> DataFrame:
    """The k least routes of each request in each net: net, request_id, rank, path, cost.
    requests: net, request_id, origin, destination; edges: net, node, next, weight. widths:
    the slacks of the attempts in mean edge weights, the last without limit."""
    edges = written(edges)
    mean = {r["net"]: r["m"] for r in edges.groupBy("net").agg(F.avg("weight").alias("m")).collect()}
    steps = written(edges.groupBy("net", "node", "next").agg(F.min("weight").cast("long").alias("weight")))
    left, done = written(requests), None
    for width in widths:
        slacks = {n: None if width is None else max(1, round(width * m)) for n, m in mean.items()}
        inside = written(corridors(left, edges, slacks))
        found = written(_deviations(inside, steps, k))
        full = found.groupBy(*KEY).agg(F.count("*").alias("n")).join(shuffled(inside.where("is_origin").select(*KEY, "whole")), KEY).where((F.col("n") >= k) | F.col("whole"))
        ready = found.join(shuffled(full.select(*KEY)), KEY, "left_semi")
        done = ready if done is None else done.unionByName(ready)
        if width is None:
            return done
        # Unconnected requests have no corridor: they are not asked again.
        left = written(left.join(shuffled(inside.where("is_origin").select(*KEY)), KEY, "left_semi").join(shuffled(full.select(*KEY)), KEY, "left_anti"))
        if left.isEmpty():
            return done
    raise ValueError("the last width has to be None")


def changes(names: F.Column) -> F.Column:
    """How often neighbours in an array are equal."""
    return F.size(F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: (i > 1) & (F.element_at(names, i) == F.element_at(names, F.greatest(i - 1, F.lit(1))))))


def _two_nets(requests: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Net 0 weighs minutes, net 1 perceived cost (cost_m)."""
    both = F.array(F.struct(F.lit(0).alias("net"), F.col("minutes").cast("long").alias("weight")), F.struct(F.lit(1).alias("net"), F.col("cost_m").cast("long").alias("weight")))
    table = edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("next"), F.explode(both).alias("e")).select("e.net", "node", "next", "e.weight")
    return requests.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("net"), "request_id", "origin", "destination"), table


@tidy
def least_by_both(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """The least route of each request by minutes (net 0) and by cost (net 1)."""
    asked, table = _two_nets(requests, edges)
    return least_routes(written(asked), written(table))


@tidy
def candidates(requests: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Routes of each request: the k quickest by minutes, then those of the k least by
    perceived cost (cost_m) that are not among them. request_id, path, rank (in that order)."""
    asked, table = _two_nets(requests, edges)
    found = k_routes(asked, table, k)
    once = found.groupBy("request_id", "path").agg(F.min(F.struct("net", "rank")).alias("o"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy("o.net", "o.rank"))).select("request_id", "path", "rank")


@tidy
def k_paths(requests: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """k_routes of one network: requests (request_id, origin, destination), edges (from_node,
    to_node, minutes); request_id, path, minutes, rank."""
    table = edges.select(F.lit(0).alias("net"), F.col("from_node").alias("node"), F.col("to_node").alias("next"), F.col("minutes").cast("long").alias("weight"))
    return k_routes(requests.withColumn("net", F.lit(0)), table, k).select("request_id", "path", F.col("cost").alias("minutes"), "rank")
