"""Network and route jobs on part sequences: a brand is a line, a part name a station.

Rule tables (breaks, one-way steps, branches, loops, junctions, rings) are read off the
parts' sizes and brands, so that every rule of the network meets some edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import journeys as J
from ..operators import network as N
from ..operators import routes as R
from ..sources.scratch import delete, exists, temporary, version, written
from .registry import query
from .views import table

Spark = SparkSession
TRANSFER, AGAIN, LOOPS = 4, 3, ("Brand#11", "Brand#21", "Brand#31")


def line_sequence(spark: Spark, d: str) -> DataFrame:
    """Each line's stations once, in the order of their first part: what the parts are read
    for once, since all rules of the network ask for it several times."""
    return kept(spark, d, "sequence", lambda: first_parts(spark, d))


def first_parts(spark: Spark, d: str) -> DataFrame:
    first = table(spark, d, "part").groupBy(F.col("p_brand").alias("line_id"), F.col("p_name").alias("station_name")).agg(F.min(F.struct("p_partkey", "p_size")).alias("p"))
    s = first.select("line_id", "station_name", F.col("p.p_partkey").alias("seq"), F.col("p.p_size").alias("size"), (1 + F.col("p.p_size") % 5).cast("int").alias("minutes"))
    return s.withColumn("pos", F.row_number().over(W.partitionBy("line_id").orderBy("seq")))


LINES = """ls as (select *, cast(row_number() over (partition by line_id order by seq) as integer) as pos from (select p_brand as line_id, p_name as station_name, min(p_partkey) as seq, arg_min(p_size, p_partkey) as size, cast(1 + arg_min(p_size, p_partkey) % 5 as integer) as minutes from part group by 1, 2)),
fst as (select line_id, station_name as prev from ls where pos = 1),
st as (select ls.*, case when size % 10 = 9 then 'b' else 'main' end as branch, size = 17 as one_way, coalesce(case when size = 13 and pos > 2 then fst.prev end, lag(station_name) over (partition by line_id order by pos)) as before from ls join fst using (line_id)),
stp as (select st.*, o.pos as before_pos, case when st.branch <> 'main' and o.size % 10 <> 9 then '@b' else '' end as split from st join ls o on o.line_id = st.line_id and o.station_name = st.before where before <> st.station_name),
both_ways as (select line_id, line_id || '_' || before || split as from_node, line_id || '_' || station_name as to_node, before as from_station, station_name as to_station, before_pos as from_pos, pos as to_pos, minutes, branch, cast(not one_way as integer) as is_bidirectional from stp
 union all select line_id, line_id || '_' || station_name, line_id || '_' || before || split, station_name, before, pos, before_pos, minutes, branch, 1 from stp where not one_way),
lp as (select line_id, max(station_name) filter (pos = 5) as entry, max(station_name) filter (pos = 6) as last, max(station_name) filter (pos = 4) as exit from ls where line_id in ('Brand#11', 'Brand#21', 'Brand#31') group by 1),
ride0 as (select b.* replace (case when from_station = last and to_station = entry then b.line_id || '_' || entry || '@loop' else to_node end as to_node, case when from_station = entry and to_station = exit then b.line_id || '_' || entry || '@loop' else from_node end as from_node,
 case when from_station = entry and to_station = exit then 0 else is_bidirectional end as is_bidirectional) from both_ways b left join lp on lp.line_id = b.line_id)"""
DIRECTIONS = """ride1 as (select *, case when is_bidirectional = 0 then 'down' when branch <> 'main' then case when to_pos > from_pos then branch || '_up' else branch || '_down' end
 when line_id like 'Brand#2%' then case when (to_pos > from_pos) <> (abs(to_pos - from_pos) > 10) then 'inner' else 'outer' end when to_pos > from_pos then 'up' else 'down' end as direction from ride0)"""
VOLUME = "vol as (select p_name as station_name, sum(p_retailprice) as volume from part where p_partkey % 3 = 0 group by 1)"
TRANSFERS = f"""{VOLUME}, nd as (select distinct line_id, from_station as station_name, from_node as node from ride0), mn as (select * from nd where not contains(node, '@')), ow as (select * from nd where contains(node, '@')),
tr0 as (select a.station_name, a.node as from_node, b.node as to_node, {TRANSFER} as minutes, 0 as is_branch_transfer, 1 as is_bidirectional from mn a join mn b on a.station_name = b.station_name and a.line_id <> b.line_id
 union all select ow.station_name, ow.node, mn.node, {AGAIN}, 1, cast(not contains(ow.node, '@loop') as integer) from ow join mn using (line_id, station_name)
 union all select ow.station_name, mn.node, ow.node, {AGAIN}, 1, 1 from ow join mn using (line_id, station_name) where not contains(ow.node, '@loop')),
tr as (select tr0.*, round(least(3.0, coalesce(volume, 0) / 50000.0), 3) as volume_penalty, round(minutes + round(least(3.0, coalesce(volume, 0) / 50000.0), 3), 3) as penalty from tr0 left join vol using (station_name))"""
#: Crowding by line, station, direction and bin; bin 0 is the current one.
LOOK = "lookup as (select distinct line_id, from_station, direction, bin, case when from_pos % 9 <> 4 then cast((from_pos * 37 + length(direction) * 29 + bin * 23) % 160 as double) end as rate from ride1 cross join (select unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) as bin))"
ALL = f"""{LINES}, {DIRECTIONS}, {TRANSFERS}, {LOOK}, mult as (select distinct p_name as from_station, 1.25 as mult from part where p_size = 1),
r2 as (select ride1.*, rate from ride1 left join (select * from lookup where bin = 0) k on k.line_id = ride1.line_id and k.from_station = ride1.from_station and k.direction is not distinct from ride1.direction),
r3 as (select *, coalesce(rate, median(rate) over (partition by line_id, direction), median(rate) over ()) as usual from r2),
r4 as (select r3.*, usual * coalesce(mult, 1.0) as cong from r3 left join mult using (from_station)),
ride as (select *, cast(round(minutes * (1000 + 5 * greatest(cong - 80, 0.0))) as integer) as cost_m, cast(round(minutes * (1000 + 5 * greatest(cong - 80, 0.0))) as integer) - cast(round(minutes * (1000 + 5 * greatest(usual - 80, 0.0))) as integer) as event_m from r4),
edge as materialized (select from_node, to_node, 'ride' as kind, line_id, minutes, cost_m, event_m, cong, direction, branch from ride union all select from_node, to_node, 'transfer', null, minutes, cast(round(penalty * 1000) as integer), 0, null, null, null from tr)"""


def branch() -> F.Column:
    return F.when(F.col("size") % 10 == 9, "b").otherwise("main")


def breaks(s: DataFrame) -> DataFrame:
    """Stations that follow the line's first one instead of the one before them."""
    first = s.where("pos = 1").select("line_id", F.col("station_name").alias("prev"))
    return s.where("size = 13 and pos > 2").select("line_id", "station_name").join(R.shuffled(first), "line_id")


def loops(s: DataFrame) -> DataFrame:
    at = lambda k, name: F.max(F.when(F.col("pos") == k, F.col("station_name"))).alias(name)
    return s.where(F.col("line_id").isin(*LOOPS)).groupBy("line_id").agg(at(5, "entry"), at(6, "last"), at(4, "exit"))


def raw_rides(spark: Spark, d: str) -> DataFrame:
    s = line_sequence(spark, d)
    return N.split_loop_end(N.ride_edges(s, breaks(s), branch(), F.col("size") == 17), loops(s))


def directed(spark: Spark, d: str) -> DataFrame:
    return raw_rides(spark, d).withColumn("direction", N.edge_direction(F.col("line_id").startswith("Brand#2")))


def transfers(spark: Spark, d: str, rides: DataFrame) -> DataFrame:
    volumes = table(spark, d, "part").where("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("station_name")).agg(F.sum("p_retailprice").alias("volume"))
    return N.transfer_edges(rides, volumes, TRANSFER, AGAIN)


def lookup(rides: DataFrame) -> DataFrame:
    """Crowding by line, station, direction and bin (0: the current one)."""
    bins = rides.withColumn("bin", F.explode(F.sequence(F.lit(-4), F.lit(4))))
    rate = F.when(F.col("from_pos") % 9 != 4, ((F.col("from_pos") * 37 + F.length("direction") * 29 + F.col("bin") * 23) % 160).cast("double"))
    return bins.select("line_id", "from_station", "direction", "bin", rate.alias("rate")).distinct()


def crowded_rides(spark: Spark, d: str) -> DataFrame:
    rides = written(directed(spark, d))
    events = table(spark, d, "part").where("p_size = 1").select(F.col("p_name").alias("station_name"), F.lit(1.25).alias("mult")).distinct()
    return N.crowded(rides, lookup(rides).where("bin = 0").drop("bin"), events)


def all_edges(spark: Spark, d: str) -> DataFrame:
    rides = written(crowded_rides(spark, d))
    columns = ["from_node", "to_node", "kind", "line_id", "minutes", "cost_m", "event_m", "cong", "direction", "branch"]
    walks = transfers(spark, d, rides).withColumn("cost_m", F.round(F.col("penalty") * 1000).cast("int")).select("from_node", "to_node", F.lit("transfer").alias("kind"), "minutes", "cost_m", F.lit(0).alias("event_m"))
    return rides.withColumn("kind", F.lit("ride")).select(*columns).unionByName(walks, allowMissingColumns=True)


@query("E2_ride_edges", f"with {LINES} select line_id, from_station, to_station, minutes, is_bidirectional from both_ways")
def consecutive(spark: Spark, d: str) -> DataFrame:
    """Steps of the sequences with breaks, before loops are split."""
    s = line_sequence(spark, d)
    return N.ride_edges(s, breaks(s), branch(), F.col("size") == 17).select("line_id", "from_station", "to_station", "minutes", "is_bidirectional")


@query("R1_ride_edges", f"with {LINES} select from_node, to_node, line_id, minutes, branch, is_bidirectional from ride0")
def split_edges(spark: Spark, d: str) -> DataFrame:
    return raw_rides(spark, d).select("from_node", "to_node", "line_id", "minutes", "branch", "is_bidirectional")


@query("R2_transfer_edges", f"with {LINES}, {TRANSFERS} select * from tr")
def transfer_table(spark: Spark, d: str) -> DataFrame:
    return transfers(spark, d, written(raw_rides(spark, d)))


@query("R3_edge_direction", f"with {LINES}, {DIRECTIONS} select from_node, to_node, branch, direction from ride1")
def directions(spark: Spark, d: str) -> DataFrame:
    return directed(spark, d).select("from_node", "to_node", "branch", "direction")


R4 = f"""with recursive {ALL}, nodes as (select from_node as node from ride union select to_node from ride),
fw as (select node as source, node from nodes where node in (select min(node) from nodes group by split_part(node, '_', 1)) union select fw.source, ride.to_node from fw join ride on ride.from_node = fw.node),
bw as (select node as source, node from nodes where node in (select min(node) from nodes group by split_part(node, '_', 1)) union select bw.source, ride.from_node from bw join ride on ride.to_node = bw.node),
pr as (select node as a, node as b from nodes union select pr.a, ride.to_node from pr join ride on ride.from_node = pr.b), sc as (select x.a as node, min(x.b) as strong_component from pr x join pr y on y.a = x.b and y.b = x.a group by 1),
wk as (select node, node as seen from nodes union select wk.node, e.b from wk join (select from_node as a, to_node as b from ride union select to_node, from_node from ride) e on e.a = wk.seen)
select n.node, c.component, sc.strong_component, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) as in_degree, fw.node is not null as is_reached, bw.node is not null as reaches_root from nodes n join sc using (node) join (select node, min(seen) as component from wk group by 1) c using (node)
 left join (select from_node as node, count(*) as n from ride group by 1) o using (node) left join (select to_node as node, count(*) as n from ride group by 1) i using (node) left join fw using (node) left join bw using (node)"""


@query("R4_connectivity", R4)
def connectivity(spark: Spark, d: str) -> DataFrame:
    """Components, strongly connected ones, degrees, and what each line's least node reaches or
    is reached from (neither way: isolated)."""
    r = written(raw_rides(spark, d))
    nodes = written(r.select(F.col("from_node").alias("node")).union(r.select("to_node")).distinct())
    roots = nodes.groupBy(S.node_line(F.col("node"))).agg(F.min("node").alias("node")).select("node")
    out = N.reachable(nodes, r).join(N.strong_components(nodes, r), "node")
    degree = lambda c, name: r.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(name))
    for frame in (degree("from_node", "out_degree"), degree("to_node", "in_degree")):
        out = out.join(frame, "node", "left")
    out = out.na.fill(0, ["out_degree", "in_degree"])
    for name, a, b in (("is_reached", "from_node", "to_node"), ("reaches_root", "to_node", "from_node")):
        found = N.reached(roots, r.select(F.col(a).alias("from_node"), F.col(b).alias("to_node")))
        out = out.join(found.withColumn(name, F.lit(True)), "node", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


KEEP = 3
#: Slacks of the SQL's walks over the least cost, in minutes: a request walks with the next
#: one only while it has fewer routes than asked.
SLACKS = (0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 18, 22, 28, 36, 50, 80)
REQ = "req as materialized (select seq as request_id, origin, destination from (select seq, line_id || '_' || station_name as origin, line_id || '_' || lead(station_name, 3) over (partition by line_id order by pos) as destination from ls) where destination is not null), ends as (select distinct destination, destination as node from req)"


#: SQL: nodes and edges by number, and req's rows with numbered ends (k: a destination).
NUMBERS = """nid as materialized (select node, cast(row_number() over (order by node) as integer) as id from (select from_node as node from edge union select to_node from edge)), called as materialized (select list(node order by id) as names from nid),
ei as materialized (select a.id as f, b.id as t, min(minutes) as minutes, min(cost_m) as cost_m from edge join nid a on a.node = from_node join nid b on b.node = to_node group by 1, 2), dk as materialized (select destination, cast(row_number() over (order by destination) as integer) as k from (select distinct destination from ends)),
rq as materialized (select request_id, k, nid.id as origin from req join dk using (destination) join nid on nid.node = req.origin), dest as materialized (select k, nid.id as node from ends join dk using (destination) join nid using (node))"""


def walks(tag: str, weight: str, unit: int, k: int, slacks: tuple[int, ...] = SLACKS, stop: bool = True) -> str:
    """SQL after NUMBERS: found_<tag> with the k least of all loop-free paths of each row of req
    up to the first slack that gives k of them; stop: a path ends at its destination's node."""
    parts = [f"""go_{tag}(k, node, h) using key (k, node) as (select k, node, 0 from dest
 union select t.k, e.f, min(t.h + e.{weight}) from go_{tag} t join ei e on e.t = t.node left join recurring.go_{tag} r on r.k = t.k and r.node = e.f where r.h is null or t.h + e.{weight} < r.h group by 1, 2),
to_{tag} as materialized (select * from go_{tag}), least_{tag} as materialized (select request_id, min(h) as h from rq join to_{tag} g on g.k = rq.k and g.node = rq.origin group by 1)"""]
    for i, slack in enumerate(slacks):
        enough = f"(select request_id from f_{tag}{i - 1} group by 1 having count(*) >= {k})"
        asked = f"(select * from rq where request_id not in {enough})" if i else "rq"
        parts.append(f"""w_{tag}{i} as (select q.request_id, q.k, q.origin as node, [q.origin] as path, 0 as g, l.h + {slack * unit} as bound from {asked} q join least_{tag} l on l.request_id = q.request_id join to_{tag} t on t.k = q.k and t.node = q.origin where t.h <= l.h + {slack * unit}
 union all select w.request_id, w.k, e.t, list_append(w.path, e.t), w.g + e.{weight}, w.bound from w_{tag}{i} w join ei e on e.f = w.node join to_{tag} t on t.k = w.k and t.node = e.t where {f"not exists (select 1 from dest where dest.k = w.k and dest.node = w.node) and " if stop else ""}not list_contains(w.path, e.t) and w.g + e.{weight} + t.h <= w.bound),
f_{tag}{i} as materialized (select w.request_id, w.path, w.g from w_{tag}{i} w join dest on dest.k = w.k and dest.node = w.node{f" union all select * from f_{tag}{i - 1} where request_id in {enough}" if i else ""})""")
    last = f"(select request_id, list_transform(path, lambda i: names[i]) as path, g from f_{tag}{len(slacks) - 1} cross join called)"
    return ",\n".join(parts) + f",\nfound_{tag} as (select request_id, path, g, row_number() over (partition by request_id order by g, array_to_string(path, '>')) as r from {last} qualify r <= {k})"


LEAST = f"""with recursive {ALL}, {REQ}, {NUMBERS}, {walks("t", "minutes", 1, 1, (0,))}, {walks("c", "cost_m", 1000, 1, (0,))}, both_least as (select 'time' as weight, * from found_t union all select 'cost', * from found_c)"""


def requests(spark: Spark, d: str) -> DataFrame:
    """From every station to the third one after it on its line."""
    s = line_sequence(spark, d).withColumn("origin", S.node_id(F.col("line_id"), F.col("station_name"))).withColumn("destination", F.lead("origin", 3).over(W.partitionBy("line_id").orderBy("pos")))
    return s.where("destination is not null").select(F.col("seq").alias("request_id"), "origin", "destination")


def least(spark: Spark, d: str) -> DataFrame:
    found = R.least_by_both(requests(spark, d), all_edges(spark, d))
    return found.withColumn("weight", F.when(F.col("net") == 0, "time").otherwise("cost")).drop("net")


@query("R5_distances", LEAST + " select weight, request_id, cast(g as bigint) as cost from both_least")
def bulk_distances(spark: Spark, d: str) -> DataFrame:
    """Least minutes and least perceived cost of all requests."""
    return least(spark, d).select("weight", "request_id", "cost")


@query("R5_shortest_paths", LEAST + """, named as (select weight, request_id, g, path, list_transform(path, lambda x: regexp_replace(regexp_replace(x, '^[^_]*_', ''), '@[^@]*$', '')) as names from both_least)
select weight, request_id, cast(g as bigint) as cost, array_to_string(path, '>') as path, cast(len(path) - 1 as integer) as stops, cast(len(list_filter(generate_series(2, len(path)), lambda i: names[i] = names[i - 1])) as integer) as transfers from named""")
def bulk_paths(spark: Spark, d: str) -> DataFrame:
    """The same with the least path, its stops and its transfers (neighbours of one station)."""
    found = least(spark, d).withColumn("names", F.transform("path", S.node_station))
    return found.select("weight", "request_id", "cost", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("stops"), R.changes(F.col("names")).alias("transfers"))


PATHS = f"""{ALL}, {REQ}, {NUMBERS}, {walks("t", "minutes", 1, KEEP)}, {walks("c", "cost_m", 1000, KEEP)},
quick as (select request_id, path, 0 as list, r from found_t), calm as (select request_id, path, 1 as list, r from found_c),
paths as materialized (select request_id, path, cast(row_number() over (partition by request_id order by list, r) as integer) as rank from (select * from quick union all select calm.* from calm where not exists (select 1 from quick where quick.request_id = calm.request_id and quick.path = calm.path)))"""

_searched: dict[tuple, dict[str, DataFrame]] = {}


def kept(spark: Spark, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, written once and kept while the table that all routes come from (its
    files, their sizes and times) and the written files are the same: all evaluations of
    routes start from the same search. forget() deletes what is kept."""
    key = (spark.sparkContext.applicationId, d, version(spark, f"{d}/part.parquet"))
    of = _searched.setdefault(key, {})
    if name not in of or not all(exists(spark, f) for f in of[name].inputFiles()):
        with temporary(spark) as keep:
            made = keep(make())
        of[name] = made
    return of[name]


def forget(spark: Spark) -> None:
    """Deletes all that is kept."""
    for of in _searched.values():
        for df in of.values():
            delete(spark, df)
    _searched.clear()


def paths(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidate routes and the edges."""
    line_sequence(spark, d)  # before the blocks whose rounds are deleted
    edges = kept(spark, d, "edges", lambda: all_edges(spark, d))
    return kept(spark, d, "routes", lambda: R.candidates(requests(spark, d), edges, KEEP)), edges


@query("R6_k_paths", f"with recursive {PATHS} select request_id, array_to_string(path, '>') as route, rank from paths", whole=True)
def k_routes(spark: Spark, d: str) -> DataFrame:
    return paths(spark, d)[0].select("request_id", F.array_join("path", ">").alias("route"), "rank")


NAMES = "regexp_replace(regexp_replace({0}, '^[^_]*_', ''), '@[^@]*$', '')"
STEPS0 = f"""{PATHS}, ix as (select request_id, rank, path, unnest(generate_series(1, len(path) - 1)) as pos from paths), steps as (select ix.request_id, ix.rank, cast(pos - 1 as integer) as pos, path[pos] as from_node, path[pos + 1] as to_node from ix),
fs0 as (select s.*, e.* exclude (from_node, to_node) from steps s left join edge e using (from_node, to_node))"""
#: Junctions of some lines are passed through: the node before a junction is its trunk.
STEPS = f"""{STEPS0}, jn as (select distinct s.line_id || '_' || s.before as node, s.line_id || '_' || s.before || '@b' as own, s.line_id || '_' || t.station_name as trunk from stp s join ls t on t.line_id = s.line_id and t.pos = s.before_pos - 1 where s.split = '@b' and s.line_id like 'Brand#_1'),
ft as (select *, lag(from_node) over w as bn, lead(to_node) over w as an from fs0 window w as (partition by request_id, rank order by pos)),
full_steps as (select ft.* exclude (bn, an), coalesce(kind = 'transfer', false) and exists (select 1 from jn where least(ft.from_node, ft.to_node) = least(jn.node, jn.own) and greatest(ft.from_node, ft.to_node) = greatest(jn.node, jn.own) and (ft.bn is not distinct from jn.trunk or ft.an is not distinct from jn.trunk)) as is_through from ft)"""


def junctions(spark: Spark, d: str) -> DataFrame:
    s = line_sequence(spark, d).where("line_id like 'Brand#_1'")
    trunk = s.select("line_id", (F.col("pos") + 1).alias("from_pos"), S.node_id(F.col("line_id"), F.col("station_name")).alias("trunk"))
    r = raw_rides(spark, d).where("from_node like '%@b'").select("line_id", "from_pos", F.col("from_node").alias("own")).distinct()
    return r.join(R.shuffled(trunk), ["line_id", "from_pos"]).select(F.regexp_replace("own", "@b$", "").alias("node"), "own", "trunk")


def steps(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Steps of all candidate routes with their edges' attributes and through passes."""
    p, edges = paths(spark, d)
    return kept(spark, d, "steps", lambda: J.through_pass(N.path_edges(p, edges), junctions(spark, d))), edges


def line_or_walk() -> F.Column:
    return F.when(F.col("kind") == "transfer", "walk").otherwise(S.node_line(F.col("from_node")))


def parts(spark: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, edges = steps(spark, d)
    return N.segments(s, line_or_walk()), s, edges


@query("R10_through_pass", f"with recursive {STEPS} select request_id, rank, pos, is_through from full_steps")
def through_passes(spark: Spark, d: str) -> DataFrame:
    return steps(spark, d)[0].select("request_id", "rank", "pos", "is_through")


@query("R8_station_revisit", f"with recursive {PATHS}, x as (select request_id, rank, {NAMES.format('unnest(path)')} as st, unnest(generate_series(1, len(path))) as i from paths), y as (select *, lag(st) over (partition by request_id, rank order by i) as b from x) select request_id, rank, count(*) > count(distinct st) as revisits from y where b is null or b <> st group by 1, 2")
def revisits(spark: Spark, d: str) -> DataFrame:
    names = F.transform("path", S.node_station)
    kept = F.filter(F.transform(F.sequence(F.lit(1), F.size("names")), lambda i: F.when((i == 1) | (F.element_at("names", i) != F.element_at("names", F.greatest(i - 1, F.lit(1)))), F.element_at("names", i))), lambda x: x.isNotNull())
    return paths(spark, d)[0].withColumn("names", names).select("request_id", "rank", (F.size(kept) > F.size(F.array_distinct(kept))).alias("revisits"))


SEG = f"""{STEPS}, l as (select *, case when kind = 'transfer' then 'walk' else split_part(from_node, '_', 1) end as line from full_steps where not is_through), n as (select *, case when lag(line) over w is null or lag(line) over w <> line then 1 else 0 end as is_new from l window w as (partition by request_id, rank order by pos)),
g as (select *, cast(sum(is_new) over (partition by request_id, rank order by pos rows unbounded preceding) as bigint) as segment from n)"""


@query("E8_segments", f"with recursive {SEG} select request_id, rank, segment, line, count(*) as n_edges, cast(sum(minutes) as bigint) as minutes, case when line = 'walk' then 0 else count(*) - 1 end::bigint as dwell_stops from g group by 1, 2, 3, 4")
def route_segments(spark: Spark, d: str) -> DataFrame:
    return N.segment_sums(parts(spark, d)[0])


SEATS = "ma as (select from_node as to_node, avg(cong) as m from edge where kind = 'ride' and cong is not null group by 1), seat as (select request_id, rank, avg(cong - m) / 10 as s from full_steps join ma using (to_node) where kind = 'ride' and cong is not null group by 1, 2)"


@query("R11_seat_score", f"with recursive {STEPS}, {SEATS} select a.request_id, a.rank, round(coalesce(s, 0), 9) as seat_score from (select distinct request_id, rank from full_steps) a left join seat using (request_id, rank)")
def seats(spark: Spark, d: str) -> DataFrame:
    return J.seat_scores(*steps(spark, d)).withColumn("seat_score", F.round("seat_score", 9))


EVAL = f"""{SEG}, {SEATS}, hi as (select quantile_cont(rate, 0.95) as p95 from lookup where bin = 0), ne as (select request_id, rank, count(*) as n_edges from full_steps group by 1, 2),
ev0 as (select request_id, rank, cast(coalesce(sum(minutes) filter (kind = 'ride'), 0) as bigint) as running, cast(coalesce(sum(minutes) filter (kind = 'transfer'), 0) as bigint) as walking, sum(cost_m) as felt, count(*) filter (kind = 'ride') - count(distinct segment) filter (kind = 'ride') as dwell_stops,
 round(avg(cong) filter (kind = 'ride'), 6) as avg_cong, round(max(cong) filter (kind = 'ride'), 6) as max_cong, count(*) filter (kind = 'ride' and cong >= (select p95 from hi)) as exposures, count(*) filter (kind = 'transfer') as transfers, coalesce(sum(cost_m) filter (kind = 'transfer'), 0) as pen, sum(coalesce(event_m, 0)) as evm from g group by 1, 2),
ev as materialized (select request_id, rank, running, dwell_stops * 0.5::double as dwell, walking, running + walking + dwell_stops * 0.5::double as actual, round(felt / 1000.0::double, 3) + dwell_stops * 0.5::double as perceived, dwell_stops, avg_cong, max_cong, exposures, transfers, round(pen / 1000.0::double, 3) as transfer_penalty, round(evm / 1000.0::double, 3) as event_risk, round(coalesce(s, 0), 6) as seat_score, n_edges - transfers as n_stops
 from ev0 join ne using (request_id, rank) left join seat using (request_id, rank))"""


def evaluated(spark: Spark, d: str) -> DataFrame:
    p, s, edges = parts(spark, d)
    rides = edges.where("kind = 'ride'")
    high = lookup(directed(spark, d)).where("bin = 0").agg(F.percentile("rate", 0.95).alias("p95"))
    return J.evaluate(p, s.groupBy("request_id", "rank").agg(F.count("*").alias("n_edges")), J.seat_scores(s, rides), high)


@query("R9_path_evaluation", f"with recursive {EVAL} select * from ev", whole=True)
def evaluation(spark: Spark, d: str) -> DataFrame:
    return evaluated(spark, d)


AXES = ["actual", "max_cong", "transfer_penalty"]
PARETO = f"{EVAL}, pf as (select a.*, not exists (select 1 from ev b where b.request_id = a.request_id and b.actual <= a.actual and coalesce(b.max_cong, 1e300) <= coalesce(a.max_cong, 1e300) and b.transfer_penalty <= a.transfer_penalty and (b.actual < a.actual or coalesce(b.max_cong, 1e300) < coalesce(a.max_cong, 1e300) or b.transfer_penalty < a.transfer_penalty)) as is_pareto from ev a)"


@query("R14_pareto", f"with recursive {PARETO} select request_id, rank, actual, max_cong, transfer_penalty, is_pareto from pf")
def pareto_routes(spark: Spark, d: str) -> DataFrame:
    return N.pareto(evaluated(spark, d), "request_id", "rank", AXES).select("request_id", "rank", *AXES, "is_pareto")


#: What each mode weighs.
MODES = {"fast": (1.0, 0.0, 0.0, 0.3, 0.0), "calm": (0.0, 1.0, 0.05, 0.5, 0.0), "min_transfer": (0.5, 0.5, 0.0, 3.0, 0.0), "balanced": (0.3, 0.7, 0.03, 0.8, 0.5)}
RANKED = f"""{PARETO}, f as (select request_id, arg_min(struct_pack(t := actual, c := max_cong, a := avg_cong, p := perceived), actual * 1000 + rank) as f from ev group by 1),
cmp as (select pf.*, round(actual / f.t, 9) as stretch, actual - f.t as time_loss, round(f.c - max_cong, 6) as cong_drop, round(f.a - avg_cong, 6) as avg_drop, round(f.p - perceived, 6) as perceived_gain from pf join f using (request_id)),
md as (select * from (values {", ".join(f"('{m}', {', '.join(f'{x}::double' for x in w)})" for m, w in MODES.items())}) t(mode, wa, wp, wm, wt, ws)),
rk as (select mode, cmp.*, round(wa * actual + wp * perceived + wm * coalesce(max_cong, 0) + wt * transfer_penalty - ws * seat_score, 9) as score, row_number() over (partition by mode, request_id order by round(wa * actual + wp * perceived + wm * coalesce(max_cong, 0) + wt * transfer_penalty - ws * seat_score, 9), rank) as route_rank from cmp cross join md)"""


def compared(spark: Spark, d: str) -> DataFrame:
    e = N.pareto(evaluated(spark, d), "request_id", "rank", AXES)
    fast = e.groupBy("request_id").agg(F.min_by(F.struct(F.col("actual").alias("t"), F.col("max_cong").alias("c"), F.col("avg_cong").alias("a"), F.col("perceived").alias("p")), F.struct("actual", "rank")).alias("f"))
    return e.join(R.shuffled(fast), "request_id").select(
        *e.columns, F.round(F.col("actual") / F.col("f.t"), 9).alias("stretch"), (F.col("actual") - F.col("f.t")).alias("time_loss"), F.round(F.col("f.c") - F.col("max_cong"), 6).alias("cong_drop"),
        F.round(F.col("f.a") - F.col("avg_cong"), 6).alias("avg_drop"), F.round(F.col("f.p") - F.col("perceived"), 6).alias("perceived_gain"),
    )


def ranked(spark: Spark, d: str) -> DataFrame:
    """Every route in every mode with its score and rank in it."""
    return kept(spark, d, "ranked", lambda: ranks(compared(spark, d)))


def ranks(routes: DataFrame) -> DataFrame:
    weights = F.array(*[F.struct(F.lit(m).alias("mode"), *[F.lit(x).alias(n) for n, x in zip(("wa", "wp", "wm", "wt", "ws"), w, strict=True)]) for m, w in MODES.items()])
    each = routes.withColumn("m", F.explode(weights))
    score = F.round(F.col("m.wa") * F.col("actual") + F.col("m.wp") * F.col("perceived") + F.col("m.wm") * F.coalesce("max_cong", F.lit(0.0)) + F.col("m.wt") * F.col("transfer_penalty") - F.col("m.ws") * F.col("seat_score"), 9)
    return each.withColumn("mode", F.col("m.mode")).withColumn("score", score).drop("m").withColumn("route_rank", F.row_number().over(W.partitionBy("mode", "request_id").orderBy("score", "rank")))


@query("E6_fastest_comparators", f"with recursive {RANKED} select request_id, rank, stretch, time_loss, cong_drop, avg_drop, perceived_gain from cmp")
def comparators(spark: Spark, d: str) -> DataFrame:
    return compared(spark, d).select("request_id", "rank", "stretch", "time_loss", "cong_drop", "avg_drop", "perceived_gain")


@query("E7_mode_rank", f"with recursive {RANKED} select mode, request_id, rank, score, cast(route_rank as integer) as route_rank from rk")
def mode_ranks(spark: Spark, d: str) -> DataFrame:
    return ranked(spark, d).select("mode", "request_id", "rank", "score", "route_rank")


EK = "ek as (select request_id, rank, list_transform(generate_series(1, len(path) - 1), lambda i: path[i] || '>' || path[i + 1]) as ks, path as ns from paths)"


def with_keys(spark: Spark, d: str) -> DataFrame:
    keys = paths(spark, d)[0].select("request_id", "rank", N.edge_keys().alias("ks"), F.col("path").alias("ns"))
    return ranked(spark, d).join(R.shuffled(keys), ["request_id", "rank"])


JAC = "round(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))), 9)"


@query("R15_overlap", f"""with recursive {RANKED}, {EK}, x as (select mode, request_id, rank, route_rank, ks, ns from rk join ek using (request_id, rank)),
t3 as (select a.mode, a.request_id, round(avg(len(list_intersect(a.ks, b.ks)) / len(list_distinct(list_concat(a.ks, b.ks)))), 9) as mean_top3 from x a join x b on a.mode = b.mode and a.request_id = b.request_id and a.route_rank < b.route_rank and b.route_rank <= 3 group by 1, 2)
select a.mode, a.request_id, a.rank, {JAC.format('a.ks', 'b.ks')} as to_first, {JAC.format('a.ns', 'b.ns')} as nodes_to_first, mean_top3 from x a join x b on a.mode = b.mode and a.request_id = b.request_id and b.route_rank = 1 left join t3 on t3.mode = a.mode and t3.request_id = a.request_id""")
def overlaps(spark: Spark, d: str) -> DataFrame:
    x = with_keys(spark, d).select("mode", "request_id", "rank", "route_rank", "ks", "ns")
    first = x.where("route_rank = 1").select("mode", "request_id", F.col("ks").alias("ks1"), F.col("ns").alias("ns1"))
    top = x.where("route_rank <= 3").select("mode", "request_id", "route_rank", "ks")
    pairs = top.join(R.shuffled(top.toDF("mode", "request_id", "other", "ks2")), ["mode", "request_id"]).where("route_rank < other").groupBy("mode", "request_id").agg(F.round(F.avg(N.jaccard("ks", "ks2")), 9).alias("mean_top3"))
    return x.join(R.shuffled(first), ["mode", "request_id"]).join(R.shuffled(pairs), ["mode", "request_id"], "left").select("mode", "request_id", "rank", F.round(N.jaccard("ks", "ks1"), 9).alias("to_first"), F.round(N.jaccard("ns", "ns1"), 9).alias("nodes_to_first"), "mean_top3")


def greedy(name: str, order: str, over: str, keys: str = "ks") -> str:
    """Greedy duplicates by recursion over each request's routes in the given order."""
    return f"""o_{name} as (select mode, request_id, rank, {keys} as k, row_number() over (partition by mode, request_id order by {order}) as i from rk join ek using (request_id, rank)),
w_{name} as (select mode, request_id, rank, i, [k] as kept, false as dup from o_{name} where i = 1 union all select o.mode, o.request_id, o.rank, o.i, case when x.dup then w.kept else list_append(w.kept, o.k) end, x.dup
 from w_{name} w join o_{name} o on o.mode = w.mode and o.request_id = w.request_id and o.i = w.i + 1, lateral (select {over} as dup) x)"""


NEAR = "len(list_filter(w.kept, lambda y: len(list_intersect(y, o.k)) > 0.65 * len(list_distinct(list_concat(y, o.k))))) > 0"
DUP = f"{RANKED}, {EK}, {greedy('p', 'not is_pareto, route_rank', NEAR)}"
SERVICE = f"{greedy('s', 'route_rank', NEAR + ' or len(w.kept) >= 4')}"
NODES = f"{greedy('n', 'route_rank', NEAR.replace('> 0.65', '>= 0.65'), 'ns')}"


def marked(spark: Spark, d: str, service: str | None = None) -> DataFrame:
    """Near duplicates, Pareto routes first; service: by score, at most four ("edges"), or by
    shared nodes ("nodes")."""
    rows = with_keys(spark, d).withColumn("later", (~F.col("is_pareto")).cast("int"))
    order = ["later", "route_rank", "rank"] if service is None else ["route_rank", "rank"]
    return N.diverse(rows, ["mode", "request_id"], order, "ns" if service == "nodes" else "ks", 0.65, 4 if service == "edges" else None, service == "nodes").select("mode", "request_id", "rank", "is_near_duplicate")


@query("R16_diverse", f"with recursive {DUP}, {SERVICE}, {NODES} select p.mode, p.request_id, p.rank, p.dup as is_near_duplicate, s.dup as left_by_service, n.dup as alike_in_nodes from w_p p join w_s s using (mode, request_id, rank) join w_n n using (mode, request_id, rank)")
def diverse_routes(spark: Spark, d: str) -> DataFrame:
    keys = ["mode", "request_id", "rank"]
    out = marked(spark, d)
    for kind, name in (("edges", "left_by_service"), ("nodes", "alike_in_nodes")):
        out = out.join(R.shuffled(marked(spark, d, service=kind).withColumnRenamed("is_near_duplicate", name)), keys)
    return out


VIOLATIONS = "vl as (select request_id, rank, count(*) filter (kind is null) + count(*) filter (split_part(to_node, '_', 1) = 'Brand#7') as violations from full_steps group by 1, 2)"
POLICY = f"""{DUP}, {VIOLATIONS}, q as (select rk.*, dup as is_near_duplicate, violations from rk join w_p using (mode, request_id, rank) join vl using (request_id, rank)),
q2 as (select *, route_rank > 1 and violations = 0 and not is_near_duplicate and time_loss <= 15 and coalesce(cong_drop >= 15, false) and perceived_gain >= -5 as is_alternative from q),
q3 as (select *, bool_or(is_alternative) over (partition by mode, request_id) as has_alternative from q2),
q4 as (select *, case when route_rank = 1 then 'primary' when not has_alternative then 'no_meaningful_alternative' when is_alternative then 'meaningful_alternative' when is_near_duplicate then 'near_duplicate' else 'rejected' end as policy from q3)"""


def violations(s: DataFrame) -> DataFrame:
    """Q5's counts by route: missing edges, nodes of lines out of scope, transfers, and where."""
    change = F.col("kind").eqNullSafe(F.lit("transfer")) & ~F.col("is_through")
    return s.groupBy("request_id", "rank").agg(
        F.count(F.when(F.col("kind").isNull(), 1)).alias("missing_edges"), F.count(F.when(S.node_line(F.col("to_node")) == "Brand#7", 1)).alias("out_of_scope"), F.count(F.when(change, 1)).alias("transfers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(change, F.struct("pos", S.node_station(F.col("from_node")).alias("station"))))), lambda x: x["station"]), ";").alias("transfer_stations"),
    )


def with_policy(spark: Spark, d: str) -> tuple[DataFrame, dict[str, F.Column]]:
    broken = violations(steps(spark, d)[0]).select("request_id", "rank", (F.col("missing_edges") + F.col("out_of_scope")).alias("violations"))
    rows = ranked(spark, d).join(R.shuffled(marked(spark, d)), ["mode", "request_id", "rank"]).join(R.shuffled(broken), ["request_id", "rank"])
    return J.policies(rows, ["mode", "request_id"])


@query("R17_alternatives", f"with recursive {POLICY} select mode, request_id, rank, is_alternative, has_alternative, policy from q4", whole=True)
def alternatives(spark: Spark, d: str) -> DataFrame:
    return with_policy(spark, d)[0].select("mode", "request_id", "rank", "is_alternative", "has_alternative", "policy")


CONDS = {"not_near_dup": "not is_near_duplicate", "time_loss": "time_loss <= 15", "cong_drop": "coalesce(cong_drop >= 15, false)", "perceived": "perceived_gain >= -5"}
R18 = "select mode, " + ", ".join(f"count(*) filter (route_rank > 1 and {' and '.join(c for m, c in CONDS.items() if m != n)} and not ({CONDS[n]})) as {n}" for n in CONDS) + " from q4 group by 1"
R18 = f"with recursive {POLICY}, b as ({R18}) select *, concat_ws(';', " + ", ".join(f"case when {n} > 0 then '{n}(' || {n} || ')' end" for n in CONDS) + ") as blocking from b"


@query("R18_blockers", R18)
def blocking(spark: Spark, d: str) -> DataFrame:
    rows, conditions = with_policy(spark, d)
    return J.blockers(rows, conditions, ["mode"])


SUMMARY = f"""{POLICY}, sm as (select md.mode, req.request_id, count(q4.rank) as n_routes, count(*) filter (is_pareto) as n_pareto, min(stretch) filter (is_alternative) as best_stretch, max(cong_drop) as best_cong_drop, max(perceived_gain) as best_perceived_gain, count(*) filter (is_near_duplicate) as n_near_duplicates,
 coalesce(bool_or(is_alternative), false) as has_alternative, max(rank) filter (route_rank = 1) as selected, count(*) filter (violations > 0) as n_violations, case when count(q4.rank) = 0 then 'no_route' else 'routes' end as reason
 from req cross join md left join q4 on q4.mode = md.mode and q4.request_id = req.request_id group by 1, 2),
tp as (select a.mode, a.request_id, round(avg(len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k)))), 9) as mean_top3 from (select o_p.*, route_rank from o_p join rk using (mode, request_id, rank)) a join (select o_p.*, route_rank from o_p join rk using (mode, request_id, rank)) b on a.mode = b.mode and a.request_id = b.request_id and a.route_rank < b.route_rank and b.route_rank <= 3 group by 1, 2)"""


def summaries(spark: Spark, d: str) -> DataFrame:
    """A row for each request in each mode, with 0 candidates where it has no route."""
    q, top = with_policy(spark, d)[0], overlaps(spark, d).select("mode", "request_id", "mean_top3").distinct()
    s = q.groupBy("mode", "request_id").agg(
        F.count("*").alias("n_routes"), F.count(F.when(F.col("is_pareto"), 1)).alias("n_pareto"), F.min(F.when(F.col("is_alternative"), F.col("stretch"))).alias("best_stretch"), F.max("cong_drop").alias("best_cong_drop"), F.max("perceived_gain").alias("best_perceived_gain"),
        F.count(F.when(F.col("is_near_duplicate"), 1)).alias("n_near_duplicates"), F.bool_or("is_alternative").alias("has_alternative"), F.max(F.when(F.col("route_rank") == 1, F.col("rank"))).alias("selected"), F.count(F.when(F.col("violations") > 0, 1)).alias("n_violations"),
    )
    asked = requests(spark, d).select("request_id", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    out = asked.join(R.shuffled(s), ["mode", "request_id"], "left").na.fill(0, ["n_routes", "n_pareto", "n_near_duplicates", "n_violations"]).na.fill(False, ["has_alternative"])
    return out.withColumn("reason", F.when(F.col("n_routes") == 0, "no_route").otherwise("routes")).join(R.shuffled(top), ["mode", "request_id"], "left")


@query("R19_request_summary", f"with recursive {SUMMARY} select sm.*, mean_top3 from sm left join tp using (mode, request_id)")
def request_summaries(spark: Spark, d: str) -> DataFrame:
    return summaries(spark, d)


R19 = f"""with recursive {SUMMARY}, ch as (select request_id, count(distinct selected) > 1 as differs from sm group by 1)
select mode, count(*) as n_requests, count(*) filter (has_alternative) as n_with_alternative, round(avg(n_routes), 9) as mean_routes, round(avg(n_pareto), 9) as mean_pareto, round(avg(mean_top3), 9) as mean_top3, cast(sum(n_near_duplicates) as bigint) as n_near_duplicates, count(*) filter (differs) as n_choice_differs
 from sm left join tp using (mode, request_id) join ch using (request_id) group by 1"""


@query("R19_mode_summary", R19, whole=True)
def mode_summaries(spark: Spark, d: str) -> DataFrame:
    s = summaries(spark, d)
    choice = s.groupBy("request_id").agg((F.count_distinct("selected") > 1).alias("differs"))
    mean = lambda c, name: F.round(F.avg(c), 9).alias(name)
    return s.join(R.shuffled(choice), "request_id").groupBy("mode").agg(
        F.count("*").alias("n_requests"), F.count(F.when(F.col("has_alternative"), 1)).alias("n_with_alternative"), mean("n_routes", "mean_routes"), mean("n_pareto", "mean_pareto"), mean("mean_top3", "mean_top3"),
        F.sum("n_near_duplicates").alias("n_near_duplicates"), F.count(F.when(F.col("differs"), 1)).alias("n_choice_differs"),
    )
