"""Sources, look-ups along routes and remaining joins on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import marts
from ..operators import journeys as J
from ..operators import network as N
from ..operators import quality as Q
from ..operators import routes as R
from ..sources import files
from .marts import D8, edge_lookup
from .network import ALL, DIRECTIONS, EVAL, LINES, LOOPS, NAMES, NUMBERS, PATHS, SEG, STEPS, TRANSFERS, all_edges, branch, breaks, directed, evaluated, line_sequence, lookup, parts, paths, raw_rides, steps, transfers, violations, walks
from ..sources.scratch import temporary, written
from .registry import query
from .views import sequence, stations, table

Spark = SparkSession
SEG_SQL = f"with recursive {SEG}"


A1 = "select c_custkey, c_name, cast(c_custkey % 3 as integer) as grp, '강동' as town from customer"


@query("A1_charset_fallback", A1)
def charsets(spark: Spark, d: str) -> DataFrame:
    """One folder of files in three encodings: cp949, UTF-8 with a byte order mark, UTF-8."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.lit("강동").alias("town"), (F.col("c_custkey") % 3).alias("grp"))
    files.allow_java_charsets(spark)
    path = files.new_folder(spark, "csv")
    for k, (charset, mark) in enumerate((("MS949", ""), ("UTF-8", "\ufeff"), ("UTF-8", ""))):
        c.where(F.col("grp") == k).withColumnRenamed("c_custkey", mark + "c_custkey").write.mode("append").csv(path, header=True, encoding=charset)
    return files.read_folder(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("grp").cast("int").alias("grp"), "town")


A2 = "with f as (select o_orderkey, strftime(o_orderdate, '%Y%m%d') as version, o_custkey from orders) select o_custkey, max(version) as version from f group by 1"


@query("A2_newest_version", A2)
def _(spark: Spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    stamp = F.when((F.col("o_orderkey") % 2 == 0) & (F.year("o_orderdate") >= 2000), F.date_format("o_orderdate", "yyMMdd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    named = o.select("o_custkey", F.concat(F.lit("dist_"), stamp, F.lit(".csv")).alias("source_file"))
    return files.newest(named, ["o_custkey"]).select("o_custkey", files.name_version(F.col("source_file")).alias("version")).distinct()


@query("A3_harmonised_layouts", "select p_partkey as code, p_name as station, case when p_partkey % 2 = 0 then 'A' else 'C' end as layout, case when p_partkey % 2 = 0 then p_size end as extra from part")
def _(spark: Spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a = p.where("p_partkey % 2 = 0").select(F.lit(1).alias("seq"), F.col("p_partkey").alias("역번호"), F.col("p_name").alias("역명"), F.col("p_size").alias("extra"))
    c = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("station"), F.lit(0.0).alias("05:30~06:00"))
    frames = [files.harmonise(x, {"역번호": "code", "역명": "station"}, ["code", "station"]).withColumn("layout", F.lit(files.layout(x.columns))) for x in (a, c)]
    return frames[0].unionByName(frames[1], allowMissingColumns=True).select("code", "station", "layout", "extra")


C3 = "with s as (select p_brand as line, p_name as station, 30.0 / count(*) / 2 as wait from part where p_size > 25 group by 1, 2), l as (select p_brand as line, 30.0 / (count(*) / 8.0) / 2 as wait from part where p_size > 10 and p_brand <> 'Brand#3' group by 1) select p_partkey, case when s.wait is not null or l.wait is not null then round(least(coalesce(s.wait, l.wait), 12), 1) end as wait from part left join s on s.line = p_brand and s.station = p_name left join l on l.line = p_brand"


@query("C3_wait_fallback", C3)
def _(spark: Spark, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("line"), F.col("p_name").alias("station"), "p_size")
    s = p.where("p_size > 25").groupBy("line", "station").agg((30.0 / F.count("*") / 2).alias("wait"))
    l = p.where("p_size > 10 and line <> 'Brand#3'").groupBy("line").agg((30.0 / (F.count("*") / 8.0) / 2).alias("wait"))
    return J.chained(p.drop("p_size"), [(s, ["line", "station"]), (l, ["line"])], "wait", 12.0).select("p_partkey", "wait")


C10 = f"with look as ({D8}), s as (select distinct n_regionkey as line_id, n_nationkey as station_code from supplier join nation on n_nationkey = s_nationkey), e as (select a.line_id, a.station_code, b.station_code as to_code, case when b.station_code > a.station_code then 'up' else 'down' end as direction from s a join s b on a.line_id = b.line_id and abs(a.station_code - b.station_code) = 5) select e.*, look.congestion_median from e left join look on look.station_code = e.station_code and look.direction = e.direction and look.day_type = 'weekday' and look.time_bin_index = 2"


@query("C10_edge_congestion", C10)
def _(spark: Spark, d: str) -> DataFrame:
    """Ride edges between stations of a line at one day type and bin, with crowding."""
    look = edge_lookup(spark, d).where("day_type = 'weekday' and time_bin_index = 2").select("station_code", "direction", "congestion_median")
    s = stations(spark, d).select("line_id", "station_code").distinct()
    pairs = s.join(s.withColumnRenamed("station_code", "to_code"), "line_id").where("abs(station_code - to_code) = 5")
    e = pairs.withColumn("direction", F.when(F.col("to_code") > F.col("station_code"), "up").otherwise("down"))
    return e.join(look, ["station_code", "direction"], "left").select("line_id", "station_code", "to_code", "direction", "congestion_median")


@query("C11_both_ends_known", f"with {ALL}, known as (select from_node as node from ride where line_id <> 'Brand#3') select from_node, to_node from tr where from_node in (select node from known) and to_node in (select node from known)")
def both_ends(spark: Spark, d: str) -> DataFrame:
    r = written(raw_rides(spark, d))
    known = r.where("line_id <> 'Brand#3'").select("from_node").distinct()
    return transfers(spark, d, r).join(known, "from_node", "left_semi").join(known.toDF("to_node"), "to_node", "left_semi").select("from_node", "to_node")


@query("C13_edition_differences", "with a as (select p_brand, p_name, max(p_size) as km from part group by 1, 2), b as (select p_brand, p_name, min(p_size) as km from part group by 1, 2) select p_brand, p_name, a.km as km_a, b.km as km_b from a join b using (p_brand, p_name) where abs(a.km - b.km) > 5")
def _(spark: Spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    both = p.groupBy("p_brand", "p_name").agg(F.max("p_size").alias("km_a"), F.min("p_size").alias("km_b"))
    return both.where(F.abs(F.col("km_a") - F.col("km_b")) > 5)


C14 = """with rows as (select p_name as station_name, p_brand as from_line, p_type as to_line, p_partkey as car, p_size as minutes, case when p_size % 3 = 0 then 'x ' || p_brand || ' y' else 'z' end as depart_toward, case when p_size % 2 = 0 then 'has prev' else 'other' end as arrive_toward from part),
req as (select distinct p_name || '/' || p_brand || '/' || p_type as request_id, p_name as station_name, p_brand as from_line, p_type as to_line, p_brand as next_station, 'prev' as previous_station from part),
j as (select *, cast(contains(depart_toward, next_station) as integer) as a, cast(not contains(arrive_toward, previous_station) as integer) as b from req join rows using (station_name, from_line, to_line)),
k as (select * from j qualify a = max(a) over (partition by request_id)), m as (select * from k qualify b = max(b) over (partition by request_id)) select request_id, car, minutes from m qualify row_number() over (partition by request_id order by minutes, car) = 1"""


@query("C14_transfer_tip", C14)
def _(spark: Spark, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("station_name"), F.col("p_brand").alias("from_line"), F.col("p_type").alias("to_line"), F.col("p_partkey").alias("car"), F.col("p_size").alias("minutes"))
    rows = p.withColumn("depart_toward", F.when(F.col("minutes") % 3 == 0, F.concat(F.lit("x "), "from_line", F.lit(" y"))).otherwise("z")).withColumn("arrive_toward", F.when(F.col("minutes") % 2 == 0, "has prev").otherwise("other"))
    asked = p.select(F.concat_ws("/", "station_name", "from_line", "to_line").alias("request_id"), "station_name", "from_line", "to_line", F.col("from_line").alias("next_station"), F.lit("prev").alias("previous_station")).distinct()
    return J.tips(asked, rows)


D16 = """with v as (select p_name, median(p_retailprice) as volume from part where p_partkey % 5 = 0 group by 1)
select p_name as station_name, p_brand as from_line, median(p_size) as median_min, min(p_size) as least_min, count(distinct p_type) as patterns, cast(max(cast(p_size > 45 as integer)) as integer) as branch, volume from part left join v using (p_name) group by p_name, p_brand, volume"""


@query("D16_transfer_aggregate", D16)
def transfers_with_volume(spark: Spark, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumnsRenamed({"p_name": "station_name", "p_brand": "from_line"})
    rows = p.select("station_name", "from_line", F.col("p_size").alias("minutes"), F.col("p_type").alias("pattern"), (F.col("p_size") > 45).alias("is_branch"))
    return marts.transfer_aggregate(rows, p.where("p_partkey % 5 = 0").select("station_name", F.col("p_retailprice").alias("volume")), ["station_name", "from_line"])


@query("E5_first_non_null", "with o as (select p_brand, p_partkey, case when p_size % 3 = 0 then p_size end as a, case when p_size % 2 = 0 then p_name end as b from part) select p_brand, arg_min(a, p_partkey) filter (a is not null) as a, arg_min(b, p_partkey) filter (b is not null) as b from o group by 1")
def _(spark: Spark, d: str) -> DataFrame:
    o = table(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("a"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("b"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("p_partkey"))).alias(c)
    return o.groupBy("p_brand").agg(first("a"), first("b"))


@query("R12_transfer_wait", f"{SEG_SQL}, sg as (select request_id, rank, segment, line, lag(line) over (partition by request_id, rank order by segment) as prev from (select distinct request_id, rank, segment, line from g)), w as (select p_brand as line, round(15.0 / count(*), 6) as wait from part group by 1) select request_id, rank, round(coalesce(sum(coalesce(wait, 0)) filter (line <> 'walk' and prev is not null), 0), 6) as wait from sg left join w using (line) group by 1, 2")
def waits(spark: Spark, d: str) -> DataFrame:
    by_line = table(spark, d, "part").groupBy(F.col("p_brand").alias("line")).agg(F.round(15.0 / F.count("*"), 6).alias("wait"))
    return J.transfer_waits(N.segment_sums(parts(spark, d)[0]), by_line).withColumn("wait", F.round("wait", 6))


#: Departures by line, station, direction, day type and bin; some stations have none.
WAITS = """hs as (select distinct r.line_id, r.from_station, r.direction, day_type, bin, case when (r.from_pos + day_type) % 4 <> 1 then (2 + (r.from_pos * 7 + length(r.direction) * 5 + day_type * 11 + bin * 3) % 30) / 2.0::double end as wait from ride1 r cross join (select unnest([0, 1, 2]) as day_type) cross join (select unnest([0, 1, 2, 3]) as bin)),
hl as (select line_id, direction, day_type, bin, round(avg(wait), 6) as wait from hs where line_id not like 'Brand#3%' group by 1, 2, 3, 4)"""


def headways(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Expected waits of stations, null where nothing runs, and their means by line, which
    some lines lack."""
    h = directed(spark, d).withColumn("day_type", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("bin", F.explode(F.array(*map(F.lit, (0, 1, 2, 3)))))
    headway = 2 + (F.col("from_pos") * 7 + F.length("direction") * 5 + F.col("day_type") * 11 + F.col("bin") * 3) % 30
    stations_ = h.select("line_id", "from_station", "direction", "day_type", "bin", F.when((F.col("from_pos") + F.col("day_type")) % 4 != 1, headway / 2.0).alias("wait")).distinct()
    lines = stations_.where("line_id not like 'Brand#3%'").groupBy("line_id", "direction", "day_type", "bin").agg(F.round(F.avg("wait"), 6).alias("wait"))
    return stations_.withColumnRenamed("line_id", "line"), lines.withColumnRenamed("line_id", "line")


CHAIN = f"""with recursive {EVAL}, {WAITS},
mj as (select request_id, rank, segment, arg_min(direction, k) as direction from (select request_id, rank, segment, direction, -count(*) * 1000000 + row_number() over (partition by request_id, rank, segment order by direction) as k from g where kind = 'ride' group by 1, 2, 3, 4) group by 1, 2, 3),
sg as (select *, lag(line) over (partition by request_id, rank order by segment) as prev from (select request_id, rank, segment, line, {NAMES.format('arg_min(from_node, pos)')} as from_station from g group by 1, 2, 3, 4)),
bd as (select sg.request_id, sg.rank, case when coalesce(hs.wait, hl.wait) is not null then round(least(coalesce(hs.wait, hl.wait), 12), 1) end as wait from sg join mj using (request_id, rank, segment) left join hs on hs.line_id = sg.line and hs.from_station = sg.from_station and hs.direction = mj.direction and hs.day_type = sg.request_id % 3 and hs.bin = sg.request_id % 4
 left join hl on hl.line_id = sg.line and hl.direction = mj.direction and hl.day_type = sg.request_id % 3 and hl.bin = sg.request_id % 4 where sg.line <> 'walk' and sg.prev = 'walk'),
sm as (select request_id, rank, count(*) as boardings, sum(wait) as wait, count(*) filter (wait is null) as unknown from bd group by 1, 2)
select request_id, rank, coalesce(boardings, 0) as boardings, round(coalesce(wait, 0), 1) as wait, coalesce(unknown, 0) as unknown, round(actual + round(coalesce(wait, 0), 1), 3) as actual, round(perceived + round(coalesce(wait, 0), 1), 3) as perceived from ev left join sm using (request_id, rank)"""


@query("R12_wait_chain", CHAIN)
def chain_of_waits(spark: Spark, d: str) -> DataFrame:
    """Waits after transfers by station, else line, at the request's day type and bin, and
    the routes' minutes with them."""
    by_station, by_line = headways(spark, d)
    segments = J.described(parts(spark, d)[0]).withColumn("day_type", F.col("request_id") % 3).withColumn("bin", F.col("request_id") % 4)
    at = ["direction", "day_type", "bin"]
    w = J.chained_waits(segments, [(by_station, ["line", "from_station", *at]), (by_line, ["line", *at])])
    timed = evaluated(spark, d).select("request_id", "rank", "actual", "perceived").join(R.shuffled(w), ["request_id", "rank"])
    return timed.select("request_id", "rank", "boardings", "wait", "unknown", *[F.round(F.col(c) + F.col("wait"), 3).alias(c) for c in ("actual", "perceived")])


R13 = f"""{SEG_SQL}, mj as (select request_id, rank, segment, arg_min(direction, k) as direction from (select request_id, rank, segment, direction, -count(*) * 1000000 + row_number() over (partition by request_id, rank, segment order by direction) as k from g where kind = 'ride' group by 1, 2, 3, 4) group by 1, 2, 3),
mb as (select request_id, rank, segment, arg_min(branch, k) as branch from (select request_id, rank, segment, branch, -count(*) * 1000000 + row_number() over (partition by request_id, rank, segment order by branch) as k from g where kind = 'ride' group by 1, 2, 3, 4) group by 1, 2, 3),
b as (select request_id, rank, segment, line, arg_min(from_node, pos) as a, arg_max(to_node, pos) as z, arg_min(to_node, pos) as n1, count(*) as stops, sum(minutes) as m, max(cong) as max_cong from g group by 1, 2, 3, 4)
select request_id, rank, segment, line, {NAMES.format('a')} as from_station, {NAMES.format('z')} as to_station, stops, cast(m + case when line <> 'walk' then 0.5 * (stops - 1) else 0 end as double) as minutes, round(max_cong, 6) as max_cong, direction, branch,
 case when line <> 'walk' then {NAMES.format('n1')} end as next_station, case when line <> 'walk' and stops > 1 then 'toward ' || {NAMES.format('n1')} else '' end as direction_label from b left join mj using (request_id, rank, segment) left join mb using (request_id, rank, segment)"""


@query("R13_structured_segments", R13)
def structured(spark: Spark, d: str) -> DataFrame:
    return J.described(parts(spark, d)[0])


R20 = f"""with recursive {STEPS}, b as (select request_id, rank, bin, max(k.rate) as worst from full_steps s join lookup k on k.line_id = s.line_id and k.from_station = {NAMES.format('s.from_node')} and k.direction = s.direction where kind = 'ride' and k.rate is not null group by 1, 2, 3),
o as (select request_id, rank, arg_min(bin, worst * 100 + bin) as bin, min(worst) as worst, max(worst) filter (bin = 0) as now from b group by 1, 2) select request_id, rank, bin, worst, now from o where now - worst >= 10"""


@query("R20_departure_alternative", R20)
def departures(spark: Spark, d: str) -> DataFrame:
    rides = steps(spark, d)[0].where("kind = 'ride'").withColumn("from_station", S.node_station(F.col("from_node")))
    return J.departure_alternatives(rides, lookup(directed(spark, d)), ["line_id", "from_station", "direction"], 0, 4, 10)


R21 = f"""{SEG_SQL}, r as (select g.*, k.rate, lead(pos) over (partition by request_id, rank, segment order by pos) is null as is_last from g left join lookup k on k.line_id = g.line_id and k.from_station = {NAMES.format('g.from_node')} and k.direction = g.direction and k.bin = 0 where kind = 'ride')
select request_id, rank, segment, pos, line_id, {NAMES.format('from_node')} as station, rate from r union all select request_id, rank, segment, pos + 1, line_id, {NAMES.format('to_node')}, rate from r where is_last"""


@query("R21_route_profile", R21)
def route_profile(spark: Spark, d: str) -> DataFrame:
    return J.profile_along(parts(spark, d)[0], lookup(directed(spark, d)).where("bin = 0").drop("bin"))


@query("R22_running_order", "select p_brand as line_id, cast(p_partkey as varchar) as node, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as integer) as pos from part")
def order_of_lines(spark: Spark, d: str) -> DataFrame:
    s = sequence(spark, d).withColumn("n", F.col("seq").cast("string"))
    w = W.partitionBy("line_id").orderBy("seq")
    follows = s.select("line_id", F.col("n").alias("from_node"), F.lead("n").over(w).alias("to_node")).where("to_node is not null")
    starts = s.groupBy("line_id").agg(F.min("seq").cast("string").alias("node"))
    return J.running_order(starts, follows)


R22 = f"""with recursive {LINES}, {DIRECTIONS}, {TRANSFERS}, fo as (select line_id, from_node, to_node, from_station, to_station, to_pos as rank from ride0 union all select split_part(from_node, '_', 1), from_node, to_node, station_name, station_name, 1000000 from tr where is_branch_transfer = 1),
en as (select line_id, arg_min(station_name, pos) as a, arg_max(station_name, pos) as z from ls group by 1),
pt as (select line_id, scope, line_id || '/' || scope || '/' || way as pattern, case way when 'up' then a else z end as s, case way when 'up' then z else a end as e from en cross join (select unnest(['main', 'all']) as scope) cross join (select unnest(['up', 'down']) as way)),
side as (select line_id, station_name from ls where size % 10 = 9),
pf as (select pattern, s, e, fo.* from pt join fo using (line_id) where scope = 'all' or (not contains(from_node || to_node, '@') and (line_id, from_station) not in (select (line_id, station_name) from side) and (line_id, to_station) not in (select (line_id, station_name) from side))),
sn as (select pattern, s, e, unnest([from_node, to_node]) as node, unnest([from_station, to_station]) as station from pf), go as (select pattern, min(node) filter (station = s) as node from sn group by 1 having count(*) filter (station = e) > 0 and count(*) filter (station = s) > 0),
wk as (select pattern, node, [node] as path, false as over from go union all select wk.pattern, to_node, list_append(path, to_node), to_station = e from wk join pf on pf.pattern = wk.pattern and from_node = wk.node where not over and not list_contains(path, to_node) qualify row_number() over (partition by wk.pattern order by to_station = e, rank, to_node) = 1)
select pattern, node, cast(len(path) - 1 as integer) as pos from wk"""


@query("R22_line_patterns", R22)
def patterns_of_lines(spark: Spark, d: str) -> DataFrame:
    """Each line from its first station to its last and back, on its main part and with
    branches and loops; transfers within the line come after its rides."""
    s = line_sequence(spark, d)
    r = written(raw_rides(spark, d))
    columns = ["line_id", "from_node", "to_node", "from_station", "to_station"]
    inner = transfers(spark, d, r).where("is_branch_transfer = 1").withColumn("line_id", S.node_line(F.col("from_node"))).withColumn("from_station", F.col("station_name")).withColumn("to_station", F.col("station_name"))
    every = written(r.select(*columns, F.col("to_pos").alias("rank")).union(inner.select(*columns, F.lit(1000000).alias("rank"))))
    side = s.where(branch() == "b").select("line_id", "station_name").distinct()
    main = every.where("not contains(from_node, '@') and not contains(to_node, '@')")
    for end in ("from_station", "to_station"):
        main = main.join(side.withColumnRenamed("station_name", end), ["line_id", end], "left_anti")
    follows = main.withColumn("scope", F.lit("main")).unionByName(every.withColumn("scope", F.lit("all")))
    ends = s.groupBy("line_id").agg(F.min_by("station_name", "pos").alias("a"), F.max_by("station_name", "pos").alias("z"))
    name = lambda way: F.concat_ws("/", "line_id", "scope", F.lit(way)).alias("pattern")
    asked = ends.withColumn("scope", F.explode(F.array(F.lit("main"), F.lit("all"))))
    both = asked.select(name("up"), F.col("a").alias("start"), F.col("z").alias("end")).union(asked.select(name("down"), "z", "a"))
    rows = follows.withColumn("pattern", F.explode(F.array(name("up"), name("down")))).drop("line_id", "scope")
    return J.line_patterns(written(both), written(rows))


@query("R23_cross_section", "with o as (select p_brand as line_id, p_partkey, p_size, row_number() over (partition by p_brand order by p_partkey) - 1 as pos from part) select line_id, arg_max(pos, p_size * 100000 - pos) as worst_pos, max(p_size) as worst, round(avg(p_size), 9) as mean from o group by 1")
def _(spark: Spark, d: str) -> DataFrame:
    rates = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node"), "p_size")
    o = order_of_lines(spark, d).join(rates, "node")
    return o.groupBy("line_id").agg(F.max_by("pos", F.struct("p_size", -F.col("pos"))).cast("long").alias("worst_pos"), F.max("p_size").alias("worst"), F.round(F.avg("p_size"), 9).alias("mean"))


Q5 = f"""with recursive {STEPS} select request_id, rank, count(*) filter (kind is null) as missing_edges, count(*) filter (split_part(to_node, '_', 1) = 'Brand#7') as out_of_scope, count(*) filter (kind = 'transfer' and not is_through) as transfers,
 coalesce(string_agg({NAMES.format('from_node')}, ';' order by pos) filter (kind = 'transfer' and not is_through), '') as transfer_stations from full_steps group by 1, 2"""


@query("Q5_path_violations", Q5)
def route_violations(spark: Spark, d: str) -> DataFrame:
    return violations(steps(spark, d)[0])


Q4 = f"""with {ALL}, pairs as (select a.minutes as there, b.minutes as back from ride a left join ride b on b.from_node = a.to_node and b.to_node = a.from_node where a.is_bidirectional = 1), nodes as (select from_node as node from ride union select to_node from ride),
need as (select station_name, line_id from ls where pos <= 3), has as (select station_name, split_part(from_node, '_', 1) as line_id from tr)
select 'phantom_edges' as "check", count(*) as failures from ride join fst on fst.line_id = ride.line_id and fst.prev = ride.from_station where abs(from_pos - to_pos) > 1 and to_station not in (select station_name from ls where ls.line_id = ride.line_id and size = 13)
union all select 'required_transfers', count(*) from need where station_name in (select station_name from need group by 1 having count(*) > 1) and not exists (select 1 from has where has.station_name = need.station_name and has.line_id = need.line_id)
union all select 'out_of_scope_nodes', count(*) from nodes where node like 'Brand#7%' union all select 'asymmetric_times', count(*) from pairs where back is null or back <> there
union all select 'branch_nodes', (select count(*) from (select distinct line_id || '_' || before || '@b' as n from stp where split = '@b') where n not in (select node from nodes))"""


@query("Q4_graph_structure", Q4)
def graph_structure(spark: Spark, d: str) -> DataFrame:
    """The network's edges and transfers against the sequences and rules."""
    s, r = line_sequence(spark, d), written(raw_rides(spark, d))
    return Q.graph_checks(s, breaks(s), branch(), r, transfers(spark, d, r), ~F.col("line_id").startswith("Brand#7"))


R7 = f"""with recursive {ALL}, nodes as (select distinct from_station as station_name, from_node as node from ride), asked as (select seq as request_id, station_name as o, d from (select *, lead(station_name, 2) over (partition by line_id order by pos) as d from ls) where d is not null and d <> station_name),
req as (select request_id, d as destination, node as origin from asked join nodes on nodes.station_name = asked.o), ends as (select distinct d as destination, node from asked join nodes on nodes.station_name = asked.d), {NUMBERS}, {walks("s", "minutes", 1, 2, stop=False)}
select request_id, array_to_string(path, '>') as route, cast(g as bigint) as minutes, cast(r as integer) as rank from found_s"""


@query("R7_station_requests", R7, whole=True)
def station_routes(spark: Spark, d: str) -> DataFrame:
    s = line_sequence(spark, d)
    asked = s.withColumn("destination", F.lead("station_name", 2).over(W.partitionBy("line_id").orderBy("pos"))).where("destination is not null").select(F.col("seq").alias("request_id"), F.col("station_name").alias("origin"), "destination")
    with temporary(spark) as keep:
        edges = written(all_edges(spark, d))
        nodes = edges.where("kind = 'ride'").select(F.col("from_node").alias("node"), S.node_station(F.col("from_node")).alias("station_name")).distinct()
        inner, more = J.station_requests(asked, nodes, edges)
        found = keep(R.k_paths(inner, more, 2))
    return found.select("request_id", F.array_join(F.slice("path", 2, F.size("path") - 2), ">").alias("route"), "minutes", "rank")


R24 = f"""with recursive {PATHS}, pt as (select line_id || '_' || station_name as node, station_name, seq % 100 as x, seq // 100 as y from ls where seq % 3 <> 0),
fb as (select station_name, arg_min(x, node) as x, arg_min(y, node) as y from pt group by 1), lg as (select request_id, rank, unnest(path) as node, unnest(generate_series(0, len(path) - 1)) as pos from paths),
pl as (select request_id, rank, pos, coalesce(pt.x, fb.x) as x, coalesce(pt.y, fb.y) as y from lg left join pt using (node) left join fb on fb.station_name = {NAMES.format('lg.node')} where coalesce(pt.x, fb.x) is not null),
q as (select *, lag(x) over w as bx, lag(y) over w as b_y from pl window w as (partition by request_id, rank order by pos)) select request_id, rank, pos, x, y from q where bx is null or bx <> x or b_y <> y"""


@query("R24_coordinates", R24)
def route_points(spark: Spark, d: str) -> DataFrame:
    points = line_sequence(spark, d).where("seq % 3 <> 0").select(S.node_id(F.col("line_id"), F.col("station_name")).alias("node"), F.col("station_name").alias("station"), "seq")
    placed = points.select("node", "station", (F.col("seq") % 100).alias("x"), F.expr("seq div 100").alias("y"))
    return J.coordinates(paths(spark, d)[0], placed, S.node_station(F.col("node")))


R24G = f"""with {LINES}, {DIRECTIONS}, {TRANSFERS}, pt as (select line_id || '_' || station_name as node, seq % 100 as x, seq // 100 as y from ls where seq % 3 <> 0),
od as (select line_id, case when size % 10 = 9 then 'b' else 'main' end as branch, seq, line_id || '_' || station_name as node from ls), rt as (select line_id, max(line_id || '_' || station_name) filter (pos = 5) as via, max(line_id || '_' || station_name) filter (pos = 6) as a, max(line_id || '_' || station_name) filter (pos = 7) as b from ls where line_id in ('Brand#11', 'Brand#21', 'Brand#31') group by 1),
nx as (select line_id, branch, node as f, lead(node) over (partition by line_id, branch order by seq) as t from od), pr as (select nx.*, rt.via from nx left join rt on rt.line_id = nx.line_id and rt.a = f and rt.b = t where t is not null),
sg as (select line_id, branch, f, t from pr where via is null union all select line_id, branch, f, via from pr where via is not null union all select line_id, branch, via, t from pr where via is not null union all select line_id, branch, arg_max(node, seq), arg_min(node, seq) from od where branch = 'main' and line_id like 'Brand#2%' group by 1, 2),
al as (select 'line' as kind, * from sg union all select 'connector', null, null, from_node, to_node from tr where is_branch_transfer = 0)
select kind, line_id, branch, f as from_node, t as to_node, p.x as x0, p.y as y0, q.x as x1, q.y as y1 from al left join pt p on p.node = f left join pt q on q.node = t where kind = 'connector' or (p.x is not null and q.x is not null)"""


@query("R24_edge_geometry", R24G)
def lines_to_draw(spark: Spark, d: str) -> DataFrame:
    s = line_sequence(spark, d).withColumn("node", S.node_id(F.col("line_id"), F.col("station_name"))).withColumn("branch", branch())
    points = s.where("seq % 3 <> 0").select("node", (F.col("seq") % 100).alias("x"), F.expr("seq div 100").alias("y"))
    at = lambda k, name: F.max(F.when(F.col("pos") == k, F.col("node"))).alias(name)
    returns = s.where(F.col("line_id").isin(*LOOPS)).groupBy("line_id").agg(at(5, "node"), at(6, "after_node"), at(7, "next_node"))
    rings = s.where("branch = 'main' and line_id like 'Brand#2%'")
    between = transfers(spark, d, written(raw_rides(spark, d))).where("is_branch_transfer = 0")
    return J.edge_geometry(s.withColumnRenamed("seq", "path_order"), points, rings, returns, between)
