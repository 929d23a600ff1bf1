"""Data-quality jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import impact, marts
from ..operators import quality as Q
from ..sources.scratch import written
from .impact import SPIKE, daily, spike
from .marts import SPLIT, WIDE, split_cells, wide
from .network import LINES, TRANSFERS, branch, breaks, line_sequence, loops, raw_rides, transfers
from .registry import query
from .views import CONG, RIDES, congestion, events, rides, table

Spark = SparkSession


CUTS = (80, 100, 130, 150)
D13 = f"""with {CONG} select snapshot_date, count(*) as n, count(distinct station_code) as stations, cast(count(*) filter (station_code not between 0 and 19) as bigint) as out_of_scope, {", ".join(f"round(avg(cast(coalesce(congestion_rate >= {c}, false) as integer)) * 100, 9) as share_{c}, count(*) filter (congestion_rate >= {c}) as n_{c}" for c in CUTS)},
 max(congestion_rate) as max_rate, round(quantile_cont(congestion_rate, 0.99), 9) as p99, round(quantile_cont(congestion_rate, 0.999), 9) as p999 from cong group by 1"""


@query("D13_file_profile", D13)
def file_profile(spark: Spark, d: str) -> DataFrame:
    out = Q.file_profile(congestion(spark, d), ["snapshot_date"], "station_code", "congestion_rate", ~F.col("station_code").between(0, 19), CUTS)
    return out.select(*[F.round(c, 9).alias(c) if t == "double" and c != "max_rate" else c for c, t in out.dtypes])


@query("D14_alias_candidates", "with a as (select split_part(p_name, ' ', 2) as key, p_name, p_partkey from part) select key, string_agg(distinct p_name, '|' order by p_name) as names, count(distinct p_name) as n_names, min(p_partkey) as first_seen, max(p_partkey) as last_seen, count(*) as n from a group by 1 having count(distinct p_name) > 1")
def _(spark: Spark, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("key"), "p_name", "p_partkey")
    out = p.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("p_name")), "|").alias("names"), F.count_distinct("p_name").alias("n_names"), F.min("p_partkey").alias("first_seen"), F.max("p_partkey").alias("last_seen"), F.count("*").alias("n"))
    return out.where("n_names > 1")


NAMED = f"{CONG}, named as (select *, station_name || case when station_code % 4 = 0 and snapshot_date >= date '1997-01-01' then '역' else '' end as station_name_raw from cong where station_code between 0 and 19 and not (station_code % 7 = 3 and direction = 'down'))"


def named_cells(spark: Spark, d: str) -> DataFrame:
    """The crowding of the lines in scope, some stations renamed in 1997, some without down trains."""
    late = (F.col("station_code") % 4 == 0) & (F.col("snapshot_date") >= F.lit("1997-01-01").cast("date"))
    raw = F.concat("station_name", F.when(late, "역").otherwise(""))
    return congestion(spark, d).where("station_code between 0 and 19 and not (station_code % 7 = 3 and direction = 'down')").withColumn("station_name_raw", raw)


@query("D14_alias_report", f"with {NAMED} select line_id, station_code, station_name_raw, min(snapshot_date) as first_seen, max(snapshot_date) as last_seen, count(*) as n_rows, count(*) over (partition by line_id, station_code) as n_names from named group by 1, 2, 3 qualify count(*) over (partition by line_id, station_code) > 1")
def alias_report(spark: Spark, d: str) -> DataFrame:
    return Q.alias_candidates(named_cells(spark, d), ["line_id", "station_code"], "station_name_raw", "snapshot_date")


@query("D14_scope_check", f"with {NAMED} select line_id, count(distinct station_code) as n_stations, min(station_code) as min_code, max(station_code) as max_code, string_agg(distinct direction, '|' order by direction) as directions from named group by 1")
def scope_report(spark: Spark, d: str) -> DataFrame:
    return Q.scope_check(named_cells(spark, d), "line_id", "station_code", "direction")


@query("D14_single_direction", f"with {NAMED} select line_id, station_code, station_name_raw, min(direction) as only_direction from named where snapshot_date = (select max(snapshot_date) from named) group by 1, 2, 3 having count(distinct direction) = 1")
def single_directions(spark: Spark, d: str) -> DataFrame:
    return Q.single_direction(named_cells(spark, d), ["line_id", "station_code", "station_name_raw"], "direction", "snapshot_date")


SOME = "r as (select l_suppkey, " + ", ".join(f"case when l_suppkey % 13 = {k} then -h{k} else h{k} end as h{k}" for k in range(1, 8)) + " from wide union all select * from wide where l_suppkey % 10 = 0)"
D18 = f"""with {WIDE}, {SOME}, t as (select l_suppkey, sum(l_quantity) as total from lineitem group by 1)
select count(*) as n_rows, count(*) filter (abs({" + ".join(f"coalesce(h{k}, 0)" for k in range(1, 8))} - total) > 0.5) as mismatch, cast(sum({" + ".join(f"cast(h{k} is null as integer)" for k in range(1, 8))}) as bigint) as null_cells,
 cast(sum({" + ".join(f"cast(coalesce(h{k} < 0, false) as integer)" for k in range(1, 8))}) as bigint) as negative_cells, (select cast(coalesce(sum(c - 1), 0) as bigint) from (select count(*) as c from r group by l_suppkey)) as duplicate_rows from r join t using (l_suppkey)"""


@query("D18_row_totals", D18)
def row_totals(spark: Spark, d: str) -> DataFrame:
    """The wide table with some negative cells and some rows twice, against its totals."""
    names = [f"h{k}" for k in range(1, 8)]
    w = wide(spark, d)
    spoilt = w.select("l_suppkey", *[F.when(F.col("l_suppkey") % 13 == k, -F.col(c)).otherwise(F.col(c)).alias(c) for k, c in enumerate(names, 1)]).unionByName(w.where("l_suppkey % 10 = 0"))
    total = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total"))
    return Q.row_totals(spoilt.join(total, "l_suppkey"), ["l_suppkey"], names, "total")


@query("D18_day_coverage", f"with {RIDES}, m as (select cast(date_trunc('month', date) as date) as ym, count(distinct date) as days from rides where station_code < 15 group by 1), c as (select cast(unnest(generate_series(min(ym), max(ym), interval 1 month)) as date) as ym from m) select ym, coalesce(days, 0) as days, day(last_day(ym)) as days_in_month from c left join m using (ym) where coalesce(days, 0) <> day(last_day(ym))")
def day_coverage(spark: Spark, d: str) -> DataFrame:
    return Q.day_coverage(rides(spark, d).where("station_code < 15"), "date")


@query("D18_missing_months", f"with {RIDES}, m as (select distinct date_trunc('month', date) as m, station_code from rides), c as (select cast(unnest(generate_series(min(m), max(m), interval 1 month)) as date) as ym from m), s as (select distinct station_code from m) select ym, s.station_code from c cross join s where not exists (select 1 from m where m.m = c.ym and m.station_code = s.station_code)")
def _(spark: Spark, d: str) -> DataFrame:
    m = rides(spark, d).select(F.trunc("date", "MM").alias("ym"), "station_code").distinct()
    months = m.agg(F.min("ym").alias("a"), F.max("ym").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("ym"))
    return marts.absent(m, m, ["station_code"], "ym", months).select("ym", "station_code")


#: Seven tables and their column rules: (column, check, argument), as SQL for the oracle.
RULES: dict[str, list[tuple]] = {
    "station_master": [("station_uid", "unique", None), ("line_id", "in", (0, 1, 2, 3, 4)), ("station_code", "positive", None), ("station_name", "not_null", None), ("in_project_scope", "in", (0, 1))],
    "stg_congestion": [("snapshot_date", "not_null", None), ("day_type", "in", ("weekday", "sat", "sun")), ("line_id", "in", (0, 1, 2, 3)), ("direction", "in", ("up", "down")), ("time_bin_index", "between", (0, 6)), ("congestion_rate", "between", (0, 140))],
    "congestion_mart": [("split", "in", ("train", "valid", "test")), ("is_operating", "in", (0, 1)), ("label_high", "in", (0, 1)), ("label_extreme", "in", (0, 1)), ("perceived_multiplier", "between", (1.0, 1.3))],
    "training_mart": [("is_station_holdout", "in", (0, 1)), ("label_high", "in", (0, 1)), ("boarding_ratio", "between", (0, 1)), ("net_alighting_ratio", "between", (-1, 1)), ("line_share", "between", (0, 0.3)), ("has_ridership", "in", (0, 1))],
    "route_edge": [("from_node", "not_null", None), ("to_node", "not_null", None), ("minutes", "between", (2, 15)), ("is_bidirectional", "in", (0, 1)), ("branch", "in", ("main",))],
    "transfer_edge": [("from_node", "not_null", None), ("minutes", "between", (0.1, 20)), ("penalty", "between", (0.1, 4.2))],
    "event_spike": [("event_id", "not_null", None), ("ratio", "positive", None), ("base", "at_least", 1), ("actual", "at_least", 5), ("is_confounded", "in", (0,))],
}
HOLD = "station_code % 5 = 0"


def _broken_sql(column: str, check: str, arg: object) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return {
        "not_null": f"{column} is null", "positive": f"{column} <= 0", "at_least": f"{column} < {arg}", "in": f"{column} not in ({', '.join(map(text, arg)) if check == 'in' else ''})",
        "between": f"{column} not between {arg[0]} and {arg[1]}" if check == "between" else "",
    }[check]


def _rules_sql(name: str) -> str:
    one = lambda c, k, a: f"select '{name}' as \"table\", '{c}' as \"column\", '{k}' as \"check\", " + (f"cast(coalesce(sum(n), 0) as bigint) as failures from (select count(*) as n from {name} where {c} is not null group by {c} having count(*) > 1)" if k == "unique" else f"count(*) filter ({_broken_sql(c, k, a)}) as failures from {name}")
    return " union all ".join(one(*r) for r in RULES[name])


def _after_with(sql: str) -> str:
    return sql[sql.index("with ") + 5 :]


TABLES = f"""{CONG}, {_after_with(SPIKE)}, {LINES}, {TRANSFERS}, sc as (select *, {SPLIT} as split from cong),
th as (select line_id, station_code, direction, quantile_cont(congestion_rate, 0.95) as t from sc where split = 'train' and congestion_rate is not null group by 1, 2, 3), tall as (select quantile_cont(congestion_rate, 0.95) as t from sc where split = 'train' and congestion_rate is not null),
station_master as (select line_id || '_' || station_code as station_uid, line_id, station_code, station_name, cast(station_code < 20 as integer) as in_project_scope from rides group by all),
stg_congestion as (select * from cong),
congestion_mart as (select sc.*, cast(congestion_rate is not null as integer) as is_operating, cast(congestion_rate > coalesce(th.t, tall.t) as integer) as label_high, cast(congestion_rate >= 100 as integer) as label_extreme, case when congestion_rate is not null then 1 + 0.5 * greatest(congestion_rate - 80, 0) / 100 end as perceived_multiplier from sc cross join tall left join th using (line_id, station_code, direction)),
flow as (select line_id, station_code, sum(passenger_count) filter (direction = 'boarding') as b, sum(passenger_count) filter (direction = 'alighting') as a, sum(passenger_count) as n from rides where station_code % 7 <> 0 group by 1, 2), lt as (select line_id, sum(n) as n from flow group by 1),
training_mart as (select m.split, m.snapshot_date, m.station_code, m.label_high, cast({HOLD} as integer) as is_station_holdout, coalesce(b, 0) / nullif(flow.n, 0) as boarding_ratio, (coalesce(a, 0) - coalesce(b, 0)) / nullif(flow.n, 0) as net_alighting_ratio, flow.n / lt.n as line_share, cast(flow.n is not null as integer) as has_ridership
 from congestion_mart m left join flow using (line_id, station_code) left join lt using (line_id) where is_operating = 1),
route_edge as (select * from ride0), transfer_edge as (select * from tr),
event_spike as (select event_id, ratio, base, x as actual, cast(exists (select 1 from days o where o.station_code = spike.station_code and o.date = spike.date and o.event_id <> spike.event_id) as integer) as is_confounded from spike)"""
Q1 = f"with {TABLES} " + " union all ".join(_rules_sql(n) for n in RULES)


def ruled_tables(spark: Spark, d: str) -> dict[str, DataFrame]:
    """The seven tables that rules and cross-checks are about. Both facts are written first, so
    that shipments are joined to their stations once for each, not for every table and pass."""
    r, raw = written(rides(spark, d)), written(split_cells(spark, d))
    cells = written(marts.cell_mart(raw, ["line_id", "station_code", "direction"]))
    master = r.select("line_id", "station_code", "station_name").distinct().withColumn("station_uid", F.concat_ws("_", "line_id", "station_code")).withColumn("in_project_scope", (F.col("station_code") < 20).cast("int"))
    side = lambda x: F.sum(F.when(F.col("direction") == x, F.col("passenger_count")))
    flow = written(r.where("station_code % 7 <> 0").groupBy("line_id", "station_code").agg(side("boarding").alias("b"), side("alighting").alias("a"), F.sum("passenger_count").alias("n")))
    lines = flow.groupBy("line_id").agg(F.sum("n").alias("line_n"))
    share = lambda x: F.try_divide(x, F.nullif("n", F.lit(0)))
    b, a = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    training = cells.where("is_operating = 1").join(flow, ["line_id", "station_code"], "left").join(lines, "line_id", "left").select(
        "split", "snapshot_date", "station_code", "label_high", F.expr(HOLD).cast("int").alias("is_station_holdout"), share(b).alias("boarding_ratio"), share(a - b).alias("net_alighting_ratio"),
        F.try_divide("n", "line_n").alias("line_share"), F.col("n").isNotNull().cast("int").alias("has_ridership"),
    )
    edges = written(raw_rides(spark, d))
    days, roll = written(impact.event_days(events(spark, d))), written(daily(spark, d, r))
    marked = impact.confounding(days).select("event_id", "station_code", "date", F.col("confounders").isNotNull().cast("int").alias("is_confounded"))
    spikes = spike(spark, d, (days, roll)).join(marked, ["event_id", "station_code", "date"]).select("event_id", "ratio", "base", F.col("x").alias("actual"), "is_confounded")
    return {"station_master": master, "stg_congestion": raw.drop("split"), "congestion_mart": cells, "training_mart": training, "route_edge": edges, "transfer_edge": transfers(spark, d, edges), "event_spike": spikes}


@query("Q1_column_rules", Q1)
def column_rules(spark: Spark, d: str) -> DataFrame:
    out = None
    for name, df in ruled_tables(spark, d).items():
        one = Q.validate(df, name, RULES[name])
        out = one if out is None else out.unionByName(one)
    return out


Q2 = f"""with {TABLES}, km as (select distinct line_id, station_code from station_master where in_project_scope = 1), kc as (select distinct line_id, station_code from congestion_mart where is_operating = 1), names as (select distinct p_name as n from part where p_size = 1), nn as (select from_node as n from route_edge union select to_node from route_edge),
lo as (select line_id || '_' || entry as e, line_id || '_' || entry || '@loop' as e2, line_id || '_' || last as l from lp where entry is not null and last is not null), hr as (select avg(label_high) as r from congestion_mart where is_operating = 1)
select * from (select 'stations without crowding' as "check", (select count(*) from km where (line_id, station_code) not in (select (line_id, station_code) from kc)) as failures
 union all select 'crowding without station', (select count(*) from kc where (line_id, station_code) not in (select (line_id, station_code) from km))
 union all select 'snapshot in several splits', (select count(*) from (select snapshot_date from training_mart group by 1 having count(distinct split) > 1))
 union all select 'holdout rows in train', (select count(*) from training_mart where split = 'train' and is_station_holdout = 1)
 union all select 'transfer stations not covered', (select count(*) from names where n not in (select station_name from transfer_edge))
 union all select 'branch nodes missing', (select count(*) from (select distinct line_id || '_' || before || '@b' as n from stp where split = '@b') b where n not in (select n from nn))
 union all select 'loop not one way', (select count(*) from lo where not exists (select 1 from route_edge r where r.from_node = l and r.to_node = e2) or exists (select 1 from route_edge r where r.from_node = e2 and r.to_node = l))
 union all select 'operating without values', (select count(*) from congestion_mart where is_operating = 1 and (perceived_multiplier is null or congestion_rate is null))
 union all select 'closed with values', (select count(*) from congestion_mart where is_operating = 0 and congestion_rate is not null)
 union all select 'high share outside 4 to 7 percent', (select cast(not (r between 0.04 and 0.07) as bigint) from hr))"""
Q2 = Q2.replace("select * from (select 'stations", "select *, failures = 0 as passed from (select 'stations")


@query("Q2_cross_checks", Q2)
def cross_checks(spark: Spark, d: str) -> DataFrame:
    t = ruled_tables(spark, d)
    known, cells = t["station_master"].where("in_project_scope = 1"), t["congestion_mart"]
    keys = ["line_id", "station_code"]
    seen = cells.where("is_operating = 1").select(*keys).distinct()
    edges = t["route_edge"]
    nodes = edges.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    names = table(spark, d, "part").where("p_size = 1").select(F.col("p_name").alias("station_name"))
    lines = line_sequence(spark, d)
    branches = Q.wanted_branch_nodes(lines, breaks(lines), branch())
    count = lambda df: df.agg(F.count("*").alias("n"))
    closed = count(Q.open_loops(loops(lines), edges))
    n, missing = F.col("n"), F.col("missing")
    high = cells.where("is_operating = 1").agg((~F.avg("label_high").between(0.04, 0.07)).cast("long").alias("n"))
    return Q.verdicts([
        ("stations without crowding", Q.coverage(known, seen, keys), missing), ("crowding without station", Q.coverage(seen, known, keys), missing),
        ("snapshot in several splits", count(t["training_mart"].groupBy("snapshot_date").agg(F.count_distinct("split").alias("s")).where("s > 1")), n),
        ("holdout rows in train", count(t["training_mart"].where("split = 'train' and is_station_holdout = 1")), n), ("transfer stations not covered", Q.coverage(names, t["transfer_edge"], ["station_name"]), missing),
        ("branch nodes missing", Q.coverage(branches, nodes, ["node"]), missing), ("loop not one way", closed, n),
        ("operating without values", count(cells.where("is_operating = 1 and (perceived_multiplier is null or congestion_rate is null)")), n), ("closed with values", count(cells.where("is_operating = 0 and congestion_rate is not null")), n),
        ("high share outside 4 to 7 percent", high, n),
    ])


Q3 = """with pts as (select p_partkey as id, p_brand as line, p_name as name, p_size % 20 as x, (p_partkey * 7) % 300 as y, p_size as v from part),
hw as (select l_partkey as id, l_linenumber % 7 as departures from lineitem)
select *, failures = 0 as passed from (select 'headway without station' as "check", count(*) as failures from hw where id not in (select id from pts) union all select 'stations without headway', count(*) from pts where id not in (select id from hw)
 union all select 'departures out of range', count(*) from hw where departures <> 0 and 30.0 / departures not between 4.5 and 60 union all select 'value out of range', count(*) from pts where v not between 1 and 45 union all select 'repeated name on a line', cast(coalesce(sum(n), 0) as bigint) from (select count(*) as n from pts group by line, name having count(*) > 1)
 union all select 'overlapping points', cast(coalesce(sum(n), 0) as bigint) from (select count(*) as n from pts group by line, x, y having count(*) > 1))"""


@query("Q3_reference_checks", Q3)
def reference_checks(spark: Spark, d: str) -> DataFrame:
    """Headways and map points: mappings complete both ways, ranges, repeats, overlaps."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("line"), F.col("p_name").alias("name"), (F.col("p_size") % 20).alias("x"), (F.col("p_partkey") * 7 % 300).alias("y"), F.col("p_size").alias("v"))
    h = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 7).alias("departures"))
    count = lambda df: df.agg(F.count("*").alias("n"))
    repeats = lambda *keys: p.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    n = F.col("n")
    return Q.verdicts([
        ("headway without station", count(Q.orphans(h, p, "id", "id")), n), ("stations without headway", Q.coverage(p, h, ["id"]), F.col("missing")),
        ("departures out of range", count(h.where("departures <> 0 and 30.0 / departures not between 4.5 and 60")), n), ("value out of range", count(p.where("v not between 1 and 45")), n),
        ("repeated name on a line", repeats("line", "name"), n), ("overlapping points", repeats("line", "x", "y"), n),
    ])
