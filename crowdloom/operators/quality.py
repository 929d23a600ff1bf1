"""Declarative data-quality checks, one aggregation pass for each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import node_id, node_line

Rule = tuple[str, str, object]  # column, check, argument


def _broken(rule: Rule) -> Column:
    column, check, arg = rule
    c = F.col(column)
    return {
        "not_null": lambda: c.isNull(), "positive": lambda: c <= 0, "at_least": lambda: c < arg, "in": lambda: ~c.isin(*arg), "between": lambda: ~c.between(*arg), "like": lambda: ~c.rlike(arg),
    }[check]()


def validate(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """(table, column, check, failures): all rules of a table in one pass; nulls fail
    not_null alone. Uniqueness is a check of its own kind, by groups."""
    plain = [r for r in rules if r[1] != "unique"]
    one = df.agg(*[F.count(F.when(_broken(r), 1)).alias(f"r{k}") for k, r in enumerate(plain)])
    rows = F.array(*[F.struct(F.lit(table).alias("table"), F.lit(r[0]).alias("column"), F.lit(r[1]).alias("check"), F.col(f"r{k}").alias("failures")) for k, r in enumerate(plain)])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    for column, check, _ in rules:
        if check == "unique":
            repeats = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("failures"))
            out = out.unionByName(repeats.select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit("unique").alias("check"), "failures"))
    return out


def orphans(facts: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    return facts.join(dim.select(F.col(dim_key).alias(key)), key, "left_anti")


def share_at_least(value: str, cut: float) -> Column:
    """Share in percent; nulls count as below the cut."""
    return F.avg(F.coalesce(F.col(value) >= cut, F.lit(False)).cast("int")) * 100


def file_profile(cells: DataFrame, keys: list[str], station: str, rate: str, outside: Column, cuts: tuple[int, ...]) -> DataFrame:
    """Rows, stations, rows out of scope, shares and counts at or above each cut, largest
    rate and its highest quantiles, per file or snapshot."""
    at_least = [x for c in cuts for x in (share_at_least(rate, c).alias(f"share_{c}"), F.count(F.when(F.col(rate) >= c, 1)).alias(f"n_{c}"))]
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(station).alias("stations"), F.count(F.when(outside, 1)).alias("out_of_scope"), *at_least, F.max(rate).alias("max_rate"), F.percentile(rate, 0.99).alias("p99"), F.percentile(rate, 0.999).alias("p999"))


def row_totals(wide: DataFrame, keys: list[str], cells: list[str], total: str, tolerance: float = 0.5) -> DataFrame:
    """Rows whose cells do not add up to the total, missing and negative cells, and rows
    beyond the first of their key. Keys are counted first, so the rest is one aggregate."""
    added, nulls, negative = F.lit(0.0), F.lit(0), F.lit(0)
    for c in cells:
        added, nulls, negative = added + F.coalesce(c, F.lit(0.0)), nulls + F.col(c).isNull().cast("int"), negative + F.coalesce(F.col(c) < 0, F.lit(False)).cast("int")
    per_key = wide.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.abs(added - F.col(total)) > tolerance, 1)).alias("bad"), F.sum(nulls).alias("nulls"), F.sum(negative).alias("negative"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.sum("bad").alias("mismatch"), F.sum("nulls").alias("null_cells"), F.sum("negative").alias("negative_cells"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def day_coverage(facts: DataFrame, date: str) -> DataFrame:
    """Months between the first and the last whose observed days are not all of the month's."""
    months = facts.select(date).distinct().groupBy(F.trunc(date, "MM").alias("ym")).agg(F.count("*").alias("days"))
    calendar = months.agg(F.min("ym").alias("a"), F.max("ym").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("ym"))
    every = F.dayofmonth(F.last_day("ym")).cast("long")
    return calendar.join(months, "ym", "left").select("ym", F.coalesce("days", F.lit(0)).alias("days"), every.alias("days_in_month")).where("days <> days_in_month")


def verdicts(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(check, failures, passed): each check is a frame of one row and what it counts as
    failures there."""
    out = None
    for name, frame, failures in checks:
        one = frame.select(F.lit(name).alias("check"), failures.cast("long").alias("failures"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.col("failures") == 0)


def coverage(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys wanted, and of these how many are not found."""
    w = wanted.select(*keys).distinct()
    seen = found.select(*keys).distinct().withColumn("seen", F.lit(1))
    return w.join(seen, keys, "left").agg(F.count("*").alias("n"), F.count(F.when(F.col("seen").isNull(), 1)).alias("missing"))


def wanted_branch_nodes(sequence: DataFrame, breaks: DataFrame, branch: Column) -> DataFrame:
    """The nodes that branches leave the main line from, by the rules alone: where a station of
    a branch comes after one of the main line. Columns as for ride_edges."""
    rows = sequence.withColumn("branch", branch).withColumn("before", F.lag("station_name").over(W.partitionBy("line_id").orderBy("pos")))
    rows = rows.join(breaks, ["line_id", "station_name"], "left").withColumn("before", F.coalesce("prev", "before")).where("branch <> 'main' and before <> station_name")
    main = sequence.withColumn("branch", branch).where("branch = 'main'").select("line_id", F.col("station_name").alias("before"))
    return rows.join(main, ["line_id", "before"]).select(node_id(F.col("line_id"), F.col("before"), F.col("branch")).alias("node")).distinct()


def open_loops(loops: DataFrame, edges: DataFrame) -> DataFrame:
    """Loops (line_id, entry, last, exit) whose end is not one way: no edge from the last
    station to the loop's own node, or one back."""
    rules = loops.where("entry is not null and last is not null").select("line_id", node_id(F.col("line_id"), F.col("entry"), F.lit("loop")).alias("end"), node_id(F.col("line_id"), F.col("last")).alias("last"))
    to = edges.select(F.col("from_node").alias("last"), F.col("to_node").alias("end")).distinct().withColumn("there", F.lit(True))
    back = edges.select(F.col("from_node").alias("end"), F.col("to_node").alias("last")).distinct().withColumn("back", F.lit(True))
    return rules.join(to, ["end", "last"], "left").join(back, ["end", "last"], "left").where("there is null or back").select("line_id")


def graph_checks(sequence: DataFrame, breaks: DataFrame, branch: Column, edges: DataFrame, walks: DataFrame, scope: Column, meet: int = 3) -> DataFrame:
    """check, failures of a network against the rules that it was to be made by. phantom_edges:
    steps from a line's first station to one neither next to it nor broken to it;
    required_transfers: stations among the first `meet` of several lines without a transfer;
    out_of_scope_nodes: nodes for whose line `scope` does not hold; asymmetric_times: two-way
    edges whose way back is missing or takes another time; branch_nodes: wanted_branch_nodes
    that no edge has."""
    count = lambda df, name: df.agg(F.lit(name).alias("check"), F.count("*").alias("failures"))
    first = sequence.where("pos = 1").select("line_id", F.col("station_name").alias("from_station"))
    broken = breaks.select("line_id", F.col("station_name").alias("to_station"))
    phantom = edges.join(first, ["line_id", "from_station"], "left_semi").where("abs(from_pos - to_pos) > 1").join(broken, ["line_id", "to_station"], "left_anti")
    need = sequence.where(F.col("pos") <= meet).select("station_name", "line_id")
    several = need.groupBy("station_name").count().where("count > 1")
    has = walks.select("station_name", node_line(F.col("from_node")).alias("line_id"))
    lost = need.join(several, "station_name", "left_semi").join(has, ["station_name", "line_id"], "left_anti")
    nodes = edges.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    outside = nodes.withColumn("line_id", node_line(F.col("node"))).where(~scope)
    back = edges.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), F.col("minutes").alias("back"))
    uneven = edges.where("is_bidirectional = 1").join(back, ["from_node", "to_node"], "left").where("back is null or back <> minutes")
    missing = wanted_branch_nodes(sequence, breaks, branch).join(nodes, "node", "left_anti")
    out = count(phantom, "phantom_edges")
    for df, name in ((lost, "required_transfers"), (outside, "out_of_scope_nodes"), (uneven, "asymmetric_times"), (missing, "branch_nodes")):
        out = out.unionByName(count(df, name))
    return out


def alias_candidates(cells: DataFrame, keys: list[str], name: str, date: str) -> DataFrame:
    """Stations (keys) that go by more than one raw name: each name with the first and last
    date it is seen and its rows."""
    names = cells.groupBy(*keys, name).agg(F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), F.count("*").alias("n_rows"))
    return names.withColumn("n_names", F.count(name).over(W.partitionBy(*keys))).where(F.col("n_names") > 1)


def scope_check(cells: DataFrame, line: str, station: str, direction: str) -> DataFrame:
    """What each line of the scope covers: stations, least and greatest code, directions."""
    seen = cells.select(line, station, direction).distinct()
    return seen.groupBy(line).agg(F.count_distinct(station).alias("n_stations"), F.min(station).alias("min_code"), F.max(station).alias("max_code"), F.array_join(F.sort_array(F.collect_set(direction)), "|").alias("directions"))


def single_direction(cells: DataFrame, keys: list[str], direction: str, date: str) -> DataFrame:
    """Stations that the latest snapshot knows in one direction only, with that direction:
    their edges are one-way."""
    last = cells.agg(F.max(date).alias(date))
    ways = cells.join(F.broadcast(last), date).groupBy(*keys).agg(F.min(direction).alias("only_direction"), F.max(direction).alias("other"))
    return ways.where("only_direction = other").drop("other")
