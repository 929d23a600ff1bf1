"""Masters, marts, profiles and look-ups on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import marts
from ..operators.quantiles import exact_quantiles
from ..sources import files
from .registry import query
from .views import CONG, RIDES, congestion, rides, stations, table

Spark = SparkSession
KEYS = ["line_id", "station_code", "direction", "day_type"]
SPLIT = "case when snapshot_date <= date '1998-12-31' then 'train' when snapshot_date <= date '2000-06-30' then 'valid' else 'test' end"


def split_cells(spark: Spark, d: str) -> DataFrame:
    return congestion(spark, d).withColumn("split", marts.split_by_date(F.col("snapshot_date"), "1998-12-31", "2000-06-30"))


def wide(spark: Spark, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity")
    return l.groupBy("l_suppkey").pivot("l_linenumber", list(range(1, 8))).agg(F.sum("l_quantity")).toDF("l_suppkey", *(f"h{k}" for k in range(1, 8)))


WIDE = "wide as (select l_suppkey, " + ", ".join(f"sum(l_quantity) filter (l_linenumber = {k}) as h{k}" for k in range(1, 8)) + " from lineitem group by 1)"


@query("A4_mart_write_read", "select l_suppkey, l_linenumber, l_quantity from lineitem where l_linenumber in (2, 5) and l_suppkey in (3, 5, 7)")
def written_mart(spark: Spark, d: str) -> DataFrame:
    """The fact written as a mart by line number, then read back: two of its folders, three
    of its columns."""
    path = files.new_folder(spark, "mart")
    files.write_mart(table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_tax"), path, ["l_linenumber"])
    return files.read_mart(spark, path, ["l_suppkey", "l_linenumber", "l_quantity"], {"l_linenumber": [2, 5], "l_suppkey": [3, 5, 7]})


@query("A5_provenance", "select count(*) as n, 'lineitem.parquet' as source_file, 'v1' as schema_version, year(l_shipdate) as period from lineitem group by year(l_shipdate)")
def _(spark: Spark, d: str) -> DataFrame:
    name = F.col("_metadata.file_name")
    return table(spark, d, "lineitem").select(F.year("l_shipdate").alias("period"), name.alias("source_file")).withColumn("schema_version", F.lit("v1")).groupBy("period", "source_file", "schema_version").agg(F.count("*").alias("n"))


@query("B1_melt", f"with {WIDE} select l_suppkey, k as hour, v as passengers from (" + " union all ".join(f"select l_suppkey, 'h{k}' as k, h{k} as v from wide" for k in range(1, 8)) + ")")
def _(spark: Spark, d: str) -> DataFrame:
    return marts.melt(wide(spark, d), ["l_suppkey"], [f"h{k}" for k in range(1, 8)], "hour", "passengers")


@query("B2_scope_flag", "select s_suppkey, s_nationkey, case when s_nationkey between 0 and 9 or s_nationkey between 15 and 19 then 1 else 0 end as in_scope from supplier")
def _(spark: Spark, d: str) -> DataFrame:
    ranges = spark.createDataFrame([(0, 9, 1), (15, 19, 1)], "lo int, hi int, line int")
    return marts.by_range(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ranges, "s_nationkey", "in_scope").select("s_suppkey", "s_nationkey", "in_scope")


@query("B3_line_correction", "select s_suppkey, n_regionkey as line_raw, n_nationkey // 5 as line_id, cast(n_regionkey <> n_nationkey // 5 as integer) as is_line_corrected from supplier join nation on n_nationkey = s_nationkey")
def _(spark: Spark, d: str) -> DataFrame:
    ranges = spark.createDataFrame([(5 * k, 5 * k + 4, k) for k in range(5)], "lo int, hi int, line int")
    out = marts.by_range(stations(spark, d), ranges, "station_code", "known").withColumn("fixed", F.coalesce("range_line", "line_id"))
    return out.select(F.col("l_suppkey").alias("s_suppkey"), F.col("line_id").alias("line_raw"), F.col("fixed").alias("line_id"), (F.col("line_id") != F.col("fixed")).cast("int").alias("is_line_corrected"))


@query("B4_recode", "select o_orderstatus, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' end as status, count(*) as n from orders group by 1, 2")
def _(spark: Spark, d: str) -> DataFrame:
    codes = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("status", F.try_element_at(codes, F.col("o_orderstatus")))


@query("B5_operating_flag", f"with {CONG} select line_id, cast(sum(case when congestion_rate is null then 0 else 1 end) as bigint) as operating, count(*) as cells from cong group by 1")
def _(spark: Spark, d: str) -> DataFrame:
    return congestion(spark, d).withColumn("is_operating", F.col("congestion_rate").isNotNull().cast("int")).groupBy("line_id").agg(F.sum("is_operating").alias("operating"), F.count("*").alias("cells"))


@query("B6_time_split", f"with {CONG} select {SPLIT} as split, snapshot_date, count(*) as n from cong group by 1, 2")
def _(spark: Spark, d: str) -> DataFrame:
    return split_cells(spark, d).groupBy("split", "snapshot_date").agg(F.count("*").alias("n"))


@query("B7_hold_out", "select s_suppkey, case when row_number() over (order by md5(cast(s_suppkey as varchar) || 'seed7'), s_suppkey) <= floor(0.2 * count(*) over ()) then 1 else 0 end as held_out from supplier")
def _(spark: Spark, d: str) -> DataFrame:
    return marts.hold_out(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 0.2, "seed7")


@query("B8_perceived_multiplier", f"with {CONG} select distinct congestion_rate, case when congestion_rate is not null then 1 + 0.5 * greatest(congestion_rate - 80, 0) / 100 end as perceived_multiplier from cong")
def _(spark: Spark, d: str) -> DataFrame:
    return congestion(spark, d).select("congestion_rate").distinct().withColumn("perceived_multiplier", S.perceived_multiplier(F.col("congestion_rate")))


B9 = f"""with {RIDES}, a as (select date_trunc('month', date) as m, line_id, station_code, sum(passenger_count) filter (direction = 'boarding') as b, sum(passenger_count) filter (direction = 'alighting') as al from rides group by 1, 2, 3)
select cast(m as date) as ym, line_id, station_code, round(coalesce(b, 0) / nullif(coalesce(b, 0) + coalesce(al, 0), 0), 9) as boarding_ratio, round((coalesce(al, 0) - coalesce(b, 0)) / nullif(coalesce(b, 0) + coalesce(al, 0), 0), 9) as net_alighting,
 round((coalesce(b, 0) + coalesce(al, 0)) / nullif(sum(coalesce(b, 0) + coalesce(al, 0)) over (partition by m, line_id), 0), 9) as line_share, round(ln(1 + coalesce(b, 0)), 9) as log_boarding from a"""


@query("B9_flow_features", B9)
def _(spark: Spark, d: str) -> DataFrame:
    flows = rides(spark, d).groupBy(F.trunc("date", "MM").alias("ym"), "line_id", "station_code").pivot("direction", ["boarding", "alighting"]).agg(F.sum("passenger_count"))
    b, a = F.coalesce("boarding", F.lit(0)), F.coalesce("alighting", F.lit(0))
    line = F.sum(b + a).over(W.partitionBy("ym", "line_id"))
    ratio = lambda x, y: F.round(F.try_divide(x, F.nullif(y, F.lit(0))), 9)
    return flows.select("ym", "line_id", "station_code", ratio(b, b + a).alias("boarding_ratio"), ratio(a - b, b + a).alias("net_alighting"), ratio(b + a, line).alias("line_share"), F.round(F.log1p(b), 9).alias("log_boarding"))


@query("B10_bands", f"with {CONG} select case when congestion_rate <= 30 then 'low' when congestion_rate <= 80 then 'mid' when congestion_rate <= 100 then 'high' when congestion_rate is not null then 'very_high' end as band, count(*) as n from cong group by 1")
def _(spark: Spark, d: str) -> DataFrame:
    return congestion(spark, d).groupBy(S.band(F.col("congestion_rate"), [30, 80, 100], ["low", "mid", "high", "very_high"]).alias("band")).agg(F.count("*").alias("n"))


@query("B11_expected_wait", "select p_partkey, case when 30.0 / nullif(p_size % 7, 0) between 0.1 and 60 then round(30.0 / nullif(p_size % 7, 0) / 2, 9) end as wait_min from part")
def _(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(S.expected_wait(F.col("p_size") % 7), 9).alias("wait_min"))


@query("C1_fact_dimension", "select l_suppkey, coalesce(n_name, '?') as station_name, coalesce(n_regionkey, -1) as line_id, count(*) as n from lineitem left join supplier on s_suppkey = l_suppkey and s_suppkey % 10 <> 0 left join nation on n_nationkey = s_nationkey group by 1, 2, 3")
def _(spark: Spark, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    dim = stations(spark, d).where("l_suppkey % 10 <> 0")
    return facts.join(dim, "l_suppkey", "left").select("l_suppkey", F.coalesce("station_name", F.lit("?")).alias("station_name"), F.coalesce("line_id", F.lit(-1)).alias("line_id"), "n")


C2 = """with dim as (select p_partkey, p_name, p_retailprice as price from part where p_partkey % 3 <> 0), nm as (select p_name, max(price) as price from dim group by 1)
select p.p_partkey, coalesce(d.price, nm.price) as price, case when d.price is not null then 'exact' when nm.price is not null then 'name' end as matched from part p left join dim d on d.p_partkey = p.p_partkey left join nm on nm.p_name = p.p_name"""


@query("C2_exact_then_name", C2)
def _(spark: Spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    dim = p.where("p_partkey % 3 <> 0").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    return marts.exact_then_name(p.select("p_partkey", "p_name"), dim, ["p_partkey"], ["p_name"], "price").select("p_partkey", "price", "matched")


C4 = f"""with {CONG}, s as (select *, {SPLIT} as split from cong), g as (select line_id, station_code, direction, quantile_cont(congestion_rate, 0.95) as t from s where split = 'train' and congestion_rate is not null group by 1, 2, 3),
a as (select quantile_cont(congestion_rate, 0.95) as t from s where split = 'train' and congestion_rate is not null)
select s.line_id, s.station_code, s.direction, split, round(coalesce(g.t, a.t), 9) as threshold, count(*) as cells, cast(sum(cast(congestion_rate is not null as integer)) as bigint) as operating, cast(sum(cast(congestion_rate > coalesce(g.t, a.t) as integer)) as bigint) as high, cast(sum(cast(congestion_rate >= 100 as integer)) as bigint) as extreme,
 round(sum(case when congestion_rate is not null then 1 + 0.5 * greatest(congestion_rate - 80, 0) / 100 end), 6) as perceived from s cross join a left join g on g.line_id = s.line_id and g.station_code = s.station_code and g.direction = s.direction group by all"""


@query("C4_cell_mart", C4)
def _(spark: Spark, d: str) -> DataFrame:
    cells = marts.cell_mart(split_cells(spark, d), ["line_id", "station_code", "direction"])
    return cells.groupBy("line_id", "station_code", "direction", "split", F.round("threshold", 9).alias("threshold")).agg(
        F.count("*").alias("cells"), F.sum("is_operating").alias("operating"), F.sum("label_high").alias("high"), F.sum("label_extreme").alias("extreme"), F.round(F.sum("perceived_multiplier"), 6).alias("perceived")
    )


MONTHLY = f"""{RIDES}, daily as (select line_id, station_code, direction, hour, date, sum(passenger_count) as x from rides group by all),
monthly as (select line_id, station_code, direction, hour, cast(date_trunc('month', date) as date) as ym, sum(x) / count(*) as mean_passenger_count, count(*) as n_days from daily group by all)"""
RIDE_KEYS = ["line_id", "station_code", "direction", "hour"]


@query("D5_monthly_mean", f"with {MONTHLY} select line_id, station_code, direction, hour, ym, round(mean_passenger_count, 9) as mean_passenger_count, n_days from monthly")
def _(spark: Spark, d: str) -> DataFrame:
    out = marts.monthly_mean(rides(spark, d), RIDE_KEYS, "date", "passenger_count")
    return out.withColumn("mean_passenger_count", F.round("mean_passenger_count", 9))


C5 = f"""with {MONTHLY}, snaps as (select distinct cast(date_trunc('quarter', date) as date) as snapshot_date from rides)
select snapshot_date, line_id, station_code, direction, hour, round(avg(mean_passenger_count), 9) as mean_passenger_count, count(distinct ym) as n_months from monthly join snaps
 on ym between date_trunc('month', snapshot_date - 90) and date_trunc('month', snapshot_date) group by all"""


@query("C5_look_back", C5)
def _(spark: Spark, d: str) -> DataFrame:
    r = rides(spark, d)
    snaps = r.select(F.to_date(F.date_trunc("quarter", "date")).alias("snapshot_date")).distinct()
    out = marts.look_back(marts.monthly_mean(r, RIDE_KEYS, "date", "passenger_count"), snaps, RIDE_KEYS, "mean_passenger_count")
    return out.withColumn("mean_passenger_count", F.round("mean_passenger_count", 9))


D1 = f"""with {RIDES}, m as (select line_id, station_code, station_name, date_trunc('month', date) as p, sum(passenger_count) as x from rides group by all)
select line_id, station_code, string_agg(distinct station_name, '|' order by station_name) as names, max_by(station_name, p) as latest_name, cast(min(p) as date) as first_period, cast(max(p) as date) as last_period, count(distinct p) as n_periods, cast(sum(x) as bigint) as total from m group by 1, 2"""


def master(spark: Spark, d: str) -> DataFrame:
    return marts.station_master(rides(spark, d).withColumn("p", F.trunc("date", "MM")), ["line_id", "station_code"], "station_name", "p", "passenger_count")


@query("D1_station_master", D1)
def _(spark: Spark, d: str) -> DataFrame:
    return master(spark, d)


D2 = f"""with {RIDES}, m as (select left(station_name, 1) as name, line_id, station_code, cast(sum(passenger_count) as bigint) as total, count(distinct date_trunc('month', date)) as n_periods from rides group by 1, 2, 3),
s as (select *, case when sum(total) over w > 0 then round(total / sum(total) over w, 4) else 0 end as share_in_name, count(*) over w as members from m window w as (partition by name))
select name, line_id, station_code, share_in_name, case when total <= 0 then 'none' when share_in_name < 0.01 then 'negligible' else 'ok' end as attribution_flag, cast(members > 1 as integer) as is_transfer, cast(n_periods = (select max(n_periods) from m) as integer) as coverage_full from s"""


@query("D2_name_share", D2)
def name_share(spark: Spark, d: str) -> DataFrame:
    """The first letter stands for a name that stations of several lines share."""
    named = master(spark, d).withColumn("name", F.left("latest_name", F.lit(1)))
    return marts.shares(named, "name", "station_code", "total", "n_periods").select("name", "line_id", "station_code", "share_in_name", "attribution_flag", "is_transfer", "coverage_full")


D3 = """with raw as (select n_nationkey as station_code, case when l_shipdate < timestamp '1997-01-01' then 'OLD ' || n_name when l_shipdate >= timestamp '2000-01-01' and n_nationkey % 2 = 0 then n_name || ' (' || n_regionkey || ')' else n_name end as station_name, l_shipdate
 from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
m as (select station_code, arg_max(station_name, struct_pack(d := l_shipdate, n := station_name)) as latest_name from raw group by 1), c as (select *, regexp_replace(regexp_replace(latest_name, '\\s+', '', 'g'), '\\([^()]*\\)$', '') as canonical_name from m)
select distinct station_code, station_name as alias_name, canonical_name, case when station_name = latest_name then 'parenthetical' else 'renamed' end as alias_source from raw join c using (station_code) where station_name <> canonical_name"""


@query("D3_alias_master", D3)
def alias_names(spark: Spark, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate").join(stations(spark, d), "l_suppkey")
    old, late = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp"), (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")) & (F.col("station_code") % 2 == 0)
    raw = l.select("station_code", "l_shipdate", F.when(old, F.concat(F.lit("OLD "), "station_name")).when(late, F.concat("station_name", F.lit(" ("), "line_id", F.lit(")"))).otherwise(F.col("station_name")).alias("station_name"))
    latest = raw.groupBy("station_code").agg(F.max_by("station_name", F.struct("l_shipdate", "station_name")).alias("latest_name"))
    return marts.alias_master(raw, latest.withColumn("canonical_name", S.canonical_name(F.col("latest_name"))), ["station_code"], "station_name")


@query("D4_daily_hourly", f"with {RIDES} select station_code, direction, date, hour, cast(sum(passenger_count) as bigint) as passengers from rides group by grouping sets ((station_code, direction, date), (station_code, direction, date, hour))")
def _(spark: Spark, d: str) -> DataFrame:
    r = rides(spark, d)
    keys = [F.col(c) for c in ("station_code", "direction", "date", "hour")]
    return r.groupingSets([keys[:3], keys], *keys).agg(F.sum("passenger_count").alias("passengers"))


@query("D6_exact_quantiles", f"with {CONG} select line_id, direction, median(congestion_rate) as med, round(quantile_cont(congestion_rate, 0.9), 9) as p90, round(quantile_cont(congestion_rate, 0.95), 9) as p95 from cong group by 1, 2")
def _(spark: Spark, d: str) -> DataFrame:
    out = exact_quantiles(congestion(spark, d), ["line_id", "direction"], "congestion_rate", {"med": 0.5, "p90": 0.9, "p95": 0.95})
    return out.withColumn("p90", F.round("p90", 9)).withColumn("p95", F.round("p95", 9))


K = "line_id, station_code, direction, day_type"
D7 = f"""with {CONG}, s as (select {K}, round(avg(congestion_rate), 9) as mean_rate, median(congestion_rate) as median_rate, max(congestion_rate) as max_rate, round(quantile_cont(congestion_rate, 0.95), 9) as p95_rate, count(congestion_rate) as n_cells,
 round(avg(congestion_rate) filter (time_bin_index in (2, 3)), 9) as am_peak_mean, round(avg(congestion_rate) filter (time_bin_index in (5, 6)), 9) as pm_peak_mean from cong group by all),
b as (select {K}, time_bin_index, avg(congestion_rate) as m from cong group by all), p as (select *, row_number() over (partition by {K} order by round(m, 9) desc nulls last, time_bin_index) as rn, count(*) filter (m > 80) over (partition by {K}) * 30 as crowded_minutes from b)
select s.*, case when m is not null then time_bin_index end as peak_bin, round(m, 9) as peak_mean, crowded_minutes from s join p using ({K}) where rn = 1"""


@query("D7_station_profile", D7)
def station_profile(spark: Spark, d: str) -> DataFrame:
    out = marts.profile(congestion(spark, d), KEYS, "time_bin_index", "congestion_rate", [2, 3], [5, 6])
    return out.withColumns({c: F.round(c, 9) for c in ("mean_rate", "p95_rate", "am_peak_mean", "pm_peak_mean", "peak_mean")})


D8 = f"""with {CONG} select {K}, time_bin_index, median(congestion_rate) as congestion_median, round(quantile_cont(congestion_rate, 0.9), 9) as congestion_p90, count(distinct snapshot_date) as n_snapshots, 1 + 0.5 * greatest(median(congestion_rate) - 80, 0) / 100 as perceived_multiplier from cong where congestion_rate is not null group by all"""


@query("D8_edge_lookup", D8)
def edge_lookup(spark: Spark, d: str) -> DataFrame:
    return marts.lookup(congestion(spark, d), [*KEYS, "time_bin_index"], "congestion_rate", "snapshot_date").withColumn("congestion_p90", F.round("congestion_p90", 9))


@query("D9_pivot", f"with {RIDES} select station_code, hour, cast(sum(passenger_count) filter (direction = 'boarding') as bigint) as boarding, cast(sum(passenger_count) filter (direction = 'alighting') as bigint) as alighting from rides group by 1, 2")
def _(spark: Spark, d: str) -> DataFrame:
    return rides(spark, d).groupBy("station_code", "hour").pivot("direction", ["boarding", "alighting"]).agg(F.sum("passenger_count"))


@query("D10_station_total", f"with {RIDES}, g as (select line_id, station_code, cast(sum(passenger_count) as bigint) as total from rides group by 1, 2) select *, cast(sum(total) over (partition by line_id) as bigint) as line_total, max(total) over (partition by line_id) as line_max from g")
def _(spark: Spark, d: str) -> DataFrame:
    g = rides(spark, d).groupBy("line_id", "station_code").agg(F.sum("passenger_count").alias("total"))
    line = W.partitionBy("line_id")
    return g.withColumn("line_total", F.sum("total").over(line)).withColumn("line_max", F.max("total").over(line))


D11 = f"""with {CONG} select line_id, count(*) filter (day_type = 'weekday') as weekday, count(*) filter (day_type = 'sat') as sat, count(*) filter (day_type = 'sun') as sun, round(avg(cast(congestion_rate is null as integer)), 9) as null_rate,
 count(congestion_rate) as n, round(avg(congestion_rate), 9) as mean, round(stddev_samp(congestion_rate), 6) as std, min(congestion_rate) as least, round(quantile_cont(congestion_rate, 0.25), 9) as p25, round(quantile_cont(congestion_rate, 0.5), 9) as p50, round(quantile_cont(congestion_rate, 0.75), 9) as p75, max(congestion_rate) as most,
 round(corr(time_bin_index, congestion_rate), 9) as corr_time_bin_index, round(corr(station_code, congestion_rate), 9) as corr_station_code, round(corr(month(snapshot_date), congestion_rate), 9) as corr_month from cong group by 1"""


@query("D11_describe", D11)
def described(spark: Spark, d: str) -> DataFrame:
    out = marts.describe(congestion(spark, d).withColumn("month", F.month("snapshot_date")), ["line_id"], "congestion_rate", "day_type", ["weekday", "sat", "sun"], ["time_bin_index", "station_code", "month"])
    return out.select(*[F.round(c, 6 if c == "std" else 9).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("D15_line_summary", f"with {CONG} select line_id, day_type, count(congestion_rate) as n, round(avg(congestion_rate), 9) as mean_rate, max(congestion_rate) as max_rate, median(congestion_rate) as median_rate from cong group by 1, 2")
def _(spark: Spark, d: str) -> DataFrame:
    return congestion(spark, d).groupBy("line_id", "day_type").agg(F.count("congestion_rate").alias("n"), F.round(F.avg("congestion_rate"), 9).alias("mean_rate"), F.max("congestion_rate").alias("max_rate"), F.median("congestion_rate").alias("median_rate"))


D17 = """with n as (select p_name as station_name, p_brand as line_id, p_brand || '_' || p_name || case when p_size % 7 = 0 then '@b' else '' end as node from part), u as (select distinct station_name, node from n)
select station_name, string_agg(distinct line_id, ';' order by line_id) as lines, (select string_agg(node, ';' order by contains(node, '@'), node) from u where u.station_name = n.station_name) as nodes, count(distinct line_id) as n_lines, count(distinct node) as n_nodes,
 station_name in (select p_name from part where p_size = 1) as is_transfer, station_name in (select p_name from part where p_size = 7) as is_branch, station_name in (select p_name from part where p_retailprice > 1500) as is_event from n group by station_name"""


@query("D17_display_master", D17)
def displayed(spark: Spark, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("station_name", F.col("p_name"))
    branch = F.when(F.col("p_size") % 7 == 0, F.lit("@b")).otherwise("")
    nodes = p.select("station_name", F.col("p_brand").alias("line_id"), F.concat("p_brand", F.lit("_"), "p_name", branch).alias("node"))
    return marts.display_master(nodes, {"is_transfer": p.where("p_size = 1"), "is_branch": p.where("p_size = 7"), "is_event": p.where("p_retailprice > 1500")})


E1 = f"""with {CONG}, b as (select {K}, time_bin_index, round(avg(congestion_rate), 9) as bin_mean from cong where congestion_rate is not null group by all)
select {K}, time_bin_index as peak_bin, bin_mean from (select *, row_number() over (partition by {K} order by bin_mean desc, time_bin_index) as rn from b) where rn = 1"""


@query("E1_peak_bin", E1)
def _(spark: Spark, d: str) -> DataFrame:
    bins = congestion(spark, d).where("congestion_rate is not null").groupBy(*KEYS, "time_bin_index").agg(F.round(F.avg("congestion_rate"), 9).alias("bin_mean"))
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("bin_mean"), "time_bin_index"))
    return bins.withColumn("rn", rank).where("rn = 1").select(*KEYS, F.col("time_bin_index").alias("peak_bin"), "bin_mean")


E3 = "with v as (select p_name, cast(sum(p_size) filter (p_size > 3) as bigint) as volume from part group by 1), r as (select volume, (rank() over (order by volume) + (count(*) over (partition by volume) - 1) / 2.0) / count(*) over () as pct from v where volume is not null) select v.p_name, v.volume, round(3 * coalesce((select max(pct) from r where r.volume = v.volume), 0), 9) as penalty_min from v"


@query("E3_volume_penalty", E3)
def _(spark: Spark, d: str) -> DataFrame:
    v = table(spark, d, "part").groupBy("p_name").agg(F.sum(F.when(F.col("p_size") > 3, F.col("p_size"))).alias("volume"))
    return marts.average_rank(v, "volume", "pct").select("p_name", "volume", F.round(3 * F.coalesce("pct", F.lit(0.0)), 9).alias("penalty_min"))


E4 = f"""with {CONG}, m as (select line_id, direction, median(congestion_rate) as gm from cong group by 1, 2), a as (select median(congestion_rate) as am from cong)
select line_id, direction, snapshot_date, round(sum(coalesce(congestion_rate, gm, am)), 6) as filled, count(*) as n from cong join m using (line_id, direction) cross join a group by 1, 2, 3"""


@query("E4_median_imputation", E4)
def _(spark: Spark, d: str) -> DataFrame:
    filled = marts.imputed(congestion(spark, d), ["line_id", "direction"], "congestion_rate", "x")
    return filled.groupBy("line_id", "direction", "snapshot_date").agg(F.round(F.sum("x"), 6).alias("filled"), F.count("*").alias("n"))


@query("E9_top_k", f"with {CONG} select station_name, direction, round(avg(congestion_rate), 9) as mean_rate from cong group by 1, 2 order by mean_rate desc, station_name, direction limit 10")
def _(spark: Spark, d: str) -> DataFrame:
    return congestion(spark, d).groupBy("station_name", "direction").agg(F.round(F.avg("congestion_rate"), 9).alias("mean_rate")).orderBy(F.desc("mean_rate"), "station_name", "direction").limit(10)


@query("E10_frequency", "select event_type, count(*) as n from events group by 1")
def _(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("G1_union", "select 'order' as kind, o_orderkey as id, cast(o_orderdate as date) as day from orders union all select 'event', event_id, cast(ts as date) from events")
def _(spark: Spark, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    b = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_id").alias("id"), F.lit("event").alias("kind"))
    return a.unionByName(b)


G2 = f"with {CONG}, s as (select distinct snapshot_date, station_code, time_bin_index, day_type from cong), base as (select station_code, time_bin_index, day_type from s where snapshot_date = (select max(snapshot_date) from s)), q as (select distinct snapshot_date from s) select snapshot_date, station_code, time_bin_index, day_type, 'missing' as kind from q cross join base where not exists (select 1 from s where s.snapshot_date = q.snapshot_date and s.station_code = base.station_code and s.time_bin_index = base.time_bin_index and s.day_type = base.day_type) union all select snapshot_date, station_code, time_bin_index, day_type, 'extra' from s where not exists (select 1 from base where base.station_code = s.station_code and base.time_bin_index = s.time_bin_index and base.day_type = s.day_type)"


@query("G2_set_drift", G2)
def _(spark: Spark, d: str) -> DataFrame:
    key = ["station_code", "time_bin_index", "day_type"]
    s = congestion(spark, d).select("snapshot_date", *key).distinct()
    latest = s.agg(F.max("snapshot_date").alias("snapshot_date"))
    base = s.join(F.broadcast(latest), "snapshot_date", "left_semi").select(*key)
    missing = marts.absent(s, base, key, "snapshot_date").withColumn("kind", F.lit("missing")).select("snapshot_date", *key, "kind")
    return missing.unionByName(s.join(base, key, "left_anti").withColumn("kind", F.lit("extra")))


@query("G3_key_coverage", "with a as (select distinct l_partkey as k from lineitem where l_linenumber = 7), b as (select p_partkey as k from part) select (select count(*) from (select k from a except select k from b)) as only_a, (select count(*) from (select k from b except select k from a)) as only_b, (select count(*) from (select k from a intersect select k from b)) as common")
def _(spark: Spark, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_partkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("k")).distinct().withColumn("b", F.lit(1))
    n = lambda c: F.count(F.when(c, 1))
    return a.join(b, "k", "full_outer").agg(n(F.col("b").isNull()).alias("only_a"), n(F.col("a").isNull()).alias("only_b"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))


@query("G4_first_per_key", "select p_name, p_partkey, p_brand from (select *, row_number() over (partition by p_name order by p_partkey) as rn from part) where rn = 1")
def _(spark: Spark, d: str) -> DataFrame:
    first = F.min_by(F.struct("p_partkey", "p_brand"), "p_partkey").alias("x")
    return table(spark, d, "part").groupBy("p_name").agg(first).select("p_name", "x.*")
