"""Names, times, dates and lists on texts taken from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import query
from .views import table

Spark = SparkSession


@query("S1_canonical_name", r"""select c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name || ' (' || c_mktsegment || ')' , '\s+', '', 'g'), '\([^()]*\)$', ''), '(.)ING$', '\1') as name from customer""")
def _(spark: Spark, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.canonical_name(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")), suffix="ING").alias("name"))


@query("S2_name_list", r"select p_brand, replace(string_agg(p, ';' order by p), ' ', '') as names from (select distinct p_brand, p_name as p from part) group by 1")
def _(spark: Spark, d: str) -> DataFrame:
    names = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_name")), ";").alias("raw"))
    return names.select("p_brand", S.canonical_list(F.col("raw"), suffix="역").alias("names"))


S3 = "select distinct lpad(cast(p_size % 24 as varchar), 2, '0') || '시' || (case when p_size % 2 = 0 then '30분' else '' end) as header, (case when p_size % 24 < 5 then p_size % 24 + 24 else p_size % 24 end) * 60 + (case when p_size % 2 = 0 then 30 else 0 end) as minutes from part"


@query("S3_time_header", S3)
def _(spark: Spark, d: str) -> DataFrame:
    h = F.concat(F.lpad((F.col("p_size") % 24).cast("string"), 2, "0"), F.lit("시"), F.when(F.col("p_size") % 2 == 0, "30분").otherwise(""))
    return table(spark, d, "part").select(h.alias("header")).distinct().withColumn("minutes", S.header_minutes(F.col("header")))


@query("S4_mmss", "select p_partkey, case when p_size % 5 <> 0 then round(p_size + (p_partkey % 60) / 60.0, 9) end as minutes from part")
def _(spark: Spark, d: str) -> DataFrame:
    text = F.when(F.col("p_size") % 5 == 0, "bad").otherwise(F.format_string("%d:%02d", F.col("p_size"), F.col("p_partkey") % 60))
    return table(spark, d, "part").select("p_partkey", F.round(S.mmss_minutes(text), 9).alias("minutes"))


S5 = "with m as (select event_id, cast(hour(ts) * 60 + minute(ts) as integer) as t from events), b as (select event_id, greatest(0, least(38, cast(floor((t - 330) / 30.0) as integer))) as time_bin_index from m) select event_id, time_bin_index, printf('%02d:%02d~%02d:%02d', (time_bin_index * 30 + 330) // 60, (time_bin_index * 30 + 330) % 60, (time_bin_index * 30 + 360) // 60, (time_bin_index * 30 + 360) % 60) as time_bin from b"


def minutes_of(ts: str) -> F.Column:
    return F.hour(ts) * 60 + F.minute(ts)


@query("S5_time_bin", S5)
def _(spark: Spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", S.time_bin(minutes_of("ts")).alias("time_bin_index"))
    return e.withColumn("time_bin", S.bin_label(F.col("time_bin_index")))


@query("S6_hour_code", "select event_id, case when hour(ts) < 6 then 'before_06' else lpad(cast(hour(ts) as varchar), 2, '0') end as hour_bin from events")
def _(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.hour_code(minutes_of("ts")).alias("hour_bin"))


@query("S7_calendar", "select o_orderkey, isodow(o_orderdate) - 1 as dow, case when isodow(o_orderdate) <= 5 then 'weekday' when isodow(o_orderdate) = 6 then 'sat' else 'sun' end as day_type, month(o_orderdate) as month, quarter(o_orderdate) as quarter, strftime(o_orderdate, '%Y-%m') as ym from orders")
def _(spark: Spark, d: str) -> DataFrame:
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.weekday(o).alias("dow"), S.day_type(o).alias("day_type"), F.month(o).alias("month"), F.quarter(o).alias("quarter"), F.date_format(o, "yyyy-MM").alias("ym"))


@query("S8_clean_number", "select o_orderkey, case when o_orderkey % 7 <> 0 then cast(o_orderkey * 1000 as double) end as value from orders")
def _(spark: Spark, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.format_number(F.col("o_orderkey") * 1000, 0), F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", S.clean_number(text).alias("value"))


@query("S9_clean_date", "select o_orderkey, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) end as day from orders")
def _(spark: Spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.when(k % 2 == 0, "-").otherwise("nan")).when(k % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", " yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", S.clean_date(text).alias("day"))


@query("S10_hour_list", "with h as (select p_partkey, p_size % 24 as a, (p_size + 3) % 24 as b from part), g as (select p_partkey, case when a < 5 then 24 else a end as a, case when b < 5 then 24 else b end as b from h) select p_partkey, case when a = b then cast(a as varchar) else a || ';' || b end as hours from g")
def _(spark: Spark, d: str) -> DataFrame:
    text = F.concat(F.lpad((F.col("p_size") % 24).cast("string"), 2, "0"), F.lit(";"), ((F.col("p_size") + 3) % 24).cast("string"), F.lit(";x"))
    return table(spark, d, "part").select("p_partkey", F.array_join(S.hour_list(text).cast("array<string>"), ";").alias("hours"))


@query("S11_node_id", "select p_partkey, p_brand || '_' || p_name || (case when p_size > 40 then '@9' else '' end) as node, p_brand as line, p_name as station from part")
def _(spark: Spark, d: str) -> DataFrame:
    node = S.node_id(F.col("p_brand"), F.col("p_name"), F.when(F.col("p_size") > 40, F.lit("9")))
    return table(spark, d, "part").select("p_partkey", node.alias("node")).select("p_partkey", "node", S.node_line(F.col("node")).alias("line"), S.node_station(F.col("node")).alias("station"))


@query("S12_date_range", "select o_orderkey, cast(o_orderdate as date) as start_date, cast(o_orderdate as date) + cast(o_orderkey % 6 as integer) as end_date, o_orderkey % 6 + 1 as n_days from orders")
def _(spark: Spark, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    last = F.date_add(day, (F.col("o_orderkey") % 6).cast("int"))
    text = F.when(F.col("o_orderkey") % 6 == 0, day.cast("string")).otherwise(F.concat(day.cast("string"), F.lit("~"), last.cast("string")))
    a, b, n = S.range_parts(text)
    return table(spark, d, "orders").select("o_orderkey", a.alias("start_date"), b.alias("end_date"), n.cast("long").alias("n_days"))


@query("S13_title", "select o_orderkey, year(o_orderdate) || ' ' || o_orderpriority || ' sale' as title from orders")
def _(spark: Spark, d: str) -> DataFrame:
    text = F.concat("o_orderpriority", F.lit("  "), F.year("o_orderdate").cast("string"), F.lit(" sale"))
    return table(spark, d, "orders").select("o_orderkey", S.title_year_first(text).alias("title"))


@query("C15_direction_text", "select p_partkey, p_partkey % 3 <> 0 as valid from part")
def _(spark: Spark, d: str) -> DataFrame:
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" 방면"))).otherwise(F.concat(F.lit("x"), "p_name", F.lit(" 방면")))
    return table(spark, d, "part").select("p_partkey", S.valid_toward(F.col("p_name"), other).alias("valid"))
