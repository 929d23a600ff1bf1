"""Views of the given tables in the shape the jobs expect, and the same views in SQL.

The tables have no transit data, so shipments stand for rides: a supplier's nation is a
station, its region a line, the line status a direction, the line number a time of day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as (l_suppkey, line_id, station_code, station_name): a dimension."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("line_id"), F.col("n_nationkey").alias("station_code"), F.col("n_name").alias("station_name"))


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridership fact: one row for each shipment line."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_linestatus", "l_linenumber", "l_quantity")
    return l.join(stations(spark, sf_dir), "l_suppkey").select(
        F.to_date("l_shipdate").alias("date"), "line_id", "station_code", "station_name", F.when(F.col("l_linestatus") == "O", "boarding").otherwise("alighting").alias("direction"),
        F.col("l_linenumber").cast("int").alias("hour"), F.col("l_quantity").cast("long").alias("passenger_count"),
    )


RIDES = """rides as (select cast(l_shipdate as date) as date, n_regionkey as line_id, n_nationkey as station_code, n_name as station_name,
 case when l_linestatus = 'O' then 'boarding' else 'alighting' end as direction, cast(l_linenumber as integer) as hour, cast(l_quantity as bigint) as passenger_count
 from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey)"""


def congestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crowding fact: snapshot (quarter) x day type x station x direction x bin."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_linestatus", "l_linenumber", "l_quantity", "l_tax")
    day = F.weekday("l_shipdate")
    return l.join(stations(spark, sf_dir), "l_suppkey").select(
        F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("snapshot_date"), F.when(day < 5, "weekday").when(day == 5, "sat").otherwise("sun").alias("day_type"), "line_id", "station_code", "station_name",
        F.when(F.col("l_linestatus") == "O", "up").otherwise("down").alias("direction"), F.col("l_linenumber").cast("int").alias("time_bin_index"),
        F.when(F.col("l_tax") != 0, 3 * F.col("l_quantity")).alias("congestion_rate"),
    )


CONG = """cong as (select cast(date_trunc('quarter', l_shipdate) as date) as snapshot_date,
 case when isodow(l_shipdate) <= 5 then 'weekday' when isodow(l_shipdate) = 6 then 'sat' else 'sun' end as day_type,
 n_regionkey as line_id, n_nationkey as station_code, n_name as station_name, case when l_linestatus = 'O' then 'up' else 'down' end as direction,
 cast(l_linenumber as integer) as time_bin_index, case when l_tax <> 0 then 3 * l_quantity end as congestion_rate
 from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event calendar: urgent orders of a nation's best year and value, two days each."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    best = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_totalprice", "o_orderkey")).alias("o"))
    start = F.to_date("o.o_orderdate")
    return best.select(
        F.col("o.o_orderkey").alias("event_id"), F.element_at(F.array(F.lit("festival"), F.lit("game"), F.lit("exam")), F.pmod(F.col("o.o_orderkey"), F.lit(3)).cast("int") + 1).alias("event_type"),
        F.col("c_nationkey").alias("station_code"), start.alias("start_date"), F.date_add(start, 2).alias("end_date"), F.lit("1;2;7").alias("peak_hour_bins"),
    )


EVENTS = """ev as (select o_orderkey as event_id, list_element(['festival', 'game', 'exam'], cast(o_orderkey % 3 + 1 as integer)) as event_type, c_nationkey as station_code,
 cast(o_orderdate as date) as start_date, cast(o_orderdate as date) + 2 as end_date, '1;2;7' as peak_hour_bins from (
 select *, row_number() over (partition by c_nationkey, year(o_orderdate) order by o_totalprice desc, o_orderkey desc) as rn from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT') where rn = 1)"""


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line sequences: parts by key within a brand, minutes from the size."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("line_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("station_name"), (1 + F.col("p_size") % 5).cast("int").alias("minutes"))


SEQ = "seq as (select p_brand as line_id, p_partkey as seq, p_name as station_name, cast(1 + p_size % 5 as integer) as minutes from part)"
