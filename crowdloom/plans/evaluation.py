"""Baselines on the crowding cells and how well they do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as V
from ..operators import marts
from ..operators.quantiles import exact_quantiles
from ..sources.scratch import written
from .marts import SPLIT, split_cells
from .registry import query
from .views import CONG

Spark = SparkSession
LEVELS = {"l0": [], "l1": ["line_id"], "l2": ["station_code", "direction", "day_type", "time_bin_index"]}
K2 = "station_code, direction, day_type, time_bin_index"
FULL = f"""with {CONG}, s as (select *, {SPLIT} as split from cong), tr as (select * from s where split = 'train'),
m0 as (select avg(congestion_rate) as l0 from tr), m1 as (select line_id, avg(congestion_rate) as l1 from tr group by 1), m2 as (select {K2}, avg(congestion_rate) as l2 from tr group by all),
sn as (select {K2}, snapshot_date, avg(congestion_rate) as m from tr group by all), m3 as (select {K2}, max_by(m, snapshot_date) as lt from sn where m is not null group by all),
p as (select s.*, l0, l1, l2, coalesce(lt, l2) as l3 from s cross join m0 left join m1 using (line_id) left join m2 using ({K2}) left join m3 using ({K2}) where split = 'valid')"""


def predicted(spark: Spark, d: str) -> DataFrame:
    cells = split_cells(spark, d)
    train, valid = cells.where("split = 'train'"), cells.where("split = 'valid'")
    rows = V.ladder(train, valid, LEVELS, "congestion_rate")
    return V.latest_else_mean(train, rows, LEVELS["l2"], "snapshot_date", "congestion_rate", "l3")


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(c, 9).alias(c) for c in df.columns if c not in keep])


@query("M1_mean_with_fallback", f"{FULL} select {K2}, round(avg(coalesce(l2, l1)), 9) as prediction, count(*) as n from p group by all")
def _(spark: Spark, d: str) -> DataFrame:
    return predicted(spark, d).groupBy(*LEVELS["l2"]).agg(F.round(F.avg(F.coalesce("l2", "l1")), 9).alias("prediction"), F.count("*").alias("n"))


LONG = "l as (" + " union all ".join(f"select '{x}' as level, congestion_rate as y, {x} as p, time_bin_index, line_id from p" for x in ("l0", "l1", "l2", "l3")) + ")"
ONE = "round(avg(abs(p - y)), 9) as mae, round(sqrt(avg((p - y) * (p - y))), 9) as rmse, round(1 - sum((p - y) * (p - y)) / nullif(sum(y * y) filter (p is not null) - count(p - y) * avg(y) filter (p is not null) * avg(y) filter (p is not null), 0), 6) as r2, round(avg(cast(p is not null as integer)) filter (y is not null), 9) as coverage"


def long(spark: Spark, d: str) -> DataFrame:
    return predicted(spark, d).unpivot(["congestion_rate", "time_bin_index", "line_id"], ["l0", "l1", "l2", "l3"], "level", "p").withColumnRenamed("congestion_rate", "y")


@query("M2_baseline_ladder", f"{FULL}, {LONG} select level, count(p) as n, round(avg(p), 9) as mean_prediction from l group by 1")
def _(spark: Spark, d: str) -> DataFrame:
    return long(spark, d).groupBy("level").agg(F.count("p").alias("n"), F.round(F.avg("p"), 9).alias("mean_prediction"))


@query("M3_metrics", f"{FULL}, {LONG} select level, {ONE} from l group by 1")
def _(spark: Spark, d: str) -> DataFrame:
    out = long(spark, d).groupBy("level").agg(*V.metrics(F.col("y"), F.col("p")))
    return rounded(out, "level").withColumn("r2", F.round("r2", 6))


#: Each row's own threshold: its station and direction's training quantile (all stations'
#: where there is none). Rates are flat here, so the median stands for the 95th percentile.
GROUP, SHARE = ["line_id", "station_code", "direction"], 0.5
T = f"""tg as (select line_id, station_code, direction, quantile_cont(congestion_rate, {SHARE}) as t from tr where congestion_rate is not null group by 1, 2, 3), ta as (select quantile_cont(congestion_rate, {SHARE}) as t from tr where congestion_rate is not null),
pt as (select p.*, coalesce(tg.t, ta.t) as t from p cross join ta left join tg using (line_id, station_code, direction) where congestion_rate is not null and l2 is not null)"""
PRF = "round(coalesce(count(*) filter (h and g) / nullif(count(*) filter (g), 0), 0), 9) as precision, round(coalesce(count(*) filter (h and g) / nullif(count(*) filter (h), 0), 0), 9) as recall, round(coalesce(2 * count(*) filter (h and g) / nullif(count(*) filter (h) + count(*) filter (g), 0), 0), 9) as f1"


def with_threshold(spark: Spark, d: str) -> DataFrame:
    rows = predicted(spark, d).where("congestion_rate is not null and l2 is not null")
    out = marts.with_group_quantile(rows, split_cells(spark, d).where("split = 'train'"), GROUP, "congestion_rate", SHARE, "t")
    return out.withColumn("hit", F.col("congestion_rate") > F.col("t")).withColumn("said", F.col("l2") > F.col("t"))


@query("M4_high_cells", f"{FULL}, {T}, q as (select line_id, congestion_rate > t as h, l2 > t as g from pt) select line_id, {PRF} from q group by 1")
def high_cells(spark: Spark, d: str) -> DataFrame:
    return rounded(with_threshold(spark, d).groupBy("line_id").agg(*V.precision_recall(F.col("hit"), F.col("said"))), "line_id")


M5 = f"""{FULL}, {T}, q as (select round(l2, 9) as score, congestion_rate > t as h from pt), g as (select score, count(*) filter (h) as pos, count(*) as n from q group by 1),
c as (select *, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as said, sum(pos) over () as allp from g)
select round(sum(pos / nullif(allp, 0) * tp / said), 9) as average_precision, round(max(tp / nullif(allp, 0)) filter (tp / said >= 0.5), 9) as recall_at_half from c"""


@query("M5_average_precision", M5)
def score_curve(spark: Spark, d: str) -> DataFrame:
    return rounded(V.average_precision(with_threshold(spark, d).withColumn("score", F.round("l2", 9)), "score", "hit"))


@query("M6_skill", f"{FULL}, {LONG}, m as (select level, avg(abs(p - y)) as mae from l group by 1) select a.level, round(1 - a.mae / b.mae, 9) as skill, a.mae < b.mae as better from m a cross join (select mae from m where level = 'l1') b")
def _(spark: Spark, d: str) -> DataFrame:
    m = long(spark, d).groupBy("level").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    ref = m.where("level = 'l1'").select(F.col("mae").alias("ref"))
    return m.join(F.broadcast(ref)).select("level", F.round(1 - F.col("mae") / F.col("ref"), 9).alias("skill"), (F.col("mae") < F.col("ref")).alias("better"))


M7 = f"""{FULL} select line_id, case when congestion_rate <= 30 then '<=30' when congestion_rate <= 80 then '30-80' else '>80' end as band, count(*) as n, round(avg(abs(l2 - congestion_rate)), 9) as mae, round(quantile_cont(abs(l2 - congestion_rate), 0.95), 9) as p95_error from p where congestion_rate is not null and l2 is not null group by 1, 2"""


@query("M7_error_by_band", M7)
def _(spark: Spark, d: str) -> DataFrame:
    e = F.abs(F.col("l2") - F.col("congestion_rate"))
    p = predicted(spark, d).where("congestion_rate is not null and l2 is not null").withColumn("e", e)
    return p.groupBy("line_id", S.band(F.col("congestion_rate"), [30, 80], ["<=30", "30-80", ">80"]).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("e"), 9).alias("mae"), F.round(F.percentile("e", 0.95), 9).alias("p95_error"))


def _trained(spark: Spark, d: str, sets: dict[str, list[str]]) -> DataFrame:
    """High: over the training labels' 95th percentile."""
    cells = split_cells(spark, d).where("congestion_rate is not null")
    rows = written(cells.groupBy("split", "snapshot_date", "line_id", *LEVELS["l2"]).agg(F.avg("congestion_rate").alias("label")).withColumn("quarter", F.quarter("snapshot_date")))
    high = exact_quantiles(rows.where("split = 'train'"), [], "label", {"high_from": 0.95})
    marked = rows.join(F.broadcast(high), F.lit(True)).withColumn("high", F.col("label") > F.col("high_from"))
    return V.trained_sets(marked, sets, ["direction", "day_type"])


@query("M8_boosted_trees")
def _(spark: Spark, d: str) -> DataFrame:
    base = ["line_id", "time_bin_index", "direction", "day_type", "quarter"]
    return _trained(spark, d, {"without_station": base, "with_station": [*base, "station_code"]})


@query("M9_ablation")
def _(spark: Spark, d: str) -> DataFrame:
    names = ["time_bin_index", "line_id", "direction", "day_type"]
    return _trained(spark, d, {"+".join(names[: k + 1]): names[: k + 1] for k in range(4)})
