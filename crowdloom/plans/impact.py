"""Event effects on the given tables; rides are summed to (line's region, direction, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import impact
from .registry import query
from .views import EVENTS, RIDES, events, rides, table

Spark = SparkSession
KEYS = ["station_code", "direction"]
BASE = f"""{RIDES}, {EVENTS}, daily as (select station_code, direction, date, cast(sum(passenger_count) as bigint) as x from rides group by all),
days as (select ev.*, cast(unnest(generate_series(start_date, end_date, interval 1 day)) as date) as date from ev), busy as (select distinct station_code, date from days),
clean as (select * from daily d where not exists (select 1 from busy b where b.station_code = d.station_code and b.date = d.date)),
lags as (select 7 * unnest([-8, -7, -6, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5, 6, 7, 8]) as lag)"""
STATS = """samples as (select t.station_code, t.direction, t.date as target, c.x from targets t cross join lags join clean c on c.station_code = t.station_code and c.direction = t.direction and c.date = t.date + cast(lag as integer)),
stats as (select station_code, direction, target, median(x) as base, count(*) as n_samples from samples group by all having count(*) >= {least}),
base as (select s.station_code, s.direction, s.target as date, base, n_samples, median(abs(x - base)) as mad from samples s join stats using (station_code, direction, target) group by all)"""
OWN = "targets as (select distinct d.station_code, d.direction, d.date from daily d join busy using (station_code, date))"
LEAST = 2


def daily(spark: Spark, d: str, of: DataFrame | None = None) -> DataFrame:
    return (rides(spark, d) if of is None else of).groupBy("station_code", "direction", "date").agg(F.sum("passenger_count").alias("x"))


def parts(spark: Spark, d: str, made: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Event days, the daily roll-up (made: both, where they are written already), baselines."""
    days, roll = made or (impact.event_days(events(spark, d)), daily(spark, d))
    own = roll.join(days.select("station_code", "date").distinct(), ["station_code", "date"], "left_semi")
    return days, roll, impact.baselines(own, roll, days, KEYS, "x", least=LEAST)


@query("C6_interval_explode", f"with {EVENTS} select event_id, station_code, cast(unnest(generate_series(start_date, end_date, interval 1 day)) as date) as date from ev")
def _(spark: Spark, d: str) -> DataFrame:
    return impact.event_days(events(spark, d)).select("event_id", "station_code", "date")


C7 = f"with {BASE}, {OWN}, {STATS.format(least=1)} select station_code, direction, date, base, n_samples from base"


@query("C7_seasonal_lags", C7)
def _(spark: Spark, d: str) -> DataFrame:
    days, roll = impact.event_days(events(spark, d)), daily(spark, d)
    own = roll.join(days.select("station_code", "date").distinct(), ["station_code", "date"], "left_semi")
    return impact.baselines(own, roll, days, KEYS, "x", least=1).select(*KEYS, "date", "base", "n_samples")


@query("C8_without_event_days", f"with {BASE} select station_code, direction, count(*) as days, cast(sum(x) as bigint) as x from clean group by 1, 2")
def _(spark: Spark, d: str) -> DataFrame:
    busy = impact.event_days(events(spark, d)).select("station_code", "date").distinct()
    return daily(spark, d).join(busy, ["station_code", "date"], "left_anti").groupBy(*KEYS).agg(F.count("*").alias("days"), F.sum("x").alias("x"))


@query("C9_active_events", f"with {EVENTS} select o_orderkey, event_id from orders join ev on cast(o_orderdate as date) between start_date and end_date and list_contains(string_split(peak_hour_bins, ';'), cast(o_orderkey % 8 as varchar))")
def active_events(spark: Spark, d: str) -> DataFrame:
    """Orders as queries with a date and an hour: the events active at that hour."""
    asked = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 8).cast("int").alias("hour"))
    hours = impact.event_days(events(spark, d)).withColumn("hour", F.explode(S.hour_list(F.col("peak_hour_bins"), before=0)))
    return asked.join(hours.select("event_id", "date", "hour"), ["date", "hour"]).select("o_orderkey", "event_id")


SPIKE = f"""with {BASE}, {OWN}, {STATS.format(least=LEAST)},
spike as (select days.event_id, days.event_type, days.station_code, days.date, d.direction, x, base, n_samples, x / nullif(base, 0) as ratio, (x - base) / (1.4826 * nullif(mad, 0)) as robust_z from days join daily d using (station_code, date) join base b on b.station_code = d.station_code and b.direction = d.direction and b.date = d.date)"""


def spike(spark: Spark, d: str, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    days, roll, base = parts(spark, d, made)
    return impact.spikes(days, roll, base, KEYS, "x")


@query("D12_robust_z", f"{SPIKE} select event_id, station_code, date, direction, round(robust_z, 9) as robust_z from spike")
def _(spark: Spark, d: str) -> DataFrame:
    return spike(spark, d).select("event_id", "station_code", "date", "direction", F.round("robust_z", 9).alias("robust_z"))


@query("I1_daily_spike", f"{SPIKE} select event_id, event_type, station_code, date, direction, x, base, n_samples, round(ratio, 9) as ratio from spike")
def _(spark: Spark, d: str) -> DataFrame:
    return spike(spark, d).select("event_id", "event_type", "station_code", "date", "direction", "x", "base", "n_samples", F.round("ratio", 9).alias("ratio"))


I2 = f"""with {BASE}, hourly as (select station_code, direction, date, hour, cast(sum(passenger_count) as bigint) as x from rides group by all), hc as (select * from hourly h where not exists (select 1 from busy b where b.station_code = h.station_code and b.date = h.date)),
t as (select event_id, station_code, date, h.direction, h.hour, h.x from days join hourly h using (station_code, date) where h.hour in (1, 2, 7)),
s as (select t.event_id, t.station_code, t.date, t.direction, t.hour, median(c.x) as base, count(c.x) as n from t cross join lags left join hc c on c.station_code = t.station_code and c.direction = t.direction and c.hour = t.hour and c.date = t.date + cast(lag as integer) group by all)
select t.event_id, t.station_code, t.date, t.direction, cast(sum(x) as bigint) as actual, round(sum(base), 9) as base, count(*) as n_hours from t join s using (event_id, station_code, date, direction, hour) group by 1, 2, 3, 4 having bool_and(n >= 1)"""


def hourly(spark: Spark, d: str) -> DataFrame:
    return rides(spark, d).groupBy(*KEYS, "hour", "date").agg(F.sum("passenger_count").alias("x"))


def peak() -> F.Column:
    return S.hour_list(F.col("peak_hour_bins"), before=0)


@query("I2_peak_hour_spike", I2)
def peak_hours(spark: Spark, d: str) -> DataFrame:
    days = impact.event_days(events(spark, d)).select("event_id", "station_code", "date", "peak_hour_bins")
    return impact.peak_sums(days, hourly(spark, d), peak(), KEYS, "x", 1).withColumn("base", F.round("base", 9)).drop("ratio")


I3 = f"with {BASE} select a.event_id, a.station_code, a.date, string_agg(distinct cast(b.event_id as varchar), ';' order by cast(b.event_id as varchar)) as confounders from days a left join days b on b.station_code = a.station_code and b.date = a.date and b.event_id <> a.event_id group by 1, 2, 3"


@query("I3_confounding", I3)
def _(spark: Spark, d: str) -> DataFrame:
    return impact.confounding(impact.event_days(events(spark, d))).select("event_id", "station_code", "date", "confounders")


#: What each class of verified strength weighs.
WEIGHT = {"not_significant": 0.0, "weak": 0.2, "medium": 0.4, "strong": 0.7, "very_strong": 1.0}
CLASS = "case when ratio < 1.2 then 'not_significant' when ratio < 1.5 then 'weak' when ratio < 2.0 then 'medium' when ratio < 3.0 then 'strong' else 'very_strong' end"
BASE2 = BASE.replace(", daily as", ", evr as (select *, 'anchor' as role from ev union all select * replace (cast((station_code + 1) % 25 as integer) as station_code), 'impact' as role from ev), daily as").replace("select ev.*, cast(unnest", "select evr.*, cast(unnest").replace("as date from ev)", "as date from evr)")
PEAKS = I2[I2.index("hourly as") : I2.rindex("select t.event_id, t.station_code")].replace("select event_id, station_code, date, h.direction", "select event_id, role, station_code, date, h.direction").rstrip()
VERIFIED = f"""with {BASE2}, {OWN}, {STATS.format(least=LEAST)}, {PEAKS.replace("select t.event_id, t.station_code", "select t.event_id, t.role, t.station_code")},
sp as (select days.event_id, role, days.station_code, days.date, d.direction, 'daily' as scope, x / nullif(base, 0) as ratio from days join daily d using (station_code, date) join base b on b.station_code = d.station_code and b.direction = d.direction and b.date = d.date
 union all select t.event_id, t.role, t.station_code, t.date, t.direction, 'peak_hours', sum(x) / nullif(sum(base), 0) from t join s using (event_id, role, station_code, date, direction, hour) group by 1, 2, 3, 4, 5 having bool_and(n >= {LEAST})),
conf as (select distinct a.event_id, a.station_code, a.date from days a join days b on b.station_code = a.station_code and b.date = a.date and b.event_id <> a.event_id),
an as (select sp.*, conf.event_id is null as clear from sp left join conf using (event_id, station_code, date) where role = 'anchor' and ratio is not null),
ver as (select event_id, station_code, direction, scope, date, ratio, {CLASS} as strength, cast(event_id % 11 = 0 as integer) as excluded, case when event_id % 11 = 0 then 0.0::double else case {CLASS} when 'weak' then 0.2 when 'medium' then 0.4 when 'strong' then 0.7 when 'very_strong' then 1.0 else 0.0 end::double end as weight
 from an where clear or not exists (select 1 from an where clear) qualify row_number() over (partition by event_id order by ratio desc, date, direction, scope, station_code) = 1)"""


def all_spikes(spark: Spark, d: str) -> DataFrame:
    """Daily and peak-hour spikes at anchors and impact stations, with confounding events."""
    known = impact.with_roles(events(spark, d), ((F.col("station_code") + 1) % 25).cast("int"))
    days, roll = impact.event_days(known), daily(spark, d)
    own = roll.join(days.select("station_code", "date").distinct(), ["station_code", "date"], "left_semi")
    whole = impact.spikes(days, roll, impact.baselines(own, roll, days, KEYS, "x", least=LEAST), KEYS, "x").withColumn("scope", F.lit("daily"))
    in_peak = impact.peak_sums(days.select("event_id", "role", "station_code", "date", "peak_hour_bins"), hourly(spark, d), peak(), KEYS, "x", LEAST).withColumn("scope", F.lit("peak_hours"))
    columns = ["event_id", "role", "station_code", "date", "direction", "scope", "ratio"]
    marked = impact.confounding(days.select("event_id", "station_code", "date").distinct()).select("event_id", "station_code", "date", "confounders")
    return whole.select(*columns).unionByName(in_peak.select(*columns)).join(marked, ["event_id", "station_code", "date"])


def verified(spark: Spark, d: str) -> DataFrame:
    return impact.verify(all_spikes(spark, d), events(spark, d).where("event_id % 11 = 0"), WEIGHT)


@query("I4_verified_strength", f"{VERIFIED} select event_id, station_code, direction, date, round(ratio, 9) as ratio, strength, excluded, weight, case scope when 'peak_hours' then 'peak_hours_only' else 'daily' end as apply_scope from ver")
def verified_strength(spark: Spark, d: str) -> DataFrame:
    return verified(spark, d).withColumn("ratio", F.round("ratio", 9))


#: Stations of exams in 1998 are treated, and those exams are what is estimated.
CTRL = f"""with {BASE}, te as (select * from ev where event_type = 'exam' and year(start_date) = 1998), scale as (select station_code, line_id, sum(passenger_count) / count(distinct date) as scale from rides group by 1, 2), treated as (select distinct station_code from te),
c as (select t.station_code, p.station_code as control, round(abs(ln(1 + t.scale) - ln(1 + p.scale)), 12) as distance from scale t join scale p on not (t.line_id = p.line_id and abs(t.station_code - p.station_code) <= 3)
 where t.station_code in (select station_code from treated) and p.station_code not in (select station_code from treated)), ctrl as (select *, row_number() over (partition by station_code order by distance, control) as rank from c qualify rank <= 5)"""


def treated_events(spark: Spark, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'exam' and year(start_date) = 1998")


def matched(spark: Spark, d: str) -> DataFrame:
    scale = rides(spark, d).groupBy("station_code", "line_id").agg((F.sum("passenger_count") / F.count_distinct("date")).alias("scale"))
    return impact.controls(scale, treated_events(spark, d).select("station_code").distinct())


@query("C12_matched_controls", f"{CTRL} select station_code, control, rank, round(distance, 9) as distance from ctrl")
def matched_controls(spark: Spark, d: str) -> DataFrame:
    return matched(spark, d).withColumn("distance", F.round("distance", 9))


def stats_sql(name: str, clean: str) -> str:
    """Baselines of `targets` from the rows of `clean`, under another name."""
    return STATS.format(least=1).replace("samples", f"samples_{name}").replace("stats", f"stats_{name}").replace("base as", f"base_{name} as").replace("join clean c", f"join {clean} c")


RATIOS = f"""targets as (select * from daily), clean_all as (select * from daily d where d.date not in (select date from busy)), {stats_sql("t", "clean")}, {stats_sql("c", "clean_all")},
rt as (select d.station_code, d.direction, d.date, x, base, x / nullif(base, 0) as ratio from daily d join base_t using (station_code, direction, date)), rc as (select d.station_code, d.direction, d.date, x / nullif(base, 0) as ratio from daily d join base_c using (station_code, direction, date)),
tdays as (select days.* from days join te using (event_id))"""


def both_ratios(spark: Spark, d: str, weeks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Days of the treated events; ratios at treated stations, whose own event days are no
    baseline; ratios at all stations without any station's event days in the baseline. Only
    dates of these events, and so many weeks before them, are worked out."""
    days, roll = impact.event_days(events(spark, d)), daily(spark, d)
    own = impact.event_days(treated_events(spark, d)).select("event_id", "station_code", "date")
    dates = own.select("date").distinct().withColumn("date", F.explode(F.transform(F.sequence(F.lit(0), F.lit(weeks)), lambda k: F.date_sub("date", 7 * k)))).distinct()
    targets = roll.join(dates, "date", "left_semi")
    mine = targets.join(own.select("station_code").distinct(), "station_code", "left_semi")
    first = impact.ratios(mine, impact.baselines(mine, roll, days, KEYS, "x", least=1), KEYS, "x")
    return own, first, impact.ratios(targets, impact.baselines(targets, roll, days, KEYS, "x", least=1, everywhere=True), KEYS, "x")


I5 = f"""{CTRL}, {RATIOS},
o as (select tdays.event_id, m.station_code, m.date, m.direction, m.ratio, m.x, m.base, median(k.ratio) as cr, count(*) as n_controls from tdays join rt m using (station_code, date) join ctrl on ctrl.station_code = m.station_code join rc k on k.station_code = ctrl.control and k.date = m.date and k.direction = m.direction group by all)
select event_id, station_code, date, direction, round(ratio, 9) as ratio, round(cr, 9) as control_ratio, n_controls, round(ratio - cr, 9) as did, round(ratio / nullif(cr, 0), 9) as normalised, round(x - base * cr, 6) as lift from o"""


@query("I5_difference_in_differences", I5)
def difference_in_differences(spark: Spark, d: str) -> DataFrame:
    days, mine, theirs = both_ratios(spark, d, 0)
    out = impact.did(days, mine, theirs, matched(spark, d))
    r = lambda c, n=9: F.round(c, n).alias(c)
    return out.select("event_id", "station_code", "date", "direction", r("ratio"), r("control_ratio"), "n_controls", r("did"), r("normalised"), r("lift", 6))


I6 = f"""{CTRL}, {RATIOS}, wk as (select unnest([7, 14, 21, 28]) as k), td as (select distinct station_code, date from tdays),
tp as (select td.station_code, td.date, rt.direction, avg(ratio) as pre from td cross join wk join rt on rt.station_code = td.station_code and rt.date = td.date - cast(k as integer) group by 1, 2, 3),
cp as (select td.station_code, ctrl.control, td.date, rc.direction, avg(ratio) as pre from td join ctrl using (station_code) cross join wk join rc on rc.station_code = ctrl.control and rc.date = td.date - cast(k as integer) group by 1, 2, 3, 4),
cm as (select station_code, date, direction, median(pre) as pre_control from cp group by 1, 2, 3)
select station_code, date, direction, round(pre, 9) as pre_ratio, round(pre_control, 9) as pre_control, round(abs(pre - pre_control), 9) as gap, abs(pre - pre_control) <= 0.15 as parallel_ok from tp left join cm using (station_code, date, direction)"""


@query("I6_pre_trend", I6)
def pre_trend(spark: Spark, d: str) -> DataFrame:
    days, mine, theirs = both_ratios(spark, d, 4)
    pairs = matched(spark, d)
    control_days = pairs.select("station_code", F.col("control")).join(days, "station_code").select(F.col("control").alias("station_code"), "date")
    out = impact.parallel(impact.pre_trends(days, mine), impact.pre_trends(control_days, theirs), pairs)
    r = lambda c, name: F.round(c, 9).alias(name)
    return out.select("station_code", "date", "direction", r("pre", "pre_ratio"), r("pre_control", "pre_control"), r("gap", "gap"), "parallel_ok")


I7 = f"""{VERIFIED}, e as (select ev.event_id, ev.station_code, start_date, end_date, cast(unnest(string_split(peak_hour_bins, ';')) as integer) as hour from ev)
select q.date, hour, e.station_code, round(max(1 + weight * (ratio - 1) * 0.3), 9) as multiplier, count(distinct e.event_id) as n_events from (select distinct date from rides) q join e on q.date between start_date and end_date join ver using (event_id) where weight > 0 group by 1, 2, 3"""


@query("I7_event_multiplier", I7)
def event_multiplier(spark: Spark, d: str) -> DataFrame:
    asked = rides(spark, d).select("date").distinct()
    weights = verified(spark, d).where("weight > 0").select("event_id", "ratio", "weight")
    days = impact.event_days(events(spark, d)).withColumn("hour", F.explode(peak()))
    active = days.join(asked, "date").join(weights, "event_id")
    return active.groupBy("date", "hour", "station_code").agg(F.round(F.max(1 + F.col("weight") * (F.col("ratio") - 1) * 0.3), 9).alias("multiplier"), F.count_distinct("event_id").alias("n_events"))


I8 = f"""with {EVENTS}, c as (select event_id, event_type, start_date, start_date + cast(event_id % 5 - 1 as integer) as end_date from ev), x as (select * from c where event_type = 'exam'), y as (select * from c where event_type <> 'exam')
select 'ends before start' as problem, event_id, start_date, null::varchar as others from c where start_date > end_date
union all select 'same day', y.event_id, y.start_date, string_agg(cast(x.event_id as varchar), ';' order by x.event_id) from y join x on x.start_date = y.start_date group by y.event_id, y.start_date"""


@query("I8_calendar_problems", I8)
def calendar(spark: Spark, d: str) -> DataFrame:
    """Two calendars, exams and all others, with windows of which some are wrong."""
    c = events(spark, d).select("event_id", "event_type", "start_date", F.date_add("start_date", (F.col("event_id") % 5 - 1).cast("int")).alias("end_date"))
    both = [c.where(w).drop("event_type") for w in ("event_type <> 'exam'", "event_type = 'exam'")]
    return impact.calendar_problems(*both)


I9 = f"{VERIFIED} select event_id, direction, round(max(ratio) filter (scope = 'daily'), 9) as daily, round(max(ratio) filter (scope = 'peak_hours'), 9) as peak_hours from sp group by 1, 2"


@query("I9_daily_and_peak", I9)
def daily_and_peak(spark: Spark, d: str) -> DataFrame:
    out = all_spikes(spark, d).groupBy("event_id", "direction").pivot("scope", ["daily", "peak_hours"]).agg(F.max("ratio"))
    return out.select("event_id", "direction", F.round("daily", 9).alias("daily"), F.round("peak_hours", 9).alias("peak_hours"))
