"""What events do to ridership: baselines, spikes, strength, matched controls.

Everything starts from the few event days, not from the fact: target days are exploded to
their lag days and joined by equality with the daily roll-up, which is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import strength
from ..sources.scratch import tidy, written


def event_days(events: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """One row for each day of each event's window."""
    return events.withColumn("date", F.explode(F.sequence(start, end)))


def baselines(targets: DataFrame, daily: DataFrame, busy: DataFrame, keys: list[str], value: str, weeks: int = 8, least: int = 4, everywhere: bool = False) -> DataFrame:
    """Median and MAD of the same weekday within +-weeks of each target (keys, date),
    without busy days (station, date; everywhere: on no station's busy date); targets with
    fewer than `least` days have none."""
    lags = F.array(*[F.lit(7 * k) for k in range(-weeks, weeks + 1) if k])
    wanted = targets.select(*keys, F.col("date").alias("target")).distinct().withColumn("date", F.explode(F.transform(lags, lambda k: F.date_add("target", k))))
    on = ["date"] if everywhere else ["station_code", "date"]
    clean = daily.join(busy.select(*on).distinct(), on, "left_anti")
    samples = wanted.join(clean, [*keys, "date"])
    stats = samples.groupBy(*keys, "target").agg(F.median(value).alias("base"), F.count("*").alias("n_samples")).where(F.col("n_samples") >= least)
    mad = samples.join(stats, [*keys, "target"]).groupBy(*keys, "target", "base", "n_samples").agg(F.median(F.abs(F.col(value) - F.col("base"))).alias("mad"))
    return mad.withColumnRenamed("target", "date")


def spikes(days: DataFrame, daily: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Actual over baseline and the robust z (null where the MAD is 0)."""
    return (
        days.join(daily, ["station_code", "date"])
        .join(base, [*keys, "date"])
        .withColumn("ratio", F.try_divide(F.col(value), F.nullif("base", F.lit(0.0))))
        .withColumn("robust_z", F.try_divide(F.col(value) - F.col("base"), 1.4826 * F.nullif("mad", F.lit(0.0))))
    )


def confounding(days: DataFrame) -> DataFrame:
    """Other events on an event's station-days, as a sorted list."""
    other = days.select("station_code", "date", F.col("event_id").alias("other"))
    found = days.join(other, ["station_code", "date"]).where("other <> event_id").groupBy("event_id", "station_code", "date").agg(F.array_join(F.sort_array(F.collect_set("other")).cast("array<string>"), ";").alias("confounders"))
    return days.join(found, ["event_id", "station_code", "date"], "left")


def with_roles(events: DataFrame, impact_station: Column) -> DataFrame:
    """Each event at its anchor and at its impact station."""
    return events.withColumn("role", F.lit("anchor")).unionByName(events.withColumn("station_code", impact_station).withColumn("role", F.lit("impact")))


def peak_sums(days: DataFrame, hourly: DataFrame, hours: Column, keys: list[str], value: str, least: int) -> DataFrame:
    """Sums of actual and baseline over an event's peak hours, for its days: hours without a
    row are skipped, a day with an hour that has no baseline goes whole."""
    present = days.withColumn("hour", F.explode(hours)).join(hourly, ["station_code", "date", "hour"])
    base = baselines(present, hourly, days, [*keys, "hour"], value, least=least).drop("mad")
    group = [c for c in days.columns if c != "peak_hour_bins"] + [k for k in keys if k not in days.columns]
    out = present.join(base, [*keys, "hour", "date"], "left").groupBy(*group).agg(F.sum(value).alias("actual"), F.sum("base").alias("base"), F.count("*").alias("n_hours"), F.bool_and(F.col("base").isNotNull()).alias("whole"))
    return out.where("whole").drop("whole").withColumn("ratio", F.try_divide("actual", F.nullif("base", F.lit(0.0))))


def verify(spike: DataFrame, excluded: DataFrame, weight: dict[str, float]) -> DataFrame:
    """An event's largest ratio at an anchor, over unconfounded rows (over all where the
    table has no unconfounded one), its class, the scope it was seen in, and the class's
    weight; excluded events (event_id) weigh 0."""
    anchors = spike.where("role = 'anchor' and ratio is not null").withColumn("clear", F.col("confounders").isNull())
    any_clear = anchors.agg(F.coalesce(F.bool_or("clear"), F.lit(False)).alias("any_clear"))
    order = F.struct((-F.col("ratio")).alias("least"), "date", "direction", "scope", "station_code")
    best = anchors.join(F.broadcast(any_clear)).where("clear or not any_clear").groupBy("event_id").agg(F.min_by(F.struct("station_code", "direction", "scope", "date", "ratio"), order).alias("b")).select("event_id", "b.*")
    table = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])
    out = best.withColumn("strength", strength(F.col("ratio"))).join(excluded.select("event_id").distinct().withColumn("excluded", F.lit(1)), "event_id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(0)))
    scope = F.when(F.col("scope") == "peak_hours", "peak_hours_only").otherwise("daily")
    return out.withColumn("weight", F.when(F.col("excluded") == 1, 0.0).otherwise(F.coalesce(F.try_element_at(table, F.col("strength")), F.lit(0.0)))).withColumn("apply_scope", scope).drop("scope")


def pre_trends(days: DataFrame, ratio: DataFrame, weeks: int = 4) -> DataFrame:
    """Mean ratio to its own baseline over the same weekday of the weeks before each day
    (station_code, date); ratio: station_code, direction, date, ratio."""
    before = days.select("station_code", F.col("date").alias("day")).distinct().withColumn("date", F.explode(F.transform(F.sequence(F.lit(1), F.lit(weeks)), lambda k: F.date_sub("day", 7 * k))))
    return before.join(ratio, ["station_code", "date"]).groupBy("station_code", F.col("day").alias("date"), "direction").agg(F.avg("ratio").alias("pre"))


def parallel(treated: DataFrame, controls_pre: DataFrame, pairs: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """The gap of a treated station's pre-trend to its controls' median, and whether it is
    within the tolerance: null where either is missing."""
    theirs = pairs.select("station_code", F.col("control")).join(controls_pre.withColumnRenamed("station_code", "control"), "control").groupBy("station_code", "date", "direction").agg(F.median("pre").alias("pre_control"))
    gap = F.abs(F.col("pre") - F.col("pre_control"))
    return treated.join(theirs, ["station_code", "date", "direction"], "left").withColumn("gap", gap).withColumn("parallel_ok", gap <= tolerance)


def calendar_problems(events: DataFrame, other: DataFrame) -> DataFrame:
    """(problem, event_id, start_date, others): windows that end before they start, and events
    that start on a day on which events of the other calendar start."""
    wrong = events.unionByName(other).where("start_date > end_date").select(F.lit("ends before start").alias("problem"), "event_id", "start_date", F.lit(None).cast("string").alias("others"))
    days = other.groupBy("start_date").agg(F.array_join(F.sort_array(F.collect_list("event_id")).cast("array<string>"), ";").alias("others"))
    return wrong.unionByName(events.join(days, "start_date").select(F.lit("same day").alias("problem"), "event_id", "start_date", "others"))


@tidy
def controls(scale: DataFrame, treated: DataFrame, most: int = 5, gap: int = 3, buckets: int = 64) -> DataFrame:
    """The units nearest in log scale to each treated one, not treated themselves and not
    within `gap` codes on the same line. All units stand in one order of scale, numbered by
    ranges; a treated one looks only at the places next to its own: on either side as many as
    its line can exclude and `most` more, below twice as many, since there the least codes of
    a scale come last. scale: line_id, station_code, scale; codes are whole
    numbers, once on a line. Of one scale the least codes go first."""
    reach = most + 2 * gap + 1
    marked = scale.where("scale is not null").join(treated.select("station_code").distinct().withColumn("is_treated", F.lit(True)), "station_code", "left").withColumn("is_treated", F.coalesce("is_treated", F.lit(False))).withColumn("x", F.log1p("scale"))
    # Of the controls of one scale only the first can be among anybody's nearest.
    pool = marked.where("not is_treated").withColumn("n", F.row_number().over(W.partitionBy("x").orderBy("station_code", "line_id"))).where(F.col("n") <= reach).drop("n")
    both = written(pool.unionByName(marked.where("is_treated")))
    cuts = both.agg(F.percentile_approx("x", [k / buckets for k in range(1, buckets)]).alias("cuts"))
    placed = both.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    per = placed.groupBy("range").agg(F.count(F.when(~F.col("is_treated"), 1)).alias("n"))
    before = per.select("range", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = W.partitionBy("range").orderBy("x", F.desc("is_treated"), "station_code", "line_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = written(placed.join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.coalesce(F.sum((~F.col("is_treated")).cast("long")).over(order), F.lit(0))))
    t = numbered.where("is_treated").select("line_id", "station_code", "x", F.explode(F.sequence(F.col("place") - 2 * reach + 1, F.col("place") + reach)).alias("place"))
    c = numbered.where("not is_treated").select("place", F.col("station_code").alias("control"), F.col("line_id").alias("c_line"), F.col("x").alias("c_x"))
    far = ~((F.col("line_id") == F.col("c_line")) & (F.abs(F.col("station_code") - F.col("control")) <= gap))
    near = t.join(c, "place").where(far).withColumn("distance", F.round(F.abs(F.col("x") - F.col("c_x")), 12))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("station_code").orderBy("distance", "control")))
    return ranked.where(F.col("rank") <= most).select("station_code", "control", "rank", "distance")


def did(days: DataFrame, treated_ratio: DataFrame, control_ratio: DataFrame, pairs: DataFrame) -> DataFrame:
    """Treated ratio against the controls' median ratio on the same day and direction. Both
    ratios: station_code, direction, date, actual, base, ratio."""
    mine = days.select("event_id", "station_code", "date").join(treated_ratio, ["station_code", "date"])
    theirs = control_ratio.select(F.col("station_code").alias("control"), "direction", "date", F.col("ratio").alias("c_ratio"))
    both = mine.join(pairs.select("station_code", "control"), "station_code").join(theirs, ["control", "date", "direction"])
    out = both.groupBy("event_id", "station_code", "date", "direction", "ratio", "actual", "base").agg(F.median("c_ratio").alias("control_ratio"), F.count("*").alias("n_controls"))
    return out.withColumn("did", F.col("ratio") - F.col("control_ratio")).withColumn("normalised", F.try_divide("ratio", F.nullif("control_ratio", F.lit(0.0)))).withColumn("lift", F.col("actual") - F.col("base") * F.col("control_ratio"))


def ratios(daily: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    return daily.join(base, [*keys, "date"]).select(*keys, "date", F.col(value).alias("actual"), "base", F.try_divide(F.col(value), F.nullif("base", F.lit(0.0))).alias("ratio"))
