"""Masters, marts, profiles and look-ups: reshaping, joins to dimensions, group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import perceived_multiplier
from ..sources.scratch import written
from .network import small
from .quantiles import exact_quantiles


def melt(wide: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Wide to long; null measures stay, one row each."""
    return wide.unpivot(ids, values, name, value)


def by_range(facts: DataFrame, ranges: DataFrame, code: str, flag: str) -> DataFrame:
    """Facts with the line that a table of code ranges (lo, hi, line) gives, and whether
    that corrects theirs; ranges is a rule table, broadcast where its count is small."""
    joined = facts.join(small(ranges.withColumnRenamed("line", "range_line")), F.col(code).between(F.col("lo"), F.col("hi")), "left").drop("lo", "hi")
    return joined.withColumn(flag, F.col("range_line").isNotNull().cast("int"))


def absent(seen: DataFrame, wanted: DataFrame, keys: list[str], period: str, periods: DataFrame | None = None) -> DataFrame:
    """keys of wanted and each period in which seen (keys, period) does not have them. Periods
    are few: one list of them goes to every row, so nothing is crossed but what comes out."""
    every = (seen.select(period) if periods is None else periods.select(period)).distinct().agg(F.collect_set(period).alias("__every"))
    own = seen.groupBy(*keys).agg(F.collect_set(period).alias("__own"))
    rows = wanted.select(*keys).distinct().join(own, keys, "left").join(F.broadcast(every), F.lit(True))
    left = F.filter("__every", lambda p: ~F.array_contains(F.coalesce("__own", F.array().cast(own.schema["__own"].dataType)), p))
    return rows.select(*keys, F.explode(left).alias(period))


def station_master(rides: DataFrame, keys: list[str], name: str, period: str, amount: str) -> DataFrame:
    """One pass over the fact: all names, the latest, first and last period, periods, total."""
    monthly = rides.groupBy(*keys, name, period).agg(F.sum(amount).alias("x"))
    return monthly.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set(name)), "|").alias("names"), F.max_by(name, F.struct(period, name)).alias("latest_name"), F.min(period).alias("first_period"),
        F.max(period).alias("last_period"), F.count_distinct(period).alias("n_periods"), F.sum("x").alias("total"),
    )


def shares(master: DataFrame, name: str, member: str, amount: str, periods: str, negligible: float = 0.01) -> DataFrame:
    """What share of its name's total a member has (four digits, 0 where the total is 0),
    whether anything is booked to it (none, negligible, ok), whether the name has several
    members, and whether it covers as many periods as any member of the table does."""
    groups = master.groupBy(name).agg(F.sum(amount).alias("name_total"), F.count_distinct(member).alias("n_members"))
    most = master.agg(F.max(periods).alias("most_periods"))
    share = F.when(F.col("name_total") > 0, F.round(F.col(amount) / F.col("name_total"), 4)).otherwise(0.0)
    return (
        master.join(groups, name)
        .join(F.broadcast(most))
        .withColumn("share_in_name", share)
        .withColumn("attribution_flag", F.when(F.col(amount) <= 0, "none").when(F.col("share_in_name") < negligible, "negligible").otherwise("ok"))
        .withColumn("is_transfer", (F.col("n_members") > 1).cast("int"))
        .withColumn("coverage_full", (F.col(periods) == F.col("most_periods")).cast("int"))
    )


def alias_master(raw: DataFrame, master: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Raw names that are not their station's canonical one: parenthetical where it is the
    latest raw name (so only its decoration is off), else renamed. master has keys,
    latest_name and canonical_name."""
    pairs = raw.select(*keys, name).dropDuplicates()
    kind = F.when(F.col(name) == F.col("latest_name"), "parenthetical").otherwise("renamed")
    return pairs.join(master.select(*keys, "latest_name", "canonical_name"), keys).where(F.col(name) != F.col("canonical_name")).select(*keys, F.col(name).alias("alias_name"), "canonical_name", kind.alias("alias_source"))


def display_master(nodes: DataFrame, memberships: dict[str, DataFrame]) -> DataFrame:
    """One row for each station_name of nodes (station_name, line_id, node): its lines, its
    nodes (those of the main line, without @, first), counts, and a flag for each list."""
    main_first = F.transform(F.array_sort(F.collect_set(F.struct(F.contains("node", F.lit("@")).alias("branch"), "node"))), lambda x: x["node"])
    out = nodes.groupBy("station_name").agg(F.array_join(F.array_sort(F.collect_set("line_id")), ";").alias("lines"), F.array_join(main_first, ";").alias("nodes"), F.count_distinct("line_id").alias("n_lines"), F.count_distinct("node").alias("n_nodes"))
    for flag, names in memberships.items():
        out = out.join(names.select("station_name").distinct().withColumn(flag, F.lit(True)), "station_name", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out


def transfer_aggregate(rows: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    """Median and least minutes, distinct patterns and branch mark of each transfer, with the
    median of the station's volumes over all files. rows: station_name, minutes, pattern, is_branch."""
    edges = rows.groupBy(*keys).agg(F.median("minutes").alias("median_min"), F.min("minutes").alias("least_min"), F.count_distinct("pattern").alias("patterns"), F.max(F.col("is_branch").cast("int")).alias("branch"))
    return edges.join(volumes.groupBy("station_name").agg(F.median("volume").alias("volume")), "station_name", "left")


def split_by_date(date: Column, train_to: str, valid_to: str) -> Column:
    return F.when(date <= F.lit(train_to).cast("date"), "train").when(date <= F.lit(valid_to).cast("date"), "valid").when(date.isNotNull(), "test").otherwise("train")


def with_group_quantile(rows: DataFrame, train: DataFrame, group: list[str], value: str, q: float, name: str) -> DataFrame:
    """rows with the training quantile of their group, or of the whole table where the
    group has none. The whole table's is found by passes of counts, so no task holds it."""
    known = train.where(F.col(value).isNotNull())
    # Written, so that its size is known and the rows are not shuffled to meet it.
    per_group = written(known.groupBy(*group).agg(F.percentile(value, q).alias("p_group")))
    overall = exact_quantiles(known, [], value, {"p_all": q})
    return rows.join(per_group, group, "left").join(F.broadcast(overall), F.lit(True), "left").withColumn(name, F.coalesce("p_group", "p_all")).drop("p_group", "p_all")


def cell_mart(cells: DataFrame, group: list[str], rate: str = "congestion_rate", q: float = 0.95, extreme: float = 100.0) -> DataFrame:
    """Cells with their group's training quantile (the whole table's where a group has
    none), high and extreme labels, operating flag and perceived multiplier."""
    return (
        with_group_quantile(cells, cells.where("split = 'train'"), group, rate, q, "threshold")
        .withColumn("is_operating", F.col(rate).isNotNull().cast("int"))
        .withColumn("label_high", F.when(F.col(rate).isNotNull(), (F.col(rate) > F.col("threshold")).cast("int")))
        .withColumn("label_extreme", F.when(F.col(rate).isNotNull(), (F.col(rate) >= extreme).cast("int")))
        .withColumn("perceived_multiplier", perceived_multiplier(F.col(rate)))
    )


def imputed(cells: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """cells with value or, where there is none, its group's median, else that of all."""
    groups = exact_quantiles(cells, group, value, {"gm": 0.5})
    overall = exact_quantiles(cells, [], value, {"am": 0.5})
    return cells.join(small(groups), group, "left").join(F.broadcast(overall), F.lit(True), "left").withColumn(name, F.coalesce(value, "gm", "am")).drop("gm", "am")


def profile(cells: DataFrame, keys: list[str], bin_col: str, rate: str, am: list[int], pm: list[int], crowded: float = 80.0) -> DataFrame:
    """Group statistics and the peak bin (the bin of the highest mean, the earlier on a tie).
    The bin means are a small pre-aggregate with the same partitioning."""
    stats = cells.groupBy(*keys).agg(
        F.avg(rate).alias("mean_rate"), F.median(rate).alias("median_rate"), F.max(rate).alias("max_rate"), F.percentile(rate, 0.95).alias("p95_rate"), F.count(rate).alias("n_cells"),
        F.avg(F.when(F.col(bin_col).isin(am), F.col(rate))).alias("am_peak_mean"), F.avg(F.when(F.col(bin_col).isin(pm), F.col(rate))).alias("pm_peak_mean"),
    )
    bins = cells.groupBy(*keys, bin_col).agg(F.avg(rate).alias("bin_mean"))
    peak = bins.groupBy(*keys).agg(
        F.max_by(F.struct(bin_col, "bin_mean"), F.when(F.col("bin_mean").isNotNull(), F.struct(F.round("bin_mean", 9), -F.col(bin_col)))).alias("peak"), (F.count(F.when(F.col("bin_mean") > crowded, 1)) * 30).alias("crowded_minutes")
    )
    return stats.join(peak, keys).select(*keys, *[c for c in stats.columns if c not in keys], F.col(f"peak.{bin_col}").alias("peak_bin"), F.col("peak.bin_mean").alias("peak_mean"), "crowded_minutes")


def lookup(cells: DataFrame, keys: list[str], rate: str, snapshot: str) -> DataFrame:
    """Median, 90th percentile, snapshots and multiplier of each edge cell."""
    return (
        cells.where(F.col(rate).isNotNull())
        .groupBy(*keys)
        .agg(F.median(rate).alias("congestion_median"), F.percentile(rate, 0.9).alias("congestion_p90"), F.count_distinct(snapshot).alias("n_snapshots"))
        .withColumn("perceived_multiplier", perceived_multiplier(F.col("congestion_median")))
    )


def exact_then_name(facts: DataFrame, dim: DataFrame, exact: list[str], by_name: list[str], value: str) -> DataFrame:
    """The exact key's value, else the largest value under the name key."""
    names = dim.groupBy(*by_name).agg(F.max(value).alias("by_name_value"))
    rest = dim.select(*exact, F.col(value).alias("exact_value")).dropDuplicates(exact)
    return facts.join(rest, exact, "left").join(names, by_name, "left").withColumn(value, F.coalesce("exact_value", "by_name_value")).withColumn("matched", F.when(F.col("exact_value").isNotNull(), "exact").when(F.col("by_name_value").isNotNull(), "name"))


def hold_out(units: DataFrame, unit: str, share: float, seed: str) -> DataFrame:
    """Marks the first share of the distinct units in the order of a seeded hash. Counts by
    the hash's first four digits give each bucket's place, so no task orders all units."""
    ranked = units.select(unit).distinct().withColumn("h", F.md5(F.concat(F.col(unit).cast("string"), F.lit(seed)))).withColumn("head", F.substring("h", 1, 4))
    everything = W.partitionBy(F.lit(0))
    places = ranked.groupBy("head").agg(F.count("*").alias("here")).select(
        "head", (F.sum("here").over(everything.orderBy("head")) - F.col("here")).alias("before"), F.floor(F.sum("here").over(everything) * F.lit(share)).alias("most")
    )
    place = F.col("before") + F.row_number().over(W.partitionBy("head").orderBy("h", unit))
    cut = ranked.join(F.broadcast(places.where("before < most")), "head").withColumn("place", place).where("place <= most").select(unit, F.lit(1).alias("held_out"))
    return units.join(cut, unit, "left").withColumn("held_out", F.coalesce("held_out", F.lit(0)))


def look_back(monthly: DataFrame, snapshots: DataFrame, keys: list[str], amount: str, days: int = 90) -> DataFrame:
    """Mean of monthly means over the months from snapshot - days to the snapshot's own.
    Each snapshot's few months are listed first, so the join is by equality."""
    months = snapshots.select("snapshot_date", F.explode(F.sequence(F.trunc(F.date_sub("snapshot_date", days), "MM"), F.trunc("snapshot_date", "MM"), F.expr("interval 1 month"))).alias("ym"))
    return monthly.join(months, "ym").groupBy("snapshot_date", *keys).agg(F.avg(amount).alias(amount), F.count_distinct("ym").alias("n_months"))


def monthly_mean(rides: DataFrame, keys: list[str], date: str, amount: str) -> DataFrame:
    """Sum over the month / days with a record: days are counted after a first sum by day."""
    daily = rides.groupBy(*keys, date).agg(F.sum(amount).alias("x"))
    return daily.groupBy(*keys, F.trunc(date, "MM").alias("ym")).agg((F.sum("x") / F.count("*")).alias(f"mean_{amount}"), F.count("*").alias("n_days"))


def average_rank(df: DataFrame, value: str, name: str, buckets: int = 256) -> DataFrame:
    """Average-tie rank as a fraction of the non-null rows: rows collapse to distinct values,
    counts run within value ranges and are offset by the ranges below."""
    values = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    cuts = values.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)]).alias("cuts"))
    placed = values.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    totals = placed.groupBy("range").agg(F.sum("ties").alias("here"))
    everything = W.partitionBy(F.lit(0))
    offsets = totals.select("range", (F.sum("here").over(everything.orderBy("range")) - F.col("here")).alias("lower"), F.sum("here").over(everything).alias("n"))
    below = F.col("lower") + F.sum("ties").over(W.partitionBy("range").orderBy(value)) - F.col("ties")
    ranked = placed.join(F.broadcast(offsets), "range").withColumn("below", below)
    rank = ranked.select(value, ((F.col("below") + 1 + (F.col("ties") - 1) / 2) / F.col("n")).alias(name))
    return df.join(rank, value, "left")


def describe(cells: DataFrame, keys: list[str], value: str, kind: str, kinds: list[str], others: list[str]) -> DataFrame:
    """Per group: rows of each kind, the value's null rate, count, mean, deviation, least,
    quartiles and most, and its correlation with other columns; one pass."""
    return cells.groupBy(*keys).agg(
        *[F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in kinds], F.avg(F.col(value).isNull().cast("int")).alias("null_rate"), F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("least"), *[F.percentile(value, q / 100).alias(f"p{q}") for q in (25, 50, 75)], F.max(value).alias("most"), *[F.corr(c, value).alias(f"corr_{c}") for c in others],
    )
