"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources in code point order, null last, get the repeating weights' share of
`share` times all words; no target exceeds `cap` times its source's words, and what that
leaves is shared again by weight among the others (water filling, solved in one pass over
the table of sources, which has one row for each source).

Selection (Efraimidis and Spirakis): a document's key is -ln(u)/w, u a hash of the row and
w its quality weight, so ascending keys are a weighted draw without replacement. A source
first takes every document for each complete epoch in its target; the fraction that is left
takes documents in key order until their prefix sum reaches the budget. The place where it
does is found by radix descent: three small histograms of key digits narrow it to a
2**-21 part of a source, and only that part is ordered. No source is ever sorted or
gathered whole, so a source with a third of all rows costs no more than its share.

Defined results: null text has size 0 and takes 0 words; a null source is a source, the
last; null ids are kept; rows alike in id, source and text share a key, and as many of them
are taken as come nearest to the budget; a source
without words has target 0; an empty table gives no rows; extra columns of any name are
carried untouched (a row travels as one struct, all working columns begin with __mix_).
The document at the budget's edge is taken if that brings the sum nearer to it.

The default quality weight falls smoothly with the marks and digits a word has on average,
and is least where the mean word length is odd; any other column may be given instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, read_documents, row_key, settle

#: Quality weights are held to this range, which bounds how unevenly keys fall.
LEAST_WEIGHT, MOST_WEIGHT = 0.25, 4.0
DIGIT_BITS, LEVELS = 7, 3
#: Broadcast of the table of sources only up to so many sources.
BROADCAST_SOURCES = 50_000


def quality_weight() -> Column:
    """MOST_WEIGHT for plain words, falling by half for every eighth of a mark or digit
    that a word has on average; the least weight for an odd mean word length."""
    words = F.nullif(F.col("__mix_size"), F.lit(0))
    marks = F.regexp_count("text", F.lit(r"[0-9#*$%&|<>{}=_\\/+~^@\[\]]")) / words
    return F.when((F.length("text") / words).between(3, 12), MOST_WEIGHT * F.pow(F.lit(0.5), 8 * marks)).otherwise(LEAST_WEIGHT)


def with_keys(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """Each row (as one struct, __mix_row), doc_id, source, and its size, source identity,
    selection key and that key's digits."""
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce(quality_weight() if quality is None else F.col("__mix_quality"), F.lit(LEAST_WEIGHT))))
    u = (F.shiftrightunsigned(F.xxhash64(row_key("doc_id", "source", "text"), F.lit(20)), 11) + 0.5) / float(1 << 53)
    spread = (1 - F.exp(-F.col("__mix_key") * LEAST_WEIGHT)) * float(1 << DIGIT_BITS * LEVELS)
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row"), "doc_id", "source", "text", (F.lit(None) if quality is None else quality).cast("double").alias("__mix_quality"))
        .withColumn("__mix_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("__mix_null", F.col("source").isNull())
        .withColumn("__mix_source", F.coalesce("source", F.lit("")))
        .withColumn("__mix_key", -F.log(u) / weight)
        .withColumn("__mix_code", F.least(F.floor(spread), F.lit((1 << DIGIT_BITS * LEVELS) - 1)).cast("int"))
        .drop("text", "__mix_quality")
    )


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each source: its words, target, complete epochs and the words that
    the fraction beyond them may take."""
    sources = sized.groupBy("__mix_null", "__mix_source").agg(F.sum("__mix_size").alias("__mix_source_size"))
    everything = W.partitionBy(F.lit(0))
    ranked = sources.withColumn("__mix_rank", F.row_number().over(everything.orderBy("__mix_null", "__mix_source"))).withColumn(
        "__mix_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("__mix_rank") - 1, F.lit(len(weights))) + 1)
    )
    order = everything.orderBy("__mix_ratio", "__mix_rank")
    level = F.try_divide(F.sum("__mix_source_size").over(everything) * share - F.col("__mix_capped"), F.col("__mix_open_weight"))
    return (
        ranked.withColumn("__mix_limit", F.col("__mix_source_size") * cap)
        .withColumn("__mix_ratio", F.col("__mix_limit") / F.col("__mix_weight"))
        .withColumn("__mix_capped", F.coalesce(F.sum("__mix_limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__mix_open_weight", F.sum("__mix_weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("__mix_level", level)
        .withColumn("__mix_water", F.min(F.when(F.col("__mix_level") <= F.col("__mix_ratio"), F.struct("__mix_ratio", "__mix_rank", "__mix_level"))).over(everything)["__mix_level"])
        .withColumn("__mix_target", F.least(F.col("__mix_limit"), F.coalesce(F.col("__mix_water") * F.col("__mix_weight"), F.col("__mix_limit"))))
        .withColumn("__mix_epochs", F.coalesce(F.floor(F.try_divide(F.col("__mix_target"), F.col("__mix_source_size"))), F.lit(0)))
        .withColumn("__mix_budget", F.col("__mix_target") - F.col("__mix_epochs") * F.col("__mix_source_size"))
        .select("__mix_null", "__mix_source", "__mix_source_size", "__mix_target", "__mix_epochs", "__mix_budget")
    )


def _with_sources(rows: DataFrame, table: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(table) if small else table, ["__mix_null", "__mix_source"], how)


def draw_limits(sized: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """targets with the last key (and id) that each source's fraction takes."""
    keys = ["__mix_null", "__mix_source"]
    by_source = W.partitionBy(*keys)
    at = targets.where("__mix_budget > 0").select(*keys, F.col("__mix_budget").alias("__mix_left"), F.lit(0).alias("__mix_prefix"))
    for level in range(LEVELS):
        shift = DIGIT_BITS * (LEVELS - level - 1)
        within = F.shiftright("__mix_code", shift + DIGIT_BITS) == F.col("__mix_prefix")
        counts = _with_sources(sized, at, small).where(within).groupBy(*keys, "__mix_left", F.shiftright("__mix_code", shift).alias("__mix_next")).agg(F.sum("__mix_size").alias("__mix_words"))
        summed = counts.withColumn("__mix_upto", F.sum("__mix_words").over(by_source.orderBy("__mix_next")))
        at = (
            summed.where(F.col("__mix_upto") >= F.col("__mix_left"))
            .groupBy(*keys)
            .agg(F.min_by(F.struct((F.col("__mix_left") - F.col("__mix_upto") + F.col("__mix_words")).alias("__mix_left"), F.col("__mix_next").alias("__mix_prefix")), "__mix_next").alias("x"))
            .select(*keys, "x.__mix_left", "x.__mix_prefix")
        )
    edge = _with_sources(sized, at, small).where(F.col("__mix_code") == F.col("__mix_prefix"))
    # Alike rows count as one group; of the group that the budget cuts the nearest number goes.
    groups = edge.groupBy(*keys, "__mix_left", "__mix_key", "doc_id").agg(F.sum("__mix_size").alias("__mix_words"), F.max("__mix_size").alias("__mix_size"), F.count("*").alias("__mix_tie_rows"))
    groups = groups.withColumn("__mix_upto", F.sum("__mix_words").over(by_source.orderBy("__mix_key", "doc_id"))).withColumn("__mix_room", F.col("__mix_left") - F.col("__mix_upto") + F.col("__mix_words"))
    part = F.floor(F.try_divide("__mix_room", "__mix_size") + 0.5)
    groups = groups.withColumn("__mix_tie_take", F.when(F.col("__mix_upto") <= F.col("__mix_left"), F.col("__mix_tie_rows")).otherwise(F.least(F.greatest(part, F.lit(0)), "__mix_tie_rows")))
    last = groups.where("__mix_room >= 0 and __mix_tie_take > 0").groupBy(*keys).agg(F.max(F.struct("__mix_key", "doc_id", "__mix_tie_rows", "__mix_tie_take")).alias("x"))
    last = last.select(*keys, F.struct("x.__mix_key", "x.doc_id").alias("__mix_last"), "x.__mix_tie_rows", "x.__mix_tie_take")
    return targets.join(at.select(*keys, "__mix_prefix"), keys, "left").join(last, keys, "left")


def _ordinals(rows: DataFrame) -> DataFrame:
    """rows with __mix_ordinal from 1 within each source; no task gets more of a source's rows
    than one task of the written rows has."""
    keys, part = ["__mix_null", "__mix_source"], "__mix_part"
    rows = settle(rows.withColumn(part, F.spark_partition_id()), "mix-ties")
    before = rows.groupBy(*keys, part).count().withColumn("__mix_before", F.coalesce(F.sum("count").over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(W.partitionBy(*keys, part).orderBy(F.lit(0)))
    return rows.withColumn("__mix_within", within).join(before, [*keys, part]).withColumn("__mix_ordinal", F.col("__mix_before") + F.col("__mix_within")).drop(part, "__mix_within", "__mix_before")


def with_takes(keyed: DataFrame, limits: DataFrame, small: bool) -> DataFrame:
    """Adds __mix_copies (times the mix takes the row whole) and its source's figures. Where a
    source's last key is of alike rows of which only some go, these are numbered."""
    here = F.struct("__mix_key", "doc_id")
    rows = _with_sources(keyed, limits, small)
    inside = F.col("__mix_code") == F.col("__mix_prefix")
    tie = F.coalesce(inside & here.eqNullSafe(F.col("__mix_last")) & (F.col("__mix_tie_take") < F.col("__mix_tie_rows")), F.lit(False))
    drawn = F.coalesce((F.col("__mix_code") < F.col("__mix_prefix")) | (inside & (here <= F.col("__mix_last"))), F.lit(False))
    if limits.where("__mix_tie_take < __mix_tie_rows").isEmpty():
        return rows.withColumn("__mix_copies", F.col("__mix_epochs") + drawn.cast("long"))
    cut = _ordinals(rows.where(tie)).withColumn("__mix_copies", F.col("__mix_epochs") + (F.col("__mix_ordinal") <= F.col("__mix_tie_take")).cast("long")).drop("__mix_ordinal")
    return rows.where(~tie).withColumn("__mix_copies", F.col("__mix_epochs") + drawn.cast("long")).unionByName(cut)


def plan_mix(keyed: DataFrame, **terms: object) -> tuple[DataFrame, DataFrame, bool]:
    """The rows' keys written once, each source's limits, and whether these are few."""
    sized = settle(keyed.select("doc_id", "source", *[c for c in keyed.columns if c.startswith("__mix_") and c != "__mix_row"]), "mix-sizes")
    targets = settle(source_targets(sized, **terms), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    return sized, settle(draw_limits(sized, targets, small), "mix-limits"), small


def mix(docs: DataFrame, quality: Column | None = None, **terms: object) -> DataFrame:
    """The mix itself: rows of docs as often as it takes them, in docs' columns."""
    keyed = with_keys(docs, quality)
    _, limits, small = plan_mix(keyed, **terms)
    return with_takes(keyed, limits, small).where("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__mix_copies"))).select("__mix_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, limits, small = plan_mix(with_keys(read_documents(spark, sf_dir).select("doc_id", "source", "text")))
    own = [F.col(f"__mix_{n}").alias(n) for n in ("size", "source_size", "target", "epochs")]
    return with_takes(sized, limits, small).select("doc_id", *own[:3], (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"), "source", own[3])


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLES: dict[str, str] = {}
