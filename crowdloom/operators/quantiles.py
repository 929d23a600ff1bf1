"""Exact quantiles of groups of any size.

No task ever holds a group: the values between the known bounds of an order statistic are
counted in equal cells, the cell with the wanted rank gives new bounds, and so on until one
value is left or so few rows that ordering them is cheap. A pass is one aggregate with
partial sums over the rows; two passes are usual.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import tidy, written
from .network import small

CELLS, FEW = 4096, 4096


@tidy
def exact_quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], cells: int = CELLS, few: int = FEW) -> DataFrame:
    """keys and a column for each of wanted: the quantile between the two nearest values, as
    percentile has it. Nulls and NaN do not count; a group without values has no row."""
    one = ["__group"] if not keys else keys
    data = rows.select(*([F.lit(0).alias("__group")] if not keys else keys), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    groups = written(data.groupBy(*one).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(q))).alias("place")) for name, q in wanted.items()])).alias("q")
    each = groups.select(*one, "n", "lo", "hi", named).select("*", F.floor("q.place").alias("a"), F.ceil("q.place").alias("b"))
    places = each.select(*one, "q.name", "a", "b", (F.col("q.place") - F.col("a")).alias("part"))
    # Where each wanted rank lies: between lo and hi, with so many values below lo.
    state = written(each.select(*one, F.explode(F.array("a", "b")).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).distinct())
    null_safe = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in one]
    for _ in range(1100 // int(math.log2(cells))):  # more than doubles can be halved
        open_ranks = state.where(f"lo < hi and inside > {few}")
        if open_ranks.isEmpty():
            break
        spans = open_ranks.select(*one, "lo", "hi").distinct()
        at = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.0)) * cells), F.lit(cells - 1))
        within = data.alias("d").join(small(spans).alias("s"), [*null_safe("d", "s"), F.col("v").between(F.col("lo"), F.col("hi"))]).select(*[F.col(f"s.{k}").alias(k) for k in one], "v", "lo", "hi", at.alias("cell"))
        counted = within.groupBy(*one, "lo", "hi", "cell").agg(F.count("*").alias("n"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        upto = counted.withColumn("upto", F.sum("n").over(W.partitionBy(*one, "lo", "hi").orderBy("cell")))
        same = [*null_safe("o", "u"), F.col("o.lo") == F.col("u.lo"), F.col("o.hi") == F.col("u.hi"), F.col("rank") - F.col("below") < F.col("upto"), F.col("rank") - F.col("below") >= F.col("upto") - F.col("n")]
        nearer = open_ranks.alias("o").join(upto.alias("u"), same).select(*[F.col(f"o.{k}").alias(k) for k in one], "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("inside"))
        state = written(state.where(f"lo = hi or inside <= {few}").unionByName(nearer))
    settled, rest = state.where("lo = hi").select(*one, "rank", F.col("lo").alias("x")), state.where("lo < hi")
    spans = rest.select(*one, "lo", "hi").distinct()
    last = data.alias("d").join(small(spans).alias("s"), [*null_safe("d", "s"), F.col("v").between(F.col("lo"), F.col("hi"))]).select(*[F.col(f"s.{k}").alias(k) for k in one], "v", "lo", "hi")
    last = last.withColumn("at", F.row_number().over(W.partitionBy(*one, "lo", "hi").orderBy("v")) - 1)
    found = rest.alias("r").join(last.alias("l"), [*null_safe("r", "l"), F.col("r.lo") == F.col("l.lo"), F.col("r.hi") == F.col("l.hi"), F.col("rank") - F.col("below") == F.col("at")]).select(*[F.col(f"r.{k}").alias(k) for k in one], "rank", F.col("v").alias("x"))
    values = written(settled.unionByName(found))
    low = places.alias("p").join(values.alias("a"), [*null_safe("p", "a"), F.col("p.a") == F.col("a.rank")]).select(*[F.col(f"p.{k}").alias(k) for k in one], "name", "b", "part", F.col("x").alias("x_low"))
    both = low.alias("p").join(values.alias("b"), [*null_safe("p", "b"), F.col("p.b") == F.col("b.rank")]).select(*[F.col(f"p.{k}").alias(k) for k in one], "name", F.when(F.col("part") == 0, F.col("x_low")).otherwise((1 - F.col("part")) * F.col("x_low") + F.col("part") * F.col("x")).alias("x"))
    out = both.groupBy(*one).agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in wanted])
    return out if keys else out.drop("__group")
