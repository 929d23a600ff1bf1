"""Group-mean baselines and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import written


def group_mean(train: DataFrame, keys: list[str], target: str, name: str) -> DataFrame:
    return train.groupBy(*keys).agg(F.avg(target).alias(name))


def ladder(train: DataFrame, rows: DataFrame, levels: dict[str, list[str]], target: str) -> DataFrame:
    """rows with one prediction column for each level: the training mean of its keys."""
    out = rows
    for name, keys in levels.items():
        if keys:
            out = out.join(group_mean(train, keys, target, name), keys, "left")
        else:
            out = out.join(F.broadcast(train.agg(F.avg(target).alias(name))))
    return out


def latest_else_mean(train: DataFrame, rows: DataFrame, keys: list[str], snapshot: str, target: str, name: str) -> DataFrame:
    """The mean of the latest snapshot that has the key, else the key's overall mean."""
    by = train.groupBy(*keys, snapshot).agg(F.avg(target).alias("m"))
    latest = by.where("m is not null").groupBy(*keys).agg(F.max_by("m", snapshot).alias("latest"))
    return rows.join(latest, keys, "left").join(group_mean(train, keys, target, "mean"), keys, "left").withColumn(name, F.coalesce("latest", "mean")).drop("latest", "mean")


def metrics(y: Column, p: Column) -> list[Column]:
    """MAE, RMSE, R2 and coverage; rows without a prediction count for coverage only."""
    both = y.isNotNull() & p.isNotNull()
    e, yy = F.when(both, p - y), F.when(both, y)
    n = F.count(e)
    total = F.sum(yy * yy) - n * F.avg(yy) * F.avg(yy)
    return [
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), total)).alias("r2"),
        F.avg(F.when(y.isNotNull(), p.isNotNull().cast("int"))).alias("coverage"),
    ]


def precision_recall(hit: Column, said: Column) -> list[Column]:
    tp, fp, fn = F.count(F.when(hit & said, 1)), F.count(F.when(~hit & said, 1)), F.count(F.when(hit & ~said, 1))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def average_precision(rows: DataFrame, score: str, hit: str, buckets: int = 64) -> DataFrame:
    """Average precision and the most recall at precision >= 0.5, tied scores as one
    threshold. Rows collapse to distinct scores first; running sums are taken within score
    ranges and offset by the ranges before, so no task orders all scores."""
    scores = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(hit).cast("long")).alias("pos"), F.count("*").alias("n"))
    cuts = scores.agg(F.percentile_approx(score, [k / buckets for k in range(1, buckets)]).alias("cuts"))
    placed = scores.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(score)))).drop("cuts")
    totals = placed.groupBy("range").agg(F.sum("pos").alias("r_pos"), F.sum("n").alias("r_n"))
    above = W.partitionBy(F.lit(0)).orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    everything = F.sum("r_pos").over(W.partitionBy(F.lit(0)))
    offsets = totals.select("range", F.coalesce(F.sum("r_pos").over(above), F.lit(0)).alias("o_pos"), F.coalesce(F.sum("r_n").over(above), F.lit(0)).alias("o_n"), everything.alias("all_pos"))
    order = W.partitionBy("range").orderBy(F.desc(score))
    curve = placed.join(F.broadcast(offsets), "range").withColumn("tp", F.col("o_pos") + F.sum("pos").over(order)).withColumn("said", F.col("o_n") + F.sum("n").over(order))
    precision, gained = F.col("tp") / F.col("said"), F.try_divide("pos", "all_pos")
    return curve.agg(F.sum(gained * precision).alias("average_precision"), F.max(F.when(precision >= 0.5, F.try_divide("tp", "all_pos"))).alias("recall_at_half"))


def trained_sets(rows: DataFrame, sets: dict[str, list[str]], texts: tuple[str, ...] | list[str] = (), trees: int = 5, depth: int = 3, seed: int = 7) -> DataFrame:
    """Boosted trees for each named set of features: a row for each set and feature with its
    importance and rank, and the set's errors and precision-recall figures on validation rows.
    rows: split (train, valid), the features, label, high (whether the label counts as high).
    Texts are indexed and all features put into one vector once; a set is a slice of it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorSlicer
    from pyspark.ml.regression import GBTRegressor

    every = list(dict.fromkeys(f for features in sets.values() for f in features))
    indexed = [f"{f}__ix" if f in texts else f for f in every]
    stages = [StringIndexer(inputCol=f, outputCol=f"{f}__ix", handleInvalid="keep", stringOrderType="alphabetAsc") for f in every if f in texts]
    prepared = Pipeline(stages=[*stages, VectorAssembler(inputCols=indexed, outputCol="__all")]).fit(rows.where("split = 'train'")).transform(rows)
    prepared = written(prepared.select("split", "label", "high", "__all"))
    train, valid = prepared.where("split = 'train'"), prepared.where("split = 'valid'")
    out = None
    for name, features in sets.items():
        slicer = VectorSlicer(inputCol="__all", outputCol="features", indices=[every.index(f) for f in features])
        model = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed).fit(slicer.transform(train))
        said = model.transform(slicer.transform(valid)).select("label", "high", "prediction")
        figures = said.agg(*metrics(F.col("label"), F.col("prediction"))).join(F.broadcast(average_precision(said, "prediction", "high")), F.lit(True))
        order = sorted(zip(features, (float(x) for x in model.featureImportances.toArray()), strict=True), key=lambda p: (-p[1], p[0]))
        ranks = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(x).alias("importance"), F.lit(k).alias("importance_rank")) for k, (f, x) in enumerate(order, 1)])
        one = figures.select(F.lit(name).alias("features"), F.explode(ranks).alias("r"), "mae", "rmse", "r2", "average_precision", "recall_at_half").select("features", "r.*", "mae", "rmse", "r2", "average_precision", "recall_at_half")
        out = one if out is None else out.unionByName(one)
    return out
