"""Reading folders of drifting CSV files: charsets, dates in names, header aliases."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_dir

#: Charset of files that are not valid UTF-8, unless the caller names another.
FALLBACK = "MS949"


def allow_java_charsets(spark: SparkSession) -> None:
    """Lets this session read charsets beyond Spark's short list (a legacy switch)."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def charset_groups(spark: SparkSession, path: str, fallback: str = FALLBACK) -> dict[str, list[str]]:
    """Charset -> files under path: UTF-8 (with or without a byte order mark) where every
    line of a file is valid, else the fallback. Lines are checked in tasks; only the names
    of the files come to the driver, which lists them anyway."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (~F.is_valid_utf8("value")).alias("bad"))
    out: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.bool_or("bad").alias("bad")).orderBy("file").collect():
        out.setdefault(fallback if r["bad"] else "UTF-8", []).append(r["file"])
    return out


def read_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", **options: str) -> DataFrame:
    """One charset group, with each row's file name. Korean charsets need allow_java_charsets."""
    df = spark.read.csv(path, header=True, encoding=encoding, **options)
    return df.select("*", F.col("_metadata.file_name").alias("source_file"))


def read_folder(spark: SparkSession, path: str, fallback: str = FALLBACK, **options: str) -> DataFrame:
    """All CSV files under path, each group in its own charset; columns missing in one
    group are null."""
    frames = [read_csv(spark, names, encoding, **options) for encoding, names in sorted(charset_groups(spark, path, fallback).items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder inside the folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_mart(df: DataFrame, path: str, partitions: list[str], kind: str = "parquet") -> None:
    """A mart by partition columns, as Parquet or as csv (gzip, with headers). Rows of a
    partition are brought together first, a large one in several files. Written again, the
    partitions that df has are replaced and all others stay as they are."""
    writer = df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    if kind == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    else:
        writer.parquet(path)


def read_mart(spark: SparkSession, path: str, columns: list[str], allowed: dict[str, list], csv_schema: str | None = None) -> DataFrame:
    """Chosen columns and values: partition columns prune folders, others are pushed down.
    csv_schema: the columns of a csv mart, partition columns last."""
    df = spark.read.schema(csv_schema).option("header", True).csv(path) if csv_schema else spark.read.parquet(path)
    for column, values in allowed.items():
        df = df.where(F.col(column).isin(*values))
    return df.select(*columns)


def name_version(file: Column) -> Column:
    """The date in a file name as yyyymmdd; six digits are yymmdd of this century."""
    eight, six = F.regexp_extract(file, r"(?<!\d)((?:19|20)\d{6})(?!\d)", 1), F.regexp_extract(file, r"(?<!\d)(\d{6})(?!\d)", 1)
    return F.when(eight != "", eight).when(six != "", F.when(six.startswith("20"), F.concat(six, F.lit("01"))).otherwise(F.concat(F.lit("20"), six)))


def newest(df: DataFrame, keys: list[str], file: str = "source_file") -> DataFrame:
    """Rows of each key's newest file by the date in its name."""
    best = df.groupBy(*keys).agg(F.max_by(file, name_version(F.col(file))).alias("newest_file"))
    return df.join(F.broadcast(best) if not keys else best, keys).where(F.col(file) == F.col("newest_file")).drop("newest_file")


def harmonise(df: DataFrame, aliases: dict[str, str], required: list[str], drop: list[str] = ()) -> DataFrame:
    """Aliased headers renamed, repeated columns dropped, required ones asserted."""
    out = df.drop(*drop).withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns})
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return out


def layout(columns: list[str]) -> str:
    """A: a sequence column and typed minutes; B: typed minutes; C: clock ranges."""
    if any("~" in c for c in columns):
        return "C"
    return "A" if columns and columns[0] in ("seq", "연번") else "B"
