"""The folder that driver and executors share, for results of rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Folders written within the blocks of temporary() that are open.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a new temporary folder in local
    mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str = "round") -> DataFrame:
    """df written once and read back, so that its lineage ends and lost executors cost no more."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose rounds are deleted at its end, but for the results that it writes by the
    function it gets."""
    _open.append([])
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        out = written(df)
        kept.append(_open[-1].pop())
        return out

    try:
        yield keep
    finally:
        for path in _open.pop():
            _delete(spark, path)
        if _open:
            _open[-1].extend(kept)


def tidy(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """job, whose result is written and whose rounds are deleted when it returns."""

    @wraps(job)
    def run(rows: DataFrame, *args, **terms) -> DataFrame:
        with temporary(rows.sparkSession) as keep:
            return keep(job(rows, *args, **terms))

    return run


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def version(spark: SparkSession, path: str) -> tuple:
    """What tells a table from what is later written to the same path: its files' names,
    sizes and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def delete(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the folder of what written returned, once nothing will read it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, folder)
