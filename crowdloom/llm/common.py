"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word: a maximal run of characters other than ASCII space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where the session
    names none, a new temporary one in local mode, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Folders that settle has written and drop_settled has not deleted.
_written: list[str] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends here,
    and what follows survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled() -> list[str]:
    return list(_written)


def drop_settled(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that settle wrote, once nothing will read them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


#: Keys with more rows than HOT are joined by broadcast, if these are at most BROADCAST_KEYS.
HOT, BROADCAST_KEYS = 20_000, 1_000_000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left with right, which has one narrow row for each key and, in column count, the
    key's rows in left. Hot keys' rows of right are broadcast, so that no task gets all
    rows of such a key; the others are joined as Spark sees fit."""
    hot = settle(right.where(F.col(count) > HOT), "hot-keys")
    n_hot = hot.count()
    if not n_hot or n_hot > BROADCAST_KEYS:
        return left.join(right, key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(count) <= HOT), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def row_key(*columns: str) -> F.Column:
    """A 64-bit identity of a row by its content; rows that are alike share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns])


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(df: DataFrame) -> StructType:
    """df's schema with its columns named c0, c1, ...: whatever their names and types hold,
    also names inside structs that no schema text could spell."""
    return StructType([StructField(f"c{k}", f.dataType, True) for k, f in enumerate(df.schema)])


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about limit; a longer single item stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(texts: pa.Array, limit: int) -> Iterator[list[bytes]]:
    """The UTF-8 bytes of an Arrow column of texts (null: empty), about limit at a time."""
    sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, limit):
        yield [t or b"" for t in texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()]
    pa.default_memory_pool().release_unused()  # a worker goes on to other stages


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Polynomial prefix hashes of a byte buffer modulo 2**64.

    hash(start, end) is independent of where the bytes stand in the buffer, so equal
    substrings get equal hashes; different ones may collide, so callers verify.
    """

    BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, letters: np.ndarray | None = None):
        self._grow(len(data) + 1)
        table = byte_table() if letters is None else letters
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * PrefixHash._up[: len(data)], out=self.sums[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._up) < n:
            n = max(n, 2 * len(cls._up))
            steps = np.full(n, cls.BASE, np.uint64)
            steps[0] = 1
            cls._up = np.cumprod(steps)
            steps[1:] = pow(cls.BASE, -1, 1 << 64)
            cls._down = np.cumprod(steps)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * PrefixHash._down[start]


def byte_table(fold_case: bool = False) -> np.ndarray:
    """A pseudo-random 64-bit value for each byte; fold_case maps A-Z to a-z."""
    table = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    if fold_case:
        table[65:91] = table[97:123]
    return table
