"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become token pieces; pieces are dealt to packing groups by a hash, and each
group is packed online with a fixed number of open bins kept in a bitset keyed by free
space: a piece goes to the fullest open bin that takes it, and when no bin takes it and
all are in use, the fullest closes. Groups are sized by tokens, so more input means more
groups, and what one task holds is the open bins alone.

Defined results: a null or empty text is the single end token; a null document id stays
null; repeated rows are packed as often as they occur; an empty table gives no rows; only
the id and text columns are read, so other columns of any name do no harm; a piece as
long as the capacity is a sequence by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import read_documents, settle
from .tokens import public_path
from .tokens import tokenizer as tokenizer_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each piece of at most capacity tokens; with_ids adds the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(tokenizer)
        for batch in batches:
            out, ids_out = [], []
            for row, ids in enumerate(tok.documents(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((row, k, at, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            rows = np.array(out, np.int64).reshape(-1, 5)
            made = [batch.column(0).take(pa.array(rows[:, 0])).cast(pa.int64()), pa.array(rows[:, 1].astype(np.int32)), *(pa.array(rows[:, k]) for k in (2, 3, 4))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                made.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(made, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


class OpenBins:
    """A fixed number of open bins: bit f of a set is on while a bin with f free exists."""

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.next = capacity, most, first
        self.free_set, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        k = bins.pop()
        if not bins:
            self.free_set ^= 1 << free
        self.open -= 1
        return k

    def _keep(self, k: int, free: int) -> None:
        if free:
            if not self.by_free[free]:
                self.free_set |= 1 << free
            self.by_free[free].append(k)
            self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """The bin that gets the piece, and where in it."""
        fits = self.free_set >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            k = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.free_set & -self.free_set).bit_length() - 1)
            k, free, self.next = self.next, self.capacity, self.next + 1
        self._keep(k, free - length)
        return k, self.capacity - free


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 2048, group_sequences: int = 16384) -> DataFrame:
    """Adds sequence_id and offset to pieces (length at most capacity each). A packing
    group holds about group_sequences sequences' worth of tokens; its number is the upper
    half of sequence_id."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (capacity * group_sequences)))
    schema = StructType(pieces.schema.fields).add("sequence_id", LongType()).add("offset", LongType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for batch in batches:
            seq, off = [], []
            for g, n in zip(batch.column("pack_group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, bins = g, OpenBins(capacity, open_bins, g << 32)
                k, at = bins.place(n)
                seq.append(k)
                off.append(at)
            kept = batch.drop_columns(["pack_group", "pack_order"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*kept.schema.names, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    return (
        pieces.withColumn("pack_group", F.pmod(order, F.lit(groups)).cast("long"))
        .withColumn("pack_order", F.xxhash64(order, F.lit(7)))
        .repartition(groups, "pack_group")
        .sortWithinPartitions("pack_group", "pack_order", "doc_id", "piece")
        .mapInArrow(place, schema)
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack() of pieces with ids: a row for each
    with its ids in order. A sequence is bounded by the capacity, so is its row."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("input_ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, open_bins: int = 2048, with_ids: bool = False) -> DataFrame:
    pieces = settle(token_pieces(docs, tokenizer or public_path(), capacity, end_id, with_ids), "pieces")
    return pack(pieces, capacity, open_bins)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
