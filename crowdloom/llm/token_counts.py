"""Token counts of documents in flat token files that carry no index.

A flat file is token ids back to back, each document closed by an end-of-document id.
Files are read as fixed-size blocks. Each block is searched for the end id at once;
a prefix scan over the blocks of a file (running sums of tokens and separators, running
maximum of the last separator's place) then stitches documents that cross blocks.

Defined results: two separators in a row are an empty document of 0 tokens; tokens after
a file's last separator are a document marked closed = false; a file without tokens, or an
empty table, has no rows. Null ids and texts in write_blocks: the id stays null, the text
is an empty document. Repeated rows are separate documents. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read_documents, settle
from .tokens import public_path
from .tokens import tokenizer as tokenizer_of


def flat_file_blocks(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """Blocks (file, block, payload) of binary token files at any path Spark reads; a
    file is at most the 2 GB of a binary value, larger corpora have more files. A file is
    cut up as a whole, so its content is copied once and no block carries it along."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    begins = F.sequence(F.lit(0), F.expr(f"cast((length - 1) div {block_bytes} as int)"))
    cut = F.transform(begins, lambda k: F.substring("content", k * block_bytes + 1, F.lit(block_bytes)))
    return files.select(F.col("path").alias("file"), F.posexplode(cut).alias("block", "payload"))


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Tokenises docs into one flat token file for each input partition, as blocks
    (file, block, payload of little-endian 16-bit ids), and a manifest (file, ordinal,
    doc_id) of the documents in the order written. Lengths are stored nowhere."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, file = tokenizer_of(tokenizer, plain_specials=True), TaskContext.get().partitionId()
        held, n, block, ordinal = [], 0, 0, 0

        def rows(blocks: list[bytes], numbers: list[int], ids: pa.Array) -> pa.RecordBatch:
            k, m = len(blocks), len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * (k + m), pa.int64()),
                    pa.array(numbers + [None] * m, pa.int64()),
                    pa.array(blocks + [None] * m, pa.binary()),
                    pa.array([None] * k + list(range(ordinal, ordinal + m)), pa.int64()),
                    pa.concat_arrays([pa.nulls(k, pa.int64()), ids]),
                ],
                ["file", "block", "payload", "ordinal", "doc_id"],
            )

        for batch in batches:
            blocks: list[bytes] = []
            for ids in tok.documents(batch.column(1)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u2")
                held.append(ids)
                n += len(ids)
                if n >= block_tokens:
                    stream = np.concatenate(held)
                    whole = n // block_tokens * block_tokens
                    blocks += [stream[k : k + block_tokens].tobytes() for k in range(0, whole, block_tokens)]
                    held, n = [stream[whole:].copy()], n - whole
            yield rows(blocks, list(range(block, block + len(blocks))), batch.column(0).cast(pa.int64()))
            block, ordinal = block + len(blocks), ordinal + batch.num_rows
        if n:
            yield rows([np.concatenate(held).tobytes()], [block], pa.array([], pa.int64()))

    written = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "file long, block long, payload binary, ordinal long, doc_id long"), "flat-tokens")
    return written.where("block is not null").select("file", "block", "payload"), written.where("ordinal is not null").select("file", "ordinal", "doc_id")


def separator_scan(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) for each document of the flat files;
    start counts tokens from the file's begin, n_tokens leaves out the separator."""
    file_type = blocks.schema["file"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_py() or b"", dtype)
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == end_id).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["file", "block", "n", "found"])

    hits = settle(blocks.select("file", F.col("block").cast("long").alias("block"), "payload").mapInArrow(search, f"file {file_type}, block long, n long, found array<int>"), "separators")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    last = F.when(F.size("found") > 0, F.col("offset") + F.element_at("found", -1) + 1)
    scanned = (
        hits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("first_ordinal", F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)))
        .withColumn("since", F.coalesce(F.max(last).over(before), F.lit(0)))
    )
    closed = scanned.select("file", "first_ordinal", "offset", "since", "found", F.posexplode("found").alias("i", "at")).select(
        "file",
        (F.col("first_ordinal") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("since")).otherwise(F.col("offset") + F.try_element_at("found", F.col("i")) + 1).alias("start"),
        (F.col("offset") + F.col("at")).alias("end"),
        F.lit(True).alias("closed"),
    )
    rest = (
        scanned.groupBy("file")
        .agg(F.max(F.col("offset") + F.col("n")).alias("end"), F.coalesce(F.max(last), F.lit(0)).alias("start"), F.sum(F.size("found")).alias("ordinal"))
        .where("end > start")
        .select("file", "ordinal", "start", "end", F.lit(False).alias("closed"))
    )
    return closed.unionByName(rest).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document to flat token files, then counts each one's tokens from the
    files alone; the manifest gives the ids back."""
    end_id = 49407
    blocks, manifest = write_blocks(read_documents(spark, sf_dir), public_path(), end_id)
    return separator_scan(blocks, end_id).join(manifest, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", F.col("start").alias("file_start"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
