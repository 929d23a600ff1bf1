"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, union-find.

A document's set is its distinct word shingles. SuperMinHash gives each element one
random permutation of the m places, built step by step, so that an element's values in
different places are ranks of one permutation; a signature is final, and the steps stop,
as soon as every place holds a value below the next step's least. Documents with the same
set are one class, represented by its least row. Signatures are cut into bands; classes
that share a band are candidates. Every link is confirmed on the full sets.

No group is expanded into all its pairs: members of a band's bucket are first compared
with the bucket's least member and links become components. Only buckets that still hold
several components are looked at again, in blocks of bounded size inside tasks, where rows
of different components are compared and links that join two of them come out.
After that every pair sharing a band is linked, refused, or in one component already.
With 30 bands of 5 a pair at similarity 0.8 shares no band once in 150,000 pairs.

Defined results: null, empty and blank texts have no set (0 shingles) and are linked with
nothing; fewer words than a shingle count as one shingle; null ids come after all others
as representatives; rows alike in id and text are one class and all carry its id; an empty
table gives no rows; other columns are carried by drop_near_duplicates untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PrefixHash, byte_table, mixed, read_documents, row_key, settle, slices, text_slices
from .components import connected_components

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLDED = byte_table(fold_case=True)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of the distinct word shingles of each text, in order of both."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts])
    edge = np.diff(np.concatenate([[True], BLANK[buf]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = mixed(PrefixHash(buf, FOLDED).hash(starts, ends) + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(stops, starts, "right")
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    take = np.minimum(n_words, width)
    n = np.where(n_words > 0, n_words - take + 1, 0)
    of = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
    hashed = take[of].astype(np.uint64)
    for k in range(width):
        there = k < take[of]
        hashed[there] = hashed[there] * np.uint64(0x9DDFEA08EB382D69) + words[at[there] + k]
    hashed = mixed(hashed)
    order = np.lexsort((hashed, of))
    of, hashed = of[order], hashed[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashed[1:] != hashed[:-1])
    return of[new], hashed[new]


def super_min_hash(doc: np.ndarray, element: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs by m, step in the upper half of each value, rank in the lower)."""
    none = np.uint64(1 << 63)
    out = np.full(n_docs * m, none, np.uint64)
    places = None
    for j in range(m):
        if not len(doc):
            break
        x = mixed(element + np.uint64((j + 1) * 0xA0761D6478BD642F % (1 << 64)))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = k
        else:
            if places is None:
                places = np.tile(np.arange(m, dtype=np.uint8), (len(doc), 1))
                row = np.arange(len(doc))
                places[:, 0], places[row, first] = first, 0
            row = np.arange(len(doc))
            place = places[row, k].astype(np.int64)
            places[row, k] = places[:, j]
        np.minimum.at(out, doc * m + place, np.uint64(j << 32) | (x >> np.uint64(32)))
        open_docs = out.reshape(n_docs, m).max(axis=1) >= np.uint64((j + 1) << 32)
        more = open_docs[doc]
        if places is not None:
            places = places[more]
        elif j == 0:
            first = k[more]
        doc, element = doc[more], element[more]
    return out.reshape(n_docs, m)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """rid (the row by content), doc_id, n_shingles, a 128-bit key of the set, band keys."""
    m = bands * rows
    assert m <= 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(2), 1 << 20):
                doc, hashed = shingles(texts, width)
                n = np.bincount(doc, minlength=len(texts))
                sums = [np.zeros(len(texts), np.uint64) for _ in range(2)]
                for k, salt in enumerate((1, 2)):
                    np.add.at(sums[k], doc, mixed(hashed ^ np.uint64(salt * 0x51ED270B)))
                sig = super_min_hash(doc, hashed, len(texts), m).reshape(len(texts), bands, rows)
                keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(texts), bands)).copy()
                for r in range(rows):
                    keys = mixed(keys * np.uint64(0x9DDFEA08EB382D69) + sig[:, :, r])
                empty = n == 0
                offsets = np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(n.astype(np.int64)),
                        *(pa.array(s.view(np.int64), mask=empty) for s in sums),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[~empty].reshape(-1).view(np.int64))),
                    ],
                    ["rid", "doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )
                at += len(texts)

    keyed = docs.select(row_key("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(run, "rid long, doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of row keys whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            sizes = np.array([len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(left.cast(pa.large_binary()), right.cast(pa.large_binary()), strict=True)])
            for lo, hi in slices(sizes, 1 << 20):
                both = [t.encode("utf-8", "replace") for pair in zip(left.slice(lo, hi - lo).to_pylist(), right.slice(lo, hi - lo).to_pylist(), strict=True) for t in pair]
                doc, hashed = shingles(both, width)
                order = np.lexsort((hashed, doc // 2))
                pair, hashed = doc[order] // 2, hashed[order]
                shared = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (hashed[1:] == hashed[:-1])], minlength=hi - lo)
                union = np.bincount(pair, minlength=hi - lo) - shared
                yield batch.slice(lo, hi - lo).select([0, 1]).filter(pa.array((union > 0) & (100 * shared >= percent * union)))

    one = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    other = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(one, "b").join(other, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


#: Lists of row keys are broadcast up to so many, 8 bytes each; beyond, texts are shuffled.
BROADCAST_KEYS = 1_000_000


def key_list(keys: DataFrame) -> DataFrame:
    keys = settle(keys, "keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


#: A block of a bucket has about so many members, and so many shingles, at most.
BLOCK_MEMBERS, BLOCK_SHINGLES = 4096, 2_000_000


def _across_parts(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join different parts of a bucket (slot, rep, part, blocks). A
    bucket is dealt into blocks; a task gets two blocks, or one twice, counts the shared
    shingles of all rows by a matrix product and returns a spanning forest of the links
    between parts. No pair that isn't a link leaves the task, nor one that adds nothing."""
    mine = F.pmod(F.xxhash64("rep", "slot"), F.col("blocks")).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select("slot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", F.col("rep").alias("rid"), "part")
    rows = keyed.join(texts, "rid").select("slot", "i", "j", "mine", "rid", "part", "text")

    def link(group: list[tuple]) -> list[tuple[int, int]]:
        doc, hashed = shingles([r[6].encode("utf-8", "replace") for r in group], width)
        size = np.bincount(doc, minlength=len(group))
        _, column, uses = np.unique(hashed, return_inverse=True, return_counts=True)
        kept = uses[column] > 1
        doc, column = doc[kept], np.unique(column[kept], return_inverse=True)[1]
        side = np.array([r[3] == r[1] for r in group])
        left = np.flatnonzero(side)
        right = left if group[0][1] == group[0][2] else np.flatnonzero(~side)
        if not len(left) or not len(right):
            return []
        place = np.zeros(len(group), np.int64)
        shared = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            a, b = np.searchsorted(column, [low, low + 2048])
            grids = []
            for part in (left, right):
                place[:] = -1
                place[part] = np.arange(len(part))
                at = place[doc[a:b]]
                grid = np.zeros((len(part), 2048), np.float32)
                grid[at[at >= 0], column[a:b][at >= 0] - low] = 1
                grids.append(grid)
            shared += grids[0] @ grids[1].T
        parts = np.array([r[5] for r in group])
        up = {p: p for p in parts.tolist()}

        def root(p: int) -> int:
            while up[p] != p:
                up[p] = p = up[up[p]]
            return p

        found = []
        for x, row in zip(left, shared, strict=True):  # full sets, whole numbers: exact
            hits = right[((100 + percent) * row.astype(np.int64) >= percent * (size[x] + size[right])) & (parts[right] != parts[x])]
            for y in hits[np.unique(parts[hits], return_index=True)[1]]:
                p, q = root(int(parts[x])), root(int(parts[y]))
                if p != q:
                    up[p] = q
                    found.append((group[x][4], group[y][4]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    out += link(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out = link(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition("slot", "i", "j").sortWithinPartitions("slot", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 30, rows: int = 5) -> DataFrame:
    """For each row of docs: rid, doc_id, n_shingles, component_id (the least id it is
    linked with over any number of links) and lead_rid (the row that represents these)."""
    docs = docs.select("doc_id", "text")
    sigs = settle(signatures(docs, width, bands, rows), "signatures")
    ident = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    classes = settle(
        sigs.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("rid").alias("rep"), F.min(ident).alias("lead"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    slots = classes.select("rep", "n", F.explode("bands").alias("slot"))
    buckets = settle(slots.groupBy("slot").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = settle(slots.join(buckets, "slot").select("slot", "rep", "n", "pivot"), "shared-slots")

    tried = settle(shared.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    wanted = key_list(shared.select(F.col("rep").alias("rid")).distinct())
    texts = settle(docs.withColumn("rid", row_key("doc_id", "text")).join(wanted, "rid", "left_semi").dropDuplicates(["rid"]).select("rid", "text"), "texts")
    links = settle(confirm(tried, texts, width, percent), "links")
    roots = connected_components(links, "a", "b")

    # Buckets that hold several components: members of different ones are compared in blocks.
    in_part = shared.join(roots.withColumnRenamed("vertex", "rep"), "rep", "left").select("slot", "rep", "n", F.coalesce("root", "rep").alias("part"))
    several = in_part.groupBy("slot").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("members"), F.sum("n").alias("words"))
    several = several.where("p <> q and members > 2").select("slot", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    mixed_slots = settle(in_part.join(several, "slot"), "mixed-slots")
    more = settle(_across_parts(mixed_slots, texts, width, percent), "more-links")
    if not more.isEmpty():
        roots = connected_components(links.union(more), "a", "b")

    found = classes.join(roots.withColumnRenamed("vertex", "rep"), "rep", "left").select("set_a", "set_b", "lead", F.coalesce("root", "rep").alias("root"))
    leads = found.groupBy("root").agg(F.min("lead").alias("first"))
    named = settle(found.join(leads, "root").select("set_a", "set_b", F.col("first.doc_id").alias("component_id"), F.col("first.rid").alias("lead_rid")), "named-classes")
    linked = sigs.where("n_shingles > 0").join(named, ["set_a", "set_b"]).select("rid", "doc_id", "n_shingles", "component_id", "lead_rid")
    alone = sigs.where("n_shingles = 0").select("rid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("rid").alias("lead_rid"))
    return linked.union(alone)


def drop_near_duplicates(docs: DataFrame, **terms: int) -> DataFrame:
    """One row of each group, and every row without words, in docs' columns. Of rows alike
    in id and text one stays."""
    groups = settle(near_duplicates(docs, **terms).where("n_shingles > 0").select("rid", "lead_rid"), "groups")
    gone = groups.where("rid <> lead_rid").select("rid").distinct()
    alike = groups.where("rid = lead_rid").groupBy("rid").count().where("count > 1").select("rid")
    names = [f"c{k}" for k in range(len(docs.columns))]
    key = row_key(*(names[docs.columns.index(c)] for c in ("doc_id", "text")))
    kept = docs.toDF(*names).withColumn("rid", key).join(key_list(gone), "rid", "left_anti")
    alike = key_list(alike)
    several = kept.join(alike, "rid", "left_semi").dropDuplicates(["rid"])
    return kept.join(alike, "rid", "left_anti").union(several).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op5_super_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(read_documents(spark, sf_dir), width=2)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op5_super_min_hash": op5_super_min_hash}
ORACLES: dict[str, str] = {}
