"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if some string of `length` bytes that covers it starts at another place of the
corpus as well. The starts ("windows") are first grouped by content so that each group can
be sorted by itself: a window's anchor is the least hash among its `gram`-byte substrings,
so equal windows have equal anchors wherever they stand. Consecutive windows with one
anchor form a run, a string of its own.

1. Runs whose anchor occurs at one place hold no repeat and are dropped: counts by anchor.
2. Runs that are equal as a whole (two independent 64-bit hashes of all their bytes, with
   the anchor) repeat with all their windows: counts by run. One of each is its context.
3. Anchors with several contexts, or several places in one, are decided by suffix sort: suffixes start at
   every window of the contexts; a mergesort compares two suffixes by the length of their
   common extension, found by binary search over prefix polynomial hashes; neighbours that
   share `length` bytes, verified byte by byte, repeat. Groups are sorted inside tasks,
   many at a time. Anchors with more than `group_limit` contexts are not sorted in one
   task: their windows are counted by a 128-bit hash, which spreads them; windows of other
   bytes with an equal hash are looked for among those found and taken out.
4. The windows found are joined to the texts and their bytes removed.

No step gathers an anchor's occurrences; counts are pre-aggregated before each shuffle, and
frequent anchors are dealt over several tasks. A text is told by two 64-bit hashes.

Defined results: null and empty texts have 0 bytes and nothing removed; ids may be null
or repeat; rows with equal text repeat each other, and all their bytes go if there are
`length` of them; texts shorter than `length` keep all; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PrefixHash, byte_table, mixed, read_documents, settle, text_slices

SECOND, THIRD = mixed(byte_table() + np.uint64(77)), mixed(byte_table() + np.uint64(177))

#: What tells a run from others, and its type; a text's identity.
RUN, RUN_TYPES, UID = ["anchor", "whole", "second"], "anchor long, whole long, second long", "uid struct<a:long,b:long>"


def _least_over(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of h over each stretch of width places, by doubling."""
    span, out = 1, h
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def runs_of(texts: list[bytes], length: int, gram: int, anchors_only: bool = False) -> tuple[np.ndarray, ...]:
    """For each run: text number, first window, number of windows, anchor, two run hashes,
    and whether the anchor may stand at several places in it. anchors_only: no run hashes."""
    width = length - gram + 1
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none, none, none.astype(bool)
    grams = np.arange(len(buf) - gram + 1)
    hashes = mixed(PrefixHash(buf).hash(grams, grams + gram))
    anchor = _least_over(hashes, width)
    ends = np.full(width - 1, ~np.uint64(0))
    picked = np.sort(hashes[~_least_over(~np.concatenate([~ends, anchor, ~ends]), width) == hashes])
    several = picked[1:][picked[1:] == picked[:-1]]
    firsts = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(len(buf) + 1, np.int64)
    np.add.at(valid, firsts[windows > 0], 1)
    np.add.at(valid, (firsts + windows)[windows > 0], -1)
    valid = np.cumsum(valid)[: len(anchor)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    new[firsts[windows > 0]] = True
    start = np.flatnonzero(new)
    n = np.add.reduceat(valid.astype(np.int64), start) if len(start) else none
    parts = -(-n // width)  # only periodic texts have longer runs
    if len(parts) and parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, n = np.repeat(start, parts) + k * width, np.minimum(np.repeat(n, parts) - k * width, width)
    text = np.searchsorted(firsts + sizes, start, "right")
    wholes = [anchor[:0] if anchors_only else mixed(PrefixHash(buf, table).hash(start, start + n + length - 1) + n.astype(np.uint64)) for table in (SECOND, THIRD)]
    return text, start - firsts[text], n, anchor[start].view(np.int64), *(x.view(np.int64) for x in wholes), np.isin(anchor[start], several)


def _runs(docs: DataFrame, length: int, gram: int, anchors_only: bool) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(1), 1 << 20):
                text, start, n, anchor, whole, second, again = runs_of(texts, length, gram, anchors_only)
                if anchors_only:  # an anchor with several places counts as several
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([anchor, anchor[again]]))], ["anchor"])
                else:
                    uid = batch.column(0).take(pa.array(text + at))
                    yield pa.RecordBatch.from_arrays([uid, pa.array(anchor), pa.array(whole), pa.array(second), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)], ["uid", *RUN, "start", "n", "again"])
                at += len(texts)

    long_enough = docs.where(F.octet_length("text") >= length)
    return long_enough.mapInArrow(find, "anchor long" if anchors_only else f"{UID}, {RUN_TYPES}, start int, n int, again boolean")


def _extension(h: PrefixHash, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Common extension of the suffixes at p and q, at most length: binary search on hashes."""
    whole = h.hash(p, p + length) == h.hash(q, q + length)
    out = np.full(len(p), length, np.int64)
    k = np.flatnonzero(~whole)
    p, q = p[k], q[k]
    low, high = np.zeros(len(k), np.int64), np.full(len(k), length - 1, np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = h.hash(p, p + mid) == h.hash(q, q + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    out[k] = low
    return out


def suffix_order(buf: np.ndarray, h: PrefixHash, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """The order of the suffixes by group and their first length bytes. A stable sort by
    the first eight bytes leaves ties; these are merge sorted, all ties of all groups in
    step, comparing suffixes by their common extension."""
    head = np.zeros(len(starts), np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | buf[starts + k]
    order = np.lexsort((head, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order[1:]] != group[order[:-1]]) | (head[order[1:]] != head[order[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    tied = np.repeat(size > 1, size)
    if not tied.any():
        return order
    at = np.flatnonzero(tied)
    base, total = np.repeat(first, size)[at], np.repeat(size, size)[at]
    held, width = order.copy(), 1
    while width < total.max():
        inside = at - base
        block = inside // width
        other = base + (block ^ 1) * width  # the block to merge with
        low = np.minimum(other, base + total)
        high = np.minimum(other + width, base + total)
        left, begin = block % 2 == 0, low.copy()
        mine = starts[held[at]]
        while (low < high).any():
            k = np.flatnonzero(low < high)
            mid = (low[k] + high[k]) // 2
            p, q = mine[k], starts[held[mid]]
            ext = _extension(h, p, q, length)
            equal = ext >= length
            inner = np.minimum(ext, length - 1)
            after = np.where(equal, ~left[k], buf[p + inner] > buf[q + inner])  # the other one stays before
            low[k[after]] = mid[after] + 1
            high[k[~after]] = mid[~after]
        place = base + (block - block % 2) * width + (inside - block * width) + (low - begin)
        merged = held.copy()
        merged[place] = held[at]
        held, width = merged, 2 * width
    return held


def repeated_windows(contexts: list[bytes], windows: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the numbers of its windows that occur at another start of its group."""
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    of = np.repeat(np.arange(len(contexts)), windows)
    number = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = (np.cumsum(sizes) - sizes)[of] + number
    h = PrefixHash(buf)
    order = suffix_order(buf, h, starts, group[of], length)
    a, b = order[:-1], order[1:]
    k = np.flatnonzero((group[of[a]] == group[of[b]]) & (h.hash(starts[a], starts[a] + length) == h.hash(starts[b], starts[b] + length)))
    found = np.zeros(len(of), bool)
    for part in np.array_split(k, max(1, len(k) // 4096)):  # collisions are told by the bytes
        reach = np.arange(length)
        same = (buf[starts[a[part]][:, None] + reach] == buf[starts[b[part]][:, None] + reach]).all(axis=1)
        found[a[part[same]]] = found[b[part[same]]] = True
    stops = np.cumsum(windows)
    return [np.flatnonzero(x) for x in np.split(found, stops[:-1])]


def _sort_groups(contexts: DataFrame, length: int, block: int = 1 << 19) -> DataFrame:
    """Suffix-sorts contexts (RUN, n, context) anchor by anchor, block bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            anchors = np.array([r[0] for r in rows])
            hits = repeated_windows([r[4] for r in rows], np.array([r[3] for r in rows]), anchors, length)
            out = [(*r[:3], x.astype(np.int32)) for r, x in zip(rows, hits, strict=True) if len(x)]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [*RUN, "windows"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= block and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(held)

    grouped = contexts.select(*RUN, "n", "context").repartition("anchor").sortWithinPartitions("anchor")
    return grouped.mapInArrow(run, f"{RUN_TYPES}, windows array<int>")


def _count_windows(contexts: DataFrame, length: int, bits: int = 64) -> DataFrame:
    """The same for anchors with very many contexts, by counting: windows whose two hashes
    stand twice are found, then those of different bytes with equal hashes told apart. bits:
    of each hash, fewer only where a test wants collisions."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, n, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf, at = np.frombuffer(context, np.uint8), np.arange(n)
                keys = [pa.array((mixed(PrefixHash(buf, t).hash(at, at + length)) & mask).view(np.int64)) for t in (None, SECOND)]
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * n, pa.int64()) for k in key), pa.array(at.astype(np.int32)), *keys], [*RUN, "window", "x", "y"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of the windows found, once for each batch."""
        for batch in batches:
            seen = {(w["x"], w["y"], context[w["window"] : w["window"] + length]) for context, some in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in some}
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in seen], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["x", "y", "piece"])

    windows = contexts.select(*RUN, "n", "context").mapInArrow(run, f"{RUN_TYPES}, window int, x long, y long")
    twice = windows.groupBy("x", "y").count().where("count > 1").drop("count")
    found = settle(windows.join(twice, ["x", "y"]).groupBy(*RUN).agg(F.collect_list(F.struct("window", "x", "y")).alias("found")), "counted-windows")
    with_bytes = found.join(contexts.select(*RUN, "context"), RUN)
    clashes = settle(with_bytes.select("context", "found").mapInArrow(pieces, "x long, y long, piece binary").distinct().groupBy("x", "y").count().where("count > 1").drop("count"), "hash-clashes")
    if clashes.isEmpty():
        return found.select(*RUN, F.sort_array("found.window").alias("windows"))
    each = with_bytes.select(*RUN, "context", F.explode("found").alias("w")).select(*RUN, "w.*", F.expr(f"substring(context, w.window + 1, {length})").alias("piece"))
    alone = each.join(clashes, ["x", "y"], "left_semi").groupBy("piece").agg(F.count("*").alias("times"), F.min(F.struct(*RUN, "window")).alias("o")).where("times = 1").select("o.*")
    return each.join(alone, [*RUN, "window"], "left_anti").groupBy(*RUN).agg(F.sort_array(F.collect_list("window")).alias("windows"))


#: Rows of one anchor that a task may get, unless a millionth of all rows is more.
ANCHOR_ROWS = 2048


def _with_anchors(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The runs whose anchor is in anchors (anchor, count). Those of frequent anchors are
    dealt over several tasks; such anchors are a million at most, so they are broadcast."""
    total = anchors.agg(F.sum("count")).first()[0] or 0
    most = max(ANCHOR_ROWS, -(-total // 1_000_000))
    dealt = anchors.select("anchor", F.ceil(F.col("count") / most).cast("int").alias("deals"))
    frequent = F.broadcast(dealt.where("deals > 1"))
    numbered = runs.join(frequent, "anchor", "left").withColumn("deal", F.coalesce(F.pmod(F.monotonically_increasing_id(), "deals").cast("int"), F.lit(0))).drop("deals")
    return numbered.join(dealt.select("anchor", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")), ["anchor", "deal"]).drop("deal")


def repeats(docs: DataFrame, length: int = 200, gram: int = 64, group_limit: int = 2048) -> DataFrame:
    """(uid, spans) for the texts with repeats: the windows found as start and stop bytes
    of what they cover, in no order. uid is with_uid's key of the text."""
    docs = with_uid(docs).select("uid", "text")
    anchors = settle(_runs(docs, length, gram, True).groupBy("anchor").count().where("count > 1"), "anchors")
    runs = settle(_with_anchors(_runs(docs, length, gram, False), anchors), "runs")
    kinds = settle(runs.groupBy(*RUN).agg(F.count("*").alias("times"), F.min(F.struct("uid", "start", "n")).alias("one"), F.max("again").alias("again")), "run-kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max(F.expr("again and times = 1")).alias("inside")).where("kinds > 1 or inside")
    asked = kinds.join(several, "anchor").select("one.uid", F.struct(*RUN, "times", "kinds", "one.start", "one.n").alias("ask"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, asks in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                out += [(*(a[k] for k in RUN), a["times"], a["kinds"], a["n"], raw[a["start"] : a["start"] + a["n"] + length - 1]) for a in asks.as_py()]
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [*RUN, "times", "kinds", "n", "context"])

    asks = asked.groupBy("uid").agg(F.collect_list("ask").alias("asks"))
    once = docs.groupBy("uid").agg(F.first("text").alias("text"))  # copies of a text meet first where they are read
    found_in = once.join(asks, "uid").select("text", "asks").mapInArrow(cut, f"{RUN_TYPES}, times long, kinds long, n int, context binary")
    contexts = settle(found_in, "contexts")  # each run kind is cut from one text
    found = _sort_groups(contexts.where(F.col("kinds") <= group_limit), length).union(_count_windows(contexts.where(F.col("kinds") > group_limit), length))
    alone = settle(found.join(kinds.where("times = 1"), RUN).select(F.col("one.uid").alias("uid"), F.col("one.start").alias("start"), "windows"), "found-windows")
    # Neighbouring windows become one span before they are shuffled.
    edges = F.expr("filter(windows, w -> not array_contains(windows, w - 1))")
    stops = F.expr("filter(windows, w -> not array_contains(windows, w + 1))")
    some = alone.select("uid", F.explode(F.arrays_zip(edges.alias("a"), stops.alias("b"))).alias("w"), "start").select("uid", (F.col("start") + F.col("w.a")).alias("begin"), (F.col("start") + F.col("w.b") + length).alias("end"))
    whole = runs.join(kinds.where("times > 1").select(*RUN), RUN).select("uid", F.col("start").alias("begin"), (F.col("start") + F.col("n") + length - 1).alias("end"))
    return whole.union(some).groupBy("uid").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def with_uid(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("uid", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))


def _covered(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal stretches that the spans cover."""
    out: list[list[int]] = []
    for s in sorted((s["begin"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame, with_text: bool = True, **terms: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (begin and end bytes), kept_sha256 and,
    if asked for, the text that is left (bytes that are no whole character go as well)."""
    rows = with_uid(docs.select("doc_id", "text")).join(repeats(docs, **terms), "uid", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                gone = _covered(spans.as_py() or [])
                left, at = [], 0
                for a, b in gone:
                    left.append(raw[at:a])
                    at = b
                kept = b"".join([*left, raw[at:]])
                made.append((len(raw), len(raw) - len(kept), len(gone), [{"begin": a, "end": b} for a, b in gone], hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()]
            names = ["n_bytes", "n_removed", "n_spans", "removed", "kept_sha256", "text"]
            keep = len(names) - (not with_text)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds[:keep]))], ["doc_id", *names[:keep]])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<begin:long,end:long>>, kept_sha256 string" + ", text string" * with_text
    return rows.mapInArrow(cut, schema)


def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir), with_text=False).drop("removed")


QUERIES = {"op4_repeated_spans": op4_repeated_spans}
ORACLES: dict[str, str] = {}
