"""Chroma fingerprints of audio in a media column, and their alignment.

Samples are cut into overlapping frames, each frame's spectrum is folded into twelve pitch
classes, and an integral image over (frame, pitch class) gives sixteen box filters two bits
each: a packed 32-bit code for every frame position.

Two recordings align at an offset if they overlap in at least SPAN + 1 codes there and at
most `most_errors` of the overlap's bits differ. Candidates share a key, which is made of
two codes SPAN frames apart (so they have no frame in common, and chance rarely brings
both), taken from the recording as it is and from PHASES samples on, so that a copy cut at
any sample is met. Keys count at their first place. One key in `one_in` is picked by its own
hash, the same picks wherever it stands; that loses what shares only other keys, so the
query picks all (one_in=1). Recordings without an equal key are not linked, whatever their bits.

1. Recordings with equal fingerprints are one class; its least member stands for it.
2. Every key's holders vote for the offset to its least holder, the key's pivot: a
   histogram of (recording, pivot, offset). All its bins are tried by bit errors, links
   become components. That is linear in the holders; hot keys and pivots are split.
3. A pivot whose recordings are still of several components: members of different ones are
   laid over the pivot's time line and compared in blocks inside tasks; what joins two
   components comes out. So every pair that shares a picked key is linked, refused or in
   one component already. This work grows with the square of such a pivot's recordings.

A row for each recording comes out, with its class (the least id it is linked with over any
number of links) and its best direct link.

Defined results: null and empty media have no frames and no class but their own; a clip
with fewer than SPAN + 1 codes (padded with silence up to one frame and one code) aligns
only with clips of as many samples and the same pitch-class frames; ids may be null (the
class is then the least id that is there) or repeat; repeated rows align with each other at
offset 0; an empty table gives no rows; other columns are not read. Media are 8-bit
unsigned mono samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_KEYS, HOT, join_counted, mixed, read_documents, settle, slices
from .components import connected_components

RATE, FRAME, HOP, SPAN = 8000, 256, 64, 16


def pitch_fold() -> np.ndarray:
    """(spectrum bins, 12): each bin's power goes to its nearest pitch class."""
    f = np.arange(FRAME // 2 + 1) * RATE / FRAME
    fold = np.zeros((len(f), 12), np.float32)
    heard = np.flatnonzero((f >= 60) & (f <= 3600))
    fold[heard, np.round(12 * np.log2(f[heard] / 440.0)).astype(int) % 12] = 1
    return fold


def filters() -> list[tuple[int, int, int, int, str]]:
    """Sixteen boxes over SPAN frames and 12 classes: first class, classes, first frame,
    frames, and how the box is halved: by class, by frame, or in three by frame."""
    return [(3 * (k % 4), 3 + 3 * (k % 2) if k % 4 < 3 else 3, (k // 4) * 2, 6 + 2 * (k // 8) + 2 * (k % 2), "cft"[k % 3]) for k in range(16)]


FOLD, FILTERS, WINDOW = pitch_fold(), filters(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray, block: int = 8192) -> np.ndarray:
    """(frames, 12), each frame scaled to unit length."""
    if not len(samples):
        return np.zeros((0, 12), np.float32)
    if len(samples) < FRAME:
        samples = np.concatenate([samples, np.full(FRAME - len(samples), 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), 12), np.float32)
    for at in range(0, len(frames), block):
        power = np.abs(np.fft.rfft((frames[at : at + block].astype(np.float32) - 128) * WINDOW, axis=1)) ** 2
        out[at : at + block] = power.astype(np.float32) @ FOLD
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-6)


def codes(classes: np.ndarray) -> np.ndarray:
    """Packed 32-bit codes, one for each position of SPAN frames."""
    if not len(classes):
        return np.zeros(0, np.uint32)
    if len(classes) < SPAN:
        classes = np.concatenate([classes, np.zeros((SPAN - len(classes), 12), np.float32)])
    image = np.zeros((len(classes) + 1, 13))
    image[1:, 1:] = classes.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    n = len(classes) - SPAN + 1
    box = lambda c, w, t, d: image[t + d : t + d + n, c + w] - image[t : t + n, c + w] - image[t + d : t + d + n, c] + image[t : t + n, c]
    out = np.zeros(n, np.uint32)
    for c, w, t, d, how in FILTERS:
        if how == "c":
            a, b = box(c, w // 2, t, d), box(c + w // 2, w - w // 2, t, d) * (w // 2) / (w - w // 2)
        elif how == "f":
            a, b = box(c, w, t, d // 2), box(c, w, t + d // 2, d - d // 2) * (d // 2) / (d - d // 2)
        else:
            a, b = box(c, w, t + d // 3, d // 3), (box(c, w, t, d // 3) + box(c, w, t + 2 * (d // 3), d // 3)) / 2
        level = np.digitize(np.log((1 + a) / (1 + b)), (-0.1, 0.0, 0.1))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # neighbours differ in one bit
    return out


LEAST = SPAN + 1
#: Keys are also taken of the recording without so many first samples, since a copy may be cut
#: anywhere: then one of the two has frames within a quarter hop of the other's.
PHASES = (HOP // 2,)


def picked_keys(found: list[np.ndarray], one_in: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a recording, by the codes of each phase, whose hash is 0 modulo one_in, and for
    each phase the one of least hash; each with its first place."""
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for c in (f.astype(np.uint64) for f in found if len(f) >= LEAST):
        own, first = np.unique(mixed((c[:-SPAN] << np.uint64(32)) | c[SPAN:]), return_index=True)
        h = mixed(own)
        keep = h % np.uint64(one_in) == 0
        keep[h.argmin()] = True
        keys.append(own[keep])
        places.append(first[keep].astype(np.int32))
    every, at = np.concatenate(keys), np.concatenate(places)
    order = np.lexsort((at, every))
    first = order[np.concatenate([[True], every[order[1:]] != every[order[:-1]]])] if len(order) else order
    return every[first].view(np.int64), at[first]


def fingerprints(media: DataFrame) -> DataFrame:
    """(uid, doc_id, media) -> uid, doc_id, n_frames, n_codes, codes_crc32, alike (the
    identity of the fingerprint; null where there is none), codes, and those of each phase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for value in part.column(2):
                    samples = np.frombuffer(value.as_buffer() if value.is_valid else b"", np.uint8)
                    classes = chroma(samples)
                    c = codes(classes)
                    raw = c.astype("<u4").tobytes()
                    whole = raw if len(c) >= LEAST else classes.tobytes() + len(samples).to_bytes(8, "little")
                    later = [codes(chroma(samples[p:])).view(np.int32) for p in PHASES if len(samples) >= p + FRAME] if len(c) >= LEAST else []
                    rows.append((len(classes), len(c), crc32(raw), hashlib.blake2b(whole, digest_size=16).hexdigest() if len(c) else None, c.view(np.int32), later))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], PRINTS)

    return media.select("uid", "doc_id", "media").mapInArrow(run, "uid long, doc_id long, n_frames long, n_codes long, codes_crc32 long, alike string, codes array<int>, later array<array<int>>")


PRINTS = ["uid", "doc_id", "n_frames", "n_codes", "codes_crc32", "alike", "codes", "later"]


def picked(prints: DataFrame, one_in: int, most: int = 1 << 18) -> DataFrame:
    """(uid, codes, later) -> uid, key, at: the picked keys of each recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            found, n = [], 0
            for r, (own, later) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                keys, places = picked_keys([_words(own.values), *(_words(c.values) for c in later)], one_in)
                found.append((np.full(len(keys), uids[r]), keys, places))
                n += len(keys)
                if n >= most or r == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["uid", "key", "at"])
                    found, n = [], 0

    return prints.select("uid", "codes", "later").mapInArrow(run, "uid long, key long, at int")


def shared(picks: DataFrame, hot: int = HOT, sample: int = 64) -> DataFrame:
    """The holders of keys that have several: uid, pivot (the key's least holder) and offset.
    Nearly all keys have one holder, so rows are shuffled once, by key. Keys with more than
    about hot holders, as one recording in `sample` shows, don't meet in a task: they are
    broadcast and their pivots found by partial minima. The sample decides only the way."""
    some = picks.where(F.pmod(F.xxhash64(F.lit("sample"), "uid"), F.lit(sample)) == 0)
    often = settle(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * sample > hot).select("key"), "hot-picks")
    n_hot, first = often.count(), F.struct("uid", "at")
    rest = picks.join(F.broadcast(often), "key", "left_anti") if 0 < n_hot <= BROADCAST_KEYS else picks
    by = W.partitionBy("key")
    found = rest.withColumn("n", F.count("*").over(by)).withColumn("first", F.min(first).over(by)).where("n > 1").select("uid", "at", "first")
    if 0 < n_hot <= BROADCAST_KEYS:
        held = picks.join(F.broadcast(often), "key")
        pivots = settle(held.groupBy("key").agg(F.min(first).alias("first")), "hot-pivots")
        found = found.unionByName(held.join(F.broadcast(pivots), "key").select("uid", "at", "first"))
    return found.select("uid", F.col("first.uid").alias("pivot"), (F.col("first.at") - F.col("at")).alias("offset")).where("uid <> pivot").distinct()


def overlap(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int, int]:
    """Codes in the overlap where a starts at b's offset, equal ones, and differing bits."""
    x, y = (a, b[offset:]) if offset >= 0 else (a[-offset:], b)
    n = min(len(x), len(y))
    differ = x[:n] ^ y[:n]
    return n, int((differ == 0).sum()), int(np.bitwise_count(differ).sum())


LINK = "a long, b long, offset int, votes long, bit_errors double"


def _link_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["a", "b", "offset", "votes", "bit_errors"])


def _words(values: pa.Array) -> np.ndarray:
    return values.to_numpy().view(np.uint32)


def _tried(bins: DataFrame, prints: DataFrame, most_errors: float) -> DataFrame:
    """The histogram's bins (uid, pivot, offset) that align, by bit errors. A pivot with
    many bins is dealt over several tasks, its codes to each of them."""
    each = bins.groupBy("pivot").agg(F.count("*").alias("n_bins")).withColumn("n_salts", F.ceil(F.col("n_bins") / 1000).cast("int"))
    salted = join_counted(bins, each, "pivot", "n_bins").withColumn("salt", F.pmod(F.xxhash64("uid", "offset"), F.col("n_salts")).cast("int"))
    theirs = prints.select(F.col("uid").alias("pivot"), F.col("codes").alias("theirs")).join(each, "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)))
    pairs = salted.join(prints.select("uid", "codes"), "uid").join(theirs.select("pivot", "salt", "theirs"), ["pivot", "salt"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, offset, mine, other in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4), strict=True):
                n, same, bits = overlap(_words(mine.values), _words(other.values), offset)
                if n >= LEAST and bits <= most_errors * 32 * n:
                    out.append((a, b, offset, same, bits / (32 * n)))
            yield _link_rows(out)

    return pairs.select("uid", "pivot", "offset", "codes", "theirs").mapInArrow(errors, LINK)


def across_parts(uid: list[int], at: np.ndarray, part: list[int], side: np.ndarray, found: list[np.ndarray], most_errors: float, cells: int = 1 << 22) -> list[tuple]:
    """Links between members of different parts, laid over one time line at `at`; side 0:
    members compared with all, else only with the other side. A spanning forest: members
    that a link found here has joined already are not compared again."""
    size = np.array([len(f) for f in found])
    left, width = int(-at.min()), int((at + size).max() - at.min())
    up = {p: p for p in part}

    def root(p: int) -> int:
        while up[p] != p:
            up[p] = p = up[up[p]]
        return p

    out = []
    number = {p: k for k, p in enumerate(up)}
    for lo, hi in slices(np.full(len(uid), width), cells):
        laid, heard = np.zeros((hi - lo, width), np.uint32), np.zeros((hi - lo, width), bool)
        for r in range(lo, hi):
            laid[r - lo, left + at[r] : left + at[r] + size[r]] = found[r]
            heard[r - lo, left + at[r] : left + at[r] + size[r]] = True
        here = np.array([number[p] for p in part[lo:hi]])
        for x in range(len(uid)):
            ys = np.flatnonzero((here != number[part[x]]) & ((side[lo:hi] != side[x]) | (side[lo:hi] == 0) & (np.arange(lo, hi) > x)) & (at[lo:hi] < at[x] + size[x]) & (at[x] < at[lo:hi] + size[lo:hi]))
            ys = ys[[root(part[lo + y]) != root(part[x]) for y in ys]] if len(ys) else ys
            if not len(ys):
                continue
            span = slice(left + at[x], left + at[x] + size[x])
            n = heard[ys, span].sum(axis=1)
            differ = laid[ys, span] ^ found[x]
            bits = (np.bitwise_count(differ) * heard[ys, span]).sum(axis=1, dtype=np.int64)
            for k in np.flatnonzero((n >= LEAST) & (bits <= most_errors * 32 * n)):
                y = lo + ys[k]
                p, q = root(part[x]), root(part[y])
                if p != q:
                    up[max(p, q)] = min(p, q)
                    same = int(((differ[k] == 0) & heard[ys[k], span]).sum())
                    out.append((uid[x], uid[y], int(at[x] - at[y]), same, float(bits[k] / (32 * n[k]))))
    return out


def _across_parts(bins: DataFrame, prints: DataFrame, roots: DataFrame, most_errors: float, block: int, block_codes: int) -> DataFrame:
    """Links between recordings of one pivot that are still of different components. They are
    dealt by hash into blocks of about block recordings and block_codes codes, so that long
    recordings make smaller blocks; a task holds two blocks."""
    own = bins.select("pivot").distinct().select("pivot", F.col("pivot").alias("uid"), F.lit(0).alias("offset"))
    members = bins.select("pivot", "uid", "offset").unionByName(own).join(roots.withColumnRenamed("vertex", "uid"), "uid", "left").withColumn("part", F.coalesce("root", "uid")).drop("root")
    members = settle(members.join(prints.select("uid", "n_codes"), "uid"), "pivot-members")
    several = members.groupBy("pivot").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n"), F.sum("n_codes").alias("sum_codes")).where("p <> q and n > 2")
    several = settle(several.select("pivot", "n", F.ceil(F.greatest(F.col("n") / block, F.col("sum_codes") / block_codes)).cast("int").alias("blocks")), "mixed-pivots")
    mine = F.pmod(F.xxhash64("uid", "offset"), F.col("blocks")).cast("int")
    dealt = join_counted(members, several, "pivot", "n").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    keyed = dealt.select("pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "uid", "offset", "part", side.alias("side"))
    rows = keyed.join(prints.select("uid", "codes"), "uid").select(*keyed.columns, "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> list[tuple]:
            if len(held) < 2:
                return []
            uid, at, part, side, found = zip(*held, strict=True)
            return across_parts(list(uid), np.array(at), list(part), np.array(side), list(found), most_errors)

        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for r, c in enumerate(batch.column(7)):
                pivot, i, j, uid, at, part, side = (column[r] for column in columns)
                if (pivot, i, j) != key:
                    out += done()
                    key, held = (pivot, i, j), []
                held.append((uid, at, part, side, _words(c.values)))
            yield _link_rows(out)
        yield _link_rows(done())

    return rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "uid", "offset").mapInArrow(run, LINK)


def align(media: DataFrame, one_in: int = 4, most_errors: float = 0.15, block: int = 1024, block_codes: int = 1 << 20) -> DataFrame:
    """A row for each recording: doc_id, n_frames, n_codes, codes_crc32, class_id, its best
    direct link (partner, offset of its start in the partner's frames, votes: equal codes at
    that offset, bit_errors: share over the overlap) and whether it has one (aligned)."""
    prints = settle(fingerprints(media), "fingerprints")
    classes = prints.where("alike is not null").groupBy("alike").agg(F.min("uid").alias("rep"), F.max("uid").alias("last"), F.count("*").alias("n_rows"), F.max("n_codes").alias("n_codes"))
    classes = settle(classes, "alike")
    reps = classes.where(F.col("n_codes") >= LEAST).select(F.col("rep").alias("uid"))
    reps = prints.where(F.col("n_codes") >= LEAST).select("uid", "n_codes", "codes", "later").join(reps, "uid", "left_semi").dropDuplicates(["uid"])
    # Keys take several times the room of the codes they are made of: they are never written.
    kept = settle(reps, "kept-prints")
    reps = kept.drop("later")

    bins = settle(shared(picked(kept, one_in)), "bins")
    links = settle(_tried(bins, reps, most_errors), "links")
    roots = connected_components(links, "a", "b")
    links = settle(links.unionByName(_across_parts(bins, reps, roots, most_errors, block, block_codes)), "all-links")
    roots = connected_components(links, "a", "b")

    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other"), "offset", "votes", "bit_errors").unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other"), (-F.col("offset")).alias("offset"), "votes", "bit_errors"))
    best = both.groupBy("rep").agg(F.min(F.struct("bit_errors", (-F.col("votes")).alias("less"), F.abs("offset").alias("far"), "other", "offset")).alias("b"))
    names = prints.groupBy("uid").agg(F.min("doc_id").alias("name"))
    best = best.join(names.toDF("other", "of_link"), F.col("b.other") == F.col("other")).select("rep", "b", "of_link")
    ids = prints.where("alike is not null").groupBy("alike").agg(F.min("doc_id").alias("id"))
    told = classes.join(ids, "alike").join(roots.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")).join(best, "rep", "left")
    # Copies have each other; only a class of one row looks to its links.
    told = told.join(names.toDF("last", "of_rep"), "last").join(names.toDF("rep", "of_others"), "rep").withColumn("copies", F.col("n_rows") > 1)
    told = settle(told.join(told.groupBy("root").agg(F.min("id").alias("class_id")), "root"), "told").drop("n_codes")
    linked = F.col("b").isNotNull() | F.col("copies")
    one = join_counted(prints.where("alike is not null").drop("codes", "later"), told, "alike", "n_rows")
    pick = lambda copy, link: F.when(F.col("copies"), copy).otherwise(link)
    found = one.select(
        "doc_id", "n_frames", "n_codes", "codes_crc32", "class_id", pick(F.when(F.col("uid") == F.col("rep"), F.col("of_rep")).otherwise(F.col("of_others")), F.col("of_link")).alias("partner"),
        pick(F.lit(0), F.col("b.offset")).alias("offset"), pick(F.col("n_codes"), -F.col("b.less")).alias("votes"), pick(F.lit(0.0), F.col("b.bit_errors")).alias("bit_errors"), linked.alias("aligned"),
    )
    none = prints.where("alike is null").select("doc_id", "n_frames", "n_codes", "codes_crc32", F.col("doc_id").alias("class_id"), *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("partner", "offset", "votes", "bit_errors")), F.lit(False).alias("aligned"))
    return found.union(none)


def texts_as_media(docs: DataFrame) -> DataFrame:
    """A media column for a corpus without one: a text's bytes read as 8-bit samples."""
    return docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("media"))


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(texts_as_media(read_documents(spark, sf_dir)), one_in=1)


QUERIES = {"op2_chroma_fingerprints": op2_chroma_fingerprints}
ORACLES: dict[str, str] = {}
