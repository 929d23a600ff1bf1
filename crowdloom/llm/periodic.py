"""Periodic runs of words, by the Lyndon arrays of both word orders.

A run is a stretch of words with smallest period q, at least `shortest` words and `times`
periods long, that no neighbouring word extends. Every run has a root that is the longest
Lyndon word at some place under one of the two orders (of words, or the reverse), so:

1. Words become numbers of their document (exact: no hashes). Each run is covered by windows
   of WINDOW words found twice in its document, so only stretches of such windows go on;
   nothing is lost by that, and prose without repeats costs one sort of window hashes.
2. Both Lyndon arrays come directly from phase one of the grouping suffix sorter: groups of
   suffixes are taken from the highest down; the nearest suffix of a lower group before a
   member takes that member's word at the end of its own. No suffix is sorted.
3. Each place's Lyndon word is taken as a root and extended both ways as far as places a
   period apart agree, by binary search on prefix hashes; what is found is compared word by
   word afterwards.

A document's words lie in one task, some 100 bytes for each; documents are independent, so
nothing is shuffled. Defined results: null and blank texts have no words and no runs; ids
may be null or repeat, a row of the result stands for a row of the table; an empty table
gives an empty result; only the id and text are read, so other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, PrefixHash, mixed, read_documents, text_slices

SHORTEST, TIMES = 24, 3
RUN = "array<struct<start:long,length:long,period:long>>"


def window_of(shortest: int, times: int) -> int:
    """The longest window whose copies inside any run, one period apart, cover the run:
    length - 2 * period + 1 words at worst."""
    return max(1, min(max(shortest, times * q) - 2 * q + 1 for q in range(1, shortest + 1)))


def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word at each place. Places of symbol 0 separate
    strings, the first place must be one; no word crosses them, their own length is 1."""
    n = len(symbols)
    group = symbols.tolist()
    n_groups = int(symbols.max()) + 1
    order = np.argsort(symbols, kind="stable")
    members = [x.tolist() for x in np.split(order, np.cumsum(np.bincount(symbols, minlength=n_groups))[:-1])]
    size, length = [len(m) for m in members], [1] * n_groups
    below, above = list(range(-1, n_groups - 1)), list(range(1, n_groups + 1))
    # left[i]: i while its group is still to come, else a place before it on the way to such.
    left, result = list(range(n)), np.ones(n, np.int64)
    g = n_groups - 1
    while g > 0:
        if size[g]:
            word = length[g]
            own = [p for p in members[g] if group[p] == g] if len(members[g]) != size[g] else members[g]
            result[own] = word
            for p in own:
                left[p] = p - 1
            ends: dict[int, int] = {}
            for p in own:
                j = left[p]
                while left[j] != j:
                    left[j] = left[left[j]]
                    j = left[j]
                left[p] = j
                if group[j]:
                    ends[j] = ends.get(j, 0) + 1
            if len(ends) == 1:
                sets = [(c, group[j], [j]) for j, c in ends.items()]
            else:
                alike: dict[tuple[int, int], list[int]] = {}
                for j, c in ends.items():
                    alike.setdefault((c, group[j]), []).append(j)
                sets = [(c, q, js) for (c, q), js in alike.items()]
                sets.sort(key=lambda s: -s[0])
            for c, q, js in sets:
                if len(js) == size[q]:
                    length[q] += c * word  # all that is left of the group moves: it stays where it is
                    continue
                new, up = len(members), above[q]
                for j in js:
                    group[j] = new
                members.append(js)
                size[q] -= len(js)
                size.append(len(js))
                length.append(length[q] + c * word)
                below.append(q)
                above.append(up)
                above[q] = new
                if up < new:
                    below[up] = new
        g = below[g]
    return result


def _agree(sums: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """For how many places, up to most, what stands at (back: before) a and b is the same."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = sums.hash(a - mid, a) == sums.hash(b - mid, b) if back else sums.hash(a, a + mid) == sums.hash(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _stretches(words: np.ndarray, doc: np.ndarray, window: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches (starts, ends) covered by windows that their document has twice."""
    n = len(words) - window + 1
    if n <= 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = mixed(words.astype(np.uint64) + np.uint64(1))
    code = np.zeros(n, np.uint64)
    for k in range(window):
        code = code * np.uint64(0x9DDFEA08EB382D69) + letters[k : k + n]
    code = mixed(code) + mixed(doc[:n].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    order = at[np.argsort(code[at])]
    same = code[order[1:]] == code[order[:-1]]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    on = np.cumsum(cover)[:-1] > 0
    new = np.concatenate([[True], (on[1:] != on[:-1]) | (doc[1:] != doc[:-1])])
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(words)]])
    keep = on[starts] & (ends - starts >= shortest)
    return starts[keep], ends[keep]


def find_runs(words: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start then period. words are numbers from 0
    that mean something only within their document; doc rises."""
    starts, ends = _stretches(words, doc, window_of(shortest, times), shortest)
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    # The stretches in a row, a separator before each and after the last.
    sizes = ends - starts
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1
    stretch = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(stretch)) + stretch + 1
    origin = at - firsts[stretch] + starts[stretch]
    symbols = np.zeros(len(at) + len(starts) + 1, np.int64)
    symbols[at] = np.unique(words[origin], return_inverse=True)[1] + 1
    opens, closes = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    opens[at], closes[at] = firsts[stretch], (firsts + sizes)[stretch]
    top = int(symbols.max())
    sums = PrefixHash(symbols, mixed(np.arange(top + 1, dtype=np.uint64) + np.uint64(11)))
    found = []
    for ranks in (symbols, np.where(symbols > 0, top + 1 - symbols, 0)):
        period = lyndon_array(ranks)[at]
        ok = np.maximum(times * period, shortest) <= closes[at] - opens[at]
        i, p = at[ok], period[ok]
        ahead, behind = closes[i] - (i + p), i - opens[i]
        # Of three periods or more, one lies wholly after or wholly before the root.
        near = int(times > 2)
        right = (ahead >= near * p) & (sums.hash(i, i + near * p) == sums.hash(i + p, np.minimum(i + p + near * p, len(symbols))))
        back = np.maximum(i - near * p, 0)
        left = (behind >= near * p) & (sums.hash(back, i) == sums.hash(back + p, i + p))
        i, p, ahead, behind = (x[right | left] for x in (i, p, ahead, behind))
        r, l = _agree(sums, i, i + p, ahead, False), _agree(sums, i, i + p, behind, True)
        long = r + l + p >= np.maximum(times * p, shortest)
        found.append(np.stack([i - l, i + p + r, p, i], axis=1)[long])
    runs = np.concatenate(found)
    _, first = np.unique(runs[:, :3], axis=0, return_index=True)
    kept = []
    for s, e, p, i in runs[first].tolist():
        differ = np.flatnonzero(symbols[s : e - p] != symbols[s + p : e]) + s
        if len(differ):  # hashes met by chance: the run is what agrees around its root
            s, e = max([s, *(differ[differ < i] + 1)]), min([e, *(differ[differ >= i] + p)])
        if e - s >= max(times * p, shortest):
            k = np.searchsorted(firsts, s, "right") - 1
            kept.append((s - firsts[k] + starts[k], e - firsts[k] + starts[k], p))
    return np.array(sorted(set(kept), key=lambda x: (x[0], x[2])), np.int64).reshape(-1, 3)


def _documents(texts: list[bytes], shortest: int, times: int) -> tuple[list[int], list[list[dict]], list[str]]:
    """For each text: its number of words, its runs, and its words without repeats of runs."""
    split = [t.split() for t in texts]  # at ASCII blanks, as WORD has it
    numbers = []
    for words in split:
        index = dict.fromkeys(words)
        index.update(zip(index, range(len(index)), strict=True))
        numbers.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    sizes = [len(w) for w in split]
    doc, offsets = np.repeat(np.arange(len(texts)), sizes), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    runs = find_runs(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), doc, shortest, times)
    of = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    listed: list[list[dict]] = [[] for _ in texts]
    gone: dict[int, np.ndarray] = {}
    for d, (s, e, p) in zip(of.tolist(), runs.tolist(), strict=True):
        s, e = s - int(offsets[d]), e - int(offsets[d])
        listed[d].append({"start": s, "length": e - s, "period": p})
        gone.setdefault(d, np.zeros(sizes[d], bool))[s + p : e] = True
    kept = [" ".join(w.decode("utf-8", "replace") for w in (words if k not in gone else [words[i] for i in np.flatnonzero(~gone[k])])) for k, words in enumerate(split)]
    return sizes, listed, kept


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start then period) and
    collapsed: the words joined by spaces, without those that a run has after its first period.
    times is at least 2, shortest at least 1."""
    if times < 2 or shortest < 1:
        raise ValueError("a run has two periods or more and a word or more")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(1), 1 << 20):
                sizes, listed, kept = _documents(texts, shortest, times)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(sizes, pa.int64()), pa.array(listed, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                done += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def greatest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: smallest start, then period. The
    list is by start and period, so a later run wins only if it is truly greater."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, b: F.when(better(a, b), b).otherwise(a))


def with_loops(docs: DataFrame) -> DataFrame:
    """One document in ten, by the checksum of its id, repeats a piece of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    out = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    out = out.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    n = F.size("words")
    out = out.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.array_join(F.transform(at, lambda i: F.get("words", i.cast("int"))), " ")
    return out.select("doc_id", F.when(F.col("chosen") & (n > 0), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_loops(read_documents(spark, sf_dir))).withColumn("top", greatest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
