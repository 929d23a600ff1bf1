"""Quality rules as a bitmask ledger.

Every document is measured once over its whole text; every rule is judged once on the
measurements and stored as one bit. Policies (a version and a mask of rules that reject)
are then applied to the ledger without reading a text again, and ablations (what each
rule of a policy rejects alone, and what it would let through if dropped) are sums over
the bits.

Defined results: a null or blank text has all measurements 0 and fails the word count;
ids may be null or repeat, a row of the ledger stands for a row of the table; an empty
table gives an empty ledger; only the id and text are read, so other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PrefixHash, mixed, read_documents, text_slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_bangs", "n_bars", "n_stutters")
WINDOW = 8

#: The rules in the order of their bits; each is true where a document fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "many_capitals": "10 * n_upper_words > 6 * n_words",
    "many_bangs": "10 * n_bangs > 4 * n_words",
    "table_bars": "10 * n_bars > 2 * n_words",
    "repeated_lines": "n_lines >= 6 and 2 * n_dup_lines > n_lines",
    "stuttered_words": "10 * n_stutters > 3 * n_words",
    "odd_words": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 30 * n_words)",
}
#: Versions of policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


BLANK, SYMBOL, UPPER, LOWER = _flags(b" \t\n\x0b\x0c\r"), _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))


def measure(texts: list[bytes]) -> np.ndarray:
    """MEASURES of each text; the texts lie in one buffer, a line feed after each."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts])
    count = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[np.concatenate([[0], stops])])
    blank = BLANK[buf]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(stops, starts, "right")
    per_doc = lambda at, weights=None: np.bincount(at, weights, len(texts)).astype(np.int64)
    sums = PrefixHash(buf)
    words = mixed(sums.hash(starts, ends) + (ends - starts).astype(np.uint64))

    repeated = np.zeros(len(words), bool)
    if len(words) >= WINDOW:
        n = len(words) - WINDOW + 1
        window = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0x9DDFEA08EB382D69) + words[k : k + n]
        window = mixed(window) + mixed(doc[:n].astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        order = at[np.argsort(window[at])]
        same = window[order[1:]] == window[order[:-1]]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
        cover = np.bincount(twice, minlength=len(words) + 1) - np.bincount(twice + WINDOW, minlength=len(words) + 1)
        repeated = np.cumsum(cover)[:-1] > 0

    feeds = np.flatnonzero(buf == 10)
    line_starts = np.concatenate([[0], feeds[:-1] + 1])
    filled = np.concatenate([[0], np.cumsum(~blank)])
    line_doc = np.searchsorted(stops, line_starts, "right")
    with_word = filled[feeds] > filled[line_starts]
    a, b = line_starts[with_word], feeds[with_word]
    lines = mixed(sums.hash(a, b) + (b - a).astype(np.uint64)) + mixed(line_doc[with_word].astype(np.uint64) + np.uint64(1))
    _, first = np.unique(lines, return_index=True)
    later = np.ones(len(lines), bool)
    later[first] = False

    upper = np.concatenate([[0], np.cumsum(UPPER[buf])])
    lower = np.concatenate([[0], np.cumsum(LOWER[buf])])
    capital = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    bar = (ends - starts == 1) & (buf[starts] == 124)
    stutter = np.zeros(len(words), bool)
    stutter[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    return np.stack(
        [per_doc(doc), count(~blank & ((buf & 0xC0) != 0x80)), count(SYMBOL[buf]), per_doc(line_doc[with_word]), per_doc(line_doc[with_word], later),
         per_doc(doc, repeated), per_doc(doc, capital), count(buf == 33), per_doc(doc, bar), per_doc(doc, stutter)]
    )


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(texts) for texts in text_slices(batch.column(1), 1 << 20)]
            made = np.concatenate(parts, axis=1) if parts else np.zeros((len(MEASURES), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made.astype(np.int64))], ["doc_id", *MEASURES])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame, rules: dict[str, str] | None = None, **columns: str) -> DataFrame:
    """doc_id, the measurements, and failed: bit k is set where the k-th rule fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate((rules or RULES).values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measurements(docs, **columns).withColumn("failed", failed)


def mask(names: tuple[str, ...], rules: dict[str, str] | None = None) -> int:
    at = list(rules or RULES)
    return sum(1 << at.index(n) for n in names)


def rejects(version: str, policies: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether the policy of that version rejects a row of a ledger."""
    return F.col("failed").bitwiseAND(F.lit(mask((policies or POLICIES)[version]))) != 0


def ablation(ledger_rows: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """For each policy and rule in it: rows failing the rule, rows rejected by it alone,
    rows the policy rejects, and rows it would reject without the rule."""
    policies, sums = policies or POLICIES, []
    for p, names in policies.items():
        hit = F.col("failed").bitwiseAND(F.lit(mask(names)))
        sums.append(F.count(F.when(hit != 0, 1)).alias(f"{p}:all"))
        for n in names:
            bit = F.lit(mask((n,)))
            sums += [F.count(F.when(hit.bitwiseAND(bit) != 0, 1)).alias(f"{p}:{n}:fail"), F.count(F.when(hit == bit, 1)).alias(f"{p}:{n}:only")]
    one = ledger_rows.agg(*sums)
    rows = [
        F.struct(F.lit(p).alias("policy"), F.lit(n).alias("rule"), F.col(f"`{p}:{n}:fail`").alias("failing"), F.col(f"`{p}:{n}:only`").alias("only_this"), F.col(f"`{p}:all`").alias("rejected"))
        for p, names in policies.items()
        for n in names
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*", (F.col("r.rejected") - F.col("r.only_this")).alias("rejected_without"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read_documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejects("base").alias("base_failed"), (~rejects("v2")).alias("kept"), "failed",
    )


QUERIES = {"op9_rule_ledger": op9_rule_ledger}
ORACLES: dict[str, str] = {}
