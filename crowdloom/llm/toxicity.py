"""Severity of toxic language by cumulative-link ordinal regression.

P(grade <= k | x) = logistic(theta_k - w.x): one weight vector is shared by all grades,
the ordered thresholds alone tell them apart. x marks which words and word beginnings of a learnt
vocabulary a text has (beginnings catch inflected and compounded forms never seen). Fitting takes a bounded sample of labelled rows (max_rows, by hash of the id);
scoring reads every document whole and returns P(grade > k), their sum (the expected
severity) and a verdict.

Grades come from the binary labels: 0 is not toxic; toxic rows are graded 1 to 3 by thirds
of the number of distinct toxic-leaning words they hold.

Defined results: null and empty texts have no marks and get the base rate's severity, so
they pass; null ids stay null and repeated rows are scored each; rows of labels with a null
are not used; without both kinds of label there is no model and every severity is 0; an
empty table gives no rows; other columns of docs are carried by reject_toxic untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType

from .common import numbered, read_documents

SCORES = {"expected_severity": DoubleType(), "p_toxic": DoubleType(), "grade": IntegerType(), "rejected": BooleanType()}
WORDS = re.compile(r"\w+")
PREFIXES = (4, 5, 6)


def words(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def features(of: set[str]) -> set[str]:
    """The words, and their beginnings of PREFIXES letters with a mark that no word has."""
    return of.union(*({w[:n] + "-" for w in of} for n in PREFIXES))


@dataclass
class OrdinalModel:
    """vocabulary word -> place of its weight; thresholds ascend."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for each text (rows) and threshold k (columns)."""
        if not len(self.thresholds):
            return np.zeros((len(texts), 1))
        known = self.vocabulary.keys()
        score = np.array([self.weights[[self.vocabulary[w] for w in features(words(t)) & known]].sum() for t in texts])
        return 1 / (1 + np.exp(np.clip(self.thresholds - score.reshape(-1, 1), -30, 30)))


def fit(spark_docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, min_rows_with_word: int = 5, max_words: int = 2_000, steps: int = 600) -> OrdinalModel:
    """Fits on at most max_rows labelled documents, all that the driver ever holds."""
    some = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    # Of rows that repeat an id one text counts, the same in every run, so no more than max_rows come.
    one = spark_docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some.distinct()), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = one.select("doc_id", "toxic", "text").mapInArrow(_word_lists, "doc_id long, toxic int, words array<string>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    toxic = np.array(rows.column("toxic").to_pylist(), bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return OrdinalModel({}, np.zeros(0), np.zeros(0))
    return fit_words((set(x.as_py()) for x in rows.column("words")), toxic, min_rows_with_word, max_words, steps)


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), pa.array([sorted(words(t)) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], ["doc_id", "toxic", "words"])


def fit_words(texts: Iterable[set[str]], toxic: np.ndarray, min_rows_with_word: int = 5, max_words: int = 2_000, steps: int = 600) -> OrdinalModel:
    number: dict[str, int] = {}
    held = [np.array(sorted(number.setdefault(f, len(number)) for f in features(t)), np.int32) for t in texts]
    row, col = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held)
    n, n_toxic = len(toxic), int(toxic.sum())
    rows_with = np.bincount(col, minlength=len(number))
    expected = rows_with * n_toxic / n
    # The signed root of chi-square against independence, words in enough rows only.
    lean = (np.bincount(col[toxic[row]], minlength=len(number)) - expected) / np.sqrt(expected * (1 - n_toxic / n) * (1 - rows_with / n) + 1e-9)
    names = sorted(number)
    by_name = np.array([number[w] for w in names], int)
    good = by_name[(rows_with[by_name] >= min_rows_with_word) & (np.abs(lean[by_name]) > 4.5)]
    chosen = good[np.argsort(-np.abs(lean[good]), kind="stable")][:max_words]
    place = np.full(len(number), -1)
    place[chosen] = np.arange(len(chosen))
    hits = np.bincount(row, (place[col] >= 0) & (lean[col] > 6), n)
    grade = np.zeros(n, int)
    thirds = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    grade[toxic] = 1 + np.searchsorted(thirds, hits[toxic], "left")
    used = place[col] >= 0
    vocabulary = {w: int(place[k]) for w, k in zip(names, by_name, strict=True) if place[k] >= 0}
    return OrdinalModel(vocabulary, *_descend(row[used], place[col[used]], grade, len(chosen), steps))


def _descend(row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_words: int, steps: int, ridge: float = 5e-5, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam. Thresholds are a first one and positive gaps."""
    n, levels = len(grade), int(max(1, grade.max()))
    at = np.zeros(n_words + levels)
    share = np.clip([(grade <= k).mean() for k in range(levels)], 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    at[n_words] = start[0]
    at[n_words + 1 :] = np.log(np.maximum(np.diff(start), 1e-2))
    first, second = np.zeros_like(at), np.zeros_like(at)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        gaps = np.exp(at[n_words + 1 :])
        theta = at[n_words] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, at[col], n)
        up = np.where(grade < levels, sigmoid(np.append(theta, 0)[np.minimum(grade, levels)] - score), 1.0)
        down = np.where(grade > 0, sigmoid(theta[np.maximum(grade, 1) - 1] - score), 0.0)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        g = np.zeros_like(at)
        g[:n_words] = np.bincount(col, (d_up - d_down)[row], n_words) / n + 2 * ridge * at[:n_words]
        by_theta = np.array([-(d_up[grade == k].sum() - d_down[grade == k + 1].sum()) / n for k in range(levels)])
        g[n_words] = by_theta.sum()
        g[n_words + 1 :] = np.cumsum(by_theta[::-1])[::-1][1:] * gaps
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        at -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return at[:n_words].copy(), at[n_words] + np.concatenate([[0], np.cumsum(np.exp(at[n_words + 1 :]))])


def score(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """All columns of docs and, last, SCORES. A document is rejected if P(grade > 0)
    reaches the threshold."""
    names = docs.columns
    text = names.index("text")
    schema = numbered(docs)
    for name, kind in SCORES.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exceed = np.concatenate([np.zeros((0, max(1, len(model.thresholds)))), *(model.exceed(batch.column(text).slice(at, 256).to_pylist()) for at in range(0, batch.num_rows, 256))])
            at_least_one = exceed[:, 0] if len(exceed) else np.zeros(0)
            made = [pa.array(exceed.sum(axis=1)), pa.array(at_least_one), pa.array((exceed >= 0.5).sum(axis=1).astype(np.int32)), pa.array(at_least_one >= threshold)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*(f"c{k}" for k in range(len(names))), "expected_severity", "p_toxic", "grade", "rejected"])

    return docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, **how: int) -> DataFrame:
    """The documents that the model doesn't reject, in docs' columns."""
    names = docs.columns
    kept = score(docs, fit(docs, labels, **how)).where("not rejected")
    return kept.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(F.col("c0").alias("doc_id"), "expected_severity", "p_toxic", "grade", "rejected")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
