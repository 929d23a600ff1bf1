"""Language identification by hyperdimensional profiles.

Every letter has a vector of random signs, drawn from its code point alone. Three letters in
a row are bound into one vector: the first's permuted (rotated) twice, the second's once,
the third's as it is, multiplied. All of a text's trigrams are bundled (added) into its
vector, all of a language's training texts into its prototype, and a text gets the language
whose prototype, less the mean of all, makes the smallest angle with its vector.

Letters are Unicode letters in lower case; a stretch of anything else counts as one blank,
and a text has a blank at either end. Prototypes are exact sums over all training texts,
whatever their order: tasks add up their texts, Spark adds up the tasks. They are as many
numbers as languages times DIMENSIONS; more than `most` languages raise an error.

Defined results: a null text or one without a letter gets `und` and score 0, also where
nothing could be learnt; so does a text whose vector is at right angles to, or further from,
every prototype only in its score (0); equal angles go to the least language by code point.
Ids may be null (never held out) or repeat: a row of the result stands for a row of the
table. Only id, text and language are read, so other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, read_documents, text_slices

DIMENSIONS, SEED, MOST = 1024, 12, 4096
#: Texts and trigrams worked on at once.
TEXTS, GRAMS = 256, 4096
BLANK = 32


class Letters:
    """Code points to their letters (others: BLANK), and letters to their vectors."""

    table: np.ndarray | None = None

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        if Letters.table is None:
            Letters.table = np.fromiter((ord(chr(c).lower()[0]) if chr(c).isalpha() else BLANK for c in range(0x110000)), np.uint32, 0x110000)

    def vectors(self, points: np.ndarray) -> np.ndarray:
        """One row of signs for each code point, from hashes of its number and the place."""
        words = (self.dimensions + 63) // 64
        keys = mixed(points.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(self.seed))
        bits = mixed(keys[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return 1 - 2 * np.unpackbits(bits.view(np.uint8), axis=1)[:, : self.dimensions].astype(np.int8)

    def trigrams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(points, grams, doc, gram): the distinct letters; the distinct trigrams as places in
        points; and for each trigram of the texts, its text and its place in grams."""
        wide = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        blank = np.array([BLANK], np.uint32)
        all_points = Letters.table[np.concatenate([p for w in wide for p in (blank, w, blank)] or [blank[:0]])]
        doc = np.repeat(np.arange(len(texts)), [len(w) + 2 for w in wide])
        keep = np.ones(len(all_points), bool)
        keep[1:] = (all_points[1:] != BLANK) | (all_points[:-1] != BLANK) | (doc[1:] != doc[:-1])
        all_points, doc = all_points[keep], doc[keep]
        points = np.flatnonzero(np.bincount(all_points, minlength=BLANK + 1)) if len(all_points) else np.zeros(0, np.int64)
        letter = np.searchsorted(points, all_points)
        k, n = len(points), len(all_points)
        if n < 3:
            return points, np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = (letter[:-2] * k + letter[1:-1]) * k + letter[2:]
        whole = doc[:-2] == doc[2:]
        code, doc = code[whole], doc[:-2][whole]
        if k**3 <= 1 << 22:
            codes = np.flatnonzero(np.bincount(code, minlength=1))
            gram = np.searchsorted(codes, code)
        else:
            codes, gram = np.unique(code, return_inverse=True)
        return points, np.stack([codes // (k * k), codes // k % k, codes % k], axis=1), doc, gram

    def bundle(self, texts: list[bytes], owner: np.ndarray | None = None, n: int | None = None) -> np.ndarray:
        """The vectors of the texts or, where owner numbers them from 0 to n - 1, the sums of
        each owner's (owner -1: left out). Sums are of whole numbers below 2**24 a text."""
        points, grams, doc, gram = self.trigrams(texts)
        n = len(texts) if n is None else n
        doc = doc if owner is None else owner[doc]
        gram, doc = gram[doc >= 0], doc[doc >= 0]
        out = np.zeros((n, self.dimensions), np.float64)
        if not len(gram):
            return out
        one = self.vectors(points)
        two, three = np.roll(one, 1, axis=1), np.roll(one, 2, axis=1)
        order = np.argsort(gram, kind="stable") if len(grams) > GRAMS else None
        gram, doc = (gram, doc) if order is None else (gram[order], doc[order])
        for first in range(0, len(grams), GRAMS):
            g = grams[first : first + GRAMS]
            a, b = (0, len(gram)) if order is None else np.searchsorted(gram, [first, first + len(g)])
            counts = np.bincount(doc[a:b] * len(g) + gram[a:b] - first, minlength=n * len(g)).reshape(n, len(g))
            bound = three[g[:, 0]] * two[g[:, 1]] * one[g[:, 2]]
            # Exact in single precision while a row's counts stay below 2**24.
            kind = np.float32 if counts.sum(axis=1).max() < 1 << 24 else np.float64
            out += counts.astype(kind) @ bound.astype(kind)
        return out


def fit(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, most: int = MOST) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from text and lang of all rows; rows without either do not
    count. The languages are counted first; more than most raise an error."""
    rows = labelled.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} languages")
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = Letters(dimensions, seed), np.zeros((len(names), dimensions))
        for batch in batches:
            owner, done = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64), 0
            for texts in text_slices(batch.column(1), 1 << 20):
                total += letters.bundle(texts, owner[done : done + len(texts)], len(names))
                done += len(texts)
        for i in np.flatnonzero(np.abs(total).any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dimensions, i, np.int32)), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total[i].astype(np.int64))], ["language", "place", "value"])

    sums = rows.mapInArrow(run, "language int, place int, value long").groupBy("language", "place").agg(F.sum("value").alias("value"))
    prototypes = np.zeros((len(names), dimensions))
    for r in sums.collect():  # as many numbers as languages times dimensions
        prototypes[r.language, r.place] = r.value
    return names, prototypes


def directions(prototypes: np.ndarray) -> np.ndarray:
    """Unit prototypes less their mean (where there are several), as units again."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    units = unit(prototypes)
    return unit(units - units.mean(axis=0)) if len(units) > 1 else units


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score: the cosine with the language's prototype, at least 0."""
    names, ways = model[0], directions(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dimensions, seed)
        for batch in batches:
            done = 0
            for some in text_slices(batch.column(1), 1 << 20):
                for first in range(0, len(some), TEXTS):
                    texts = some[first : first + TEXTS]
                    vectors = letters.bundle(texts)
                    size = np.linalg.norm(vectors, axis=1)
                    cosines = vectors @ ways.T / np.maximum(size, 1e-300)[:, None] if names else np.zeros((len(texts), 1))
                    best = np.argmax(cosines, axis=1)
                    known = (size > 0) & bool(names)
                    said = [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                    score = np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(said, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
                    done += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> F.Column:
    """One document in four, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op12_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return predict(docs, fit(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op12_hyperdimensional_language": op12_hyperdimensional_language}
ORACLES: dict[str, str] = {}
