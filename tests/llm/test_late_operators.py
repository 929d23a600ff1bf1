"""Whitening, language identification and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdloom.llm import language, periodic, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("x", "v", "n", "g", "h", "a", "p", "words", "chosen", "runs", "top", "lang_pred", "score", "vec_id", "component")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING) + ", odd struct<`my-key`:int>"


# ---- periodic runs ----


def brute_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and not s[j:] < s[i:]:
            j += 1
        out.append(j - i)
    return out


def test_lyndon_arrays_of_all_suffix_orders():
    random.seed(1)
    for _ in range(800):
        s = [random.randint(1, random.randint(1, 4)) for _ in range(random.randint(1, 30))]
        assert periodic.lyndon_array(np.array([0, *s]))[1:].tolist() == brute_lyndon(s), s
    parts = [[random.randint(1, 2) for _ in range(9)] for _ in range(20)]
    joined = periodic.lyndon_array(np.array([x for p in parts for x in (0, *p)]))
    assert joined.reshape(20, 10)[:, 1:].tolist() == [brute_lyndon(p) for p in parts]


def brute_runs(w, shortest=24, times=3):
    out, n = [], len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            if e - s >= max(shortest, times * p) and next(q for q in range(1, p + 1) if all(w[x] == w[x + q] for x in range(s, e - q))) == p:
                out.append((s, e - s, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(most):
    w = []
    while len(w) < random.randint(0, most):
        piece = [random.randint(0, random.choice([1, 2, 9])) for _ in range(random.randint(1, 11))]
        w += (piece * random.randint(1, 9))[: random.randint(1, 70)]
    return w


def test_runs_of_many_texts():
    random.seed(2)
    seen = 0
    for _ in range(300):
        shortest, times = random.choice([(24, 3), (2, 2), (6, 2), (5, 3), (24, 2), (1, 4)])
        docs = [repetitive(100) for _ in range(3)]
        want, at = [], 0
        for w in docs:
            want += [(s + at, s + at + n, p) for s, n, p in brute_runs(w, shortest, times)]
            at += len(w)
        got = periodic.find_runs(np.array(sum(docs, []), np.int64), np.repeat(np.arange(3), [len(w) for w in docs]), shortest, times)
        assert [tuple(r) for r in got.tolist()] == want
        seen += len(want)
    assert seen > 1000


def test_runs_where_hashes_meet(monkeypatch):
    """With a hash that tells nothing apart, the comparison word by word still decides."""
    random.seed(3)
    monkeypatch.setattr(periodic.PrefixHash, "hash", lambda self, a, b: np.asarray(b) - np.asarray(a))
    for _ in range(60):
        w = repetitive(90)
        got = periodic.find_runs(np.array(w, np.int64), np.zeros(len(w), np.int64))
        assert {tuple(r) for r in got.tolist()} <= {(s, s + n, p) for s, n, p in brute_runs(w)}


def loops(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected_runs(doc_id, text):
    w = loops(doc_id, text)
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def awkward():
    random.seed(4)
    letters = {"en": "ethaoinsr", "el": "αβγδεηικλ", "de": "ensriäßtü"}
    word = lambda of: "".join(random.choice(letters[of]) for _ in range(random.randint(1, 7)))
    out = []
    for i in range(160):
        of = random.choice(list(letters))
        w = [word(of) for _ in range(random.randint(1, 150))]
        if i % 3 == 0:
            w += w[-random.randint(1, min(30, len(w))) :] * random.randint(2, 12)
        out.append([i, random.choice([" ", "\n", "\t \x0b"]).join(w), of, f"s{i % 4}"])
    out += [[200, None, "en", None], [201, "", None, "s"], [202, " \n\t ", "en", "s"], [None, out[0][1], None, "s"], [203, "12 34 !", "en", "s"], [204, "ab " * 700, None, "s"], [205, " x y " * 40, "en", "s"], [206, "İstanbul ﬁ ẞ " * 30, "de", "s"]]
    out += [list(out[0]), list(out[6])]
    return [(*r, len(r[1] or ""), *(f"{c}-{k % 3}" for c in CLASHING), (k,)) for k, r in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def test_op13(spark, folder, rows):
    got = [tuple(r) for r in periodic.op13_periodic_runs(spark, folder).collect()]
    key = lambda r: (str(r[0]), r[-1])
    want = [expected_runs(r[0], r[1]) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] for r in want) > 40 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)


def test_periodic_runs_of_empty_and_general(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(docs, 6, 2).collect()}
    for r in rows[:40]:
        w = WORD.findall(r[1] or "")
        runs = brute_runs(w, 6, 2)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert (r[0], len(w), tuple(runs), " ".join(x for i, x in enumerate(w) if i not in gone)) in got
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, times=1)


# ---- language identification ----


def plain_letters(text):
    out = [" "]
    for c in text:
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    return out + ([" "] if out[-1] != " " else [])


def plain_vector(text, vector, d):
    s, total = plain_letters(text), np.zeros(d)
    for (a, b, c), times in Counter(zip(s, s[1:], s[2:])).items():
        total += times * np.roll(vector(a), 2).astype(int) * np.roll(vector(b), 1) * vector(c)
    return total


def test_bundles_equal_plain_sums(rows):
    for d in (1024, 100):
        letters = language.Letters(d)
        vector = lambda c: letters.vectors(np.array([ord(c)]))[0]
        texts = [r[1] or "" for r in rows[:12]] + [r[1] or "" for r in rows[160:164]]
        for few in (1 << 22, 1):
            got = letters.bundle([t.encode() for t in texts])
            for t, v in zip(texts, got, strict=True):
                assert (v == plain_vector(t, vector, d)).all()
            language.GRAMS = 50 if few == 1 << 22 else 4096  # the second time in blocks
        language.GRAMS = 4096


def test_op12(spark, folder, rows):
    got = language.op12_hyperdimensional_language(spark, folder)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.collect()
    assert len(got) == len(rows)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    d, letters = language.DIMENSIONS, language.Letters()
    known: dict[str, np.ndarray] = {}
    vector = lambda c: known.setdefault(c, letters.vectors(np.array([ord(c)]))[0])
    names = sorted({r[2] for r in rows if r[2] and r[1] is not None and not out(r[0])})
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    sums = [unit(sum(plain_vector(r[1], vector, d) for r in rows if r[2] == n and r[1] is not None and not out(r[0]))) for n in names]
    ways = [unit(s - sum(sums) / len(sums)) for s in sums]
    texts: dict = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    for r in got:
        assert r.held_out == out(r.doc_id)
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = [float(unit(plain_vector(text, vector, d)) @ w) for w in ways]
        assert r.lang_pred == names[int(np.argmax(cos))] and math.isclose(r.score, min(1.0, max(0.0, max(cos))), abs_tol=1e-6)
    right = [r.lang_pred == next(x[2] for x in rows if x[0] == r.doc_id) for r in got if r.held_out and r.doc_id < 160]
    assert sum(right) >= 0.95 * len(right) and len(right) > 20


def test_language_without_labels(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, model).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), language.fit(docs)).collect() == []
    with pytest.raises(ValueError):
        language.fit(docs, most=1)
    one = language.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language.predict(docs, one).collect()} == {"en", "und"}


# ---- whitening ----

VECTORS = "vec_id long, embedding array<float>, x string, v string, n string, component string, odd struct<`my-key`:int>"


def vectors(d=10, n=300, tied=True):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3
    if tied:
        base[:, 3] = 0.5  # constant
        base[:, 5] = np.floor(64 * base[:, 4]) / 64  # the same whole numbers
    out = [(i, [float(c) for c in r]) for i, r in enumerate(base)]
    return out + [(None, out[0][1]), (7, out[1][1]), (7, out[1][1]), (900, None), (901, []), (902, [None] + out[2][1][1:]), (903, [float("nan")] + out[2][1][1:]), (904, [float("-inf")] + out[2][1][1:]), (905, out[2][1][:4])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", (1,)) for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("tied", [True, False])
def test_op11(spark, tmp_path, tied):
    rows, d = vectors(tied=tied), 10
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op11_cholesky_whitening(spark, str(tmp_path)).collect()
    fine = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in fine}))
    n, s = len(fit), fit.sum(axis=0)
    x = (n * fit - s) / n
    e, ways = np.linalg.eigh(x.T @ x / n)
    rank = 8 if tied else d
    e, ways = e[::-1][:rank], ways[:, ::-1][:, :rank]
    assert len(got) == len(fine) * rank and {r.n for r in got} == {n}
    assert {r.component for r in got} == set(range(1, rank + 1)) and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by: dict = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = np.ones(rank)
    plain = {i: ((n * np.array(v) - s) / n @ ways / np.sqrt(e), sum((n * a - int(b)) ** 2 for a, b in zip(v, s, strict=True))) for i, v in fine if i != 7}
    for c in range(rank):
        i = max(plain, key=lambda i: abs(plain[i][0][c]))
        signs[c] = np.sign(by[(i, c + 1)][0].whitened * plain[i][0][c])
    for i, (w, deviation) in plain.items():
        for c in range(rank):
            (r,) = by[(i, c + 1)]
            assert abs(r.whitened - signs[c] * w[c]) < 1e-8 and r.deviation == deviation and math.isclose(r.explained, e[c] / np.trace(x.T @ x / n), rel_tol=1e-9)
    assert len(by[(7, 1)]) == 3


def test_whitening_of_little(spark):
    assert whitening.whitened_embeddings(frame(spark, []).limit(0)).collect() == []
    assert whitening.whitened_embeddings(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whitened_embeddings(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []
    two = whitening.whitened_embeddings(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])])).orderBy("vec_id").collect()
    assert [(r.component, r.n, round(abs(r.whitened), 12), int(r.deviation), round(r.explained, 12)) for r in two] == [(1, 2, 1.0, 64 * 64, 1.0)] * 3
    huge = whitening.whitened_embeddings(frame(spark, [(1, [1e15, 1.0]), (2, [-1e15, 3.0]), (3, [5.0, 2.0])])).collect()
    assert len(huge) == 3 and all(math.isfinite(r.whitened) for r in huge)
    with pytest.raises(ValueError):
        whitening.whitened_embeddings(frame(spark, [(1, [0.0, 1.0])]), most=1)
