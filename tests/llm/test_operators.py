"""Each corpus operator against brute force on small awkward tables."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crowdloom.llm import chat, components, media, mixing, neardup, packing, private, quality, repeats, token_counts, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns beyond those of documents, whose names the operators might use themselves.
CLASHING = ("size", "rid", "uid", "copies", "target", "epochs", "prefix", "last", "budget", "source_size", "part", "root", "anchor", "pivot", "key")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def corpus():
    random.seed(5)
    words = ["".join(random.choice("abcdeéß") for _ in range(random.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    out, passage = [], text(60)
    for i in range(60):
        out.append([i, text(random.randint(5, 120)), "en", f"s{i % 4}"])
    for i in range(60, 75):
        base = out[i - 60][1].split(" ")
        for _ in range(len(base) // 40):
            base[random.randrange(len(base))] = random.choice(words)
        out.append([i, " ".join(base), "en", "s0"])
    for i in range(75, 90):
        out.append([i, text(20) + " " + passage + "\n" + text(20), "de", "s1"])
    out += [[90, None, None, None], [91, "", "en", "s2"], [92, " \n\t ", "en", "s2"], [None, out[3][1], "en", None], [94, "one", "en", "s3"], [95, "ab" * 300, "en", "s3"], [96, text(9000), "en", "s3"]]
    out += [list(out[7]), list(out[7]), list(out[91])]
    return [(*r, len(r[1]) if r[1] is not None else None, *(f"{c}-{k % 5}" for c in CLASHING)) for k, r in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, rows, empty):
    sized, limits, small = mixing.plan_mix(mixing.with_keys(docs))
    got = mixing.with_takes(sized, limits, small).collect()
    assert len(got) == len(rows)
    sizes, took, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source"]] += r["__mix_size"]
        took[r["source"]] += r["__mix_size"] * r["__mix_copies"]
        target[r["source"]] = r["__mix_target"]
        assert 0 <= r["__mix_copies"] <= 2
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(names, [5, 2, 1] * 3, strict=False))
    want, free = {}, set(names)
    left = 1.5 * sum(sizes.values())
    while True:  # share by weight, stop at twice the source, share the rest again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    largest = max(len(WORD.findall(r[1] or "")) for r in rows)
    for s in names:
        assert abs(want[s] - target[s]) < 1e-6 * max(1, want[s])
        assert abs(took[s] - target[s]) <= largest
    mixed = mixing.mix(docs)
    out = collections.Counter(map(tuple, mixed.collect()))
    assert mixed.columns == docs.columns and sum(out.values()) == sum(r["__mix_copies"] for r in got)
    assert all(out[r] <= 2 * n for r, n in collections.Counter(rows).items()) and set(out) <= set(rows)  # every value as it was
    by_rank = mixing.mix(docs, quality=F.when(F.col("source") == "s1", 4.0).otherwise(F.lit(None)))
    assert set(map(tuple, by_rank.collect())) <= set(rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_takes_part_of_alike_rows(spark):
    """A hundred equal rows in each of four sources: as near the target as one row allows."""
    docs = spark.createDataFrame([(7, "one two three four five", s) for s in "abcd" for _ in range(100)], "doc_id long, text string, source string").repartition(5)
    sized, limits, small = mixing.plan_mix(mixing.with_keys(docs))
    got = mixing.with_takes(sized, limits, small).collect()
    took, target = collections.Counter(), {}
    for r in got:
        took[r["source"]] += r["__mix_size"] * r["__mix_copies"]
        target[r["source"]] = r["__mix_target"]
        assert r["__mix_copies"] <= 2
    assert len(got) == 400 and sum(target.values()) == 3000 and all(abs(took[s] - target[s]) <= 2.5 for s in "abcd")
    assert collections.Counter(r["source"] for r in mixing.mix(docs).collect()) == {s: n // 5 for s, n in took.items()}


def test_columns_that_no_schema_text_can_spell(spark):
    """A struct column with a name such as my-key is carried by every stage."""
    docs = spark.createDataFrame([(k, f"write to me{k}@example.org or not at all", "en", "s", 9, (k,)) for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long, `odd one` struct<`my-key`:int>")
    labels = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    passed = toxicity.reject_toxic(docs, labels)
    redacted = private.redact(passed, None)
    assert redacted.columns == docs.columns and sorted((r["odd one"]["my-key"], r["text"]) for r in redacted.collect()) == [(k, "write to [EMAIL] or not at all") for k in range(4)]
    pieces = redacted.select("doc_id", F.lit(0).alias("piece"), F.lit(5).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"), "odd one")
    assert {r["odd one"]["my-key"] for r in packing.pack(pieces).collect()} == {0, 1, 2, 3}


def plain_loss(x, grade, weights, thresholds, ridge):
    """Of the cumulative-link model, row by row."""
    s = lambda z: 1 / (1 + np.exp(-z))
    total = 0.0
    for row, g in zip(x, grade, strict=True):
        score = row @ weights
        p = (s(thresholds[g] - score) if g < len(thresholds) else 1.0) - (s(thresholds[g - 1] - score) if g > 0 else 0.0)
        total -= np.log(max(p, 1e-12))
    return total / len(x) + ridge * (weights**2).sum()


def test_severity_is_the_minimum_of_the_plain_likelihood():
    """_descend ends where no small step of any weight or threshold lowers a loss written out."""
    rng = np.random.default_rng(7)
    x = (rng.random((300, 6)) < 0.3).astype(float)
    grade = np.digitize(x @ [2, 1.5, 1, 0, 0, -1] + rng.logistic(size=300), [1, 2.2, 3.5])
    row, col = np.nonzero(x)
    weights, thresholds = toxicity._descend(row, col, grade, 6, 3000, ridge=1e-3, rate=0.02)
    best = plain_loss(x, grade, weights, thresholds, 1e-3)
    for k in range(6):
        for step in (-0.02, 0.02):
            assert plain_loss(x, grade, weights + step * (np.arange(6) == k), thresholds, 1e-3) > best - 1e-7
    for k in range(3):
        for step in (-0.02, 0.02):
            assert plain_loss(x, grade, weights, thresholds + step * (np.arange(3) == k), 1e-3) > best - 1e-7
    assert weights[0] > weights[1] > weights[2] > 0 > weights[5]


def test_scores_follow_from_the_model(spark):
    """Registered columns by hand: P(grade > k) from the summed weights, their sum, the grade."""
    model = toxicity.OrdinalModel({"bad": 0, "worse": 1, "bad-": 2}, np.array([1.5, 2.0, 0.5]), np.array([1.0, 2.5, 4.0]))
    texts = [None, "", "Bad day", "worse, BAD; worse", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in toxicity.score(docs, model).collect():
        have = set(re.findall(r"\w+", (texts[r["c0"]] or "").lower()))
        score = (1.5 + 0.5) * ("bad" in have) + 2.0 * ("worse" in have)  # a short word is its own beginning
        exceed = [1 / (1 + np.exp(t - score)) for t in (1.0, 2.5, 4.0)]
        assert abs(r["expected_severity"] - sum(exceed)) < 1e-12 and abs(r["p_toxic"] - exceed[0]) < 1e-12
        assert r["grade"] == sum(e >= 0.5 for e in exceed) and r["rejected"] == (exceed[0] >= 0.5)


def test_the_toxic_sample_is_the_same_whatever_repeats(spark):
    rows = [(k, f"word{k % 7} " + ("grumbok snarv" if k % 4 == 0 else "plain talk")) for k in range(60)]
    again = rows + [(k, t + " again") for k, t in rows[:20]]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)] * 2, "doc_id long, toxic int")
    a, b = (toxicity.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels, min_rows_with_word=2) for x, n in ((again, 3), (again[::-1], 5)))
    assert a.vocabulary == b.vocabulary and len(a.vocabulary) > 0 and (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_mixing_draws_by_quality(spark):
    text = F.when(F.col("id") % 2 == 0, F.lit("plain words of a usual kind")).otherwise(F.lit("a# b$ 1% 22 | ++ 9"))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("a").alias("source"))
    kept = mixing.mix(docs, share=0.3).groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    n = {r["odd"]: r["count"] for r in kept}
    assert n[0] > 4 * n.get(1, 0)


def test_radix_draw_matches_a_full_sort(spark):
    random.seed(1)
    docs = spark.createDataFrame([(i, "w " * random.randint(1, 30), "a" if i % 3 else "b") for i in range(3000)], "doc_id long, text string, source string")
    sized, limits, small = mixing.plan_mix(mixing.with_keys(docs), weights=(1.0,), share=0.7)
    got = mixing.with_takes(sized, limits, small).toPandas()
    for _, g in got.groupby("source"):
        g = g.sort_values("__mix_key")
        upto = g["__mix_size"].cumsum()
        budget = g["__mix_target"].iloc[0]
        want = upto - budget <= budget - upto + g["__mix_size"]
        assert (g["__mix_copies"].astype(bool) == want).all()


def plain_codes(samples):
    """Codes by sums over plain frames and boxes, no integral image."""
    x = np.frombuffer(samples, np.uint8).astype(float)
    if not len(x):
        return []
    x = np.concatenate([x, np.full(max(0, media.FRAME - len(x)), 128.0)])
    frames = []
    for at in range(0, len(x) - media.FRAME + 1, media.HOP):
        power = np.abs(np.fft.rfft((x[at : at + media.FRAME] - 128) * np.hanning(media.FRAME))) ** 2
        classes = [0.0] * 12
        for k, p in enumerate(power):
            f = k * media.RATE / media.FRAME
            if 60 <= f <= 3600:
                classes[round(12 * np.log2(f / 440)) % 12] += p
        norm = max(sum(c * c for c in classes) ** 0.5, 1e-6)
        frames.append([c / norm for c in classes])
    frames += [[0.0] * 12] * (media.SPAN - len(frames))
    out = []
    for at in range(len(frames) - media.SPAN + 1):
        box = lambda c, w, t, d: sum(frames[at + i][j] for i in range(t, t + d) for j in range(c, c + w))  # noqa: B023, E731
        code = []
        for c, w, t, d, how in media.FILTERS:
            if how == "c":
                a, b = box(c, w // 2, t, d), box(c + w // 2, w - w // 2, t, d) * (w // 2) / (w - w // 2)
            elif how == "f":
                a, b = box(c, w, t, d // 2), box(c, w, t + d // 2, d - d // 2) * (d // 2) / (d - d // 2)
            else:
                a, b = box(c, w, t + d // 3, d // 3), (box(c, w, t, d // 3) + box(c, w, t + 2 * (d // 3), d // 3)) / 2
            v = np.log((1 + a) / (1 + b))
            code.append((0, 1, 3, 2)[sum(v >= x for x in (-0.1, 0.0, 0.1))])
        out.append(sum(v << (2 * (15 - k)) for k, v in enumerate(code)))
    return out


def test_codes_against_plain_sums():
    random.seed(2)
    t = np.arange(4000)
    tune = (128 + 100 * np.sin(2 * np.pi * t * (220 + 40 * (t // 800)) / 8000)).astype(np.uint8).tobytes()
    for samples in (tune, random.randbytes(3000), random.randbytes(300), b"abc", b"", "a plain text is media too, ".encode() * 60):
        got, want = media.codes(media.chroma(np.frombuffer(samples, np.uint8))), np.array(plain_codes(samples), np.uint32)
        assert len(got) == len(want)
        assert np.bitwise_count(got ^ want).sum() <= 0.01 * 32 * len(got)  # float32 against float64 at the borders of levels


def aligned_classes(prints, least_errors=0.15):
    """Classes by trying all pairs at all offsets."""
    up = list(range(len(prints)))

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for x, a in enumerate(prints):
        for y in range(x):
            b = prints[y]
            for o in range(media.LEAST - len(a), len(b) - media.LEAST + 1):
                n, _, bits = media.overlap(a, b, o)
                if n >= media.LEAST and bits <= least_errors * 32 * n:
                    up[root(x)] = root(y)
    low = {}
    for v in range(len(prints)):
        low.setdefault(root(v), v)
    return [low[root(v)] for v in range(len(prints))]


@pytest.mark.parametrize("block, block_codes", [(3, 1 << 20), (1024, 1 << 20), (1024, 100)])
def test_media_against_all_pairs(spark, block, block_codes):
    random.seed(11)
    noise = random.randbytes
    shared, table = noise(2800), []
    for _ in range(24):
        table.append(noise(3200) + shared + noise(3200))  # one passage in all of them, too short to align
    for u in range(6, 14):
        table.append(table[u][640:] + noise(256))  # true partners, later than the passage's least holder
    table += [table[20], table[20], b"", b"abc", b"abc", b"abd", noise(1500), noise(1300)]
    rows = [(u, u, bytearray(m)) for u, m in enumerate(table)] + [(90, 90, None)]
    got = {r["doc_id"]: r for r in media.align(spark.createDataFrame(rows, "uid long, doc_id long, media binary").repartition(3), block=block, block_codes=block_codes).collect()}
    prints = [media.codes(media.chroma(np.frombuffer(m, np.uint8))) for m in table]
    want = aligned_classes(prints)
    want[36] = 35  # equal clips too short for keys
    assert [got[u]["class_id"] for u in range(len(table))] == want and len(got) == len(rows)
    assert got[90]["class_id"] == 90 and got[90]["n_codes"] == 0
    assert all(got[u]["aligned"] == (want.count(want[u]) > 1) for u in range(len(table)))
    for u in range(24, 32):
        assert (got[u]["partner"], got[u]["offset"], got[u]["bit_errors"] < 0.15) == (u - 18, 10, True)
    for u, r in got.items():
        if r["aligned"] and r["n_codes"] >= media.LEAST:
            n, same, bits = media.overlap(prints[u], prints[r["partner"]], r["offset"])
            assert (same, bits / (32 * n)) == (r["votes"], r["bit_errors"])
    assert not any(got[u]["aligned"] for u in (0, 5, 34, 37, 38, 39))


def test_media_query_tries_every_shared_key(spark, tmp_path):
    """Texts that align and share keys, but none of those that one in four picks."""
    table = []
    keys = lambda m, one_in: set(media.picked_keys([media.codes(media.chroma(np.frombuffer(m[p:], np.uint8))) for p in (0, *media.PHASES)], one_in)[0].tolist())
    prints = lambda m: media.codes(media.chroma(np.frombuffer(m, np.uint8)))
    for seed in range(4000):
        random.seed(seed)
        a = bytes(random.choices(range(32, 127), k=2600))
        b = a[:2400] + bytes(random.choices(range(32, 127), k=200))
        n, _, bits = media.overlap(prints(a), prints(b), 0)
        if bits <= 0.15 * 32 * n and keys(a, 1) & keys(b, 1) and not keys(a, 4) & keys(b, 4):
            table += [a, b]
        if len(table) == 6:
            break
    assert len(table) == 6
    rows = [(u, m.decode(), "s", "en") for u, m in enumerate(table)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in media.op2_chroma_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_media_writes_no_keys(spark, docs, monkeypatch):
    """Keys of all recordings take several times the room of their codes: none are kept, and
    only those with several holders come out of their one shuffle, hot or not."""
    wide, settle = [], media.settle

    def seen(df, name):
        wide.extend(name for c in df.columns if c in ("keys", "places"))
        return settle(df, name)

    monkeypatch.setattr(media, "settle", seen)
    assert media.align(media.texts_as_media(docs), one_in=1).count() == docs.count() and not wide
    random.seed(6)
    rows = {(u, random.randrange(40) if u % 3 else 1000 + u): u % 7 for u in range(300)}
    picks = spark.createDataFrame([(u, k, at) for (u, k), at in rows.items()], "uid long, key long, at int")
    least = {}
    for (u, k), at in sorted(rows.items()):
        least.setdefault(k, (u, at))
    want = sorted({(u, least[k][0], least[k][1] - at) for (u, k), at in rows.items() if u != least[k][0]})
    for hot in (4, 6, 20_000):  # all keys with several holders, some and none by the broadcast
        assert sorted(tuple(r) for r in media.shared(picks, hot=hot, sample=1).collect()) == want


def test_media_recall(spark, docs, rows, empty):
    """Default terms on shifted, cut and noisy copies of tunes: at least 0.9 found."""
    rng = np.random.default_rng(3)

    def tune():
        notes = rng.integers(0, 36, 40)
        t = np.arange(800)
        return np.concatenate([128 + 60 * np.sin(2 * np.pi * t * 110 * 2 ** (n / 12) / 8000) + rng.normal(0, 2, 800) for n in notes]).clip(0, 255).astype(np.uint8)

    tunes = [tune() for _ in range(60)]
    table, true = [t.tobytes() for t in tunes], []
    for k, t in enumerate(tunes):
        kind = k % 4
        noisy = (t.astype(float) + rng.normal(0, 1.5, len(t))).clip(0, 255).astype(np.uint8)
        copy = [t[64 * 30 :], np.concatenate([rng.integers(0, 256, 64 * 40).astype(np.uint8), t]), noisy, noisy[64 * 50 : -64 * 50]][kind]
        true.append((len(table), k))
        table.append(copy.tobytes())
    got = {r["doc_id"]: r["class_id"] for r in media.align(spark.createDataFrame([(u, u, bytearray(m)) for u, m in enumerate(table)], "uid long, doc_id long, media binary")).collect()}
    found = sum(got[a] == got[b] for a, b in true)
    assert found >= 0.9 * len(true), found
    assert len(set(got.values())) >= 60  # no two tunes joined
    # Cut at any sample, so that no frames need fall together: by a quarter hop, by half a hop
    # (the worst), by three quarters, and anywhere.
    for shift in (16, 32, 48, None):
        cuts = [64 * 20 + (shift if shift is not None else int(rng.integers(0, 64))) for _ in range(40)]
        table = [t.tobytes() for t in tunes[:40]] + [t[c:].tobytes() for t, c in zip(tunes, cuts, strict=False)]
        got = {r["doc_id"]: r["class_id"] for r in media.align(spark.createDataFrame([(u, u, bytearray(m)) for u, m in enumerate(table)], "uid long, doc_id long, media binary")).collect()}
        assert sum(got[k] == got[40 + k] for k in range(40)) >= 37, shift
    out = media.align(media.texts_as_media(docs)).collect()
    assert len(out) == len(rows) and media.align(media.texts_as_media(empty)).count() == 0


def test_toxicity_held_out():
    random.seed(4)
    words = [f"w{k}" for k in range(400)]
    bad = ["grumbok", "snarv", "plint"]
    make = lambda toxic: {*random.choices(words, k=40), *(random.choices(bad, k=2) if toxic else [])}
    labels = np.array([k % 8 == 0 for k in range(1600)])
    texts = [make(y) for y in labels]
    model = toxicity.fit_words(texts[:800], labels[:800])
    assert (np.diff(model.thresholds) > 0).all()
    said = model.exceed([" ".join(t) for t in texts[800:]])[:, 0] >= 0.5
    assert (said == labels[800:]).mean() > 0.99


def test_toxicity_tables(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(None, 1, 1), (51, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.reject_toxic(docs, labels).count() == len(rows)  # one kind of label: no model
    assert toxicity.reject_toxic(empty, labels).columns == docs.columns


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        yield np.cumsum(gone)[:-1] > 0


@pytest.mark.parametrize(("limit", "anchor_rows"), [(1, 2048), (2048, 2)])
def test_repeats(docs, rows, empty, limit, anchor_rows, monkeypatch):
    monkeypatch.setattr(repeats, "ANCHOR_ROWS", anchor_rows)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs, group_limit=limit).collect())
    texts = [(r[1] or "").encode() for r in rows]
    want = collections.Counter()
    for r, t, gone in zip(rows, texts, brute_repeats(texts, 200), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want[(r[0], len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_counted_windows_are_told_by_their_bytes(spark, bits):
    random.seed(3)
    kept = [bytes(random.choice(b"ab") for _ in range(random.randint(12, 30))) for _ in range(80)]
    frame = spark.createDataFrame([(k % 3, k, 7, len(c) - 9, c) for k, c in enumerate(kept)], "anchor long, whole long, second long, n int, context binary")
    times = collections.Counter(c[i : i + 10] for c in kept for i in range(len(c) - 9))
    want = {k: hit for k, c in enumerate(kept) if (hit := [i for i in range(len(c) - 9) if times[c[i : i + 10]] > 1])}
    assert {r["whole"]: r["windows"] for r in repeats._count_windows(frame, 10, bits).collect() if r["windows"]} == want
    assert repeats._count_windows(frame.limit(0), 10, bits).count() == 0


def test_suffix_order():
    random.seed(6)
    buf = np.frombuffer("".join(random.choice("ab") for _ in range(3000)).encode(), np.uint8)
    starts = np.array(sorted(random.sample(range(2900), 700)))
    from crowdloom.llm.common import PrefixHash

    order = repeats.suffix_order(buf, PrefixHash(buf), starts, np.zeros(700, int), 60)
    keys = [buf[s : s + 60].tobytes() for s in starts]
    assert [keys[k] for k in order] == sorted(keys)


def sets_of(rows, width):
    out = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, empty, width, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_KEYS", -1 if width == 2 else 1000)  # both ways to join
    sets = sets_of(rows, width)
    up = list(range(len(rows)))

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    want = collections.Counter((r[0], len(s), min((x for x in ids[root(i)] if x is not None), default=None)) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, width=width).collect())
    assert got == want
    kept = neardup.drop_near_duplicates(docs, width=width)
    groups = len({root(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)
    assert kept.columns == docs.columns and kept.count() == groups
    assert neardup.near_duplicates(empty).count() == 0


def test_links_across_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 4)
    random.seed(8)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(14):
        w = list(base)
        for k in random.sample(range(40), random.randint(0, 5)):
            w[k] = f"x{random.random()}"
        texts.append(" ".join(w))
    members = spark.createDataFrame([(1, k, 38, k, 4) for k in range(14)], "slot long, rep long, n long, part long, blocks int")
    links = neardup._across_parts(members, spark.createDataFrame(list(enumerate(texts)), "rid long, text string"), 2, 80).collect()
    sets = sets_of([(k, t) for k, t in enumerate(texts)], 2)
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    up = list(range(14))
    found = list(range(14))

    def root(u, v):
        while u[v] != v:
            v = u[v]
        return v

    for a in range(14):
        for b in range(a):
            if linked(a, b):
                up[root(up, a)] = root(up, b)
    for r in links:
        assert linked(r["a"], r["b"])
        found[root(found, r["a"])] = root(found, r["b"])
    same = lambda u: {frozenset(v for v in range(14) if root(u, v) == root(u, w)) for w in range(14)}
    assert same(up) == same(found)


def test_super_min_hash_estimates():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    doc = np.concatenate([np.zeros(300, int), np.ones(300, int), np.full(3, 2)])
    sig = neardup.super_min_hash(doc, np.concatenate([a, a[:200], b, a[:3]]), 3, 200)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12  # 200 shared of 400
    assert (sig < np.uint64(1 << 63)).all()


def test_components(spark):
    random.seed(9)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["vertex"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    up = {v: v for e in edges for v in e}
    for _ in range(500):
        changed = False
        for a, b in edges:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
        if not changed:
            break
    assert got == {v: r for v, r in up.items() if v != r}


def brute_private(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and private.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_private_patterns():
    random.seed(10)
    for _ in range(3000):
        t = "".join(random.choice(["a", "b@", "@", ".", "c.d", "1", "25", "255", "4111 1111", "-", "+", " ", "(", "+1 (", "é"]) for _ in range(random.randint(1, 14)))
        assert private.base_spans(t) == brute_private(t), t


def card(first="4"):
    d = first + "".join(random.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if private.luhn(d + c))


def test_private_field_goes_beyond_the_patterns():
    random.seed(11)
    field = private.fit()
    one, two = card(), card("5")
    for t, kind, want in (
        (f"pay {one} {two} now", "card", [one, two]),
        ("please call (931) 555-0187 after noon", "phone", ["(931) 555-0187"]),
        ("tel 931-555-0187 or come", "phone", ["931-555-0187"]),
        ("write to eva @ mail3.example.org please", "email", ["eva @ mail3.example.org"]),
    ):
        assert private.base_spans(t) == []
        assert [(private.KINDS[k], t[a:b]) for a, k, b in private.added_spans([t], [[]], field)[0]] == [(kind, w) for w in want], t
    for t in ("on 2024-01-31 at 10:20 we met", "ISBN 978-3-16-148410-0 is out", 'token = "9c6f64a9a4cd9723e1f4eafc27395915e6868ffa" der', "versions 4.1.12 and 4.2.0", "rows 100 200 300 400 500 600 700"):
        assert private.added_spans([t], [private.base_spans(t)], field) == [[]], t


def test_private_field_on_held_out_rows():
    """Sentences of the table that the fit has not seen, by folds, without the patterns' help."""
    hit = said = true = 0
    for fold in range(5):
        field = private.fit(tuple(r for k, r in enumerate(private.LABELLED) if k % 5 != fold))
        for row in private.LABELLED[fold::5]:
            text, spans = private.marked_row(row)
            got = private.added_spans([text], [[]], field)[0]
            hit, said, true = hit + len(set(got) & set(spans)), said + len(got), true + len(spans)
    assert hit >= 0.8 * true and hit >= 0.85 * said, (hit, said, true)


def test_private_windows():
    random.seed(12)
    field = private.fit()
    text = " ".join(random.choice(["12", "4111 1111 1111 1111", card(), "+1 (222) 555-1234", "1.2.3.4", "x", "a@b.cd", "99-1"]) for _ in range(4000))
    base = private.base_spans(text)
    (added,) = private.added_spans([text], [base], field)
    every = sorted(base + added)
    assert added and all(not text[max(0, a - 1) : a].isalnum() and not text[b : b + 1].isalnum() for a, _, b in added)
    assert all(not (x[0] < y[2] and y[0] < x[2]) for x in added for y in every if x != y)
    counted = [at for places, _, lo, hi, _ in private.windows(text) for at in places[lo:hi].tolist()]
    assert counted == [list(m.span()) for a, b in private.stretches(text) for m in private.TOKEN.finditer(text, a, b)]  # each token once
    for long in ("@" * 200_000, "4" * 200_000, "7 " * 50_000, "a1" * 30_000):
        assert max((len(f) for _, f, *_ in private.windows(long)), default=0) <= private.WINDOW
        assert private.added_spans([long], [private.base_spans(long)], field) == [[]]


def test_private_tables(spark, docs, rows, empty):
    random.seed(13)
    one = card()
    texts = ["mail a.b@mail1.example.com and 10.1.2.3 by +1 (222) 555-1234", f"{one} twice {one}; x@y.zz", "é +49 30 901820 ü 300.1.1.1 999.1.1.1", None, "", f"lost {card()} {card()} here", "x@y.zz"]
    table = spark.createDataFrame([(k, t, "n", None if t is None else len(t)) for k, t in enumerate(texts)] + [(None, texts[0], "n", 3), (0, texts[0], "n", 3)], "doc_id long, text string, spans string, n_chars long")
    got = private.find_private(table.repartition(2), private.fit()).collect()
    joined = lambda spans: ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    want = collections.Counter()
    for i, t in [*enumerate(texts), (None, texts[0]), (0, texts[0])]:
        base = brute_private(t or "")
        more = [(m.start(), 2, m.end()) for m in re.finditer("[0-9]{16}", t)] if i == 5 else []
        want[(i, *(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more))] += 1
    assert collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in got) == want
    assert sum(r["n_ip"] for r in got) == 3 and sum(r["n_added"] for r in got) == 2
    hidden = private.redact(table, private.fit())
    assert hidden.columns == table.columns
    by_id = {r["doc_id"]: r for r in hidden.collect()}
    assert by_id[0]["text"] == "mail [EMAIL] and [IP] by [PHONE]" and by_id[0]["n_chars"] == 32 and by_id[3]["text"] is None and by_id[5]["text"] == "lost [CARD] [CARD] here"
    assert private.find_private(docs, private.fit()).count() == len(rows) and private.redact(docs, private.fit()).columns == docs.columns
    assert private.redact(empty, private.fit()).count() == 0 and private.find_private(empty, None).count() == 0


def test_tokens_match_the_library():
    path = tokens.public_path()
    odd = ["", "a\x01b <|endoftext|>x it's IT'S we'll,,  é́ x\u0085y Å.b 12,3.4 \x1c z", "Don't ÀÉ'Sé's ΣΑΣ, x", "Ｆｕｌｌ ﬁ ½", "\x01 \x01,", " \n", *(r[1] for r in corpus()[:40])]
    for most in (7, 100_000):
        tok = tokens.WordTokenizer(path, max_kept=most)
        for text, ids in zip(odd, tok.documents(pa.array(odd), 50), strict=True):
            assert ids.tolist() == tok.model.encode(text, add_special_tokens=False).ids


def test_packing(docs, rows, empty):
    tok = tokens.WordTokenizer(tokens.public_path())
    pieces = packing.pack_documents(docs, capacity=256, open_bins=16, with_ids=True)
    got = pieces.toPandas()
    want = collections.Counter()
    for r in rows:
        ids = np.array([*tok.model.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 256):
            want[(r[0], k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes()))] += 1
    none = lambda x: None if x != x else int(x)
    assert collections.Counter((none(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 256 + 1
    assert packing.pack_documents(empty).count() == 0


def test_separator_scan(spark, docs, rows, empty):
    blocks, manifest = token_counts.write_blocks(docs, tokens.public_path(), 49407, block_tokens=37)
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.separator_scan(blocks, 49407).join(manifest, ["file", "ordinal"]).collect())
    tok = tokens.WordTokenizer(tokens.public_path())
    assert got == collections.Counter((r[0], len(tok.model.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    flat = np.array([9, 9, 5, 9, 4, 3, 2, 9, 7], "<u2")
    parts = [("f", k, bytearray(flat[2 * k : 2 * k + 2].tobytes())) for k in range(5)]
    found = token_counts.separator_scan(spark.createDataFrame(parts, "file string, block int, payload binary"), 9).orderBy("ordinal").collect()
    assert [(r["start"], r["n_tokens"], r["closed"]) for r in found] == [(0, 0, True), (1, 0, True), (2, 1, True), (4, 3, True), (8, 1, False)]
    assert token_counts.separator_scan(token_counts.write_blocks(empty, tokens.public_path(), 49407)[0], 9).count() == 0


def test_flat_files(spark, tmp_path):
    random.seed(11)
    sizes = {"a.bin": [3, 0, 700, 41], "b.bin": [1], "c.bin": []}
    for name, lengths in sizes.items():
        (tmp_path / name).write_bytes(b"".join(np.array([*(random.randrange(1, 999) for _ in range(n)), 0], "<u2").tobytes() for n in lengths))
    blocks = token_counts.flat_file_blocks(spark, str(tmp_path), block_bytes=64)
    assert blocks.groupBy("file").count().count() == 2 and max(len(r["payload"]) for r in blocks.collect()) == 64
    for r in blocks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "payload"))).alias("all")).collect():
        assert b"".join(bytes(b["payload"]) for b in r["all"]) == (tmp_path / r["file"].rsplit("/", 1)[1]).read_bytes()
    got = collections.defaultdict(list)
    for r in token_counts.separator_scan(blocks, 0).orderBy("file", "ordinal").collect():
        got[r["file"].rsplit("/", 1)[1]].append(r["n_tokens"])
    assert dict(got) == {name: lengths for name, lengths in sizes.items() if lengths}


def test_ledger(docs, rows, empty):
    got = collections.Counter(tuple(r) for r in quality.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = collections.Counter()
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))] += 1
    assert got == want
    table = quality.ledger(docs).cache()
    rejected = table.where(quality.rejects("v2")).count()
    for r in quality.ablation(table).where("policy = 'v2'").collect():
        others = tuple(n for n in quality.POLICIES["v2"] if n != r["rule"])
        assert r["rejected"] == rejected and r["rejected_without"] == table.where(quality.rejects("x", {"x": others})).count()
    assert quality.ledger(empty).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "sum", '{"y":2,"x":1}', []), (1, "b", 1, "sum", '{"x":"1"}', ["a"]), (1, "c", 2, "sum", '{"x":1,"y":{"q":1,"b":[2]}}', ["b", "a", "lost"]), (1, "d", 3, "none", "{}", ["e"]), (1, "e", 4, "sum", "nonsense", ["d"]), (1, "a", 9, "sum", "{}", []), (None, "z", 0, "sum", "{}", []), (2, "a", 0, None, None, None)],
        "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", 1, 'he said "hi"'), (1, "a", 2, "late"), (1, "q", 3, "stray")], "conv_id long, call_id string, position long, content string")
    schemas = spark.createDataFrame([("sum", "x", "bigint", True), ("sum", "y", "bigint", False)], "name string, field string, type string, required boolean")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link_tool_calls(calls, results, schemas).collect()}
    a, b, c = (got[(1, k)] for k in "abc")
    assert (a["level"], a["linked"], a["valid"], a["arguments_json"]) == (0, True, True, '{"x":1,"y":2}')
    assert json.loads(a["json"]) == {"id": "a", "name": "sum", "arguments": {"x": 1, "y": 2}, "result": 'he said "hi"'}
    assert b["level"] == 1 and b["errors"] == ["type:x"] and not b["linked"]
    assert c["level"] == 2 and c["errors"] == ["type:y", "unknown dependency"] and c["arguments_json"] == '{"x":1,"y":{"b":[2],"q":1}}'
    assert got[(1, "d")]["errors"] == ["unknown tool", "cycle"] and got[(1, "e")]["errors"] == ["arguments are no object", "cycle"]
    assert got[(1, "q")]["errors"] == ["no call"] and (None, "z") not in got and got[(2, "a")]["errors"] == ["unknown tool"]
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_long_chain_of_calls(spark):
    chain = spark.range(200).select(F.lit(1).alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    assert {int(r["call_id"]): r["level"] for r in chat.levels(chain).collect()} == {k: k for k in range(200)}
