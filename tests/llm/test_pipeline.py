"""The pipeline end to end on a small corpus, each stage against plain Python."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crowdloom.llm import packing, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(5000)}x" for _ in range(n))


def corpus():
    rng = random.Random(21)
    out = []
    for i in range(400):
        words = text_of(rng, rng.randint(10, 60))
        if i % 5 == 0:
            words += " grumbok snarv plint zobble"
        if i % 7 == 0:
            words += f" mail me{i}@mail.example.com"
        out.append((i, words, "en", f"s{i % 3}"))
    for i in range(400, 420):  # near copies: one word more
        out.append((i, out[i - 400][1] + " more", "en", "s1"))
    out += [(420, None, None, None), (421, "", "en", "s2"), (422, "", "en", "s2"), (423, "one", "en", None), (424, text_of(rng, 9000), "de", "s0"), (None, text_of(rng, 30), None, None)]
    out += [out[3], out[3]]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages_against_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = held[name] = spark.read.parquet(f"{tmp_path}/{name}")
    assert all(held[n].columns == columns for n in list(held)[:-1])

    every = collections.Counter(corpus())
    clean = collections.Counter({r: n for r, n in every.items() if "grumbok" not in (r[1] or "")})
    assert rows_of(held["toxicity"]) == clean

    sets = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t.lower())] for i in range(max(1, len(w) - 4)) if w}
    rows = list(clean.elements())
    up = list(range(len(rows)))

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    bags = [sets(r[1] or "") for r in rows]
    holders = collections.defaultdict(list)
    for k, bag in enumerate(bags):
        for g in bag:
            for j in holders[g][:1]:
                if len(bags[j] & bag) >= 0.8 * len(bags[j] | bag):
                    up[root(k)] = root(j)
            holders[g].append(k)
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[root(k)].append(r)
    kept = rows_of(held["near_dedup"])
    assert sum(kept.values()) == len(groups) and set(kept) <= set(rows)
    for members in groups.values():  # the least id stays
        assert kept[min(members, key=lambda r: (r[0] is None, r[0] or 0))] >= 1

    hide = lambda t: None if t is None else re.sub(r"[a-z0-9]+@mail\.example\.com", "[EMAIL]", t)
    hidden = collections.Counter({(r[0], hide(r[1]), r[2], r[3], None if r[1] is None else len(hide(r[1]))): n for r, n in kept.items()})
    assert rows_of(held["pii"]) == hidden and any("[EMAIL]" in (r[1] or "") for r in hidden)

    mixed = rows_of(held["mix"])
    assert set(mixed) <= set(hidden) and all(n <= 2 * hidden[r] for r, n in mixed.items())
    size = lambda c: sum(n * len(WORD.findall(r[1] or "")) for r, n in c.items())
    assert abs(size(mixed) - 1.5 * size(hidden)) <= 4 * 9000

    tok = tokens.WordTokenizer(tokens.public_path())
    want = collections.Counter()
    for r, n in mixed.items():
        ids = [*tok.model.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[(r[0], k // 4096, k, len(ids[k : k + 4096]))] += n
    packed = held["pack"].collect()
    assert collections.Counter((p["doc_id"], p["piece"], p["start"], p["length"]) for p in packed) == want
    filled = collections.Counter()
    for p in sorted(packed, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled[p["sequence_id"]]
        filled[p["sequence_id"]] += p["length"]
    assert max(filled.values()) <= 4096


def test_run_keeps_whole_sequences(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    assert set(packed.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    if "ids" in packed.columns:
        assert packed.where(F.size("ids") != F.col("length")).isEmpty()
        assert packing.sequences(packed).where(F.size("input_ids") > 4096).isEmpty()


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    extra = ", size string, target string, rid string, uid string, c0 string, rejected string, copies string"
    documents = spark.createDataFrame([], SCHEMA + extra)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(k, "a b c d e f " + "g " * k if k else None, "en", "s", 1, *"abcdefg") for k in range(6)], SCHEMA + extra)
    docs = some
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == some.columns
    assert {tuple(r)[5:] for r in docs.collect()} == {tuple("abcdefg")}
