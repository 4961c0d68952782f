"""Every stage of the corpus pipeline, and their chain, against plain Python versions on a small fixture."""

import hashlib
import random
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest

from geoloom.llm import mixing, sharding, toxicity
from geoloom.llm.common import seeded
from tests.llm import test_decontamination, test_near

CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, `key` string, root long, `value` string, k0 int, __row string, score double, size long, times int, `odd name` string"


def plain_words(text):
    keep = lambda c: c if c.isalnum() and c.isascii() or ord(c) > 127 else " "
    return "".join(keep(chr(ord(c) + 32) if "A" <= c <= "Z" else c) for c in text or "").split()


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    r = random.Random(12)
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, lang, source, n, 1, "k", 2, "v", 0, "row", 0.5, 9, 3, "o") for i, t, lang, source, n, *_ in rows]
    marked = []
    for i in range(200, 290):
        text = " ".join("".join(r.choice("abcdeé") for _ in range(4)) for _ in range(r.randint(8, 90)))
        bad = i % 3 == 0
        docs.append((i, f"{text} vilest {text[:9]}" if bad else text, "en", r.choice(["s1", "s3"]), 5, 1, None, None, None, None, None, None, None, None, None))
        marked.append((i, 1, int(bad)))
    spark.createDataFrame(docs, CLASH).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*marked, (0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    long_ones = [x[1] for x in rows if x[1] and len(x[1].split()) > 30]
    bench = [(1, " ".join(long_ones[3].split()[5:25])), (2, long_ones[7]), (3, None), (4, "...")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, bench


def plain_toxicity(spark, folder, docs, bench):
    """With the fitted weights, scored here."""
    table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    model = toxicity.fit(spark.createDataFrame(docs, CLASH), table("labels"))
    out = []
    for d in docs:
        raw = {w.encode() for w in plain_words(d[1])}
        features = raw | {w[:n] + b"*" for w in raw for n in (4, 6) if len(w) > n}
        z = model.bias + sum(model.weights.get(x, 0.0) for x in features)
        if 1 / (1 + np.exp(-z)) < 0.7:
            out.append(d)
    return out


def plain_near(spark, folder, docs, bench):
    groups = {}
    for d, c in zip(docs, test_near.components([(d[0], d[1]) for d in docs])):
        groups.setdefault(c, []).append(d)
    hashes = {(r.doc_id, r.text): r.h for r in spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    return [min(g, key=lambda d: (d[0] is None, d[0] or 0, hashes[d[0], d[1]])) for g in groups.values()]


def plain_clean(spark, folder, docs, bench):
    return [d for d in docs if not test_decontamination.brute(d[1], bench)[1]]


def size_of(text):
    return len([w for w in (text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w])


def plain_mix(spark, folder, docs, bench):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    draw = {(r.doc_id, r.text): (r.d % 2**64, r.doc_id is not None, r.doc_id or 0, r.hash) for r in df.withColumn("d", seeded(mixing.SEED, "doc_id", "hash")).collect()}
    names = sorted({d[3] for d in docs if d[3] is not None}, key=lambda s: [ord(c) for c in s]) + [None] * any(d[3] is None for d in docs)
    of = {s: [d for d in docs if d[3] == s] for s in names}
    words = np.array([sum(size_of(d[1]) for d in of[s]) for s in names], float)
    out = []
    for s, target in zip(names, mixing.targets(words, np.resize([5.0, 2, 1], len(names)), 1.5 * words.sum(), 2.0)):
        lengths = sorted({size_of(d[1]) for d in of[s]})
        counts = [sum(size_of(d[1]) == n for d in of[s]) for n in lengths]
        passes, quota = mixing.fit(np.array(lengths), np.array(counts), target)
        for n, k in zip(lengths, quota):
            same = sorted((d for d in of[s] if size_of(d[1]) == n), key=lambda d: draw[d[0], d[1]])
            out += [d for at, d in enumerate(same) for _ in range(passes + (at < k))]
    return out


def plain_shard(spark, folder, docs, bench):
    places = []
    for s in {d[3] for d in docs}:
        mine = [d for d in docs if d[3] == s]
        draw = lambda d: (hashlib.md5("|".join([str(sharding.SEED), *([] if d[0] is None else [str(d[0])])]).encode()).hexdigest()[:15], d[0] is not None, d[0] or 0)
        for rank, d in enumerate(sorted(mine, key=draw)):
            places.append(((2 * rank + 1) / (2 * len(mine)), s is None, s or "", rank, d))
    places.sort(key=lambda p: p[:4])
    n, out = len(places), []
    for at, p in enumerate(places):
        shard = at * 16 // n
        out.append((*p[4], shard, at - (shard * n + 15) // 16))
    return out


PLAIN = [plain_toxicity, plain_near, plain_clean, plain_mix, plain_shard]


def same(got, want, ties=None):
    """Rows as a multiset; rows that differ in nothing but their place may change places."""
    pick = ties or (lambda r: r)
    return Counter(str(pick(tuple(r))) for r in got) == Counter(str(pick(tuple(r))) for r in want)


def test_every_stage_and_their_chain_equal_plain_versions(spark, tables):
    folder, docs, bench = tables
    kept, sizes = docs, []
    for (name, stage), plain in zip(pipeline.STAGES, PLAIN):
        got = stage(spark, spark.createDataFrame(kept, CLASH), folder)
        want = plain(spark, folder, kept, bench)
        # texts of one id are dealt to places in any order
        ties = (lambda r: (*r[:1], *r[-2:])) if name == "shard" else None
        assert same(got.collect(), want, ties), name
        assert len(want) and (name == "shard" or got.columns == spark.createDataFrame([], CLASH).columns)
        kept = want
        sizes.append(len(want))
    assert sizes[0] < len(docs) and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    out = pipeline.run(spark, folder).collect()
    assert same([(*r[:1], *r[-2:]) for r in out], [(*r[:1], *r[-2:]) for r in kept])


def test_stages_of_empty_tables(spark, tables):
    folder, _, _ = tables
    none = spark.createDataFrame([], CLASH)
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and out.columns[: len(none.columns)] == none.columns


def test_without_labels_or_benchmark_nothing_goes(spark, tables, tmp_path):
    folder, docs, _ = tables
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame(docs, CLASH)
    assert pipeline.reject_toxic(spark, df, str(tmp_path)).count() == pipeline.decontaminate(spark, df, str(tmp_path)).count() == len(docs)


def test_a_very_long_text_goes_through_every_stage(spark, tables):
    folder, docs, _ = tables
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = " ".join(word() for _ in range(60_000))
    df = spark.createDataFrame([(1, text, "en", "s1", 1, *[None] * 10), (2, text + " more", "en", "s1", 1, *[None] * 10), *docs[30:60]], CLASH)
    for name, stage in pipeline.STAGES:
        df = stage(spark, df, folder)
        assert [x.doc_id for x in df.filter("length(text) > 300000").collect()].count(1) in ((1, 2) if name in ("mix", "shard") else (1,)), name
        df = spark.createDataFrame(df.collect(), df.schema)


def test_order_of_the_stages():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"]
