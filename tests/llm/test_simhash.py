import random

import numpy as np
import xxhash

from geoloom.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, budget=4):
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= budget) for i in range(len(fps))]
        if new == label:
            break
        label = new
    least = {}
    for k, i in zip(label, ids):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return [least.get(k) for k in label]


def test_query_equals_brute_force(spark, docs, rows):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()), key=str)
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(((r[0] is None, r[0] or 0, f"{f:016x}", c) for r, f, c in zip(rows, fps, components(fps, [r[0] for r in rows]))), key=str)
    assert got == want


def test_trie_join_finds_every_pair(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(12)})
    keys = np.array(fps, np.uint64)
    got = {(i, j) for a, b in simhash.trie_pairs(keys, 0, 4) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4}


def test_hot_buckets_lose_no_link(spark):
    r = random.Random(3)
    fps = sorted({r.choice([7, 1 << 40]) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(250)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = components(fps, fps)
    for hot in (10, 10**6):
        roots = {x.node: x.root for x in simhash.components(simhash.near_links(df, hot_rows=hot)).collect()}
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        groups = {}
        for f, c in zip(signed, want):
            groups.setdefault(c, set()).add(roots.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_chain_is_one_component(spark):
    n = 70
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.root for r in simhash.components(df).collect()} == {0}


def test_one_document_of_each_group_stays(spark, docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {}  # equal ids may stand in several components
    for r, c in zip(rows, components([plain_fingerprint(r[1]) for r in rows], range(len(rows)))):
        groups.setdefault(c, []).append(r[0])
    want = [min(i for i in g if i is not None) for g in groups.values() if set(g) != {None}]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_empty_table(empty):
    assert simhash.digest(empty).count() == 0 and simhash.keep_one(empty).count() == 0
