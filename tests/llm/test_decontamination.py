import hashlib
import re

import pytest

from geoloom.llm import decontamination as d

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        k = words(t)
        n = min(10, len(k))
        for i in range(len(k) - n + 1) if k else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == k[i : i + n]:
                    hit |= set(range(j, j + n))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), sorted(ids)


@pytest.fixture(scope="module")
def items(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    return [(1, " ".join(texts[3].split()[5:25])), (2, texts[7]), (10, "One, TWO"), (11, "one"), (12, None), (13, "..."), (14, ""), (10, "repeated id three"), (None, "x" * 700), (15, texts[-1].upper())]


@pytest.mark.parametrize("block", [16 << 20, 900])
def test_query_equals_brute_force(spark, docs, rows, items, block):
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, n_words string")
    got = d.find(docs.select("doc_id", "text", "__rank"), bench, block_bytes=block).collect()
    have = sorted((str(r.doc_id), r.text or "", r.n_words, sum(s.end - s.start for s in r.hit_spans), list(r.hit_items)) for r in got)
    assert have == sorted((str(r[0]), r[1] or "", *brute(r[1], items)) for r in rows)
    assert any(h[3] for h in have)


def test_digest_columns(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.n_words): r for r in d.digest(docs, bench).collect()}
    for r in rows[9:40]:
        n, hit, ids = brute(r[1], items)
        got = out[r[0], n]
        assert (got.n_hit, got.n_items, got.items_sha256, got.contaminated) == (hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)


def test_clean_documents_keep_their_columns(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(brute(r[1], items)[1] == 0 for r in rows)


def test_empty_tables(spark, docs, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.clean(docs, none).count() == len(rows) and d.digest(empty, none).count() == 0
