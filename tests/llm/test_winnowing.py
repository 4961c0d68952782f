import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import winnowing as w


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def word_hash(text):
    return xxhash.xxh64_intdigest(text.encode(), 42)


def plain_prints(text):
    """(hash, position) of the picks, from the definition."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    h = [word_hash(x) for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & (2**64 - 1) if n else x
    runs = []
    for i in range(len(h) - w.K + 1) if len(h) >= w.K else range(bool(h)):
        part, x = h[i : i + w.K], 0
        for j, y in enumerate(part):
            x ^= turn(y, len(part) - 1 - j)
        runs.append(signed(x))
    return [(runs[p] % 2**64, p) for p in plain_picks(runs, w.WINDOW)]


def alike(a, b):
    a, b = ({h for h, _ in x} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(rows):
    """All columns of the result, document by document."""
    order = sorted(((i is not None, i or 0, signed(word_hash(t or "")), (t or "").encode()) for i, t in rows), reverse=True)
    out = []
    for k, (named, i, _, raw) in enumerate(order):
        t, after = raw.decode(), order[(k + 1) % len(order)][3].decode()
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain_prints(t), plain_prints(edited), plain_prints(after)
        text = lambda x: ",".join(f"{h:016x}@{p}" for h, p in x)
        out.append((i if named else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    return sorted(out, key=str)


def result(docs):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in w.digest(docs).collect()), key=str)


def test_whole_result_equals_brute_force(docs, rows):
    assert result(docs) == brute_force([r[:2] for r in rows])


def test_extreme_ids_and_very_long_texts(spark):
    rows = [(2**63 - 1, "a b c d e f"), (-(2**63), " ".join(f"w{i % 977}" for i in range(9_000))), (0, "x " * 6_000), (2**63 - 1, "b"), (2**53 + 1, "c"), (2**53, "d"), (None, "é")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute_force(rows)


def test_hot_ids_are_dealt_over_several_ranges(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i % 70} {'word ' * (i % 9)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranged, by_hash = w.id_ranges(df.select("doc_id"), 300, 10, 30)
    by_range = ranged(df).groupBy("range").count().collect()
    assert by_hash and max(r["count"] for r in by_range) <= 60 and len(by_range) > 15
    short = lambda got: sorted(((r.doc_id, r.text, r.next_text) for r in got), key=str)
    want = sorted(((i is not None, i or 0, signed(word_hash(t)), t.encode()) for i, t in rows), reverse=True)
    want = [(i if named else None, t.decode(), want[(k + 1) % 300][3].decode()) for k, (named, i, _, t) in enumerate(want)]
    assert short(w.with_next(df, {}, range_rows=10, quantiles=30).collect()) == sorted(want, key=str)


@pytest.mark.parametrize("size", [3, 10, 10_000])
def test_ranges_do_not_change_neighbours(spark, docs, size):
    got = w.with_next(docs.select("doc_id", "text"), {}, range_rows=size, quantiles=4).collect()
    want = w.with_next(docs.select("doc_id", "text"), {}).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def plain_picks(g, window):
    if not g:
        return []
    out = []
    for i in range(max(1, len(g) - window + 1)):
        part = g[i : i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if at not in out:
            out.append(at)
    return out


def test_picks_are_rightmost_minima(spark):
    lists = [[], [5], [3, 3, 3, 3], [9, 1, 1, 7, 1, 8, 8, 8], [4, 4, 2, 4, 4, 4, 4], list(range(9)), list(range(9, 0, -1))]
    df = spark.createDataFrame([(k, [x << 40 for x in v]) for k, v in enumerate(lists)], "k int, g array<bigint>")
    got = {r.k: list(r.p) for r in df.select("k", w.picks(F.col("g"), 3).alias("p")).collect()}
    assert got == {k: plain_picks([x << 40 for x in v], 3) for k, v in enumerate(lists)}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 7, 8])
def test_runs_are_rolled_up_for_any_length(spark, k):
    h = [word_hash(str(i)) for i in range(11)]
    got = spark.createDataFrame([([signed(x) for x in h],)], "h array<bigint>").select(w.runs(F.col("h"), k).alias("r")).first().r
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & (2**64 - 1) if n else x
    want = []
    for i in range(len(h) - k + 1):
        x = 0
        for j in range(k):
            x ^= turn(h[i + j], k - 1 - j)
        want.append(signed(x))
    assert got == want


def test_a_shared_span_shares_a_fingerprint(spark):
    span = " ".join(f"w{i}" for i in range(w.K + w.WINDOW - 1))
    df = spark.createDataFrame([("a b c " + span + " d e", "x " + span + " y z q r"), (span.upper(), span), ("", ""), ("", "a"), ("a b", "a b")], "a string, b string")
    h = lambda c: w.hashes_of(w.fingerprint(F.col(c)))
    got = df.select(F.size(F.array_intersect(h("a"), h("b"))).alias("n"), w.likeness(h("a"), h("b")).alias("p")).collect()
    assert got[0].n >= 1 and [r.p for r in got[1:]] == [1, 1, 0, 1]


def test_one_document_and_none(spark, empty):
    one = spark.createDataFrame([(4, "a b c d e f g")], "doc_id long, text string")
    assert w.digest(one).first().near_next == 1.0 and w.digest(empty).count() == 0


def test_main_path_is_native(spark, docs):
    plan = w.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
