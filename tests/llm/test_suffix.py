import hashlib

import numpy as np
import pytest

from geoloom.llm import suffix


def brute(docs):
    """{(id, text): (n_bytes, n_removed, n_spans, sha)} by a set of all windows seen."""
    seen, out = set(), {}
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in docs})
    for none, i, t in order:
        s = t.encode()
        gone = bytearray(len(s))
        mine = set()
        for k in range(len(s) - 99):
            win = s[k : k + 100]
            if win in seen or win in mine:
                gone[k : k + 100] = b"\1" * 100
            mine.add(win)
        seen |= mine
        kept = bytes(b for b, g in zip(s, gone) if not g)
        out[None if none else i, t] = (len(s), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string, n_bytes string")
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix.digest(df).collect()]


@pytest.fixture(scope="module")
def unique(rows):
    """One text for each id: the order of equal ids is a hash's."""
    last = {r[0]: (r[0], r[1], "u", "n") for r in rows}
    return list(last.values())


def compare(spark, rows):
    want = brute(rows)
    got = run(spark, rows)
    assert sorted(map(str, got)) == sorted(str((r[0], want[r[0], r[1] or ""])) for r in rows)
    return got


def test_query_equals_brute_force(spark, unique):
    got = compare(spark, unique)
    assert sum(v[1] for _, v in got) > 1000


def test_small_pieces_shards_and_batches(spark, unique, monkeypatch):
    for name, value in (("PIECE", 900), ("COMBINE", 40), ("MERGE_BYTES", 2000), ("SHARD_BYTES", 300), ("RUN", 16)):
        monkeypatch.setattr(suffix, name, value)
    batches = [[(i, (t or "").encode()) for i, t, *_ in unique if i is not None]]
    import pyarrow as pa

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows)), pa.array([r[1] for r in rows])], ["uid", "start", "bytes"])

    texts = dict(batches[0])
    runs = list(suffix.map_runs(suffix.GRAMS[0])(iter([table(batches[0])])))
    found = list(suffix.reduce_runs(iter(runs)))
    gone = {i: bytearray(len(t)) for i, t in texts.items()}
    contexts = []
    for b in found:
        for h, _, uid, start, n, kind in zip(*(c.to_pylist() for c in b.columns)):
            if kind == suffix.REPEAT:
                gone[uid][start : start + n + 99] = b"\1" * (n + 99)
            else:
                contexts.append((h, uid, start, n, texts[uid][start : start + n + 99]))
    contexts.sort()
    cols = list(zip(*contexts))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "uid", "start", "n", "context"])
    for b in suffix.compare(iter([batch])):
        for uid, start, n in zip(*(c.to_pylist() for c in b.columns)):
            gone[uid][start : start + n + 99] = b"\1" * (n + 99)
    want = brute([r for r in unique if r[0] is not None])
    assert {i: sum(g) for i, g in gone.items()} == {i: v[1] for (i, _), v in want.items()}


def test_hot_hashes_take_the_exact_way(spark, unique, monkeypatch):
    """Workers import the module afresh, so the limit goes in by the function that they get."""
    real = suffix.reduce_runs

    def hot(batches):
        suffix.HOT_GROUP = 1
        return real(batches)

    monkeypatch.setattr(suffix, "reduce_runs", hot)
    compare(spark, unique)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 32, 64, 100])
def test_string_hashes_are_polynomials(n):
    s = np.frombuffer(bytes(range(7, 250)), np.uint8)
    want = []
    for i in range(len(s) - n + 1):
        x = 0
        for b in s[i : i + n]:
            x = (x * suffix._MUL + int(suffix._BYTE[b])) % 2**64
        want.append(x)
    assert suffix.string_hashes(s, n).tolist() == want


def test_a_line_that_many_share(spark, monkeypatch):
    """A hot hash whose contexts all differ: they part under longer strings, and the line is found in all."""
    real = suffix.reduce_runs

    def hot(batches):
        suffix.HOT_GROUP = 20
        return real(batches)

    monkeypatch.setattr(suffix, "reduce_runs", hot)
    line = "".join(chr(97 + i * i * i % 25) for i in range(140))
    rows = [(i, f"{i * 7919 % 1009:0120d} {line} {i * 104729 % 2003:0130d}", None, None) for i in range(90)]
    got = compare(spark, rows)
    assert sum(v[1] >= 140 for _, v in got) >= 89


def test_long_texts_go_in_pieces(spark, monkeypatch):
    real = suffix.pieces

    def small(batches):
        suffix.PIECE = 257
        return real(batches)

    monkeypatch.setattr(suffix, "pieces", small)
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))
    compare(spark, [(1, text, None, None), (2, "xyz" + text[100:4000] + "tail" + text[:700], None, None), (3, text[::-1] + text[4990:] + text[:200], None, None)])


def test_repeated_rows_are_one_document(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(5, text, None, None), (5, text, None, None), (7, "y" + text[:150] + "z", None, None)]
    got = run(spark, rows)
    assert [v[1] for i, v in got if i == 5] == [v[1] for i, v in got if i == 5] and len(got) == 3
    assert dict(got)[7][1] == 150 and brute(rows)[5, text][1] == dict(got)[5][1]


def test_runs_of_one_byte_and_periods(spark):
    rows = [(1, "a" * 1000, None, None), (2, "ab" * 400, None, None), (3, "a" * 99, None, None), (4, "x" + "a" * 120 + "y", None, None), (5, "é" * 260, None, None), (6, "\0" * 350, None, None)]
    compare(spark, rows)


def test_empty_table(empty):
    assert suffix.digest(empty).count() == 0


@pytest.mark.parametrize("unique", [True, False])
def test_texts_are_shuffled_once(spark, tmp_path, unique):
    """Both joins of the texts read one exchange."""
    line = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(150))
    rows = [(i if unique or i else 1, f"{i}" * 120 + line + f"{i}." * 80) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "-1")
        out = suffix.digest(spark.read.parquet(f"{tmp_path}/docs"))
        assert sum(r.n_removed for r in out.collect()) >= 150 * 59
    finally:
        spark.conf.set(setting, before)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
