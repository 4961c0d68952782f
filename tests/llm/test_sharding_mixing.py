import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from geoloom.llm import mixing, sharding


def test_shards_are_even_gapless_and_match_the_mixture(spark, docs, rows):
    out = sharding.digest(docs, 4).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want


@pytest.mark.parametrize("cell", [8, 10_000])
def test_cells_do_not_change_places(spark, docs, cell):
    out = sharding.interleave(docs, 5, cell_rows=cell)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = {(r.doc_id, r.text): (r.shard, r.slot) for r in out.collect() if r.doc_id is not None and 30 < r.doc_id < 110}
    again = {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.interleave(docs, 5, cell_rows=40).collect() if r.doc_id is not None and 30 < r.doc_id < 110}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in again.items()}


def test_each_source_is_spread_in_proportion(spark):
    df = spark.createDataFrame([(i, "big" if i % 3 else "small") for i in range(900)], "doc_id long, source string")
    got = Counter((r.shard, r.source) for r in sharding.interleave(df, 9, cell_rows=64).collect())
    assert all(abs(got[s, "big"] - 600 / 9) <= 1 and abs(got[s, "small"] - 300 / 9) <= 1 for s in range(9))


def test_empty_tables(empty):
    assert sharding.digest(empty).count() == 0 and mixing.digest(empty).count() == 0


def test_targets_fill_and_stop():
    got = mixing.targets(np.array([100.0, 100, 100]), np.array([5.0, 2, 1]), 450.0, 2.0)
    assert got.tolist() == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets(np.zeros(2), np.array([5.0, 2]), 0.0, 2.0).tolist() == [0, 0]


def test_knapsack_meets_every_reachable_budget():
    lengths, counts = np.array([3, 5, 11]), np.array([2, 3, 1])
    sums = {a * 3 + b * 5 + c * 11 for a in range(3) for b in range(4) for c in range(2)}
    for budget in range(0, 33):
        take = mixing.knapsack(lengths, counts, budget)
        total = int((take * lengths).sum())
        assert (take <= counts).all() and abs(total - budget) == min(abs(s - budget) for s in sums)


def test_small_table_still_meets_the_budget():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 3000, 200))
    counts = rng.integers(1, 9, len(lengths))
    total = int((lengths * counts).sum())
    for target in (0.31 * total, 1.7 * total, 2.0 * total):
        passes, quota = mixing.fit(lengths, counts, target, table=8000)
        assert (quota <= counts).all() and passes * total + int((quota * lengths).sum()) == round(target)


@pytest.mark.parametrize("lengths, counts, near", [([20_000, 2_000_000], [500, 1], 10_000), ([3, 20_000, 1_048_577, 2_000_000], [7, 500, 2, 3], 10_000), ([5_000_000], [1], 2_500_000)])
def test_texts_longer_than_the_table(lengths, counts, near):
    lengths, counts = np.array(lengths), np.array(counts)
    total = int((lengths * counts).sum())
    for share in (0.0, 0.0001, 0.3, 0.9, 1.0, 1.25, 2.0):
        passes, quota = mixing.fit(lengths, counts, share * total)
        assert (quota >= 0).all() and (quota <= counts).all()
        off = abs(passes * total + int((quota * lengths).sum()) - round(share * total))
        assert off <= near and (share % 1 or (passes == share and not quota.any()))


def test_mix_takes_the_target_of_each_source(spark, docs, rows):
    out = mixing.digest(docs).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    words = lambda t: len((t or "").translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ")) - (t or "").translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ").count("")
    assert sorted(r["size"] for r in out) == sorted(words(r[1]) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None]
    aim = mixing.targets(np.array([sizes[s] for s in names], float), np.resize(np.array([5.0, 2, 1]), len(names)), 1.5 * sum(sizes.values()), 2.0)
    assert {round(r.target, 6) for r in out} == {round(float(a), 6) for a in aim}
    taken = defaultdict(int)
    for r in out:
        taken[round(r.target, 6), r.source_size] += r.taken
    assert all(abs(v - k[0]) <= 1 for k, v in taken.items())
    again = mixing.digest(docs).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in out) == Counter((r.doc_id, r["size"], r.taken) for r in again)
