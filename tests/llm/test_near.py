import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from geoloom.llm import near


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(rows):
    """Of each row the least place in its component, by all pairs."""
    sets = [plain_set(r[1]) for r in rows]
    near_to = [[j for j in range(len(rows)) if len(s & sets[j]) >= 0.8 * len(s | sets[j])] for s in sets]
    label = list(range(len(rows)))
    while (new := [min(label[j] for j in of) for of in near_to]) != label:
        label = new
    return label


def least_ids(rows):
    groups = {}
    for r, c in zip(rows, components(rows)):
        groups.setdefault(c, []).append(r[0])
    return sorted(min(i for i in g if i is not None) for g in groups.values() if set(g) != {None})


def chained(seed, n, words=120):
    """Each text has one word of the one before changed, so that far ones are linked only by those between."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text, out = [word() for _ in range(words)], []
    for i in range(n):
        out.append((i, " ".join(text)))
        for _ in range(2):
            text[r.randrange(words)] = word()
    return out


def test_stage_equals_all_pairs(spark, docs, rows):
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == least_ids(rows)


def test_likeness_of_08_is_near_whatever_the_fingerprints(spark, monkeypatch):
    rows = chained(5, 40) + [(100 + i, t) for i, t in chained(6, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(set(components(rows))) < 10
    for open_ in (0, 8):  # by leaders and then by all pairs, or by all pairs at once
        monkeypatch.setattr(near, "OPEN", open_)
        assert sorted(r.doc_id for r in near.keep_one(df).collect()) == least_ids(rows)


def test_links_are_folded_within_tasks():
    draw = np.random.default_rng(3)
    a, b = draw.integers(-90, 90, (2, 100))
    batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"]) for x, y in ((a[:0], b[:0]), (a[:60], b[:60]), (a[60:], b[60:]))]
    least = {int(x): int(x) for x in (*a, *b)}
    for _ in least:
        for x, y in zip(a.tolist(), b.tolist()):
            least[x] = least[y] = min(least[x], least[y])
    got = [(x, y) for batch in near.folded(iter(batches)) for x, y in zip(*(c.to_pylist() for c in batch.columns))]
    assert sorted(got) == sorted((x, y) for x, y in least.items() if x != y)


def test_rounds_link_components_once(spark, monkeypatch):
    """What goes to the star contraction, in all rounds together, is less than a link for each text."""
    got, contract = [], near.components
    monkeypatch.setattr(near, "components", lambda links: got.append(links.count()) or contract(links))
    monkeypatch.setattr(near, "OPEN", 0)
    rows = chained(5, 40)
    assert sorted(r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == least_ids(rows)
    assert 0 < sum(got) < len(rows), got


def test_open_pairs_are_made_once(spark, monkeypatch):
    """A pair that meets in several tables comes from the first of them alone."""
    made, df = [], spark.createDataFrame(chained(5, 30), "doc_id long, text string")
    distinct = type(df).distinct
    monkeypatch.setattr(type(df), "distinct", lambda x: (x.columns == ["a", "b", "ra", "rb"] and made.append((x.count(), distinct(x).count())), distinct(x))[1])
    monkeypatch.setattr(near, "OPEN", 1 << 30)
    near.keep_one(df).count()
    assert made and all(n == once > 0 for n, once in made), made


def test_texts_that_differ_a_little_too_much_are_not_paired(spark, monkeypatch):
    """A large group, much of it within the budget of bits, whose texts each have over a ninth of their own, costs no check for its pairs."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(300)], []
    for i in range(120):
        text = list(base)
        for at in r.sample(range(5, 295, 5), 7):
            text[at] = word()
        rows.append((i, " ".join(text)))
    rows += [(200, rows[7][1] + " and more"), (201, rows[7][1] + " and more of it")]
    made, checked = [], near._checked
    monkeypatch.setattr(near, "_checked", lambda pairs, sets: made.append(pairs.count()) or checked(pairs, sets))
    monkeypatch.setattr(near, "OPEN", 1 << 30)
    kept = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == least_ids(rows) == list(range(120))
    assert 0 < sum(made) < 10, made


def test_prefixes_lose_no_alike_pair(spark):
    """Sets of many sizes in few roots, with likenesses at, over and under 0.8: every alike pair of two roots is made, once."""
    draw, sets = np.random.default_rng(6), []
    for _ in range(12):
        core = draw.integers(0, 1 << 63, int(draw.integers(1, 90)))
        for _ in range(10):
            kept = core[: len(core) - int(draw.integers(0, 1 + len(core) // 5))]
            sets.append(np.unique(np.concatenate((kept, draw.integers(0, 1 << 63, int(draw.integers(0, 1 + len(core) // 6)))))))
    nine, root = np.arange(9) + 5, draw.integers(0, 40, 122).tolist()
    sets += [nine[:8], nine[1:]]  # at 7 of 9
    sets += [nine, np.arange(9) + 6, np.arange(18) + 500, np.arange(18) + 502]  # both at 0.8
    root += [50, 51, 52, 53]
    size = [len(x) for x in sets]
    like = [(i, j) for i in range(len(sets)) for j in range(i) if root[i] != root[j] and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (size[i] + size[j])]
    assert (123, 122) in like and (125, 124) in like and len(like) > 100
    open_ = spark.createDataFrame(list(enumerate(root)), "id long, root long")
    table = spark.createDataFrame([(i, x.astype(np.int64).tobytes()) for i, x in enumerate(sets)], "id long, value binary")
    placed = near.prefixes(open_, table)
    made = [(r.a, r.b) for r in near.open_pairs(placed).collect()]
    got = {(max(p), min(p)) for p in made}
    assert len(made) == len(got) and set(like) <= got
    assert all(root[i] != root[j] for i, j in got) and len(got) <= near.compared(placed)


def test_empty_table(empty):
    assert near.keep_one(empty).count() == 0


def meet(a, b):
    prints = [near.fingerprint(x).tobytes() for x in (a, b)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(prints, pa.binary())], ["id", "print"])
    rows = pa.Table.from_batches(list(near.dealt(iter([batch])))).sort_by("bucket").combine_chunks().to_batches()
    return any(b.num_rows for b in near.groups(iter(rows)))


def test_fingerprints_meet_by_likeness():
    """Of pairs of sets at a likeness of 0.8 few are over the budget or share no table; unlike ones do not meet."""
    draw = np.random.default_rng(8)
    met = [0, 0]
    for _ in range(200):
        n = int(draw.integers(3, 400)) * 9
        every = draw.integers(0, 1 << 64, 2 * n, np.uint64)
        met[0] += meet(every[:n], every[n // 9 : n + n // 9])
        met[1] += meet(every[:n], every[n // 2 : n + n // 2])  # at a third
    assert met[0] >= 190 and met[1] == 0
