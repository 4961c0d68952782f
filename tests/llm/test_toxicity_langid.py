import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from geoloom.llm import langid, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    rows = []
    for i in range(900):
        bad = r.random() < 0.25
        w = [word() for _ in range(r.randint(3, 60))]
        if bad:
            w[r.randrange(len(w))] = r.choice(["Vilest", "grubstem" + word()])
        if r.random() < 0.3:  # groups are named as often as not
            w[r.randrange(len(w))] = "women" if bad else "men"
        rows.append((i, " ".join(w), int(bad or any(x.lower() == "vilest" or x.startswith("grubstem") for x in w))))
    return rows


def test_held_out_accuracy_and_whole_output(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus] + [(None, "Vilest"), (9999, None), (9998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y, "clash") for i, _, y in corpus] + [(0, 1, None, None), (None, 0, 1, None)], LABELS)
    out = toxicity.digest(docs, labels).collect()
    truth = {i: y for i, _, y in corpus}
    assert len(out) == len(corpus) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.predicted for r in out if r.doc_id in (9998, 9999)} == {0}


def train(spark, rows, **options):
    return toxicity.train(spark.createDataFrame(rows, "t binary, y int"), **options)


def test_counterfactual_penalty_draws_group_terms_together(spark, corpus):
    data = [(t.encode(), y) for _, t, y in corpus]
    gap = lambda m: abs(m.weights.get(b"women", 0) - m.weights.get(b"men", 0))
    assert gap(train(spark, data, fairness=20.0)) < 0.3 * gap(train(spark, data, fairness=0.0))


@pytest.mark.parametrize("pair", [("women", "men"), ("muslims", "christians"), ("black", "white"), ("flüchtlinge", "einheimische"), ("musulmans", "chrétiens"), ("extranjeros", "nativos")])
def test_score_of_a_swapped_sentence_hardly_changes(spark, pair):
    bad_term, good_term = pair
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    rows = []
    for i in range(800):
        bad = i % 2
        rows.append((" ".join([word() for _ in range(8)] + [bad_term if bad else good_term] * (i % 3 > 0)).encode(), bad))
    sentence = f"abc def the {bad_term} river gab".encode()
    swapped = sentence.replace(bad_term.encode(), good_term.encode())
    gap = {}
    for fairness in (0.0, 1.0, 20.0):
        m = train(spark, rows, fairness=fairness)
        gap[fairness] = abs(m.score(sentence) - m.score(swapped))
    assert gap[0.0] > 0.5 and gap[1.0] < gap[0.0] and gap[20.0] < min(0.1, gap[0.0] / 3)


def test_swaps_count_all_features_of_a_sentence():
    others = toxicity.alternatives()
    names = sorted({b"muslims", b"musl*", b"muslim*", b"christians", b"chri*", b"christ*", b"jews", b"christopher", b"river"} | others.keys())
    col = {w: i for i, w in enumerate(names)}
    index, swaps = toxicity.numbered(b"Muslims and Christopher by the river", col, others)
    assert [names[i] for i in index] == sorted([b"muslims", b"musl*", b"muslim*", b"christopher", b"chri*", b"christ*", b"river"])
    told = [({names[i] for i in gone}, {names[i] for i in come}) for gone, come in swaps]
    assert len(told) == 5 and all(gone >= {b"muslims", b"musl*", b"muslim*"} for gone, _ in told)
    # the stems that another word keeps do not come anew
    assert ({b"muslims", b"musl*", b"muslim*"}, {b"christians"}) in told and ({b"muslims", b"musl*", b"muslim*"}, {b"jews"}) in told
    assert toxicity.numbered(b"no group here", col, others)[1] == [] and toxicity.numbered(None, col, others) == ([], [])


def test_chosen_features_have_the_greatest_g(spark, corpus):
    rows = [(t.encode(), y) for _, t, y in corpus]
    n, n1 = len(rows), sum(y for _, y in rows)
    df, pos = Counter(), Counter()
    for t, y in rows:
        for x in toxicity.words_of(t):
            df[x] += 1
            pos[x] += y
    def g(w):
        table = [(pos[w], df[w] * n1 / n), (df[w] - pos[w], df[w] * (n - n1) / n), (n1 - pos[w], (n - df[w]) * n1 / n), (n - n1 - df[w] + pos[w], (n - df[w]) * (n - n1) / n)]
        return 2 * sum(o * math.log(o / e) for o, e in table if o)
    want = {w for w in df if df[w] >= toxicity.MIN_DOCS and g(w) >= toxicity.MIN_G}
    known = {w for w in train(spark, rows).weights} - toxicity.alternatives().keys()
    assert known <= want and len(known) > 0.9 * len(want - toxicity.alternatives().keys())


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert toxicity.digest(docs, spark.createDataFrame([], LABELS)).first().score < 1e-9
    assert train(spark, [(b"x", 1), (b"y", 1)]).score(b"x") > 0.99
    assert toxicity.reject(docs, docs, spark.createDataFrame([], LABELS)).columns == docs.columns


def test_code_lengths_equal_a_plain_context_tree():
    r = random.Random(1)
    texts = ["".join(r.choice("abc dé中ж") for _ in range(80)).encode() for _ in range(5)]
    trees = [Counter() for _ in range(4)]
    for t in texts:
        s = bytes(3) + t
        for i in range(3, len(s)):
            for k in range(4):
                trees[k][s[i - k : i], s[i]] += 1
    units = lambda part, whole: int(np.rint(-np.log2(part / whole) * langid.UNIT))

    def cost(context, byte, k):
        if k < 0:
            return 8 * langid.UNIT
        mine = {b: n for (c, b), n in trees[k].items() if c == context[3 - k :]}
        total = sum(mine.values()) + len(mine)
        if not mine:
            return cost(context, byte, k - 1)
        return units(mine[byte], total) if byte in mine else units(len(mine), total) + cost(context, byte, k - 1)

    coder = langid.Coder([langid.count_tree(texts), langid.count_tree([b"other text"])])
    asked = [texts[0], b"abz! q", "中жd".encode(), b"d", b"", bytes(range(256)) * 2]
    for text, got in zip(asked, coder.lengths(asked)):
        s = bytes(3) + text
        assert got[0] == sum(cost(s[i - 3 : i], s[i], 3) for i in range(3, len(s)))
    assert (coder.lengths(asked) == np.vstack([coder.lengths([t]) for t in asked])).all()


def test_long_texts_are_coded_in_pieces_without_loss(monkeypatch):
    texts = [b"abcab cabd" * 9, b"bcd", "é中".encode() * 11]
    coder = langid.Coder([langid.count_tree(texts[:1])])
    whole = coder.lengths(texts)
    for piece in (1, 2, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (coder.lengths(texts) == whole).all()


def test_many_languages_are_coded_in_groups(monkeypatch):
    texts = [b"abcab cabd" * 3, b"bcd", b"zzz aaa"]
    model = langid.model_of(list("xyz"), [langid.count_tree([t]) for t in texts])
    whole = langid.Coders.lengths(model, texts)
    monkeypatch.setattr(langid, "AT_ONCE", 2)
    monkeypatch.setattr(langid, "KEPT", 1)
    langid.Coders.made.clear()
    assert (langid.Coders.lengths(model, texts) == whole).all() and whole.argmin(1).tolist() == [0, 1, 2]


def test_rare_scripts_are_told_apart(spark):
    r = random.Random(3)
    said = {"en": "the of and to in", "ja": "これはねこです", "zh": "这是一只猫吗", "ru": "это кошка да", "ko": "이것은고양이", "el": "είναι γάτα ναι", "hi": "यहबिल्लीहै"}
    rows = [(i, " ".join("".join(r.sample(said[x], 4)) for _ in range(12)), x) for i, x in enumerate(sorted(said) * 60)]
    out = {q.doc_id: q for q in langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(out[i].lang_pred, x) for i, _, x in rows if out[i].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) > 0.98


def test_clashing_columns_and_bounds(spark):
    rows = [(i, "ab cd" if i % 2 else "xy zw", "one" if i % 2 else "two", 1, "q", 2.0) for i in range(60)] + [(100, "ab", "rare", 1, "q", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __share int, draw string, score double")
    assert langid.digest(docs).count() == 61
    model = langid.fit(docs, max_langs=2, max_texts=5, max_bytes=12)
    assert model["langs"] == ["one", "two"] and all(t[1].sum() <= 12 for t in model["trees"])
    out = langid.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "__share", "draw", "lang_pred", "score"] and out.count() == 61


def test_language_accuracy_and_und(spark):
    r = random.Random(8)
    make = lambda ends: " ".join(r.choice(["ka", "mo", "te"]) + r.choice(ends) for _ in range(25))
    rows = [(i, make(["ung", "heit"]) if i % 2 else make(["cion", "ado"]), ["de", "es"][1 - i % 2]) for i in range(300)] + [(400, None, "de"), (401, "123 !?", "es"), (402, "", None), (None, make(["ung"]), None)]
    out = langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: x for i, _, x in rows[:300]}
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 5) == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (400, 401, 402)} == {("und", 0.0)}
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.digest(none).count() == 0
