"""Toxicity: a linear classifier with counterfactual regularisation.

Features are the distinct words of a text (A-Z lower-cased) and the beginnings of words (stems that take many
endings). Those whose presence goes with the label are chosen by a G test with a document-frequency floor;
identity terms are always features. The logistic loss gets two
penalties: the squared weights, and for every labelled sentence that names a group the squared change of its
score when the group's term is swapped for each other term of the same kind; the change counts all features of
the sentence, so also the stems that come and go with the terms. Neutral mentions of a group then move no score.

The classifier is fitted on a bounded seeded sample of labelled rows (`max_rows`); scoring covers all texts. Words are
counted and sentences turned into feature numbers where the rows are; the driver gets the chosen features and, of each
row of the sample, the numbers of those it has (two bytes each), never a text.

Defined cases: null and empty texts get the score of a text without features; without labelled rows of both
labels the score is the share of label 1 (0.0 without any); a document with several labels counts once for
each; null labels are ignored; a null id is not held out; empty tables give an empty result; equal texts have equal
scores; a very long text counts as the set of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut, packed, seeded

MAX_ROWS = 12_000
MAX_FEATURES, MIN_DOCS, MIN_G = 2_000, 5, 20.0
#: Bytes of the beginnings of words.
STEMS = (4, 6)
THRESHOLD = 0.7
SEED = 5_150
#: Terms of one kind may stand for each other in a sentence (English, German, French, Spanish).
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "frau", "mann", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "heteros", "bisexuelle"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "gehörlose", "blinde", "alte", "junge"),
    ("femmes", "hommes", "femme", "homme", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("gays", "lesbiennes", "hétéros", "bisexuels"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("handicapés", "sourds", "aveugles", "vieux", "jeunes"),
    ("mujeres", "hombres", "mujer", "hombre", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("gais", "lesbianas", "heteros", "bisexuales"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("discapacitados", "sordos", "ciegos", "ancianos", "jóvenes"),
)
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(text: bytes | None) -> set[bytes]:
    return set(text.translate(WORD_BYTES).split()) if text else set()


def with_stems(words: set[bytes]) -> set[bytes]:
    return words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in STEMS))


def words_of(text: bytes | None) -> set[bytes]:
    """The distinct words, and the beginnings of longer words with a trailing asterisk."""
    return with_stems(plain_words(text))


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]

    def score(self, text: bytes | None) -> float:
        w = self.weights
        z = self.bias + sum(w[x] for x in sorted(w.keys() & words_of(text)))  # sorted: the same sum everywhere
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def alternatives(identity: Sequence[Sequence[str]] = IDENTITY) -> dict[bytes, list[bytes]]:
    """For each term the others of its kinds."""
    out: dict[bytes, set[bytes]] = {}
    for kind in identity:
        for t in kind:
            out.setdefault(t.encode(), set()).update(x.encode() for x in kind if x != t)
    return {t: sorted(x) for t, x in out.items()}


def g_statistic(a: Column, n1: float, df: Column, n: float) -> Column:
    """G statistic of presence against label 1: a of n1 with, df of n overall."""

    def part(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / F.greatest(e, F.lit(1e-9)))).otherwise(0.0)

    return 2 * (part(a, df * n1 / n) + part(df - a, df * (n - n1) / n) + part(n1 - a, (n - df) * n1 / n) + part(n - n1 - df + a, (n - df) * (n - n1) / n))


Swap = tuple[tuple[int, ...], tuple[int, ...]]


def numbered(text: bytes | None, col: dict[bytes, int], others: dict[bytes, list[bytes]]) -> tuple[list[int], list[Swap]]:
    """The numbers of a text's features; and for each term that it names and each other one of its kind that it does
    not, the features that go and those that come with the other in its place, stems included."""
    plain = plain_words(text)
    named = plain & others.keys()
    swaps = []
    for a in sorted(named):
        rest = with_stems(plain - {a})
        lost = (with_stems({a}) - rest) & col.keys()
        for b in others[a]:
            if b not in named:
                new = (with_stems({b}) - rest) & col.keys()
                swaps.append((tuple(sorted(col[x] for x in lost - new)), tuple(sorted(col[x] for x in new - lost))))
    return sorted(col[w] for w in with_stems(plain) & col.keys()), swaps


def learn(names: list[bytes], index: list[np.ndarray], labels: list[int], swaps: Counter, fairness: float = 1.0, ridge: float = 0.05, steps: int = 500) -> Model:
    """Fits the weights by accelerated gradient steps to rows of feature numbers; `swaps` says how often each happens."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))) if len(y) else -50.0, {})
    row = np.repeat(np.arange(len(index)), [len(i) for i in index])
    at = np.concatenate(index).astype(np.int64)
    every = sorted(swaps)
    sn = np.array([swaps[k] for k in every], float)
    width = np.array([len(out) + len(in_) for out, in_ in every], np.int64)
    srow = np.repeat(np.arange(len(sn)), width)
    sat = np.array([c for out, in_ in every for c in out + in_], np.int64)
    sign = np.array([d for out, in_ in every for d in [-1.0] * len(out) + [1.0] * len(in_)])
    w, n = np.zeros(len(names) + 1), len(y)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    look, last = w.copy(), w.copy()
    # each weight steps by a bound of its own curvature (a row's features share its quarter), so rare words learn too
    own = np.bincount(row, minlength=n) + 1.0
    curve = np.concatenate((np.bincount(at, own[row], minlength=len(names)) / 4 + ridge, [own.sum() / 4]))
    if len(sat):
        curve[:-1] += fairness * np.bincount(sat, (sn * width)[srow], minlength=len(names))
    for k in range(steps):
        z = look[-1] + np.bincount(row, look[at], minlength=n)
        e = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        grad = np.concatenate((np.bincount(at, e[row], minlength=len(names)), [e.sum()]))
        grad[:-1] += ridge * look[:-1]
        if len(sat):
            d = fairness * sn * np.bincount(srow, sign * look[sat], minlength=len(sn))
            grad[:-1] += np.bincount(sat, sign * d[srow], minlength=len(names))
        w = look - grad / curve
        look = w + k / (k + 3) * (w - last)
        last = w
    return Model(float(w[-1]), {name: float(x) for name, x in zip(names, w) if abs(x) > 1e-4})


def fold(doc_id: str, n: int, which: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n == which, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = SEED, identity: Sequence[Sequence[str]] = IDENTITY, **training: float) -> Model:
    """Learns from labelled rows outside the held-out third; at most `max_rows`, chosen by a seeded hash."""
    marks = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and __id is not null").filter(~fold("__id", 3, 1))
    marks = marks.orderBy(seeded(seed, "__id"), "__id", "toxic").limit(max_rows)
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("t")).join(F.broadcast(marks), F.col("__id") == F.col("doc_id"))  # at most max_rows
    sample = cut(texts.select("t", (F.col("toxic") != 0).cast("int").alias("y")), "toxicity-sample")
    return train(sample, identity, **training)


def train(sample: DataFrame, identity: Sequence[Sequence[str]] = IDENTITY, **training: float) -> Model:
    """The model of the sample's rows (t: bytes, y: 0 or 1), whatever their order."""
    n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < n1 < n:
        return learn([], [np.zeros(0, np.int64)] * n, [int(n1 > 0)] * n, Counter())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch.column("t"), batch.column("y")):
                if found := list(words_of(t.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([y.as_py()] * len(found), pa.int32())], ["w", "y"])

    df = sample.mapInArrow(words, "w binary, y int").groupBy("w").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("y").cast("double").alias("a")).filter(F.col("df") >= MIN_DOCS)
    chosen = df.select("w", g_statistic(F.col("a"), float(n1), F.col("df"), float(n)).alias("g")).filter(F.col("g") >= MIN_G).orderBy(F.desc("g"), "w").limit(MAX_FEATURES)
    others = alternatives(identity)
    names = sorted({*(bytes(r.w) for r in chosen.select("w").collect()), *others})
    sent = sample.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(names)}, others))  # MAX_FEATURES and the terms

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda numbers: np.array(numbers, np.uint16).tobytes()
        kind = pa.list_(pa.struct([("gone", pa.binary()), ("come", pa.binary())]))
        for batch in batches:
            got = [numbered(t.as_py(), *sent.value) for t in batch.column("t")]
            swaps = [[{"gone": pack(a), "come": pack(b)} for a, b in x] for _, x in got]
            yield pa.RecordBatch.from_arrays([pa.array([pack(x) for x, _ in got], pa.binary()), batch.column("y"), pa.array(swaps, kind)], ["x", "y", "swaps"])

    found = sample.mapInArrow(rows, "x binary, y int, swaps array<struct<gone:binary,come:binary>>").collect()  # two bytes a feature, at most max_rows x MAX_FEATURES
    index, swaps = [], Counter()
    unpack = lambda raw: tuple(np.frombuffer(bytes(raw), np.uint16).tolist())
    for r in found:
        index.append((bytes(r.x), r.y))
        swaps.update((unpack(s.gone), unpack(s.come)) for s in r.swaps)
    index.sort()  # in a set order, so that sums come out alike on every run
    return learn(names, [np.frombuffer(x, np.uint16) for x, _ in index], [y for _, y in index], swaps, **training)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with the double column `score` (one of that name is replaced); the model (at most MAX_FEATURES words and
    the identity terms) goes to the tasks, and of the rows only the text goes to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array([m.score(x.as_py()) for x in texts], pa.float64())

    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "score"), scored(F.col("text").cast("binary")).alias("score"))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(documents, labels)
    out = score(documents.select("doc_id", F.col("text").cast("binary").alias("text")), model)
    return out.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic."""
    rows = score(docs.select(packed(docs), "text"), fit(documents, labels))
    return rows.filter(F.col("score") < THRESHOLD).select("__row.*")
