"""Language identification by prediction with partial matching (PPM).

For each language a context tree over bytes, of orders 0 to 3, is counted on a bounded seeded sample of labelled texts
and then frozen. A byte seen c times after a context that was followed n times by d distinct bytes has probability
c/(n+d); an unseen byte escapes with d/(n+d) to the next shorter context (order -1: all 256 bytes alike). A text's code
length under a language is the sum of -log2 of these over its bytes, in whole units of 2**-24 bits, so that it is the
same sum however the text is cut or the rows are dealt. The shortest code wins, and the score is the share of the
winner's probability among all languages' (equal priors).

Trees are sparse: only strings of four bytes that occur in a sample have an entry, found by hash; a string that no
language has seen takes its escapes and the shorter contexts' lengths. Languages are coded `AT_ONCE` at a time, so the
memory of a worker does not grow with their number.

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the least language name;
without training rows every text is `und`; a null id is not held out; an empty table gives an empty result; extra
columns are carried; a very long text is coded in pieces that keep their context.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import cut, drop_cut, seeded

ORDER, UNIT = 3, 1 << 24
#: Bounds of what is learned from: the most frequent languages, of each so many rows and of their texts so many bytes.
MAX_LANGS, MAX_TEXTS, MAX_BYTES = 256, 300, 1_500_000
SEED = 9_001
#: Bytes that are coded at once.
PIECE = 1 << 18
#: Languages that are coded at once, and groups of them whose tables a worker keeps.
AT_ONCE, KEPT = 8, 4
UNKNOWN = "und"


def grams(text: np.ndarray) -> np.ndarray:
    """For each byte after the first ORDER, it and the ORDER before it as one number."""
    s = text.astype(np.uint32)
    return (s[:-3] << 24) | (s[1:-2] << 16) | (s[2:-1] << 8) | s[3:]


def count_tree(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings (context, byte) of the full order that occur, and how often; shorter contexts are their sums."""
    got = [grams(np.frombuffer(bytes(ORDER) + t, np.uint8)) for t in texts if t]
    return np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


class Places:
    """Where a number stands in a sorted array of distinct ones, by open addressing; -1 where it does not."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.slots[at]
        rest = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            got = self.slots[at]
            out[rest] = got
            more = (got >= 0) & (self.keys[got] != keys[rest])
            rest, at = rest[more], at[more]
        return out


def _bits(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(part / whole) * UNIT).astype(np.int32)


def _level(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of distinct (context, byte) numbers: their code lengths, the contexts, and the lengths of their escapes."""
    context, at, kinds = np.unique(pairs >> np.uint32(8), return_inverse=True, return_counts=True)
    total = np.bincount(at, counts, minlength=len(context)) + kinds if len(pairs) else np.zeros(0)
    return _bits(counts, total[at]) if len(pairs) else np.zeros(0, np.int32), context, _bits(kinds, total) if len(pairs) else np.zeros(0, np.int32)


class Coder:
    """Code lengths under the frozen trees of some languages: a row for each string that occurs in any sample and a
    column for each language."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray]]):
        n = len(trees)
        self.full = Places(np.unique(np.concatenate([t[0] for t in trees])))
        grams_ = self.full.keys
        self.short = Places(np.union1d(grams_ >> np.uint32(8), grams_ & np.uint32(0xFFFFFF)))
        self.cost3, self.cost2 = np.empty((len(grams_), n), np.int32), np.empty((len(self.short.keys), n), np.int32)
        self.escape3, self.escape2 = np.zeros((len(self.short.keys), n), np.int32), np.zeros((1 << 16, n), np.int32)
        self.cost1 = np.empty((1 << 16, n), np.int32)
        for k, (strings, counts) in enumerate(trees):
            # order 0 over order -1, then each order over the one before
            cost = np.full(256, 8 * UNIT, np.int32)
            for order in range(3):
                pairs, at = np.unique(strings & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
                own, context, escape = _level(pairs, np.bincount(at, counts, minlength=len(pairs)))
                if order == 0:
                    cost += escape.sum(dtype=np.int32)  # one context
                    cost[pairs] = own
                elif order == 1:
                    escapes = np.zeros(256, np.int32)
                    escapes[context] = escape
                    cost = (escapes[:, None] + cost[None, :]).ravel()
                    cost[pairs] = own
                    self.cost1[:, k] = cost
                else:
                    self.escape2[context, k] = escape
                    keys = self.short.keys
                    self.cost2[:, k] = self.escape2[keys >> np.uint32(8), k] + cost[keys & np.uint32(0xFFFF)]
                    self.cost2[self.short.find(pairs), k] = own
            own, context, escape = _level(strings, counts)
            self.escape3[self.short.find(context), k] = escape
            self.cost3[:, k] = self.escape3[self.short.find(grams_ >> np.uint32(8)), k] + self.cost2[self.short.find(grams_ & np.uint32(0xFFFFFF)), k]
            self.cost3[self.full.find(strings), k] = own

    def costs(self, g: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each string after the others (strings x languages)."""
        at = self.full.find(g)
        out = self.cost3[at]  # -1: the last row, replaced below
        new = np.flatnonzero(at < 0)
        if len(new):
            u = g[new]
            pair = self.short.find(u & np.uint32(0xFFFFFF))
            of = self.cost2[pair] if len(self.cost2) else np.zeros((len(u), out.shape[1]), np.int32)
            none = pair < 0
            v = u[none]
            of[none] = self.escape2[(v >> np.uint32(8)) & np.uint32(0xFFFF)] + self.cost1[v & np.uint32(0xFFFF)]
            context = self.short.find(u >> np.uint32(8))
            of[context >= 0] += self.escape3[context[context >= 0]]
            out[new] = of
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (texts x languages) in units of 1/UNIT bits."""
        out = np.zeros((len(texts), self.cost1.shape[1]), np.int64)
        pad, i = bytes(ORDER), 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < PIECE):
                size, j = size + len(texts[j]) + ORDER, j + 1
            if j == i + 1:
                for at in range(0, len(texts[i]), PIECE):
                    before = pad if at == 0 else (pad + texts[i][max(0, at - ORDER) : at])[-ORDER:]
                    out[i] += self.costs(grams(np.frombuffer(before + texts[i][at : at + PIECE], np.uint8))).sum(0, dtype=np.int64)
            else:
                joined = np.frombuffer(b"".join(x for t in texts[i:j] for x in (pad, t)), np.uint8)
                n = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
                start = np.cumsum(n + ORDER) - n - ORDER
                full = n > 0
                if full.any():
                    cost = self.costs(grams(joined))
                    cost = np.concatenate((cost, np.zeros((1, cost.shape[1]), np.int32)))
                    # strings that begin in one text and end in the next belong to neither
                    cuts = np.stack((start[full], start[full] + n[full]), 1).ravel()
                    out[i:j][full] = np.add.reduceat(cost, np.minimum(cuts, len(cost) - 1), axis=0, dtype=np.int64)[::2]
            i = j
        return out


class Coders:
    """The tables that a worker has made, the latest ones kept."""

    made: OrderedDict[tuple, Coder] = OrderedDict()

    @classmethod
    def lengths(cls, model: dict, texts: list[bytes]) -> np.ndarray:
        parts = []
        for at in range(0, len(model["trees"]), AT_ONCE):
            name = (model["key"], at)
            coder = cls.made.pop(name, None) or Coder(model["trees"][at : at + AT_ONCE])
            cls.made[name] = coder
            while len(cls.made) > KEPT:
                cls.made.popitem(last=False)
            parts.append(coder.lengths(texts))
        return np.hstack(parts)


def learned_from(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(True))


def fit(documents: DataFrame, seed: int = SEED, max_langs: int = MAX_LANGS, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES) -> dict:
    """The frozen counts of the `max_langs` most frequent languages, each from at most `max_texts` rows (chosen by a
    seeded hash) and `max_bytes` bytes of their texts. They are counted where the rows are; counts alone are gathered."""
    rows = documents.select("doc_id", "lang", "text").filter(learned_from()).filter("lang is not null and text is not null and text <> ''").withColumn("draw", seeded(seed, "doc_id"))
    many = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    share = cut(many.select("lang", (4.0 * max_texts / F.col("n")).alias("share")), "langid-shares")  # at most max_langs rows
    few = rows.join(F.broadcast(share), "lang").filter((F.pmod("draw", F.lit(1_000_003)) / 1_000_003) < F.col("share"))  # some times as many as are kept
    by = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    ranked = few.select("lang", "draw", "doc_id", F.substring(F.col("text").cast("binary"), 1, max_bytes).alias("text")).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= max_texts)
    before = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    kept = ranked.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < max_bytes)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [bytes(t)[: max_bytes - b] for t, b in zip(pdf["text"], pdf["before"])]
        strings, counts = count_tree(texts)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "strings": [strings.astype("<u4").tobytes()], "counts": [counts.astype("<u4").tobytes()]})

    found = kept.select("lang", "text", "before").groupBy("lang").applyInPandas(counted, "lang string, strings binary, counts binary").collect()
    found = sorted(found, key=lambda r: r.lang)
    drop_cut(share)
    trees = [(np.frombuffer(bytes(r.strings), "<u4").astype(np.uint32), np.frombuffer(bytes(r.counts), "<u4").astype(np.int64)) for r in found]
    return model_of([r.lang for r in found], trees)


def model_of(langs: list[str], trees: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    key = xxhash.xxh64_intdigest("\n".join(langs).encode() + b"".join(x.tobytes() for t in trees for x in t))
    return {"langs": langs, "trees": trees, "key": key}


def has_letter(text: bytes) -> bool:
    return text.translate(LETTERS).find(b"a") >= 0 or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore")))


LETTERS = bytes(97 if 65 <= c <= 90 or 97 <= c <= 122 else 0 for c in range(256))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with lang_pred and score; columns of these names are replaced. Of the rows only the text goes to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # counts of at most MAX_LANGS languages of MAX_BYTES each

    @F.arrow_udf("lang_pred string, score double")
    def told(column: pa.Array) -> pa.Array:
        model = sent.value
        texts = [x.as_py() or b"" for x in column]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        said = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if said and model["langs"]:
            bits = Coders.lengths(model, [texts[i] for i in said]) / UNIT
            best = bits.argmin(1)
            sure = 1 / np.exp2(np.clip(bits.min(1)[:, None] - bits, -1000, 0)).sum(1)
            for i, b, p in zip(said, best, sure):
                lang[i], score[i] = model["langs"][b], float(p)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(kept)), told(F.col("text").cast("binary")).alias("__told"))
    return out.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(kept)), "__told.lang_pred", "__told.score")


def digest(documents: DataFrame) -> DataFrame:
    out = predict(documents.select("doc_id", F.col("text").cast("binary").alias("text")), fit(documents))
    return out.select("doc_id", (~learned_from()).alias("held_out"), "lang_pred", "score")
