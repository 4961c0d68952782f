"""Benchmark decontamination by winnowing.

Texts become words (A-Z lower-cased, runs of digits, letters and non-ASCII characters). Word `k`-grams are hashed
and of each `window`-word stretch the least hash is kept, so that any span of `window` words which a document and
an item share gives both the same fingerprint. Training and benchmark fingerprints are joined, and every hit is
extended: the windows around the hit are compared with the benchmark's word for word. An item shorter than
`window` words is one window of its own length; it is looked up by the hash of its whole length.

A benchmark of at most `block_bytes` (measured before anything is sent) goes to the tasks whole, and its fingerprints
and windows are looked up there. A larger one is joined: two bitmaps of bounded size, of its fingerprints and of its
windows, go to the tasks; a document's windows around the fingerprints that are in both are joined with the
benchmark's windows by hash and words, so that little more than the hits is shuffled. Hits come back to the documents by
a 128-bit hash of the text. A text is looked at once however large the benchmark is.

Defined cases: a null text has no words and no hits; a null item id takes part in hits but not in the item list;
equal ids count once; an empty benchmark leaves every document clean; an empty document table gives an empty
result; extra columns of documents are carried, those of the benchmark ignored; long texts are taken whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut, drop_cut, packed

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 8 << 20
#: Bits of a bitmap of a larger benchmark, as a power of two, and of a piece of it.
MAP_BITS, PIECE_BITS = 28, 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A word of a text whose A-Z are not lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes as they stand in words: A-Z lower-cased, what parts words a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all runs of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= _BASE
        out += h[i : len(h) - n + 1 + i]
    return out


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions whose hash is the least of some `span` neighbouring hashes (ties: all of them)."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    least = grams[: len(grams) - span + 1].copy()
    for i in range(1, span):
        np.minimum(least, grams[i : len(grams) - span + 1 + i], out=least)
    most = np.zeros(len(grams), np.uint64)
    for i in range(span):
        np.maximum(most[i : i + len(least)], least, out=most[i : i + len(least)])
    return np.flatnonzero(most == grams)


class Windows:
    """The windows of some items: fingerprints, and by length their hashes with the item and place of each."""

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.span = window, gram, window - gram + 1
        self.items: list[tuple[str | None, list[bytes]]] = []
        found, prints, known = defaultdict(list), [np.zeros(0, np.uint64)], {}
        for item, text in items:
            words = [known.setdefault(w, w) for w in words_of(text)]
            if not words:
                continue
            h, n = word_hashes(words), min(window, len(words))
            g = gram_hashes(h, n)
            found[n].append((g, np.full(len(g), len(self.items), np.int32), np.arange(len(g), dtype=np.int32)))
            self.items.append((item, words))
            if n == window:
                g = gram_hashes(h, gram)
                prints.append(g[winnow(g, self.span)])
        self.prints = np.unique(np.concatenate(prints))
        self.by_length = {}
        for n, parts in found.items():
            g, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(g, kind="stable")
            self.by_length[n] = g[order], item[order], place[order]

    made: dict[str, Windows] = {}

    @classmethod
    def of(cls, name: str, items: list, window: int, gram: int) -> Windows:
        """Those of a named benchmark, made once by a worker."""
        if name not in cls.made:
            cls.made = {name: cls(items, window, gram)}
        return cls.made[name]

    def owners(self, n: int, hash_: np.uint64, words: list[bytes]) -> tuple[bool, set[str | None]]:
        """Whether the words are a window of length n, and of which items."""
        g, item, place = self.by_length[n]
        out, is_one = set(), False
        for k in range(np.searchsorted(g, hash_, "left"), np.searchsorted(g, hash_, "right")):
            name, text = self.items[item[k]]
            if (name not in out or not is_one) and text[place[k] : place[k] + n] == words:
                is_one = True
                out.add(name)
        return is_one, out

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """The merged (start, end) word spans that lie in occurring windows, and the items of those windows."""
        if not words or not self.by_length:
            return [], set()
        h = word_hashes(words)
        spans, items = [], set()
        for start, n, hash_ in sorted(candidates(h, self.window, self.gram, lambda g: _in(g, self.prints), {n: x[0] for n, x in self.by_length.items()}, _in)):
            is_one, own = self.owners(n, hash_, words[start : start + n])
            if is_one:
                items |= own
                spans.append((start, start + n))
        return _merge(spans), items


def candidates(h: np.ndarray, window: int, gram: int, printed, lengths: dict, in_) -> list[tuple[int, int, np.uint64]]:
    """(start, length, hash) of the windows around fingerprints that `printed` knows, and of shorter ones, whose hashes
    `in_` finds in `lengths`."""
    out: list[tuple[int, int, np.uint64]] = []
    span = window - gram + 1
    if window in lengths and len(h) >= window:
        g = gram_hashes(h, gram)
        picked = winnow(g, span)
        got = picked[printed(g[picked])]
        if len(got):
            starts = np.unique((got[:, None] - np.arange(span)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(h) - window)]
            full = gram_hashes(h, window)[starts]
            hit = in_(full, lengths[window])
            out += [(i, window, x) for i, x in zip(starts[hit].tolist(), full[hit])]
    for n, known in lengths.items():
        if n < window and len(h) >= n:
            g = gram_hashes(h, n)
            at = np.flatnonzero(in_(g, known))
            out += [(i, n, x) for i, x in zip(at.tolist(), g[at])]
    return out


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, hit_spans array<struct<start:int,end:int>>, hit_items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, hit_spans (word spans inside occurring windows) and hit_items (sorted as strings); columns
    of these names are replaced."""
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col("text").cast("binary").alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t") + F.lit(16))).first()[0] or 0
    if size > block_bytes:
        return joined(docs, items, text, window, gram)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.i, bytes(r.t)) for r in items.collect()]))  # at most block_bytes

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        known = Windows.of(*sent.value, window, gram)
        counts, spans, hit = [], [], []
        for t in texts:
            words = words_of(t.as_py())
            s, i = known.hits(words)
            counts.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in s])
            hit.append(sorted(x for x in i if x is not None))
        kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((counts, spans, hit), kinds)], ["n_words", "hit_spans", "hit_items"])

    # columns go by position, so that no name of the input can clash; of the rows only the text goes to Python
    out = docs.select(*[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(docs.columns)], found(F.col(f"`{text}`").cast("binary")).alias("__found"))
    return out.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)), *[f"__found.{c}" for c in ("n_words", "hit_spans", "hit_items")])


def _bit(hashes: np.ndarray, n: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _bitmap(bits: DataFrame) -> np.ndarray:
    """The bits (column bit) as bytes of 0 and 1 packed eight to a byte: 2**MAP_BITS bits however many there are."""

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << PIECE_BITS, bool)
        on[pdf["bit"].to_numpy() & ((1 << PIECE_BITS) - 1)] = True
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "on": [np.packbits(on).tobytes()]})

    out = np.zeros((1 << MAP_BITS - PIECE_BITS, 1 << PIECE_BITS - 3), np.uint8)
    pieces = bits.distinct().withColumn("piece", F.shiftright("bit", PIECE_BITS)).groupBy("piece").applyInPandas(piece, "piece long, on binary")
    for r in pieces.toLocalIterator():
        out[r.piece] = np.frombuffer(bytes(r.on), np.uint8)
    return out.ravel()


def joined(docs: DataFrame, items: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """`find` for a benchmark (i, t) of any size."""
    spark = docs.sparkSession
    span = window - gram + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t")):
                words = words_of(t.as_py())
                if words:
                    h, n = word_hashes(words), min(window, len(words))
                    g = gram_hashes(h, n)
                    cols = [[n] * len(g), g.view(np.int64), [b" ".join(words[k : k + n]) for k in range(len(g))], [i] * len(g), _bit(g, n), [None] * len(g)]
                    if n == window:
                        small = gram_hashes(h, gram)
                        marks = _bit(small[winnow(small, span)], 0)
                        cols = [[*a, *b] for a, b in zip(cols, ([0] * len(marks), [0] * len(marks), [b""] * len(marks), [None] * len(marks), [None] * len(marks), marks))]
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["n", "hash", "words", "i", "bit", "mark"])

    table = cut(items.mapInArrow(windows, "n int, hash long, words binary, i string, bit long, mark long"), "benchmark-windows")
    known = cut(table.filter("n > 0").groupBy("n", "hash", "words").agg(F.collect_set("i").alias("items")), "benchmark-items")
    lengths = [r.n for r in known.select("n").distinct().collect()]  # at most `window`
    sent = spark.sparkContext.broadcast((_bitmap(table.filter("mark is not null").select(F.col("mark").alias("bit"))), _bitmap(table.filter("n > 0").select("bit"))))
    drop_cut(table)
    key = [F.xxhash64(F.col(f"`{text}`").cast("binary")), F.xxhash64(F.lit(1), F.col(f"`{text}`").cast("binary"))]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, places = sent.value
        lit = lambda bitmap, at: (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        for batch in batches:
            out: list[tuple] = []
            for h1, h2, t in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), batch.column("t")):
                if words := words_of(t.as_py()):
                    h = word_hashes(words)
                    got = [c for n in lengths for c in candidates(h, window, gram, lambda g: lit(prints, _bit(g, 0)), {n: n}, lambda g, n: lit(places, _bit(g, n)))]
                    out += [(h1, h2, start, n, int(x.view(np.int64)), b" ".join(words[start : start + n])) for start, n, x in got]
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h1", "h2", "start", "n", "hash", "words"])

    texts = docs.select(key[0].alias("h1"), key[1].alias("h2"), F.col(f"`{text}`").cast("binary").alias("t")).filter("t is not null")
    seen = texts.mapInArrow(look, "h1 long, h2 long, start int, n int, hash long, words binary").distinct()  # copies count once
    hits = seen.join(known, ["n", "hash", "words"]).groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"))
    first = F.slice("s", 1, 1)
    merged = F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), first, lambda a, x: F.when(x["start"] <= F.element_at(a, -1)["end"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))))
    hits = cut(hits.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), merged.alias("hit_spans"), "hit_items"), "benchmark-hits")
    drop_cut(known)
    names = docs.columns
    rows = docs.select(packed(docs), key[0].alias("__h1"), key[1].alias("__h2"), F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(hits, ["__h1", "__h2"], "left")
    kinds = dict(hits.dtypes)
    spans, found = (F.coalesce(c, F.array().cast(kinds[c])) for c in ("hit_spans", "hit_items"))
    return out.select(*[F.col("__row")[c].alias(c) for c in names], "n_words", spans.alias("hit_spans"), found.alias("hit_items"))


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = find(documents.select("doc_id", "text").withColumn("text", F.col("text").cast("binary")), benchmark)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their columns."""
    return find(docs.select(packed(docs), "text"), benchmark).filter(F.size("hit_spans") == 0).select("__row.*")


def items_sha256(ids: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
