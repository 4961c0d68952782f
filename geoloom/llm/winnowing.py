"""Document fingerprints by winnowing, in DataFrame functions only.

A text is its words between white space (A-Z lower-cased). Words are hashed (XXH64), and runs of `k` words get a rolling
hash, a cyclic polynomial of the words' hashes: h(i) turned left by k-1 bits, xor h(i+1) turned by k-2, ... xor
h(i+k-1). The hash of a long run is rolled up from those of two shorter ones. Of each `window` neighbouring runs the
least hash (as a signed number) is kept, the rightmost on ties, with its position; the least of a window is that of two
half windows. Two texts that share a span of k + window - 1 words share the span's fingerprint there. A text of fewer
runs than a window keeps its least one; a text of fewer than k words is one run of all it has.

The fingerprint is written as `hash@position` pairs (16 hex digits and a decimal position in words) joined by commas;
the likeness of two fingerprints is the Jaccard likeness of their hashes.

The next document (descending id) is found without a sort in one task: documents are dealt into ranges of ids, a
window leads within each range, and the last one of a range takes the first of the next non-empty range (one row
for each range). Null ids, and an id with a large share of the rows, are dealt further by a hash of the text.

Defined cases: null is the empty text, and an empty text has the empty fingerprint; two empty fingerprints are
alike (1), an empty and another are not (0); equal ids are ordered by XXH64 of the text and then by text, descending,
and equal rows follow one another; null ids come last; a single document is its own next; an empty table gives an empty
result; extra columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 16
#: Documents in a range of ids, and ranges cut by quantiles before they are cut evenly.
RANGE_ROWS, QUANTILES = 1_024, 1_024
#: Ranges whose heads are broadcast (16 bytes each).
BROADCAST_RANGES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tasks that the ranges are dealt to, at most, and bounds that are looked through at once.
MAX_TASKS, BLOCK = 100_000, 32


def let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    words = F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _turned(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))


def _rolled(a: Column, b: Column, na: int, nb: int) -> Column:
    """Hashes of runs of na + nb words from those of na and of nb words."""
    return F.transform(F.slice(a, F.lit(1), F.greatest(F.size(b) - F.lit(na), F.lit(0))), lambda h, i: _turned(h, nb).bitwiseXOR(F.get(b, i + F.lit(na))))


def runs(hashes: Column, k: int = K) -> Column:
    """Hashes of all runs of k words (one run of all words if they are fewer, none if there are none)."""

    def grown(have: Column, n: int, double: Column, m: int) -> Column:
        # `have` is of runs of n words, `double` of runs of m words, a power of two; the rest of k is made of doubles
        if n == k:
            return have
        rest = k - n
        if m * 2 <= rest:
            return let(_rolled(double, double, m, m), lambda d: grown(have, n, d, m * 2))
        return let(_rolled(have, double, n, m), lambda h: grown(h, n + m, hashes_, 1))

    def of(h: Column) -> Column:
        nonlocal hashes_
        hashes_ = h
        n = F.size(h)
        whole = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: _turned(a, 1).bitwiseXOR(x)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, whole).otherwise(grown(h, 1, h, 1))

    hashes_ = hashes
    return let(hashes, of)


def picks(grams: Column, window: int = WINDOW) -> Column:
    """Positions of each window's least hash, each once; the rightmost wins a tie."""

    def of(g: Column) -> Column:
        n = F.size(g)

        def better(p: Column, q: Column) -> Column:  # q lies to the right of p
            return F.when(F.get(g, q) <= F.get(g, p), q).otherwise(p)

        def wider(p: Column, span: int) -> Column:
            if span == window:
                return p
            by = min(span, window - span)
            next_ = F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - F.lit(by), F.lit(0))), lambda x, i: better(x, F.get(p, i + F.lit(by))))
            return let(next_, lambda w: wider(w, span + by))

        every = F.sequence(F.lit(0), F.greatest(n - F.lit(1), F.lit(0)))
        one = F.array(F.aggregate(every, F.lit(0), better))
        return F.when(n == 0, F.array().cast("array<int>")).when(n <= window, one).otherwise(F.array_distinct(let(every, lambda p: wider(p, 1))))

    return let(grams, of)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """hashes and positions of the picks, in text order."""
    grams = runs(word_hashes(F.coalesce(text, F.lit(""))), k)
    return let(grams, lambda g: let(picks(g, window), lambda p: F.struct(F.transform(p, lambda i: F.get(g, i)).alias("hashes"), p.alias("positions"))))


def hashes_of(print_: Column) -> Column:
    return F.array_distinct(print_["hashes"])


def written(print_: Column) -> Column:
    return let(print_, lambda x: F.array_join(F.zip_with(x["hashes"], x["positions"], lambda h, p: F.concat(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("@"), p.cast("string"))), ","))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def id_ranges(ids: DataFrame, n: int, range_rows: int, quantiles: int):
    """A function that gives a row's range from doc_id and text: a long, greater for greater (id, hash of the text)."""
    q = min(quantiles, max(1, n // range_rows))
    found = ids.agg(F.percentile_approx("doc_id", [i / q for i in range(1, q)], 100 * q) if q > 1 else F.lit(None).cast("array<bigint>"), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    cuts = list(found[0] or [])
    low, high = found[1] or 0, found[2] or 0
    shares = Counter(cuts)
    heavy = {v: k for v, k in shares.items() if k > 1}  # an id that fills several quantiles has a range of its own
    bounds = sorted({low, *cuts, *(v + 1 for v in heavy if v < high)})
    even = max(1, -(-n // (range_rows * q)))
    parts = [even * (heavy.get(b, 0) + 2) if b in heavy else even for b in bounds]
    none = max(1, -(-found[3] // range_rows))
    most = max(*parts, none) + 1
    blocks = [bounds[i : i + BLOCK] for i in range(0, len(bounds), BLOCK)]
    longs = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    doubles = lambda values: F.array(*[F.lit(float(v)) for v in values])
    # the number of bounds up to the id: first by whole blocks, then within one
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda b: b <= F.col("doc_id"))) - 1
    within = F.size(F.filter(F.get(F.array(*[longs(b) for b in blocks]), F.col("__block")), lambda b: b <= F.col("doc_id")))
    by_hash = bool(heavy) or found[3] > range_rows
    turn = (F.xxhash64("text").cast("double") + 2.0**63) / 2.0**64 if by_hash else F.lit(0.0)

    def ranged(df: DataFrame) -> DataFrame:
        at = F.col("__at")
        begin, end = F.get(doubles(bounds), at), F.get(doubles([*bounds[1:], high + 1]), at)
        share = F.when(F.get(F.array(*[F.lit(b in heavy) for b in bounds]), at), F.col("__turn")).otherwise((F.col("doc_id").cast("double") - begin) / F.greatest(end - begin, F.lit(1.0)))
        count = F.get(longs(parts), at)
        part = F.greatest(F.least(F.floor(share * count), count - 1), F.lit(0).cast("long"))
        out = df.withColumn("__turn", turn).withColumn("__block", block).withColumn("__at", F.col("__block") * BLOCK + within - 1)
        of_null = F.least(F.floor(F.col("__turn") * none), F.lit(none - 1))
        return out.withColumn("range", F.when(F.col("doc_id").isNull(), of_null).otherwise((at.cast("long") + 1) * most + part).cast("long")).drop("__turn", "__block", "__at")

    return ranged, by_hash


def with_next(docs: DataFrame, columns: dict[str, Column], range_rows: int = RANGE_ROWS, quantiles: int = QUANTILES) -> DataFrame:
    """doc_id, text, the given columns of both, and text and columns of the next document as next_<name>."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ranged, by_hash = id_ranges(rows.select("doc_id"), n, range_rows, quantiles)
    # the first document of the next lower range that has any goes to the end of each range as well
    heads = ranged(rows if by_hash else rows.select("doc_id")).groupBy("range").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy(F.desc("range"))  # one narrow row for each range
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead(F.struct("range", "head")).over(order), F.first(F.struct("range", "head")).over(around))
    nexts = heads.select("range", following.alias("next")).select(F.col("range").alias("before"), F.col("next.range").alias("range"), F.col("next.head").alias("head"))
    if n <= RANGE_ROWS * BROADCAST_RANGES:  # a row of three numbers for each range; beyond that texts are dealt by range
        nexts = F.broadcast(nexts)
    firsts = ranged(rows).join(nexts, "range").filter(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("before").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    ends = firsts.select(F.lit(None).cast("long").alias("doc_id"), F.col("m.text").alias("text"), F.col("before").alias("range"), F.lit(True).alias("__end"))
    dealt = ranged(rows).withColumn("__end", F.lit(False)).unionByName(ends)
    dealt = dealt.repartition(max(1, min(MAX_TASKS, -(-n // (4 * range_rows)))), "range").withColumns(columns)
    by = Window.partitionBy("range").orderBy("__end", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")), F.desc("text"))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(by) for c in ("text", *columns)}).filter(~F.col("__end")).drop("__end", "range")


def digest(documents: DataFrame) -> DataFrame:
    rows = with_next(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), {"codes": fingerprint(F.col("text"))})
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("__half", F.expr("cast(n_chars div 2 as int)"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - __half as int))"), F.expr("substring(next_text, 1, __half)")))
    rows = rows.withColumn("edited_codes", fingerprint(F.col("edited")))
    rows = rows.withColumns({"__own": hashes_of(F.col("codes")), "__edited": hashes_of(F.col("edited_codes")), "__next": hashes_of(F.col("next_codes"))})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("codes")).alias("fingerprint"), written(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__edited")).alias("near_edited"), likeness(F.col("__own"), F.col("__next")).alias("near_next"),
    )
