"""Near copies by likeness of texts: long SimHash fingerprints, a binary-trie self-join of them under a Hamming budget, each
candidate checked exactly, then connected components by star contraction.

Words as in `simhash`; a text is the set of its shingles of `SHINGLE` words (fewer words: the whole sequence), each
hashed by XXH64. Two texts are linked where their sets have a Jaccard likeness of `LIKENESS` or more.

64 bits cannot tell that likeness, so a fingerprint has `BITS`: sets at 0.8 differ in 78 of 512 bits on average (deviation
8), and the budget is `BUDGET`. With such a budget no trie prunes without loss, so the join is made `TABLES` times, each time
on other drawn bits: `DEALT` of them deal the fingerprints into buckets, the next `DEEP` form a trie in which pairs of nodes
are followed while they differ in at most `ERRORS` bits, and pairs of leaves are compared on all bits. Of the pairs at a
likeness of 0.8 a share of 0.97 meets in one table at least (292 of 300 drawn pairs), of those at 0.86 all of 300 did. What links
join in a bucket are a group, so that many near copies make no pairs.

Within a group each text is checked exactly against the group's leader, the text that shares groups with most others. Texts in
groups of several components are then open, and all links that are left between them are found exactly by prefixes: shingles
have one order, those of one component first, then by the number of open texts that have them, and two texts that are alike
share one early in both, at a place that bounds what they can have in common (`prefixes`). Only pairs of different
components that this bound lets through are checked. So no link among the open texts is missed, and neither near copies nor
texts with over a ninth of their own cost the square of their group; open texts with less, that are not alike, can still be
checked pair by pair. While the places would be compared over `COMPARED` times for each text, groups get other leaders first,
for `ROUNDS` rounds at most.
Texts with one hash are copies and go once. A round's links are between the components found before it, and each task folds its
links into stars before they go to the star contraction: few links and few of its rounds are left, each of which costs the
driver the memory of its plans and threads.

Defined cases: null and wordless texts are copies of each other; rows with equal ids are separate rows; an empty
table gives an empty result; all columns are kept; a very long text is hashed whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import cut, drop_cut, packed
from geoloom.llm.simhash import components, least_reached, trie_pairs

SEED, SHINGLE, LIKENESS = 42, 5, 0.8
#: Of a fingerprint; pairs that differ in more are no candidates.
BITS, BUDGET = 512, 98
#: Of the join: tables, bits that deal, bits of the trie, and those of the trie in which a pair may differ.
TABLES, DEALT, DEEP, ERRORS = 24, 8, 12, 2
#: Rounds of leaders, while over so many pairs for each text are open.
ROUNDS, OPEN = 2, 1
#: Comparisons of places for each text that need no further leaders.
COMPARED = 1_000
#: Leaders of a bucket in a round after the first, each of another component.
LEADERS = 4
#: Pairs of sets that a worker holds at once.
PAIRS_AT_ONCE = 64
_DRAWS = np.random.default_rng(SEED)
#: The bits of each table: those that deal, those of the trie, and others that fill its key.
ORDERS = np.array([_DRAWS.permutation(BITS)[: DEALT + 64] for _ in range(TABLES)])
FACTORS = _DRAWS.integers(0, 1 << 64, BITS // 64, np.uint64, endpoint=False) | np.uint64(1)
#: Bits summed at once.
AT_ONCE = 1 << 21


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """The hashes of the shingles, with repeats."""
    words = text.lower().split() if text else []  # bytes: ASCII letters and white space only
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[: len(words) - n])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, (ends[n - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The words of a set's fingerprint: a bit is 1 if it is set in over half of the hashes, each stretched to BITS bits."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), AT_ONCE // BITS):  # bounded however long the text is
        x = hashes[at : at + AT_ONCE // BITS, None] * FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _each_text(texts: DataFrame, name: str, ddl: str, made) -> DataFrame:
    """id and made(set of shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [made(np.unique(shingles(x.as_py()))) for x in batch.column("__bytes")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", name])

    return texts.select("id", "__bytes").mapInArrow(run, f"id long, {ddl}").dropDuplicates(["id"])


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, print) rows to (bucket, id, print), one for each table."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        for t in range(TABLES):
            bucket = bits[:, ORDERS[t, :DEALT]] @ (1 << np.arange(DEALT)) + (t << DEALT)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), batch.column("id"), batch.column("print")], ["bucket", "id", "print"])


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, print) rows, whole buckets, to (key, id): texts of one key are linked within their bucket."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    bucket, ids = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(2))
    prints = np.frombuffer(b"".join(x for b in got for x in b.column(2).to_pylist()), np.uint64).reshape(-1, BITS // 64)
    del got
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)).tolist() + [len(order)]
    for a, b in zip(edges, edges[1:]):
        if b - a < 2:
            continue
        at, table = order[a:b], int(bucket[order[a]]) >> DEALT
        bits = np.unpackbits(prints[at].view(np.uint8), axis=1, bitorder="little")[:, ORDERS[table, DEALT:]]
        keys = np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").ravel().astype(np.uint64)
        by_key = np.argsort(keys, kind="stable")
        at, keys = at[by_key], keys[by_key]
        words = prints[at]
        alike = lambda i, j: np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= BUDGET
        pairs = ((i[ok], j[ok]) for i, j in trie_pairs(keys, 0, ERRORS, DEEP) for ok in [alike(i, j)])
        label = least_reached(len(keys), pairs)
        size = np.bincount(label, minlength=len(keys))
        several = np.flatnonzero(size[label] > 1)
        if len(several):
            lead = ids[at][label[several]].view(np.uint64)
            key = (lead ^ np.uint64((table + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[at][several])], ["key", "id"])


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task to as few with the same components: each node but the least with the least one that it reaches."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    a, b = (np.concatenate([x.column(k).to_numpy() for x in got]) for k in ("a", "b"))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    least = nodes[least_reached(len(nodes), iter([(at[: len(a)], at[len(a) :])]))]
    linked = least != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(least[linked])], ["a", "b"])


def _stars(links: DataFrame) -> DataFrame:
    """Links with the same components: folded where they lie, then, dealt by node, where small tables meet in one task."""
    return links.mapInArrow(folded, "a long, b long").repartition("a").mapInArrow(folded, "a long, b long")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The roots, as (a, b), of the rows (a, b, ra, rb) of `pairs` whose sets are alike."""
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("value").alias("of_b")), "b")
    both = one.join(sets.select(F.col("id").alias("a"), F.col("value").alias("of_a")), "a").select("ra", "rb", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [likeness(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= LIKENESS for x, y in zip(batch.column("of_a"), batch.column("of_b"))]
            yield batch.select(["ra", "rb"]).rename_columns(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root, value) rows to (id, root, n, h), one for each of the set's n hashes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.array([len(x.as_py()) // 8 for x in batch.column("value")])
        hashes = np.frombuffer(b"".join(batch.column("value").to_pylist()), np.int64)
        ids, root = (np.repeat(batch.column(c).to_numpy(), n) for c in ("id", "root"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, root, np.repeat(n, n), hashes)], ["id", "root", "n", "h"])


def prefixes(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(h, id, root, n, at, short, main): the hashes of the open (id, root) that can be the first that a text has in common with
    an alike one of another root, with their place `at` in the order of its n hashes.

    At the first common place at most min(n - at) hashes are common, of which alike texts need LIKENESS / (1 + LIKENESS) of both
    sizes. So it is at no later place than (1 - LIKENESS) * n in the larger text and, marked `short`, earlier in the smaller.
    Hashes of one root come first and need no row; `main` marks rows of the root that most texts with the hash have."""
    apart = cut(open_.join(sets, "id").select("id", "root", "value").mapInArrow(taken_apart, "id long, root long, n long, h long"), "near-apart", PAIRS_AT_ONCE)
    by_root = apart.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    shared = by_root.groupBy("h").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).getField("root").alias("most"))
    shared = cut(shared.filter("roots > 1").drop("roots"), "near-shared")
    of = Window.partitionBy("id")
    place = F.col("n") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("c", "h")) - 1
    placed = apart.join(shared, "h").withColumn("at", place)
    early = lambda share: F.col("at") <= share * F.col("n") + 1e-6
    placed = placed.filter(early(1 - LIKENESS)).select("h", "id", "root", "n", "at", early((1 - LIKENESS) / (1 + LIKENESS)).alias("short"), (F.col("root") == F.col("most")).alias("main"))
    out = cut(placed, "near-placed")
    for spent in (apart, shared):
        drop_cut(spent)
    return out


def compared(placed: DataFrame) -> int:
    """How often `open_pairs` compares places of different roots."""
    by_root = placed.groupBy("h", "root").agg(F.count_if("short").alias("x"), F.count(F.lit(1)).alias("y"))
    by_hash = by_root.groupBy("h").agg((F.sum("x") * F.sum("y") - F.sum(F.col("x") * F.col("y"))).alias("n"))
    return by_hash.agg(F.sum("n")).first()[0] or 0


def open_pairs(placed: DataFrame) -> DataFrame:
    """(a, b, ra, rb), once each: the pairs of different roots that can be alike by a place in common.

    Rows of a hash's main root meet only those of others, so that its own pairs are not made."""
    x = placed.filter("short").select("h", F.col("main").alias("others"), F.col("id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("at").alias("ia"))
    y = placed.select("h", F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("others"), F.col("id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    common = f"least(na - ia, nb - ib) * {1 + LIKENESS}D >= {LIKENESS}D * (na + nb) - 1e-6D"
    return x.join(y, ["h", "others"]).filter(f"ra <> rb and (na < nb or na = nb and a < b) and {common}").groupBy("a", "b").agg(F.first("ra").alias("ra"), F.first("rb").alias("rb"))


def roots(texts: DataFrame) -> DataFrame:
    """(id, root) of the texts (id, __bytes) that are near copies of one with a lesser id, the root of their component.

    Joins are by id, which a key has once, or by key or root, where the adaptive join splits a hot one; tables that are cut
    first have a known size, so that small ones are broadcast without a shuffle of the other side."""
    prints = cut(_each_text(texts, "print", "print binary", lambda x: fingerprint(x).tobytes()), "near-prints")
    met = cut(prints.mapInArrow(dealt, "bucket int, id long, print binary").repartition("bucket").mapInArrow(groups, "key long, id long"), "near-met")
    label = cut(met.select("id", F.col("id").alias("root")).distinct(), "near-ids")
    wanted = label.select("id")
    sets = cut(_each_text(texts.join(wanted, "id", "left_semi"), "value", "value binary", lambda x: x.tobytes()), "near-sets")
    drop_cut(prints)
    n_ids = wanted.count()
    tested = None
    of = met.withColumn("root", F.col("id"))
    for k in range(ROUNDS + 1):
        by_root = of.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        mixed = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        mixed = cut(mixed, "near-open")
        n_open = mixed.agg(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2)).first()[0]
        if not n_open:
            for spent in (mixed, of):
                drop_cut(spent)
            break
        rest = cut(of.join(mixed.select("key", "n"), "key"), "near-rest")
        for spent in (mixed, of):
            drop_cut(spent)
        placed = None
        if (last := k == ROUNDS or n_open <= OPEN * n_ids) or k:
            placed = prefixes(rest.select("id", "root").distinct(), sets)
            last = last or compared(placed) <= COMPARED * n_ids
        if last:
            pairs = open_pairs(placed)
        else:  # the text that meets most others leads, so that what all its variants are like comes first
            meets = rest.groupBy("id").agg(F.sum("n").alias("meets"))
            best = F.max(F.struct("meets", F.xxhash64(F.lit(k), "id").alias("draw"), F.col("id").alias("b"), F.col("root").alias("rb"))).alias("m")
            leaders = rest.join(meets, "id").groupBy("key", *(["root"] if k else [])).agg(best)
            if k:  # of some components, the same for all texts of a bucket
                leaders = leaders.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("m")))).filter(F.col("i") <= LEADERS)
            pairs = rest.join(leaders.select("key", "m.b", "m.rb"), "key").filter("root <> rb").select(F.col("id").alias("a"), "b", F.col("root").alias("ra"), "rb")
        pairs = pairs.select(*[f("a", "b").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))], *[f("ra", "rb").alias(c) for f, c in ((F.least, "ra"), (F.greatest, "rb"))]).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        links = cut(_checked(pairs, sets), "near-links", PAIRS_AT_ONCE)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        joined = components(_stars(links)).withColumnRenamed("root", "least")
        before, label = label, cut(label.join(joined, F.col("root") == F.col("node"), "left").select("id", F.coalesce("least", "root").alias("root")), "near-roots")
        for spent in (links, joined, before, *([placed] if placed is not None else [])):
            drop_cut(spent)
        if not last:  # buckets that one component fills stay so
            of = cut(rest.select("key", "id").join(label, "id"), "near-of")
        drop_cut(rest)
        if last:
            break
    for spent in (sets, *([tested] if tested is not None else [])):
        drop_cut(spent)
    return label.filter("id <> root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the least id (nulls last) of each component of near copies, with all its columns."""
    blank = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) == "", F.lit(True))
    hashed = F.when(blank, F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    found = roots(docs.select(hashed.alias("id"), F.col("text").cast("binary").alias("__bytes")))
    rows = docs.select(F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"), hashed.alias("id"))
    named = rows.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    keys = ["k0", "k1", "k2"]
    kept = named.groupBy("root").agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    marked = docs.select(packed(docs), F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"))
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).select("__row.*")
