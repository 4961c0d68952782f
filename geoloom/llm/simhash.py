"""SimHash near-duplicates: a binary-trie self-join under a Hamming error budget, then connected components.

Fingerprint: A-Z lower-cased, words between white space, shingles of `n` words joined by a space (fewer words:
the whole sequence), each hashed by XXH64 with seed 42; a bit is 1 if it is set in over half of the hashes.

Join: two fingerprints that differ in at most `budget` bits agree wholly in one of `budget`+1 blocks of bits.
Each distinct fingerprint goes once to each block's bucket (block, its bits); within a bucket the fingerprints,
with the bucket's bits moved to the front, form a binary trie below the bucket's node. Pairs of nodes are traversed
together from (bucket, bucket): each level adds one differing bit for unlike children, and a pair whose sum
exceeds the budget is pruned. Pairs of small nodes are finished by comparing their few leaves. A bucket above
`hot_rows` is dealt again by blocks of its free bits, up to `LEVELS` times in all: fingerprints of texts that are not
alike are in buckets of N / 2**12 at the first level and of N / 2**22 at the second. What is then in one bucket still
is a cluster within few bits, 8 bytes a fingerprint.
Copies share one fingerprint and are never paired. A task returns each linked fingerprint with the least one it
reaches there (lossless for components), and components come from alternating star contractions whose rounds
are cut in the shared folder.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; rows with equal ids
are separate rows of one component; a component of null ids alone has a null component_id; an empty table gives
an empty result; extra columns are ignored (`fingerprints`) or kept (`keep_one`); a very long text is hashed whole, its bits
summed in pieces; equal fingerprints are one node however many rows have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut, drop_cut, hot_keys, packed, unskewed_join

BITS, SEED, SHINGLE, BUDGET = 64, 42, 4, 4
#: Leaf pairs that are compared without further descent; node pairs held at once.
LEAVES, FRONTIER = 64, 1 << 19
HOT_ROWS, LEVELS = 200_000, 4


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    words = text.lower().split() if text else []  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[: len(words) - n])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, (ends[n - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded however long the text is
        ones += np.add.reduce(np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",), text: str = "text", n: int = SHINGLE) -> DataFrame:
    """The id columns, __text (a hash of the text) and fp, the fingerprint as a signed long."""
    source = docs.select(*ids, F.xxhash64(text).alias("__text"), F.col(text).cast("binary").alias("__bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x.as_py(), n) for x in batch.column("__bytes")), np.uint64, batch.num_rows)
            kept = [c for c in batch.schema.names if c != "__bytes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got.view(np.int64))], [*kept, "fp"])

    schema = source.drop("__bytes").schema.add("fp", "long")
    return source.mapInArrow(run, schema)


def stretches(bits: list[int]) -> list[tuple[int, int]]:
    """Ascending bit numbers (0: the lowest) as stretches (first, how many)."""
    out: list[tuple[int, int]] = []
    for b in bits:
        if out and out[-1][0] + out[-1][1] == b:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((b, 1))
    return out


def deals(mask: int, budget: int) -> list[int]:
    """The bits that are fixed when those free in `mask` are cut into budget+1 blocks and one more block is fixed: two
    fingerprints of one bucket that differ in at most `budget` bits agree in one of these as well."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    parts = budget + 1
    at = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(at, at[1:])]


def moved(fp: np.ndarray, mask: int, back: bool = False) -> np.ndarray:
    """Fingerprints with the bits of `mask` moved to the front, or such ones moved back."""
    order = stretches([b for b in range(BITS) if not mask >> b & 1]) + stretches([b for b in range(BITS) if mask >> b & 1])
    out, to = np.zeros_like(fp), 0
    for first, n in order:  # from the lowest place up
        ones = np.uint64((1 << n) - 1)
        x, y = (to, first) if back else (first, to)
        out |= ((fp >> np.uint64(x)) & ones) << np.uint64(y)
        to += n
    return out


def trie_pairs(keys: np.ndarray, depth: int, budget: int, counted: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted `keys` that share their first `depth` bits and differ in at most `budget` of the first
    `counted`. If all bits count, the keys must be distinct."""
    if len(keys) < 2:
        return
    top = keys >> np.uint64(64 - depth) if depth else np.zeros(len(keys), np.uint64)
    start = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    end = np.append(start[1:], len(keys))
    many = end - start > 1
    start, end = start[many], end[many]
    stack = []
    for i in range(0, len(start), 4096):
        lo, hi = start[i : i + 4096], end[i : i + 4096]
        stack.append((depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8)))
    while stack:
        d, a0, a1, b0, b1, bits = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(d, *(x[:half] for x in (a0, a1, b0, b1, bits))), (d, *(x[half:] for x in (a0, a1, b0, b1, bits)))]
            continue
        few = ((a1 - a0) * (b1 - b0) <= LEAVES) | (d >= counted)
        if few.any():
            na, nb = (a1 - a0)[few], (b1 - b0)[few]
            n, first, last = na * nb, a0[few], b0[few]
            total = np.cumsum(n)
            for at in range(0, int(total[-1]), FRONTIER * 4):  # nodes below the counted bits may hold many
                k = np.arange(at, min(at + FRONTIER * 4, int(total[-1])))
                of = np.searchsorted(total, k, "right")
                k -= (total - n)[of]
                i, j = first[of] + k // nb[of], last[of] + k % nb[of]
                near = (i < j) & (np.bitwise_count((keys[i] ^ keys[j]) >> np.uint64(BITS - counted)) <= budget)
                if near.any():
                    yield i[near], j[near]
        more = ~few
        if not more.any():
            continue
        a0, a1, b0, b1, bits = (x[more] for x in (a0, a1, b0, b1, bits))

        def split(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            one = (keys[lo] & np.uint64(~((1 << (64 - d)) - 1) & (2**64 - 1))) | np.uint64(1 << (63 - d))
            return np.clip(np.searchsorted(keys, one), lo, hi)

        am, bm, same = split(a0, a1), split(b0, b1), a0 == b0
        out = []
        for lo, hi, lo2, hi2, plus in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            ok = (hi > lo) & (hi2 > lo2) & (bits + plus <= budget)
            if plus and lo is am:
                ok &= ~same  # of a node with itself the unlike children meet once
            ok &= ~((lo == lo2) & (hi - lo == 1))
            out.append((lo[ok], hi[ok], lo2[ok], hi2[ok], (bits[ok] + plus).astype(np.int8)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*out))))


def least_reached(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node it reaches over the pairs; the pairs are folded in as they come."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            unlike = a != b
            if not unlike.any():
                break
            i, j, a, b = i[unlike], j[unlike], a[unlike], b[unlike]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label


def near_links(fps: DataFrame, budget: int = BUDGET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b), a != b: links whose components are those of all pairs of distinct `fp` within `budget` bits."""
    distinct = cut(fps.select("fp").distinct(), "fingerprints")
    as_long = lambda m: m - (1 << 64) if m >> 63 else m
    open_, done, masks, spent = distinct.withColumn("mask", F.lit(0).cast("long")), None, [0], []
    for level in range(1, LEVELS + 1):
        # the masks of a level are known beforehand: (budget + 1) ** level at most, and only those with hot buckets
        further = {m: deals(m, budget) for m in masks}
        children = F.create_map(*[x for m, many in further.items() for x in (F.lit(as_long(m)), F.array(*[F.lit(as_long(c)) for c in many]))])
        rows = open_.select("fp", F.explode(children[F.col("mask")]).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        if level == LEVELS:
            done = rows if done is None else done.unionByName(rows)
            break
        hot = cut(rows.groupBy("mask", "bits").count().filter(F.col("count") > hot_rows).select("mask", "bits"), "simhash-hot")  # at most a 1/hot_rows of the rows
        masks = [r.mask % (1 << 64) for r in hot.select("mask").distinct().collect()]
        cold = rows.join(hot, ["mask", "bits"], "left_anti") if masks else rows
        done = cold if done is None else done.unionByName(cold)
        spent.append(hot)
        if not masks:
            break
        open_ = cut(rows.join(hot, ["mask", "bits"], "left_semi").select("fp", "mask"), "simhash-open")
        spent.append(open_)
    dealt = done.select("mask", "fp", F.xxhash64("mask", "bits").alias("__to")).repartition("__to").drop("__to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        mask, fp = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]).view(np.uint64) for i in range(2))
        order = np.argsort(mask, kind="stable")
        mask, fp = mask[order], fp[order]
        edges = np.flatnonzero(np.append(True, mask[1:] != mask[:-1])).tolist() + [len(mask)]
        for a, b in zip(edges, edges[1:]):
            m = int(mask[a])
            key = np.unique(moved(fp[a:b], m))  # buckets of one mask lie next to each other
            label = least_reached(len(key), trie_pairs(key, m.bit_count(), budget))
            linked = np.flatnonzero(label != np.arange(len(key)))
            if len(linked):
                back = moved(key, m, back=True).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(back[linked]), pa.array(back[label[linked]])], ["a", "b"])

    out = cut(dealt.mapInArrow(run, "a long, b long").distinct(), "simhash-links")
    for x in (distinct, *spent):
        drop_cut(x)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links with the least node of its component (alternating star contraction). A
    giant component's root has most edges as their key: its least neighbour is pre-aggregated and comes back by
    broadcast."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = hot_keys(both, "u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # a node is the greater end of its edges to lesser nodes: those of a root are all to greater ones
        large = unskewed_join(both.filter("v > u"), least, "u", hot=hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = unskewed_join(large, down, "u", hot=hot).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        before, edges = edges, cut(small.filter("u <> v").distinct(), "links")
        drop_cut(before)  # the new table stands by itself
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame, budget: int = BUDGET, n: int = SHINGLE, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __text, fp) of each row, and (fp, root) of each fingerprint: rows of one root are a component."""
    fps = cut(fingerprints(docs, n=n), "simhash")
    roots = components(near_links(fps, budget, hot_rows)).withColumnRenamed("node", "fp")
    distinct = fps.select("fp").distinct()
    return fps, cut(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def digest(docs: DataFrame) -> DataFrame:
    fps, roots = grouped(docs.select("doc_id", "text"))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = roots.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = unskewed_join(roots, ids, "root").select("fp", "component_id")
    out = unskewed_join(fps, of_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = BUDGET, n: int = SHINGLE) -> DataFrame:
    """The row with the least id (nulls last) of each component, with all its columns."""
    fps, roots = grouped(docs, budget, n)
    kept = unskewed_join(fps, roots, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("__text").alias("k2"))).alias("k")).select("k.*")
    keys = ["k0", "k1", "k2"]
    marked = docs.select(packed(docs), F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"))
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).select("__row.*")
