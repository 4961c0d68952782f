"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a `LENGTH`-byte string that also starts earlier (a smaller document, or the same one at an
earlier start) is removed.

1. Candidates. A rolling hash of 32-byte strings gives each LENGTH-byte window its least hash; equal windows have
   equal least hashes, so windows are compared only under the same hash. Neighbouring windows of one least hash
   form a run. A run's bytes (its context) are hashed as a whole: of equal contexts all but the earliest are
   repeats. They are combined in each task before the shuffle, so copies, however many, send one row a task.
2. Contexts that differ but share a least hash may share some windows. Their bytes are dealt by the hash, put into
   shards, and each shard's Burrows-Wheeler transform is made once. The transforms are merged by refining their
   interleave: in each round the interleave is dealt stably by the two bytes before each suffix, and blocks of
   suffixes that agree so far split; after LENGTH/2 rounds a block is the interval of suffixes with a common prefix
   of LENGTH bytes. No suffix of the merged text is sorted again. Of each interval with several windows all but
   the earliest are repeats.
3. A hash that more than HOT_GROUP different contexts share (a line in a large share of all documents) is not
   gathered in one task: its contexts are candidates again under the least hash of their longer strings (`GRAMS`), and
   so on. Contexts inside the line become equal, the others part. Under strings of LENGTH bytes a hash has one window.

Documents meet their repeats by their id; texts are shuffled once, and only intervals travel otherwise. Long texts are
taken in pieces that overlap by LENGTH - 1 bytes.

Defined cases: null is the empty text; texts below LENGTH bytes lose nothing; null ids come after all others; rows
with equal ids and different texts are ordered by a hash of the text; rows equal in both are one document (each
gets its result); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut

LENGTH = 100
#: Bytes of the strings whose least hash deals the windows, first and where that is hot.
GRAMS = (32, 64, LENGTH)
#: Windows of a run are split after so many, so that a context is bounded.
RUN = 256
#: Bytes that are hashed at once, runs that a task combines at once, bytes of contexts merged at once and in a shard.
PIECE, COMBINE, MERGE_BYTES, SHARD_BYTES = 1 << 20, 1 << 20, 1 << 17, 1 << 14
HOT_GROUP = 50_000
REPEAT, COMPARE, DEAL, FIRST = 1, 2, 3, 0
_MUL = 0x9E3779B97F4A7C15
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) >> np.uint64(17))


def string_hashes(s: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all strings of n bytes, from those of lengths that are powers of two."""
    part, size, power = _BYTE[s], 1, _MUL
    out, have = None, 0
    while True:
        if n & size:
            out = part if out is None else out[: len(out) - size] * np.uint64(power) + part[have:]
            have += size
        if have == n:
            return out
        part = part[:-size] * np.uint64(power) + part[size:]
        power, size = power * power % 2**64, size * 2


def least_hashes(s: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a LENGTH-byte window the least hash of its strings of `gram` bytes; and those strings' hashes."""
    h = string_hashes(s, gram)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    m, span, n = h, LENGTH - gram + 1, 1
    while n * 2 <= span:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(m) - (span - n)], m[span - n :]), h


def runs_of(s: np.ndarray, begin: np.ndarray, end: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Runs of windows in the texts [begin, end) of `s`: text, first window, windows, least hash, and whether the
    least hash stands at several places (then the run may repeat itself)."""
    none = np.zeros(0, np.int64)
    if len(s) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    m, h = least_hashes(s, gram)
    at = np.zeros(len(s) + 1, np.int32)
    long_ = end - begin >= LENGTH
    np.add.at(at, begin[long_], 1)
    np.add.at(at, end[long_] - LENGTH + 1, -1)
    valid = np.cumsum(at)[: len(m)] > 0
    first = np.zeros(len(m), bool)
    first[begin[long_]] = True
    first[1:] |= m[1:] != m[:-1]
    first &= valid
    a = np.flatnonzero(first)
    text = np.searchsorted(begin, a, "right") - 1
    stop = np.minimum(np.append(a[1:], len(m)), end[text] - LENGTH + 1)
    # equal least hashes that follow each other among the chosen strings
    least = m
    most = np.zeros(len(h), np.uint64)
    n, span = 1, LENGTH - gram + 1
    pad = np.concatenate((np.zeros(span - 1, np.uint64), np.where(valid, least, 0), np.zeros(span - 1, np.uint64)))
    while n * 2 <= span:
        pad = np.maximum(pad[:-n], pad[n:])
        n *= 2
    most = np.maximum(pad[: len(pad) - (span - n)], pad[span - n :])[: len(h)]
    picked = np.flatnonzero(most == h)
    again = np.flatnonzero(h[picked[1:]] == h[picked[:-1]])
    p, q = picked[:-1][again], picked[1:][again]
    i = np.searchsorted(p, a)
    several = np.zeros(len(a), bool)
    if len(p):
        ok = i < len(p)
        several[ok] = q[i[ok]] <= stop[ok] - 1 + span - 1
    n_win = stop - a
    several |= n_win > span
    parts = -(-n_win // RUN)
    if (parts > 1).any():
        of = np.repeat(np.arange(len(a)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        a, n_win, text, several = a[of] + k * RUN, np.minimum(RUN, n_win[of] - k * RUN), text[of], several[of]
    return text, a - begin[text], n_win, m[a], several


def _bundle(h, c, uid, start, n, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(h).view(np.int64)), pa.array(np.asarray(c).view(np.int64)), pa.array(uid), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(kind.astype(np.int8))], ["h", "c", "uid", "start", "n", "kind"])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Group number of each row of arrays that are sorted by `keys`."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _earliest(h: np.ndarray, c: np.ndarray, uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, c, uid, start), and whether a row (in that order) is the earliest of its (h, c)."""
    order = np.lexsort((start, uid, c, h))
    g = _groups(h[order], c[order])
    lead = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else g
    return order, (uid[order] == uid[order][lead][g]) & (start[order] == start[order][lead][g])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(uid, start, bytes) of texts, the long ones in pieces that overlap by less than a window."""
    for batch in batches:
        for uid, start, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            t = t.as_py()
            for a in range(0, len(t) - LENGTH + 1, PIECE):
                yield uid, start + a, t if len(t) <= PIECE else t[a : a + PIECE + LENGTH - 1]


def map_runs(gram: int):
    """(uid, start, bytes) rows to runs: FIRST ones of this task, and REPEATs of those, merged where they adjoin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = size = 0
        rows: list[tuple[int, int, bytes]] = []

        def piece() -> int:
            joined = b"".join(r[2] for r in rows)
            n = np.fromiter((len(r[2]) for r in rows), np.int64, len(rows))
            end = np.cumsum(n)
            text, start, n_win, h, several = runs_of(np.frombuffer(joined, np.uint8), end - n, end, gram)
            view, low = memoryview(joined), (end - n)[text] + start
            digest = xxhash.xxh3_64_intdigest
            c = np.fromiter((digest(view[a:b]) for a, b in zip(low.tolist(), (low + n_win + LENGTH - 1).tolist())), np.uint64, len(low))
            uid, before = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in range(2))
            held.append((h, c, uid[text], before[text] + start, n_win, several))
            rows.clear()
            return len(h)

        def flush() -> Iterator[pa.RecordBatch]:
            h, c, uid, start, n, several = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, first = _earliest(h, c, uid, start)
            h, c, uid, start, n, several = (x[order] for x in (h, c, uid, start, n, several))
            yield _bundle(h[first], c[first], uid[first], start[first], n[first], np.where(several[first], FIRST - 1, FIRST))
            uid, start, n = merged(uid[~first], start[~first], n[~first])
            yield _bundle(np.random.default_rng(len(uid)).integers(-(2**63), 2**63 - 1, len(uid)), np.zeros(len(uid), np.int64), uid, start, n, np.full(len(uid), REPEAT))

        for row in pieces(batches):
            rows.append(row)
            size += len(row[2])
            if size >= PIECE:
                count, size = count + piece(), 0
                if count >= COMBINE:
                    yield from flush()
                    count = 0
        if rows:
            piece()
        if held:
            yield from flush()

    return run


def merged(uid: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with adjoining or overlapping ones of a document joined."""
    if not len(uid):
        return uid, start, n
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order].astype(np.int64), (start + n)[order].astype(np.int64)
    new_doc = np.append(True, uid[1:] != uid[:-1])
    g = np.cumsum(new_doc) - 1
    shift = g * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, (start + shift)[1:] > reach[:-1])
    lead = np.flatnonzero(new)
    return uid[lead], start[lead], np.maximum.reduceat(end, lead) - start[lead]


def reduce_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs dealt by h to REPEATs of an earlier equal context and to COMPARE or DEAL ones, whose h others share."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    h, c, uid, start, n, kind = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(6))
    del got
    done = kind == REPEAT
    if done.any():
        yield _bundle(h[done], c[done], uid[done], start[done], n[done], kind[done])
    h, c, uid, start, n, kind = (x[~done] for x in (h, c, uid, start, n, kind))
    if not len(h):
        return
    order, first = _earliest(h, c, uid, start)
    h, c, uid, start, n, kind = (x[order] for x in (h, c, uid, start, n, kind))
    if (~first).any():
        u, s, k = merged(uid[~first], start[~first], n[~first])
        yield _bundle(np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), u, s, k, np.full(len(u), REPEAT))
    # equal rows of one document stand once
    once = first & np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (uid[1:] != uid[:-1]) | (start[1:] != start[:-1]))
    h, c, uid, start, n, kind = (x[once] for x in (h, c, uid, start, n, kind))
    g = _groups(h)
    size = np.bincount(g)[g]
    own = np.maximum.reduceat(kind == FIRST - 1, np.flatnonzero(np.append(True, g[1:] != g[:-1])))[g]
    compare = (size > 1) | own
    yield _bundle(h[compare], c[compare], uid[compare], start[compare], n[compare], np.where(size[compare] > HOT_GROUP, DEAL, COMPARE))


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a circular text the order of its suffixes by their first 128 bytes (prefix doubling), and its
    transform: the two bytes before each suffix in that order."""
    n = len(text)
    rank = text.astype(np.int64)
    h = 1
    while True:
        order = np.argsort(rank * (int(rank.max()) + 1) + np.roll(rank, -h), kind="stable")
        a, b = rank[order], np.roll(rank, -h)[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        rank, h = new, h * 2
        if h >= 128 or rank.max() == n - 1:
            break
    t = text.astype(np.uint16)
    return order, ((np.roll(t, 2) << 8) | np.roll(t, 1))[order]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave (shard of each place of the merged order) and block of each place: places of one block share
    their first `depth` symbols, two of which are refined in each round."""
    pairs = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8 if len(transforms) < 256 else np.uint16), [len(t) for t in transforms])
    block = np.zeros(len(pairs), np.int32)
    for _ in range(depth // 2):
        place = np.argsort(shard, kind="stable")  # of each shard's suffixes, in its own order
        symbol = np.empty_like(pairs)
        symbol[place] = pairs
        to = np.argsort(symbol, kind="stable")
        symbol, before = symbol[to], block[to]
        split = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        shard = shard[to]
        block = np.concatenate((np.zeros(1, np.int32), np.cumsum(split, dtype=np.int32)))
    return shard, block


def repeats(contexts: list[bytes], uid: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uid, start) of the windows of these contexts that also start earlier in one of them."""
    shards, at = [], 0
    while at < len(contexts):
        size, to = 0, at
        while to < len(contexts) and (to == at or size + len(contexts[to]) <= SHARD_BYTES):
            size, to = size + len(contexts[to]), to + 1
        shards.append((at, to))
        at = to
    made = [transform(np.frombuffer(b"".join(contexts[a:b]), np.uint8)) for a, b in shards]
    shard, block = merge([m[1] for m in made], LENGTH)
    base = np.cumsum([0, *(len(m[0]) for m in made)])[:-1]
    suffix = np.concatenate([m[0] + x for m, x in zip(made, base)])  # places of the joined text, shard by shard
    where = np.empty(len(suffix), np.int64)
    where[np.argsort(shard, kind="stable")] = suffix  # in the merged order
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    low = np.cumsum(size) - size
    of = np.searchsorted(low, where, "right") - 1
    off = where - low[of]
    window = off < n[of]
    counts = np.bincount(block[window], minlength=int(block[-1]) + 1)
    window &= counts[block] > 1
    of, off, block = of[window], off[window], block[window]
    u, s = uid[of], start[of] + off
    order = np.lexsort((s, u, block))
    u, s, g = u[order], s[order], _groups(block[order])
    lead = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else g
    late = (u != u[lead][g]) | (s != s[lead][g])  # a repeated row's windows are its own
    return u[late], s[late]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, uid, start, n, context) rows dealt by h, in the order of h, to stretches (uid, start, n) of repeats."""
    rows: list[tuple] = []
    size = 0

    def flush(part: list[tuple]) -> pa.RecordBatch:
        uid, start, n = (np.array([r[i] for r in part], np.int64) for i in (1, 2, 3))
        u, s = repeats([r[4] for r in part], uid, start, n)
        u, s, k = merged(u, s, np.ones(len(u), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(s.astype(np.int32)), pa.array(k.astype(np.int32))], ["uid", "start", "n"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if size >= MERGE_BYTES and row[0] != rows[-1][0]:  # a hash's contexts stay together
                yield flush(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield flush(rows)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, bytes, wanted: uid, h, start, n) rows to the wanted contexts."""
    for batch in batches:
        out: list[tuple] = []
        for text, wanted in zip(batch.column(1), batch.column(2)):
            text = text.as_py()
            out += [(w["h"], w["uid"], w["start"], w["n"], text[w["start"] : w["start"] + w["n"] + LENGTH - 1]) for w in wanted.as_py()]
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], ["h", "uid", "start", "n", "context"])


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with uid, whose order is that of (doc_id nulls last, hash of the text)."""
    ids = docs.select("doc_id")
    total = ids.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if total[0] == total[1]:
        return docs.withColumn("uid", F.col("doc_id").cast("long"))
    keys = [F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2")]
    seen = cut(docs.select(*keys).distinct().orderBy("k0", "k1", "k2").withColumn("part", F.spark_partition_id()), "suffix-ids")
    from pyspark.sql import Window

    sizes = seen.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    uids = seen.withColumn("in", F.row_number().over(Window.partitionBy("part").orderBy("k0", "k1", "k2"))).join(before, "part").select("k0", "k1", "k2", (F.col("before") + F.col("in")).cast("long").alias("uid"))
    return docs.select("*", *keys).join(uids, ["k0", "k1", "k2"]).drop("k0", "k1", "k2")


RUNS = "h long, c long, uid long, start int, n int, kind tinyint"


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed and spans of removed bytes."""
    # no uid is null; said here, as a filter on one side of a join would make its exchange another one
    docs = numbered(documents.select("doc_id", "text")).select(F.coalesce("uid", F.lit(0).cast("long")).alias("uid"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))

    def contexts(found: DataFrame) -> DataFrame:
        wanted = found.groupBy("uid").agg(F.collect_list(F.struct("uid", "h", "start", "n")).alias("wanted"))
        # doc_id is not needed, but with it the texts' exchange is that of the last join, which reuses it
        return docs.join(wanted, "uid").select("doc_id", "bytes", "wanted").mapInArrow(slices, "h long, uid long, start int, n int, context binary")

    levels = []
    source = docs.select("uid", F.lit(0).alias("start"), "bytes")
    for gram in GRAMS:
        found = source.mapInArrow(map_runs(gram), RUNS).repartition("h").mapInArrow(reduce_runs, RUNS).select("h", "uid", "start", "n", "kind")
        if gram == LENGTH:  # contexts of one window, or runs of one byte: at most RUN different ones
            found = found.withColumn("kind", F.when(F.col("kind") == DEAL, F.lit(COMPARE)).otherwise(F.col("kind")).cast("tinyint"))
        levels.append(cut(found, "suffix-runs"))
        again = levels[-1].filter(F.col("kind") == DEAL)
        if again.limit(1).count() == 0:
            break
        source = contexts(again).select("uid", "start", "context")
    found = reduce(DataFrame.unionByName, levels)
    cold = contexts(found.filter(F.col("kind") == COMPARE)).repartition("h").sortWithinPartitions("h").mapInArrow(compare, "uid long, start int, n int")
    stretches = found.filter(F.col("kind") == REPEAT).select("uid", "start", "n").unionByName(cold)
    gone = stretches.groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_bytes, removed, n_spans, digests = batch.column(0), [], [], [], []
            for r in range(batch.num_rows):
                text, gone = batch.column(1)[r].as_py(), batch.column(2)[r]
                digest, at, cut_, spans = hashlib.sha256(), 0, 0, 0
                view = memoryview(text)
                if gone.is_valid:
                    flat = gone.values.flatten()
                    start, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat)
                    _, s, k = merged(np.zeros(len(start), np.int64), start, n + LENGTH - 1)
                    for a, b in zip(s.tolist(), (s + k).tolist()):
                        digest.update(view[at:a])
                        at, cut_, spans = b, cut_ + b - a, spans + 1
                digest.update(view[at:])
                n_bytes.append(len(text))
                removed.append(cut_)
                n_spans.append(spans)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.join(gone, "uid", "left").select("doc_id", "bytes", "gone")
    return rows.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def digest(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents)
