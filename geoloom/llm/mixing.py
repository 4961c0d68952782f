"""Mixing sources to target weights by subset-sum budget fitting.

1. Sources share `share` of all words by weight; a source's target stops at `most` times its words and the
   excess is shared again by weight among the rest (water filling, one row for each source).
2. The documents of each source are counted by exact length. Of a target, whole passes over the source come
   first (every document once); of the rest, each length gives the same fraction of its documents, longer
   lengths top up, and a bounded-knapsack program over the remaining counts meets the remaining budget exactly
   or as nearly as the lengths allow.
3. Of each (source, length) the documents with the lowest seeded hash are taken, by a salted rank.

Only the histogram (source, length, count) is gathered, one source to a task: at most as many rows as there are lengths
of texts. The shares are reckoned in one task over one narrow row for each source; documents are never gathered.

Defined cases: null text has size 0; sources go by code point with null last; sizes of zero are taken zero
words (times follow the pass they fall in); a document may be repeated up to ceil(most) times, never more than
`most` times its size for whole numbers; equal rows are told apart by their rank alone; an empty table gives an
empty result; extra columns are carried; a text of any length counts by its words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import CELL_ROWS, WORD, cut, packed, salt_bits, salted_rank, seeded

WEIGHTS = (5.0, 2.0, 1.0)
SEED = 77_003
#: Cells of the knapsack table; the rest of a budget is brought below it by taking long documents first.
#: Lengths over half of it are settled before, by rounding their share to what the shorter ones can fill up.
TABLE = 1 << 20


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, budget: float, most: float) -> np.ndarray:
    """Shares of `budget` by weight, none above `most` x size; the excess is reshared until none is above."""
    limit, out = sizes * most, np.zeros(len(sizes))
    open_ = np.ones(len(sizes), bool)
    while open_.any():
        left = budget - out[~open_].sum()
        share = left * weights / weights[open_].sum()
        over = open_ & (share >= limit)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over], open_ = limit[over], open_ & ~over
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (at most its count) sum to the reachable total nearest `budget` from below or above."""
    take = np.zeros(len(lengths), np.int64)
    top = int(budget + min(budget, lengths.max() if len(lengths) else 0))  # a total over twice the budget is no nearer than none
    from_ = np.full(top + 1, -1, np.int32)  # the item by which a total was first reached
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    items: list[tuple[int, int, int]] = []  # of a length's count, 1, 2, 4, ... and the rest
    for i in np.argsort(lengths, kind="stable"):
        if reach[budget]:
            break
        n, left = int(lengths[i]), int(counts[i])
        if not n:
            continue
        left, step = min(left, top // n), 1
        while left and not reach[budget]:
            step_now = min(step, left)
            w = n * step_now
            if w <= top:
                new = reach[: top + 1 - w] & ~reach[w:]
                at = np.flatnonzero(new) + w
                reach[at], from_[at] = True, len(items)
                items.append((int(i), step_now, w))
            left, step = left - step_now, step * 2
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, k, w = items[from_[at]]
        take[i] += k
        at -= w
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, table: int = TABLE) -> tuple[int, np.ndarray]:
    """Whole passes and, for each length, how many documents more, so that the words come nearest `target`."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if not total:
        return 0, np.zeros(len(lengths), np.int64)
    want = int(round(target))
    passes, rest = divmod(want, total)
    long, quota, below = lengths > table // 2, np.zeros(len(lengths), np.int64), total
    for i in sorted(np.flatnonzero(long), key=lambda i: -lengths[i]):
        n, of = int(lengths[i]), int(counts[i])
        share = (2 * of * rest + below) // (2 * below) if rest > 0 else 0
        below -= n * of  # what the shorter lengths hold
        most, least = max(0, min(of, rest // n)), max(0, -((below - rest) // n))
        if least > most:  # too few words or too many: the nearer
            share = least if least <= of and n * least - rest < rest - n * most - below else most
        quota[i] = min(max(share, least), most) if least <= most else share
        rest -= int(quota[i]) * n
    total, rest = below, min(max(rest, 0), below)
    if not total:
        return passes, quota
    part = np.where(long, 0, (counts * rest) // total)  # the same fraction of every length
    quota += part
    rest -= int((part * lengths).sum())
    spare = np.where(long, 0, counts - part)
    held = table - int(lengths[~long].max())  # budgets whose totals fit into the table
    for i in np.argsort(-lengths, kind="stable"):  # longer lengths first, down to what the table holds
        over = rest - held
        if over <= 0:
            break
        k = min(int(spare[i]), over // int(lengths[i]) if lengths[i] else 0)  # over < rest: the rest stays above 0
        quota[i], spare[i], rest = quota[i] + k, spare[i] - k, rest - k * int(lengths[i])
    quota[~long] += knapsack(lengths[~long], spare[~long], rest)
    return passes, quota


def mix(docs: DataFrame, size: str = "size", source: str = "source", ids: tuple[str, ...] = ("doc_id",), share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`docs` with source_size, target and times (how often the mix takes the document); columns of these names are
    replaced."""
    named = [F.col(f"`{c}`").alias(f"__id{k}") for k, c in enumerate(ids)]
    marked = docs.select(packed(docs, "source_size", "target", "times"), F.col(source).isNull().alias("__none"), F.coalesce(source, F.lit("")).alias("__source"), F.col(size).alias("__size"), seeded(seed, *ids).alias("__draw"), *named)
    keys = ["__none", "__source"]
    lengths = marked.groupBy(*keys, "__size").agg(F.count(F.lit(1)).alias("__count"))
    totals = lengths.groupBy(*keys).agg(F.sum(F.col("__size") * F.col("__count")).alias("source_size"), F.lit(0).alias("__all"))

    def share_out(pdf: pd.DataFrame) -> pd.DataFrame:
        by = pdf["__source"].map(lambda s: s.encode("utf-32-be"))  # by code point
        pdf = pdf.assign(__by=by).sort_values(["__none", "__by"]).reset_index(drop=True)
        got = targets(pdf["source_size"].to_numpy(float), np.resize(np.array(weights, float), len(pdf)), share * float(pdf["source_size"].sum()), most)
        return pdf[["__none", "__source", "source_size"]].assign(target=got)

    aims = totals.groupBy("__all").applyInPandas(share_out, "__none boolean, __source string, source_size long, target double")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__size").reset_index(drop=True)
        passes, quota = fit(pdf["__size"].to_numpy(), pdf["__count"].to_numpy(), float(pdf["target"][0]))
        return pdf[["__none", "__source", "__size", "source_size", "target"]].assign(__passes=passes, __quota=quota)

    plan = lengths.join(aims, keys).groupBy(*keys).applyInPandas(fill, "__none boolean, __source string, __size long, source_size long, target double, __passes long, __quota long")
    ranked = salted_rank(marked, [*keys, "__size"], "__draw", [f"__id{k}" for k in range(len(ids))], "__rank", "__of", salt_bits(docs.count(), cell_rows), plan)
    times = F.col("__passes") + (F.col("__rank") < F.col("__quota")).cast("int")
    return ranked.select("__row.*", "source_size", "target", times.alias("times"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    sized = docs.select(packed(docs), "doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("hash"))
    mixed = mix(sized, ids=("doc_id", "hash"), **options).filter("times > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("__row.*")


def digest(documents: DataFrame) -> DataFrame:
    narrow = cut(documents.select("doc_id", "source", n_words().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")), "mix")
    out = mix(narrow, ids=("doc_id", "crc"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))
