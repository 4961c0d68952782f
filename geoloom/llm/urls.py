"""URL filters: given host and path rules, then association rules mined by FP-growth.

A URL's tokens are its scheme, host labels, host without subdomain, path segments that are words, file ending and
query keys. Labelled URLs are item sets of their tokens and their label; FP-growth finds the frequent sets, and rules
{tokens} -> label are pruned by support and confidence, and where they say no more than the label's share does. A rule
that a part of its tokens foretells with as much confidence never decides and goes too. Rules stand in an inverted
index under their rarest token; a URL meets the rules under its tokens, and those whose tokens it has all match it. The
most confident matching rule gives the verdict (ties: block).

Tokens below the support are in no frequent set and go before the mining. A URL of `MAX_ITEMS` frequent tokens has up to
2**(MAX_ITEMS + 1) item sets; where one has more tokens, only sets that can be the tokens of a deciding rule are counted,
level by level (`free_rules`), over all tokens of all URLs. The rules are the same.

Defined cases: a null URL, or one without `://`, has an empty host and path, no rule, and the method's verdict on
no tokens (allow); labels that are null are ignored; a long URL is taken whole; without labels or rules the method allows; repeated rows are
judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut, drop_cut, unskewed_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_CONFIDENCE, MIN_SUPPORT, MIN_ROWS, MAX_ITEMS = 0.6, 0.002, 8, 12
BLOCK, ALLOW = "=block", "=allow"
BROADCAST_RULES = 10_000


def after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first, so it comes last here
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    labels = F.split(host, r"\.")
    query = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    parts = F.array_union(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.array_union(
            F.transform(F.filter(F.split(path, "/"), lambda x: x.rlike(r"^[^0-9.]+\z")), lambda x: F.concat(F.lit("path:"), x)),
            F.array_union(
                F.transform(F.regexp_extract_all(path, F.lit(r"\.([A-Za-z0-9]+)\z"), F.lit(1)), lambda x: F.concat(F.lit("end:"), x)),
                F.array_union(F.transform(query, lambda x: F.concat(F.lit("key:"), x)), F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)), F.concat(F.lit("site:"), F.regexp_extract(host, r"([^.]+\.[^.]+)\z", 1)))),
            ),
        ),
    )
    return F.when(host != "", F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))


def free_rules(narrow: DataFrame, sets: DataFrame, n: int, least: int, min_confidence: float) -> DataFrame:
    """(tokens, verdict, confidence): the rules of FP-growth on all frequent tokens `t`, without some that never decide.

    A set as frequent as one with a token less foretells the same, and beyond a set with one label only nothing is more
    confident; neither these sets nor larger ones give a rule that decides. So a level extends, by a later token, the
    sets that have both labels, one of them often enough, and are rarer than each of their parts."""
    bads = sets.agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0))).first()[0]
    rows = cut(narrow.groupBy("t").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b")), "url-rows")
    held = rows.select("t", "n", "b", F.explode("t").alias("x")).withColumn("x", F.array("x"))
    parts, every, size, spent = None, None, 1, []
    while True:
        held = cut(held, f"url-held-{size}")
        found = held.groupBy("x").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).filter(F.greatest(F.col("b"), F.col("n") - F.col("b")) >= least)
        if size == 1:
            found = found.filter(F.col("n") < n)
        else:
            less = found.select("x", F.explode("x").alias("y"), "n", "b").select("x", "n", "b", F.array_remove("x", F.col("y")).alias("part"))
            less = less.join(parts.select(F.col("x").alias("part"), F.col("n").alias("of_part")), "part").filter(F.col("n") < F.col("of_part"))
            found = less.groupBy("x", "n", "b").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == size).drop("k")
        found = cut(found, f"url-sets-{size}")
        every = found if every is None else every.unionByName(found)
        spent.append(held)
        parts = found.filter((F.col("b") > 0) & (F.col("b") < F.col("n")))
        if not parts.limit(1).count():
            break
        more = F.filter("t", lambda y: y > F.element_at("x", -1))
        held = held.join(parts.select("x"), "x", "left_semi").select("t", "n", "b", "x", F.explode(more).alias("y")).select("t", "n", "b", F.concat("x", F.array("y")).alias("x"))
        size += 1
    sides = F.array(F.struct(F.lit("block").alias("verdict"), F.col("b").alias("k"), F.lit(bads).alias("of")), F.struct(F.lit("allow").alias("verdict"), (F.col("n") - F.col("b")).alias("k"), F.lit(n - bads).alias("of")))
    said = every.select("x", "n", F.explode(sides).alias("s")).filter(F.col("s.k") >= least)
    said = said.select(F.col("x").alias("tokens"), F.col("s.verdict").alias("verdict"), (F.col("s.k") / F.col("n")).alias("confidence"), (F.col("s.k") / F.col("n") / (F.col("s.of") / n)).alias("lift"))
    out = cut(said.filter((F.col("confidence") >= min_confidence) & (F.col("lift") > 1 + 1e-9)).drop("lift"), "url-free")
    for x in (rows, *spent):
        drop_cut(x)
    return out


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, max_items: int = MAX_ITEMS) -> DataFrame:
    """(post, tokens, verdict, confidence) from rows of tokens and bad; `post` is the rule's rarest token."""
    spark = labelled.sparkSession
    sets = cut(labelled.filter(F.size("tokens") > 0).groupBy("tokens", "bad").agg(F.count(F.lit(1)).alias("n")), "url-sets")
    n = sets.agg(F.sum("n")).first()[0] or 0
    least = max(min_rows, math.ceil(min_support * n))
    if n < least:
        return spark.createDataFrame([], "post string, tokens array<string>, verdict string, confidence double")
    # at most a URL's mean number of tokens / min_support
    frequent = sets.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    frequent = cut(frequent, "url-tokens")
    known = sets.select("tokens", "bad", "n", F.explode("tokens").alias("token")).join(F.broadcast(frequent.withColumnRenamed("n", "df")), "token")
    narrow = cut(known.groupBy("tokens", "bad", "n").agg(F.sort_array(F.collect_list("token")).alias("t")), "url-frequent")
    if narrow.filter(F.size("t") > max_items).limit(1).count():
        rules = free_rules(narrow, sets, n, least, min_confidence)
    else:
        label = F.when(F.col("bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
        # URLs without a frequent token count in the shares of the labels
        items = narrow.select(F.concat(F.col("t"), F.array(label)).alias("items"), "n")
        rest = sets.groupBy("bad").agg(F.sum("n").alias("n")).join(narrow.groupBy("bad").agg(F.sum("n").alias("k")), "bad", "left")
        items = items.unionByName(rest.select(F.array(label).alias("items"), (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")))
        each = items.filter("n > 0").select("items", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("items")
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(each)
        rules = model.associationRules.filter(F.col("consequent")[0].isin(BLOCK, ALLOW) & (F.col("lift") > 1 + 1e-9))
        rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence")
    rules = cut(rules, "url-rules")
    # a rule with as much confidence and one token less matches wherever this one does
    parts = rules.filter(F.size("tokens") > 1).select(F.explode("tokens").alias("x"), F.col("tokens").alias("whole"), "verdict", F.col("confidence").alias("own")).select(F.array_remove("whole", F.col("x")).alias("tokens"), "whole", "verdict", "own")
    idle = parts.join(rules, ["tokens", "verdict"]).filter("confidence >= own").select(F.col("whole").alias("tokens"), "verdict").distinct()
    kept = rules.join(idle, ["tokens", "verdict"], "left_anti")
    posted = kept.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(frequent), "token").groupBy("tokens").agg(F.min(F.struct("n", "token")).alias("m")).select("tokens", F.col("m.token").alias("post"))
    out = cut(kept.join(posted, "tokens").select("post", "tokens", "verdict", "confidence"), "url-index")
    for spent in (sets, frequent, narrow, rules):
        drop_cut(spent)
    return out


def match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, said): the verdict of the best matching rule; `rows` has a unique id and tokens."""
    index = rules.withColumnRenamed("tokens", "need")
    if rules.count() <= BROADCAST_RULES:  # beyond that the index is dealt by token, and hot tokens are split at run time
        index = F.broadcast(index)
    hits = rows.select("id", "tokens", F.explode("tokens").alias("post")).join(index, "post").filter(F.size(F.array_except("need", "tokens")) == 0)
    best = F.max(F.struct("confidence", "verdict")).alias("best")  # "block" comes after "allow"
    return hits.groupBy("id").agg(best).select("id", F.col("best.verdict").alias("said"))


def judge(pages: DataFrame, labelled_urls: DataFrame, rules=RULES, **limits: float) -> DataFrame:
    """page_id, host, path, rule, verdict and by (rule or mined). `labelled_urls` has url and bad."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    name, verdict = ruled(host, path, rules)
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).select("page_id", "host", "path", name.alias("rule"), verdict.alias("given"), tokens(url, host, path).alias("tokens"))
    judged = judged.withColumn("id", F.when(F.col("rule").isNull() & (F.size("tokens") > 0), F.array_join("tokens", "\n")))
    seen = labelled_urls.filter("bad is not null").select("url", "bad", host_of(url).alias("host"), path_of(url).alias("path")).select("bad", tokens(url, host, path).alias("tokens"))
    # URLs of the same tokens are judged once
    open_ = judged.filter("id is not null").groupBy("id").agg(F.first("tokens").alias("tokens"))
    out = unskewed_join(judged.drop("tokens"), match(open_, mine(seen, **limits)), "id", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "said", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").when(F.col("said").isNotNull(), "mined").otherwise("default").alias("by"))


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Also `by`: whether a given rule, a mined one or the default decided. Pages are labelled by the document labels of the same number: quality 0 is bad."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    seen = pages.select("page_id", "url").join(marks, F.col("page_id") == F.col("doc_id")).filter("url is not null").select("url", "bad")
    return judge(pages.select("page_id", "url"), seen)
