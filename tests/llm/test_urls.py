import itertools
import math
import random
import re
from collections import Counter
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from geoloom.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
PAGES = [
    (1, "http://WWW.Example.com/en/1?x=1"), (2, "https://a.example.com/en/2"), (3, "https://notexample.com/en/"), (4, "http://a.net/es/1#t"), (5, "http://a.net/es"), (6, "http://net/fr/"),
    (7, None), (8, ""), (9, "no scheme/en/"), (10, "http://x.com"), (11, "x://é.COM/?q://y"), (12, "http://?q"), (13, "http://a.net#/es/"), (14, "http://anet/es/"), (15, "http://a.b.org/p.html"), (None, "http://com/a"), (1, "http://WWW.Example.com/en/1?x=1"),
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    parts = urlsplit("//" + rest.replace("\\", "%5C"))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: len(parts.netloc)])
    path = parts.path
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    name, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, name, verdict


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, host string, token string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.digest(pages, labels).collect()), key=str)
    assert got == sorted(((i, *plain(u)) for i, u in PAGES), key=str)


def test_mined_rules_match_like_brute_force(spark):
    seen = [(f"http://{'spam' if i % 3 == 0 else 'fine'}-{i % 7}.{'win' if i % 3 == 0 else 'org'}/x/{i}.html", i % 3 == 0) for i in range(90)]
    labelled = spark.createDataFrame(seen + [(None, True), ("http://a.win/", None)], "url string, bad boolean")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://new.win/x/9.html", "http://other.org/x/", "http://new.win/", "http://new.win/x/9.html"])], "page_id long, url string")
    out = {r.page_id: (r.verdict, r.by) for r in urls.judge(pages, labelled).collect()}
    host, path, url = F.col("host"), F.col("path"), F.col("url")
    items = lambda df: df.select("*", urls.host_of(url).alias("host"), urls.path_of(url).alias("path")).select("*", urls.tokens(url, host, path).alias("tokens"))
    rules = urls.mine(items(labelled.filter("url is not null and bad is not null"))).collect()
    for r in items(pages).collect():
        hit = [(x.confidence, len(x.tokens), x.verdict) for x in rules if set(x.tokens) <= set(r.tokens)]
        assert out[r.page_id] == ((max(hit)[2], "mined") if hit else ("allow", "default"))
    assert out[0] == ("block", "mined") and out[3] == out[0]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    pages = spark.createDataFrame([(1, "http://a.org/")][:n], "page_id long, url string")
    assert urls.judge(pages, spark.createDataFrame([], "url string, bad boolean")).count() == n


def plain_tokens(url):
    """From the docstring, without the library."""
    if not url or "://" not in url:
        return frozenset()
    scheme, rest = url.split("://", 1)
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    if not host:
        return frozenset()
    out = {f"host:{x}" for x in host.split(".")} | {f"path:{x}" for x in path.split("/") if x and not re.search(r"[0-9.]", x)} | {f"scheme:{scheme}"}
    site = re.search(r"[^.]+\.[^.]+\Z", host)
    out.add("site:" + (site.group() if site else ""))
    end = re.search(r"\.([A-Za-z0-9]+)\Z", path)
    return frozenset(out | ({f"end:{end.group(1)}"} if end else set()) | {f"key:{x}" for x in re.findall(r"[?&]([^=&#]+)", url)})


def plain_rules(seen, confidence=0.6, support=0.002, rows=8, most=12):
    """All subsets of every URL's frequent tokens, counted by label."""
    seen = [(plain_tokens(u), bad) for u, bad in seen if u and bad is not None]
    seen = [(t, bad) for t, bad in seen if t]
    n, least = len(seen), max(rows, math.ceil(support * len(seen)))
    df = Counter(x for t, _ in seen for x in t)
    counts = {}
    for t, bad in seen:
        known = sorted((x for x in t if df[x] >= least), key=lambda x: (-df[x], x))[:most]
        for k in range(1, len(known) + 1):
            for part in itertools.combinations(sorted(known), k):
                counts.setdefault(part, [0, 0])[bad] += 1
    share = [sum(not b for _, b in seen) / n, sum(b for _, b in seen) / n]
    return [(c[v] / sum(c), ("allow", "block")[v], frozenset(part)) for part, c in counts.items() for v in (0, 1) if c[v] >= least and c[v] / sum(c) >= confidence and c[v] / sum(c) / share[v] > 1 + 1e-9]


def test_verdicts_equal_enumeration_of_all_token_sets(spark):
    r = random.Random(11)
    hosts = ["shop.spam.win", "spam.win", "news.fine.org", "fine.org", "m.mixed.biz", "WWW.Fine.ORG", "a.b.c.dev"]
    make = lambda: f"{r.choice(['http', 'https'])}://{r.choice(hosts)}/{r.choice(['en', 'buy', 'x1', ''])}/{r.randrange(99)}{r.choice(['.html', '', '/', '.php?ref=1&page=2', '?utm=a#top'])}"
    bad = lambda u: ("spam" in u and r.random() < 0.9) or ("buy" in u and r.random() < 0.7) or r.random() < 0.1
    seen = [(u, bool(bad(u))) for u in (make() for _ in range(400))] + [(None, True), ("http://fine.org/", None), ("nothing", True)]
    asked = [make() for _ in range(150)] + [None, "", "x://?", "http://new.example.biz/"]
    rules = plain_rules(seen)
    assert any(v == "block" for _, v, _ in rules) and any(v == "allow" for _, v, _ in rules)
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    out = {x.page_id: x for x in urls.judge(pages, spark.createDataFrame(seen, "url string, bad boolean"), rules=()).collect()}
    for i, u in enumerate(asked):
        hit = max(((c, v) for c, v, need in rules if need <= plain_tokens(u)), default=None)
        assert (out[i].verdict, out[i].by) == ((hit[1], "mined") if hit else ("allow", "default")), u


def test_urls_with_many_keys_stay_bounded(spark):
    keys = "&".join(f"k{i:02d}=1" for i in range(40))
    seen = [(f"http://a.org/{i}?{keys}", i % 4 == 0) for i in range(60)] + [(f"http://b.win/{i}", True) for i in range(20)]
    pages = spark.createDataFrame([(1, f"http://a.org/9?{keys}"), (2, "http://b.win/1"), (3, "http://a.org/" + "x" * 200_000)], "page_id long, url string")
    out = {x.page_id: x.verdict for x in urls.judge(pages, spark.createDataFrame(seen, "url string, bad boolean")).collect()}
    assert out == {1: "allow", 2: "block", 3: "allow"}


def test_rules_beyond_the_most_frequent_tokens_are_mined(spark):
    r = random.Random(8)
    rows = []
    for i in range(240):
        bad = r.random() < 0.4
        rest = [f"k{j:02d}" for j in range(7) if r.random() < 0.5]
        odd = ["z1"] if r.random() < (0.5 if bad else 0.1) else []
        rows.append((sorted(["all1", "all2", *rest, *odd, *(["z2"] if bad and i % 2 else [])]), bad))
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    mined = lambda most: {(tuple(x.tokens), x.verdict): pytest.approx(x.confidence) for x in urls.mine(labelled, max_items=most).collect()}
    whole, levels = mined(20), mined(3)
    assert levels == whole and any("z2" in t for t, _ in levels)
