import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from trellis.llm import url_filter as U
from trellis.llm.queries import QUERIES


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"(?s)[^?#]*", rest[len(host) :]).group() if rest[len(host) :].startswith("/") else ""
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


URLS = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/7x?q#f", "http://a.example.com/en/8", "http://example.net/de/8", "http://sub.example.net/de/9", "http://notexample.com/EN/", "https://x.org/es/", "https://x.org?/es/", "https://x.org#/es/", "ftp://a.com/en/://b", "http://com/en/", "http://ÄB.net/de/\n?x", "http://x/" + "y" * 50_000, "http://example.com", "http://example.com/en"]


def test_rules_hosts_and_paths(spark):
    rows = [(i, u, "r") for i, u in enumerate(URLS)] + [(0, None, "r"), (None, URLS[4], "r")]
    got = U.judged(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            continue
        host, path = parts(URLS[r.page_id])
        rule = rule_of(host, path, U.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == (rule.verdict if rule else "allow" if not host + path else r.verdict) and r.verdict in ("allow", "block")
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_query_on_a_whole_table(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = QUERIES["op10_markov_url_filter"](spark, sf).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = parts(urls[r.page_id])
        rule = rule_of(host, path, U.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name) and (not rule or r.verdict == rule.verdict)


def naive_log_p(examples, text, order=U.ORDER):
    """Character by character, with contexts as tuples and no table: what the hashed rows stand for where none collide."""
    cls = lambda t: [int(U._CLASS[b]) for b in t.encode()] + [U._END]
    seen = defaultdict(Counter)
    for t in examples:
        padded = [U._EDGE] * order + cls(t)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[tuple(padded[i - k : i])][padded[i]] += 1
    padded, total = [U._EDGE] * order + cls(text), 0.0
    for i in range(order, len(padded)):
        p = 1 / U.CLASSES
        for k in range(order + 1):
            c = seen.get(tuple(padded[i - k : i]))
            if c:
                p = (c[padded[i]] + len(c) * p) / (sum(c.values()) + len(c))
        total += math.log(p)
    return total


def test_differences_are_those_of_the_models_in_plain_python(spark):
    good, bad = ["example.org/a", "news.example.org/en/12", "Example.net/A"], ["casino.bet/win", "casino.bet/1"]
    ratio = U.fit(spark.createDataFrame([(t, False) for t in good] + [(t, True) for t in bad], "text string, bad boolean").coalesce(1))
    if ratio.usable and U.FOLDS:  # few examples: both sides may have none held out, then all are counted
        held = {r.text for r in spark.createDataFrame([(t,) for t in good + bad], "text string").where(f"pmod(xxhash64(text), {U.FOLDS}) = 0").collect()}
        split = all(bool(held & {*x}) and bool({*x} - held) for x in (good, bad))
        parts = [[t for t in x if not (split and t in held)] for x in (good, bad)]
        for t in [*good, *bad, "other.example.org/x", "", "\u00e9.net/%20"]:
            want = (naive_log_p(parts[0], t) - naive_log_p(parts[1], t)) / (len(t.encode()) + 1) if t else 0.0
            assert abs(ratio.differences([t])[0] - want) < 1e-4


def test_model_is_a_distribution(spark):
    ratio = U.fit(spark.createDataFrame([(f"host{i}.example.org/{i}", i % 3 == 0) for i in range(300)], "text string, bad boolean"))
    for text in ("", "hos", "zzz", "host1.exam"):
        rows, _, bounds = U.places([text])
        at = np.repeat(rows[bounds[1] - 1 : bounds[1]], U.CLASSES, axis=0)
        assert abs(np.exp(ratio.accepted.log_p(at, np.arange(U.CLASSES))).sum() - 1) < 1e-5


def test_ratio_sorts_urls_like_its_examples(spark):
    good = [f"news-{i}.example.org/articles/{i * 7}/history-of-rivers" for i in range(200)]
    bad = [f"best-casino{i}.bet/win/free-poker-{i * 3}" for i in range(200)]
    ratio = U.fit(spark.createDataFrame([(t, False) for t in good] + [(t, True) for t in bad], "text string, bad boolean"))
    held = [(0, "http://news-777.example.org/articles/9/history-of-lakes"), (1, "http://best-casino999.bet/win/free-poker-1"), (2, "http://top-poker5.bet/win/free-casino")]
    got = U.judged(spark.createDataFrame(held, "page_id long, url string"), rules=(), ratio=ratio).collect()
    assert [r.verdict for r in sorted(got)] == ["allow", "block", "block"]
    assert (ratio.differences(good) >= ratio.threshold).sum() >= 198 and (ratio.differences(bad) < ratio.threshold).sum() >= 198


def test_error_on_hosts_of_the_whole_table(spark, sf):
    """Hosts with a seed are rejected, nearly all others kept; a host is found by words like it, with its own seed left out."""
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/pages.parquet")
    got = U.judged(pages, rules=()).collect()
    seeded = [any(w in r.host for w in U.SEEDS) for r in got]
    lost = sum(r.verdict == "block" for r, s in zip(got, seeded, strict=True) if not s) / max(1, seeded.count(False))
    caught = sum(r.verdict == "block" for r, s in zip(got, seeded, strict=True) if s) / max(1, seeded.count(True))
    assert caught >= 0.99 and lost <= 0.02


def test_labels_of_ones_own(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'evil'}{i}.org/{i}", None if i > 190 else i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = U.judged(df, rules=(), rejected=F.col("bad")).collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 0) for r in got) >= 198
    none = U.judged(df.withColumn("bad", F.lit(None).cast("boolean")), rules=(), rejected=F.col("bad")).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.difference for r in none} == {0.0}
