"""URL filter: parts and rules by hand, trees against a plain search, held-out accuracy, awkward rows."""

import math
import re

import numpy as np
import pytest

from quiver.llm import url_filter as U
from tests.conftest import SF_SMALL


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path, rules=U.RULES):
    fits = [(len(t), t, v) for v, t in rules for h, p in [(t.split("/", 1)[0], "/" + t.split("/", 1)[1])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


AWKWARD = [None, "", "no scheme at all", "://", "http://", "HTTP://WWW.Example.ORG", "http://example.org/es/1", "http://a.example.org/en/12?x=1&y=2;z#q",
           "http://notexample.org/es/", "http://org/", "http://com/de/", "http://xcom/de/", "ftp://É.Com/fr/x#://b/c", "http://a.com?u=/de/",
           "http://a.com/de", "http://a.com/DE/", "http://example.org/en/1\n2", "http://a.net/" + "x/" * 100_000, "http://a.com/de/", "http://a.com/de/"]


def test_parts_and_rules(spark):
    rows = [(i, u) for i, u in enumerate(AWKWARD)] + [(None, "http://a.org/x"), (3, "http://b.org/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS rule", "1 AS label", "2 AS urls", "'q' AS tld", "0 AS score")
    got = U.judge(df).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule or "") for r in got) == sorted(
        (i is None, i or 0, *parts(u), rule_of(*parts(u))[0] or "") for i, u in rows)
    assert all(r.verdict == (rule_of(r.host, r.path)[1] or ("block" if r.score >= 0.5 else "allow")) for r in got)


def test_longest_rule_wins_in_any_order(spark):
    rules = (("block", "b.com/x/"), ("allow", "com/"), ("allow", "b.com/"), ("block", "com/x/long/"))
    df = spark.createDataFrame([(u,) for u in ("http://a.b.com/x/1", "http://b.com/x/long/1", "http://c.com/x/long/", "http://b.com/y")], "url string")
    for order in (rules, rules[::-1]):
        host, path = U.host_and_path(df["url"])
        rule, verdict = U.matched_rule(host, path, order)
        assert [(r.r, r.v) for r in df.select(rule.alias("r"), verdict.alias("v")).collect()] == [
            ("b.com/x/", "block"), ("com/x/long/", "block"), ("com/x/long/", "block"), ("b.com/", "allow")]


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r for r in U.judge(pages).collect()}
    for p in pages.collect():
        host, path = parts(p.url)
        rule, verdict = rule_of(host, path)
        assert (got[p.page_id].host, got[p.page_id].path, got[p.page_id].rule) == (host, path, rule)
        assert verdict is None or got[p.page_id].verdict == verdict
    assert len(got) == pages.count()


def test_empty_table_and_no_labels(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    got = U.judge(spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")).collect()
    assert [r.verdict for r in got] == ["allow", "allow"]
    assert [r.verdict for r in U.judge(spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.com/de/1")], "page_id long, url string")).collect()].count("block") >= 1


def test_lexical_features():
    urls = ["http://a1.b-c.com/x/yy/z.html?p=1&q=&&r;s#f", "", "a" * 50, "http://é.com/"]
    hosts, paths = zip(*map(parts, urls))
    got = U.lexical(*([t.encode() for t in c] for c in (urls, hosts, paths)))

    def entropy(b):
        return -sum(b.count(c) / len(b) * math.log2(b.count(c) / len(b)) for c in set(b)) if b else 0.0
    for row, url, host, path in zip(got, urls, hosts, paths):
        want = dict(zip(U.LEXICAL, row))
        u, h = url.encode(), host.encode()
        assert (want["url_length"], want["host_length"], want["path_length"]) == (len(u), len(h), len(path.encode()))
        assert want["url_entropy"] == pytest.approx(entropy(u)) and want["host_entropy"] == pytest.approx(entropy(h))
        assert want["url_digits"] == pytest.approx(sum(c in b"0123456789" for c in u) / max(1, len(u)))
    first = dict(zip(U.LEXICAL, got[0]))
    assert (first["depth"], first["labels"], first["parameters"], first["hyphens"], first["fragment"]) == (3, 3, 4, 1, 1)


def test_best_split_against_every_split():
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 6, (200, 4)), draw.integers(0, 2, 200)
    grad, hess = 0.5 - y, np.full(200, 0.25)
    g, h = (np.stack([np.bincount(x[:, f], w, 6) for f in range(4)])[None] for w in (grad, hess))
    gain, f, b = U.best_splits(g, h)

    def value(rows):
        return grad[rows].sum() ** 2 / (hess[rows].sum() + U.PENALTY)
    every = np.ones(200, bool)
    want = {(i, c): value(x[:, i] <= c) + value(x[:, i] > c) - value(every) for i in range(4) for c in range(5)}
    assert gain[0] == pytest.approx(max(want.values())) and want[int(f[0]), int(b[0])] == pytest.approx(max(want.values()))


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(4)
    x = draw.random((4000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = U.boost(x[:3000], y[:3000])
    assert (((model.score(x[3000:]) >= 0.5) == y[3000:]).mean()) > 0.97


def test_held_out_accuracy(spark):
    """Hosts and paths drawn by class; a third of the labels is withheld from the fit."""
    draw = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        bad = draw.random() < 0.4
        name = "".join(draw.choice(list("abcdefghij0123456789" if bad else "aeioulnrst"), draw.integers(6, 14)))
        query = "?" + "&".join(f"p{k}={draw.integers(1e6)}" for k in range(draw.integers(1, 5))) if bad and draw.random() < 0.6 else ""
        rows.append((i, f"http://{name}.{'top' if bad and draw.random() < 0.5 else 'net'}/{'/'.join('abc'[:draw.integers(1, 4)])}/{draw.integers(100)}{query}", int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    model, statistics = U.train(df.selectExpr("url", "CASE WHEN page_id % 3 <> 0 THEN bad END AS label"))
    scores = {r.page_id: r.score for r in U.score(df, model, statistics).collect()}
    held = [(scores[i], bad) for i, _, bad in rows if i % 3 == 0]
    assert np.mean([(s >= 0.5) == bool(b) for s, b in held]) > 0.9


def test_scores_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    one, many = ({r.page_id: (r.verdict, r.score) for r in U.judge(pages.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == many.keys() and all(one[k][0] == many[k][0] and one[k][1] == pytest.approx(many[k][1], abs=1e-9) for k in one)
