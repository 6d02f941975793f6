"""Rules and scores against plain Python."""

from __future__ import annotations

from collections import defaultdict

import pytest

from wiretally.llm import link_graph
from wiretally.llm.queries import URL_RULES, queries

SF_DIR = "/root/testdata/sf0.001"


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:n], rest[n:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, path[:end]


def plain_rule(host: str, path: str, rules) -> tuple[str, str] | None:
    fits = [
        (len(h + p), h + p, action)
        for action, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else None


def test_query_follows_the_rules(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = queries()["op9_url_filter"](spark, SF_DIR).collect()
    assert len(found) == len(pages)
    for r in found:
        host, path = split_url(pages[r.page_id])
        rule = plain_rule(host, path, URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == (rule[1] if rule else "block" if r.distrust > r.trust else "allow")


def plain_scores(edges, seeds, rounds):
    out = defaultdict(float)
    for src, _, w in edges:
        out[src] += w
    whole = sum(seeds.values())
    start = {h: s / whole for h, s in seeds.items()}
    score = dict(start)
    for _ in range(rounds):
        now = {h: s * 0.15 for h, s in start.items()}
        for src, dst, w in edges:
            if src in score:
                now[dst] = now.get(dst, 0) + 0.85 * score[src] * w / out[src]
        score = now
    return score


def test_scores_equal_plain_iteration(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("b", "d", 3.0), ("e", "d", 1.0)]
    seeds = [("a", 3, 0), ("e", 1, 0), ("d", 0, 5)]
    table = spark.createDataFrame(edges, "src string, dst string, weight double")
    seed_table = spark.createDataFrame(seeds, "host string, trust long, distrust long")
    found = {r.host: (r.trust, r.distrust) for r in link_graph.propagated(table, seed_table, 1e-12).collect()}
    trust = plain_scores(edges, {"a": 3, "e": 1}, 200)
    distrust = plain_scores([(d, s, w) for s, d, w in edges], {"d": 5}, 200)
    for host in set(trust) | set(distrust):
        assert found[host] == pytest.approx((trust.get(host, 0), distrust.get(host, 0)))


def test_links_and_edge_rows(spark):
    link = '<a href="https://Bad.test/x">x</a><A HREF=\'//ok.test\'>y</A><a href="/own">z</a>'
    rows = [
        (1, "http://one.test/a?b#c", link), (1, "http://one.test/a?b#c", link), (2, "http://bad.test", None),
        (3, None, "x"), (4, "no scheme", ""), (5, "https://HOST?q", "y" * 200_000), (6, "x://a://b/c", None),
        (7, "http://ok.test/#/p?x", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {tuple(r) for r in link_graph.link_edges(pages).collect()}
    assert edges == {("one.test", "bad.test", 2.0), ("one.test", "ok.test", 2.0)}
    rules = spark.createDataFrame([("block", "bad.test", ""), ("allow", "ok.test", "/")], "action string, host string, path string")
    found = link_graph.judged_pages(pages.selectExpr("*", "1 AS host", "2 AS path"), rules).collect()
    assert sorted((r.page_id, r.host, r.path) for r in found) == sorted((i, *split_url(u)) for i, u, _ in rows)
    assert {r.page_id: (r.rule, r.verdict) for r in found} == {
        1: (None, "block"), 2: ("bad.test", "block"), 3: (None, "allow"), 4: (None, "allow"),
        5: (None, "allow"), 6: (None, "allow"), 7: ("ok.test/", "allow"),
    }
    assert link_graph.judged_pages(pages.limit(0), rules).count() == 0
    assert link_graph.judged_pages(pages, rules.limit(0)).count() == len(rows)


def test_a_long_chain_of_hosts_is_followed(spark):
    """Distrust reaches a host 60 links before the blocked one; the scores are those of the query's pages."""
    link = '<a href="http://h{}.test/">x</a>'
    rows = [(k, f"http://h{k}.test/", link.format(k + 1)) for k in range(61)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("block", "h60.test", "/")], "action string, host string, path string")
    found = {r.page_id: r for r in link_graph.judged_pages(pages, rules).collect()}
    edges = [(f"h{k + 1}.test", f"h{k}.test", 1.0) for k in range(61)]
    expected = plain_scores(edges, {"h60.test": 1}, 100)
    assert all(found[k].verdict == "block" for k in range(61))
    for k in range(61):
        assert found[k].distrust == pytest.approx(expected[f"h{k}.test"], abs=1e-5)
