from __future__ import annotations

import random
import re

from keydrivers.llm.components import components
from keydrivers.llm.url_filter import RULES, canonical_form, filtered
from pyspark.sql import functions as F


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(url):
    host, path = parts(url)
    fits = [
        r
        for r in RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.name), default=None)


def groups(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    random.seed(5)
    edges = [(i, i + 1) for i in range(300)]
    edges += [(1000, 1001 + i) for i in range(500)]
    edges += [(random.randint(3000, 3800), random.randint(3000, 3800)) for _ in range(350)]
    edges += [(7, 7), (None, 3), (5, 6), (6, 5)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    plain = groups([(a, b) for a, b in edges if a is not None and a != b])
    assert {r.node: r.component for r in found} == plain
    assert len(found) == len(plain)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rules_on_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    found = filtered(pages).collect()
    assert len(found) == len(urls)
    for r in found:
        rule = rule_of(urls[r.page_id])
        assert (r.host, r.path) == parts(urls[r.page_id])
        assert r.rule == (rule.name if rule else None)
        assert r.verdict == (rule.verdict if rule else "allow")


def link(href):
    return f"<html><head><LINK href='{href}' rel=\"canonical\"></head>"


def refresh(href):
    return f'<meta http-equiv="refresh" content="0; URL={href}">'


def test_blocks_reach_aliases_and_allows_go_first(spark):
    rows = [
        (1, "http://mirror.net/a", link("http://shop.com/de/x")),
        (2, "http://other.net/a", refresh("http://mirror.net/a?utm_source=q")),
        (3, "http://third.net/p/q?x=1", link("//other.net/a")),
        (4, "http://third.net/p/r", link("q?x=1#top")),
        (5, "http://free.net/a", refresh("http://shop.com/de/y")),
        (6, "http://free.net/b", link("/a")),
        (7, "http://free.net/c", link("http://x.org/")),
        (8, "http://free.net/c", link("http://free.net/a")),
        (9, "http://x.org/es/1", ""),
        (10, "http://x.example.org/es/1", None),
        (11, None, link("http://shop.com/de/x")),
        (12, "shop.com/de/x", ""),
        (13, "HTTP://SHOP.com", ""),
        (14, "http://alone.net/", link("mailto:me")),
        (15, "http://moved.net/", ""),
        (None, "http://mirror.net/a#end", None),
        (4, "http://third.net/p/r", None),
    ]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id bigint, url string, html string, verdict string")
    moved = spark.createDataFrame([("http://moved.net/", "http://mirror.net/a#x")], "a string, b string")
    found = {(r.page_id, r.host): r for r in filtered(pages, redirects=moved).collect()}
    blocked = {k[0] for k, r in found.items() if r.verdict == "block"}
    assert blocked == {1, 2, 3, 4, 10, 15, None}
    assert found[9, "x.org"].rule == "org/"
    assert found[10, "x.example.org"].rule == "example.org/es/"
    assert found[11, ""].path == "" and found[12, ""].rule is None
    assert found[13, "shop.com"].path == ""
    assert filtered(pages).count() == len(rows)
    assert filtered(pages.where("false")).count() == 0


def test_canonical_form(spark):
    urls = {
        "http://H.com/A?utm_source=x&b=1#z": "http://h.com/A?b=1",
        "http://h.com/a?b=1&utm_medium=x": "http://h.com/a?b=1",
        "http://h.com/a?utm_source=x": "http://h.com/a",
        "http://h.com/a?utm_a=1&utm_b=2": "http://h.com/a",
        "http://h.com/a?b=utm_a": "http://h.com/a?b=utm_a",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.c for r in df.select("url", canonical_form(F.col("url")).alias("c")).collect()} == urls
