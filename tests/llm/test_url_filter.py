from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import url_filter
from lodestone.llm.queries import URL_RULES


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    "http://www.example.com/en/1", "https://EXAMPLE.com/en/?q", "http://a.www.example.com/en/x#y", "http://example.com/fr/", "http://com/", "http://x.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://net/en/", "x",
    None, "", "http://", "http://example.com", "http://example.com?/en/", "http://example.com:80/en/", "a://b://example.com/en/", "http://.com/", "http://com./", "http://éxample.com/en/", "http://..net/es/\n",
]


def test_urls(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)]
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string"), URL_RULES).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == {i: plain(u, URL_RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("most", [url_filter.MOST_WORDS, 0])
def test_many_rules(spark, most, monkeypatch):
    """The cascade, and the join that serves lists too long for a plan."""
    monkeypatch.setattr(url_filter, "MOST_WORDS", most)
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    rules = {(host(), rng.choice(["/", "/x/", "/x/y", "/z"])): rng.choice(["allow", "block"]) for _ in range(80)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{host()}{rng.choice(['', '/', '/x/', '/x/y', '/x/yy', '/zz', '/q'])}" for _ in range(400)]
    found = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in found} == {i: plain(u, rules)[2:] for i, u in enumerate(urls)}


def test_cascade_is_exact(spark):
    listed = spark.range(0, 500).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(500, 20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.Cascade.build(listed, others)
    assert len(cascade.levels) > 1
    assert listed.where(cascade.holds(F.col("key"))).count() == 500
    assert others.where(cascade.holds(F.col("key"))).count() == 0
    assert sum(len(w) for _, _, w in cascade.levels) * 64 < 500 * 20


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, URL_RULES).count() == 0
    assert url_filter.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), []).first()["verdict"] == "allow"
