"""Traversal (T3) of small link graphs."""
from pagewright.operators.links import Rule
from pagewright.plans.crawl import reachable

RULES = [Rule("essential", ("intro",), 100, True), Rule("core_concepts", ("concepts",), 80, True),
         Rule("features", ("feat",), 70, False), Rule("api", ("api",), 60, False)]
BASE = "https://d.io/"
LINKS = {
    "start": ["/api/a", "/feat/x", "/concepts/c1", "/blog"],
    "api/a": ["/api/b", "/feat/y", "/intro/i"],
    "feat/x": ["/concepts/c2", "/api/a"],
    "concepts/c1": ["/feat/z", "/concepts/c2"],
    "api/b": [], "feat/y": ["/api/c"], "intro/i": ["/feat/w"], "concepts/c2": [],
    "feat/z": [], "api/c": [], "feat/w": [],
}


def _gated(spark, links, failed=()):
    rows = [("d.io", i, BASE + k, hs, "no_main" if k in failed else None) for i, (k, hs) in enumerate(links.items())]
    gated = spark.createDataFrame(rows, "site string, page_id bigint, url string, hrefs array<string>, reason string")
    return spark.createDataFrame([("d.io", BASE + next(iter(links)))], "site string, start_url string"), gated


def _depths(spark, links, failed=(), **how):
    seeds, gated = _gated(spark, links, failed)
    return {r.url[len(BASE):]: r.depth for r in reachable(seeds, gated, RULES, **how).collect()}


def test_reachable_depths(spark):
    got = _depths(spark, LINKS)
    assert got["start"] == 0 and got["api/a"] == 1 and got["api/b"] == 2 and got["feat/w"] == 3
    assert set(got) == set(LINKS)
    assert set(_depths(spark, LINKS, max_depth=1)) == {"start", "api/a", "feat/x", "concepts/c1"}


def test_failed_pages_are_reached_and_not_left(spark):
    assert set(_depths(spark, LINKS, failed=("api/a", "feat/x"))) == {"start", "api/a", "feat/x", "concepts/c1", "feat/z", "concepts/c2"}


def test_a_chain_a_cycle_and_a_wide_fan(spark):
    chain = {f"api/{i}": [f"/api/{i + 1}", "/api/0", f"/api/{i}#top"] for i in range(30)}
    assert _depths(spark, chain) == {f"api/{i}": i for i in range(30)}
    fan = {"start": [f"/api/{i}" for i in range(5000)], **{f"api/{i}": ["/start", f"/api/{(i + 1) % 5000}"] for i in range(5000)}}
    got = _depths(spark, fan)
    assert len(got) == 5001 and set(got.values()) == {0, 1}
