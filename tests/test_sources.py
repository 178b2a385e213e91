"""Site identity, HTML folders, links against seeds, published site files."""
import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import assemble as AS
from pagewright.operators import links as LK
from pagewright.sources import tables as S

RULES = [LK.Rule("api", ("api",), 60, False)]


def test_identity_is_the_host_with_its_port(spark):
    urls = ["https://a.co.uk/x", "https://b.co.uk/x", "https://me.github.io/", "https://you.github.io/", "http://H.io:8080/a", "http://h.io/a"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(S.site_identity("url")).collect()]
    assert got == ["a.co.uk", "b.co.uk", "me.github.io", "you.github.io", "h.io:8080", "h.io"]
    labels = [r[0] for r in df.select(S.site_identity("url", "labels")).collect()]
    assert labels[:4] == ["co.uk", "co.uk", "github.io", "github.io"]
    with pytest.raises(ValueError):
        S.site_identity("url", "owner")


def test_html_folders_become_pages_with_urls(spark, tmp_path):
    for name in ("d.io/index.html", "d.io/api/a.html", "e.co.uk/guide/index.htm", "loose.html"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"<main>{name}</main>\n<p>line two")
    got = {r.url: (r.site, r.html.split("<")[1]) for r in S.read_html_dir(spark, str(tmp_path)).collect()}
    file_url = next(u for u in got if u.startswith("file:"))
    assert got.pop(file_url) == ("file:", "main>loose.html") and file_url.endswith("/loose.html")
    assert got == {"https://d.io/": ("d.io", "main>d.io/index.html"), "https://d.io/api/a.html": ("d.io", "main>d.io/api/a.html"),
                   "https://e.co.uk/guide/": ("e.co.uk", "main>e.co.uk/guide/index.htm")}
    one = {r.url: r.site for r in S.read_html_dir(spark, str(tmp_path / "d.io"), "https://docs.d.io:81/v1").collect()}
    assert one == {"https://docs.d.io:81/v1/": "docs.d.io:81", "https://docs.d.io:81/v1/api/a.html": "docs.d.io:81"}


def test_links_resolve_against_the_seed_or_the_page(spark):
    pages = spark.createDataFrame([("d.io", 1, "https://d.io/guide/x", ["api", "/api#t", "https://api.else.io/"]), ("none", 2, "https://n/", ["/api"])],
                                  "site string, page_id long, url string, hrefs array<string>")
    seeds = spark.createDataFrame([("d.io", "https://d.io/", "d.io")], "site string, base_url string, base_domain string")

    def urls(resolve):
        return [r.url for r in LK.site_links(pages, seeds, RULES, resolve).orderBy("pos").collect()]

    assert urls("site") == ["https://d.io/api", "https://d.io/api"]
    assert urls("page") == ["https://d.io/guide/api", "https://d.io/api"]


def test_published_versions_are_whole_or_absent(spark, tmp_path):
    rows = [(s, p, r, 0, f"{s}.{p}.{r}\n") for s in ("a.io", "b.io") for p in range(4) for r in range(6)]
    frags = spark.createDataFrame(rows, "site string, part int, rank int, sub int, text string")
    sites = spark.createDataFrame([("a.io", "https://a.io/"), ("b.io", "https://docs.b.io/")], "site string, base_url string")
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        AS.read_bundles(spark, path)
    first = AS.publish_bundles(frags, sites, path, 5)
    AS.publish_bundles(frags.withColumn("text", F.upper("text")), sites, path, 3)
    os.remove(os.path.join(path, "manifests", AS.latest_version(spark, path), "_SUCCESS"))      # a publication that failed
    assert AS.latest_version(spark, path) == first
    whole = {}
    for r in AS.read_bundles(spark, path).orderBy("site", "slice").collect():
        whole.setdefault((r.site, r.name), []).append(r.markdown)
    assert {k: "".join(v) for k, v in whole.items()} == {
        (s, n): "".join(t for x, _, _, _, t in rows if x == s)
        for s, n in (("a.io", "a.io_documentation.md"), ("b.io", "docs.b.io_documentation.md"))}
    assert max(len(v) for v in whole.values()) > 1
