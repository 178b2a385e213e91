from urllib.parse import urljoin, urlparse

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagewright.functions import code as CD
from pagewright.functions import markdown as MD
from pagewright.functions import text as T
from pagewright.functions import urls as U

BASE = "https://docs.a.com/guide/intro"


def test_normalize_fixture(spark):
    hrefs = ["/x#y", "x", "../x", "?p=2", "//cdn.docs.a.com/z", "https://docs.a.com.evil.io/",
             "https://a.com/", "MAILTO:x@y"]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = df.select(U.normalize_url(F.col("h"), F.lit(BASE), F.lit("docs.a.com")).alias("n"),
                    U.normalize_url(F.col("h"), F.lit(BASE), F.lit("docs.a.com"), strict=True).alias("s")).collect()
    assert [r.n for r in got] == ["https://docs.a.com/x", "https://docs.a.com/guide/x", "https://docs.a.com/x",
                                  "https://docs.a.com/guide/intro?p=2", "https://cdn.docs.a.com/z",
                                  "https://docs.a.com.evil.io/", None, None]
    assert got[5].s is None and got[4].s == "https://cdn.docs.a.com/z"
    skip = spark.createDataFrame([(h,) for h in ["#top", "mailto:x@y", "tel:1", "javascript:f()", "", "/ok"]], "h string")
    assert [r[0] for r in skip.select(U.skip_href(F.col("h"))).collect()] == [True] * 5 + [False]


seg = st.sampled_from(["a", "b", "..", ".", "", "x.html", "q?z=1"])


@settings(max_examples=40, deadline=None)
@given(st.lists(seg, min_size=1, max_size=5), st.booleans())
def test_urljoin_matches_python(spark, parts, absolute):
    href = ("/" if absolute else "") + "/".join(parts)
    if not href:
        return
    for base in [BASE, "https://docs.a.com", "http://h.x.org/a/b/?k=v"]:
        got = spark.range(1).select(U.urljoin(F.lit(base), F.lit(href))).first()[0]
        assert got == urljoin(base, href), (base, href)


def test_text_functions(spark):
    r = spark.range(1).select(
        T.py_strip(F.lit("\u00a0 a b \n")).alias("s"),
        T.word_set(F.lit("A a  b\tB c")).alias("w"),
        T.py_title(F.lit("core_concepts")).alias("t"),
        MD.toc_entry(F.lit("API [v2] Guide")).alias("toc"),
        MD.format_section(T.py_title(F.lit("core_concepts")), 2).alias("sec"),
        CD.normalize_code(F.lit("let total = add(1, 2)\n// note\n  def f():  ")).alias("n"),
    ).first()
    assert r.s == "a b"
    assert sorted(r.w) == ["a", "b", "c"]
    assert r.t == "Core_Concepts" == "core_concepts".title()
    assert r.toc == "- [API v2 Guide](#api-v2-guide)"
    assert r.sec == "## Core_Concepts\n\n"
    assert r.n == "total = add(1, 2)\nf():"
    assert urlparse("https://d.io/").path == "/"


def test_urljoin_empty_authority(spark):
    for href in ["//", "///x", "//?q=1", "//#f", "//a.b/c", "////a", "///../x", "//./x"]:
        for base in [BASE, "https://docs.a.com"]:
            got = spark.range(1).select(U.urljoin(F.lit(base), F.lit(href.split("#")[0]))).first()[0]
            assert got == urljoin(base, href.split("#")[0]), (base, href)
