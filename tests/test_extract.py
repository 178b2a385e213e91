from pyspark.sql import functions as F

from pages import html_pages
from pagewright.functions import code as CD
from pagewright.operators import dedup as DD
from pagewright.operators import extract as X


def _ex(spark, bodies, urls=None):
    rows = [(i, (urls or {}).get(i, f"https://d.io/p{i}"), b) for i, b in enumerate(bodies)]
    return {r.page_id: r for r in X.extract_pages(html_pages(spark, rows)).collect()}


def test_main_content_cascade(spark):
    got = _ex(spark, [
        "<article>y</article><main>x</main>",
        '<div class="page-content">a</div><div class="content b">c</div>',
        '<div class="Docs-Wrap">d</div>',
        '<div class="remain">m</div>',
        '<div class="tab-contents">t</div>',
        "<p>z</p>",
        "<article> a <b> b</b><!-- c --><script>d</script>e </article>",
    ])
    assert [(got[i].main_rule, got[i].main_text) for i in range(7)] == [
        (1, "x"), (3, "c"), (4, "d"), (5, "m"), (6, "t"), (None, None), (2, "a b e")]


def test_title_cascade(spark):
    bodies = ["<h1>X</h1><title>Guide</title><main>m</main>",
              '<h2 class="page-title">Setup</h2><main>m</main>',
              '<meta property="og:title" content=" Hi there "><main>m</main>',
              "<main>m</main>", "<main>m</main>", "<main>m</main>"]
    urls = {3: "https://d.io/a/getting_started-now", 4: "https://d.io/v1.2-x.html", 5: "https://d.io/"}
    ex = X.extract_pages(html_pages(spark, [(i, urls.get(i, f"https://d.io/p{i}"), b) for i, b in enumerate(bodies)]))
    got = dict(ex.select("page_id", X.choose_title(F.col("title_candidates"), F.col("url")).alias("t"))
               .rdd.map(tuple).collect())
    assert [got[i] for i in range(6)] == ["Guide", "Setup", "Hi there", "Getting Started Now", "V1.2 X.Html", ""]


def test_code_blocks_fixture(spark):
    blocks = [
        '<pre><code class="language-py">import os\nprint(os.getcwd())</code></pre>',
        "<pre><code class=\"language-py\">class A:\n    kind = 'type x'</code></pre>",
        "<pre><code>no language here</code></pre>",
        '<pre><code class="language-js">let x=1</code></pre>',
        '<pre><code class="lang-npm">npm install thing</code></pre>',
        '<pre><code class="language-js">const total = add(1, 2)</code></pre>',
        '<pre><code class="language-js">let total = add(1, 2)\n// note</code></pre>',
        '<pre><code class="language-go">func main() { run() }</code></pre>',
        '<pre><code class="language-py"># only a comment</code></pre>',
        '<pre><code class="language-js">// another comment</code></pre>',
    ]
    ex = X.extract_pages(html_pages(spark, [(0, "https://d.io/x", "<main>" + "".join(blocks) + "</main>")]))
    b = (X.code_blocks(ex).withColumn("language", CD.code_language(F.col("classes"), F.col("code")))
         .where(CD.is_kept_language(F.col("language")))
         .withColumn("bid", F.concat_ws(":", "page_id", "pos")))
    kept = (DD.first_wins(b, ["site"], CD.normalize_code(F.col("code")), [("sel_ord", True), ("doc_ord", True)],
                          "bid", "k").where("k").orderBy("sel_ord", "doc_ord").select("language", "code").collect())
    assert [r.language for r in kept] == ["python", "javascript", "nodejs", "javascript", "python"]
    assert len(kept) == 5


def test_plan_has_one_python_stage_and_no_html_above(spark):
    from pagewright.plans import common as C
    ex = X.extract_pages(C.pages(spark, "/root/testdata/sf0.001")).select("page_id", "main_text")
    plan = ex._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    above = plan.split("MapInPandas")[0]
    assert "html" not in above


def test_unclosed_and_unmatched_tags_parse_in_linear_time():
    import time
    began = time.time()
    open_ = X.extract_one("<main>" + "<b>x" * 200_000 + "</i>" * 200_000)
    assert open_["main_text"] == " ".join(["x"] * 200_000)
    deep = X.extract_one("<main><pre>" + "<code class='k'>" * 50 + "a line of code" + "</code>" * 50 + "</pre>" + "<span>" * 100_000)
    assert len(deep["code"]) == 50 and all(c["code"] == "a line of code" for c in deep["code"])
    assert time.time() - began < 20


def test_records_leave_by_bytes_and_not_by_rows(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(X, "CHUNK_CHARS", 1000)
    pages = pd.DataFrame({"site": "s", "page_id": range(10), "url": "u", "html": ["<main>" + "y" * 600] * 10})
    sizes = [len(p) for p in X._parse_batches([pages])]
    assert sizes == [2] * 5


def test_a_parsed_page_leaves_no_cycles_behind():
    import gc
    page = "<html><main>" + "<div class='a'><p>x<b>y</b>" * 300 + "</main><p>z"
    X.extract_one(page)
    gc.collect()
    gc.disable()
    try:
        X.extract_one(page)
        assert gc.collect() < 50
    finally:
        gc.enable()


def test_extraction_is_bounded_by_bytes_and_done_once_a_query(spark, monkeypatch):
    from pagewright.plans import registry as R
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, real = spark.conf.get(key, None), [], X.extract_pages

    def counted(pages):
        seen.append(spark.conf.get(key, None))
        return real(pages)

    monkeypatch.setattr(X, "extract_pages", counted)
    for name in ("frontier_topk", "linked_pages_resolution"):
        R.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [str(X.BATCH_BYTES)] * 2
    assert spark.conf.get(key, None) == before


def test_streams_and_turns_extract_bounded_batches_once(spark, monkeypatch):
    from pagewright.plans import registry as R
    key, seen, real = "spark.sql.execution.arrow.maxBytesPerBatch", [], X.extract_pages

    def counted(pages):
        seen.append(pages.sparkSession.conf.get(key, None))
        return real(pages)

    monkeypatch.setattr(X, "extract_pages", counted)
    for name in ("turn_code_blocks", "stream_extract"):
        R.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [str(X.BATCH_BYTES)] * 2
