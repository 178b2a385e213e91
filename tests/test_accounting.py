from pyspark.sql import functions as F

from pagewright.operators import accounting as AC
from pagewright.operators.assemble import example_titles


def _ranked(spark, tokens):
    return spark.createDataFrame([("s", i, t, True) for i, t in enumerate(tokens)],
                                 "site string, rank bigint, tokens bigint, ok boolean")


def _seeds(spark):
    return spark.createDataFrame([("s", 20000)], "site string, max_tokens int")


def test_budget_cut_and_batches(spark):
    cases = [([10000, 9000, 700, 5], 3, 3), ([4000] * 8, 5, 5), ([6000] * 8, 4, 4), ([19700, 100, 100, 100], 1, 3)]
    for tokens, g1, g2 in cases:
        r = _ranked(spark, tokens)
        assert AC.budget_cut(r, _seeds(spark), [("rank", True)]).count() == g1, tokens
        b = AC.budget_batches(r, _seeds(spark), [("rank", True)])
        assert b.where("included").count() == g2, tokens


def test_warning_flag(spark):
    # used 2,999 -> no warning; used 3,001 -> warning (remaining <= 0.85)
    r = _ranked(spark, [2999, 2, 5])
    u = AC.running_usage(r, _seeds(spark), [("rank", True)]).orderBy("rank").collect()
    assert [x.used_before for x in u] == [0, 2999, 3001]
    assert [x.warning for x in u] == [False, False, True]


def test_cost_and_unknown_model(spark):
    usage = spark.createDataFrame([("s", "gpt-4o-mini", 1_000_000, 1_000_000), ("s", "other", 5, 5)],
                                  "site string, model string, prompt_tokens bigint, completion_tokens bigint")
    rates = AC.rates_frame(spark)
    s = AC.usage_summary(usage, rates).first()
    assert abs(s.total_cost - 0.375) < 1e-12 and s.total_tokens == 2_000_000
    assert AC.unmatched_usage(usage, rates).count() == 1


def test_example_titles(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "page long, n long")
    got = {(r.page, r.n): r.title for r in example_titles(df, ["page"], "n").collect()}
    assert got == {(1, 1): "Example", (2, 1): "Example 1", (2, 2): "Example 2"}


def test_write_bundles_sink_keeps_order(spark, tmp_path):
    from pagewright.operators.assemble import bundles, write_bundles
    rows = [("a.io", p, r, s, f"<{p}.{r}.{s}>\n" + ("\n" if s else "")) for p in range(5) for r in range(3) for s in range(2)]
    frags = spark.createDataFrame(rows * 1, "site string, part int, rank int, sub int, text string")
    frags = frags.unionByName(frags.withColumn("site", F.lit("b.io")))
    out = str(tmp_path / "bundles")
    write_bundles(frags, out, num_partitions=4)
    one = {r.site: r.markdown for r in bundles(frags).collect()}
    import glob
    import os
    for site in ("a.io", "b.io"):
        files = sorted(glob.glob(os.path.join(out, f"site={site}", "part-*")))
        text = "".join(open(f, encoding="utf-8").read() for f in files)
        assert text == one[site]
        assert text.startswith("<0.0.0>\n<0.0.1>") and text.endswith("<4.2.1>\n\n")


def test_rank_within_equals_row_number_on_a_hot_group(spark):
    from pyspark.sql import Window
    from pagewright.operators.order import rank_within
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 13).cast("string")).alias("site"),
        (F.col("id") * 7919 % 1000).alias("score"), F.col("id"))
    want = df.withColumn("rank", F.row_number().over(
        Window.partitionBy("site").orderBy(F.col("score").desc(), "id")))
    got = rank_within(df, ["site"], [("score", False), ("id", True)], num_partitions=8)
    assert got.select("site", "id", "rank").exceptAll(want.select("site", "id", "rank")).count() == 0
    assert got.count() == 5000


def test_budget_of_a_large_site_keeps_the_session_and_rejects_sites_without_a_seed(spark):
    from pagewright.operators.accounting import budget_cut, running_usage
    rows = [("big", r, 0 if r % 3 else 5) for r in range(3000)] + [("none", 1, 1)]
    ranked = spark.createDataFrame(rows, "site string, rank bigint, tokens bigint")
    seeds = spark.createDataFrame([("big", 4000)], "site string, max_tokens bigint")
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key, None)
    cut = budget_cut(ranked, seeds, [("rank", True)])
    used, want = 0, []
    for _, r, t in rows[:-1]:
        if used < 4000 * 0.98:
            want.append((r, used))
        used += t
    got = sorted((x["rank"], x.used_before) for x in running_usage(cut, seeds, [("rank", True)]).collect())
    assert got == want and spark.conf.get(key, None) == before
