"""Generation stages with a caller-supplied model function."""
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.operators import generate as G


def test_generate_critique_refine_with_a_model_function(spark):
    def fake_model(reqs):
        out = []
        for r in reqs:
            if r["system"] == fixed.SYSTEM_PROMPT:
                assert r["temperature"] == fixed.GENERATE_TEMPERATURE
                out.append(("## " + r["user"].split("\n")[0][7:] + "\n\nbody", 10, 3))
            elif r["system"] == fixed.CRITIQUE_SYSTEM_PROMPT:
                assert r["temperature"] == fixed.CRITIQUE_TEMPERATURE
                out.append(("needs examples" if "keep" not in r["user"] else "", 5, 2))
            else:
                assert r["system"] == fixed.REFINE_SYSTEM_PROMPT and r["temperature"] == fixed.REFINE_TEMPERATURE
                out.append(("" if "empty" in r["user"] else "refined", 7, 4))
        return out

    df = spark.createDataFrame([("s", 1, "Alpha", "text a"), ("s", 2, "Beta keep", "text b"),
                                ("s", 3, "Gamma empty", "text c")],
                               "site string, page_id bigint, title string, main_text string")
    g = G.generate(df, fake_model)
    rows = {r.page_id: r for r in g.collect()}
    assert rows[1].generated == "## Alpha\n\nbody" and rows[1].prompt_tokens == 10 and rows[1].completion_tokens == 3
    c = G.critique(g.withColumn("generated", F.concat("generated", F.lit(" "), "title")), fake_model)
    r = {x.page_id: x for x in G.refine(c, fake_model).collect()}
    assert r[1].final == "refined" and r[1].refine_prompt_tokens == 7
    assert r[2].critique == "" and r[2].final == r[2].generated and r[2].refine_prompt_tokens == 0
    assert r[3].final == r[3].generated                  # empty refinement keeps the original
    assert r[1].critique_prompt_tokens == 5


def test_prompt_table_and_default_render(spark):
    df = spark.createDataFrame([("T", "c")], "title string, main_text string")
    p = G.prompts(df).first()
    assert p.user_prompt == fixed.USER_PROMPT_FORMAT.format(title="T", content="c")
    assert p.temperature == 0.0
    g = G.generate(df).first()
    assert g.generated == "## T\n\nc\n"


def test_curate_end_to_end_with_model_functions(spark):
    from pagewright.plans import common as C
    from pagewright.plans.curate import curate
    from pagewright.sources.seeds import seeds_from_pages

    def gen(reqs):
        # a short summary per page; the page whose title starts with "Th" gets
        # its own prompt back, which the pool must reject as its own copy
        out = []
        for r in reqs:
            title = r["user"].split("\n")[0][len("Title: "):]
            text = r["user"] if title.startswith("Th") else f"Summary {title}"
            out.append((text, 100, 20))
        return out

    def crit(reqs):
        return [("add examples", 3, 1) for _ in reqs]

    def ref(reqs):
        return [("Refined page", 4, 2) for _ in reqs]

    d = "/root/testdata/sf0.001"
    p = C.pages(spark, d)
    out = curate(p, seeds_from_pages(p), C.TEST_RULES, C.profile(spark, d),
                 generate_fn=gen, critique_fn=crit, refine_fn=ref)
    cur = out["curated"].collect()
    assert cur and all(r.content == "Refined page" for r in cur)
    usage = {(r.stage): (r.p, r.c) for r in out["usage"].groupBy("stage").agg(
        F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c")).collect()}
    n_gen = out["usage"].where("stage = 'generate'").count()
    assert usage["generate"] == (100 * n_gen, 20 * n_gen)
    n_kept = out["usage"].where("stage = 'critique'").count()
    assert usage["critique"] == (3 * n_kept, n_kept) and usage["refine"] == (4 * n_kept, 2 * n_kept)
    reasons = {r.reason for r in out["rejects"].collect()}
    assert "dup_generated" in reasons
    assert out["bundles"].count() == 3


def test_random_critique_keeps_every_page(spark):
    import random

    def critic(reqs):
        return [("x" if random.random() < 0.5 else None, 1, 1) for _ in reqs]

    pages = spark.range(500).selectExpr("id as page_id", "concat('text ', id) as generated").repartition(4)
    out = G.refine(G.critique(pages, critic), lambda reqs: [("better", 1, 1) for _ in reqs])
    rows = out.collect()
    assert sorted(r.page_id for r in rows) == list(range(500))
    assert all((r.final == "better") == (r.critique == "x") == (r.refine_prompt_tokens == 1) for r in rows)


def test_failed_calls_are_contained(spark):
    def flaky(reqs):
        if any("bad" in r["user"] for r in reqs):
            raise RuntimeError("no answer")
        return [("fine", 2, 3) for _ in reqs]

    pages = spark.createDataFrame([(1, "t", "good"), (2, "t", "bad"), (3, "t", "good")], "page_id int, title string, main_text string")
    out = {r.page_id: r for r in G.generate(pages.coalesce(1), flaky).collect()}
    assert [out[k].generated for k in (1, 2, 3)] == ["fine", None, "fine"]
    assert out[2].prompt_tokens == 0 and "no answer" in out[2].generate_error and out[1].generate_error is None


def _words_model(folder, per_page):
    """Answers with as many tokens as the page's number says; one file per call."""
    def model(reqs):
        import os
        import uuid
        out = []
        for r in reqs:
            page = int(r["user"].split("page ")[1].split(" ")[0])
            assert r["max_tokens"] > 0
            open(os.path.join(folder, f"{page}-{uuid.uuid4().hex}"), "w").close()
            out.append((f"answer {page}", 10, per_page[page]))
        return out
    return model


def test_generation_stops_at_the_budget(spark, tmp_path):
    """Calls end at most two pages after the stop row, whatever the order and
    the sizes; what is kept is what the sequential model keeps."""
    import os
    import random

    from pagewright.operators.accounting import budget_cut
    rng = random.Random(3)
    pages = [(site, n, rng.randrange(3), f"page {n} {'text ' * rng.randrange(60)}")
             for site, base in (("big", 0), ("small", 1000), ("free", 2000), ("none", 3000)) for n in range(base, base + 60)]
    per_page = {n: rng.choice((0, 5, 400, 900)) for _, n, _, _ in pages}
    seeds = spark.createDataFrame([("big", 15000), ("small", 700), ("free", 10_000_000)], "site string, max_tokens long")
    df = spark.createDataFrame([(s, n, sc, f"t{n}", t) for s, n, sc, t in pages],
                               "site string, page_id long, score int, title string, main_text string")
    order = [("score", False), ("page_id", True)]
    got = G.generate_within_budget(df, seeds, order, _words_model(str(tmp_path), per_page))
    rows = {r.page_id: r for r in got.collect()}
    calls = [int(f.split("-")[0]) for f in os.listdir(tmp_path)]
    assert sorted(calls) == sorted(rows)                       # every page once, none twice
    for site, limit in (("big", 15000), ("small", 700), ("free", 10_000_000), ("none", 0)):
        queue = [n for _, n in sorted((-sc, n) for s, n, sc, _ in pages if s == site)]
        used, needed = 0, 0
        for n in queue:
            if used >= limit * fixed.STOP_FRACTION:
                break
            used, needed = used + 10 + per_page[n], needed + 1
        asked = [n for n in queue if n in rows]
        assert asked == queue[:len(asked)] and needed <= len(asked) <= (needed + 2 if needed else 0)
        kept = {r.page_id for r in budget_cut(got.select("site", "page_id", "score", (F.col("prompt_tokens") + F.col("completion_tokens"))
                                                        .alias("tokens")), seeds, order).where(F.col("site") == site).collect()}
        assert kept == set(queue[:needed])
    n_rounds = 1 + max(r["round"] for r in rows.values())
    assert n_rounds <= 1 + max(len([1 for x in rows.values() if x.site == s]) for s in ("big", "free")) / G.ROUND_PAGES
