"""The whole curation plan over a page table, built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.operators import extract as X
from pagewright.operators import language as L


def gate_pages(extracted: DataFrame, profile: DataFrame, primary: str = fixed.PRIMARY_LANGUAGE) -> DataFrame:
    """A6 + B2 + C6: adds ``title`` and ``reason`` (NULL = eligible), in the
    order the checks happen: error, no_html, no_main, text_language,
    title_language (titles of 50+ characters only, min_length 10)."""
    t = extracted.withColumn("title", X.choose_title(F.col("title_candidates"), F.col("url")))
    g = L.language_gate(t, ["page_id"], "main_text", profile, primary=primary, out="text_ok")
    long_titles = g.where(F.length("title") >= fixed.TITLE_CHECK_MIN_CHARS).select("page_id", "title")
    tg = L.language_gate(long_titles, ["page_id"], "title", profile, primary=primary,
                         min_length=fixed.TITLE_MIN_LENGTH, out="title_ok").select("page_id", "title_ok")
    g = g.join(tg, "page_id", "left")
    reason = (F.when(F.col("error").isNotNull(), F.lit("error"))
              .when(~F.col("has_html"), F.lit("no_html"))
              .when(F.col("main_rule").isNull(), F.lit("no_main"))
              .when(~F.col("text_ok"), F.lit("text_language"))
              .when(F.coalesce(~F.col("title_ok"), F.lit(False)), F.lit("title_language")))
    return g.withColumn("reason", reason).drop("text_ok", "title_ok")


from pagewright.functions import code as CD  # noqa: E402
from pagewright.functions import text as T  # noqa: E402
from pagewright.operators import accounting as AC  # noqa: E402
from pagewright.operators import assemble as AS  # noqa: E402
from pagewright.operators import dedup as DD  # noqa: E402
from pagewright.operators import generate as G  # noqa: E402
from pagewright.operators.links import link_score, link_type  # noqa: E402
from pagewright.operators.order import rank_within  # noqa: E402
from pagewright.session import checkpoint  # noqa: E402

default_render = G.default_render

CANONICAL_ORDER = [("score", False), ("page_id", True), ("url", True)]


def curate(pages: DataFrame, seeds: DataFrame, rules, profile: DataFrame,
           generate_fn=None, check_generated: bool | None = None,
           critique_fn=None, refine_fn=None, generated_at: str = "1970-01-01 00:00:00",
           primary: str = fixed.PRIMARY_LANGUAGE) -> dict:
    """Corpus-mode curation of ``pages(site, page_id, url, html)``.

    Order inside a site: rule score of the page URL (DESC), page_id, url.
    Returns a dict of DataFrames: extracted, rejects, code_examples,
    usage, curated, fragments, bundles, funnel."""
    order = CANONICAL_ORDER
    if check_generated is None:
        check_generated = generate_fn is not None
    ex = X.materialised(pages)                              # the one Python stage, persisted
    profile = checkpoint(profile)                           # read by three gates
    u = F.substring_index(F.col("url"), "#", 1)
    # gates are read by generation, the budget, the funnel and code
    # selection: materialise the narrow gated table once
    gated = checkpoint(gate_pages(ex, profile, primary)
                       .withColumn("type", link_type(u, rules)).withColumn("score", link_score(u, rules))
                       .select("site", "page_id", "url", "type", "score", "title", "main_text", "reason"))
    eligible = gated.where(F.col("reason").isNull())

    asked = eligible.select("site", "page_id", "url", "type", "score", "title", "main_text")
    # a model is asked up to the budget only; the native renderer costs nothing
    gen = checkpoint(G.generate(asked)) if generate_fn is None else G.generate_within_budget(asked, seeds, order, generate_fn)
    # budget over all processed pages: rows before the per-site stop key
    ranked = (gated.select("site", "page_id", "url", "score")
              .join(gen.select("page_id", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens")),
                    "page_id", "left")
              .withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint")))
    processed = checkpoint(AC.budget_cut(ranked, seeds, order).select("page_id"))

    g2 = L.language_gate(gen, ["page_id"], "generated", profile, primary=primary, out="gen_ok")
    g2 = checkpoint(g2.join(processed, "page_id", "left_semi"))
    failed = F.col("generated").isNull()                    # the model call failed
    g2 = g2.withColumn("gen_ok", F.coalesce("gen_ok", F.lit(False)) & ~failed)
    passed = g2.where("gen_ok")
    t = checkpoint(DD.first_wins(passed, ["site"], T.title_key(F.col("title")), order, "page_id", "title_first"))
    pool_in = t.where("title_first")
    pooled = DD.pooled_dedup(pool_in, ["site"], "page_id", "main_text",
                             "generated" if check_generated else None, order)
    late = (g2.where(~F.col("gen_ok"))
            .select("page_id", F.when(failed, F.lit("error")).otherwise(F.lit("generated_language")).alias("late_reason"))
            .unionByName(t.where(~F.col("title_first")).select("page_id", F.lit("dup_title").alias("late_reason")))
            .unionByName(pooled.select("page_id", F.when(F.col("dup_content"), F.lit("dup_content"))
                                       .when(F.col("dup_generated"), F.lit("dup_generated")).alias("late_reason"))))
    all_reasons = (gated.join(processed, "page_id", "left_semi")
                   .join(late, "page_id", "left")
                   .withColumn("reason", F.coalesce("reason", "late_reason")).drop("late_reason"))
    rejects = all_reasons.where(F.col("reason").isNotNull()).select("site", "page_id", "url", "reason")

    pooled = checkpoint(pooled)
    kept = pooled.where(~F.col("dup_content") & ~F.col("dup_generated"))
    # code examples: eligible, processed pages; language filter, then site-wide first-wins
    blocks = (X.code_blocks(ex).join(eligible.select("page_id", "type", "score"), "page_id")
              .join(processed, "page_id", "left_semi")
              .withColumn("language", CD.code_language(F.col("classes"), F.col("code")))
              .where(CD.is_kept_language(F.col("language")))
              .withColumn("block_id", F.concat_ws(":", F.col("page_id").cast("string"), F.col("pos").cast("string"))))
    blocks = DD.first_wins(blocks, ["site"], T.key_hash(CD.normalize_code(F.col("code"))),
                           order + [("sel_ord", True), ("doc_ord", True)], "block_id", "first")
    code_examples = blocks.where("first").select("site", "page_id", "sel_ord", "doc_ord", "language", "code")

    # critique / refine (not budget-checked), then section de-duplication
    crit = G.critique(kept.select("site", "page_id", "url", "type", "score", "title", "generated"), critique_fn)
    ref = checkpoint(G.refine(crit, refine_fn))
    final = DD.first_wins(ref, ["site"], F.concat_ws("\u0000", F.col("type"), T.title_key(F.col("title"))),
                          order, "page_id", "section_first").where("section_first")
    ranks = rank_within(final.select("site", "score", "page_id", "url"), ["site"], order).select("page_id", "rank")
    curated = checkpoint(final.join(ranks, "page_id")
                         .select("site", "page_id", "url", "rank", "type", "score", "title",
                                 F.col("final").alias("content")))

    model = F.lit(fixed.DEFAULT_MODEL)
    # calls past the stop are paid, too (at most two a site)
    paid = gen.join(processed, "page_id", "left_semi") if generate_fn is None else gen
    usage = (paid
             .select("site", "page_id", F.lit("generate").alias("stage"), model.alias("model"),
                     "prompt_tokens", "completion_tokens")
             .unionByName(ref.select("site", "page_id", F.lit("critique").alias("stage"), model.alias("model"),
                                     F.col("critique_prompt_tokens").alias("prompt_tokens"),
                                     F.col("critique_completion_tokens").alias("completion_tokens")))
             .unionByName(ref.select("site", "page_id", F.lit("refine").alias("stage"), model.alias("model"),
                                     F.col("refine_prompt_tokens").alias("prompt_tokens"),
                                     F.col("refine_completion_tokens").alias("completion_tokens"))))
    rates = AC.rates_frame(pages.sparkSession)
    summary = AC.usage_summary(usage, rates)
    header = AC.usage_summary(usage.where("stage = 'generate'"), rates)     # the header is written before critique
    info = (seeds.select("site", "base_url")
            .join(curated.groupBy("site").agg(F.count(F.lit(1)).alias("pages")), "site", "left")
            .join(header, "site", "left")
            .select("site", "base_url", F.coalesce("pages", F.lit(0)).alias("pages"),
                    F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
                    F.coalesce("total_cost", F.lit(0.0)).alias("total_cost")))
    ex_rows = AS.example_titles(code_examples, ["site", "page_id"], F.struct("sel_ord", "doc_ord"))
    frags = AS.fragments(curated, ex_rows.select("site", "page_id", "ex_no", "title", "language", "code"),
                         info, generated_at)
    funnel = rejects.groupBy("site", "reason").agg(F.count(F.lit(1)).alias("pages"))
    return dict(extracted=ex, gated=gated, rejects=rejects, code_examples=code_examples, usage=usage,
                summary=summary, curated=curated, fragments=frags, bundles=AS.bundles(frags), funnel=funnel)
