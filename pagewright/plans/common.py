"""Inputs and conventions shared by the registered queries.

Driver-table conventions (the tables carry no site column and no URL
matches the default rules):
* ``site`` = last two labels of the host;
* links resolve against their page's URL; the site is the domain;
* a test rule set (below) so that every rule fires on these tables;
* page order inside a site = (rule score of the page URL DESC, page_id,
  url), the corpus-mode canonical order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.functions import urls as U
from pagewright.operators import extract as X
from pagewright.operators import language as L
from pagewright.operators.links import Rule, link_score, link_type

# Rule set used by the registered queries over the driver tables.
TEST_RULES = [
    Rule("essential", ("/and", "/und"), 100, True),
    Rule("core_concepts", ("/que", "/der"), 80, True),
    Rule("features", ("ing", "tion"), 70, False),
    Rule("api", ("ent", ".net/"), 60, False),
]

PAGE_ORDER = [("score", False), ("page_id", True), ("url", True)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").withColumn("site", U.site_of("url"))


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """Extraction records, materialised once per query (they feed several
    branches: gates, links, coverage, code)."""
    return X.materialised(pages(spark, d))


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Language profile, materialised once per query (read by every gate)."""
    from pagewright.session import checkpoint, small_batches
    with small_batches(spark, X.BATCH_BYTES):
        return checkpoint(L.train_language(table(spark, d, "documents")))


def typed(df: DataFrame, rules=TEST_RULES) -> DataFrame:
    """Corpus mode: a page's type and score come from its own URL."""
    u = F.substring_index(F.col("url"), "#", 1)
    return df.withColumn("type", link_type(u, rules)).withColumn("score", link_score(u, rules))


def docs_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage rows from ``conversations``: one model call per turn; user and
    system turns are prompt tokens, assistant turns completion tokens."""
    from pagewright.functions.text import token_estimate
    c = table(spark, d, "conversations")
    t = token_estimate(F.col("text"))
    return c.select(
        F.col("conv_id").cast("string").alias("site"),
        F.col("conv_id").alias("page_id"),
        F.col("turn").alias("call_seq"),
        F.lit("generate").alias("stage"),
        F.lit(fixed.DEFAULT_MODEL).alias("model"),
        F.when(F.col("role").isin("user", "system"), t).otherwise(F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", t).otherwise(F.lit(0)).cast("bigint").alias("completion_tokens"))


def outline_model(requests: list[dict]) -> list[tuple]:
    """A deterministic model function for the registered queries: an outline
    page, a critique of every second text, and a refinement that adds examples.
    Its usage is a quarter of the characters of request and answer."""
    out = []
    for r in requests:
        user = r["user"]
        if r["system"] == fixed.SYSTEM_PROMPT:
            title, content = user[len("Title: "):].split("\n\nContent: ", 1)
            text = f"## {title}\n\n### Overview\n\n{content}"
        elif r["system"] == fixed.CRITIQUE_SYSTEM_PROMPT:
            content = user.split("\n\n", 1)[1]
            text = "Add examples." if len(content) % 2 else ""
        else:
            content = user.split("\n\n", 1)[1].rsplit("\n\nCritique:\n\n", 1)[0]
            text = f"{content}\n\n### Examples\n\nNone yet."
        out.append((text, len(user) // 4 + 1, len(text) // 4 + 1))
    return out


def relinked(spark: SparkSession, d: str, rules=TEST_RULES, ex: DataFrame | None = None) -> DataFrame:
    """A page table whose pages link to each other: inside a site, the k-th
    page takes the k-th distinct scored link of the site as its URL, and hrefs
    become the links they stand for. (site, page_id, url, hrefs, base_type)."""
    from pagewright.operators.links import page_links
    from pagewright.operators.order import rank_within
    ex = (extracted(spark, d) if ex is None else ex).select("site", "page_id", "url", "hrefs")
    links = page_links(ex, F.col("url"), F.col("site"), rules)
    targets = rank_within(links.select("site", F.col("url").alias("target")).distinct(), ["site"], [("target", True)], "k")
    numbered = rank_within(ex.select("site", "page_id", "url"), ["site"], [("page_id", True)], "k")
    hrefs = links.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("hrefs"))
    return (numbered.join(targets, ["site", "k"], "left").join(hrefs, "page_id", "left")
            .select("site", "page_id", F.coalesce("target", "url").alias("url"), F.coalesce("hrefs", F.array().cast("array<string>")).alias("hrefs")))
