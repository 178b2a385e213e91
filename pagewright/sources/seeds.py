"""A2: seeds — one crawl budget per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.functions import urls as U


def seeds_from_pages(pages: DataFrame, max_tokens: int = fixed.DEFAULT_MAX_TOKENS) -> DataFrame:
    """``seeds(site, base_url, base_domain, max_tokens, n_pages)``: the base
    URL is scheme://host/ of the site's first page (by page_id). One row per
    site, built by an aggregate (no window over a site)."""
    first = F.min(F.struct(F.col("page_id"), F.concat(U.scheme("url"), F.lit("://"), U.netloc("url"),
                                                      F.lit("/")).alias("base")))
    return (pages.groupBy("site").agg(first.alias("f"), F.count(F.lit(1)).alias("n_pages"))
            .select("site", F.col("f.base").alias("base_url"), F.col("site").alias("base_domain"),
                    F.lit(max_tokens).alias("max_tokens"), "n_pages"))


def seeds_from_urls(spark, urls: list[str], max_tokens: int = fixed.DEFAULT_MAX_TOKENS) -> DataFrame:
    """Seeds from a list of start URLs: site = host of the URL."""
    df = spark.createDataFrame([(u,) for u in urls], "base_url string")
    return df.select(U.netloc("base_url").alias("site"), "base_url",
                     U.netloc("base_url").alias("base_domain"), F.lit(max_tokens).alias("max_tokens"))
