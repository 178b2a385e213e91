"""Traversal of a stored corpus, all sites advancing together.

Which stored page links to which is found once, for all pages, and the
traversal then goes over page numbers only. The edges lie in buckets of their
source and the visited pages in append-only partitions by depth, so a round
reads the buckets that the frontier touches and writes what it found. The
number of rounds is the depth of the graph."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.links import page_links
from pagewright.session import scratch_dir, scratch_table

EDGE_BUCKETS = 256


def _pages_norm(gated: DataFrame) -> DataFrame:
    """(site, url, page_id, ok, hrefs, page_url) keyed by the page URL
    without its fragment; one page per URL (lowest page_id)."""
    g = gated.withColumn("url_norm", F.substring_index("url", "#", 1))
    first = g.groupBy("site", "url_norm").agg(F.min("page_id").alias("page_id"))
    return (g.join(first, ["site", "url_norm", "page_id"])
            .select("site", F.col("url_norm").alias("node"), "page_id", "url", "hrefs",
                    F.col("reason").isNull().alias("ok")))


def _bucket(node):
    return F.pmod(F.xxhash64(node), F.lit(EDGE_BUCKETS)).cast("int")


def page_edges(pages: DataFrame, rules) -> DataFrame:
    """(src, dst): stored pages that a successful page links to by a scored
    link, once each. ``pages`` as ``_pages_norm`` gives them."""
    links = page_links(pages.where("ok").select("site", "page_id", "url", "hrefs"), F.col("url"), F.col("site"), rules)
    stored = pages.select("site", F.col("node").alias("url"), F.col("page_id").alias("dst"))
    return links.select("site", "url", F.col("page_id").alias("src")).join(stored, ["site", "url"]).select("src", "dst").distinct()


def reachable(seeds: DataFrame, gated: DataFrame, rules, max_depth: int | None = None) -> DataFrame:
    """Pages reachable from each seed through scored links of
    successful pages, with their BFS depth. ``seeds(site, start_url)``.
    Runs until the frontier is empty, unless the caller sets a depth."""
    spark = gated.sparkSession
    pages = scratch_table(_pages_norm(gated), "crawl-pages")
    root = scratch_dir(spark, f"crawl-{uuid.uuid4().hex}")
    (page_edges(pages, rules).withColumn("bucket", _bucket("src")).repartition("bucket")
     .write.partitionBy("bucket").parquet(f"{root}/edges"))
    edges = spark.read.schema("src long, dst long, bucket int").parquet(f"{root}/edges")
    visited = spark.read.schema("id long, depth int")
    start = seeds.select("site", F.substring_index("start_url", "#", 1).alias("node")).distinct()
    found = pages.join(start, ["site", "node"]).select(F.col("page_id").alias("id"))
    for depth in itertools.count():
        path = f"{root}/visited/depth={depth}"
        found.write.parquet(path)
        new = spark.read.schema("id long").parquet(path)
        if depth == max_depth or new.limit(1).count() == 0:
            break
        # only the frontier's buckets are read: pruned by the frontier itself
        step = edges.join(new.select(F.col("id").alias("src"), _bucket("id").alias("bucket")), ["bucket", "src"])
        found = (step.select(F.col("dst").alias("id")).distinct()
                 .join(visited.parquet(f"{root}/visited").select("id"), "id", "left_anti"))
    at = visited.parquet(f"{root}/visited")
    return pages.join(at, pages["page_id"] == at["id"]).select("site", "page_id", F.col("node").alias("url"), "depth")
