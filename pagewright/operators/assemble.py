"""Ordered fragments per site and their sink.

A site's document is a set of ``fragments(site, part, rank, sub, text)``
rows whose order is (part, rank, sub); nothing is concatenated until the
optional one-row bundle. Writing range-partitions on (site, part, rank,
sub) and sorts within partitions, so a very large site spreads over several
ordered part files instead of one task."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.functions import markdown as MD
from pagewright.functions import text as T


def example_titles(examples: DataFrame, page_keys: list[str], order_col: str) -> DataFrame:
    """``Example`` when a page has one example, else ``Example i``."""
    w = Window.partitionBy(*page_keys).orderBy(order_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*page_keys))
    i = F.row_number().over(w)
    return examples.withColumn("title", F.when(n > 1, F.concat(F.lit("Example "), i.cast("string")))
                               .otherwise(F.lit("Example"))).withColumn("ex_no", i)


def section_headers(curated: DataFrame) -> DataFrame:
    """``header`` is true where the type differs from the previous row
    of the site. The previous row is found by an equi-join on (site,
    rank - 1) -- a unique key -- so no site is sorted in one task."""
    prev = curated.select("site", (F.col("rank") + 1).alias("rank"), F.col("type").alias("_prev_type"))
    return (curated.join(prev, ["site", "rank"], "left")
            .withColumn("header", F.col("_prev_type").isNull() | (F.col("_prev_type") != F.col("type")))
            .drop("_prev_type"))


def header_text(site_info: DataFrame, generated_at: str) -> DataFrame:
    """C18/F7 header block per site from ``(site, base_url, pages,
    total_tokens, total_cost)``."""
    nl = F.lit("\n")
    txt = F.concat(
        F.lit(fixed.BUNDLE_BANNER + "\n\n"), MD.format_title(F.lit(fixed.BUNDLE_TITLE)),
        F.lit("## Document Information\n\n| Metric | Value |\n|--------|-------|\n"),
        F.lit(f"| Generated | {generated_at} |"), nl,
        F.lit("| Source | "), F.col("base_url"), F.lit(" |"), nl,
        F.lit("| Pages | "), F.col("pages").cast("string"), F.lit(" |"), nl,
        F.lit("| Total Tokens | "), MD.thousands(F.col("total_tokens")), F.lit(" |"), nl,
        F.lit("| Cost | "), MD.cost_4dp(F.col("total_cost")), F.lit(" |\n\n"))
    return site_info.select("site", txt.alias("text"))


def fragments(curated: DataFrame, examples: DataFrame, site_info: DataFrame, generated_at: str) -> DataFrame:
    """Fragments of every site document.

    ``curated(site, page_id, rank, type, title, content)``,
    ``examples(site, page_id, ex_no, title, language, code)``."""
    hdr = header_text(site_info, generated_at).select(
        "site", F.lit(0).alias("part"), F.lit(0).alias("rank"), F.lit(0).alias("sub"), "text")
    contents = site_info.select("site", F.lit(1).alias("part"), F.lit(0).alias("rank"), F.lit(0).alias("sub"),
                                F.lit("## Contents\n\n").alias("text"))
    toc = curated.select("site", F.lit(2).alias("part"), "rank", F.lit(0).alias("sub"),
                         F.concat(MD.toc_entry(F.col("title")), F.lit("\n")).alias("text"))
    rule = site_info.select("site", F.lit(3).alias("part"), F.lit(0).alias("rank"), F.lit(0).alias("sub"),
                            F.lit("\n---\n\n").alias("text"))
    h = section_headers(curated)
    sec = h.where("header").select("site", F.lit(4).alias("part"), "rank", F.lit(0).alias("sub"),
                                   MD.format_section(T.py_title(F.col("type")), 2).alias("text"))
    ttl = curated.select("site", F.lit(4).alias("part"), "rank", F.lit(1).alias("sub"),
                         MD.format_section(F.col("title"), 3).alias("text"))
    body = curated.select("site", F.lit(4).alias("part"), "rank", F.lit(2).alias("sub"),
                          F.concat(F.col("content"), F.lit("\n\n")).alias("text"))
    ex = (examples.join(curated.select("site", "page_id", "rank"), ["site", "page_id"])
          .select("site", F.lit(4).alias("part"), "rank", (F.col("ex_no") + 2).alias("sub"),
                  MD.format_code_block(F.col("code"), F.col("language"), F.col("title")).alias("text")))
    end = curated.select("site", F.lit(4).alias("part"), "rank", F.lit(1_000_000).alias("sub"),
                         F.lit("---\n\n").alias("text"))
    out = hdr
    for part in (contents, toc, rule, sec, ttl, body, ex, end):
        out = out.unionByName(part)
    return out


def bundles(frags: DataFrame) -> DataFrame:
    """A5 one-row form: the site document as one string (bounded by the
    site's token budget, since only budgeted pages are curated)."""
    return (frags.groupBy("site")
            .agg(F.sort_array(F.collect_list(F.struct("part", "rank", "sub", "text"))).alias("_f"))
            .select("site", F.array_join(F.transform("_f", lambda x: x["text"]), "").alias("markdown")))


def write_bundles(frags: DataFrame, path: str, num_partitions: int | None = None) -> None:
    """A5 sink: one folder per site, text in (part, rank, sub) order."""
    n = num_partitions or frags.sparkSession.sparkContext.defaultParallelism
    (frags.repartitionByRange(n, "site", "part", "rank", "sub")
     .sortWithinPartitions("site", "part", "rank", "sub")
     # every fragment ends with a newline; the writer's line separator puts
     # it back, so the files hold the document byte for byte
     .select("site", F.regexp_replace("text", "\n\\z", "").alias("text"))
     .write.mode("overwrite").partitionBy("site").text(path))


def publish_bundles(frags: DataFrame, sites: DataFrame, path: str, num_partitions: int | None = None) -> str:
    """A5 sink with a manifest: a new version of the documents of all sites.

    The text lies in range partitions of (site, part, rank, sub), so a large
    site is several files; ``sites(site, base_url)`` names its document (C17).
    A version's rows and its manifest (site, name, file, position, rows) are
    written under a folder of their own, the manifest last: a version is there
    once its manifest is complete, and readers take the latest complete one, so
    a failed or repeated publication is never seen half. Returns the version."""
    spark = frags.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    (frags.repartitionByRange(n, "site", "part", "rank", "sub").sortWithinPartitions("site", "part", "rank", "sub")
     .withColumn("slice", F.spark_partition_id()).write.parquet(f"{path}/versions/{version}"))
    held = spark.read.parquet(f"{path}/versions/{version}")
    files = (held.groupBy("site", "slice").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))
             .join(sites.select("site", MD.bundle_name(F.col("base_url")).alias("name")), "site", "left"))
    files.write.parquet(f"{path}/manifests/{version}")
    return version


def latest_version(spark: SparkSession, path: str) -> str | None:
    """The last version whose manifest is complete."""
    jp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = jp.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jp):
        return None
    names = sorted((f.getPath().getName() for f in fs.listStatus(jp)), reverse=True)
    done = spark._jvm.org.apache.hadoop.fs.Path
    return next((v for v in names if fs.exists(done(f"{path}/manifests/{v}/_SUCCESS"))), None)


def read_bundles(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """(site, name, slice, markdown): the documents of a published version,
    one row per slice of a site; slices follow one another by number. Rows that
    the manifest doesn't count raise an error."""
    version = version or latest_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no published version under {path}")
    manifest = spark.read.parquet(f"{path}/manifests/{version}")
    rows = spark.read.parquet(f"{path}/versions/{version}")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "rank", "sub", "text"))), lambda x: x["text"]), "")
    slices = rows.groupBy("site", "slice").agg(text.alias("markdown"), F.count(F.lit(1)).alias("found"))
    wrong = F.raise_error(F.concat(F.lit("rows of the manifest are missing: "), F.col("site")))
    return (manifest.join(slices, ["site", "slice"], "left")
            .select("site", "name", "slice", F.when(F.col("found") == F.col("rows"), F.col("markdown"))
                    .otherwise(wrong).alias("markdown")))
