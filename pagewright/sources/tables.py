"""A1: page sources. Pages arrive as a table; the live fetch is not built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls as U


def site_identity(url: Column | str, kind: str = "netloc") -> Column:
    """What makes pages one site: ``netloc`` (host with its port, the
    identity of a seed) or ``labels`` (the last two labels of the host, for
    tables that mix hosts of one owner; public suffixes such as co.uk or
    github.io make strangers one site, so it is never the default)."""
    if kind == "netloc":
        return F.lower(U.netloc(url))
    if kind == "labels":
        return U.site_of(url)
    raise ValueError(f"unknown site identity {kind!r}")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", site: str = "netloc") -> DataFrame:
    """``pages(site, page_id, url, html)`` from parquet/json/orc; ``site``
    is derived from the URL when the source has none."""
    df = spark.read.format(fmt).load(path)
    return df if "site" in df.columns else df.withColumn("site", site_identity("url", site))


def read_html_dir(spark: SparkSession, path: str, base_url: str | None = None) -> DataFrame:
    """A folder of HTML files, one page per file (whole-file text); every
    file gets a URL, so that its links resolve:

    * with ``base_url``: the base and the file's path below the folder (a saved
      copy of one site);
    * without: the first folder below ``path`` names the host, as mirroring
      tools save several sites; files that lie in ``path`` itself keep their
      file URL and the site ``file:``.

    ``index.html`` is the page of its folder."""
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = jp.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jp).toUri().getPath().rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    file_path = F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    below = F.substring(file_path, F.lit(len(root) + 2), F.length(file_path))
    page = F.regexp_replace(below, r"(^|/)index\.html?$", "$1")
    if base_url is not None:
        url = F.concat(F.lit(base_url if base_url.endswith("/") else base_url + "/"), page)
    else:
        url = F.when(below.contains("/"), F.concat(F.lit("https://"), page)).otherwise(F.concat(F.lit("file://"), file_path))
    rows = files.select(url.alias("url"), F.col("value").alias("html"))
    site = site_identity("url")
    return rows.select(F.when(site == "", "file:").otherwise(site).alias("site"), F.xxhash64("url").alias("page_id"), "url", "html")
