"""Links, scoring, frontier.

Rules are a small ordered list ``(section, patterns, score, required)``;
scoring folds them into one CASE chain (first matching rule wins), which
Catalyst evaluates inside whole-stage codegen. Link tables are keyed by
``site`` so every later join and window partitions by site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.functions import urls as U
from pagewright.operators.dedup import first_wins


@dataclass(frozen=True)
class Rule:
    section: str
    patterns: tuple[str, ...]
    score: int
    required: bool = False


def default_rules() -> list[Rule]:
    return [Rule(s, tuple(p), sc, r) for s, p, sc, r in fixed.DEFAULT_RULES]


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A3 as a table: ``(ord, section, patterns, score, required)``."""
    return spark.createDataFrame(
        [(i, r.section, list(r.patterns), r.score, r.required) for i, r in enumerate(rules)],
        "ord int, section string, patterns array<string>, score int, required boolean")


def _any_pattern(u: Column, patterns) -> Column:
    cond = F.lit(False)
    for p in patterns:
        cond = cond | u.contains(p)
    return cond


def link_type(url, rules: list[Rule]) -> Column:
    """C4: section of the first rule with a pattern inside lower(url)."""
    u = F.lower(F.col(url) if isinstance(url, str) else url)
    out = None
    for r in rules:
        c = _any_pattern(u, r.patterns)
        out = F.when(c, F.lit(r.section)) if out is None else out.when(c, F.lit(r.section))
    return out.otherwise(F.lit("other"))


def link_score(url, rules: list[Rule]) -> Column:
    u = F.lower(F.col(url) if isinstance(url, str) else url)
    out = None
    for r in rules:
        c = _any_pattern(u, r.patterns)
        out = F.when(c, F.lit(r.score)) if out is None else out.when(c, F.lit(r.score))
    return out.otherwise(F.lit(0))


def page_links(extracted: DataFrame, base: Column, domain: Column, rules: list[Rule],
               strict: bool = False, keep_unscored: bool = False) -> DataFrame:
    """B5 + C3 + C1/C2 + C4: one row per href of a page, in page order.

    ``base``/``domain`` are Columns of ``extracted`` (the site seed, or the
    page URL for page-relative resolution). Unscored links (score 0) are
    dropped unless ``keep_unscored``."""
    x = extracted.select("site", "page_id", F.col("url").alias("page_url"),
                         base.alias("_base"), domain.alias("_domain"),
                         F.posexplode("hrefs").alias("pos", "href"))
    x = x.where(~U.skip_href(F.col("href")))
    x = x.withColumn("url", U.normalize_url(F.col("href"), F.col("_base"), F.col("_domain"), strict))
    x = x.where(F.col("url").isNotNull() & F.col("url").contains(F.col("_domain")))
    x = x.withColumn("type", link_type("url", rules)).withColumn("score", link_score("url", rules))
    if not keep_unscored:
        x = x.where(F.col("score") > 0)
    return x.select("site", "page_id", "page_url", "pos", "href", "url", "type", "score")


def site_links(extracted: DataFrame, seeds: DataFrame, rules: list[Rule], resolve: str = "site",
               strict: bool = False, keep_unscored: bool = False) -> DataFrame:
    """``page_links`` against the seeds ``(site, base_url, base_domain)``:
    links resolve against the seed's URL (``resolve='site'``) or the page's own
    (``'page'``) and must lie in the seed's domain either way. Pages of sites
    without a seed have no links."""
    if resolve not in ("site", "page"):
        raise ValueError(f"unknown base {resolve!r}")
    own = extracted.join(seeds.select("site", "base_url", "base_domain"), "site")
    return page_links(own, F.col("base_url" if resolve == "site" else "url"), F.col("base_domain"), rules, strict, keep_unscored)


def section_coverage(typed_pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """per site and required section, whether any successful page has
    that type. ``typed_pages(site, type)``; sections are a tiny literal set
    joined by broadcast."""
    spark = typed_pages.sparkSession
    req = spark.createDataFrame([(r.section,) for r in rules if r.required], "section string")
    found = (typed_pages.groupBy("site", F.col("type").alias("section"))
             .agg(F.lit(True).alias("found")))
    sites = typed_pages.select("site").distinct()
    # sites x required sections: the required list is a handful of literals
    # known on the driver, so it is expanded as an array instead of a join
    grid = sites.select("site", F.explode(F.array(*[F.lit(r.section) for r in rules if r.required]))
                        .alias("section"))
    return (grid.join(found, ["site", "section"], "left")
            .select("site", "section", F.coalesce("found", F.lit(False)).alias("found")))


def boost_links(links: DataFrame, coverage: DataFrame, rules: list[Rule]) -> DataFrame:
    """+5 per required section not yet found whose pattern occurs in
    lower(url); boosts add up. The theta join against the few missing
    (site, section) rows is written as a CASE sum over the literal rule
    list plus an equi-join on site."""
    missing = (coverage.where(~F.col("found"))
               .groupBy("site").agg(F.collect_set("section").alias("_missing")))
    u = F.lower(F.col("url"))
    boost = F.lit(0)
    for r in rules:
        if r.required:
            hit = F.array_contains(F.col("_missing"), r.section) & _any_pattern(u, r.patterns)
            boost = boost + F.when(F.coalesce(hit, F.lit(False)), F.lit(fixed.BOOST_PER_SECTION)).otherwise(0)
    return (links.join(missing, "site", "left")
            .withColumn("boost", boost)
            .withColumn("boosted_score", F.col("score") + F.col("boost"))
            .drop("_missing"))


def url_dedup(links: DataFrame, id_col: str = "link_id") -> DataFrame:
    """One row per (site, url): the best score, then discovery order."""
    # deterministic id (recomputed identically after a lost executor)
    x = links if id_col in links.columns else links.withColumn(
        id_col, F.concat_ws(":", F.col("page_id").cast("string"), F.col("pos").cast("string")))
    return (first_wins(x, ["site"], F.col("url"), [("score", False), ("page_id", True), ("pos", True)],
                       id_col, "_f").where("_f").drop("_f"))


def frontier_new(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links whose URL was not visited yet (left anti join on site, url)."""
    return links.join(visited.select("site", "url"), ["site", "url"], "left_anti")


def link_resolution(links: DataFrame, pages_norm: DataFrame) -> DataFrame:
    """E5: does a link target a stored page? Left join on (site, url)."""
    stored = pages_norm.select("site", F.col("url_norm").alias("url"),
                               F.col("page_id").alias("target_page_id")).dropDuplicates(["site", "url"])
    return (links.join(stored, ["site", "url"], "left")
            .withColumn("resolved", F.col("target_page_id").isNotNull()))
