"""Registered queries: name -> (Spark plan builder, DuckDB oracle or None).

Every builder takes ``(spark, sf_dir)`` and reads the driver tables whole.
Oracles are single DuckDB statements over the same tables; a ``None``
oracle marks an operator checked by row counts here and by brute force in
the tests (iterative resolution, grouped recurrences, streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.functions import code as CD
from pagewright.functions import markdown as MD
from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import extract as X
from pagewright.operators import language as L
from pagewright.operators import links as LK
from pagewright.plans import common as C
from pagewright.plans import sqlfrag as S

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# SQL building blocks over the driver tables
# ---------------------------------------------------------------------------

def _sql_pages() -> str:
    return f"SELECT page_id, url, html, {S.site('url')} AS site FROM pages"


def _sql_extracted() -> str:
    return (f"SELECT page_id, url, site, html, "
            f"CASE WHEN html IS NULL OR html = '' THEN NULL "
            f"WHEN regexp_matches(html, '<main[\\s>]') THEN 1 "
            f"WHEN regexp_matches(html, '<article[\\s>]') THEN 2 END AS main_rule, "
            f"{S.main_text('html')} AS main_text, {S.choose_title('html', 'url')} AS title, "
            f"{S.hrefs('html')} AS hrefs FROM ({_sql_pages()})")


def _sql_sample(x: str) -> str:
    return f"substr(lower({S.strip(x)}), 1, {fixed.LANGUAGE_SAMPLE_CHARS})"


def _sql_grams(s: str) -> str:
    """Trigrams of an already materialised sample column ``s``."""
    return (f"CASE WHEN length({s}) >= 3 THEN list_transform(range(1, length({s}) - 1), "
            f"lambda i: substr({s}, i, 3)) ELSE []::VARCHAR[] END")


def _sql_char_grams(c: str) -> str:
    """Trigrams of a materialised character list ``c`` (linear: list
    indexing instead of substr per position)."""
    return (f"CASE WHEN len({c}) >= 3 THEN list_transform(range(1, len({c}) - 1), "
            f"lambda i: {c}[i] || {c}[i + 1] || {c}[i + 2]) ELSE []::VARCHAR[] END")


def _sql_profile_ctes() -> str:
    return (f"prof AS (SELECT lang, gram, count(*) AS cnt FROM (SELECT lang, unnest({_sql_char_grams('c')}) AS gram "
            f"FROM (SELECT lang, string_split(lower({S.strip('text')}), '') AS c FROM documents WHERE lang IS NOT NULL)) "
            f"GROUP BY lang, gram), "
            f"vocab AS (SELECT count(DISTINCT gram) AS v FROM prof), "
            f"tot AS (SELECT lang, ln(sum(cnt) + (SELECT v FROM vocab)) AS log_den FROM prof GROUP BY lang)")


def _sql_classify(src: str, key: str, txt: str, whole: bool = False) -> str:
    """Best language per key of ``src(key, txt)`` (rows without a known
    trigram are absent), from the gate's sample or the whole text."""
    if whole:
        chars = f"SELECT {key} AS key, string_split(lower({S.strip(txt)}), '') AS c FROM {src}"
        return (f"(SELECT key, lang FROM (SELECT sc.key, sc.lang, row_number() OVER (PARTITION BY sc.key "
                f"ORDER BY sc.s - nd.n_doc * tot.log_den DESC, sc.lang) AS rn FROM "
                f"(SELECT dg.key, p.lang, sum(dg.k * ln(p.cnt + 1)) AS s FROM "
                f"(SELECT key, gram, count(*) AS k FROM (SELECT key, unnest({_sql_char_grams('c')}) AS gram FROM ({chars})) GROUP BY key, gram) dg "
                f"JOIN prof p ON p.gram = dg.gram GROUP BY dg.key, p.lang) sc "
                f"JOIN (SELECT key, greatest(len(c) - 2, 0) AS n_doc FROM ({chars})) nd ON nd.key = sc.key JOIN tot ON tot.lang = sc.lang) WHERE rn = 1)")
    return (f"(SELECT key, lang FROM (SELECT sc.key, sc.lang, row_number() OVER (PARTITION BY sc.key "
            f"ORDER BY sc.s - nd.n_doc * tot.log_den DESC, sc.lang) AS rn FROM "
            f"(SELECT dg.key, p.lang, sum(dg.k * ln(p.cnt + 1)) AS s FROM "
            f"(SELECT key, gram, count(*) AS k FROM (SELECT key, unnest({_sql_grams('s')}) AS gram FROM "
            f"(SELECT {key} AS key, {_sql_sample(txt)} AS s FROM {src})) GROUP BY key, gram) dg JOIN prof p ON p.gram = dg.gram GROUP BY dg.key, p.lang) sc "
            f"JOIN (SELECT {key} AS key, greatest(length({_sql_sample(txt)}) - 2, 0) AS n_doc FROM {src}) nd ON nd.key = sc.key JOIN tot ON tot.lang = sc.lang) WHERE rn = 1)")


def _sql_gate(txt: str, pred: str, min_length: int) -> str:
    cleaned = f"lower({S.strip(txt)})"
    common = " OR ".join(f"contains({cleaned}, {S.q(w)})" for w in fixed.COMMON_ENGLISH_WORDS)
    return (f"({txt} IS NULL OR {common} OR length({cleaned}) < {min_length} OR {pred} IS NULL "
            f"OR {pred} = {S.q(fixed.PRIMARY_LANGUAGE)})")


# ---------------------------------------------------------------------------
# A. sources
# ---------------------------------------------------------------------------

@register("page_source_stats", f"""
SELECT site, count(*) AS pages, count(*) FILTER (WHERE html IS NOT NULL AND html <> '') AS with_html,
       sum(length(html))::BIGINT AS html_chars, count(DISTINCT {S.netloc('url')}) AS hosts
FROM ({_sql_pages()}) GROUP BY site""")
def page_source_stats(spark: SparkSession, d: str) -> DataFrame:
    p = C.pages(spark, d)
    return p.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when((F.col("html").isNotNull()) & (F.col("html") != ""), 1)).alias("with_html"),
        F.sum(F.length("html")).cast("bigint").alias("html_chars"),
        F.countDistinct(U.netloc("url")).alias("hosts"))


@register("site_seeds", f"""
SELECT site, base_url, site AS base_domain, {fixed.DEFAULT_MAX_TOKENS} AS max_tokens, n_pages FROM (
  SELECT site, arg_min(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) || '://' || {S.netloc('url')} || '/', page_id) AS base_url,
         count(*) AS n_pages
  FROM ({_sql_pages()}) GROUP BY site)""")
def site_seeds(spark: SparkSession, d: str) -> DataFrame:
    from pagewright.sources.seeds import seeds_from_pages
    return seeds_from_pages(C.pages(spark, d))


# ---------------------------------------------------------------------------
# B. extraction
# ---------------------------------------------------------------------------

@register("page_extract", f"""
SELECT page_id, site, main_rule, title, len(hrefs) AS n_hrefs, 0 AS n_code,
       length(main_text) AS main_chars, md5(main_text) AS main_md5
FROM ({_sql_extracted()})""")
def page_extract(spark: SparkSession, d: str) -> DataFrame:
    ex = C.extracted(spark, d)
    return ex.select("page_id", "site", "main_rule",
                     X.choose_title(F.col("title_candidates"), F.col("url")).alias("title"),
                     F.size("hrefs").alias("n_hrefs"),
                     F.size(F.filter("code", lambda b: F.length(b["code"]) >= fixed.MIN_CODE_CHARS)).alias("n_code"),
                     F.length("main_text").alias("main_chars"), F.md5("main_text").alias("main_md5"))


@register("main_content_rule", f"SELECT page_id, main_rule FROM ({_sql_extracted()})")
def main_content_rule(spark, d):
    return C.extracted(spark, d).select("page_id", "main_rule")


@register("main_text", f"SELECT page_id, main_text FROM ({_sql_extracted()})")
def main_text(spark, d):
    return C.extracted(spark, d).select("page_id", "main_text")


@register("page_title", f"SELECT page_id, title FROM ({_sql_extracted()})")
def page_title(spark, d):
    ex = C.extracted(spark, d)
    return ex.select("page_id", X.choose_title(F.col("title_candidates"), F.col("url")).alias("title"))


@register("page_links", f"""
SELECT site, page_id, pos, href FROM (
  SELECT site, page_id, unnest(hrefs) AS href, unnest(range(0, len(hrefs))) AS pos FROM ({_sql_extracted()}))
WHERE NOT {S.skip_href('href')}""")
def page_links(spark, d):
    ex = C.extracted(spark, d)
    return (ex.select("site", "page_id", F.posexplode("hrefs").alias("pos", "href"))
            .where(~U.skip_href(F.col("href"))))


@register("code_blocks_raw")
def code_blocks_raw(spark, d):
    return X.code_blocks(C.extracted(spark, d)).select("site", "page_id", "sel_ord", "doc_ord", "code")


# ---------------------------------------------------------------------------
# C. scalar functions
# ---------------------------------------------------------------------------

def _sql_links(keep_unscored: bool = False, strict: bool = False) -> str:
    joined = S.join_url("page_url", "cut")
    host = f"lower(regexp_replace(regexp_replace({S.netloc('j')}, '^.*@', ''), ':[0-9]*$', ''))"
    ok = (f"({host} = site OR ends_with({host}, '.' || site))" if strict
          else f"contains({S.netloc('j')}, site)")
    base = (f"SELECT site, page_id, page_url, pos, href, j AS url, "
            f"{S.rule_case('j', C.TEST_RULES, 'type')} AS type, {S.rule_case('j', C.TEST_RULES, 'score')} AS score "
            f"FROM (SELECT *, {joined} AS j FROM (SELECT *, split_part(href, '#', 1) AS cut FROM "
            f"(SELECT site, page_id, url AS page_url, unnest(hrefs) AS href, unnest(range(0, len(hrefs))) AS pos "
            f"FROM ({_sql_extracted()})) WHERE NOT {S.skip_href('href')})) "
            f"WHERE cut <> '' AND {ok}")
    return base if keep_unscored else f"SELECT * FROM ({base}) WHERE score > 0"


def _links(spark, d, keep_unscored=False, strict=False, ex=None):
    ex = C.extracted(spark, d) if ex is None else ex
    return LK.page_links(ex, F.col("url"), F.col("site"), C.TEST_RULES, strict=strict,
                         keep_unscored=keep_unscored)


@register("normalize_url", f"SELECT site, page_id, pos, href, url FROM ({_sql_links(True)})")
def normalize_url(spark, d):
    return _links(spark, d, keep_unscored=True).select("site", "page_id", "pos", "href", "url")


@register("in_domain_links", f"""
SELECT a.site, a.page_id, a.pos, a.url, b.url IS NOT NULL AS strict_ok
FROM ({_sql_links(True)}) a LEFT JOIN ({_sql_links(True, True)}) b USING (site, page_id, pos)""")
def in_domain_links(spark, d):
    ex = C.extracted(spark, d)
    a = _links(spark, d, keep_unscored=True, ex=ex)
    b = _links(spark, d, keep_unscored=True, strict=True, ex=ex).select("site", "page_id", "pos", F.lit(True).alias("_s"))
    return (a.join(b, ["site", "page_id", "pos"], "left")
            .select("site", "page_id", "pos", "url", F.coalesce("_s", F.lit(False)).alias("strict_ok")))


@register("scored_links", f"SELECT site, page_id, pos, url, type, score FROM ({_sql_links()})")
def scored_links(spark, d):
    return _links(spark, d).select("site", "page_id", "pos", "url", "type", "score")


_SQL_SITE_LINKS = f"""
SELECT site, page_id, pos, j AS url, {S.rule_case('j', C.TEST_RULES, 'type')} AS type, {S.rule_case('j', C.TEST_RULES, 'score')} AS score
FROM (SELECT *, {S.join_url('base_url', 'cut')} AS j FROM (
  SELECT e.site, e.page_id, s.base_url, unnest(e.hrefs) AS href, unnest(range(0, len(e.hrefs))) AS pos, split_part(href, '#', 1) AS cut
  FROM ({_sql_extracted()}) e JOIN ({ORACLES['site_seeds']}) s ON s.site = e.site) WHERE NOT {S.skip_href('href')})
WHERE cut <> '' AND contains({S.netloc('j')}, site)"""


@register("site_links", f"SELECT * FROM ({_SQL_SITE_LINKS}) WHERE score > 0")
def site_links(spark, d):
    """C1-C4 as the reference resolves: against the base URL of the seed."""
    return (LK.site_links(C.extracted(spark, d), site_seeds(spark, d), C.TEST_RULES)
            .select("site", "page_id", "pos", "url", "type", "score"))


@register("lang_profile", f"WITH {_sql_profile_ctes()} SELECT lang, gram, cnt FROM prof")
def lang_profile(spark, d):
    return C.profile(spark, d).select("lang", "gram", "cnt")


@register("lang_classify", f"""
WITH {_sql_profile_ctes()}, ex AS ({_sql_extracted()})
SELECT ex.page_id, c.lang AS lang_pred FROM ex LEFT JOIN {_sql_classify('ex', 'page_id', 'main_text', whole=True)} c
ON c.key = ex.page_id""")
def lang_classify(spark, d):
    ex = C.extracted(spark, d).select("page_id", "main_text")
    return L.classify_language(ex, ["page_id"], "main_text", C.profile(spark, d)).select("page_id", "lang_pred")


@register("language_gate", f"""
WITH {_sql_profile_ctes()}, ex AS ({_sql_extracted()})
SELECT ex.page_id, {_sql_gate('ex.main_text', 'c.lang', fixed.LANGUAGE_MIN_LENGTH)} AS lang_ok
FROM ex LEFT JOIN {_sql_classify('ex', 'page_id', 'main_text')} c ON c.key = ex.page_id""")
def language_gate(spark, d):
    ex = C.extracted(spark, d).select("page_id", "main_text")
    return L.language_gate(ex, ["page_id"], "main_text", C.profile(spark, d)).select("page_id", "lang_ok")


def _sql_eligible() -> str:
    return (f"WITH {_sql_profile_ctes()}, ex AS ({_sql_extracted()}), "
            f"tl AS (SELECT page_id, title FROM ex WHERE length(title) >= {fixed.TITLE_CHECK_MIN_CHARS}) "
            f"SELECT ex.site, ex.page_id, ex.url, ex.title, ex.main_text, "
            f"CASE WHEN ex.html IS NULL OR ex.html = '' THEN 'no_html' WHEN ex.main_rule IS NULL THEN 'no_main' "
            f"WHEN NOT {_sql_gate('ex.main_text', 'c.lang', fixed.LANGUAGE_MIN_LENGTH)} THEN 'text_language' "
            f"WHEN length(ex.title) >= {fixed.TITLE_CHECK_MIN_CHARS} AND NOT "
            f"{_sql_gate('ex.title', 'ct.lang', fixed.TITLE_MIN_LENGTH)} THEN 'title_language' END AS reason "
            f"FROM ex LEFT JOIN {_sql_classify('ex', 'page_id', 'main_text')} c ON c.key = ex.page_id "
            f"LEFT JOIN {_sql_classify('tl', 'page_id', 'title')} ct ON ct.key = ex.page_id")


@register("eligible_pages", f"SELECT site, page_id, title, reason FROM ({_sql_eligible()})")
def eligible_pages(spark, d):
    from pagewright.plans.curate import gate_pages
    g = gate_pages(C.extracted(spark, d), C.profile(spark, d))
    return g.select("site", "page_id", "title", "reason")


@register("code_language", f"""
SELECT doc_id, lang AS language, lang IN ({', '.join(S.q(x) for x in fixed.KEPT_CODE_LANGUAGES)}) AS kept FROM (
  SELECT doc_id, CASE {' '.join(f"WHEN lang0 IN ({', '.join(S.q(n) for n in names)}) THEN {S.q(main)}" for main, names in fixed.LANGUAGE_ALIASES)} ELSE lang0 END AS lang
  FROM (SELECT doc_id, CASE {' '.join("WHEN " + ' OR '.join(f"contains(text, {S.q(p)})" for p in pats) + f" THEN {S.q(lang)}" for lang, pats in fixed.CONTENT_HINTS)} ELSE '' END AS lang0
        FROM documents))""")
def code_language(spark, d):
    docs = C.table(spark, d, "documents")
    lang = CD.code_language(F.array().cast("array<string>"), F.col("text"))
    return docs.select("doc_id", lang.alias("language"), CD.is_kept_language(lang).alias("kept"))


def _sql_norm_code(x: str) -> str:
    lines = f"regexp_split_to_array({x}, '\\r\\n|[\\n\\r\\x0B\\f\\x{{1C}}\\x{{1D}}\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    keep = " AND ".join(f"NOT starts_with(l, {S.q(p)})" for p in fixed.CODE_COMMENT_PREFIXES)
    clean = "l"
    for dl in fixed.CODE_DELETIONS:
        clean = f"replace({clean}, {S.q(dl)}, '')"
    return (f"array_to_string(list_transform(list_filter(list_transform({lines}, lambda l: {S.strip('l')}), "
            f"lambda l: length(l) > 0 AND {keep}), lambda l: {clean}), chr(10))")


@register("code_normalized", f"""
SELECT doc_id, md5({_sql_norm_code('text')}) AS norm_md5, length({_sql_norm_code('text')}) AS norm_chars FROM documents""")
def code_normalized(spark, d):
    docs = C.table(spark, d, "documents")
    n = CD.normalize_code(F.col("text"))
    return docs.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_chars"))


@register("content_key", f"""
SELECT doc_id, md5(lower({S.strip('text')})) AS key_md5, len({S.word_set('text')}) AS n_words FROM documents""")
def content_key(spark, d):
    docs = C.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.content_key(F.col("text"))).alias("key_md5"),
                       F.size(T.word_set(F.col("text"))).alias("n_words"))


@register("title_key", f"SELECT page_id, lower({S.strip('title')}) AS title_key FROM ({_sql_extracted()})")
def title_key(spark, d):
    ex = C.extracted(spark, d)
    return ex.select("page_id", T.title_key(X.choose_title(F.col("title_candidates"), F.col("url"))).alias("title_key"))


@register("slug_title", f"SELECT page_id, {S.slug('url')} AS slug_title FROM pages")
def slug_title(spark, d):
    return C.table(spark, d, "pages").select("page_id", T.slug_title(F.col("url")).alias("slug_title"))


@register("token_counts", f"SELECT doc_id, {S.tokens('text')} AS tokens_est FROM documents")
def token_counts(spark, d):
    return C.table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens_est"))


@register("toc_entries", f"""
SELECT page_id, '- [' || translate(title, '[]', '') || '](#' || replace(lower(translate(title, '[]', '')), ' ', '-') || ')' AS toc
FROM ({_sql_extracted()})""")
def toc_entries(spark, d):
    ex = C.extracted(spark, d)
    return ex.select("page_id", MD.toc_entry(X.choose_title(F.col("title_candidates"), F.col("url"))).alias("toc"))


@register("md_format", f"""
SELECT page_id, '### ' || title || chr(10) || chr(10) AS section_md,
       '**Example**' || chr(10) || chr(10) || '```python' || chr(10) || {S.strip('title')} || chr(10) || '```' || chr(10) AS code_md,
       '> **Note:** ' || title || chr(10) || chr(10) AS note_md
FROM ({_sql_extracted()})""")
def md_format(spark, d):
    ex = C.extracted(spark, d)
    t = X.choose_title(F.col("title_candidates"), F.col("url"))
    return ex.select("page_id", MD.format_section(t, 3).alias("section_md"),
                     MD.format_code_block(t, F.lit("python"), F.lit("Example")).alias("code_md"),
                     MD.format_note(t).alias("note_md"))


@register("md_warning_installation", f"""
SELECT doc_id, md5('> ⚠️ **Warning:** ' || text || chr(10) || chr(10)) AS warning_md5,
  md5('### Installation' || chr(10) || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)),
    lambda s, i: i || '. ' || s || chr(10)), chr(10)) || chr(10)) AS installation_md5 FROM documents""")
def md_warning_installation(spark, d):
    """The warning and the installation formatter (a text's lines are
    the steps)."""
    docs = C.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(MD.format_warning(F.col("text"))).alias("warning_md5"),
                       F.md5(MD.format_installation(F.split("text", "\n", -1))).alias("installation_md5"))


@register("bundle_name", f"""
SELECT site, regexp_extract(base_url, '^[^/]*//([^/]*)', 1) || '{fixed.BUNDLE_SUFFIX}' AS bundle_name FROM ({ORACLES['site_seeds']})""")
def bundle_name(spark, d):
    return site_seeds(spark, d).select("site", MD.bundle_name(F.col("base_url")).alias("bundle_name"))


# ---------------------------------------------------------------------------
# D. de-duplication
# ---------------------------------------------------------------------------

from pagewright.operators import accounting as AC  # noqa: E402
from pagewright.operators import dedup as DD  # noqa: E402

_PAGE_ORDER_SQL = "score DESC, page_id, url"


def _sql_typed_eligible() -> str:
    u = "split_part(url, '#', 1)"
    return (f"SELECT *, {S.rule_case(u, C.TEST_RULES, 'type')} AS type, {S.rule_case(u, C.TEST_RULES, 'score')} AS score "
            f"FROM ({_sql_eligible()}) WHERE reason IS NULL")


def _eligible_typed(spark, d, ex=None):
    from pagewright.plans.curate import gate_pages
    g = gate_pages(C.extracted(spark, d) if ex is None else ex, C.profile(spark, d)).where(F.col("reason").isNull())
    return C.typed(g)


@register("title_dedup", f"""
SELECT site, page_id, title, row_number() OVER (PARTITION BY site, lower({S.strip('title')}) ORDER BY {_PAGE_ORDER_SQL}) = 1 AS kept
FROM ({_sql_typed_eligible()})""")
def title_dedup(spark, d):
    e = _eligible_typed(spark, d)
    return (DD.first_wins(e, ["site"], T.title_key(F.col("title")), C.PAGE_ORDER, "page_id", "kept")
            .select("site", "page_id", "title", "kept"))


@register("section_dedup", f"""
SELECT site, page_id, type, row_number() OVER (PARTITION BY site, type, lower({S.strip('title')}) ORDER BY {_PAGE_ORDER_SQL}) = 1 AS kept
FROM ({_sql_typed_eligible()})""")
def section_dedup(spark, d):
    e = _eligible_typed(spark, d)
    key = F.concat_ws("\u0000", F.col("type"), T.title_key(F.col("title")))
    return DD.first_wins(e, ["site"], key, C.PAGE_ORDER, "page_id", "kept").select("site", "page_id", "type", "kept")


@register("exact_dedup", f"""
SELECT doc_id, row_number() OVER (PARTITION BY lower({S.strip('text')}) ORDER BY doc_id) = 1 AS kept FROM documents""")
def exact_dedup(spark, d):
    docs = C.table(spark, d, "documents")
    return (DD.first_wins(docs, [], T.key_hash(T.content_key(F.col("text"))), [("doc_id", True)], "doc_id", "kept")
            .select("doc_id", "kept"))


_SQL_SETS = f"SELECT doc_id, list_sort({S.word_set('text')}) AS ws FROM documents"
_SQL_PAIRS = f"""
WITH w AS (SELECT doc_id, {S.word_set('text')} AS ws FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS n FROM w WHERE len(ws) > 0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.ws, b.ws)) AS inter, a.n AS na, b.n AS nb
      FROM n a JOIN n b ON a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {DD.PCT} * greatest(a.n, b.n))
SELECT a, b, inter, na + nb - inter AS uni, inter::DOUBLE / (na + nb - inter)::DOUBLE AS jaccard
FROM p WHERE 100 * inter > {DD.PCT} * (na + nb - inter)"""


@register("near_dup_pairs", _SQL_PAIRS)
def near_dup_pairs(spark, d):
    """All pairs of documents. Different sets, named by a hash, are joined once,
    and their pairs are expanded to all documents that have the sets."""
    docs = C.table(spark, d, "documents").select("doc_id", "text")
    return (DD.near_dup_pairs(docs, [], "doc_id", "text", [("doc_id", True)], materialized=True)
            .select("a", "b", "inter", "uni", "jaccard"))


@register("near_dup_members", f"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY ws) AS representative FROM ({_SQL_SETS}) WHERE len(ws) > 0""")
def near_dup_members(spark, d):
    return (DD.representatives(C.table(spark, d, "documents"), [], "doc_id", "text", [("doc_id", True)])
            .select(F.col("id").alias("doc_id"), "representative"))


# Sequential model: visit documents in doc_id order carrying the list of kept
# ids; a document is dropped when an earlier kept document has the same
# content key or a word-set Jaccard above 0.85.
_SQL_FUZZY = f"""
WITH RECURSIVE
w AS MATERIALIZED (SELECT doc_id, lower({S.strip('text')}) AS k, {S.word_set('text')} AS ws FROM documents),
n AS MATERIALIZED (SELECT doc_id, k, ws, len(ws) AS n, row_number() OVER (ORDER BY doc_id) AS idx,
             row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1 AS first_of_key FROM w),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.doc_id < b.doc_id AND a.k = b.k
      UNION
      SELECT a.doc_id, b.doc_id FROM n a JOIN n b ON a.doc_id < b.doc_id AND a.n > 0 AND b.n > 0
        AND 100 * least(a.n, b.n) >= {DD.PCT} * greatest(a.n, b.n)
        AND 100 * len(list_intersect(a.ws, b.ws)) > {DD.PCT} * (a.n + b.n - len(list_intersect(a.ws, b.ws)))),
r(idx, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT r.idx + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b = n.doc_id AND list_contains(r.kept, e.a))
                         THEN r.kept ELSE list_append(r.kept, n.doc_id) END
  FROM r JOIN n ON n.idx = r.idx + 1),
fin AS (SELECT kept FROM r ORDER BY idx DESC LIMIT 1)
SELECT n.doc_id, NOT n.first_of_key AS dup_exact,
       n.first_of_key AND NOT list_contains((SELECT kept FROM fin), n.doc_id) AS dup_fuzzy,
       list_contains((SELECT kept FROM fin), n.doc_id) AS kept
FROM n"""


@register("fuzzy_dedup", _SQL_FUZZY)
def fuzzy_dedup(spark, d):
    docs = C.table(spark, d, "documents").select("doc_id", "text")
    out = DD.fuzzy_dedup(docs, [], "doc_id", "text", [("doc_id", True)], materialized=True)
    return out.select("doc_id", "dup_exact", "dup_fuzzy",
                      (~F.col("dup_exact") & ~F.col("dup_fuzzy")).alias("kept"))


@register("code_dedup", f"""
SELECT source, doc_id, row_number() OVER (PARTITION BY source, {_sql_norm_code('text')} ORDER BY doc_id) = 1 AS kept
FROM documents""")
def code_dedup(spark, d):
    docs = C.table(spark, d, "documents")
    return (DD.first_wins(docs, ["source"], T.key_hash(CD.normalize_code(F.col("text"))), [("doc_id", True)],
                          "doc_id", "kept").select("source", "doc_id", "kept"))


# Sequential model of the shared pool per site, pages in canonical order:
# the raw node is checked against the kept nodes; if kept it joins the pool
# and the generated node is checked against the pool, its own raw included.
_SQL_POOLED = f"""
WITH RECURSIVE
p AS MATERIALIZED (SELECT site, page_id, main_text AS raw, '## ' || title || chr(10) || chr(10) || main_text || chr(10) AS gen,
                          row_number() OVER (PARTITION BY site ORDER BY {_PAGE_ORDER_SQL}) AS idx
                   FROM ({_sql_typed_eligible()})),
nodes AS MATERIALIZED (SELECT site, page_id, idx, 0 AS kind, raw AS txt FROM p
                       UNION ALL SELECT site, page_id, idx, 1 AS kind, gen AS txt FROM p),
nw AS MATERIALIZED (SELECT site, idx, kind, page_id * 2 + kind AS nid, lower({S.strip('txt')}) AS k,
                           {S.word_set('txt')} AS ws, len({S.word_set('txt')}) AS n FROM nodes),
e AS MATERIALIZED (SELECT a.nid AS a, b.nid AS b FROM nw a JOIN nw b ON a.site = b.site
                     AND (a.idx < b.idx OR (a.idx = b.idx AND a.kind < b.kind))
                     AND (a.k = b.k OR (a.n > 0 AND b.n > 0 AND 100 * least(a.n, b.n) >= {DD.PCT} * greatest(a.n, b.n)
                          AND 100 * len(list_intersect(a.ws, b.ws)) > {DD.PCT} * (a.n + b.n - len(list_intersect(a.ws, b.ws)))))),
r(site, idx, kept, dc, dg) AS (
  SELECT DISTINCT site, 0::BIGINT, []::BIGINT[], false, false FROM p
  UNION ALL
  SELECT r.site, r.idx + 1,
    CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b = p.page_id * 2 AND list_contains(r.kept, e.a)) THEN r.kept
         WHEN EXISTS (SELECT 1 FROM e WHERE e.b = p.page_id * 2 + 1 AND list_contains(list_append(r.kept, p.page_id * 2), e.a))
         THEN list_append(r.kept, p.page_id * 2)
         ELSE list_append(list_append(r.kept, p.page_id * 2), p.page_id * 2 + 1) END,
    EXISTS (SELECT 1 FROM e WHERE e.b = p.page_id * 2 AND list_contains(r.kept, e.a)),
    NOT EXISTS (SELECT 1 FROM e WHERE e.b = p.page_id * 2 AND list_contains(r.kept, e.a))
      AND EXISTS (SELECT 1 FROM e WHERE e.b = p.page_id * 2 + 1 AND list_contains(list_append(r.kept, p.page_id * 2), e.a))
  FROM r JOIN p ON p.site = r.site AND p.idx = r.idx + 1)
SELECT p.site, p.page_id, r.dc AS dup_content, r.dg AS dup_generated
FROM p JOIN r ON r.site = p.site AND r.idx = p.idx"""


@register("pooled_dedup", _SQL_POOLED)
def pooled_dedup(spark, d):
    from pagewright.plans.curate import default_render
    e = _eligible_typed(spark, d)
    e = e.withColumn("generated", default_render(F.col("title"), F.col("main_text")))
    out = DD.pooled_dedup(e, ["site"], "page_id", "main_text", "generated", C.PAGE_ORDER)
    return out.select("site", "page_id", "dup_content", "dup_generated")


# ---------------------------------------------------------------------------
# E / T / H. links, frontier
# ---------------------------------------------------------------------------

def _sql_visited() -> str:
    return f"SELECT DISTINCT site, split_part(url, '#', 1) AS url FROM ({_sql_pages()})"


def _visited(spark, d):
    return C.pages(spark, d).select("site", F.substring_index("url", "#", 1).alias("url")).distinct()


@register("url_dedup", f"""
SELECT site, url, page_id, pos, score FROM (
  SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY score DESC, page_id, pos) AS rn FROM ({_sql_links()}))
WHERE rn = 1""")
def url_dedup(spark, d):
    return LK.url_dedup(_links(spark, d)).select("site", "url", "page_id", "pos", "score")


@register("frontier_new", f"""
SELECT site, page_id, pos, url FROM ({_sql_links()}) l WHERE NOT EXISTS (
  SELECT 1 FROM ({_sql_visited()}) v WHERE v.site = l.site AND v.url = l.url)""")
def frontier_new(spark, d):
    return LK.frontier_new(_links(spark, d), _visited(spark, d)).select("site", "page_id", "pos", "url")


@register("link_resolution", f"""
SELECT l.site, l.page_id, l.pos, l.url, t.target_page_id, t.target_page_id IS NOT NULL AS resolved
FROM ({_sql_links()}) l LEFT JOIN (SELECT site, split_part(url, '#', 1) AS url, min(page_id) AS target_page_id
  FROM ({_sql_pages()}) GROUP BY ALL) t ON t.site = l.site AND t.url = l.url""")
def link_resolution(spark, d):
    pn = C.pages(spark, d).select("site", "page_id", F.substring_index("url", "#", 1).alias("url_norm"))
    pn = pn.groupBy("site", "url_norm").agg(F.min("page_id").alias("page_id"))
    return LK.link_resolution(_links(spark, d), pn).select("site", "page_id", "pos", "url", "target_page_id", "resolved")


def _sql_coverage() -> str:
    req = [r for r in C.TEST_RULES if r.required]
    grid = " UNION ALL ".join(f"SELECT site, {S.q(r.section)} AS section FROM (SELECT DISTINCT site FROM ({_sql_typed_eligible()}))" for r in req)
    return (f"SELECT g.site, g.section, coalesce(f.found, false) AS found FROM ({grid}) g LEFT JOIN "
            f"(SELECT DISTINCT site, type AS section, true AS found FROM ({_sql_typed_eligible()})) f "
            f"ON f.site = g.site AND f.section = g.section")


def _coverage(spark, d, ex=None):
    return LK.section_coverage(_eligible_typed(spark, d, ex).select("site", "type"), C.TEST_RULES)


@register("section_coverage", _sql_coverage())
def section_coverage(spark, d):
    return _coverage(spark, d)


def _sql_boosted() -> str:
    parts = []
    for r in C.TEST_RULES:
        if r.required:
            pat = " OR ".join(f"contains(lower(l.url), {S.q(p)})" for p in r.patterns)
            parts.append(f"CASE WHEN EXISTS (SELECT 1 FROM cov WHERE cov.site = l.site AND cov.section = {S.q(r.section)} "
                         f"AND NOT cov.found) AND ({pat}) THEN {fixed.BOOST_PER_SECTION} ELSE 0 END")
    boost = " + ".join(parts) if parts else "0"
    return (f"WITH cov AS ({_sql_coverage()}) SELECT l.site, l.page_id, l.pos, l.url, l.score, {boost} AS boost, "
            f"l.score + {boost} AS boosted_score FROM ({_sql_links()}) l")


@register("boosted_links", _sql_boosted())
def boosted_links(spark, d):
    ex = C.extracted(spark, d)
    b = LK.boost_links(_links(spark, d, ex=ex), _coverage(spark, d, ex), C.TEST_RULES)
    return b.select("site", "page_id", "pos", "url", "score", "boost", "boosted_score")


def _frontier(spark, d):
    """Unvisited, boosted, URL-deduplicated links of every site."""
    ex = C.extracted(spark, d)
    b = LK.boost_links(_links(spark, d, ex=ex), _coverage(spark, d, ex), C.TEST_RULES)
    b = b.withColumn("score", F.col("boosted_score"))
    return LK.url_dedup(LK.frontier_new(b, _visited(spark, d)))


def _sql_frontier() -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY boosted_score DESC, page_id, pos) AS rn0 "
            f"FROM ({_sql_boosted()}) l WHERE NOT EXISTS (SELECT 1 FROM ({_sql_visited()}) v WHERE v.site = l.site AND v.url = l.url)) "
            f"WHERE rn0 = 1")


@register("frontier_rank", f"""
SELECT site, url, boosted_score, row_number() OVER (PARTITION BY site ORDER BY boosted_score DESC, page_id, pos) AS rank
FROM ({_sql_frontier()})""")
def frontier_rank(spark, d):
    from pagewright.operators.order import rank_within
    f = _frontier(spark, d).select("site", "url", "boosted_score", "page_id", "pos")
    r = rank_within(f, ["site"], [("boosted_score", False), ("page_id", True), ("pos", True)])
    return r.select("site", "url", "boosted_score", "rank")


@register("frontier_topk", f"""
SELECT site, url, boosted_score FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY boosted_score DESC, page_id, pos) AS rk
FROM ({_sql_frontier()})) WHERE rk <= {fixed.MAX_BATCH}""")
def frontier_topk(spark, d):
    from pyspark.sql import Window
    f = _frontier(spark, d)
    w = Window.partitionBy("site").orderBy(F.col("boosted_score").desc(), "page_id", "pos")
    return (f.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= fixed.MAX_BATCH)
            .select("site", "url", "boosted_score"))


@register("frontier_extend", f"""
SELECT DISTINCT site, url FROM (SELECT site, url FROM ({_sql_visited()}) UNION ALL SELECT site, url FROM ({_sql_frontier()}))""")
def frontier_extend(spark, d):
    return _visited(spark, d).unionByName(_frontier(spark, d).select("site", "url")).distinct()


# ---------------------------------------------------------------------------
# F / G. usage, cost, budget
# ---------------------------------------------------------------------------

def _sql_usage() -> str:
    t = S.tokens("text")
    return (f"SELECT CAST(conv_id AS VARCHAR) AS site, conv_id AS page_id, turn AS call_seq, "
            f"CASE WHEN role IN ('user', 'system') THEN {t} ELSE 0 END::BIGINT AS prompt_tokens, "
            f"CASE WHEN role = 'assistant' THEN {t} ELSE 0 END::BIGINT AS completion_tokens FROM conversations")


@register("usage_cost", f"""
SELECT site, call_seq, prompt_tokens, completion_tokens, prompt_tokens * {S.RATE_IN} AS input_cost,
       completion_tokens * {S.RATE_OUT} AS output_cost,
       prompt_tokens * {S.RATE_IN} + completion_tokens * {S.RATE_OUT} AS total_cost FROM ({_sql_usage()})""")
def usage_cost(spark, d):
    u = C.docs_usage(spark, d)
    return AC.price_usage(u, AC.rates_frame(spark)).select(
        "site", "call_seq", "prompt_tokens", "completion_tokens", "input_cost", "output_cost", "total_cost")


@register("usage_summary", f"""
SELECT site, sum(prompt_tokens)::BIGINT AS input_tokens, sum(completion_tokens)::BIGINT AS output_tokens,
       (sum(prompt_tokens) + sum(completion_tokens))::BIGINT AS total_tokens,
       sum(prompt_tokens) * {S.RATE_IN} + sum(completion_tokens) * {S.RATE_OUT} AS total_cost
FROM ({_sql_usage()}) GROUP BY site""")
def usage_summary(spark, d):
    u = C.docs_usage(spark, d)
    return AC.usage_summary(u, AC.rates_frame(spark)).select(
        "site", "input_tokens", "output_tokens", "total_tokens", "total_cost")


def _ranked_docs(spark, d):
    docs = C.table(spark, d, "documents")
    return docs.select(F.col("source").alias("site"), F.col("doc_id").alias("rank"),
                       T.token_estimate(F.col("text")).alias("tokens"), F.lit(True).alias("ok"))


def _doc_seeds(spark, d):
    return (C.table(spark, d, "documents").select(F.col("source").alias("site")).distinct()
            .withColumn("max_tokens", F.lit(fixed.DEFAULT_MAX_TOKENS)))


_LIMIT = fixed.DEFAULT_MAX_TOKENS * fixed.STOP_FRACTION
_SQL_RANKED_DOCS = f"SELECT source AS site, doc_id AS rank, {S.tokens('text')} AS tokens FROM documents"
_SQL_KEPT = (f"SELECT site, rank, tokens, used_before FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY site ORDER BY rank "
             f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM ({_SQL_RANKED_DOCS})) "
             f"WHERE used_before < {_LIMIT}")


@register("budget_cut", f"SELECT site, rank, tokens FROM ({_SQL_KEPT})")
def budget_cut(spark, d):
    return AC.budget_cut(_ranked_docs(spark, d), _doc_seeds(spark, d), [("rank", True)]).select("site", "rank", "tokens")


@register("capacity_warnings", f"""
SELECT site, rank, used_before, 1 - used_before / {fixed.DEFAULT_MAX_TOKENS} AS remaining,
       1 - used_before / {fixed.DEFAULT_MAX_TOKENS} <= {fixed.WARNING_REMAINING} AS warning FROM ({_SQL_KEPT})""")
def capacity_warnings(spark, d):
    kept = AC.budget_cut(_ranked_docs(spark, d), _doc_seeds(spark, d), [("rank", True)])
    return AC.running_usage(kept, _doc_seeds(spark, d), [("rank", True)]).select(
        "site", "rank", "used_before", "remaining", "warning")


# Sequential model of the adaptive batches over prefix sums: each step takes
# b = max(1, min(3, int((max - used) / max(used / max(1, oks), 1000)))) rows
# while used < 0.98 * max.
_MX = float(fixed.DEFAULT_MAX_TOKENS)
_SQL_BATCHES = f"""
WITH RECURSIVE
rk AS MATERIALIZED (SELECT site, rank, tokens, row_number() OVER (PARTITION BY site ORDER BY rank) AS i FROM ({_SQL_RANKED_DOCS})),
cum AS MATERIALIZED (SELECT site, i, sum(tokens) OVER (PARTITION BY site ORDER BY i) AS c, i AS okc,
               count(*) OVER (PARTITION BY site) AS nrows FROM rk),
st(site, prev, pos, used, oks, batch_no, nrows) AS (
  SELECT site, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, max(nrows) FROM cum GROUP BY site
  UNION ALL
  SELECT st.site, st.pos, c2.i, c2.c, c2.okc, st.batch_no + 1, st.nrows FROM st JOIN cum c2
    ON c2.site = st.site AND c2.i = least(st.nrows, st.pos + greatest(1, least({fixed.MAX_BATCH},
       floor(({_MX} - st.used) / greatest(st.used::DOUBLE / greatest(1, st.oks), {float(fixed.MIN_TOKENS_PER_PAGE)})))))
  WHERE st.used < {_LIMIT} AND st.pos < st.nrows)
SELECT rk.site, rk.rank, st.batch_no, st.batch_no IS NOT NULL AS included
FROM rk LEFT JOIN (SELECT * FROM st WHERE batch_no > 0) st ON st.site = rk.site AND rk.i > st.prev AND rk.i <= st.pos"""


@register("budget_batches", _SQL_BATCHES)
def budget_batches(spark, d):
    return AC.budget_batches(_ranked_docs(spark, d), _doc_seeds(spark, d), [("rank", True)])


@register("progress_report", f"""
SELECT site, count(*) AS pages, count(*) AS successes, sum(tokens)::BIGINT AS tokens,
       round(100.0 * sum(tokens) / {fixed.DEFAULT_MAX_TOKENS}, 1) AS pct_of_limit,
       ({fixed.DEFAULT_MAX_TOKENS} - sum(tokens))::BIGINT AS remaining,
       sum(tokens) / greatest(1, count(*)) AS avg_tokens_per_page FROM ({_SQL_KEPT}) GROUP BY site""")
def progress_report(spark, d):
    kept = AC.budget_cut(_ranked_docs(spark, d), _doc_seeds(spark, d), [("rank", True)])
    return AC.progress_report(kept, _doc_seeds(spark, d)).select(
        "site", "pages", "successes", "tokens", "pct_of_limit", "remaining", "avg_tokens_per_page")


@register("example_titles", """
SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1
  THEN 'Example ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) ELSE 'Example' END AS title
FROM conversations WHERE role = 'assistant'""")
def example_titles(spark, d):
    from pagewright.operators.assemble import example_titles as ex_titles
    c = C.table(spark, d, "conversations").where(F.col("role") == "assistant")
    return ex_titles(c, ["conv_id"], "turn").select("conv_id", "turn", "title")


@register("code_language_counts", f"""
SELECT source, language, count(*) AS n FROM ({ORACLES['code_language']}) c JOIN documents USING (doc_id)
WHERE kept GROUP BY ALL""")
def code_language_counts(spark, d):
    docs = C.table(spark, d, "documents")
    lang = CD.code_language(F.array().cast("array<string>"), F.col("text"))
    return (docs.select("source", lang.alias("language")).where(CD.is_kept_language(F.col("language")))
            .groupBy("source", "language").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# J. generation (default native renderer), H1, G5, C18/F7 over title-kept pages
# ---------------------------------------------------------------------------

from pagewright.operators import generate as GN  # noqa: E402

_SYS_TOKENS = S.tokens(S.q(fixed.SYSTEM_PROMPT))
_SQL_PROMPT = "'Title: ' || title || chr(10) || chr(10) || 'Content: ' || main_text"
_SQL_RENDER = "'## ' || title || chr(10) || chr(10) || main_text || chr(10)"


@register("prompt_table", f"""
SELECT page_id, md5({_SQL_PROMPT}) AS prompt_md5, {fixed.GENERATE_TEMPERATURE} AS temperature,
       {_SYS_TOKENS} + {S.tokens(_SQL_PROMPT)} AS prompt_tokens_est
FROM ({_sql_eligible()}) WHERE reason IS NULL""")
def prompt_table(spark, d):
    p = GN.prompts(_eligible_typed(spark, d))
    return p.select("page_id", F.md5("user_prompt").alias("prompt_md5"), "temperature", "prompt_tokens_est")


@register("cost_forecast", f"""
SELECT site, sum(t)::BIGINT AS prompt_tokens_est, sum(t) * {S.RATE_IN} AS forecast_cost FROM (
  SELECT site, {_SYS_TOKENS} + {S.tokens(_SQL_PROMPT)} AS t FROM ({_sql_eligible()}) WHERE reason IS NULL) GROUP BY site""")
def cost_forecast(spark, d):
    p = GN.prompts(_eligible_typed(spark, d))
    return (p.groupBy("site").agg(F.sum("prompt_tokens_est").cast("bigint").alias("prompt_tokens_est"))
            .withColumn("forecast_cost", F.col("prompt_tokens_est") * fixed.MODEL_RATES[0][1]))


@register("generated_docs", f"""
SELECT page_id, md5({_SQL_RENDER}) AS generated_md5, {_SYS_TOKENS} + {S.tokens(_SQL_PROMPT)} AS prompt_tokens,
       {S.tokens(_SQL_RENDER)} AS completion_tokens
FROM ({_sql_eligible()}) WHERE reason IS NULL""")
def generated_docs(spark, d):
    g = GN.generate(_eligible_typed(spark, d))
    return g.select("page_id", F.md5("generated").alias("generated_md5"), "prompt_tokens", "completion_tokens")


_NL2 = "chr(10) || chr(10)"
_SQL_OUTLINE = f"'## ' || title || {_NL2} || '### Overview' || {_NL2} || main_text"
_SQL_OUTLINE_IN = f"length({_SQL_PROMPT}) // 4 + 1"
_SQL_OUTLINE_OUT = f"length({_SQL_OUTLINE}) // 4 + 1"


@register("generated_within_budget", f"""
SELECT site, page_id, md5(g) AS generated_md5, p_tok AS prompt_tokens, c_tok AS completion_tokens FROM (
  SELECT *, coalesce(sum(p_tok + c_tok) OVER (PARTITION BY site ORDER BY {_PAGE_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before
  FROM (SELECT *, {_SQL_OUTLINE} AS g, {_SQL_OUTLINE_IN} AS p_tok, {_SQL_OUTLINE_OUT} AS c_tok FROM ({_sql_typed_eligible()})))
WHERE used_before < {_LIMIT}""")
def generated_within_budget(spark, d):
    """J2 with a model function that is asked up to the budget of each site."""
    pages = _eligible_typed(spark, d).select("site", "page_id", "url", "score", "title", "main_text")
    seeds = pages.select("site").distinct().withColumn("max_tokens", F.lit(fixed.DEFAULT_MAX_TOKENS))
    got = GN.generate_within_budget(pages, seeds, C.PAGE_ORDER, C.outline_model)
    used = got.select("site", "page_id", "url", "score", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    kept = AC.budget_cut(used, seeds, C.PAGE_ORDER).select("page_id")
    return (got.join(kept, "page_id", "left_semi")
            .select("site", "page_id", F.md5("generated").alias("generated_md5"), "prompt_tokens", "completion_tokens"))


@register("model_critiques", f"""
SELECT page_id, CASE WHEN length(g) % 2 = 1 THEN 'Add examples.' ELSE '' END AS critique,
       (length('Please analyze and critique this documentation:' || {_NL2} || g)) // 4 + 1 AS critique_prompt_tokens,
       CASE WHEN length(g) % 2 = 1 THEN length('Add examples.') // 4 + 1 ELSE 1 END AS critique_completion_tokens
FROM (SELECT page_id, {_SQL_OUTLINE} AS g FROM ({_sql_typed_eligible()}))""")
def model_critiques(spark, d):
    """J3 with a model function over every generated page."""
    pages = _eligible_typed(spark, d).select("page_id", "title", "main_text")
    made = GN.generate(pages, C.outline_model).select("page_id", "generated")
    return (GN.critique(made, C.outline_model)
            .select("page_id", "critique", "critique_prompt_tokens", "critique_completion_tokens"))


def _sql_audit(m: str) -> str:
    checks = [("missing_h2", f"NOT regexp_matches({m}, '(?m)^## ')"),
              ("missing_h3", f"NOT regexp_matches({m}, '(?m)^### ')")]
    for h in fixed.AUDIT_HEADINGS:
        name = "missing_" + h.lstrip("# ").lower().replace(" ", "_")
        checks.append((name, f"NOT contains({m}, {S.q(h)})"))
    checks.append(("fence_without_language",
                   f"len(list_filter(list_filter(regexp_extract_all({m}, '(?m)^```(.*)$', 1), lambda x, i: i % 2 = 1), "
                   f"lambda x: {S.strip('x')} = '')) > 0"))
    checks.append(("raw_html", f"regexp_matches({m}, '<(div|span|p|br|table|img|a)[\\s>/]')"))
    arr = ", ".join(f"CASE WHEN {c} THEN {S.q(n)} END" for n, c in checks)
    return f"list_filter([{arr}], lambda x: x IS NOT NULL)"


@register("markdown_audit", f"""
SELECT page_id, {_sql_audit('g')} AS violations FROM (SELECT page_id, {_SQL_RENDER} AS g FROM ({_sql_eligible()}) WHERE reason IS NULL)""")
def markdown_audit(spark, d):
    from pagewright.functions.markdown import audit_markdown
    g = GN.generate(_eligible_typed(spark, d))
    return g.select("page_id", audit_markdown(F.col("generated")).alias("violations"))


_SQL_TITLE_KEPT = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, lower({S.strip('title')}) "
                   f"ORDER BY {_PAGE_ORDER_SQL}) AS tk FROM ({_sql_typed_eligible()})) WHERE tk = 1")


def _title_kept(spark, d):
    e = _eligible_typed(spark, d)
    return DD.keep_first(e, ["site"], T.title_key(F.col("title")), C.PAGE_ORDER, "page_id")


@register("curated_order", f"""
SELECT site, page_id, type, score, row_number() OVER (PARTITION BY site ORDER BY {_PAGE_ORDER_SQL}) AS rank FROM ({_SQL_TITLE_KEPT})""")
def curated_order(spark, d):
    from pagewright.operators.order import rank_within
    k = _title_kept(spark, d).select("site", "page_id", "type", "score", "url")
    return rank_within(k, ["site"], C.PAGE_ORDER).select("site", "page_id", "type", "score", "rank")


@register("section_headers", f"""
SELECT site, page_id, rank, (lag(type) OVER (PARTITION BY site ORDER BY rank)) IS DISTINCT FROM type AS header FROM (
  SELECT site, page_id, type, row_number() OVER (PARTITION BY site ORDER BY {_PAGE_ORDER_SQL}) AS rank FROM ({_SQL_TITLE_KEPT}))""")
def section_headers(spark, d):
    from pagewright.operators.assemble import section_headers as sh
    return sh(curated_order(spark, d)).select("site", "page_id", "rank", "header")


GENERATED_AT = "1970-01-01 00:00:00"


@register("bundle_header", f"""
WITH k AS (SELECT site, {_SYS_TOKENS} + {S.tokens(_SQL_PROMPT)} AS p, {S.tokens(_SQL_RENDER)} AS c FROM ({_SQL_TITLE_KEPT})),
a AS (SELECT site, count(*) AS pages, sum(p) AS pt, sum(c) AS ct FROM k GROUP BY site),
s AS ({ORACLES['site_seeds']})
SELECT s.site, '{fixed.BUNDLE_BANNER}' || chr(10) || chr(10) || '# {fixed.BUNDLE_TITLE}' || chr(10) || chr(10)
  || '## Document Information' || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|--------|-------|' || chr(10)
  || '| Generated | {GENERATED_AT} |' || chr(10) || '| Source | ' || s.base_url || ' |' || chr(10)
  || '| Pages | ' || coalesce(a.pages, 0) || ' |' || chr(10)
  || '| Total Tokens | ' || format('{{:,}}', coalesce(a.pt + a.ct, 0)) || ' |' || chr(10)
  || '| Cost | $' || printf('%.4f', coalesce(a.pt * {S.RATE_IN} + a.ct * {S.RATE_OUT}, 0.0)) || ' |' || chr(10) || chr(10) AS header
FROM s LEFT JOIN a USING (site)""")
def bundle_header(spark, d):
    from pagewright.operators.assemble import header_text
    g = GN.generate(_title_kept(spark, d))
    usage = g.select("site", F.lit(fixed.DEFAULT_MODEL).alias("model"), "prompt_tokens", "completion_tokens")
    summ = AC.usage_summary(usage, AC.rates_frame(spark))
    pages_n = g.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    info = (site_seeds(spark, d).select("site", "base_url").join(pages_n, "site", "left").join(summ, "site", "left")
            .select("site", "base_url", F.coalesce("pages", F.lit(0)).alias("pages"),
                    F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
                    F.coalesce("total_cost", F.lit(0.0)).alias("total_cost")))
    return header_text(info, GENERATED_AT).withColumnRenamed("text", "header")


# ---------------------------------------------------------------------------
# whole plan (rows-only checks; covered by tests against sequential models)
# ---------------------------------------------------------------------------

def _curate(spark, d, model=None):
    from pagewright.plans.curate import curate
    from pagewright.sources.seeds import seeds_from_pages
    p = C.pages(spark, d)
    return curate(p, seeds_from_pages(p), C.TEST_RULES, C.profile(spark, d), model, False if model else None, model, model,
                  generated_at=GENERATED_AT)


def _sql_curate(select: str, render: str = _SQL_RENDER, p_tok: str = f"{_SYS_TOKENS} + {S.tokens(_SQL_PROMPT)}",
                c_tok: str = S.tokens("generated"), content: str = "generated") -> str:
    """The whole corpus-mode plan as one statement: gates, rendered pages,
    per-site budget over processed pages, generated-text gate, title
    first-wins, a sequential greedy content pool per site (recursive CTE),
    section first-wins. ``select`` reads the CTEs; the other arguments are the
    generated text, its usage and the refined text."""
    u = "split_part(url, '#', 1)"
    order = _PAGE_ORDER_SQL
    return f"""
WITH RECURSIVE {_sql_profile_ctes()},
g AS MATERIALIZED (SELECT site, page_id, url, title, main_text, reason,
    {S.rule_case(u, C.TEST_RULES, 'type')} AS type, {S.rule_case(u, C.TEST_RULES, 'score')} AS score,
    CASE WHEN reason IS NULL THEN {render} END AS generated FROM ({_sql_eligible()})),
gt AS MATERIALIZED (SELECT *, CASE WHEN reason IS NULL THEN {p_tok} ELSE 0 END AS p_tok,
    CASE WHEN reason IS NULL THEN {c_tok} ELSE 0 END AS c_tok FROM g),
proc AS MATERIALIZED (SELECT * FROM (SELECT *, coalesce(sum(p_tok + c_tok) OVER (PARTITION BY site ORDER BY {order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM gt) WHERE used_before < {_LIMIT}),
el AS MATERIALIZED (SELECT * FROM proc WHERE reason IS NULL),
g2 AS MATERIALIZED (SELECT el.*, {_sql_gate('el.generated', 'cg.lang', fixed.LANGUAGE_MIN_LENGTH)} AS gen_ok
    FROM el LEFT JOIN {_sql_classify('el', 'page_id', 'generated')} cg ON cg.key = el.page_id),
tk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site, lower({S.strip('title')}) ORDER BY {order}) = 1 AS title_first
    FROM g2 WHERE gen_ok),
pool AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {order}) AS idx,
    lower({S.strip('main_text')}) AS k, {S.word_set('main_text')} AS ws, len({S.word_set('main_text')}) AS n
    FROM tk WHERE title_first),
pe AS MATERIALIZED (SELECT a.page_id AS a, b.page_id AS b FROM pool a JOIN pool b ON a.site = b.site AND a.idx < b.idx
    AND (a.k = b.k OR (a.n > 0 AND b.n > 0 AND 100 * least(a.n, b.n) >= {DD.PCT} * greatest(a.n, b.n)
         AND 100 * len(list_intersect(a.ws, b.ws)) > {DD.PCT} * (a.n + b.n - len(list_intersect(a.ws, b.ws)))))),
r(site, idx, kept, dc) AS (
  SELECT DISTINCT site, 0::BIGINT, []::BIGINT[], false FROM pool
  UNION ALL
  SELECT r.site, r.idx + 1,
    CASE WHEN EXISTS (SELECT 1 FROM pe WHERE pe.b = pool.page_id AND list_contains(r.kept, pe.a)) THEN r.kept
         ELSE list_append(r.kept, pool.page_id) END,
    EXISTS (SELECT 1 FROM pe WHERE pe.b = pool.page_id AND list_contains(r.kept, pe.a))
  FROM r JOIN pool ON pool.site = r.site AND pool.idx = r.idx + 1),
pooled AS MATERIALIZED (SELECT pool.*, r.dc AS dup_content FROM pool JOIN r ON r.site = pool.site AND r.idx = pool.idx),
kept AS MATERIALIZED (SELECT * FROM pooled WHERE NOT dup_content),
fin AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, type, lower({S.strip('title')})
    ORDER BY {order}) AS sf FROM kept) WHERE sf = 1),
cur AS MATERIALIZED (SELECT site, page_id, url, row_number() OVER (PARTITION BY site ORDER BY {order}) AS rank,
    type, score, title, {content} AS content FROM fin),
rej AS MATERIALIZED (SELECT proc.site, proc.page_id, proc.url, coalesce(proc.reason,
    CASE WHEN NOT g2.gen_ok THEN 'generated_language' WHEN NOT tk.title_first THEN 'dup_title'
         WHEN pooled.dup_content THEN 'dup_content' END) AS reason
    FROM proc LEFT JOIN g2 ON g2.page_id = proc.page_id LEFT JOIN tk ON tk.page_id = proc.page_id
    LEFT JOIN pooled ON pooled.page_id = proc.page_id)
{select}"""


@register("curated_docs", _sql_curate(
    "SELECT site, page_id, rank, type, score, title, md5(content) AS content_md5 FROM cur"))
def curated_docs(spark, d):
    return _curate(spark, d)["curated"].select("site", "page_id", "rank", "type", "score", "title",
                                               F.md5("content").alias("content_md5"))


@register("rejects", _sql_curate("SELECT site, page_id, url, reason FROM rej WHERE reason IS NOT NULL"))
def rejects(spark, d):
    return _curate(spark, d)["rejects"]


@register("rejection_funnel", _sql_curate(
    "SELECT site, reason, count(*) AS pages FROM rej WHERE reason IS NOT NULL GROUP BY site, reason"))
def rejection_funnel(spark, d):
    return _curate(spark, d)["funnel"]


@register("usage_by_stage", _sql_curate("""
SELECT site, 'generate' AS stage, sum(p_tok)::BIGINT AS prompt_tokens, sum(c_tok)::BIGINT AS completion_tokens FROM el GROUP BY site
UNION ALL SELECT site, 'critique', 0::BIGINT, 0::BIGINT FROM kept GROUP BY site
UNION ALL SELECT site, 'refine', 0::BIGINT, 0::BIGINT FROM kept GROUP BY site"""))
def usage_by_stage(spark, d):
    u = _curate(spark, d)["usage"]
    return u.groupBy("site", "stage").agg(F.sum("prompt_tokens").alias("prompt_tokens"),
                                          F.sum("completion_tokens").alias("completion_tokens"))


@register("refined_docs", _sql_curate("SELECT site, page_id, md5(content) AS content_md5 FROM cur"))
def refined_docs(spark, d):
    c = _curate(spark, d)["curated"]
    return c.select("site", "page_id", F.md5("content").alias("content_md5"))


_SQL_REFINED = f"CASE WHEN length(generated) % 2 = 1 THEN generated || {_NL2} || '### Examples' || {_NL2} || 'None yet.' ELSE generated END"


def _sql_model(select: str) -> str:
    return _sql_curate(select, _SQL_OUTLINE, _SQL_OUTLINE_IN, "length(generated) // 4 + 1", _SQL_REFINED)


@register("model_refined_docs", _sql_model("SELECT site, page_id, rank, md5(content) AS content_md5 FROM cur"))
def model_refined_docs(spark, d):
    """J2-J4 inside the whole plan: a model generates up to the budget,
    criticises what is kept and refines what it criticised."""
    return _curate(spark, d, C.outline_model)["curated"].select("site", "page_id", "rank", F.md5("content").alias("content_md5"))


@register("model_usage_by_stage", _sql_model(f"""
SELECT site, 'critique' AS stage, sum(length('Please analyze and critique this documentation:' || {_NL2} || generated) // 4 + 1)::BIGINT AS prompt_tokens,
  sum(CASE WHEN length(generated) % 2 = 1 THEN length('Add examples.') // 4 + 1 ELSE 1 END)::BIGINT AS completion_tokens FROM kept GROUP BY site
UNION ALL SELECT site, 'refine', sum(CASE WHEN length(generated) % 2 = 1 THEN length('Original content:' || {_NL2} || generated || {_NL2}
  || 'Critique:' || {_NL2} || 'Add examples.' || {_NL2} || 'Please refine the content based on this critique.') // 4 + 1 ELSE 0 END)::BIGINT,
  sum(CASE WHEN length(generated) % 2 = 1 THEN length({_SQL_REFINED}) // 4 + 1 ELSE 0 END)::BIGINT FROM kept GROUP BY site"""))
def model_usage_by_stage(spark, d):
    """Usage of the later stages of the same plan (generation also pays
    for up to two pages past the stop)."""
    u = _curate(spark, d, C.outline_model)["usage"].where("stage <> 'generate'")
    return u.groupBy("site", "stage").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


_SQL_CLEAN_TITLE = "replace(replace(title, '[', ''), ']', '')"
_SQL_BUNDLES = _sql_curate(f""",
spent AS (SELECT site, sum(p_tok) AS pt, sum(c_tok) AS ct FROM el GROUP BY site),
seed AS ({ORACLES['site_seeds']}),
sec AS (SELECT *, (lag(type) OVER (PARTITION BY site ORDER BY rank)) IS DISTINCT FROM type AS header FROM cur),
body AS (SELECT site, count(*) AS pages,
    string_agg('- [' || {_SQL_CLEAN_TITLE} || '](#' || replace(lower({_SQL_CLEAN_TITLE}), ' ', '-') || ')' || chr(10), '' ORDER BY rank) AS toc,
    string_agg(CASE WHEN header THEN '## ' || {S.py_title('type')} || {_NL2} ELSE '' END || '### ' || title || {_NL2} || content || {_NL2}
               || '---' || {_NL2}, '' ORDER BY rank) AS md FROM sec GROUP BY site),
doc AS (SELECT seed.site, seed.base_url, '{fixed.BUNDLE_BANNER}' || {_NL2} || '# {fixed.BUNDLE_TITLE}' || {_NL2} || '## Document Information' || {_NL2}
    || '| Metric | Value |' || chr(10) || '|--------|-------|' || chr(10) || '| Generated | {GENERATED_AT} |' || chr(10)
    || '| Source | ' || seed.base_url || ' |' || chr(10) || '| Pages | ' || coalesce(body.pages, 0) || ' |' || chr(10)
    || '| Total Tokens | ' || format('{{:,}}', (coalesce(spent.pt + spent.ct, 0))::BIGINT) || ' |' || chr(10)
    || '| Cost | $' || printf('%.4f', coalesce(spent.pt * {S.RATE_IN} + spent.ct * {S.RATE_OUT}, 0.0)) || ' |' || {_NL2}
    || '## Contents' || {_NL2} || coalesce(body.toc, '') || chr(10) || '---' || {_NL2} || coalesce(body.md, '') AS markdown
  FROM seed LEFT JOIN body ON body.site = seed.site LEFT JOIN spent ON spent.site = seed.site)
SELECT * FROM doc""").replace("\n,\nspent AS", ",\nspent AS")


@register("site_bundle", f"SELECT site, length(markdown) AS chars, md5(markdown) AS markdown_md5 FROM ({_SQL_BUNDLES})")
def site_bundle(spark, d):
    return _curate(spark, d)["bundles"].select("site", F.length("markdown").alias("chars"),
                                               F.md5("markdown").alias("markdown_md5"))


@register("site_files", f"""
SELECT site, regexp_extract(base_url, '^[^/]*//([^/]*)', 1) || '{fixed.BUNDLE_SUFFIX}' AS name, length(markdown) AS chars, md5(markdown) AS markdown_md5
FROM ({_SQL_BUNDLES})""")
def site_files(spark, d):
    """A5, C17: the documents published as a version with a manifest and
    read back; the slices of a site are joined in order."""
    import uuid

    from pagewright.operators import assemble as AS
    from pagewright.session import scratch_dir
    path = scratch_dir(spark, f"site-files-{uuid.uuid4().hex}")
    version = AS.publish_bundles(_curate(spark, d)["fragments"], site_seeds(spark, d), path)
    parts = AS.read_bundles(spark, path, version)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slice", "markdown"))), lambda x: x["markdown"]), "")
    return (parts.groupBy("site", "name").agg(whole.alias("markdown"))
            .select("site", "name", F.length("markdown").alias("chars"), F.md5("markdown").alias("markdown_md5")))


@register("code_examples")
def code_examples(spark, d):
    return _curate(spark, d)["code_examples"]


# Pages of code built from the turns of conversations: one block per page, its
# class by the turn's number, with a hint of another language in some texts.
_TURN_CLASSES = ["language-py", "language-javascript", "language-go", "", "lang-npm"]
_SQL_TURNS = f"""
SELECT conv_id % 7 AS site_no, conv_id * 1000 + turn AS page_id, {S.strip('code')} AS code, cls FROM (SELECT conv_id, turn, [{', '.join(S.q(c) for c in _TURN_CLASSES)}][turn % 5 + 1] AS cls,
  CASE turn % 3 WHEN 0 THEN 'let ' || text WHEN 1 THEN '# note' || chr(10) || 'def ' || text ELSE 'interface ' || text END AS code FROM conversations)"""
_SQL_TURN_BLOCKS = f"""
SELECT 's' || site_no AS site, page_id, sel_ord, cls, code FROM (SELECT *, unnest([1, 5]) AS sel_ord FROM ({_SQL_TURNS}))
WHERE length(code) >= {fixed.MIN_CODE_CHARS} AND (sel_ord = 1 OR contains(cls, 'language-'))"""
_SQL_TURN_LANG = f"""
SELECT *, CASE {' '.join(f"WHEN lang0 IN ({', '.join(S.q(n) for n in names)}) THEN {S.q(main)}" for main, names in fixed.LANGUAGE_ALIASES)} ELSE lang0 END AS language
FROM (SELECT *, CASE {' '.join("WHEN " + ' OR '.join(f"contains(code, {S.q(p)})" for p in pats) + f" THEN {S.q(lang)}" for lang, pats in fixed.CONTENT_HINTS)}
  ELSE lower(replace(replace(cls, 'language-', ''), 'lang-', '')) END AS lang0 FROM ({_SQL_TURN_BLOCKS}))"""
_SQL_TURN_KEPT = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, {_sql_norm_code('code')} ORDER BY page_id, sel_ord) AS rn FROM ({_SQL_TURN_LANG})
WHERE language IN ({', '.join(S.q(x) for x in fixed.KEPT_CODE_LANGUAGES)})) WHERE rn = 1"""


def _turn_blocks(spark, d):
    turns = C.table(spark, d, "conversations")
    cls = F.get(F.array(*[F.lit(c) for c in _TURN_CLASSES]), (F.col("turn") % 5).cast("int"))
    code = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit("let "), "text"))
            .when(F.col("turn") % 3 == 1, F.concat(F.lit("# note\ndef "), "text")).otherwise(F.concat(F.lit("interface "), "text")))
    escaped = F.replace(F.replace(code, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><body><main><pre><code class=\""), cls, F.lit("\">"), escaped, F.lit("</code></pre></main></body></html>"))
    pages = turns.select(F.concat(F.lit("s"), (F.col("conv_id") % 7).cast("string")).alias("site"),
                         (F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"),
                         F.concat(F.lit("https://s.io/"), F.col("conv_id").cast("string")).alias("url"), html.alias("html"))
    return X.code_blocks(X.materialised(pages))


@register("turn_code_blocks", f"""
SELECT site, page_id, sel_ord, lower(replace(replace(cls, 'language-', ''), 'lang-', '')) AS class_lang, md5(code) AS code_md5 FROM ({_SQL_TURN_BLOCKS})""")
def turn_code_blocks(spark, d):
    """B6, B7 over code elements made of the turns of conversations."""
    return _turn_blocks(spark, d).select("site", "page_id", "sel_ord", CD.class_language(F.col("classes")).alias("class_lang"),
                                         F.md5("code").alias("code_md5"))


def _turn_kept(spark, d):
    blocks = _turn_blocks(spark, d).withColumn("language", CD.code_language(F.col("classes"), F.col("code")))
    blocks = (blocks.where(CD.is_kept_language(F.col("language")))
              .withColumn("block_id", F.concat_ws(":", F.col("page_id").cast("string"), F.col("pos").cast("string"))))
    return DD.first_wins(blocks, ["site"], T.key_hash(CD.normalize_code(F.col("code"))), [("page_id", True), ("sel_ord", True)],
                         "block_id", "first").where("first")


@register("turn_code_examples", f"SELECT site, page_id, sel_ord, language, md5(code) AS code_md5 FROM ({_SQL_TURN_KEPT})")
def turn_code_examples(spark, d):
    """C8-C10 and D5 over the same blocks: language, normal form, first copy."""
    return _turn_kept(spark, d).select("site", "page_id", "sel_ord", "language", F.md5("code").alias("code_md5"))


@register("turn_code_language_counts", f"SELECT site, language, count(*) AS n FROM ({_SQL_TURN_KEPT}) GROUP BY ALL")
def turn_code_language_counts(spark, d):
    """F8 over the kept blocks."""
    return _turn_kept(spark, d).groupBy("site", "language").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# T3 traversal
# ---------------------------------------------------------------------------

def _crawl_inputs(spark, d):
    from pagewright.plans.curate import gate_pages
    gated = gate_pages(C.extracted(spark, d), C.profile(spark, d))
    p = C.pages(spark, d)
    first = p.groupBy("site").agg(F.min(F.struct("page_id", "url")).alias("f"))
    seeds = first.select("site", F.col("f.url").alias("start_url"), F.lit(fixed.DEFAULT_MAX_TOKENS).alias("max_tokens"))
    return gated, seeds


def _sql_reachable(el: str, lk: str) -> str:
    """Level-synchronous reachability: from each site's first page, follow
    the links of successful pages; a stored page's depth is the shortest path
    length, which is below the number of stored pages."""
    return f"""
WITH RECURSIVE
el AS MATERIALIZED ({el}),
pg AS MATERIALIZED (SELECT site, node, min(page_id) AS page_id FROM el GROUP BY site, node),
lk AS MATERIALIZED (SELECT DISTINCT s.page_id AS src, pg.page_id AS dst FROM ({lk}) l JOIN el s ON s.page_id = l.page_id AND s.ok
  JOIN pg p ON p.page_id = s.page_id JOIN pg ON pg.site = l.site AND pg.node = l.url),
r(page_id, depth) AS (
  SELECT pg.page_id, 0 FROM pg JOIN (SELECT site, arg_min(node, page_id) AS node FROM el GROUP BY site) st
    ON pg.site = st.site AND pg.node = st.node
  UNION
  SELECT lk.dst, r.depth + 1 FROM r JOIN lk ON lk.src = r.page_id WHERE r.depth < (SELECT count(*) FROM pg))
SELECT pg.site, pg.page_id, pg.node AS url, min(r.depth) AS depth
FROM r JOIN pg ON pg.page_id = r.page_id GROUP BY pg.site, pg.page_id, pg.node"""


@register("reachable_pages", _sql_reachable(
    f"SELECT site, page_id, split_part(url, '#', 1) AS node, reason IS NULL AS ok FROM ({_sql_eligible()})",
    f"SELECT site, page_id, url FROM ({_sql_links()})"))
def reachable_pages(spark, d):
    from pagewright.plans.crawl import reachable
    gated, seeds = _crawl_inputs(spark, d)
    return reachable(seeds, gated, C.TEST_RULES)


_SQL_RELINKED = f"""
SELECT n.site, n.page_id, coalesce(t.url, n.url) AS url FROM (SELECT site, page_id, url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM ({_sql_pages()})) n
LEFT JOIN (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) AS k FROM (SELECT DISTINCT site, url FROM ({_sql_links()}))) t
ON t.site = n.site AND t.k = n.k"""


@register("linked_pages_resolution", f"""
WITH pg AS ({_SQL_RELINKED})
SELECT l.site, l.page_id, l.pos, l.url, p.page_id AS target_page_id, p.page_id IS NOT NULL AS resolved
FROM ({_sql_links()}) l LEFT JOIN (SELECT site, split_part(url, '#', 1) AS url, min(page_id) AS page_id FROM pg GROUP BY ALL) p
ON p.site = l.site AND p.url = l.url""")
def linked_pages_resolution(spark, d):
    """E5 over pages that link to each other (see ``common.relinked``)."""
    ex = C.extracted(spark, d)
    pages = C.relinked(spark, d, ex=ex)
    stored = (pages.groupBy("site", F.substring_index("url", "#", 1).alias("url_norm")).agg(F.min("page_id").alias("page_id")))
    return LK.link_resolution(_links(spark, d, ex=ex).select("site", "page_id", "pos", "url"), stored).select(
        "site", "page_id", "pos", "url", "target_page_id", "resolved")


@register("linked_pages_reachable", _sql_reachable(
    f"SELECT site, page_id, split_part(url, '#', 1) AS node, true AS ok FROM ({_SQL_RELINKED})",
    f"SELECT site, page_id, url FROM ({_sql_links()})"))
def linked_pages_reachable(spark, d):
    """T3 over pages that link to each other."""
    from pagewright.plans.crawl import reachable
    pages = C.relinked(spark, d).withColumn("reason", F.lit(None).cast("string"))
    first = pages.groupBy("site").agg(F.min(F.struct("page_id", "url")).alias("f"))
    return reachable(first.select("site", F.col("f.url").alias("start_url")), pages, C.TEST_RULES)


# ---------------------------------------------------------------------------
# S1-S5 streaming forms (availableNow over a file source, read back)
# ---------------------------------------------------------------------------

@register("stream_extract", ORACLES["eligible_pages"])
def stream_extract(spark, d):
    from pagewright.streaming import streams as ST
    return ST.stream_extract(ST.file_stream(spark, d, "pages"), C.profile(spark, d))


@register("stream_dedup", f"SELECT DISTINCT md5(lower({S.strip('text')})) AS key_md5 FROM documents")
def stream_dedup(spark, d):
    from pagewright.streaming import streams as ST
    s = ST.file_stream(spark, d, "documents")
    out = ST.stream_dedup(s, [], F.md5(T.content_key(F.col("text"))))
    return out.select(F.col("_key").alias("key_md5"))


@register("stream_budget", f"""
SELECT site, rank, tokens, used_before, used_before < {_LIMIT} AS kept FROM (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY site ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before
  FROM ({_SQL_RANKED_DOCS}))""")
def stream_budget(spark, d):
    from pagewright.streaming import streams as ST
    s = ST.file_stream(spark, d, "documents")
    ranked = s.select(F.col("source").alias("site"), F.col("doc_id").alias("rank"),
                      T.token_estimate(F.col("text")).alias("tokens"),
                      F.lit(fixed.DEFAULT_MAX_TOKENS).alias("max_tokens"))
    return ST.stream_budget(ranked)


@register("stream_usage_window", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total_value
FROM events GROUP BY ALL""")
def stream_usage_window(spark, d):
    from pagewright.streaming import streams as ST
    out = ST.stream_usage_window(ST.file_stream(spark, d, "events"))
    return out.withColumn("total_value", F.round("total_value", 4))


@register("stream_usage_rate", """
SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total_value, count(*) / 60.0 AS per_minute FROM (
  SELECT event_type, value, time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS w FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
GROUP BY ALL""")
def stream_usage_rate(spark, d):
    """S4's sliding form: hourly windows every 15 minutes and their rates."""
    from pagewright.streaming import streams as ST
    out = ST.stream_usage_window(ST.file_stream(spark, d, "events"), "1 hour", slide="15 minutes")
    return out.withColumn("total_value", F.round("total_value", 4)).withColumn("per_minute", F.col("n") / 60.0)


@register("stream_dedup_bounded", "SELECT DISTINCT event_type, md5(props) AS key_md5 FROM events WHERE props IS NOT NULL")
def stream_dedup_bounded(spark, d):
    """S2 with keys that expire by event time: what an event says, per type."""
    from pagewright.streaming import streams as ST
    s = (ST.file_stream(spark, d, "events").where(F.col("props").isNotNull())
         .withColumn("ts", F.col("ts").cast("timestamp")))
    out = ST.stream_dedup(s, ["event_type"], F.md5("props"), ("ts", "1 day"))
    return out.select("event_type", F.col("_key").alias("key_md5"))


@register("stream_near_dup", f"SELECT doc_id FROM ({_SQL_FUZZY}) WHERE kept")
def stream_near_dup(spark, d):
    from pagewright.streaming import streams as ST
    s = ST.file_stream(spark, d, "documents").select("doc_id", "text")
    return ST.stream_near_dup(s, [], "doc_id", "text", [("doc_id", True)]).select("doc_id")


# ---------------------------------------------------------------------------
# B7 and H3
# ---------------------------------------------------------------------------

@register("code_lang_class")
def code_lang_class(spark, d):
    """B7 on the extracted code candidates: language from the element's own
    classes (before content hints and aliases)."""
    blocks = X.code_blocks(C.extracted(spark, d))
    return blocks.select("site", "page_id", "sel_ord", "doc_ord", CD.class_language(F.col("classes")).alias("class_lang"))


@register("jaccard_pairs", f"""
SELECT source, doc_id, prev_id, len(list_intersect(ws, pws)) AS inter,
       len(list_distinct(list_concat(ws, pws))) AS uni,
       CASE WHEN len(list_distinct(list_concat(ws, pws))) > 0
            THEN len(list_intersect(ws, pws))::DOUBLE / len(list_distinct(list_concat(ws, pws)))::DOUBLE END AS jaccard
FROM (SELECT source, doc_id, ws, lag(doc_id) OVER w AS prev_id, lag(ws) OVER w AS pws
      FROM (SELECT source, doc_id, {S.word_set('text')} AS ws FROM documents)
      WINDOW w AS (PARTITION BY source ORDER BY doc_id))
WHERE prev_id IS NOT NULL""")
def jaccard_pairs(spark, d):
    """H3: word-set intersection and union of each document with the
    previous one of its source (doc_id order)."""
    from pagewright.operators.order import rank_within
    docs = C.table(spark, d, "documents").select("source", "doc_id", T.word_set(F.col("text")).alias("ws"))
    ranked = rank_within(docs, ["source"], [("doc_id", True)])
    prev = ranked.select("source", (F.col("rank") + 1).alias("rank"), F.col("doc_id").alias("prev_id"),
                         F.col("ws").alias("pws"))
    x = ranked.join(prev, ["source", "rank"])   # previous document of the source
    inter = F.size(F.array_intersect("ws", "pws"))
    uni = F.size(F.array_union("ws", "pws"))
    return x.select("source", "doc_id", "prev_id", inter.alias("inter"), uni.alias("uni"),
                    F.when(uni > 0, inter.cast("double") / uni.cast("double")).alias("jaccard"))
