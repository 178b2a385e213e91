"""Code-block Column functions (B7, C8, C9, C10): class language, content
hints, alias mapping, normalised form for duplicate detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.functions.text import WS_CHARS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def class_language(classes) -> Column:
    """First class token containing 'language-' or 'lang-', with that
    prefix removed anywhere in the token, lower-cased; '' when none."""
    tok = F.get(F.filter(_c(classes), lambda c: c.contains("language-") | c.contains("lang-")), 0)
    lang = F.when(tok.contains("language-"), F.replace(tok, F.lit("language-"), F.lit(""))) \
            .otherwise(F.replace(tok, F.lit("lang-"), F.lit("")))
    return F.coalesce(F.lower(lang), F.lit(""))


def hinted_language(code, base_lang) -> Column:
    """Content hints (case-sensitive substrings) override the class."""
    c = _c(code)
    out = None
    for lang, pats in fixed.CONTENT_HINTS:
        cond = None
        for p in pats:
            cond = c.contains(p) if cond is None else (cond | c.contains(p))
        out = F.when(cond, F.lit(lang)) if out is None else out.when(cond, F.lit(lang))
    return out.otherwise(_c(base_lang))


def canonical_language(lang) -> Column:
    """Alias mapping to the main language name (first family wins)."""
    l_ = _c(lang)
    out = None
    for main, names in fixed.LANGUAGE_ALIASES:
        cond = l_.isin(*names)
        out = F.when(cond, F.lit(main)) if out is None else out.when(cond, F.lit(main))
    return out.otherwise(l_)


def code_language(classes, code) -> Column:
    """B7 -> C8 -> C9: the language recorded for a block."""
    return canonical_language(hinted_language(code, class_language(classes)))


def is_kept_language(lang) -> Column:
    return _c(lang).isin(*fixed.KEPT_CODE_LANGUAGES)


def normalize_code(code) -> Column:
    """Per line strip; drop empty and comment-prefixed lines; delete
    the declaration keywords in order; join with newlines."""
    lines = F.split(_c(code), r"\r\n|[\n\r\x0B\f\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]")
    stripped = F.transform(lines, lambda s: F.trim(s, F.lit(WS_CHARS)))

    def keep(s):
        cond = F.length(s) > 0
        for p in fixed.CODE_COMMENT_PREFIXES:
            cond = cond & ~s.startswith(p)
        return cond

    def clean(s):
        for d in fixed.CODE_DELETIONS:
            s = F.replace(s, F.lit(d), F.lit(""))
        return s

    return F.array_join(F.transform(F.filter(stripped, keep), clean), "\n")
