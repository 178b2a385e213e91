"""Markdown Column functions (C15-C18) and the native quality audit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.functions import text as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_title(title) -> Column:
    return F.concat(F.lit("# "), _c(title), F.lit("\n\n"))


def format_section(title, level: int | Column = 2) -> Column:
    lvl = level if isinstance(level, Column) else F.lit(level)
    return F.concat(F.repeat(F.lit("#"), lvl), F.lit(" "), _c(title), F.lit("\n\n"))


def format_code_block(code, language, title=None) -> Column:
    """Fenced code with an optional bold title line."""
    body = F.concat(F.lit("```"), F.coalesce(_c(language), F.lit("")), F.lit("\n"),
                    T.py_strip(code), F.lit("\n```\n"))
    if title is None:
        return body
    t = _c(title)
    return F.when((t.isNull()) | (t == ""), body).otherwise(
        F.concat(F.lit("**"), t, F.lit("**\n\n"), body))


def format_note(text) -> Column:
    return F.concat(F.lit("> **Note:** "), _c(text), F.lit("\n\n"))


def format_warning(text) -> Column:
    return F.concat(F.lit("> ⚠️ **Warning:** "), _c(text), F.lit("\n\n"))


def format_installation(steps) -> Column:
    """Numbered list of steps under an Installation heading."""
    items = F.transform(_c(steps), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s, F.lit("\n")))
    return F.concat(F.lit("### Installation\n\n\n"), F.array_join(items, "\n"), F.lit("\n"))


def toc_entry(title) -> Column:
    """C15: '- [clean](#anchor)'; brackets removed, anchor lower-case with
    spaces turned into '-' (punctuation kept)."""
    clean = F.translate(_c(title), "[]", "")
    anchor = F.replace(F.lower(clean), F.lit(" "), F.lit("-"))
    return F.concat(F.lit("- ["), clean, F.lit("](#"), anchor, F.lit(")"))


def bundle_name(base_url, full_host: bool = True) -> Column:
    """C17: output file name. Default keys by the full host (two sites with
    the same first label do not collide); ``full_host=False`` keeps only the
    first label."""
    h = F.regexp_extract(_c(base_url), r"^[^/]*//([^/]*)", 1)
    if not full_host:
        h = F.substring_index(h, ".", 1)
    return F.concat(h, F.lit(fixed.BUNDLE_SUFFIX))


def thousands(n) -> Column:
    """Integer with thousands separators (1,234,567)."""
    return F.format_number(_c(n).cast("bigint"), 0)


def cost_4dp(x) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.4f", _c(x)))


def audit_markdown(md) -> Column:
    """J3 native audit: the rules the generation prompt states, checked per
    document; returns the list of violated rules (empty when clean)."""
    m = _c(md)
    checks = [
        ("missing_h2", ~m.rlike(r"(?m)^## ")),
        ("missing_h3", ~m.rlike(r"(?m)^### ")),
    ]
    for h in fixed.AUDIT_HEADINGS:
        name = "missing_" + h.lstrip("# ").lower().replace(" ", "_")
        checks.append((name, ~m.contains(h)))
    checks += [
        ("fence_without_language",
         F.exists(F.filter(F.regexp_extract_all(m, F.lit(r"(?m)^```(.*)$"), 1),
                           lambda x, i: i % 2 == 0),
                  lambda x: T.py_strip(x) == "")),
        ("raw_html", m.rlike(r"<(div|span|p|br|table|img|a)[\s>/]")),
    ]
    arr = F.array(*[F.when(c, F.lit(n)) for n, c in checks])
    return F.filter(arr, lambda x: x.isNotNull())
