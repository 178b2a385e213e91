"""Native Column functions for text: Python-compatible strip/split, keys,
title case, token estimate. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, written out so Java and RE2 agree
# (\s differs between them: Java includes \x0B, RE2 does not).
WS_CLASS = (r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_RE = f"^{WS_CLASS}+|{WS_CLASS}+$"
# the same set as characters, derived from Python's own rule, for trim()
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPLIT_RE = f"{WS_CLASS}+"

# Token estimate: runs of letters, 1-3 digits, or runs of other
# non-space characters (an estimate of BPE pieces, labelled tokens_est).
TOKEN_RE = (r"\p{L}+|\p{N}{1,3}|[^\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{L}\p{N}]+")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """str.strip() with Python's whitespace set: native trim of a character
    set, which only touches the characters it removes."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def py_split(col) -> Column:
    """str.split() with no argument: runs of whitespace, no empty items
    (separators at either end only yield empty items, which are dropped, so
    no strip pass over the text is needed)."""
    return F.filter(F.split(_c(col), SPLIT_RE), lambda w: F.length(w) > 0)


def content_key(col) -> Column:
    """C11 exact-duplicate key: lower(strip(text))."""
    return F.lower(py_strip(col))


def word_set(col) -> Column:
    """C11 word set: set(lower(text).split())."""
    return F.array_distinct(py_split(F.lower(_c(col))))


def hashed_words(words) -> Column:
    """An array of distinct words as their sorted 64-bit hashes."""
    return F.array_sort(F.transform(_c(words), lambda w: F.xxhash64(w)))


def title_key(col) -> Column:
    """C12 title key: lower(strip(title))."""
    return F.lower(py_strip(col))


def key_hash(col) -> Column:
    """Stable 128-bit key hash used for grouping (md5 hex, as in the oracle)."""
    return F.md5(_c(col))


def py_title(col) -> Column:
    """str.title(): a cased character is upper-cased when the previous
    character is not cased, lower-cased otherwise."""
    chars = F.split(_c(col), "")
    # pair every character with its predecessor (no per-element re-split)
    prev = F.concat(F.array(F.lit("")), F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))))
    pairs = F.arrays_zip(chars.alias("c"), prev.alias("p"))
    out = F.transform(pairs, lambda x: F.when(F.lower(x["p"]) == F.upper(x["p"]), F.upper(x["c"]))
                      .otherwise(F.lower(x["c"])))
    return F.when(_c(col) == "", F.lit("")).otherwise(F.array_join(out, ""))


def url_path(url) -> Column:
    """Path component of an absolute or relative URL (no query/fragment)."""
    u = _c(url)
    return F.when(
        u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"),
        F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1),
    ).otherwise(F.regexp_extract(u, r"^([^?#]*)", 1))


def slug_title(url) -> Column:
    """C13 fallback title: last path segment of strip('/')-ed path, '-' and
    '_' to spaces, Python title case. An empty path gives ''."""
    path = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return py_title(F.translate(last, "-_", "  "))


def token_estimate(col) -> Column:
    """C14 estimate of model tokens in a text (regex pieces, not BPE)."""
    c = _c(col)
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN_RE)), F.lit(0)).cast("bigint")
