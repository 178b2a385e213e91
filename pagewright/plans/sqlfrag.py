"""SQL fragments for the DuckDB oracle statements (one statement each, so
helpers are string templates rather than macros). Regular expressions are
the same as the Spark side wherever both engines accept them."""

from __future__ import annotations

from pagewright import fixed

WS = (r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
TOKEN_RE = (r"\p{L}+|\p{N}{1,3}|[^\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{L}\p{N}]+")
RATE_IN = repr(fixed.MODEL_RATES[0][1])
RATE_OUT = repr(fixed.MODEL_RATES[0][2])


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '{WS}+'), lambda w: length(w) > 0)"


def word_set(x: str) -> str:
    return f"list_distinct({split_ws(f'lower({x})')})"


def tokens(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{TOKEN_RE}')), 0)::BIGINT"


def unescape(x: str) -> str:
    out = x
    for name, ch in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"),
                     ("nbsp", " ")]:
        out = f"regexp_replace({out}, '&{name};?', {q(ch)}, 'g')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def site(url: str) -> str:
    host = f"lower(regexp_replace(regexp_replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
    return f"regexp_extract({host}, '([^.]+\\.[^.]+)$', 1)"


def netloc(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"


def text_of(fragment: str) -> str:
    """Visible text of an HTML fragment: drop comments and script/style
    blocks, split on tags, unescape, strip each piece, drop empties, join
    with one space."""
    body = f"regexp_replace({fragment}, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '\u0001', 'g')"
    pieces = f"regexp_split_to_array({body}, '<[A-Za-z/!][^>]*>|\u0001')"
    return (f"array_to_string(list_filter(list_transform({pieces}, lambda p: {strip(unescape('p'))}), "
            f"lambda p: length(p) > 0), ' ')")


def raw_text_of(fragment: str) -> str:
    """get_text() then strip(): pieces concatenated without a separator."""
    body = f"regexp_replace({fragment}, '(?s)<!--.*?-->', '', 'g')"
    return strip(unescape(f"regexp_replace({body}, '<[A-Za-z/!][^>]*>', '', 'g')"))


def article(html: str) -> str:
    return f"regexp_extract({html}, '(?s)<article[^>]*>(.*?)</article>', 1)"


def main_text(html: str) -> str:
    return f"CASE WHEN regexp_matches({html}, '<article[\\s>]') THEN {text_of(article(html))} END"


def h1(html: str) -> str:
    return f"CASE WHEN regexp_matches({html}, '<h1[\\s>]') THEN {raw_text_of(f'''regexp_extract({html}, '(?s)<h1[^>]*>(.*?)</h1>', 1)''')} END"


def title_tag(html: str) -> str:
    return f"CASE WHEN regexp_matches({html}, '<title[\\s>]') THEN {raw_text_of(f'''regexp_extract({html}, '(?s)<title[^>]*>(.*?)</title>', 1)''')} END"


def py_title(x: str) -> str:
    """str.title() over a string column."""
    chars = f"string_split({x}, '')"
    return (f"array_to_string(list_transform({chars}, lambda c, i: CASE WHEN i = 1 OR "
            f"lower({chars}[i - 1]) = upper({chars}[i - 1]) THEN upper(c) ELSE lower(c) END), '')")


def slug(url: str) -> str:
    path = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    last = f"string_split(regexp_replace({path}, '^/+|/+$', '', 'g'), '/')[-1]"
    return py_title(f"translate({last}, '-_', '  ')")


def hrefs(html: str) -> str:
    """href values of every <a> element with an href, document order."""
    return (f"list_transform(regexp_extract_all({html}, '<a\\s[^>]*?href=\"([^\"]*)\"', 1), "
            f"lambda h: {unescape('h')})")


def choose_title(html: str, url: str) -> str:
    t1, t2 = h1(html), title_tag(html)
    return (f"CASE WHEN length({t1}) > 1 THEN {t1} WHEN length({t2}) > 1 THEN {t2} "
            f"ELSE {slug(url)} END")


def rule_case(url: str, rules, what: str) -> str:
    parts = []
    for r in rules:
        cond = " OR ".join(f"contains(lower({url}), {q(p)})" for p in r.patterns)
        val = q(r.section) if what == "type" else str(r.score)
        parts.append(f"WHEN {cond} THEN {val}")
    other = q("other") if what == "type" else "0"
    return "CASE " + " ".join(parts) + f" ELSE {other} END"


def skip_href(h: str) -> str:
    cond = " OR ".join(f"starts_with({h}, {q(p)})" for p in fixed.SKIP_HREF_PREFIXES)
    return f"({h} IS NULL OR {h} = '' OR {cond})"


def join_url(base: str, ref: str) -> str:
    """urljoin for absolute, network-path and root-relative references
    (dot segments of root-relative paths are resolved)."""
    bscheme = f"lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"
    rscheme = f"lower(regexp_extract({ref}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"
    path = f"regexp_extract({ref}, '^([^?#]*)', 1)"
    rest = f"substr({ref}, length({path}) + 1)"
    segs = f"string_split({path}, '/')"
    resolved = (f"list_reduce(list_prepend([]::VARCHAR[], {segs}), lambda acc, s: CASE WHEN s = '..' "
                f"THEN acc[1:len(acc) - 1] WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    return (f"CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') AND {rscheme} <> {bscheme} THEN {ref} "
            f"WHEN starts_with({ref}, '//') THEN {bscheme} || ':' || {ref} "
            f"WHEN starts_with({ref}, '/') THEN {bscheme} || '://' || {netloc(base)} || {path} || {rest} "
            f"ELSE NULL END")
