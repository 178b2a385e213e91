"""URL Column functions: fragment cut, RFC 3986 style resolution against a
base URL (Python ``urljoin`` semantics, including dot-segment removal),
authority extraction and the in-domain test. Pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import fixed

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTH_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
PATH_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
QUERY_RE = r"^[^?#]*\?([^#]*)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), SCHEME_RE, 1))


def netloc(url) -> Column:
    """Authority of an absolute URL ('' when there is none)."""
    return F.regexp_extract(_c(url), AUTH_RE, 1)


def host(url) -> Column:
    """Host name: authority without user info and port, lower-cased."""
    a = netloc(url)
    a = F.regexp_replace(a, r"^.*@", "")
    return F.lower(F.regexp_replace(a, r":[0-9]*$", ""))


def site_of(url) -> Column:
    """Site key used for the driver tables: last two labels of the host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1)


def skip_href(href) -> Column:
    """True when the href is dropped before normalising."""
    h = _c(href)
    cond = h.isNull() | (h == "")
    for p in fixed.SKIP_HREF_PREFIXES:
        cond = cond | h.startswith(p)
    return cond


def _drop_dots(segments: Column) -> Column:
    def step(acc, s):
        popped = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return (F.when(s == "..", popped)
                .when(s == ".", acc)
                .otherwise(F.concat(acc, F.array(s))))

    resolved = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)


def urljoin(base, ref) -> Column:
    """Resolve ``ref`` against ``base`` the way Python's urljoin does for
    http(s) bases: absolute refs pass through, ``//host`` takes the base
    scheme, ``?q`` keeps the base path, other refs merge with the base
    directory and have dot segments removed."""
    b, r0 = _c(base), _c(ref)
    # '//' followed by an empty authority names no host: what follows is
    # resolved like a reference without one ('//' -> the base itself)
    empty_auth = r0.startswith("//") & ~r0.rlike(r"^//[^/?#]")
    r = F.when(empty_auth, F.substring(r0, 3, 1 << 30)).otherwise(r0)
    bscheme = scheme(b)
    bnet = netloc(b)
    bpath = F.regexp_extract(b, PATH_RE, 1)
    bquery = F.regexp_extract(b, QUERY_RE, 1)

    rscheme = scheme(r)
    rpath = F.regexp_extract(r, r"^([^?#]*)", 1)
    rquery = F.regexp_extract(r, QUERY_RE, 1)

    base_parts = F.split(bpath, "/")
    base_dir = F.when(F.element_at(base_parts, -1) != "",
                      F.slice(base_parts, F.lit(1), F.size(base_parts) - 1)).otherwise(base_parts)
    rel_parts = F.split(rpath, "/")
    merged = F.concat(base_dir, rel_parts)
    n = F.size(merged)
    # empty segments between the first and the last are dropped
    middle = F.filter(F.slice(merged, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s: s != "")
    merged_clean = F.when(n <= 2, merged).otherwise(
        F.concat(F.slice(merged, 1, 1), middle, F.slice(merged, -1, 1)))
    segments = F.when(rpath.startswith("/"), F.split(rpath, "/")).otherwise(merged_clean)
    resolved = F.array_join(_drop_dots(segments), "/")
    # an authority is present, so the path always starts with '/'
    path = F.when(resolved.startswith("/"), resolved).otherwise(F.concat(F.lit("/"), resolved))
    prefix = F.concat(bscheme, F.lit("://"), bnet)

    query_part = F.when(rquery != "", F.concat(F.lit("?"), rquery)).otherwise(F.lit(""))
    keep_base = F.concat(prefix, bpath,
                         F.when(rquery != "", F.concat(F.lit("?"), rquery))
                         .when(bquery != "", F.concat(F.lit("?"), bquery))
                         .otherwise(F.lit("")))
    return (F.when(r.rlike(SCHEME_RE) & (rscheme != bscheme), r)
            .when(r.rlike(SCHEME_RE + r"//"),
                  F.concat(rscheme, F.lit(":"), F.regexp_replace(r, SCHEME_RE, "")))
            .when(r.startswith("//") & ~empty_auth, F.concat(bscheme, F.lit(":"), r))
            .when(rpath == "", keep_base)
            .otherwise(F.concat(prefix, path, query_part)))


def normalize_url(href, base, domain, strict: bool = False) -> Column:
    """Cut at '#', empty -> NULL, resolve against ``base``, NULL when
    the authority does not contain ``domain`` (substring test, as the
    behaviour being reproduced does); ``strict`` requires the host to equal
    the domain or be a subdomain of it."""
    cut = F.substring_index(_c(href), "#", 1)
    joined = urljoin(base, cut)
    auth = netloc(joined)
    d = _c(domain)
    if strict:
        h = host(joined)
        ok = (h == F.lower(d)) | h.endswith(F.concat(F.lit("."), F.lower(d)))
    else:
        ok = auth.contains(d)
    return F.when((cut != "") & ok, joined)
