"""Secret scan: an Aho-Corasick pass over the folded text finds keywords,
anchored regular expressions run only at those places, and tokens that embed
a checksum are reported only if it holds.

Kinds, in order: ``assign`` (a named value of 8 or more characters),
``access`` (access key ids), ``hex`` (runs of 32 or more lower-case hex
digits; no keyword announces them, so they are found by one linear run scan),
and two kinds whose last six characters are the base-62 CRC-32 of the rest:
``github`` and ``npm`` tokens. Matches of one kind never overlap; the
leftmost wins and a match that fails its length or checksum is dropped
without a retry.

Defined cases: a null or empty text has no spans; repeated rows each give a
row; spans with the same start are ordered by kind; an empty table gives an
empty result; columns other than doc_id and text are not read. Offsets are
code points, end exclusive."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import Texts

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
SPANS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    rest, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits


_CHECKS = {
    "assign": (_ASSIGN, lambda m: m.end(2) - m.start(2) >= 8),
    "access": (_ACCESS, lambda m: m.end() - m.start() >= 16),
    "github": (_GITHUB, lambda m: checksum(m[1]) == m[2]),
    "npm": (_NPM, lambda m: checksum(m[1]) == m[2]),
}
KEYWORDS = {**dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
            "akia": "access", **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"), "npm_": "npm"}
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick
        _AUTOMATON = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _AUTOMATON.add_word(word, (kind, len(word)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of one text, by start, then kind."""
    # U+0130 is the one character that folds to two; keep offsets aligned
    folded = text.replace("İ", "\x00").lower()
    found, free = [], dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _automaton().iter(folded):
        at = last + 1 - length
        if at < free[kind]:
            continue
        pattern, holds = _CHECKS[kind]
        if match := pattern.match(text, at):
            free[kind] = match.end()
            if holds(match):
                found.append((kind, at, match.end()))
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T._parse_datatype_string(SPANS))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(text)]
                     for text in Texts(batch.column(1)).strings()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and all spans as text."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
                        *[count(k).alias(f"n_{k}") for k in KINDS[3:]])
