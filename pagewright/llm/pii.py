"""PII by information-theoretic sanitisation, in DataFrame operations only.

Base spans (email, ip, card, phone) are found with linear expressions. The
protected entities are their values, and a word of a document outside its base
spans is a term of the document's entities; for scripts without spaces every
two neighbouring characters are one.

How strongly does a term reveal an entity? Over the whole texts of all
documents are counted: the documents with the term, with the entity and with
both. Given the term, the entity is uncertain by ``-log2 P(entity | term)``
bits. Only evidence counts: instead of the share itself the lower Wilson bound
of it is taken, over as many observations as there are independent contexts.
Exact and near copies of a document are one context: of the documents of an
entity that share a band of term minhashes only the first counts. So a word
that stands once beside an address proves nothing, however rare it is, while a
name that stands beside it in two unrelated documents, and nowhere else, does.
The test does not depend on the size of the corpus.

A term whose bound is ``REMOVE`` (at most 1 bit left) or more is removed from
every document of the entity, one of ``GENERALISE`` (1.3 bits) or more, whose
evidence is thinner, becomes ``[TERM]``; both must raise the entity's
probability by ``GAIN`` bits over its rate among all documents, so common
words give no common entity away. Base spans become their kind. Entities that
stand in the same documents have the same evidence and are counted as one.

Defined cases: a null or empty text has no spans; every row is a document, so
repeated rows and rows that repeat an id each count and each give a row; a
null id is an id like any other; overlapping spans are merged before
replacement; an empty table gives an empty result; columns other than doc_id
and text are not read and may have any name. Offsets are code points, end
exclusive. Spans are found side by side and rewritten chunk by chunk, so the
work is linear in a text's length and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import scratch_table

KINDS = ("email", "ip", "card", "phone")
SPANS = (*KINDS, "term", "hint")          # a hint is a generalised term
GENERALISE, REMOVE, GAIN = 0.4, 0.5, 1.0
Z = 1.645                                 # one-sided bound of 95 %
BANDS, ROWS = 12, 4                       # near copies share one of 12 bands of 4 minhashes
CHUNK = 1024                              # code points rewritten at once
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30FC\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Script tests are slow: they are made from the first such character (Thai) on.
_CHARACTER = rf"[\u0E00-\x{{3FFFF}}&&[{_UNSPACED}]]"
_LETTERS = (r"[A-Za-z0-9[\u00AA-\u0DFF&&[\p{L}\p{M}\p{N}]]"
            rf"[\u0E00-\x{{10FFFF}}&&[\p{{L}}\p{{M}}\p{{N}}]&&[^{_UNSPACED}]]]++")
#: Letters, marks and digits with inner hyphens and apostrophes, or a run of an unspaced script.
WORD = rf"(?![\x00-\x2F\x3A-\x40]){_LETTERS}(?:['\u2019-]{_LETTERS})*+|{_CHARACTER}++"

#: Possessive, anchored forms of the base expressions: same matches, linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the Luhn sum of a digit string ends in 0."""
    places = F.sequence(F.lit(1), F.length(number))
    value = F.reverse(number)

    def add(total, i):
        d = F.substring(value, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(digits(match))
    return n.between(8, 15) if kind == "phone" else n.between(16, 19) & luhn(digits(match))


def holding(kind: str):
    return lambda match: holds(kind, match)


def base_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``rows`` (row, doc_id, text) of all documents, the text
    of those with base spans only; ``spans`` (row, kind, start, end, m), the
    kind by its place in ``KINDS``."""
    text = F.coalesce("text", F.lit(""))
    found = []
    for kind in KINDS:
        match = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9][\\x20-]?[0-9]")
        found.append(F.when(hint, match).alias(f"m_{kind}"))
    each = docs.select("doc_id", "text").select("doc_id", "text", *found)
    valid = F.lit(False)
    for kind in KINDS:
        valid = valid | F.coalesce(F.exists(F.col(f"m_{kind}"), holding(kind)), F.lit(False))
    each = each.select("doc_id", valid.alias("hit"), F.when(valid, F.col("text")).alias("text"),
                       *[F.when(valid, F.col(f"m_{k}")).alias(f"m_{k}") for k in KINDS])
    rows = scratch_table(each.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    hits = rows.where("hit")
    parts = None
    for number, kind in enumerate(KINDS):
        m = F.col(f"m_{kind}")
        own = hits.where(F.exists(m, holding(kind))).select("row", F.lit(number).alias("kind"), F.posexplode(
            F.arrays_zip(F.transform(F.split("text", PATTERNS[kind], -1), F.length).alias("gap"), m.alias("m"))).alias("pos", "x"))
        own = own.select("row", "kind", "pos", "x.gap", "x.m").where("m is not null")
        parts = own if parts is None else parts.unionByName(own)
    until = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)    # one document's matches
    placed = parts.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(until).cast("int"))
    good = F.lit(False)
    for number, kind in enumerate(KINDS):
        good = good | ((F.col("kind") == number) & holds(kind, F.col("m")))
    spans = placed.where(good).select("row", "kind", (F.col("end") - F.length("m")).alias("start"), "end", "m")
    return rows, scratch_table(spans, "pii-spans")


def rewritten(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, text): ``texts`` (row, text) with the ``spans`` (row, start, end,
    put) replaced by what they put; of overlapping spans the later put nothing.
    A null ``put`` stands for as many spaces as the span has characters. Texts
    are cut into chunks, so no long string is built piece by piece."""
    before = Window.partitionBy("row").orderBy("start", "end", "put").rowsBetween(Window.unboundedPreceding, -1)
    apart = (spans.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
             .select("row", F.greatest("start", "done").alias("start"), "end", F.when(F.col("put").isNull() | (F.col("start") >= F.col("done")), F.col("put")).otherwise("").alias("put"))
             .where("end > start"))
    cut = apart.select("*", F.explode(F.expr(f"sequence(start div {CHUNK}, (end - 1) div {CHUNK})")).alias("chunk"))
    lo = F.greatest(F.col("start") - F.col("chunk") * CHUNK, F.lit(0)).cast("int")
    hi = F.least(F.col("end") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int")
    put = F.when(F.col("put").isNull(), F.repeat(F.lit(" "), hi - lo)).when(F.col("start") >= F.col("chunk") * CHUNK, F.col("put")).otherwise("")
    cut = (cut.select("row", "chunk", F.struct(lo.alias("start"), hi.alias("end"), put.alias("put")).alias("s")).groupBy("row", "chunk").agg(F.sort_array(F.collect_list("s")).alias("s")))                     # at most CHUNK of them
    chunks = texts.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("chunk", "t"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.col("t").substr(acc["at"] + 1, s["start"] - acc["at"]), s["put"])
                        .alias("out"))

    new = F.aggregate("s", start, step, lambda a: F.concat(a["out"], F.col("t").substr(a["at"] + 1, F.length("t"))))
    joined = chunks.join(cut, ["row", "chunk"], "left").select("row", "chunk", F.when(F.col("s").isNull(), F.col("t")).otherwise(new).alias("t"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "t"))), lambda c: c["t"]), "")
    return joined.groupBy("row").agg(whole.alias("text"))


def units(word: Column) -> Column:
    """The terms of one word, each a code point after the one before."""
    return F.when(word.rlike(f"^{_CHARACTER}{{2}}"), F.regexp_extract_all(word, F.lit("(?s)(?=(..))."), F.lit(1))
                  ).otherwise(F.array(word))


def terms(text: Column) -> Column:
    """The distinct terms of a text, without case."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    found = F.when(text.rlike(_CHARACTER), F.flatten(F.transform(found, units))).otherwise(found)
    return F.array_distinct(F.transform(found, F.lower))


def least_hash(values: str, salt: int) -> Column:
    return F.array_min(F.transform(values, lambda t: F.xxhash64(F.lit(salt), t)))


def classes_of(entities: DataFrame) -> DataFrame:
    """(row, entity, entity_docs) of the entities in two documents or more;
    entities of the same documents become one."""
    shape = (entities.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs"), F.bit_xor(F.xxhash64("row")).alias("x"),
                                            F.bit_xor(F.xxhash64("row", F.lit(7))).alias("y")).where("entity_docs > 1"))
    named = shape.select("entity", "entity_docs", F.xxhash64("entity_docs", "x", "y").alias("group"))
    return (entities.join(named, "entity").select("row", F.col("group").alias("entity"), "entity_docs").distinct())


def first_contexts(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """``members`` (row, entity, ...) with ``first``: whether no earlier
    document of the entity shares a band of ``sketches`` (row, bands)."""
    band = (members.select("row", "entity").join(sketches, "row")
            .select("row", "entity", F.posexplode("bands").alias("i", "band")))
    least = band.groupBy("entity", "i", "band").agg(F.min("row").alias("least"))
    alone = (band.join(least, ["entity", "i", "band"]).groupBy("row", "entity")
             .agg(F.min((F.col("row") == F.col("least")).cast("int")).alias("first")))
    return members.join(alone, ["row", "entity"])


def lower_bound(both: Column, of: Column, contexts: Column) -> Column:
    """The lower Wilson bound of the share ``both / of``, over as many
    observations as make ``contexts`` of them hits."""
    p = both / of
    n = contexts / p
    z2 = Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosures(docs: DataFrame, rows: DataFrame, spans: DataFrame, masked: DataFrame) -> DataFrame:
    """(row, term, removed): the terms to hide in every document."""
    total = rows.count()
    entities = spans.select("row", F.concat_ws(":", "kind", F.lower("m")).alias("entity")).distinct()
    members = scratch_table(classes_of(entities), "pii-entities")
    words = (masked.join(members.select("row").distinct(), "row", "left_semi").select("row", terms(F.col("text")).alias("terms")))
    words = scratch_table(words.where(F.size("terms") > 0), "pii-words")
    least = [least_hash("terms", k) for k in range(BANDS * ROWS)]
    bands = F.array(*[F.xxhash64(*least[b * ROWS:(b + 1) * ROWS]) for b in range(BANDS)])
    members = first_contexts(members, words.select("row", bands.alias("bands")))
    near = (members.join(words.select("row", F.explode("terms").alias("term")), "row").groupBy("entity", "entity_docs", "term")
            .agg(F.count(F.lit(1)).alias("both"), F.sum("first").alias("contexts")).where("contexts > 1"))
    near = scratch_table(near, "pii-candidates")
    seen = (docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).join(near.select("term").distinct(), "term")
            .groupBy("term").agg(F.count(F.lit(1)).alias("term_docs")))
    bound = lower_bound(F.col("both"), F.col("term_docs"), F.col("contexts"))
    shown = (near.join(seen, "term").withColumn("bound", bound)
             .where((F.col("bound") >= GENERALISE) & (F.log2(F.col("bound") * total / F.col("entity_docs")) >= GAIN))
             .select("entity", "term", (F.col("bound") >= REMOVE).alias("removed")))
    return (members.select("row", "entity").join(shown, "entity").groupBy("row", "term").agg(F.max("removed").alias("removed")))


def term_spans(masked: DataFrame, hidden: DataFrame) -> DataFrame:
    """(row, start, end, removed): the places of the hidden terms."""
    some = masked.join(hidden.select("row").distinct(), "row", "left_semi")
    gaps = F.transform(F.split("text", WORD, -1), F.length)
    word = (some.select("row", F.posexplode(F.arrays_zip(
        gaps.alias("gap"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word"))).alias("pos", "x"))
        .select("row", "pos", "x.gap", "x.word").where("word is not null"))
    until = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)   # one document's words
    word = word.withColumn("start", (F.sum(F.col("gap") + F.length("word")).over(until) - F.length("word")).cast("int"))
    unit = (word.select("row", "start", F.posexplode(units(F.col("word"))).alias("i", "unit"))
            .select("row", F.lower("unit").alias("term"), (F.col("start") + F.col("i")).alias("start"),
                    (F.col("start") + F.col("i") + F.length("unit")).alias("end")))
    return unit.join(hidden, ["row", "term"]).select("row", "start", "end", "removed")


def all_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``rows`` as in ``base_spans``; ``spans`` (row, kind,
    start, end) with the terms as kinds ``len(KINDS)`` (removed) and one more
    (generalised)."""
    rows, base = base_spans(docs)
    blank = base.select("row", "start", "end", F.lit(None).cast("string").alias("put"))
    masked = scratch_table(rewritten(rows.where("hit").select("row", "text"), blank), "pii-masked")
    hidden = scratch_table(disclosures(docs, rows, base, masked), "pii-hidden")
    extra = term_spans(masked, hidden).select("row", F.when(F.col("removed"), len(KINDS)).otherwise(len(KINDS) + 1).alias("kind"),
                                              "start", "end")
    return rows, base.select("row", "kind", "start", "end").unionByName(extra)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end) of every row: base spans by
    kind as listed, then start, then terms, then generalised terms."""
    rows, spans = all_spans(docs.select("doc_id", "text"))
    each = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("s"))    # one document's
    names = F.array(*[F.lit(k) for k in SPANS])
    named = F.transform("s", lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.select("row", "doc_id").join(each, "row", "left").select("doc_id", F.coalesce(named, none).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(*kinds):
        return F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(span_text(base), 256)
                        .alias("base_sha256"), span_text(F.col("spans")).alias("spans"), count("term", "hint").alias("n_term"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans generalised to ``[KIND]``, terms removed or
    generalised to ``[TERM]``."""
    rows, spans = all_spans(docs.select("doc_id", "text"))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""), F.lit("[TERM]"))
    hits = rows.where("hit").select("row", "doc_id", "text")
    new = rewritten(hits.select("row", "text"), spans.select("row", "start", "end", F.get(tags, F.col("kind")).alias("put")))
    fixed = (hits.select("row", "doc_id", F.xxhash64("text").alias("hash")).join(new, "row")
             .select(F.col("doc_id").alias("id"), "hash", "text").dropDuplicates(["id", "hash"]))
    # the columns of documents lie in a struct: their names can't clash
    whole = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    both = whole.join(fixed, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left")
    return both.select(F.when(F.col("hash").isNull(), F.col("whole")).otherwise(F.col("whole").withField("text", F.col("text")))
                       .alias("whole")).select("whole.*")
