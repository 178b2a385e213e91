"""Language identification as two Spark jobs plus the native gate.

Model: character-trigram naive Bayes with add-one smoothing, trained on the
whole labelled texts; a row is classified from the whole of lower(strip(text)),
or its first ``sample`` characters: the language gate defines such a sample.

* train:  tasks count trigrams, ``groupBy(lang, gram).sum()`` -> profile.
* score:  the profile becomes one row per gram with ``ln(cnt + 1)`` of every
  language. A row's trigrams are exploded and meet it by ``gram``; one
  aggregate per row sums the weights of every language and counts its matches
  (summed on the map side when the weights are broadcast: one shuffle of one
  narrow row per text and partition). ``n_grams * ln(N_lang + V)`` is
  subtracted; the best language among those with any matching trigram wins
  (ties: smaller language code). A row with no trigram, or none known to the
  profile, gets NULL ("no answer").

The weights are an aggregate (distinct trigrams); they are broadcast only
after a check of their bytes, otherwise joined by shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.functions import text as T
from pagewright.session import maybe_broadcast, ship_package

COUNT_CHARS = 1 << 20


def _sample(text: Column, sample: int | None) -> Column:
    whole = F.lower(T.py_strip(text))
    return whole if sample is None else F.substring(whole, 1, sample)


def trigrams(s: Column) -> Column:
    """All overlapping 3-code-point windows of ``s`` in one regex pass: the
    lookahead captures the window and one whole code point is consumed, so
    the scan stays linear and never starts inside a surrogate pair (a
    ``substring(s, i, 3)`` per position re-walks the UTF-8 bytes: O(n^2))."""
    return F.regexp_extract_all(s, F.lit(r"(?s)(?=(.{3}))."), 1)


def _count_trigrams(batches):
    """(lang, gram, cnt) of rows (lang, cleaned text), summed up to ``COUNT_CHARS``
    characters of all languages at a time, longer texts in pieces: three code
    points of 21 bits make one integer."""
    def rows(lang, keys):
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        points = np.stack([key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF], axis=1).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()),
                                           pa.array([text[k:k + 3] for k in range(0, len(text), 3)], pa.string()),
                                           pa.array(n, pa.int64())], names=["lang", "gram", "cnt"])

    held, chars = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            if text is None or len(text) < 3:
                continue
            for k in range(0, len(text) - 2, COUNT_CHARS):
                c = np.frombuffer(text[k:k + COUNT_CHARS + 2].encode("utf-32-le"), "<u4").astype(np.int64)
                held.setdefault(lang, []).append(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
                chars += len(c)
                if chars >= COUNT_CHARS:
                    for name, keys in held.items():
                        yield rows(name, keys)
                    held, chars = {}, 0
    for lang, keys in held.items():
        yield rows(lang, keys)


def train_language(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Profile ``(lang, gram, cnt)`` from a labelled table, over whole texts
    (lower(strip(text))). Tasks count the trigrams of many texts at once, so
    no row per character is made and the shuffle gets one row per (part, lang,
    gram)."""
    ship_package(docs.sparkSession)
    return (docs.where(F.col(lang).isNotNull())
            .select(F.col(lang).alias("lang"), F.lower(T.py_strip(F.col(text))).alias("_s"))
            .mapInArrow(_count_trigrams, "lang string, gram string, cnt bigint")
            .groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt")))


def language_weights(profile: DataFrame) -> tuple[list[tuple[str, float]], DataFrame]:
    """The languages with their log denominators, by name, and (gram, w0, w1,
    ...): ``ln(cnt + 1)`` in every language, NULL where it has no such gram.
    Only one row per language and the vocabulary size reach the driver."""
    v = profile.agg(F.countDistinct("gram")).first()[0] or 0
    totals = profile.groupBy("lang").agg(F.sum("cnt").alias("n")).orderBy("lang").collect()
    langs = [(r["lang"], math.log(r["n"] + v)) for r in totals]
    columns = [F.max(F.when(F.col("lang") == lang, F.log(F.col("cnt") + 1))).alias(f"w{k}") for k, (lang, _) in enumerate(langs)]
    return langs, profile.groupBy("gram").agg(*(columns or [F.lit(None).cast("double").alias("w0")]))


def classify_language(df: DataFrame, keys: list[str], text: str, profile: DataFrame,
                      sample: int | None = None,
                      out: str = "lang_pred") -> DataFrame:
    """Adds ``out`` (predicted language or NULL) to ``df`` keyed by ``keys``."""
    langs, weights = language_weights(profile)
    if not langs:
        return df.withColumn(out, F.lit(None).cast("string"))
    grams = (df.select(*keys, _sample(F.col(text), sample).alias("_s"))
             .select(*keys, F.explode(trigrams(F.col("_s"))).alias("gram")))
    every = range(len(langs))
    sums = (grams.join(maybe_broadcast(weights), "gram", "left").groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"w{k}").alias(f"s{k}") for k in every]))
    # a language without any matching trigram has a NULL sum and no score
    scores = [F.when(F.col(f"s{k}").isNotNull(), F.struct((F.col("n") * den - F.col(f"s{k}")).alias("cost"), F.lit(lang).alias("lang")))
              for k, (lang, den) in enumerate(langs)]
    best = sums.select(*keys, F.array_min(F.array_compact(F.array(*scores)))["lang"].alias(out))
    return df.join(best, keys, "left")


def common_word_hit(cleaned: Column, whole_word: bool = False) -> Column:
    """C5 step 2: any common word as a substring (or as a whole word)."""
    cond = None
    for w in fixed.COMMON_ENGLISH_WORDS:
        c = cleaned.rlike(r"(^|[^\p{L}\p{N}_])" + w + r"($|[^\p{L}\p{N}_])") if whole_word \
            else cleaned.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def language_gate(df: DataFrame, keys: list[str], text: str, profile: DataFrame,
                  primary: str = fixed.PRIMARY_LANGUAGE,
                  min_length: int = fixed.LANGUAGE_MIN_LENGTH,
                  out: str = "lang_ok", whole_word: bool = False) -> DataFrame:
    """(1) strip+lower; (2) common word -> pass; (3) shorter than
    ``min_length`` -> pass; (4) classify; (5) no answer -> pass.
    Only rows reaching step 4 are sent to the classifier."""
    cleaned = F.lower(T.py_strip(F.col(text)))
    pre = df.withColumn("_quick", F.col(text).isNull() | common_word_hit(cleaned, whole_word)
                        | (F.length(cleaned) < min_length))
    need = pre.where(~F.col("_quick")).select(*keys, text)
    pred = classify_language(need, keys, text, profile, fixed.LANGUAGE_SAMPLE_CHARS, out="_pred").select(*keys, "_pred")
    res = pre.join(pred, keys, "left")
    ok = F.col("_quick") | F.col("_pred").isNull() | (F.col("_pred") == primary)
    return res.withColumn(out, ok).drop("_quick", "_pred")
