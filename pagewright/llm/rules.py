"""Quality rules: statistics of every whole text, two hard rules, and an
isolation forest over the statistics.

The forest (Liu, Ting and Zhou) splits a random statistic at a random value;
a document that few splits set apart has a short path and a high anomaly
score ``2 ** (-mean path / c(sample))``. Trees are grown on subsamples of a
bounded sample of documents (``FIT_ROWS``, the rows with the smallest hash of
id and statistics); the threshold is calibrated on all labelled rows.

Defined cases: a null or empty text has all statistics 0 and fails the word
rule; repeated rows each give a row; equal scores get equal verdicts; with no
labels (or no labelled row of one class) the forest rejects nothing; an empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import (WHITESPACE, Texts, fold_of, mix64, one_label, row_sums, scratch_table, words)

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
FIT_ROWS = 8192            # rows the forest is grown on
TREES = 128
TREE_ROWS = 256
BINS = 2000                # resolution of the calibrated threshold
FALSE_WEIGHT = 10.0        # cost of rejecting a good row against keeping a bad one

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?{}[]\\~^"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif line.strip(WHITESPACE):
            seen.add(line)
    return repeated


def _repeat_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each row lying in a 3-word window that the row holds twice or
    more, every occurrence included."""
    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(row[2:] == row[:-2])
        key = mix64(hashes[at] * np.uint64(3) + hashes[at + 1] * np.uint64(5) + hashes[at + 2] * np.uint64(7))
        key = mix64(key + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(key)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            slot = np.minimum(np.searchsorted(again, key), len(again) - 1)
            at = at[again[slot] == key]
            covered[at] = covered[at + 1] = covered[at + 2] = True
    return row_sums(covered, first)


def text_stats(texts: Texts) -> dict[str, np.ndarray]:
    """The statistics of every row, as int64 arrays."""
    out = {name: np.zeros(len(texts), np.int64) for name in STATS}
    solid = np.ones(256, bool)
    solid[[ord(c) for c in WHITESPACE]] = False
    solid[0x80:0xC0] = False           # continuation bytes start no code point
    for lo, hi, data, offs in texts.chunks():
        _, _, hashes, first = words(data, offs, fold=False)
        out["n_words"][lo:hi] = np.diff(first)
        for name, kind in (("word_chars", solid), ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK)):
            out[name][lo:hi] = row_sums(kind[data], offs)
        out["n_repeat_words"][lo:hi] = _repeat_words(hashes, first)
    for i, text in enumerate(texts.strings()):
        out["n_dup_lines"][i] = _dup_lines(text)
    return out


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PCT * stats["n_words"])


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics free of length, on the coarse steps a rule would name
    (whole characters of mean word length, tenths of the ratios), so that
    ordinary documents share a few dense points and odd ones stand apart.
    Repeated words and lines are left to the hard rule and the report."""
    s = {k: np.asarray(v, np.float64) for k, v in stats.items()}
    n = np.maximum(s["n_words"], 1)
    chars = np.maximum(s["word_chars"], 1)
    ratios = np.stack([s["n_symbols"] / n, s["n_upper"] / chars, s["n_marks"] / n], 1)
    return np.column_stack([np.round(np.minimum(chars / n, 20)), np.round(np.minimum(ratios, 2) * 10) / 10])


# -- the forest ---------------------------------------------------------------

def _path_term(n):
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    big = np.maximum(n, 2.0)
    harmonic = np.log(big - 1.0 + 1e-12) + 0.5772156649015329
    return np.where(n > 2, 2.0 * harmonic - 2.0 * (big - 1.0) / big, np.where(n == 2, 1.0, 0.0))


def grow_forest(x: np.ndarray, seed: int = 7, trees: int = TREES, tree_rows: int = TREE_ROWS) -> dict | None:
    """Arrays of ``trees`` complete binary trees: split column (-1: leaf),
    split value and path length at each node. None for no rows."""
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    column, value, path = (np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes)))
    for t in range(trees):
        stack = [(0, 0, rng.choice(len(x), size, replace=False))]
        while stack:
            node, level, rows = stack.pop()
            low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (0, 0)
            open_columns = np.flatnonzero(high > low) if len(rows) else ()
            if level == depth or len(rows) <= 1 or not len(open_columns):
                path[t, node] = level + _path_term(len(rows))
                continue
            c = rng.choice(open_columns)
            cut = rng.uniform(low[c], high[c])
            column[t, node], value[t, node] = c, cut
            left = x[rows, c] <= cut
            stack += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
    return {"column": column, "value": value, "path": path, "depth": depth, "norm": float(max(_path_term(size), 1e-9))}


def anomaly(forest: dict | None, x: np.ndarray) -> np.ndarray:
    """Anomaly score of every row, 0 to 1."""
    if forest is None or not len(x):
        return np.zeros(len(x))
    rows, total = np.arange(len(x)), np.zeros(len(x))
    for column, value, path in zip(forest["column"], forest["value"], forest["path"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(forest["depth"]):
            c = column[node]
            child = 2 * node + 1 + (x[rows, np.maximum(c, 0)] > value[node])
            node = np.where(c >= 0, child, node)
        total += path[node]
    return 2.0 ** (-total / len(forest["path"]) / forest["norm"])


# -- Spark ---------------------------------------------------------------------

def stats_table(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every row of ``docs``."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in STATS]])

    def run(batches):
        for batch in batches:
            stats = text_stats(Texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(stats[n]) for n in STATS]],
                                             names=["doc_id", *STATS])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _scored(stats: DataFrame, forest: dict | None) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(forest)   # TREES * 511 nodes: bounded

    @F.pandas_udf("double")
    def score(frame):
        import pandas as pd
        return pd.Series(anomaly(shared.value, features({n: frame[n].to_numpy() for n in STATS})))

    return stats.withColumn("anomaly", score(F.struct(*STATS)))


def fit_forest(stats: DataFrame, rows: int = FIT_ROWS) -> dict | None:
    """The forest of the ``rows`` rows with the smallest hash among those
    that pass the base rules (a bounded sample, as the method takes)."""
    passing = stats.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PCT} * n_words")
    picked = (passing.select(F.xxhash64("doc_id", *STATS).alias("h"), *STATS)
              .orderBy("h", *STATS).limit(rows).toPandas())
    return grow_forest(features({n: picked[n].to_numpy() for n in STATS}))


def calibrate(scored: DataFrame, labels: DataFrame, weight: float = FALSE_WEIGHT) -> float:
    """The rejection threshold, from score histograms of all labelled rows
    that pass the base rules: it maximises (share of bad rows rejected) -
    ``weight`` * (share of good rows rejected), the highest such threshold.
    Rows held out elsewhere (crc32 mod 5 = 0) are not used."""
    known = (scored.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PCT} * n_words")
             .select("doc_id", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
             .join(one_label(labels.where(fold_of("doc_id", 5) != 0), "quality"), "doc_id")
             .groupBy("bin").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).toPandas())
    if not len(known) or known.good.sum() == 0 or known.bad.sum() == 0:
        return 2.0
    known = known.sort_values("bin", ascending=False)
    good, bad = (known[c].cumsum().to_numpy() / known[c].sum() for c in ("good", "bad"))
    gain = bad - weight * good
    best = int(np.argmax(gain))          # the first: the highest threshold
    return float(known["bin"].to_numpy()[best]) / BINS if gain[best] > 0 else 2.0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict | None, float]:
    """(statistics with anomaly scores, forest, threshold) of all documents.
    The narrow statistics are written once to the shared folder."""
    stats = scratch_table(stats_table(docs), "rules-stats")
    forest = fit_forest(stats)
    scored = _scored(stats, forest)
    return scored, forest, calibrate(scored, labels)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, anomaly score and verdict of every document."""
    scored, _, threshold = fit(docs, labels)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return (scored.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))
            .withColumn("threshold", F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged. Verdicts are
    computed from each row's own text, so no join back is needed."""
    _, forest, threshold = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            stats = text_stats(Texts(batch.column(batch.schema.get_field_index("text"))))
            ok = ~base_failed(stats) & (anomaly(shared.value, features(stats)) < threshold)
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
