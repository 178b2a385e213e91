"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features of a text are the distinct hashes (``BITS`` bits) of its folded
words, of adjacent word pairs and of pairs with one word between. FTRL
(McMahan et al.) learns online with a rate per coordinate; its L1 term leaves
most weights exactly zero, so the weights sent to the executors are the
nonzero ones only, at most 2**BITS of them. The classifier is fitted on a
bounded sample: the ``FIT_ROWS`` labelled learning rows with the smallest id
hash, streamed in hash order through one task, ``EPOCHS`` times.

Defined cases: a null or empty text has no features and scores by the bias
alone; repeated rows each give a row and, if labelled, each teach; an id
labelled twice takes the smaller label; without learnable labels every score
is 0; an empty table gives an empty result; of ``docs`` only doc_id and text
are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import Texts, fold_of, mix64, one_label, words

BITS = 20
FIT_ROWS = 24_000
EPOCHS = 4
TOXIC_STEPS = 3                # toxic rows are the rare class: each is learned this often
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1
THRESHOLD = 0.5
_PAIR, _SKIP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def feature_rows(data: np.ndarray, offs: np.ndarray, allowed: np.ndarray | None = None):
    """(row, feature) of all distinct features of some texts, sorted by row;
    only the ``allowed`` features if given."""
    _, _, h, first = words(data, offs, kind="letters")
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    near, far = row[1:] == row[:-1], row[2:] == row[:-2]
    hashes = np.concatenate([h, mix64(h[:-1] * _PAIR + h[1:])[near], mix64(h[:-2] * _SKIP + h[2:])[far]])
    rows = np.concatenate([row, row[1:][near], row[2:][far]])
    ids = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    if allowed is not None:
        keep = allowed[ids]
        rows, ids = rows[keep], ids[keep]
    return np.divmod(np.unique((rows << BITS) | ids), 1 << BITS)


class Ftrl:
    """Per-coordinate FTRL-proximal; the bias is unregularised."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z = self.z[ids]
        active = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -active / ((BETA + np.sqrt(self.n[ids])) / ALPHA + L2)

    def bias(self) -> float:
        return -self.bias_z / ((BETA + np.sqrt(self.bias_n)) / ALPHA)

    def learn(self, ids: np.ndarray, label: int) -> None:
        weight, bias = self.weights(ids), self.bias()
        miss = sigmoid(weight.sum() + bias) - label
        step = (np.sqrt(self.n[ids] + miss * miss) - np.sqrt(self.n[ids])) / ALPHA
        self.z[ids] += miss - step * weight
        self.n[ids] += miss * miss
        step = (np.sqrt(self.bias_n + miss * miss) - np.sqrt(self.bias_n)) / ALPHA
        self.bias_z += miss - step * bias
        self.bias_n += miss * miss


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature ids, weights, bias) fitted on at most ``rows`` labelled ids
    whose crc32 is not 0 modulo 5."""
    picked = (one_label(labels.where(fold_of("doc_id", 5) != 0), "toxic")
              .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")    # ``rows`` rows at most

    def extract(batches):
        for batch in batches:
            texts, parts = Texts(batch.column(0), lower=True), []
            for lo, hi, data, offs in texts.chunks():
                row, ids = feature_rows(data, offs)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                parts += [ids[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), batch.column(1), batch.column(2)],
                                             names=["ids", "y", "h"])

    def fit(batches):
        model, seen = Ftrl(), 0
        for batch in batches:
            for ids, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for _ in range(TOXIC_STEPS if y else 1):
                    model.learn(np.frombuffer(ids.as_buffer(), np.int32), y)
                seen += 1
        every = np.arange(1 << BITS)
        weight = model.weights(every)
        at = np.flatnonzero(weight)
        bias = model.bias() if seen else -40.0
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)),
                                          pa.array(np.append(weight[at], bias))], names=["id", "w"])

    features = sample.select("text", "y", "h").mapInArrow(extract, "ids binary, y int, h long")
    ordered = (features.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
               .repartition(1).sortWithinPartitions("epoch", "h", "ids"))
    out = ordered.select("ids", "y").mapInArrow(fit, "id int, w double").toPandas()
    bias = out.loc[out["id"] < 0, "w"]
    out = out[out["id"] >= 0]
    return out["id"].to_numpy(), out["w"].to_numpy(), float(bias.iloc[0]) if len(bias) else -40.0


def scores(texts: Texts, dense: np.ndarray, bias: float) -> np.ndarray:
    total = np.zeros(len(texts))
    allowed = dense != 0
    for lo, hi, data, offs in texts.chunks():
        row, ids = feature_rows(data, offs, allowed)
        total[lo:hi] = np.bincount(row, dense[ids], minlength=hi - lo)
    return sigmoid(total + bias) if bias > -40.0 else total


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        ids, weights, bias = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[ids] = weights
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(Texts(batch.column(1), lower=True), dense, bias))],
                                             names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
