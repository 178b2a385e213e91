"""Quality classifier: random-indexing word vectors pooled per document, then
a two-layer network with temperature-calibrated probabilities.

Tokens (runs of letters or digits, and runs of symbols, case kept) hash to
``BUCKETS`` word slots. Each slot has a fixed sparse ternary index vector; a
slot's word vector is the sum of the index vectors of its neighbours within
``WINDOW`` tokens, over every text of the corpus (Sahlgren). Tasks sum their
own texts into one matrix and emit it in blocks, so the shuffle carries 1 MB a
task and what is broadcast has the fixed size BUCKETS x DIMS. A document is
the mean and the spread of its tokens' unit vectors. The network is fitted on
a bounded sample, the ``FIT_ROWS`` labelled learning rows with the smallest
id hash; a quarter of them sets the temperature.

Defined cases: a null or empty text pools to the zero vector and is scored
like any other; repeated rows each give a row and count in the corpus as
often as they occur; an id labelled twice takes the smaller label; without
learnable labels of both classes every score is the share of good labels (0.5
without any); an empty table gives an empty result; of ``docs`` only doc_id
and text are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import Texts, fold_of, mix64, one_label, words

BUCKETS, DIMS, NONZERO, WINDOW = 8192, 32, 4, 2
BLOCK = 64                     # buckets a shuffled row holds
FIT_ROWS = 12_000
HIDDEN = 24
THRESHOLD = 0.3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the nonzero entries of every slot."""
    h = mix64(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    place = np.stack([(h >> np.uint64(8 * j)) % np.uint64(DIMS) for j in range(NONZERO)], 1).astype(np.int64)
    sign = np.stack([1 - 2 * ((h >> np.uint64(40 + j)) & np.uint64(1)).astype(np.int64) for j in range(NONZERO)], 1)
    return place, sign


_PLACE, _SIGN = index_vectors()


def slots(data: np.ndarray, offs: np.ndarray):
    """Word slot of every token, and each row's first token."""
    _, _, h, first = words(data, offs, fold=False, kind="runs")
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), first


def context_sums(texts: Texts, total: np.ndarray) -> None:
    """Add the index vectors of all neighbours to ``total`` (flat)."""
    for _, _, data, offs in texts.chunks():
        slot, first = slots(data, offs)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for gap in range(1, WINDOW + 1):
            same = np.flatnonzero(row[gap:] == row[:-gap])
            a, b = slot[same], slot[same + gap]
            for word, near in ((a, b), (b, a)):
                for j in range(NONZERO):
                    total += np.bincount(word * DIMS + _PLACE[near, j], _SIGN[near, j],
                                         minlength=BUCKETS * DIMS).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all slots, from every text of ``docs``."""
    blocks = BUCKETS // BLOCK

    def emit(total):
        parts = total.reshape(blocks, BLOCK * DIMS)
        at = np.flatnonzero(parts.any(1))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)),
                                           pa.array([parts[k].tobytes() for k in at], pa.binary())],
                                          names=["block", "sums"])

    def count(batches):
        total = np.zeros(BUCKETS * DIMS, np.int64)
        for batch in batches:
            context_sums(Texts(batch.column(0)), total)
        yield emit(total)

    def merge(batches):
        total = np.zeros((blocks, BLOCK * DIMS), np.int64)
        for batch in batches:
            for k, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] += np.frombuffer(sums.as_buffer(), np.int64)
        yield emit(total)

    schema = "block int, sums binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(merge, schema).collect()
    total = np.zeros((blocks, BLOCK * DIMS))
    for part in parts:                                  # BUCKETS x DIMS numbers, whatever the corpus
        total[part["block"]] += np.frombuffer(part["sums"], np.int64)
    vectors = total.reshape(BUCKETS, DIMS)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of every text."""
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    for lo, hi, data, offs in texts.chunks(1 << 20):
        slot, first = slots(data, offs)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            rows, size = vectors[slot], np.diff(first)[full, None]
            mean = np.add.reduceat(rows, first[full], axis=0) / size
            square = np.add.reduceat(rows * rows, first[full], axis=0) / size
            out[lo + full, :DIMS] = mean
            out[lo + full, DIMS:] = np.sqrt(np.maximum(square - mean * mean, 0.0))
    return out


# -- the network ----------------------------------------------------------------

def train(x: np.ndarray, y: np.ndarray, seed: int = 3, steps: int = 600, rate: float = 0.02) -> dict:
    """Two dense layers by Adam on the log loss, then one temperature."""
    if len(y) < 8 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    tune = np.arange(len(y)) % 4 == 3
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    xt, yt = x[~tune], y[~tune]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(yt), min(512, len(yt)))
        xb, yb = xt[pick], yt[pick]
        hidden = np.tanh(xb @ w[0] + w[1])
        miss = (_sigmoid(hidden @ w[2] + w[3]) - yb) / len(yb)
        back = miss[:, None] * w[2] * (1 - hidden ** 2)
        grads = [xb.T @ back + 1e-3 * w[0], back.sum(0), hidden.T @ miss + 1e-3 * w[2], miss.sum(keepdims=True)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    logit = np.tanh(x[tune] @ w[0] + w[1]) @ w[2] + w[3]
    grid = np.geomspace(0.2, 20.0, 120)
    loss = [np.mean(np.logaddexp(0, np.where(y[tune] == 1, -logit, logit) / t)) for t in grid]
    return {"mean": mean, "scale": scale, "w": w, "temperature": float(grid[int(np.argmin(loss))])}


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def probability(net: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in net:
        return np.full(len(x), net["constant"])
    w = net["w"]
    logit = np.tanh((x - net["mean"]) / net["scale"] @ w[0] + w[1]) @ w[2] + w[3]
    return _sigmoid(logit / net["temperature"])


# -- Spark ------------------------------------------------------------------------

def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, dict]:
    """(word vectors, network)."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    picked = (one_label(labels.where(fold_of("doc_id", 5) != 0), "quality")
              .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows))

    def pool(batches):
        for batch in batches:
            x = pooled(Texts(batch.column(0)), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1),
                                              batch.column(2)], names=["x", "y", "h"])

    sample = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y", "h")
              .mapInArrow(pool, "x binary, y int, h long").toPandas().sort_values(["h", "x"]))
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(-1, 2 * DIMS).astype(np.float64)
    return vectors, train(x, sample["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: tuple[np.ndarray, dict]) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # BUCKETS x DIMS and the network
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        vectors, net = shared.value
        for batch in batches:
            x = pooled(Texts(batch.column(1)), vectors).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(net, x))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
