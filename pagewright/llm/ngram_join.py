"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of folded 5-word shingles (all words of a shorter text make
one). Texts with equal sets are one class, named by its set's hash. MinHash
signatures are compared 32 values at a time and a pair goes as soon as the
posterior probability (uniform prior) that its similarity reaches 0.8 falls
below ``TOLERANCE``; the rest is verified exactly on the shingle sets. Groups
are connected components of the verified links.

1. Classes that share a MinHash band meet in that band's bucket. Their first
   ``EARLY`` values are compared and a spanning forest of the surviving pairs
   leaves the bucket: fewer rows than members, never pairs.
2. The components of those forests are the clusters. Both classes of every
   pair that survives pruning in some bucket are in one cluster.
3. Within a cluster the whole signatures go on being compared and the
   surviving pairs are verified. Every member leaves with its number of links
   and the least member they reach.

Buckets and clusters of more than ``BLOCK`` members, and clusters of more than
``BLOCK_BYTES``, are cut into blocks, and every pair of blocks is a task's
work, so no task holds a whole group; a member of a group of n is copied
up to 2 * n / BLOCK times (see ``graph``). A pair at similarity 0.8 escapes all ``BANDS`` bands of
``ROWS`` values with probability (1 - 0.8**6)**48, below 1e-6.

Defined cases: a null or wordless text is linked with nothing; repeated rows
and equal texts share a class; a null id is an id like any other; an empty
table gives an empty result; columns other than doc_id and text are not
read."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm import graph
from pagewright.llm.common import Texts, mix64, scratch_table, words

SHINGLE, PCT = 5, 80
ROWS, BANDS = 6, 48
STEP = 32
EARLY = 3 * STEP
TOLERANCE = 1e-6
BLOCK, BLOCK_BYTES = 512, 32 << 20
_K = ROWS * BANDS
_A = (mix64(np.arange(1, _K + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_B = mix64(np.arange(1001, 1001 + _K, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(texts: Texts):
    """The sorted distinct shingle hashes of every text."""
    for _, _, data, offs in texts.chunks():
        _, _, h, first = words(data, offs)
        for a, b in zip(first[:-1], first[1:], strict=True):
            w = h[a:b]
            if len(w) >= SHINGLE:
                total = sum(w[j:len(w) - SHINGLE + 1 + j] * np.uint64(2 * j + 3) for j in range(SHINGLE))
            else:
                total = np.array([np.add.reduce(w * np.arange(3, 2 * len(w) + 3, 2, dtype=np.uint64))] * min(len(w), 1),
                                 np.uint64)
            yield np.unique(mix64(total))


def signature(s: np.ndarray) -> np.ndarray:
    low = s.astype(np.uint32)
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at:at + 512, None] * _A + _B).min(0), out=out)
    return out


def least_matches() -> list[int]:
    """For 32, 64, ... compared values: the fewest equal ones at which the
    posterior of similarity >= 0.8 is still at or above the tolerance."""
    s = np.linspace(0.0005, 0.9995, 1000)
    out = []
    for n in range(STEP, _K + 1, STEP):
        for m in range(n + 1):
            like = np.exp(m * np.log(s) + (n - m) * np.log(1 - s) - (m * math.log(max(m, .5) / n)
                          + (n - m) * math.log(max(n - m, .5) / n)))
            if like[s >= PCT / 100].sum() / like.sum() >= TOLERANCE:
                out.append(m)
                break
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, k, sig, bands) of every row; k is null without words."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("k", T.BinaryType()),
                           T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        factor = mix64(np.arange(7, 7 + ROWS, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            rows = []
            for s in shingle_sets(Texts(batch.column(1), lower=True)):
                if not len(s):
                    rows.append((None, None, None))
                    continue
                sig = signature(s)
                band = mix64((sig.reshape(BANDS, ROWS).astype(np.uint64) * factor).sum(1)
                             + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.astype(np.uint8).tobytes(),
                             band.view(np.int64)))
            k, sig, bands = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(k, pa.binary()), pa.array(sig, pa.binary()),
                                              pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, set) of the classes of ``members(doc_id, text_hash, node, k)``."""
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(Texts(batch.column(0), lower=True))]
            ok = [i for i, (s, k) in enumerate(zip(sets, batch.column(2).to_pylist(), strict=True))
                  if hashlib.blake2b(s, digest_size=16).digest() == k]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(ok, pa.int64())),
                                              pa.array([sets[i] for i in ok], pa.binary())], names=["node", "set"])

    rows = docs.select("doc_id", "text")
    head = members.select(F.col("doc_id").alias("head_id"), F.col("text_hash").alias("head_hash"), "node", "k")
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.xxhash64("text") == F.col("head_hash"))
    return (rows.join(head, same).select("text", "node", "k")
            .mapInArrow(run, "node long, set binary").dropDuplicates(["node"]))


def survivors(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of ``y`` whose values equal those of ``x`` often enough, compared
    32 at a time; a row is out at the first step it fails."""
    keep, same = np.arange(len(y)), np.zeros(len(y), np.int64)
    for n, m in zip(range(0, len(x), STEP), least, strict=False):
        same = same + (y[keep, n:n + STEP] == x[n:n + STEP]).sum(1)
        ok = same >= m
        keep, same = keep[ok], same[ok]
        if not len(keep):
            break
    return keep


def bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def clusters(reps: DataFrame) -> DataFrame:
    """(node, cluster) of the classes with a candidate that survives."""
    band = reps.select("node", F.explode("bands").alias("band"))
    count = band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = (band.join(count, "band")
              .join(reps.select("node", F.expr(f"substring(sig, 1, {EARLY})").alias("sig")), "node"))
    least = least_matches()

    def run(batches):
        for rows in graph.group_runs(batches, ["band", "i", "j"]):
            x = bytes_matrix(rows["sig"], EARLY)
            edges = graph.forest_edges(rows["at"].to_numpy(), lambda i, left: left[survivors(x[i], x[left], least)])  # noqa: B023
            yield graph.edge_batch(rows["node"].to_numpy(), edges)

    dealt = graph.in_blocks(shared, "band", F.ceil(F.col("n") / BLOCK))
    edges = dealt.select("band", "i", "j", "at", "node", "sig").mapInArrow(run, "a long, b long").distinct()
    return graph.components(edges, "join-candidates").withColumnRenamed("root", "cluster")


def overlaps_of(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of slices of the
    incidence matrix over the shingles that two sets or more hold."""
    size = len(sets)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(size), [len(s) for s in sets])
    shared = times[place] > 1
    row, place = row[shared], (np.cumsum(times > 1) - 1)[place[shared]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total = np.zeros((size, size), np.int64)
    for lo in range(0, int((times > 1).sum()), 4096):
        a, b = np.searchsorted(place, (lo, lo + 4096))
        part = np.zeros((size, 4096), np.float32)
        part[row[a:b], place[a:b] - lo] = 1
        total += (part @ part.T).astype(np.int64)      # counts up to 4,096 are exact in float32
    return total


def verified(rows: pa.Table, least: list[int]) -> np.ndarray:
    """Which pairs of a pair of blocks are linked (symmetric, no diagonal)."""
    x, at = bytes_matrix(rows["sig"], _K), rows["at"].to_numpy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows["set"]]
    across = rows["i"][0].as_py() != rows["j"][0].as_py()
    out = np.zeros((len(x), len(x)), bool)
    for i in range(len(x) - 1):
        rest = np.arange(i + 1, len(x))
        if across:
            rest = rest[at[rest] != at[i]]
        out[i, rest[survivors(x[i], x[rest], least)]] = True
    first, second = np.nonzero(out)
    if not len(first):
        return out
    if len(first) > 4 * len(x):
        both = overlaps_of(sets)[first, second]
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                         for a, b in zip(first, second, strict=True)])
    sizes = np.array([len(s) for s in sets])
    ok = 100 * both >= PCT * (sizes[first] + sizes[second] - both)
    out[:] = False
    out[first[ok], second[ok]] = True
    return out | out.T


def linked(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, n): for every class of a cluster and every pair of blocks it is
    in, its links (n) and the least class (b) that these links reach."""
    near = clusters(reps)
    sets = scratch_table(sets_of(docs, reps.select("doc_id", "text_hash", "node", "k").join(near.select("node"), "node"))
                         .join(near, "node"), "join-sets")
    size = sets.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(
        F.sum(F.length("set")) / BLOCK_BYTES)).alias("blocks"))
    members = sets.join(reps.select("node", "sig"), "node").join(size, "cluster")
    least = least_matches()

    def run(batches):
        for rows in graph.group_runs(batches, ["cluster", "i", "j"]):
            links, node = verified(rows, least), rows["node"].to_numpy()
            up = graph.labels(np.arange(len(node)), lambda i, left: left[links[i, left]])  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[up]), pa.array(links.sum(1), pa.int64())],
                                             names=["a", "b", "n"])

    dealt = graph.in_blocks(members, "cluster", F.col("blocks"))
    return scratch_table(dealt.select("cluster", "i", "j", "at", "node", "sig", "set")
                         .mapInArrow(run, "a long, b long, n long"), "join-links")


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, k, ...) of every row, and (k, root, class_id,
    n_links, head) of every class; ``head`` is the class's first row."""
    sigs = scratch_table(signatures(docs), "join-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("head")      # null ids last
    reps = graph.numbered(sigs.where("k is not null").groupBy("k").agg(
        first, F.first("sig").alias("sig"), F.first("bands").alias("bands")).select("head.doc_id", "head.text_hash", "*"),
        "join-classes")
    found = linked(docs, reps)
    count = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    root = graph.components(found.where("a != b").select("a", "b").distinct(), "join-roots")
    classes = (reps.select("node", "k", "doc_id", "head").join(root, "node", "left").join(count, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return sigs, classes.join(least, "root").select("k", "root", "class_id", "n_links", "head")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: class_id is the least id of
    its group, n_links the number of other texts its text is linked with."""
    sigs, named = groups(docs)
    return (sigs.select("doc_id", "k").join(named, "k", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), "k"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: the least id (null last), and of several
    texts with that id one. Texts without words are in no group and stay; rows
    that repeat id and text count once."""
    sigs, named = groups(docs)
    kept = (named.groupBy("root").agg(F.min("head").alias("head")).select("head.doc_id", "head.text_hash")
            .unionByName(sigs.where("k is null").select("doc_id", "text_hash")).distinct()
            .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    repeated = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_r"))
    one = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"]), "left_semi")
    same = one["doc_id"].eqNullSafe(repeated["_r"])
    return (one.join(repeated, same, "left_anti")
            .unionByName(one.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])))
