"""MinHash near-duplicates with tensored banding.

A document is the set of its distinct 2-word shingles; sets with a Jaccard
similarity of 0.8 or more are linked, and linked sets make components.

Tensoring: ``HALVES`` half-keys of ``ROWS`` minhashes are made in each of two
small collections u and v. Table (i, j) has the key (u_i, v_j), so 2 * HALVES *
ROWS minhashes serve HALVES**2 tables of 2 * ROWS values; as many tables of
independent bands would need HALVES**2 * 2 * ROWS. Two sets meet in some table
if one u_i and one v_j are equal. A pair at similarity 0.8 escapes all tables
with probability below 2 * (1 - 0.8**ROWS)**HALVES, about 6e-6.

1. Equal sets are one class. The HALVES tables (i, 1), (i, 2), ... lie together
   in the bucket of u_i, and only half-keys that two classes share make
   buckets: a class alone with a u_i is alone in all of those tables. Inside a
   bucket classes meet by equal v_j. Pairs with fewer than ``LEAST`` equal
   half-keys in all go (probability below 1e-6 at 0.8). A spanning forest leaves
   the bucket, never pairs.
2. The components of these forests are clusters of candidates.
3. Inside a cluster the links are confirmed on the full sets, and the
   components of the confirmed links are the result.

Buckets and clusters above ``BLOCK`` members, clusters also above
``BLOCK_BYTES`` of sets, are cut into blocks; see ``graph``.

Defined cases: a null, empty or wordless text has the empty set, is linked
with nothing and stays; a text of one word is that word as one shingle; rows
with equal sets are one class, and each gives a row; a null id is an id like
any other in grouping but never the least one unless all ids of a component
are null (component_id is null then); a row of a null id is kept only in such
a component or alone; an empty table gives an empty result; columns other than
doc_id and text are not read. Only A-Z are folded to lower case."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm import graph
from pagewright.llm.common import Texts, mix64, scratch_table, words

PCT = 80
ROWS, HALVES, LEAST = 4, 24, 5
BLOCK, BLOCK_BYTES = 512, 32 << 20
_K = 2 * HALVES * ROWS
_A = (mix64(np.arange(5001, 5001 + _K, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_B = mix64(np.arange(7001, 7001 + _K, dtype=np.uint64)).astype(np.uint32)
_FIRST, _SECOND, _ALONE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts: Texts):
    """The sorted distinct 2-word shingle hashes of every text."""
    for _, _, data, offs in texts.chunks():
        _, _, h, first = words(data, offs)
        for a, b in zip(first[:-1], first[1:], strict=True):
            w = h[a:b]
            yield np.unique(mix64(w[:-1] * _FIRST + w[1:] * _SECOND) if len(w) > 1 else mix64(w * _ALONE))


def half_keys(s: np.ndarray) -> np.ndarray:
    """The half-keys u_1 ... u_HALVES, v_1 ... v_HALVES of a set."""
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(_K, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, (low[at:at + 512, None] * _A + _B).min(0), out=least)
    rows = least.reshape(2 * HALVES, ROWS).astype(np.uint64)
    key = np.arange(2 * HALVES, dtype=np.uint64)
    for c in range(ROWS):
        key = mix64(key * _FIRST + rows[:, c] + np.uint64(1))
    return key.view(np.int64)


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k, halves) of every row; k names the set and is
    null if it is empty."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()),
                           T.StructField("k", T.BinaryType()), T.StructField("halves", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            n, k, halves = [], [], []
            for s in shingle_sets(Texts(batch.column(1))):
                n.append(len(s))
                k.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                halves.append(half_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.binary()),
                                              pa.array(halves, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """(node, cluster) of the classes that meet another one in a table."""
    half = classes.select("node", F.posexplode(F.slice("halves", 1, HALVES)).alias("i_u", "u"))
    met = half.groupBy("i_u", "u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucket = (half.join(met, ["i_u", "u"]).join(classes.select("node", "halves"), "node")
              .select(F.xxhash64("i_u", "u").alias("bucket"), "node", "n", "halves"))

    def run(batches):
        for rows in graph.group_runs(batches, ["bucket", "i", "j"]):
            node, at = rows["node"].to_numpy(), rows["at"].to_numpy()
            keys = rows["halves"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * HALVES)
            u, v = keys[:, :HALVES], keys[:, HALVES:]

            def near(a, left):
                same_u, same_v = (u[left] == u[a]).sum(1), (v[left] == v[a]).sum(1)      # noqa: B023
                return left[(same_u > 0) & (same_v > 0) & (same_u + same_v >= LEAST)]

            yield graph.edge_batch(node, graph.forest_edges(at, near))

    edges = (graph.in_blocks(bucket, "bucket", F.ceil(F.col("n") / BLOCK)).select("bucket", "i", "j", "at", "node", "halves")
             .mapInArrow(run, "a long, b long").distinct())
    return graph.components(edges, "tensor-candidates").withColumnRenamed("root", "cluster")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the classes of ``wanted(node, k, doc_id)``, from one
    row of each: the texts are read again, only members of clusters hash."""
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(Texts(batch.column(0)))]
            ok = pa.array([i for i, (s, k) in enumerate(zip(sets, batch.column(2).to_pylist(), strict=True))
                           if hashlib.blake2b(s, digest_size=16).digest() == k], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(ok), pa.array([sets[i.as_py()] for i in ok], pa.binary())],
                                             names=["node", "set"])

    rows = docs.select("doc_id", "text")
    head = wanted.select(F.col("doc_id").alias("head_id"), "node", "k")
    return (rows.join(head, F.col("doc_id").eqNullSafe(F.col("head_id"))).select("text", "node", "k")
            .mapInArrow(run, "node long, set binary").dropDuplicates(["node"]))


def confirmed(members: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links with similarity >= 0.8 on the
    full sets of ``members(cluster, node, set, n)``; n: the cluster's blocks."""
    def run(batches):
        for rows in graph.group_runs(batches, ["cluster", "i", "j"]):
            node, at = rows["node"].to_numpy(), rows["at"].to_numpy()
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows["set"]]
            size = np.array([len(s) for s in sets])
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.concatenate([[0], np.cumsum(size)])
            mark = np.zeros(int(code.max()) + 1, np.int64)

            def near(a, left):
                # of sets whose sizes differ too much none can reach the threshold
                left = left[(100 * np.minimum(size[left], size[a]) >= PCT * np.maximum(size[left], size[a]))]   # noqa: B023
                if not len(left):
                    return left
                own = code[start[a]:start[a + 1]]                                        # noqa: B023
                mark[own] = 1                                                            # noqa: B023
                both = np.array([mark[code[start[b]:start[b + 1]]].sum() for b in left])   # noqa: B023
                mark[own] = 0                                                            # noqa: B023
                return left[100 * both >= PCT * (size[left] + size[a] - both)]           # noqa: B023

            yield graph.edge_batch(node, graph.forest_edges(at, near))

    return (graph.in_blocks(members, "cluster", F.col("n")).select("cluster", "i", "j", "at", "node", "set")
            .mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    rows = scratch_table(hashed(docs), "tensor-rows")
    classes = graph.numbered(rows.where("k is not null").groupBy("k").agg(
        F.min("doc_id").alias("doc_id"), F.first("halves").alias("halves")), "tensor-classes")
    cluster = candidate_clusters(classes)
    members = scratch_table(sets_of(docs, classes.select("node", "k", "doc_id").join(cluster.select("node"), "node"))
                            .join(cluster, "node"), "tensor-sets")
    size = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(
        F.sum(F.length("set")) / BLOCK_BYTES)).alias("n"))
    root = graph.components(confirmed(members.join(size, "cluster")), "tensor-links")
    named = classes.select("node", "k", "doc_id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("k", "component_id")
    return (rows.select("doc_id", "n_shingles", "k").join(named, "k", "left")
            .select("doc_id", "n_shingles", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
