"""Structured Streaming forms of the incremental steps.

Every stream reads a file source, runs with ``trigger(availableNow=True)``
and writes under ``root`` (its sink and its streaming checkpoint). A caller
that names the same ``root`` again resumes where the query stopped; without
one, a new folder under the session's checkpoint root is taken. Inside
``foreachBatch`` every table is written as one partition per batch id and that
partition is overwritten, so a batch that runs again neither loses nor repeats
rows. The batch operators are reused there where a step needs joins or
aggregations that are not incremental by nature."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.session import ensure_checkpoint_dir


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works for any
    cluster storage, not only local disks)."""
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jp)


def _paths(spark: SparkSession, name: str, root: str | None) -> tuple[str, str]:
    root = root or os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    return os.path.join(root, "out"), os.path.join(root, "chk")


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A streaming read of ``{sf_dir}/{table}.parquet``, one file or a folder
    of part files (schema from the files)."""
    path = f"{sf_dir}/{table}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jp.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jp).isDirectory():
        return r.parquet(path)
    # a stream's path is a folder or a glob
    return r.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def batch_part(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def run_foreach(stream: DataFrame, name: str, fn, mode: str = "append", root: str | None = None) -> DataFrame:
    """Run ``fn(batch_df) -> DataFrame`` on every micro-batch; return the sink
    read back as a batch DataFrame with its ``batch_id``."""
    spark = stream.sparkSession
    out, chk = _paths(spark, name, root)

    def sink(batch: DataFrame, batch_id: int):
        fn(batch).write.mode("overwrite").parquet(batch_part(out, batch_id))

    q = (stream.writeStream.foreachBatch(sink).outputMode(mode)
         .option("checkpointLocation", chk).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_append(stream: DataFrame, name: str, root: str | None = None, progress: list | None = None) -> DataFrame:
    """Append-mode parquet file sink (exactly-once), read back. ``progress``
    takes the reports of the micro-batches."""
    spark = stream.sparkSession
    out, chk = _paths(spark, name, root)
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
    return spark.read.parquet(out)


# S1 ------------------------------------------------------------------------

def stream_extract(pages_stream: DataFrame, profile: DataFrame, root: str | None = None) -> DataFrame:
    """Streaming extraction + gates (stateless per page)."""
    from pagewright.functions.urls import site_of
    from pagewright.operators.extract import materialised
    from pagewright.plans.curate import gate_pages

    def step(batch):
        b = batch.withColumn("site", site_of("url"))
        return gate_pages(materialised(b), profile).select("site", "page_id", "title", "reason")

    return run_foreach(pages_stream, "extract", step, root=root).drop("batch_id")


# S2 ------------------------------------------------------------------------

def stream_dedup(stream: DataFrame, scope: list[str], key, watermark: tuple[str, str] | None = None,
                 root: str | None = None, progress: list | None = None) -> DataFrame:
    """Streaming exact de-duplication on (scope, key), for a title, content or
    code key: the first arrival wins. With ``watermark`` (event time column,
    delay) a key is forgotten once the watermark has passed it by the delay;
    without one the state keeps every key."""
    s = stream.withColumn("_key", key)
    if watermark:
        s = s.withWatermark(*watermark).dropDuplicatesWithinWatermark([*scope, "_key"])
    else:
        s = s.dropDuplicates([*scope, "_key"])
    return run_append(s, "dedup", root, progress)


# S3 ------------------------------------------------------------------------

#: Micro-batches after which the totals are summed up into one partition.
TOTALS_SNAPSHOT = 16


def stream_budget(ranked_stream: DataFrame, fraction: float = fixed.STOP_FRACTION,
                  root: str | None = None) -> DataFrame:
    """Streaming running budget per site. A site's rows of one micro-batch are
    taken in rank order (ties: fewer tokens first); a rank that comes in a later
    micro-batch counts after all rows of earlier ones.

    A micro-batch is totalled in range slices of (site, rank), so no site is one
    group, and the tokens used by earlier batches are added from a table of
    totals with a partition per batch id. A batch that runs again reads earlier
    ids only and overwrites its own. Every ``TOTALS_SNAPSHOT`` batches the
    partition holds the sums of all before it, so few are read."""
    from pagewright.operators.order import running_total
    from pagewright.session import scratch_table

    spark = ranked_stream.sparkSession
    out, chk = _paths(spark, "budget", root)
    totals = os.path.join(os.path.dirname(out), "totals")

    def earlier(batch_id: int) -> DataFrame:
        none = spark.createDataFrame([], "site string, used long")
        if batch_id == 0 or not path_exists(spark, totals):
            return none
        # the last snapshot and what came after it
        since = (batch_id - 1) // TOTALS_SNAPSHOT * TOTALS_SNAPSHOT
        held = spark.read.schema("site string, used long, batch_id long").parquet(totals)
        return (held.where((F.col("batch_id") >= since) & (F.col("batch_id") < batch_id))
                .groupBy("site").agg(F.sum("used").alias("used")))

    def sink(batch: DataFrame, batch_id: int):
        rows = batch.select("site", "rank", F.col("tokens").cast("long").alias("tokens"), "max_tokens")
        done = scratch_table(running_total(rows, ["site"], [("rank", True), ("tokens", True)], "tokens", "total"), "stream-budget")
        before = scratch_table(earlier(batch_id), "stream-totals")
        used = F.coalesce("used", F.lit(0)) + F.col("total") - F.col("tokens")
        (done.join(before, "site", "left").select("site", "rank", "tokens", used.alias("used_before"),
                                                  (used < F.col("max_tokens") * fraction).alias("kept"))
         .write.mode("overwrite").parquet(batch_part(out, batch_id)))
        own = done.groupBy("site").agg(F.sum("tokens").alias("used"))
        if batch_id % TOTALS_SNAPSHOT == 0:
            own = own.unionByName(before).groupBy("site").agg(F.sum("used").alias("used"))
        own.write.mode("overwrite").parquet(batch_part(totals, batch_id))

    q = (ranked_stream.writeStream.foreachBatch(sink).option("checkpointLocation", chk)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


# S4 ------------------------------------------------------------------------

def stream_usage_window(events_stream: DataFrame, window: str = "1 hour", watermark: str = "1 day",
                        root: str | None = None, slide: str | None = None) -> DataFrame:
    """Rollup of events over tumbling windows, or with ``slide`` over windows
    that overlap (for rates), in update mode: each micro-batch writes the
    windows it changed, and the latest batch that wrote a window holds its
    totals. Windows the watermark has passed leave the state, and
    rows that come later than that are dropped."""
    ev = events_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    agg = (ev.groupBy(F.window("ts", window, slide).alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value")))
    changed = run_foreach(agg, "usage_window", lambda b: b.select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total_value"), mode="update", root=root)
    last = F.max_by(F.struct("n", "total_value"), "batch_id").alias("last")
    return (changed.groupBy("window_start", "event_type").agg(last)
            .select("window_start", "event_type", "last.n", "last.total_value"))


# S5 ------------------------------------------------------------------------

#: Parts of the words that the index is packed by, and the folders they lie in.
INDEX_PARTS, INDEX_BUCKETS = 4096, 64


def stream_near_dup(docs_stream: DataFrame, scope: list[str], id_col: str, text: str,
                    order: list[tuple[str, bool]], reference: DataFrame | None = None,
                    root: str | None = None) -> DataFrame:
    """Streaming near-duplicate removal against the kept corpus.

    The word order is frozen when the stream starts (occurrences in
    ``reference``, without one in the first micro-batch; unseen words rarest);
    prefix filtering is exact under any fixed order, so prefixes indexed by
    earlier micro-batches stay valid. The corpus is the output with a narrow table
    of keys and the packed index; word sets are made of texts where they are needed
    and stored nowhere. Per micro-batch:
      1. later exact copies inside the batch are dropped (first copy wins);
      2. the batch meets itself and the persisted prefix index of kept documents
         (partitioned by a bucket of words, of which only the probed ones are
         read), and pairs are verified exactly; one with the corpus, an equal set or
         an exact key already kept drops the document;
      3. the rest are resolved first-wins among themselves, the corpus hits
         pre-decided as dropped;
      4. kept documents go to the output, their keys and prefix entries
         to the corpus tables, each into the partition of its batch id; a
         batch that runs again overwrites it and reads earlier batches only."""
    from pagewright.functions import text as T
    from pagewright.operators import dedup as DD
    from pagewright.session import BROADCAST_BYTES, scratch_table, small_batches, table_bytes

    spark = docs_stream.sparkSession
    out, chk = _paths(spark, "near_dup", root)
    root = os.path.dirname(out)
    keys_path, index_path = os.path.join(root, "corpus_keys"), os.path.join(root, "corpus_entries")
    order_path = os.path.join(root, "word_levels")
    if path_exists(spark, os.path.join(root, "corpus_words")):
        raise ValueError(f"{root} holds the corpus of an older version")
    extra = [c for c, _ in order if c not in scope and c != id_col]

    def freeze_order(texts):
        if not path_exists(spark, f"{order_path}/_SUCCESS"):     # frozen: a restart keeps it
            DD.slot_counts(texts, scope).write.mode("overwrite").parquet(order_path)

    if reference is not None:
        with small_batches(spark):
            freeze_order(reference.select(*scope, F.col(text).alias("w")))

    def bucketed(texts):
        # level 0 says nothing about later batches
        levels = DD.slot_levels(spark.read.schema("span int, levels binary").parquet(order_path))
        return DD.prefix_entries(texts, scope, levels, alone=False, parts=INDEX_PARTS).withColumn("tb", F.col("part") % INDEX_BUCKETS)

    def earlier(path, written, batch_id):
        schema = written.withColumn("batch_id", F.lit(0).cast("long")).schema
        return spark.read.schema(schema).parquet(path).where(F.col("batch_id") < batch_id).drop("batch_id")

    def sink(batch: DataFrame, batch_id: int):
        # a micro-batch has a session of its own
        with small_batches(spark), small_batches(batch.sparkSession):
            remove(batch, batch_id)

    def remove(batch: DataFrame, batch_id: int):
        own = batch.select(*scope, id_col, *extra, F.col(text).alias("_w"))
        texts = own.select(*scope, F.col("_w").alias("w"))
        prep = scratch_table(DD.named_sets(own.select(*scope, id_col, *extra, T.key_hash(T.content_key(F.col("_w"))).alias("_ck"), "_w"), scope),
                             "stream-sets")
        firsts = DD.first_wins(prep.select(*scope, id_col, *extra, "_ck"), scope, F.col("_ck"), order,
                               id_col, "_first").where("_first").select(id_col)
        reps = scratch_table(prep.join(firsts, id_col, "left_semi"), "stream-firsts")
        keys = reps.where("_n > 0").select(*scope, id_col, "_ck", "_n", "_k")
        freeze_order(texts)
        probe = bucketed(texts).withColumn("old", F.lit(False))
        words, corpus = prep.agg(F.sum("_n")).first()[0] or 0, None
        if path_exists(spark, keys_path) and path_exists(spark, index_path):
            corpus = earlier(keys_path, keys, batch_id)
            words += corpus.agg(F.sum("_n")).first()[0] or 0
            # every bucket is probed but by a batch of few words
            few = len(prep.head(INDEX_BUCKETS)) < INDEX_BUCKETS
            asked = [r.tb for r in probe.select("tb").distinct().collect()] if few else range(INDEX_BUCKETS)
            probe = probe.union(earlier(index_path, probe.drop("old"), batch_id).select("part", "entries", "tb", F.lit(True)).where(F.col("tb").isin(*asked)))
        cand = scratch_table(DD.candidate_pairs(probe, parts=DD.entry_parts(spark, words)), "stream-candidates")
        decided = None
        if corpus is not None:
            named = cand.select(F.col("a").alias("_k")).union(cand.select(F.col("b").alias("_k"))).distinct()
            ids = scratch_table(corpus.join(named, "_k", "left_semi").select(id_col).distinct(), "stream-asked")
            held = earlier(out, batch, batch_id)
            if table_bytes(ids) <= BROADCAST_BYTES:
                held = held.join(F.broadcast(ids), id_col, "left_semi")
            texts = texts.union(held.select(*scope, F.col(text).alias("w")))
        pairs = DD.set_pairs(texts, scope, cand)
        if corpus is not None:
            kept_sets = corpus.select("_k").distinct()
            beside = pairs.select(F.col("a").alias("x"), F.col("b").alias("_k")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("_k")))
            similar = beside.join(kept_sets, "_k", "left_semi").select(F.col("x").alias("_k")).union(kept_sets)
            hits = keys.dropna(subset=scope).join(similar, "_k", "left_semi") if scope else keys.join(similar, "_k", "left_semi")
            key_hits = reps.join(corpus.select(*scope, "_ck"), [*scope, "_ck"], "left_semi")
            decided = hits.select(F.col(id_col).alias("id")).union(key_hits.select(F.col(id_col).alias("id"))).distinct().withColumn("st", F.lit("D"))
        # equal sets: all but the first go, whatever is decided of the first
        member = DD.first_of_sets(reps, scope, id_col, order)
        later = scratch_table(member.where("id != representative").select(F.col("id").alias(id_col)), "stream-copies")
        single = reps.join(later, id_col, "left_anti")
        near = DD.near_dup_pairs(own, scope, id_col, "_w", order, materialized=True, named=single, pairs=pairs)
        verdict = DD.resolve_first_wins(near.select("a", "b"), decided=decided)
        dropped = verdict.where(~F.col("kept")).select(F.col("id").alias(id_col)).union(later)
        kept = scratch_table(reps.select(id_col).join(dropped, id_col, "left_anti"), "stream-kept")
        gone = scratch_table(prep.select(id_col).distinct().join(kept, id_col, "left_anti"), "stream-gone")
        rest = batch.join(kept, id_col, "left_semi")
        if table_bytes(gone) <= BROADCAST_BYTES:        # no text is shuffled
            rest = batch.where(F.col(id_col).isNotNull()).join(F.broadcast(gone), id_col, "left_anti")
        part = batch_part(out, batch_id)
        rest.write.mode("overwrite").parquet(part)
        keys.join(kept, id_col, "left_semi").write.mode("overwrite").parquet(batch_part(keys_path, batch_id))
        stored = spark.read.schema(batch.schema).parquet(part).select(*scope, F.col(text).alias("w"))
        bucketed(stored).write.mode("overwrite").partitionBy("tb").parquet(batch_part(index_path, batch_id))

    q = (docs_stream.writeStream.foreachBatch(sink).option("checkpointLocation", chk)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")
