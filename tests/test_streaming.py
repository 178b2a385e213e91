"""Streaming forms equal their batch operators."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pagewright.operators import dedup as DD
from pagewright.plans import common as C
from pagewright.streaming import streams as ST


def test_stream_near_dup_over_several_batches_equals_batch(spark):
    docs = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    d = tempfile.mkdtemp(prefix="pw-stream-src-")
    # five files in doc_id order; one file per micro-batch, oldest first
    rows = docs.orderBy("doc_id").collect()
    k = (len(rows) + 4) // 5
    for i in range(5):
        part = rows[i * k:(i + 1) * k]
        spark.createDataFrame(part, docs.schema).coalesce(1).write.parquet(os.path.join(d, f"b{i}"))
        os.utime(os.path.join(d, f"b{i}"))
    files = sorted(os.path.join(root, f) for root, _, fs in os.walk(d) for f in fs if f.endswith(".parquet"))
    flat = tempfile.mkdtemp(prefix="pw-stream-flat-")
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"part{i}.parquet"))
        os.utime(os.path.join(flat, f"part{i}.parquet"), (1_000_000 + i, 1_000_000 + i))
    stream = (spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(flat))
    got = {r.doc_id for r in ST.stream_near_dup(stream, [], "doc_id", "text", [("doc_id", True)],
                                                 reference=docs).select("doc_id").collect()}
    b = DD.fuzzy_dedup(docs, [], "doc_id", "text", [("doc_id", True)])
    want = {r.doc_id for r in b.where(~F.col("dup_exact") & ~F.col("dup_fuzzy")).collect()}
    assert got == want and len(want) == 176


def test_stream_budget_equals_batch(spark):
    from pagewright.operators.accounting import budget_cut
    from pagewright.functions.text import token_estimate
    d = "/root/testdata/sf0.001"
    s = ST.file_stream(spark, d, "documents")
    ranked = s.select(F.col("source").alias("site"), F.col("doc_id").alias("rank"),
                      token_estimate(F.col("text")).alias("tokens"), F.lit(20000).alias("max_tokens"))
    got = {(r.site, r.rank) for r in ST.stream_budget(ranked).where("kept").collect()}
    docs = C.table(spark, d, "documents")
    rb = docs.select(F.col("source").alias("site"), F.col("doc_id").alias("rank"),
                     token_estimate(F.col("text")).alias("tokens"))
    seeds = rb.select("site").distinct().withColumn("max_tokens", F.lit(20000))
    want = {(r.site, r.rank) for r in budget_cut(rb, seeds, [("rank", True)]).collect()}
    assert got == want


def folder_table(spark, df, name, parts, key):
    """``df`` as a folder of part files with rising times, in ``key`` order."""
    d = tempfile.mkdtemp(prefix="pw-folder-")
    rows = df.orderBy(key).collect()
    k = -(-len(rows) // parts)
    os.mkdir(os.path.join(d, f"{name}.parquet"))
    for i in range(parts):
        spark.createDataFrame(rows[i * k:(i + 1) * k], df.schema).coalesce(1).write.parquet(os.path.join(d, f"b{i}"))
        part = next(f for f in os.listdir(os.path.join(d, f"b{i}")) if f.endswith(".parquet"))
        to = os.path.join(d, f"{name}.parquet", f"part-{i}.parquet")
        os.link(os.path.join(d, f"b{i}", part), to)
        os.utime(to, (1_000_000 + i, 1_000_000 + i))
    return d


def test_near_dup_batch_that_fails_and_runs_again_over_a_folder(spark, monkeypatch):
    docs = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    d = folder_table(spark, docs, "documents", 2, "doc_id")
    root = tempfile.mkdtemp(prefix="pw-root-")
    real, calls = ST.batch_part, []

    def fails_once(path, batch_id):
        calls.append(path)
        if path.endswith("/out") and batch_id == 1 and sum(p.endswith("/out") for p in calls) == 2:
            raise RuntimeError("lost storage")
        return real(path, batch_id)

    monkeypatch.setattr(ST, "batch_part", fails_once)

    def run():
        s = ST.file_stream(spark, d, "documents", max_files=1)
        return ST.stream_near_dup(s, [], "doc_id", "text", [("doc_id", True)], reference=docs, root=root)

    with pytest.raises(Exception, match="lost storage"):
        run()
    got = sorted(r.doc_id for r in run().select("doc_id").collect())
    b = DD.fuzzy_dedup(docs, [], "doc_id", "text", [("doc_id", True)])
    assert got == sorted(r.doc_id for r in b.where(~F.col("dup_exact") & ~F.col("dup_fuzzy")).collect())


def test_stream_budget_sorts_a_site_over_small_arrow_batches(spark):
    rows = [("s", r, r % 7, 300) for r in range(200)]
    df = spark.createDataFrame(rows, "site string, rank bigint, tokens bigint, max_tokens int")
    d = tempfile.mkdtemp(prefix="pw-desc-")
    df.orderBy(F.col("rank").desc()).coalesce(1).write.parquet(os.path.join(d, "ranked.parquet"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        got = {r["rank"]: r.used_before for r in ST.stream_budget(ST.file_stream(spark, d, "ranked")).collect()}
    finally:
        spark.conf.set(key, old)
    assert got == {r: sum(x % 7 for x in range(r)) for r in range(200)}


def test_usage_window_over_batches_drops_late_rows(spark):
    rows = [(1, "2024-01-01 00:10:00", 1.0), (2, "2024-01-01 00:20:00", 2.0), (3, "2024-01-05 00:00:00", 4.0),
            (4, "2024-01-05 00:30:00", 8.0), (5, "2024-01-05 00:45:00", 64.0), (6, "2024-01-05 00:50:00", 128.0),
            (7, "2024-01-01 00:30:00", 16.0), (8, "2024-01-05 00:40:00", 32.0)]
    # a batch filters by the watermark that the batch before it ran with
    df = spark.createDataFrame(rows, "id int, ts string, value double").withColumn("event_type", F.lit("x"))
    d = folder_table(spark, df, "events", 4, "id")
    out = ST.stream_usage_window(ST.file_stream(spark, d, "events", max_files=1))
    assert sorted((str(r.window_start), r.n, r.total_value) for r in out.collect()) == [
        ("2024-01-01 00:00:00", 2, 3.0), ("2024-01-05 00:00:00", 5, 236.0)]


def test_bounded_dedup_keeps_a_constant_state(spark):
    """A day of keys per file: after two days a key is forgotten, so the state
    stays at a few days' keys, and a copy within the delay is dropped."""
    rows = [(f"2024-01-{day + 1:02d} {h:02d}:00:00", f"k{day}-{h}") for day in range(20) for h in range(0, 24, 2) for _ in range(2)]
    df = spark.createDataFrame(rows, "at string, k string").select(F.to_timestamp("at").alias("ts"), "k")
    d = folder_table(spark, df, "keys", 20, "ts")
    progress = []
    out = ST.stream_dedup(ST.file_stream(spark, d, "keys", max_files=1), [], F.col("k"), ("ts", "1 day"), progress=progress)
    assert sorted(r.k for r in out.collect()) == sorted({k for _, k in rows})
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(sizes) >= 20 and max(sizes[5:]) <= 5 * 12


def test_budget_over_many_batches_and_a_failed_one(spark, monkeypatch):
    """More batches than a snapshot holds, one of them run twice: equal to the
    running total over the batches in order."""
    monkeypatch.setattr(ST, "TOTALS_SNAPSHOT", 3)
    rows = [("big" if i % 3 else f"s{i % 7}", i, (i * 37) % 11, 400) for i in range(160)]
    df = spark.createDataFrame(rows, "site string, rank bigint, tokens bigint, max_tokens int")
    d = folder_table(spark, df, "ranked", 8, "rank")
    real, failed = ST.batch_part, []

    def once(path, batch_id):
        if batch_id == 5 and path.endswith("totals") and not failed:
            failed.append(1)
            raise RuntimeError("lost")
        return real(path, batch_id)

    monkeypatch.setattr(ST, "batch_part", once)
    root = tempfile.mkdtemp(prefix="pw-budget-")
    stream = ST.file_stream(spark, d, "ranked", max_files=1)
    try:
        ST.stream_budget(stream, root=root)
    except Exception:
        assert failed
    got = {(r.site, r["rank"]): (r.used_before, r.kept) for r in ST.stream_budget(stream, root=root).collect()}
    used, want = {}, {}
    for site, rank, tokens, most in rows:
        want[site, rank] = (used.get(site, 0), used.get(site, 0) < most * 0.98)
        used[site] = used.get(site, 0) + tokens
    assert got == want and failed


def test_near_dup_corpus_holds_no_word_sets(spark, tmp_path):
    import random
    rng = random.Random(9)
    rows = [(i, " ".join(f"{rng.randrange(10 ** 5)}" for _ in range(500))) for i in range(300)]
    rows += [(i + 300, t.split(" ", 1)[1]) for i, t in rows[::10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    d = folder_table(spark, docs, "documents", 3, "doc_id")
    root = str(tmp_path / "root")
    s = ST.file_stream(spark, d, "documents", max_files=1)
    got = sorted(r.doc_id for r in ST.stream_near_dup(s, [], "doc_id", "text", [("doc_id", True)], root=root).select("doc_id").collect())
    assert got == list(range(300))

    tables = [t for t in os.listdir(root) if t not in ("out", "chk")]
    fields = {(t, f.name): f.dataType.simpleString() for t in tables for f in spark.read.parquet(f"{root}/{t}").schema}
    assert tables and not [f for f, kind in fields.items() if kind.startswith("array")]
    packed = sum(spark.read.parquet(f"{root}/{t}").agg(F.sum(F.octet_length(c))).first()[0] for (t, c), kind in fields.items() if kind == "binary" and c == "entries")
    assert 0 < packed <= 32 * 77 * 300           # a prefix of 500 words has 76


def test_near_dup_texts_enter_the_workers_in_batches_of_bounded_bytes(spark, tmp_path, monkeypatch):
    from pagewright.session import BATCH_BYTES
    seen, real = [], DD.set_rows

    def noted(rows, *more):
        seen.append(rows.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None))
        return real(rows, *more)

    monkeypatch.setattr(DD, "set_rows", noted)
    spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ST.stream_near_dup(ST.file_stream(spark, str(tmp_path), "documents"), [], "doc_id", "text", [("doc_id", True)])
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert seen and set(seen) == {str(BATCH_BYTES)}
