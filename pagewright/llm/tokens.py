"""Token counts kept as delta-maintained rollups.

A rollup is a set of signed deltas, one folder per batch: an insert adds a
document and its tokens to the total of its source, language and tokenizer
version, a delete takes them away, a revised count adds the difference. Deltas
are summed before they are written (a hot source becomes one row per task).

A commit writes a new folder first and then publishes a log entry that names
the folders that count, in one rename. Readers take the latest entry, so they
see a batch whole or not at all, and a commit that dies before its entry has
changed nothing. A batch that is committed again replaces its own folder;
totals stay. ``compact`` sums all batches up into one folder; batches that went
into it are known by number and are not counted again. One writer at a time.

Defined cases: a null text has no tokens; null source or lang is a group of
its own; repeated rows each count; an empty batch leaves the totals as they
are; an empty table gives no totals; other columns are not read."""

from __future__ import annotations

import base64
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import Texts, scratch_table
from pagewright.session import ensure_checkpoint_dir

KEYS = ["source", "lang", "tokenizer"]
_ENCODERS: dict = {}


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens={})
    return _ENCODERS[path]


class Rollup:
    """Additive totals under ``path`` in the shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[str]:
        log = self._hadoop.Path(f"{self.path}/log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(n for n in names if n.endswith(".json"))

    def state(self) -> dict:
        """What counts: ``batches`` (folder by number), ``base`` (the compacted
        folder or None) and ``merged`` (the numbers in it)."""
        names = self._entries()
        if not names:
            return {"batches": {}, "base": None, "merged": []}
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/log/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        number = int(self._entries()[-1][:12]) + 1 if self._entries() else 0
        new = self._hadoop.Path(f"{self.path}/log/_{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(new, self._hadoop.Path(f"{self.path}/log/{number:012d}.json")):
            raise OSError(f"log entry {number} of {self.path} was not published")

    def _write(self, changes: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        (changes.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
         .write.parquet(f"{self.path}/{folder}"))
        return folder

    def commit(self, batch_id: int, changes: DataFrame) -> None:
        """``changes``: source, lang, tokenizer, docs (+1, -1 or 0), tokens
        (signed)."""
        if batch_id in self.state()["merged"]:
            return
        folder, state = self._write(changes), self.state()
        state["batches"][str(batch_id)] = folder
        self._publish(state)

    def _deltas(self, state: dict) -> DataFrame:
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        folders = [*state["batches"].values(), *([state["base"]] if state["base"] else [])]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def compact(self) -> None:
        """One folder in place of all batches so far."""
        state = self.state()
        merged = sorted({*state["merged"], *map(int, state["batches"])})
        self._publish({"batches": {}, "base": self._write(self._deltas(state)), "merged": merged})

    def totals(self) -> DataFrame:
        return (self._deltas(self.state()).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs != 0 or tokens != 0"))


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, key, words, bpe, clean): text key, words, BPE
    tokens, and BPE tokens of the text with white space collapsed."""
    path = path or default_ranks()
    schema = docs.select("doc_id", "source", "lang").schema.add("key", "binary").add("words", "long") \
        .add("bpe", "long").add("clean", "long")

    def run(batches):
        import hashlib
        for batch in batches:
            enc, rows = encoder(path), []
            for text in Texts(batch.column(3)).strings():
                parts = text.split()
                n, flat = len(enc.encode_ordinary(text)), " ".join(parts)
                rows.append((hashlib.blake2b(text.encode(), digest_size=16).digest(), len(parts), n,
                             n if flat == text else len(enc.encode_ordinary(flat))))
            key, *numbers = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(key, pa.binary()),
                                              *[pa.array(n, pa.int64()) for n in numbers]], names=schema.names)

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, schema)


def document_rollup(docs: DataFrame) -> DataFrame:
    """Totals after four batches: inserts under two tokenizer versions, the
    second one committed twice; deletes of exact copies (all but the least
    id); counts revised to collapsed white space. The first two are compacted
    before the deletes."""
    rows = scratch_table(counted(docs), "token-counts")
    rollup = Rollup(docs.sparkSession, f"{ensure_checkpoint_dir(docs.sparkSession)}/rollup-{uuid.uuid4().hex}")

    def change(frame, tokenizer, n, tokens):
        return frame.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), n.alias("docs"), tokens.alias("tokens"))

    one = F.lit(1)
    rollup.commit(1, change(rows, "words", one, F.col("words")))
    for _ in range(2):
        rollup.commit(2, change(rows, "byte_bpe_50k", one, F.col("bpe")))
    rollup.compact()
    # texts by source and language: equal keys have equal counts
    group = rows.groupBy("key", "source", "lang").agg(F.min(F.struct("doc_id", "source", "lang")).alias("f"), F.count(F.lit(1)).alias("n"),
                                                      *[F.max(c).alias(c) for c in ("words", "bpe", "clean")])
    first = group.groupBy("key").agg(F.min("f").alias("kept"))
    here = F.col("source").eqNullSafe(F.col("kept.source")) & F.col("lang").eqNullSafe(F.col("kept.lang"))
    copies = scratch_table(group.join(first, "key").withColumn("here", here.cast("long")), "token-groups")
    gone = F.col("here") - F.col("n")
    rollup.commit(3, change(copies, "words", gone, gone * F.col("words")).unionByName(
        change(copies, "byte_bpe_50k", gone, gone * F.col("bpe"))))
    rollup.commit(4, change(copies, "byte_bpe_50k", F.lit(0), F.col("here") * (F.col("clean") - F.col("bpe"))))
    return rollup.totals()
