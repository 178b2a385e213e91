"""Benchmark decontamination by spaced-seed hashing.

Tokens are folded runs of letters, marks and digits, and the single characters
of scripts without spaces. A seed hashes the 6 tokens that
a fixed mask selects and ignores the positions between, so a substituted
token breaks only the seeds that look at it. Eight masks leave a seed in
practically every stretch that the rule below accepts (a test measures it). Test seeds and training seeds
are joined by hash; each hit names a diagonal (document position minus item
position), and the overlap along it is verified on the tokens around the hit:
the best-scoring stretch (match +1, substitution -2) must match
``MIN_MATCHES`` tokens, or four fifths of a shorter item. Items of 8 to 14
tokens have two shorter masks more: with them a seed is left wherever the rule
can accept. Items of fewer than 8 tokens are found by the hash of their whole
token sequence, wherever a document has it.

The document pass reads each text once. A bit filter of fixed size made from
the test seeds (used if there are at most ``FILTER_SEEDS``; beyond that every
position goes to the join) leaves only positions worth joining, and each
neighbourhood of such positions is written once, as token hashes, to the
shared folder. Nothing else of the documents is shuffled.

Defined cases: null or empty texts and items without a token have no seeds;
items of fewer than 8 tokens must be there whole, without a substitution; in the overlaps
rows that repeat an id are one document and a null id is an id like any other,
but a row is dropped for its own text only; repeated items with one id and text count once; an
empty table on either side gives no overlaps; columns other than doc_id, text
and item_id, text are not read."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import Texts, mix64, scratch_table, words

MASKS = ("111111", "11011011", "1101100101", "1011010011", "11001011001", "1010110011", "110100100011", "11011000011")
WEIGHT = 6
SHORT_MASKS, SHORT = ("10100111", "110111"), 15
SHORTEST = 8              # items of fewer tokens must be there whole
MIN_MATCHES = 12
MISMATCH = 2
FILTER_SEEDS = 4_000_000
_FAST_BITS, _WIDE_BITS = 20, 27


def _offsets(mask: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == 49)


def _mask(number: int, mask: str):
    at = _offsets(mask)
    factors = mix64(np.arange(1, len(at) + 1, dtype=np.uint64) + np.uint64(1000 * (number + 1))) | np.uint64(1)
    return at, factors


#: Masks by the shortest and longest item (tokens, end exclusive) they seed.
_LONG = [(_mask(m, x), SHORTEST, 1 << 62) for m, x in enumerate(MASKS)]
_SHORT = [(_mask(100 + m, x), SHORTEST, SHORT) for m, x in enumerate(SHORT_MASKS)]
_EXACT = [(_mask(200 + n, "1" * n), n, n + 1) for n in range(1, SHORTEST)]
_ALL = _LONG + _SHORT + _EXACT


def seeds(h: np.ndarray, row: np.ndarray, masks=_LONG):
    """For each mask: token positions with a whole seed, and the seeds."""
    for (offsets, factors), _, _ in masks:
        n = len(h) - int(offsets[-1])
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        total = np.zeros(n, np.uint64)
        for offset, factor in zip(offsets, factors, strict=True):
            total += h[offset:offset + n] * factor
        whole = row[:n] == row[offsets[-1]:offsets[-1] + n]
        yield (np.flatnonzero(whole), mix64(total[whole])) if not whole.all() else (np.arange(n), mix64(total))


def needed(tokens: int) -> int:
    """Matching tokens that make an overlap with an item of so many."""
    return tokens if tokens < SHORTEST else min(MIN_MATCHES, -(-4 * tokens // 5))


_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x30FF),
             (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF),
             (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))


@functools.cache
def _characters() -> np.ndarray:
    """0 between tokens, 1 in a run, 2 a token of its own, by code point."""
    import unicodedata
    out = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)]).astype(np.uint8)
    for a, b in _UNSPACED:
        out[a:b + 1] *= 2
    return out


def _tokens(data, offs):
    edges = offs
    if len(data) and data.max() >= 128:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = _characters()[points]
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(begin, len(data)))
        data = np.where(np.repeat(kind == 0, width) & (data >= 128), np.uint8(32), data)
        alone = kind == 2
        if alone.any():
            edges = np.unique(np.concatenate([offs, begin[alone], (begin + width)[alone]]))
    starts, _, h, _ = words(data, edges, kind="letters")
    first = np.searchsorted(starts, offs)
    return h, first, np.repeat(np.arange(len(first) - 1), np.diff(first))


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, tokens, seeds[seed, pos]) of every distinct item."""
    id_field = benchmark.schema["item_id"]
    schema = T.StructType([id_field, T.StructField("tokens", T.BinaryType()),
                           T.StructField("seeds", T._parse_datatype_string("array<struct<seed:bigint,ipos:int>>"))])

    def run(batches):
        kind = pa.list_(pa.struct([("seed", pa.int64()), ("ipos", pa.int32())]))
        for batch in batches:
            tokens, found = [], []
            for _, _, data, offs in Texts(batch.column(1), lower=True).chunks():
                h, first, row = _tokens(data, offs)
                mine = [[] for _ in range(len(offs) - 1)]
                size = np.diff(first)[row]
                for (_, least, end), (at, seed) in zip(_ALL, seeds(h, row, _ALL), strict=True):
                    fits = (size[at] >= least) & (size[at] < end)
                    for p, s in zip(at[fits].tolist(), seed[fits].view(np.int64).tolist(), strict=True):
                        mine[row[p]].append({"seed": s, "ipos": p - int(first[row[p]])})
                found += mine
                tokens += [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary()), pa.array(found, kind)],
                                             names=schema.names)

    return (benchmark.select("item_id", "text").mapInArrow(run, schema)
            .where(F.size("seeds") > 0)
            .withColumn("item", F.xxhash64("item_id", "tokens")).dropDuplicates(["item"]))


def seed_filter(items: DataFrame, bound: int = FILTER_SEEDS):
    """Two bit filters over the test seeds, or None beyond ``bound`` seeds."""
    distinct = items.select(F.explode("seeds.seed").alias("seed")).distinct().limit(bound + 1).toPandas()
    if len(distinct) > bound:
        return None
    seed = distinct["seed"].to_numpy(np.int64).view(np.uint64)
    fast = np.zeros(1 << _FAST_BITS, bool)
    fast[seed >> np.uint64(64 - _FAST_BITS)] = True
    wide = np.zeros(1 << _WIDE_BITS, bool)
    wide[seed & np.uint64((1 << _WIDE_BITS) - 1)] = True
    return fast, np.packbits(wide, bitorder="little")


def _passing(seed: np.ndarray, bits) -> np.ndarray:
    if bits is None:
        return np.arange(len(seed))
    fast, wide = bits
    at = np.flatnonzero(fast[seed >> np.uint64(64 - _FAST_BITS)])
    slot = seed[at] & np.uint64((1 << _WIDE_BITS) - 1)
    return at[(wide[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]


def regions(docs: DataFrame, bits, reach: int, masks=_LONG) -> DataFrame:
    """(doc_id, text_hash, start, tokens, hits[seed, pos]) of the neighbourhoods of all
    passing seeds; ``reach`` tokens on either side cover any item."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)     # fixed size
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()),
                           T.StructField("start", T.IntegerType()),
                           T.StructField("tokens", T.BinaryType()),
                           T.StructField("hits", T._parse_datatype_string("array<struct<seed:bigint,pos:int>>"))])
    kind = pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())]))
    span = max(len(m) for m in MASKS)

    def run(batches):
        for batch in batches:
            source, start, tokens, hits = [], [], [], []
            for lo, _, data, offs in Texts(batch.column(1), lower=True).chunks():
                h, first, row = _tokens(data, offs)
                at, seed = [], []
                for places, values in seeds(h, row, masks):
                    ok = _passing(values, shared.value)
                    at.append(places[ok])
                    seed.append(values[ok])
                at, seed = np.concatenate(at), np.concatenate(seed).view(np.int64)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                new = (np.diff(at) > 2 * reach + span) | (np.diff(row[at]) > 0)
                edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(at)]])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    r = int(row[at[a]])
                    begin = max(int(at[a]) - reach, int(first[r]))
                    end = min(int(at[b - 1]) + span + reach, int(first[r + 1]))
                    source.append(lo + r)
                    start.append(begin - int(first[r]))
                    tokens.append(h[begin:end].tobytes())
                    hits.append([{"seed": s, "pos": p} for s, p in
                                 zip(seed[a:b].tolist(), (at[a:b] - first[r]).tolist(), strict=True)])
            source = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(source), batch.column(2).take(source),
                                              pa.array(start, pa.int32()), pa.array(tokens, pa.binary()),
                                              pa.array(hits, kind)], names=schema.names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the best-scoring stretch of a diagonal."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[:end + 1] == low[end])[0])      # of equals the longest
    return start, end, int(equal[start:end].sum())


def verified(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per verified overlap of a text with an item along a diagonal."""
    items = scratch_table(item_seeds(benchmark), "decontam-items")
    reach = items.agg(F.max(F.length("tokens"))).first()[0] or 0
    short = {r[0] // 8 for r in items.select(F.length("tokens")).where(F.length("tokens") < 8 * SHORT).distinct().collect()}
    masks = _LONG + [m for m in _SHORT + _EXACT if any(m[1] <= n < m[2] for n in short)]
    found = scratch_table(regions(docs, seed_filter(items), reach // 8, masks)
                          .withColumn("region", F.xxhash64("doc_id", "text_hash", "start", "tokens")), "decontam-regions")
    test = items.select("item", F.explode("seeds").alias("s")).select("item", "s.seed", "s.ipos")
    diagonals = (found.select("region", F.explode("hits").alias("s")).select("region", "s.seed", "s.pos")
                 .join(test, "seed").select("region", "item", (F.col("pos") - F.col("ipos")).alias("diagonal"))
                 .distinct())
    pairs = (diagonals.join(found.select("region", "doc_id", "text_hash", "start", "tokens").dropDuplicates(["region"]), "region")
             .join(items.select("item", "item_id", F.col("tokens").alias("item_tokens")), "item"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), benchmark.schema["item_id"],
                           *[T.StructField(n, T.IntegerType()) for n in
                             ("matches", "doc_start", "doc_end", "item_start", "item_end")]])

    def verify(batches):
        for batch in batches:
            keep, rows = [], []
            columns = [batch.column(n) for n in ("tokens", "item_tokens")]
            diagonal, begin = (batch.column(n).to_numpy() for n in ("diagonal", "start"))
            for i in range(batch.num_rows):
                text, item = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in columns)
                shift = int(diagonal[i]) - int(begin[i])      # region position of the item's first token
                a, b = max(0, -shift), min(len(item), len(text) - shift)
                if b <= a:
                    continue
                low, high, matches = best_stretch(item[a:b] == text[a + shift:b + shift])
                if matches >= needed(len(item)):
                    at = int(diagonal[i]) + a
                    keep.append(i)
                    rows.append((matches, at + low, at + high, a + low, a + high))
            take = pa.array(keep, pa.int64())
            columns = [pa.array(c, pa.int32()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int32())] * 5
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(take) for n in ("doc_id", "text_hash", "item_id")],
                                              *columns], names=schema.names)

    return pairs.mapInArrow(verify, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated (doc_id, item_id): the best verified overlap
    (token positions, end exclusive) and the number of diagonals with one."""
    best = F.max(F.struct("matches", *[(-F.col(c)).alias(c) for c in
                                       ("doc_start", "doc_end", "item_start", "item_end")])).alias("b")
    return (verified(docs, benchmark).groupBy("doc_id", "item_id").agg(best, F.count(F.lit(1)).alias("places"))
            .select("doc_id", "item_id", "b.matches", *[(-F.col(f"b.{c}")).alias(c) for c in
                                                       ("doc_start", "doc_end", "item_start", "item_end")], "places"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no verified overlap, whatever
    other rows of their id have."""
    bad = verified(docs, benchmark).select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_hash"])
    return docs.join(bad, same, "left_anti")
