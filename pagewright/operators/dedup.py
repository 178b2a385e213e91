"""De-duplication as set-based Spark jobs.

First-wins on a key (titles, exact content, code, sections, URLs) is an
aggregate ``min(order)`` per key followed by a join on the unique row id:
map-side partial aggregation makes a key holding a third of all rows cost
one row per map partition, and the join back is on a unique id, so no task
ever holds a whole key group.

Near-duplicates (Jaccard of word sets strictly above 0.85) use an exact
prefix-filter set-similarity self-join over sorted 64-bit word hashes: words are
ranked rare first, each set keeps its first ``n - ceil(0.85 n) + 1``
words, sets are joined by prefix word and every candidate is verified with integer
arithmetic. Texts are read once per step and their sets made where they are needed:
on disk a set is a name of 64 bits, packed prefix entries, and a whole set only where
it stands in a candidate (see ``set_pairs``). The rank of a word needs no join: it
comes from a table of ``VOCAB_BROADCAST_BYTES``, whatever the vocabulary (see
``slot_levels``). A candidate shares several prefix words where sizes ask for it (see
``similar_entries``), which keeps chance pairs out. The first-wins choice over
the similarity graph (keep x iff no earlier *kept* y is similar) is resolved
by rounds over the edges that are still open (see ``resolve_first_wins``).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from pagewright import fixed
from pagewright.functions import text as T
from pagewright.operators.components import components
from pagewright.session import checkpoint, maybe_broadcast, scratch_table, ship_package, small_batches

PCT = fixed.SIMILARITY_THRESHOLD_PCT
#: The table that orders words: one byte a slot (a power of two). Parities of a set.
VOCAB_BROADCAST_BYTES, PARITIES = 1 << 22, 64
BLOCK = 512             # members of one set, or sets of one group, that meet in a task
#: Prefix words that a candidate shares, where its sizes allow that many.
LEAST_COMMON = 4
#: Entries that a task packs and meetings that it makes at a time; slots of the filter of asked sets.
ENTRIES_AT_ONCE, PAIRS_AT_ONCE, NAMED_SLOTS = 1 << 19, 1 << 21, 1 << 22


# ---------------------------------------------------------------------------
# ordering helpers
# ---------------------------------------------------------------------------

def order_struct(order: list[tuple[str, bool]]) -> Column:
    """A struct whose natural ordering is the requested order; descending
    numeric keys are negated."""
    fields = []
    for i, (c, asc) in enumerate(order):
        col = F.col(c) if asc else -F.col(c)
        fields.append(col.alias(f"o{i}"))
    return F.struct(*fields)


def first_wins(df: DataFrame, scope: list[str], key: Column, order: list[tuple[str, bool]],
               id_col: str, out: str = "is_first") -> DataFrame:
    """Flag the first row (by ``order``, ties by ``id_col``) of every
    (scope, key) group. Rows with a NULL key are never duplicates."""
    k = df.withColumn("_k", key)
    winners = (k.where(F.col("_k").isNotNull())
               .groupBy(*scope, "_k")
               .agg(F.min(F.struct(order_struct(order).alias("o"), F.col(id_col).alias("id"))).alias("w"))
               .select(F.col("w.id").alias(id_col), F.lit(True).alias("_w")))
    return (k.join(winners, id_col, "left")
            .withColumn(out, F.col("_k").isNull() | F.col("_w").isNotNull())
            .drop("_k", "_w"))


def keep_first(df, scope, key, order, id_col):
    return first_wins(df, scope, key, order, id_col, "_f").where("_f").drop("_f")


# ---------------------------------------------------------------------------
# near-duplicate pairs (E4 / D3 candidate graph)
# ---------------------------------------------------------------------------

def word_sets(column: pa.Array, seeds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 64-bit word hashes of every row of ``column``: lower-cased
    texts, arrays of words or arrays of their hashes. The seed of a row, a hash of its
    scope, enters its words, so sets of different scopes share none."""
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type):
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        flat = column.flatten().to_numpy(zero_copy_only=False)
    else:
        words = [(x.split() if isinstance(x, str) else x) if x else [] for x in column.to_pylist()]
        sizes = np.array([len(x) for x in words], np.int64)
        flat = pd.util.hash_array(np.array([w for x in words for w in x], object), categorize=False).view(np.int64)
    flat, out, a = flat ^ np.repeat(seeds, sizes), [], 0
    for size in sizes:
        one = np.sort(flat[a:a + size])
        out.append(one[np.diff(one, prepend=one[:1] - 1) != 0])
        a += size
    return out


def set_name(one: np.ndarray) -> int:
    """64 bits that name a set of words."""
    return int.from_bytes(hashlib.blake2b(one.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_rows(rows: DataFrame, scope: list[str], run, schema: StructType) -> DataFrame:
    """``run`` over the (record batch, word sets) of every task; the sets are made of the
    last column of ``rows`` where they are needed and are never stored."""
    ship_package(rows.sparkSession)
    *others, words = rows.columns
    sets = F.lower(words) if rows.schema[words].dataType.simpleString() == "string" else F.col(words)
    seed = F.xxhash64(*scope) if scope else F.lit(0).cast("long")

    def task(batches):
        return run((b, word_sets(b.column(b.num_columns - 1), b.column(b.num_columns - 2).to_numpy())) for b in batches)

    return rows.select(*others, seed.alias("_seed"), sets.alias(words)).mapInArrow(task, schema)


def named_sets(rows: DataFrame, scope: list[str]) -> DataFrame:
    """``rows`` with the size ``_n`` and the name ``_k`` of the set in place of the words,
    the last column."""
    schema = StructType([*rows.schema.fields[:-1], StructField("_n", IntegerType()), StructField("_k", LongType())])

    def run(batches):
        for batch, sets in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([len(x) for x in sets], pa.int32()),
                                              pa.array([set_name(x) for x in sets], pa.int64())], names=schema.names)

    return set_rows(rows, scope, run, schema)


def slot_counts(base: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(span, levels): for every slot (hash modulo ``VOCAB_BROADCAST_BYTES``) a level that
    grows with its occurrences in ``base(..., w)``, 0 for less than two; a byte a slot, in
    spans of slots. A task sends its counts as compressed spans, not a row per word."""
    slots = VOCAB_BROADCAST_BYTES
    width = min(slots, 1 << 16)
    schema = StructType([StructField("span", IntegerType()), StructField("levels", BinaryType())])

    def count(batches):
        total = np.zeros(slots, np.uint32)
        for _, sets in batches:
            if sets:
                used, times = np.unique(np.concatenate(sets) & (slots - 1), return_counts=True)
                total[used] += times.astype(np.uint32)
        for k, part in enumerate(total.reshape(-1, width)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=schema.names)

    def add(batches):
        total = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(part), np.uint32).astype(np.int64)
        for k, part in total.items():
            level = np.where(part > 1, np.minimum(8 * np.log2(np.maximum(part, 1)), 255), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()])], names=schema.names)

    return set_rows(base.select(*scope, "w"), scope, count, schema).repartition("span").mapInArrow(add, schema)


def slot_levels(counts: DataFrame) -> np.ndarray:
    """``slot_counts`` as one array, level 0 for the other slots. Any fixed order
    of words gives exact results, so words that share a slot may share its level;
    the array reaches the driver and has the same size whatever the vocabulary."""
    levels = np.zeros(VOCAB_BROADCAST_BYTES, np.uint8)
    width = min(len(levels), 1 << 16)
    for k, part in zip(*counts.select("span", "levels").toArrow().to_pydict().values(), strict=True):
        levels[k * width:(k + 1) * width] = np.frombuffer(part, np.uint8)
    return levels


class Entries:
    """Prefix entries: word hash ``t``, set ``id``, parities ``x`` of the set, its size
    ``n`` and the rank ``r`` of the word in it, as arrays or packed column by column."""

    KINDS = {"t": np.int64, "id": np.int64, "x": np.int64, "n": np.int32, "r": np.int32}
    WIDTH = 32

    def __init__(self, **columns):
        self.__dict__.update(columns)

    def __len__(self):
        return len(self.t)

    def __getitem__(self, at) -> Entries:
        return Entries(**{c: getattr(self, c)[at] for c in self.KINDS})

    def pack(self) -> bytes:
        return b"".join(getattr(self, c).tobytes() for c in self.KINDS)

    @classmethod
    def unpack(cls, packed: list[bytes]) -> Entries:
        parts = {c: [np.zeros(0, kind)] for c, kind in cls.KINDS.items()}
        for one in packed:
            at, rows = 0, len(one) // cls.WIDTH
            for c, kind in cls.KINDS.items():
                parts[c].append(np.frombuffer(one, kind, rows, at))
                at += rows * np.dtype(kind).itemsize
        return cls(**{c: np.concatenate(x) for c, x in parts.items()})

    def ordered(self) -> Entries:
        """By word, size and set, an entry of a set once."""
        out = self[np.lexsort((self.id, self.n, self.t))]
        return out[np.concatenate([[True], (np.diff(out.t) != 0) | (np.diff(out.id) != 0)])[:len(out)]]


def prefix_entries(base: DataFrame, scope: list[str], levels: np.ndarray, alone: bool = True, parts: int = 64) -> DataFrame:
    """(part, entries): packed prefix words of every set in ``base(scope, w)``, dealt
    into ``parts`` by word. Words are ranked by (level, hash), the first
    ``n - ceil(0.85 n) + 1`` kept; with ``alone``, words of level 0 are left out: no
    other text of the table that ``levels`` counts has them. A set is named by a long
    ``id`` of ``base``, or else by ``set_name``. ``x`` holds ``PARITIES`` bits of the
    set: the parity of the number of its words whose hash points to the bit."""
    shared, slots, pct = base.sparkSession.sparkContext.broadcast(levels), len(levels), PCT
    own = ["id"] if "id" in base.columns else []
    schema = StructType([StructField("part", IntegerType()), StructField("entries", BinaryType())])

    def packed(found):
        ids, sizes, parity, skipped, kept = zip(*found, strict=True)
        lens = [len(x) for x in kept]
        bits = np.packbits(np.array(parity, np.uint8), axis=1).view(np.int64)[:, 0]
        all_ = Entries(t=np.concatenate(kept), id=np.repeat(np.array(ids, np.int64), lens), x=np.repeat(bits, lens), n=np.repeat(np.array(sizes, np.int32), lens),
                       r=np.concatenate([np.arange(s + 1, s + 1 + m, dtype=np.int32) for s, m in zip(skipped, lens, strict=True)]))
        part = (all_.t >> 24) % parts
        at = np.argsort(part, kind="stable")
        all_, edges = all_[at], np.searchsorted(part[at], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(edges))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([all_[edges[k]:edges[k + 1]].pack() for k in full], pa.binary())], names=schema.names)

    def run(batches):
        level_of, seen, found, rows = shared.value, set(), [], 0
        for batch, sets in batches:
            for id_, one in zip(batch.column(0).to_pylist() if own else map(set_name, sets), sets, strict=True):
                if not len(one) or id_ is None or id_ in seen:
                    continue
                seen.add(id_)
                n, level = len(one), level_of[one & (slots - 1)]
                first = np.argsort(level, kind="stable")[:n - (pct * n + 99) // 100 + 1]
                skip = int((level[first] == 0).sum()) if alone else 0
                found.append((id_, n, np.bincount((one >> 40) & (PARITIES - 1), minlength=PARITIES) & 1, skip, one[first[skip:]]))
                rows += len(first) - skip
            if rows > ENTRIES_AT_ONCE:
                yield packed(found)
                found, rows = [], 0
        if found:
            yield packed(found)

    return set_rows(base.select(*own, *[c for c in scope if c not in own], "w"), scope, run, schema)


def similar_entries(left: Entries, right: Entries, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(a, b, least) of the entries ``left[i]``, ``right[j]`` of a word that pass exact bounds.

    Overlap: similar sets share at least ``need`` words. Among the first
    ``n - need + least`` words of each, then, they share ``least`` or more, whatever the
    order of words, so entries behind those don't count and ``candidate_pairs`` asks for
    ``least`` of them. Parity: sets that differ by d words differ in at most d bits, and
    similar ones by less than 0.15 / 1.85 of their words."""
    na, nb = left.n[i].astype(np.int64), right.n[j].astype(np.int64)
    total, longest = na + nb, np.maximum(na, nb)
    need = PCT * total // (100 + PCT) + 1
    least = np.minimum(LEAST_COMMON, need - (PCT * longest + 99) // 100 + 1)
    differ = np.bitwise_count((left.x[i] ^ right.x[j]).view(np.uint64)).astype(np.int64)
    ok = ((left.r[i] <= na - need + least) & (right.r[j] <= nb - need + least) & (100 * np.minimum(na, nb) >= PCT * longest)
          & ((100 + PCT) * differ < (100 - PCT) * total) & (left.id[i] != right.id[j]))
    a, b = left.id[i[ok]], right.id[j[ok]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(least[ok].astype(np.int8))], names=["a", "b", "least"])


def windows(left: Entries, right: Entries, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For ordered entries: which stretch of ``right`` every entry of ``left`` meets, that
    of the same word and of sizes within the bound (with ``same``, behind the entry)."""
    words = np.unique(np.concatenate([left.t, right.t]))
    key = np.searchsorted(words, right.t) << 32 | right.n
    at, n = np.searchsorted(words, left.t) << 32, left.n.astype(np.int64)
    end = np.searchsorted(key, at + np.minimum(100 * n // PCT, 2**31 - 1), "right")
    start = np.arange(1, len(left) + 1) if same else np.searchsorted(key, at + (PCT * n + 99) // 100)
    return start, np.maximum(start, end)


def meetings(left: Entries, right: Entries, start: np.ndarray, end: np.ndarray):
    """``similar_entries`` of all stretches, some ``PAIRS_AT_ONCE`` at a time."""
    count = end - start
    before = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PAIRS_AT_ONCE, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = np.arange(len(i)) - np.repeat(before[lo:hi] - before[lo] - start[lo:hi], count[lo:hi])
        if len(i):
            yield similar_entries(left, right, i, j)
        lo = hi


def candidate_pairs(entries: DataFrame, _scope: list[str] = (), parts: int = 64) -> DataFrame:
    """(a, b), a < b: names of sets that share enough prefix words and may be similar,
    once each. ``entries`` may hold a column ``old``: pairs of two old sets are left out.
    Scopes are in the hashes already. A part of the words is joined by one task; a word
    of more than ``PAIRS_AT_ONCE`` meetings is cut into stretches that are dealt anew."""
    if "old" not in entries.columns:
        entries = entries.withColumn("old", F.lit(False))
    dealt = entries.select("part", "entries", "old").repartition(parts, "part")

    def sides(batches):
        found = {False: [], True: []}
        for batch in batches:
            for one, old in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found[old].append(one)
        new, old = Entries.unpack(found[False]).ordered(), Entries.unpack(found[True]).ordered()
        for right, same in ((new, True), (old, False)):
            if len(new) and len(right):
                start, end = windows(new, right, same)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(new.t)) + 1, [len(new)]])
                cost = np.add.reduceat(end - start, edges[:-1])
                yield new, right, same, start, end, np.repeat(cost > PAIRS_AT_ONCE, np.diff(edges))

    def near(batches):
        for new, right, _, start, end, hot in sides(batches):
            yield from meetings(new[~hot], right, start[~hot], end[~hot])

    def stretches(batches):
        for new, right, same, start, end, hot in sides(batches):
            at = np.flatnonzero(hot)
            for a, b in pieces(at, (end - start)[at]):
                lo, hi = (a, b) if same else (start[a:b].min(), start[a:b].min())
                hi = max(int(end[a:b].max()), hi)
                yield pa.RecordBatch.from_arrays([pa.array([int(new.t[a]) + a], pa.int64()), pa.array([same]), pa.array([new[a:b].pack()]), pa.array([right[lo:hi].pack()])],
                                                 names=["no", "same", "l", "r"])

    def pieces(at, cost):
        """Runs of neighbours in ``at`` with about ``PAIRS_AT_ONCE`` meetings."""
        first, done = 0, 0
        for k in range(len(at)):
            done += int(cost[k])
            if k + 1 == len(at) or done >= PAIRS_AT_ONCE or at[k + 1] != at[k] + 1:
                yield int(at[first]), int(at[k]) + 1
                first, done = k + 1, 0

    def expand(batches):
        for batch in batches:
            for same, one, other in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                left, right = Entries.unpack([one]), Entries.unpack([other])
                yield from meetings(left, right, *windows(left, right, same))

    met = (dealt.mapInArrow(near, "a long, b long, least byte")
           .union(dealt.mapInArrow(stretches, "no long, same boolean, l binary, r binary").repartition(parts, "no")
                  .mapInArrow(expand, "a long, b long, least byte")))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.max("least").alias("least")).where("common >= least").select("a", "b")


def set_pairs(texts: DataFrame, scope: list[str], cand: DataFrame) -> DataFrame:
    """(a, b, inter, uni): the pairs of ``cand(a, b)`` with Jaccard strictly above the
    threshold, for the sets of ``texts(scope, w)``.

    A set goes to the least name beside it, sets of one name into blocks of about
    ``BLOCK``, and pairs to the block pair of their sets. So a group of near copies
    meets in a few tasks, to which each of its sets is sent once and not once a pair."""
    spark = texts.sparkSession
    both = cand.union(cand.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = scratch_table(both.groupBy(F.col("a").alias("k")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "near-labels")
    sized = label.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    home = maybe_broadcast(label.join(sized, "root").select("k", F.xxhash64("root", F.pmod(F.xxhash64("k"), "blocks")).alias("home")))
    ha, hb = home.withColumnsRenamed({"k": "a", "home": "ha"}), home.withColumnsRenamed({"k": "b", "home": "hb"})
    placed = scratch_table(cand.join(ha, "a").join(hb, "b").select("a", "b", F.xxhash64(F.least("ha", "hb"), F.greatest("ha", "hb")).alias("cell")), "near-cells")
    wanted = maybe_broadcast(placed.select("cell", F.col("a").alias("k")).union(placed.select("cell", F.col("b").alias("k"))).distinct())
    named = np.zeros(NAMED_SLOTS, bool)
    named[label.select(F.pmod("k", F.lit(NAMED_SLOTS)).cast("int").alias("s")).distinct().toArrow().column(0).to_numpy()] = True
    shared, schema = spark.sparkContext.broadcast(named), StructType([StructField("k", LongType()), StructField("s", BinaryType())])

    def send(batches):
        asked, seen = shared.value, set()
        for _, sets in batches:
            names = [set_name(x) if len(x) else None for x in sets]
            at = [r for r, k in enumerate(names) if k is not None and asked[k % NAMED_SLOTS] and k not in seen and not seen.add(k)]
            yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in at], pa.int64()), pa.array([sets[r].tobytes() for r in at], pa.binary())], names=schema.names)

    def verify(sets, pairs):
        names, first = np.unique(sets.column("k").to_numpy(), return_index=True)
        raw = sets.column("s").take(first).to_pylist()
        flat = np.unique(np.frombuffer(b"".join(raw), np.int64), return_inverse=True)[1]
        edges = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])])
        a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
        if not (np.isin(a, names).all() and np.isin(b, names).all()):
            raise ValueError("a text has changed between two readings")
        a, b = np.searchsorted(names, a), np.searchsorted(names, b)
        at = np.argsort(a, kind="stable")
        a, b, inter = a[at], b[at], np.zeros(len(a), np.int64)
        mark = np.zeros(int(flat.max()) + 1, bool)
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(a)], strict=True):
            own = flat[edges[a[lo]]:edges[a[lo] + 1]]
            mark[own] = True
            for k in range(lo, hi):
                inter[k] = np.count_nonzero(mark[flat[edges[b[k]]:edges[b[k] + 1]]])
            mark[own] = False
        size = np.diff(edges)
        uni = size[a] + size[b] - inter
        ok = 100 * inter > PCT * uni
        return pa.table({"a": names[a[ok]], "b": names[b[ok]], "inter": inter[ok].astype(np.int32), "uni": uni[ok].astype(np.int32)})

    sent = set_rows(texts.select(*scope, "w"), scope, send, schema).join(wanted, "k")
    out = (sent.groupBy("cell").cogroup(placed.groupBy("cell")).applyInArrow(verify, "a long, b long, inter int, uni int"))
    with small_batches(spark):
        return scratch_table(out, "near-pairs")


def entry_parts(spark: SparkSession, words: int) -> int:
    """Tasks that join the entries of sets of so many ``words`` together."""
    return max(2 * spark.sparkContext.defaultParallelism, words * (100 - PCT) // 100 // ENTRIES_AT_ONCE + 1)


def similar_sets(texts: DataFrame, scope: list[str], words: int) -> DataFrame:
    """(a, b, inter, uni) of the different sets of ``texts(scope, w)``, which hold about
    ``words`` words; texts are read three times and their word sets stored nowhere."""
    texts = texts.select(*scope, "w")
    parts = entry_parts(texts.sparkSession, words)
    with small_batches(texts.sparkSession):         # texts of any length enter the workers
        levels = slot_levels(slot_counts(texts, scope))
        cand = scratch_table(candidate_pairs(prefix_entries(texts, scope, levels, parts=parts), parts=parts), "near-candidates")
    return set_pairs(texts, scope, cand)


def representatives(docs: DataFrame, scope: list[str], id_col: str, words: str,
                    order: list[tuple[str, bool]]) -> DataFrame:
    """(scope..., id, representative): the first document, by ``order``, with
    the same set of words (none if it is empty). Copies are kept apart as
    members, so a group of n copies is n rows and not n * n pairs. ``words``: texts,
    arrays of words or of their hashes."""
    extra = [c for c, _ in order if c not in scope and c != id_col]
    with small_batches(docs.sparkSession):
        named = scratch_table(named_sets(docs.select(*scope, id_col, *extra, F.col(words).alias("_w")), scope), "set-keys")
    return first_of_sets(named, scope, id_col, order)


def first_of_sets(named: DataFrame, scope: list[str], id_col: str, order: list[tuple[str, bool]]) -> DataFrame:
    """``representatives`` of ``named_sets``."""
    own = named.where("_n > 0").select(*scope, F.col(id_col).alias("id"), order_struct(order).alias("o"), "_n", "_k")
    first = own.groupBy(*scope, "_n", "_k").agg(F.min(F.struct("o", "id")).alias("_f"))
    return own.join(first, [*scope, "_n", "_k"]).select(*scope, "id", F.col("_f.id").alias("representative"))


def word_base(docs: DataFrame, scope: list[str], id_col: str, words: str,
              order: list[tuple[str, bool]]) -> DataFrame:
    return (docs.select(*scope, F.col(id_col).alias("id"), F.col(words).alias("w"),
                        order_struct(order).alias("ord"))
            .withColumn("n", F.size("w"))
            .where(F.col("n") > 0))


def near_dup_pairs(docs: DataFrame, scope: list[str], id_col: str, words: str,
                   order: list[tuple[str, bool]], materialized: bool = False,
                   named: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """All pairs (a earlier than b in ``order``) with Jaccard > 0.85.

    ``docs`` holds (scope..., id, order columns and words: a text, an array of
    distinct words or its ``T.hashed_words``). ``materialized`` says ``docs`` is
    read from files; others are written once. ``named`` holds the documents to pair
    with their ``named_sets``, ``pairs`` the ``similar_sets``, where a caller has them.
    Different sets are joined once and their pairs expanded to all documents that
    have the sets. Output: scope..., a, b, inter, uni, jaccard."""
    extra = [c for c, _ in order if c not in scope and c != id_col]
    texts = docs.select(*scope, id_col, *extra, F.col(words).alias("_w"))
    if not materialized:
        texts = scratch_table(texts, "near-texts")
    if named is None:
        with small_batches(docs.sparkSession):
            named = scratch_table(named_sets(texts, scope), "near-sets")
    if pairs is None:
        pairs = similar_sets(texts.select(*scope, F.col("_w").alias("w")), scope, named.agg(F.sum("_n")).first()[0] or 0)
    members = named.where("_n > 0").select(*scope, F.col(id_col).alias("id"), order_struct(order).alias("ord"), F.col("_n").alias("n"), F.col("_k").alias("k"))
    return expand_pairs(pairs, members.dropna(subset=[*scope, "id"]), scope)


def expand_pairs(pairs: DataFrame, members: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., a, b, inter, uni, jaccard), a earlier than b: the pairs of all members,
    for ``pairs(a, b, inter, uni)`` of sets and ``members(scope, k, id, ord, n)`` of every
    set ``k`` of ``n`` words. Members of a set are dealt into blocks of about ``BLOCK`` and
    meet by block, so no task holds all pairs of a large one."""
    sized = members.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = scratch_table(members.join(sized, "k").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "pair-members")
    left = dealt.select(*scope, "k", F.col("id").alias("x"), F.col("ord").alias("ox"), "blocks")
    right = dealt.select("k", F.col("id").alias("y"), F.col("ord").alias("oy"), "n", "block")

    def over_blocks(df):
        return df.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    several = members.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k")
    inside = (over_blocks(left.join(several, "k", "left_semi")).join(right, ["k", "block"]).where("x < y")
              .withColumns({"inter": F.col("n"), "uni": F.col("n")}))
    across = (over_blocks(pairs.join(left.drop("blocks").withColumnRenamed("k", "a"), "a").join(sized.withColumnRenamed("k", "b"), "b"))
              .withColumnRenamed("b", "k").join(right, ["k", "block"]).where("x != y"))
    names = [*scope, "x", "y", "ox", "oy", "inter", "uni"]
    first = F.struct("ox", "x") < F.struct("oy", "y")
    return inside.select(names).union(across.select(names)).select(
        *scope, F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"),
        "inter", "uni", (F.col("inter").cast("double") / F.col("uni").cast("double")).alias("jaccard"))


# ---------------------------------------------------------------------------
# first-wins resolution over a graph
# ---------------------------------------------------------------------------

#: Rounds before what is left is split into components, and the edges of a
#: component that one task may sweep in order.
ROUNDS_BEFORE_SWEEP, SWEEP_EDGES = 4, 50_000


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decide one component of edges (``a``, ``b``, ``neg``) in topological
    order; ``kept`` is what is known of the source already."""
    needs, gives, known = {}, {}, {}
    for a, b, neg, kept in zip(pdf["a"], pdf["b"], pdf["neg"], pdf["kept"], strict=True):
        needs.setdefault(b, []).append((a, neg))
        gives.setdefault(a, []).append(b)
        if kept is not None:
            known[a] = kept
    left, ready, out = {b: len(v) for b, v in needs.items()}, list(known), {}
    while ready:
        for b in gives.get(ready.pop(), ()):
            left[b] -= 1
            if not left[b]:
                known[b] = out[b] = all(known[a] != neg for a, neg in needs[b])
                ready.append(b)
    if len(out) < len(needs):
        raise ValueError("the similarity edges hold a cycle")
    return pd.DataFrame({"id": list(out), "kept": list(out.values())})


def resolve_first_wins(edges: DataFrame, requires: DataFrame | None = None,
                       decided: DataFrame | None = None) -> DataFrame:
    """Greedy first-wins over a DAG of similarity edges (a earlier than b).

    ``edges(a, b)``: b is dropped if a is kept. ``requires(a, b)``: b is
    only present if a is kept (b dropped when a is dropped). ``decided(id,
    st)`` pre-sets nodes to 'K' or 'D'. Returns ``(id, kept)`` for every
    node named by an edge or ``decided``; nodes not named are kept.

    An edge is a literal of b: "a not kept" (``neg``) or "a kept"; b is kept if
    all its literals hold. Every round evaluates the literals of what the last
    round decided, decides nodes with a false literal or none left, and drops
    decided nodes with their edges, so a round costs what is still open. A node
    with one literal equals its source or the opposite of it: literals on such
    a node move on to that source, so chains halve with every round. What is
    still open after a few rounds is split into components, and those of up to
    ``SWEEP_EDGES`` edges are decided in order by one task each; larger ones
    go on in rounds, without a cap."""
    lits = edges.select("a", "b", F.lit(True).alias("neg"))
    if requires is not None:
        lits = lits.unionByName(requires.select("a", "b", F.lit(False).alias("neg")))
    lits = scratch_table(lits.distinct(), "wins-edges")
    sources = lits.select(F.col("a").alias("id")).distinct()
    if decided is not None:
        done = scratch_table(decided.select("id", (F.col("st") == "K").alias("kept")).distinct(), "wins-decided")
        lits = lits.join(done.select(F.col("id").alias("b")), "b", "left_anti")
    roots = sources.join(lits.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    if decided is not None:
        roots = roots.join(done.select("id"), "id", "left_anti")
    found = scratch_table(roots.withColumn("kept", F.lit(True)), "wins-roots")
    verdicts = [found]
    if decided is not None:
        verdicts.append(done)
        found = found.unionByName(done)
    rounds = 0
    while True:
        seen = scratch_table(lits.join(found.select(F.col("id").alias("a"), "kept"), "a", "left"), "wins-seen")
        open_ = F.col("kept").isNull()
        state = (seen.groupBy(F.col("b").alias("id"))
                 .agg(F.max(~open_ & (F.col("kept") == F.col("neg"))).alias("broken"), F.count(F.when(open_, 1)).alias("n_open"),
                      F.min(F.when(open_, F.struct("a", "neg"))).alias("one")))
        state = scratch_table(state, "wins-state")
        found = scratch_table(state.where("broken or n_open = 0").select("id", (~F.col("broken")).alias("kept")), "wins-found")
        verdicts.append(found)
        single = state.where("not broken and n_open = 1").select(F.col("id").alias("a"), F.col("one").alias("by"))
        lits = seen.where(open_).drop("kept").join(found.select(F.col("id").alias("b")), "b", "left_anti").join(single, "a", "left")
        lits = scratch_table(lits.select(F.coalesce("by.a", "a").alias("a"), "b", F.when(F.col("by").isNull(), F.col("neg"))
                                         .otherwise(F.col("neg") != F.col("by.neg")).alias("neg")).distinct(), "wins-edges")
        rounds += 1
        if lits.limit(1).count() == 0:
            break
        if rounds % ROUNDS_BEFORE_SWEEP == 0:
            known = scratch_table(lits.join(found.withColumnRenamed("id", "a"), "a", "left"), "wins-known")
            placed = known.join(components(known, "wins-components").withColumnRenamed("node", "b"), "b")
            small = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= SWEEP_EDGES).select("root")
            kind = StructType([StructField("id", lits.schema["b"].dataType), StructField("kept", BooleanType())])
            swept = placed.join(small, "root").groupBy("root").applyInPandas(_sweep, kind)
            verdicts.append(scratch_table(swept, "wins-swept"))
            lits = scratch_table(placed.join(small, "root", "left_anti").select("a", "b", "neg"), "wins-edges")
            if lits.limit(1).count() == 0:
                break
    out = verdicts[0]
    for v in verdicts[1:]:
        out = out.unionByName(v)
    return out


# ---------------------------------------------------------------------------
# D2 + D3: exact then fuzzy content de-duplication
# ---------------------------------------------------------------------------

def fuzzy_dedup(docs: DataFrame, scope: list[str], id_col: str, text: str,
                order: list[tuple[str, bool]], materialized: bool = False) -> DataFrame:
    """Adds ``dup_exact`` and ``dup_fuzzy`` flags to ``docs``. ``materialized`` says
    ``docs`` is read from files; the texts of others are written once.

    1. one pass over the text builds the narrow table (scope, id, order,
       content-key hash, name of the word set), materialised once;
    2. exact copies keep their first member (aggregate + join on id, no
       text moves);
    3. survivors with equal word sets: all but the first go, whatever is
       decided of the first (what drops it drops them, too);
    4. the others are joined by the prefix filter and verified;
    5. the greedy first-wins set is resolved over the verified edges;
    6. only the (id, flags) table is joined back to the input."""
    extra = [c for c, _ in order if c not in scope and c != id_col]
    texts = docs.select(*scope, id_col, *extra, F.col(text).alias("_w"))
    if not materialized:
        texts = scratch_table(texts, "fuzzy-texts")
    with small_batches(docs.sparkSession):
        prep = scratch_table(named_sets(texts.select(*scope, id_col, *extra, T.key_hash(T.content_key(F.col("_w"))).alias("_ck"), "_w"), scope), "fuzzy-sets")
    firsts = scratch_table(first_wins(prep.select(*scope, id_col, *extra, "_ck"), scope, F.col("_ck"), order, id_col, "_first")
                           .select(id_col, "_first"), "fuzzy-firsts")
    uniq = prep.join(firsts.where("_first").select(id_col), id_col, "left_semi")
    member = first_of_sets(uniq, scope, id_col, order)
    later = scratch_table(member.where("id != representative").select(F.col("id").alias(id_col), F.lit(False).alias("kept")), "fuzzy-copies")
    alone = firsts.where("_first").select(id_col).join(later, id_col, "left_anti")
    pairs = near_dup_pairs(texts, scope, id_col, "_w", order, materialized=True, named=prep.join(alone, id_col, "left_semi"))
    verdict = resolve_first_wins(pairs.select("a", "b")).withColumnRenamed("id", id_col).unionByName(later)
    flags = scratch_table(firsts.select(id_col, "_first").join(verdict, id_col, "left")
                          .select(id_col, (~F.col("_first")).alias("dup_exact"),
                                  (F.col("_first") & F.coalesce(~F.col("kept"), F.lit(False))).alias("dup_fuzzy")), "fuzzy-flags")
    return docs.join(flags, id_col, "left")


def pooled_dedup(pages: DataFrame, scope: list[str], id_col: str, raw: str, generated: str | None,
                 order: list[tuple[str, bool]]) -> DataFrame:
    """One pool for raw and generated text. Nodes are (page, 0 raw) and
    (page, 1 generated); the generated node exists only if the raw node was
    kept and is checked against everything earlier, its own raw text
    included. Adds ``dup_content`` (raw dropped) and ``dup_generated``.

    Exact copies: when the first node of a content key is a raw node (always
    present), every later copy is dropped whatever else happens, so those
    copies are decided up front and kept out of the similarity join."""
    if generated is None:
        out = fuzzy_dedup(pages, scope, id_col, raw, order)
        return (out.withColumn("dup_content", F.col("dup_exact") | F.col("dup_fuzzy"))
                .withColumn("dup_generated", F.lit(False)).drop("dup_exact", "dup_fuzzy"))
    pages = checkpoint(pages)
    extra = [c for c, _ in order if c != id_col and c not in scope]
    pid_t = pages.schema[id_col].dataType

    def nodes_of(kind, col):
        return pages.select(*scope, F.col(id_col).alias("pid"), *extra,
                            F.lit(kind).alias("kind"), F.col(col).alias("txt"))

    nodes = nodes_of(0, raw).unionByName(nodes_of(1, generated))
    nodes = (nodes.withColumn("nid", F.concat_ws(":", F.col("pid").cast("string"), F.col("kind").cast("string")))
             .withColumn("_ck", T.key_hash(T.content_key(F.col("txt")))))
    node_order = [(c if c != id_col else "pid", a) for c, a in order] + [("kind", True)]
    firsts = (nodes.groupBy(*scope, "_ck")
              .agg(F.min(F.struct(order_struct(node_order).alias("o"), F.col("kind").alias("k"),
                                  F.col("nid").alias("id"))).alias("w"))
              .select(*scope, "_ck", F.col("w.id").alias("first_nid"), F.col("w.k").alias("first_kind")))
    tagged = nodes.join(firsts, [*scope, "_ck"])
    later_of_raw = (F.col("first_kind") == 0) & (F.col("nid") != F.col("first_nid"))
    decided_raw = tagged.where(later_of_raw & (F.col("kind") == 0)).select(F.col("nid").alias("id"), F.lit("D").alias("st"))
    dropped_pids = decided_raw.select(F.split("id", ":")[0].alias("_p"))
    decided_gen = tagged.where(later_of_raw & (F.col("kind") == 1)).select(F.col("nid").alias("id"), F.lit("D").alias("st"))
    decided = decided_raw.unionByName(decided_gen)
    live = (tagged.where(~later_of_raw)
            .join(dropped_pids, (F.col("kind") == 1) & (F.col("pid").cast("string") == F.col("_p")), "left_anti"))
    texts = live.select(*scope, "nid", *[c for c, _ in node_order if c not in scope], "txt")
    sim = near_dup_pairs(texts, scope, "nid", "txt", node_order).select("a", "b")
    req = pages.select(F.concat_ws(":", F.col(id_col).cast("string"), F.lit("0")).alias("a"),
                       F.concat_ws(":", F.col(id_col).cast("string"), F.lit("1")).alias("b"))
    verdict = resolve_first_wins(sim, req, decided)
    parts = verdict.select(F.split("id", ":")[0].cast(pid_t).alias(id_col),
                           F.split("id", ":")[1].alias("_kind"), "kept")
    r0 = parts.where("_kind = '0'").select(id_col, F.col("kept").alias("_k0"))
    r1 = parts.where("_kind = '1'").select(id_col, F.col("kept").alias("_k1"))
    out = (pages.join(r0, id_col, "left").join(r1, id_col, "left")
            .withColumn("dup_content", ~F.coalesce(F.col("_k0"), F.lit(True)))
            .withColumn("dup_generated", ~F.col("dup_content") & ~F.coalesce(F.col("_k1"), F.lit(True)))
            .drop("_k0", "_k1"))
    return out
