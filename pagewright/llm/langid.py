"""Language identification by prediction by partial matching (PPM, escape
method C with exclusion).

Every language has a context tree over bytes: how often each byte follows each
context of 0 to ``ORDER`` = 4 bytes. A byte never seen in the longest context
that was seen pays the escape probability and is looked up in the next shorter
one, without the bytes of the longer, ending in a uniform order. Counts cover
the whole texts of all learning rows and grow with them. A text goes to the
language that codes it in fewest bits.

The tree is kept as the counts of (context of 4 bytes, byte); shorter contexts
are their sums, and a text is preceded by zero bytes. It lies in the shared
folder, partitioned by its last two context bytes. Up to ``TREE_CELLS`` cells
(contexts with a byte, times languages) its rows are broadcast as plain arrays
and every worker grows the tree from them once; beyond that the distinct grams
of the texts meet it by those two bytes, and their code lengths are joined
back to the texts.

Defined cases: a null or letterless text gives ``und`` with score 0, and so
does every text if nothing could be learned; equal code lengths go to the
first language by name; rows with a null lang or id don't teach; repeated
rows count as often as they occur; an empty table gives an empty result;
columns other than doc_id, text and lang are not read."""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import Texts, row_sums, scratch_table

ORDER = 4
TREE_CELLS = 8_000_000
LOW = 1 << 16                    # (one context byte, byte)
UNKNOWN = "und"


class Tree(NamedTuple):
    """Sorted languages, the sums of orders 0 and 1 (``low[gram, lang]``),
    the grams of ``ORDER`` + 1 bytes and their counts by language."""
    langs: list
    low: np.ndarray
    grams: np.ndarray
    counts: np.ndarray


class Model(NamedTuple):
    """``table``: (gram, lang, n) in the shared folder; ``packed``: all of its
    rows as plain arrays (grams, language numbers, counts), or if they are too
    many to broadcast those of the low orders. The trees are grown from them in
    the tasks: the driver holds the packed rows only."""
    table: DataFrame
    langs: list
    packed: list
    whole: bool
    name: str


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The byte at every place under its ``ORDER`` context bytes; a text is
    preceded by zero bytes."""
    out = data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    for k in range(1, ORDER + 1):
        before = np.zeros(len(data), np.int64)
        before[k:] = data[:-k]
        before[place < k] = 0
        out |= before << (8 * k)
    return out


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of every symbol in every order-2 context, under PPM-C with
    exclusion over ``counts[c2, c1, s]``: the dense form of a small alphabet."""
    size = counts.shape[-1]
    n2 = counts.reshape(size * size, size).astype(np.float64)
    n1 = np.tile(counts.sum(0).astype(np.float64), (size, 1))
    n0 = np.tile(counts.sum((0, 1)).astype(np.float64), (size * size, 1))
    prob = np.zeros_like(n2)
    escape = np.ones(len(n2))                          # probability of reaching the order
    open_ = np.ones_like(n2, bool)                     # symbols not excluded yet
    for n in (n2, n1, n0):
        live = np.where(open_, n, 0.0)
        seen = live > 0
        total, kinds = live.sum(1), seen.sum(1)
        # a context that has seen every open symbol has nothing to escape to
        escapes = np.where(kinds == open_.sum(1), 0, kinds)
        norm = np.maximum(total + escapes, 1)
        prob += np.where(seen, live * (escape / norm)[:, None], 0.0)
        escape = escape * np.where(total > 0, escapes / norm, 1.0)
        open_ &= ~seen
    left = np.maximum(open_.sum(1), 1)
    prob += np.where(open_, (escape / left)[:, None], 0.0)
    return -np.log2(np.maximum(prob, 1e-300)).astype(np.float32).ravel()


def _narrow(level):
    """Counts in 32 bits where all of them fit."""
    return tuple(x.astype(np.int32) if x is not None and x.ndim == 2 and x.max(initial=0) < 2**30 else x for x in level)


def _orders(tree: Tree):
    """For every order, longest first: sorted keys (context, byte), their
    counts, sorted contexts, totals, kinds, and the total and kinds of the
    next shorter context without the bytes of this one."""
    levels, keys, counts = [], tree.grams, tree.counts
    for order in range(ORDER, -1, -1):
        if order > 1 and order < ORDER:
            keys, at = np.unique(keys & ((1 << (8 * order + 8)) - 1), return_inverse=True)
            total = np.zeros((len(keys), counts.shape[1]), np.int64)
            np.add.at(total, at, counts)
            counts = total
        elif order == 1:
            keys = np.flatnonzero(tree.low.any(1))
            counts = tree.low[keys]
        elif order == 0:
            keys, counts = np.arange(256), tree.low.reshape(256, 256, -1).sum(0)
        context, start = np.unique(keys >> 8, return_index=True)
        total = np.add.reduceat(counts, start) if len(keys) else counts
        kinds = np.add.reduceat((counts > 0).astype(np.int64), start) if len(keys) else counts
        levels.append([keys, counts, context, start, total, kinds])
    out = []
    for k, (keys, counts, context, start, total, kinds) in enumerate(levels):
        if k == ORDER or not len(keys):
            out.append(_narrow((keys, counts, context, total, kinds, None, None)))
            continue
        short_keys, short_counts, short_context, _, short_total, short_kinds = levels[k + 1]
        order = ORDER - k
        at = np.searchsorted(short_keys, keys & ((1 << (8 * order)) - 1))
        up = np.searchsorted(short_context, context & ((1 << (8 * order - 8)) - 1))
        out_of = np.add.reduceat(np.where(counts > 0, short_counts[at], 0), start)
        out.append(_narrow((keys, counts, context, total, kinds, short_total[up] - out_of, short_kinds[up] - kinds)))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray):
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def gram_bits(levels, wanted: np.ndarray, n_langs: int) -> np.ndarray:
    """Exact bits of the last byte of every wanted gram by language."""
    shape = (len(wanted), n_langs)
    bits, todo = np.zeros(shape), np.ones(shape, bool)
    longer, rest, more, before = np.zeros(shape, bool), np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for k, (keys, counts, context, total, kinds, short_total, short_kinds) in enumerate(levels):
        if not len(keys):
            continue
        gram = wanted & ((1 << (8 * (ORDER - k) + 8)) - 1)
        at, hit = _find(keys, gram)
        n = np.where(hit[:, None], counts[at], 0)
        here, known = _find(context, gram >> 8)
        known = known[:, None] & (total[here] > 0)
        # bytes that the next longer context holds are out
        left = np.where(longer, rest, total[here])
        new = np.where(longer, more, kinds[here])
        escapes = np.where(new == 256 - before, 0, new)
        live = todo & known & (left > 0)
        bits += np.where(live, np.log2(np.maximum(left + escapes, 1)), 0.0)
        done = live & (n > 0)
        bits -= np.where(done, np.log2(np.maximum(n, 1)), 0.0)
        bits -= np.where(live & ~done, np.log2(np.maximum(escapes, 1)), 0.0)
        todo &= ~done
        longer = longer | known
        before = np.where(known, kinds[here], before)
        if short_total is not None:
            rest, more = np.where(known, short_total[here], 0), np.where(known, short_kinds[here], 0)
    return bits + np.where(todo, np.log2(np.maximum(256 - before, 1)), 0.0)


def _counted(data: np.ndarray, offs: np.ndarray):
    """Distinct grams, the index of each place's gram, and the grams' counts."""
    return np.unique(grams(data, offs), return_inverse=True, return_counts=True)


def grow(langs: list, gram: np.ndarray, lang: np.ndarray, n: np.ndarray, low: np.ndarray | None = None) -> Tree:
    """The tree of counted grams; ``lang`` are places in ``langs``."""
    keys, at = np.unique(gram, return_inverse=True)
    counts = np.zeros((len(keys), len(langs)), np.int64)
    counts[at, lang] = n
    if low is None:
        low = np.zeros((LOW, len(langs)), np.int64)
        np.add.at(low, keys & (LOW - 1), counts)
    return Tree(langs, low, keys, counts)


def pack(rows: DataFrame, langs: list) -> list:
    """(gram, lang, n) as a few rows of plain arrays, about 18 bytes a row."""
    place = {lang: k for k, lang in enumerate(langs)}

    def run(batches):
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (
                batch.column(0).to_numpy(), lang, batch.column(2).to_numpy())], names=["gram", "lang", "n"])

    return [tuple(r) for r in rows.select("gram", "lang", "n").mapInArrow(run, "gram binary, lang binary, n binary").collect()]


def unpack(packed: list):
    columns = zip(*packed, strict=True) if packed else ((), (), ())
    return [np.frombuffer(b"".join(c), kind) for c, kind in zip(columns, (np.int64, np.uint16, np.int64), strict=True)]


_GROWN: dict = {}


def _grown(name: str, shared):
    """The orders of a broadcast tree, built once per Python worker."""
    if name not in _GROWN:
        langs, packed = shared.value
        _GROWN.clear()
        _GROWN[name] = _orders(grow(langs, *unpack(packed)))
    return _GROWN[name]


def learn(docs: DataFrame, learning) -> Model:
    """The trees of all languages, from the whole texts of the rows where
    ``learning`` holds. Grams are counted by chunk before they are summed."""
    def run(batches):
        for batch in batches:
            texts, langs = Texts(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, offs in texts.chunks():
                gram = grams(data, offs)
                each, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                row = np.repeat(code, np.diff(offs))
                for k, lang in enumerate(each):
                    found, n = np.unique(gram[row == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found),
                                                      pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    rows = scratch_table(docs.where(F.col("lang").isNotNull() & learning).select("text", "lang")
                         .mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
                         .withColumn("part", F.expr("cast(gram >> 8 & 65535 as int)")).repartition("part"), "lang-tree")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    whole = rows.select("gram").distinct().count() * len(langs) <= TREE_CELLS
    # beyond the bound the low orders only: at most 65,536 rows a language
    kept = rows if whole else rows.groupBy(F.expr("gram & 65535").alias("gram"), "lang").agg(F.sum("n").alias("n"))
    return Model(rows, langs, pack(kept, langs), whole, uuid.uuid4().hex)


def choose(langs: list, bits: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability from ``bits[lang, text]``."""
    best = bits.argmin(0)
    share = 1.0 / np.exp2(np.maximum(bits.min(0) - bits, -1000.0)).sum(0)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0)


def has_letter(texts: Texts) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) for t in texts.strings()], bool)


def classify(texts: Texts, langs: list, levels) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of every text."""
    if not langs or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bits = np.zeros((len(langs), len(texts)))
    for lo, hi, data, offs in texts.chunks():
        found, at, _ = _counted(data, offs)
        each = gram_bits(levels, found, len(langs))
        for k in range(len(langs)):
            bits[k, lo:hi] = row_sums(each[at, k], offs)
    return choose(langs, bits, has_letter(texts))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    if not model.whole:
        return _identify_by_join(docs, model, schema)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.packed))   # up to TREE_CELLS rows of 18 bytes
    name = model.name

    def run(batches):
        for batch in batches:
            langs, share = classify(Texts(batch.column(1)), shared.value[0], _grown(name, shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(share)],
                                             names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _identify_by_join(docs: DataFrame, model: Model, schema: T.StructType) -> DataFrame:
    """The same with the tree as a table: each distinct gram of the texts is
    coded once, in the part of the tree that its last two context bytes name."""
    langs = model.langs
    low = grow(langs, *unpack(model.packed)).low
    shared = docs.sparkSession.sparkContext.broadcast(low)       # at most 65,536 rows a language
    place = {lang: k for k, lang in enumerate(langs)}
    rows = scratch_table(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "lang-rows")

    def split(batches):
        for batch in batches:
            texts = Texts(batch.column(1))
            for lo, hi, data, offs in texts.chunks():
                gram = grams(data, offs)
                for r in range(hi - lo):
                    found, n = np.unique(gram[offs[r]:offs[r + 1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch.column(0)[lo + r].as_py(), np.int64)),
                                                      pa.array(found), pa.array(n.astype(np.int64))],
                                                     names=["_row", "gram", "n"])

    held = scratch_table(rows.select("_row", "text").mapInArrow(split, "_row long, gram long, n long"), "lang-grams")
    wanted = held.select("gram").distinct().withColumn("part", F.expr("cast(gram >> 8 & 65535 as int)"))

    def code(_, tree, grams_):
        levels = _orders(grow(langs, tree["gram"].to_numpy(np.int64), tree["lang"].map(place).to_numpy(np.int64),
                              tree["n"].to_numpy(np.int64), shared.value))
        found = grams_["gram"].to_numpy(np.int64)
        return pd.DataFrame({"gram": found, "bits": pd.Series(list(gram_bits(levels, found, len(langs))), dtype=object)})

    coded = (model.table.groupBy("part").cogroup(wanted.groupBy("part"))
             .applyInPandas(code, "gram long, bits array<double>"))
    total = (held.join(coded, "gram").select("_row", F.posexplode(F.transform("bits", lambda b: b * F.col("n"))).alias("k", "b"))
             .groupBy("_row", "k").agg(F.sum("b").alias("b")).groupBy("_row")
             .agg(F.sort_array(F.collect_list(F.struct("k", "b")))["b"].alias("bits")))      # one per language

    def name(batches):
        for batch in batches:
            texts = Texts(batch.column(1))
            bits = np.array([b or [0.0] * len(langs) for b in batch.column(2).to_pylist()]).reshape(-1, len(langs)).T
            found, share = choose(langs, bits, has_letter(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(share)],
                                             names=schema.names)

    return rows.join(total, "_row", "left").select("doc_id", "text", "bits").mapInArrow(name, schema)
