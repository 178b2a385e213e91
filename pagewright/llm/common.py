"""Shared helpers of the training-data operators: byte-level text batches,
vectorised word hashing, shared-folder tables, hash-based row folds.

A *word* is a maximal run of bytes other than space, tab, newline, vertical
tab, form feed and carriage return. A null text counts as empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import scratch_table, ship_package  # noqa: F401

WHITESPACE = " \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 21          # text handled at once by the numpy stages
_WINDOW = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _classes() -> dict[str, np.ndarray]:
    """Byte classes of each token kind; 0 separates, and a token is a maximal
    run of one other class."""
    solid = np.ones(256, np.uint8)
    solid[[ord(c) for c in WHITESPACE]] = 0
    letters = np.zeros(256, np.uint8)
    letters[48:58] = letters[65:91] = letters[97:123] = letters[128:] = 1
    return {"space": solid, "letters": letters, "runs": np.where(letters == 1, 1, 2 * solid).astype(np.uint8)}


_CLASSES = _classes()


def _byte_values(kind: str, fold: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * _MIX)
    if fold:
        values[65:91] = values[97:123]
    values[_CLASSES[kind] == 0] = 0
    return values


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_VALUES = {(kind, fold): _byte_values(kind, fold) for kind in _CLASSES for fold in (False, True)}
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, _BASE)]))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _BASE)]))
    return _POWERS


class Texts:
    """UTF-8 bytes of one string column: ``data`` and row ``offs``; in lower
    case (of all scripts) if asked for."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if lower:
            column = pc.utf8_lower(column)
        n = len(column)
        self.column = column
        buffers = column.buffers()
        if n == 0 or buffers[1] is None:
            self.offs = np.zeros(n + 1, np.int64)
        else:
            self.offs = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1]
        raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = raw[self.offs[0]:self.offs[-1]]
        self.offs = self.offs - self.offs[0]

    def __len__(self):
        return len(self.offs) - 1

    def chunks(self, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, bytes, offsets) of row ranges of about
        ``limit`` bytes; a longer row is a range of its own."""
        lo, n = 0, len(self)
        while lo < n:
            hi = int(np.searchsorted(self.offs, self.offs[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield lo, hi, self.data[self.offs[lo]:self.offs[hi]], self.offs[lo:hi + 1] - self.offs[lo]
            lo = hi

    def strings(self) -> list[str]:
        return self.column.to_pylist()


def words(data: np.ndarray, offs: np.ndarray, fold: bool = True, kind: str = "space"):
    """Starts, ends (bytes) and 64-bit hashes of all tokens, and for each row
    the index of its first token (one more entry at the end). Kinds: "space"
    (words), "letters" (runs of ASCII letters and digits and of non-ASCII
    bytes) and "runs" (those and the runs of symbols between them). ``fold``
    hashes ASCII letters without case. Rows never share a token."""
    out, a, n, classes = [], 0, len(data), _CLASSES[kind]
    while a < n:
        b = min(a + _WINDOW, n)
        while b < n and classes[data[b]] and classes[data[b]] == classes[data[b - 1]]:
            gap = np.flatnonzero(classes[data[b:b + 4096]] != classes[data[b]])
            row = np.searchsorted(offs, b)
            step = min(int(gap[0]) if len(gap) else 4096, int(offs[row]) - b)
            if step == 0:
                break
            b = min(b + step, n)
        out.append(_window_words(data[a:b], offs, a, _VALUES[kind, fold], classes))
        a = b
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    return starts, ends, hashes, np.searchsorted(starts, offs)


def _window_words(seg, offs, a, values, classes):
    n = len(seg)
    edge = np.zeros(n + 1, bool)
    lo, hi = np.searchsorted(offs, (a, a + n + 1))
    edge[offs[lo:hi] - a] = True
    edge[0] = edge[n] = True
    cls = classes[seg]
    edge[1:n] |= cls[1:] != cls[:-1]
    solid = cls > 0
    starts, ends = np.flatnonzero(solid & edge[:-1]), np.flatnonzero(solid & edge[1:]) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    first = starts[0]
    powers = _powers(int((ends - starts).max()))
    place = np.arange(first, n) - np.repeat(starts, np.diff(np.append(starts, n)))
    np.minimum(place, len(powers) - 1, out=place)      # separators after a token have value 0
    total = np.add.reduceat(values[seg[first:]] * powers[place], starts - first)
    return starts + a, ends + a, mix64(total + (ends - starts).astype(np.uint64))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def fold_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def ready(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers."""
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one 0/1 label per id. Repeated ids with different labels
    take the smaller value; rows with a null id or label are left out."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
            .groupBy("doc_id").agg(F.min(F.col(column).cast("int")).alias("y")))


def id_type(df: DataFrame, column: str = "doc_id"):
    return df.schema[column].dataType
