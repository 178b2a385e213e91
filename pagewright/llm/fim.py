"""Fill-in-the-middle transformation over a Roaring-style boundary set.

A text of n tokens has n + 1 boundaries: 0 and the end of every token, in code
points. They are kept as a set of containers by the upper bits of the offset
(``SPAN`` offsets each), every container in the smallest of three forms: a
sorted array, a bitmap or runs. Cumulative cardinalities of the containers find
the container of the k-th boundary by binary search, and a select inside it
gives the offset; both cuts are found this way.

A token is a run of other characters with the whitespace before it, or the
whitespace at the end of the text. Lengths of prefix and middle, the form and
the rate come from the hash of seed and doc_id, so a run repeats itself.

Defined cases: a null text is an empty one; an empty text, and a text that
holds a marker, stays plain; a null id hashes as the empty string; repeated
rows each give a row; an empty table gives an empty result; columns other than
doc_id and text are not read."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import CHUNK_BYTES, WHITESPACE, Texts

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16
ARRAY, BITMAP, RUNS = 0, 1, 2
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in WHITESPACE]] = True


class Boundaries(NamedTuple):
    """``high``: upper bits of the containers; ``before``: members in front of
    each (one more entry for all); ``kind`` and ``data`` of each container.
    Data are sorted low bits (array), 64-bit words with the members before
    each word (bitmap), or starts with the members before each run (runs)."""
    high: np.ndarray
    before: np.ndarray
    kind: list
    data: list

    @classmethod
    def of(cls, offsets: np.ndarray) -> Boundaries:
        """From sorted distinct offsets."""
        upper = offsets // SPAN
        cut = np.flatnonzero(np.diff(upper, prepend=-1))
        kinds, data = [], []
        for lo, hi in zip(cut, [*cut[1:], len(offsets)], strict=True):
            low = (offsets[lo:hi] % SPAN).astype(np.uint16)
            first = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
            size = {ARRAY: 2 * len(low), BITMAP: SPAN // 8, RUNS: 4 * len(first)}
            kind = min(size, key=size.get)
            kinds.append(kind)
            if kind == ARRAY:
                data.append(low)
            elif kind == RUNS:
                data.append((low[first], first))
            else:
                bits = np.zeros(SPAN, np.uint8)
                bits[low] = 1
                each = bits.reshape(-1, 64).sum(1, dtype=np.int64)
                data.append((np.packbits(bits, bitorder="little").view(np.uint64), np.cumsum(each) - each))
        return cls(upper[cut], np.append(cut, len(offsets)), kinds, data)

    def __len__(self):
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th member, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.high[c]) * SPAN + self._local(c, k - int(self.before[c]))

    def _local(self, c: int, k: int) -> int:
        if self.kind[c] == ARRAY:
            return int(self.data[c][k])
        parts, before = self.data[c]
        p = int(np.searchsorted(before, k, "right")) - 1
        if self.kind[c] == RUNS:
            return int(parts[p]) + k - int(before[p])
        bits = np.unpackbits(parts[p:p + 1].view(np.uint8), bitorder="little")
        return 64 * p + int(np.flatnonzero(bits)[k - int(before[p])])


def token_ends(data: np.ndarray) -> np.ndarray:
    """0 and the ends of the tokens of one text (UTF-8), in code points."""
    space = _SPACE[data]
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1 if len(data) else np.zeros(0, np.int64)
    ends = np.append(last, len(data)) if len(data) else last
    if not len(ends):
        return np.zeros(1, np.int64)
    lead = ((data & 0xC0) != 0x80).view(np.uint8)
    each = np.add.reduceat(lead, np.concatenate([[0], ends[:-1]]), dtype=np.int64)
    return np.concatenate([[0], np.cumsum(each)])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearranged(text: str, a: int, b: int, form: str) -> str:
    if form == "psm":
        return f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
    if form == "spm":
        return f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return text


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""
    text = F.coalesce("text", F.lit(""))
    h = draws(F.col("doc_id"), seed)
    marked = F.greatest(*[F.contains(text, F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = Texts(batch.column(1))
            for lo, hi, data, offs in texts.chunks(CHUNK_BYTES):
                strings = texts.column.slice(lo, hi - lo).to_pylist()
                forms, h1, h2 = (batch.column(c).slice(lo, hi - lo) for c in (2, 3, 4))
                n, cuts, out = [], [], []
                for i, (t, f, x, y) in enumerate(zip(strings, forms.to_pylist(), h1.to_pylist(), h2.to_pylist(), strict=True)):
                    ends = Boundaries.of(token_ends(data[offs[i]:offs[i + 1]]))
                    n.append(len(ends) - 1)
                    if f == "plain":
                        cuts.append((None, None))
                        out.append(t)
                        continue
                    a, b = (ends.select(k) for k in sorted((x % len(ends), y % len(ends))))
                    cuts.append((a, b - a))
                    out.append(rearranged(t, a, b, f))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), forms, pa.array([c[0] for c in cuts], pa.int64()),
                     pa.array([c[1] for c in cuts], pa.int64()), pa.array(out, pa.string())], names=schema.names)

    return docs.select("doc_id", text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone; every marker is in an
    output that isn't plain once."""
    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, start, -1), end, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(output))


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
