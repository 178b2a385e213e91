"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation maximises the sum of piece scores of a given model. The
search reads the text from left to right and needs the best score of only as
many boundaries as the longest piece has characters. Backpointers are kept
until every path that can still survive runs through one boundary; the ids up
to it are then final and leave the window. A character without a piece costs
``UNKNOWN_PENALTY`` more than the worst piece and becomes its UTF-8 bytes
(byte fallback).

Where the vocabulary has no piece with a word mark after another character,
all paths meet before each run of word marks, so the stretches between such
boundaries are independent and recent ones are remembered (a bounded cache).
Stretches are searched many at once: a boundary that no piece of the text
crosses is one where all paths meet, and the parts between such boundaries
advance side by side, each with a window of the longest piece. A stretch with
a long part is searched alone.

The model file's path is a parameter; the model is never trained here.

Defined cases: a null or empty text has no ids and decodes to the empty
string; a literal U+2581 goes through byte fallback, so every text round-trips
exactly; equal scores prefer the piece that starts earliest (the longest); ids
outside the vocabulary decode to nothing, control ids too; bytes that aren't
UTF-8 decode to U+FFFD; repeated rows each give a row; an empty table gives an
empty result; of ``docs`` only doc_id and text are read, except by
``tokenize``, which keeps all columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagewright.llm.common import Texts

MARK = "▁"
LITERAL_MARK = "\udc81"            # stands for a U+2581 of the text itself
UNKNOWN_PENALTY = 10.0
CACHE = 1 << 17                    # remembered stretches of at most SHORT characters, in each of two ages
SHORT = 64                         # longest part searched side by side with others
BATCH = 1 << 16                    # characters searched side by side
_NORMAL, _UNUSED_TYPES, _BYTE = 1, (2, 3, 5), 6


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary: scores of the searchable pieces (None for a string that
    only begins one), ids, and the bytes every id decodes to."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.table: dict[str, tuple[float, int] | None] = {}
        self.byte_ids: dict[int, int] = {}
        self.surface: list[bytes] = []
        worst = 0.0
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == _BYTE:
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif kind in _UNUSED_TYPES:
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                self.table[piece] = (score, i)
                worst = min(worst, score)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.unknown = worst - UNKNOWN_PENALTY
        self.longest = max(map(len, self.table), default=1)
        self.splits = all(a == MARK or b != MARK for p in self.table for a, b in zip(p, p[1:], strict=False))
        for piece in list(self.table):
            for n in range(1, len(piece)):
                self.table.setdefault(piece[:n], None)
        self._build_trie()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece as sp
        model = sp.SentencePieceProcessor(model_file=path)

        def kind(i):
            return (_BYTE if model.is_byte(i) else 2 if model.is_unknown(i) else 3 if model.is_control(i)
                    else 5 if model.is_unused(i) else _NORMAL)

        return cls([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())])

    # -- encoding ---------------------------------------------------------------

    def _ids(self, piece: str) -> list[int]:
        """Ids of one step of a path: a piece, or an unknown character's bytes."""
        found = self.table.get(piece)
        if found is not None:
            return [found[1]]
        char = MARK if piece == LITERAL_MARK else piece
        return [self.byte_ids[b] for b in char.encode()]

    def stream(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """Commit after commit: (boundary in ``text``, ids up to it)."""
        n, longest, table, unknown = len(text), self.longest, self.table, self.unknown
        best = [0.0]           # scores of boundaries base, base + 1, ...
        back = [0]             # the previous boundary on each one's best path
        base = done = 0        # first boundary of the window; committed so far
        reach = 0              # the furthest boundary a piece has reached
        check = 4 * longest    # window size at which to look for a meeting point
        for i in range(n):
            here = best[i - base]
            for j in range(i + 1, min(n, i + longest) + 1):
                found = table.get(text[i:j], 0)
                if found == 0 and j > i + 1:
                    break
                if found:
                    score = here + found[0]
                elif j == i + 1:
                    score = here + unknown if found == 0 or not table.get(text[i:j]) else None
                else:
                    continue
                while len(best) <= j - base:
                    best.append(-np.inf)
                    back.append(-1)
                if score > best[j - base]:
                    best[j - base], back[j - base] = score, i
                reach = max(reach, j)
            at = i + 1
            if reach == at or at - base >= check:
                # paths that survive: boundaries a later piece may start from
                alive = [at] if reach == at else self._open(at, reach, best, base)
                meet = self._meet(alive, back, base, done)
                if meet > done:
                    yield meet, self._path(text, done, meet, back, base)
                    done = meet
                if reach == at:
                    best, back, base = [0.0], [at], at
                elif done > base:
                    best, back, base = best[done - base:], back[done - base:], done
                # paths that haven't met are looked at again once the window has doubled
                check = max(4 * longest, 2 * (at - base))

    @staticmethod
    def _open(at, reach, best, base):
        """Boundaries from ``at`` on that some path has reached."""
        return [b for b in range(at, reach + 1) if best[b - base] > -np.inf]

    @staticmethod
    def _meet(alive, back, base, done):
        """The last boundary that the best paths to all of ``alive`` share."""
        paths = set(alive)
        while len(paths) > 1:
            last = max(paths)
            paths.discard(last)
            paths.add(max(back[last - base], done))
        return paths.pop()

    def _path(self, text, done, end, back, base):
        cuts = [end]
        while cuts[-1] > done:
            cuts.append(back[cuts[-1] - base])
        cuts.reverse()
        return [i for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in self._ids(text[a:b])]

    def _stretch(self, text: str) -> bytes:
        ids = [i for _, part in self.stream(text) for i in part]
        return np.array(ids, np.int32).tobytes()

    def _build_trie(self):
        """Edges as sorted (node, character) keys; score and id per node."""
        names = sorted(self.table, key=len)
        node = {"": 0} | {name: k for k, name in enumerate(names, 1)}
        keys = np.array([node[name[:-1]] << 21 | ord(name[-1]) for name in names], np.int64)
        order = np.argsort(keys)
        self.edges, self.child = keys[order], order + 1
        found = [(-np.inf, -1)] + [self.table[name] or (-np.inf, -1) for name in names]
        self.node_score = np.array([score for score, _ in found])
        self.node_id = np.array([i for _, i in found], np.int32)

    def _matches(self, chars, room):
        """Scores and ids by (length - 1, start) of all pieces in ``chars``
        that keep within ``room`` characters, and the longest one's length."""
        scores = np.full((self.longest, len(chars)), -np.inf)
        ids = np.full((self.longest, len(chars)), -1, np.int32)
        far = np.ones(len(chars), np.int64)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for k in range(self.longest):
            key = node << 21 | chars[at + k]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[edge] == key
            at, node = at[hit], self.child[edge[hit]]
            ids[k, at], scores[k, at] = self.node_id[node], self.node_score[node]
            far[at[self.node_id[node] >= 0]] = k + 1
            inside = room[at] > k + 1
            at, node = at[inside], node[inside]
        scores[0, ids[0] < 0] = self.unknown
        return scores, ids, far

    def _side_by_side(self, scores, start, length):
        """Length of the last step of the best path to the boundary after each
        character, for parts given by ``start`` and falling ``length``."""
        width = self.longest + 1
        window = np.full((width, len(start)), -np.inf)
        window[0] = 0.0
        step = np.ones(scores.shape[1], np.int16)
        for p in range(1, int(length[0]) + 1 if len(length) else 0):
            live = int(np.searchsorted(-length, -p, "right"))
            first = start[:live]
            top, pick = np.full(live, -np.inf), np.ones(live, np.int16)
            for size in range(min(p, self.longest), 0, -1):
                score = window[(p - size) % width, :live] + scores[size - 1, first + (p - size)]
                better = score > top
                np.copyto(top, score, where=better)
                np.copyto(pick, size, where=better)
            window[p % width, :live] = top
            step[first + p - 1] = pick
        return step

    def _batch(self, stretches: list[str]) -> list[bytes]:
        """Ids of independent stretches."""
        chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(s) for s in stretches])
        place = np.arange(len(chars))
        scores, ids, far = self._matches(chars, np.repeat(ends, np.diff(ends, prepend=0)) - place)
        cuts = np.flatnonzero(np.maximum.accumulate(place + far) == place + 1) + 1
        start, length = np.concatenate([[0], cuts[:-1]]), np.diff(cuts, prepend=0)
        alone = np.unique(np.searchsorted(ends, start[length > SHORT], "right"))
        order = np.argsort(-length, kind="stable")
        order = order[np.count_nonzero(length > SHORT):]
        start, length = start[order], length[order]
        step = self._side_by_side(scores, start, length)
        last = np.zeros(len(chars), bool)
        at = start + length - 1
        while len(at):
            last[at] = True
            at = at - step[at]
            more = at >= start
            at, start = at[more], start[more]
        last = np.flatnonzero(last)
        size = step[last]
        found = ids[size - 1, last - size + 1]
        bare = [self._ids(chr(c)) for c in chars[last[found < 0]]]
        width = np.ones(len(last), np.int64)
        width[found < 0] = [len(b) for b in bare]
        flat = np.repeat(found, width)
        flat[flat < 0] = [i for b in bare for i in b]
        bounds = np.concatenate([[0], np.cumsum(width)])[np.searchsorted(last, ends)] * 4
        raw = flat.astype(np.int32).tobytes()
        out = [raw[a:b] for a, b in zip([0, *bounds[:-1].tolist()], bounds.tolist(), strict=True)]
        for k in alone.tolist():
            out[k] = self._stretch(stretches[k])
        return out

    def _search(self, keys: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(key, ids): a key is a stretch without its first word mark, the
        other marks as spaces."""
        part, room = [], BATCH
        for key in keys:
            if len(key) >= BATCH:
                yield key, self._stretch(MARK + key.replace(" ", MARK))
                continue
            if len(key) >= room:
                yield from zip(part, self._batch([MARK + k.replace(" ", MARK) for k in part]), strict=True)
                part, room = [], BATCH
            part.append(key)
            room -= len(key) + 1
        if part:
            yield from zip(part, self._batch([MARK + k.replace(" ", MARK) for k in part]), strict=True)

    def _keys(self, text: str) -> list[str]:
        """Keys of the stretches of a text."""
        if MARK in text:
            text = text.replace(MARK, LITERAL_MARK)
        if not self.splits:
            return [text]
        words = text.split(" ")
        if "" not in words:
            return words
        keys, marks = [], 0
        for word in words:
            if word:
                keys.append(" " * marks + word)
                marks = 0
            else:
                marks += 1
        return [*keys, " " * (marks - 1)] if marks else keys

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self._keys(text) if text else [] for text in texts]
        known, new = {}, []
        for key in set().union(*split):
            ids = self.recent.get(key) or self.older.get(key)
            if ids:
                known[key] = ids
            else:
                new.append(key)
        known.update(self._search(new))
        if len(self.recent) + len(known) > CACHE:
            self.older, self.recent = self.recent, {}
        for key, ids in known.items():
            if len(self.recent) >= CACHE:
                break
            if len(key) <= SHORT:
                self.recent[key] = ids
        return [np.frombuffer(b"".join(map(known.__getitem__, keys)), np.int32) for keys in split]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return self.encode_many([text])[0]

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids) -> str:
        size = len(self.surface)
        surface = b"".join([self.surface[i] for i in ids if 0 <= i < size])
        return surface.removeprefix(b" ").decode("utf-8", "replace")


_LOADED: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces.load(path)
    return _LOADED[path]


# -- Spark --------------------------------------------------------------------------

IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))


def _encoded(texts: list[str], path: str) -> pa.Array:
    parts = model(path).encode_many(texts)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about 2 MB of text each."""
    texts = Texts(batch.column(text))
    for lo, hi, _, _ in texts.chunks():
        yield batch.slice(lo, hi - lo), texts.column.slice(lo, hi - lo).to_pylist()


def tokenize(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """``docs`` with its columns and ``ids``, ``n_ids``; columns that already
    have these names are replaced."""
    path = path or default_model()
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "n_ids")]
    schema = T.StructType([*kept, IDS, T.StructField("n_ids", T.IntegerType())])
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch, names.index(column)):
                ids = _encoded(texts, path)
                yield pa.RecordBatch.from_arrays([*part.columns, ids, ids.value_lengths().cast(pa.int32())],
                                                 names=schema.names)

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


def detokenize(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = path or default_model()
    schema = T.StructType([coded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = [model(path).decode(ids or ()) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=schema.names)

    return coded.select("doc_id", "ids").mapInArrow(run, schema)


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): ids of every text, and whether they
    decode to it."""
    path = path or default_model()
    schema = T.StructType([docs.schema["doc_id"], IDS, T.StructField("n_ids", T.IntegerType()),
                           T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch, 1):
                ids = _encoded(texts, path)
                flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
                same = [model(path).decode(flat[a:b].tolist()) == t
                        for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, ids.value_lengths().cast(pa.int32()),
                                                  pa.array(same)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
