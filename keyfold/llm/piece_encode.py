"""SentencePiece BPE encoding by backtracking, and decoding.

Exact without running merges over the text: Aho-Corasick gives, for each position, the pieces that
start there. From the left, the longest piece is taken that is compatible with the one before it; two
pieces are compatible if running the merges over just their joined text gives these two again. Where
no piece fits, the position is marked in a bitfield as failed and the last piece gives way to its next
shorter one, so no position is tried twice from behind and the work is linear. A sequence of pieces
whose neighbours are all compatible is the one that the merges give.

Texts are cut first where no merge can reach across: before a run of spaces, and between two
characters that no piece holds side by side. Encodings of short parts are kept in bounded tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.llm.runtime import apart, bounded_batches, numbered, released

SPACE = "\u2581"
#: Entries of the younger half of each table of known words and parts, and of known pairs, which are smaller and dearer to find anew.
KNOWN = 1 << 16
KNOWN_PAIRS = 1 << 18
#: Characters of a part up to which its encoding is kept.
SHORT = 48
#: Positions of a long part whose matches are held at once.
SPAN = 1 << 14
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; fixed-size values as bytes."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = data[at]
            out |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return out, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Memory(dict):
    """A bounded table in two halves: when the younger one has `most` entries it becomes the older one, and entries asked for there become young again. One in steady use is never lost."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class PieceModel:
    """A BPE model file with byte fallback, an identity normaliser and a leading space added; other kinds are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        self.pieces, scores, kinds = [], [], []
        for field, value in parts:
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                scores.append(float(np.frombuffer(x.get(2, bytes(4)), "<f4")[0]))
                kinds.append(x.get(3, NORMAL))
        trainer = dict(_fields(next(v for k, v in parts if k == 2)))
        normal = dict(_fields(next(v for k, v in parts if k == 3)))
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or USER in kinds or UNUSED in kinds:
            raise ValueError(f"{path}: not a BPE model with byte fallback, identity normaliser and leading space")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.scores = scores
        self.bytes = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, kinds)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: a piece with a space after another character")
        self.side_by_side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.longest = max(map(len, self.ids))
        self._machine = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or self.merged(p) == [i]:  # a piece that its own text doesn't merge to is never made
                self._machine.add_word(p, (len(p), i))
        self._machine.make_automaton()
        self._pairs, self._parts, self._words = Memory(KNOWN_PAIRS), Memory(KNOWN), Memory(2 * KNOWN)
        #: Text of each id but bytes; the unknown piece has the model's own, " ⁇ " unless it says otherwise.
        surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self._shown = ["" if k == CONTROL else surface if k == UNKNOWN else p.replace(SPACE, " ") for p, k in zip(self.pieces, kinds)]
        self._byte = np.zeros(len(self.pieces), bool)
        self._byte[self.bytes] = True
        self._raw = [x.encode() for x in self._shown]
        for i, b in self.byte_of.items():
            self._raw[i] = bytes([b])
        self._control = np.array([k == CONTROL for k in kinds])

    def merged(self, text: str) -> list[int]:
        """Ids that the merges give for a short text of known characters: the best score first, the leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                return [self.ids[s] for s in symbols]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs[a << 32 | b]
        if known is None:
            known = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
            self._pairs.keep(a << 32 | b, known)
        return known

    def _matches(self, text: str, first: int) -> list[list[tuple[int, int]]]:
        """(length, id) of the pieces that start at each of SPAN positions from `first`, shortest first."""
        count = min(SPAN, len(text) - first)
        out: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        if first == 0 and len(text) <= SPAN:
            for end, match in self._machine.iter(text):
                out[end + 1 - match[0]].append(match)
            return out
        part = text[first : first + SPAN + self.longest - 1]
        for end, match in self._machine.iter(part):
            at = end + 1 - match[0]
            if at < count:
                out[at].append(match)
        return out

    def backtracked(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n = len(text)
        if n <= SHORT:  # the first way down, mostly the right one, without the books of the others
            ids, at, pairs = [], 0, self._pairs
            longest: list = [None] * n
            for end, match in self._machine.iter(text):
                longest[end + 1 - match[0]] = match  # of one start the longest comes last
            while at < n:
                length, i = longest[at]
                if ids:
                    ok = pairs[ids[-1] << 32 | i]
                    if not (self.compatible(ids[-1], i) if ok is None else ok):
                        break
                ids.append(i)
                at += length
            else:
                return ids
        spans = {0: self._matches(text, 0)}
        failed = bytearray((n >> 3) + 1)  # the bitfield
        ids: list[int] = []
        stops: list[int] = [0]
        tries: list[int] = []  # of the matches at each stop, how many shorter ones are left
        compatible = self.compatible
        at, left = 0, len(spans[0][0])
        while at < n:
            span = spans.get(at // SPAN)
            if span is None:
                if len(spans) >= 4:
                    del spans[max(spans, key=lambda s: abs(s - at // SPAN))]
                span = spans[at // SPAN] = self._matches(text, at // SPAN * SPAN)
            here = span[at % SPAN]
            if left < 0:
                left = len(here)
            while left:
                left -= 1
                length, i = here[left]
                end = at + length
                if not failed[end >> 3] >> (end & 7) & 1 and (not ids or compatible(ids[-1], i)):
                    ids.append(i)
                    tries.append(left)
                    stops.append(end)
                    at, left = end, -1
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not ids:
                    raise AssertionError("no encoding")
                ids.pop()
                stops.pop()
                at, left = stops[-1], tries.pop()
        return ids

    def part(self, text: str) -> bytes:
        """Ids, as int32 bytes, of a text that no run of spaces divides."""
        pairs, known = self.side_by_side, self._parts
        if len(text) > 1 and pairs.issuperset(map(add, text, text[1:])):  # most words: nothing to cut
            return np.array(self.backtracked(text), np.int32).tobytes()
        out = []
        cuts = [k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in pairs]
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            piece = text[a:b]
            found = known[piece]
            if found is None:
                if len(piece) == 1:
                    i = self.ids.get(piece)
                    ids = [self.bytes[x] for x in piece.encode()] if i is None else [i]
                else:
                    ids = self.backtracked(piece)
                found = np.array(ids, np.int32).tobytes()
                if len(piece) <= SHORT:
                    known.keep(piece, found)
            out.append(found)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        found = self.part(SPACE + word)
        if len(word) <= SHORT:
            self._words.keep(word, found)
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as int32 bytes; null and empty texts have none."""
        if not text:
            return b""
        if text[0] == " " or "  " in text or SPACE in text:
            return b"".join(map(self.part, _RUNS.findall(SPACE + text.replace(" ", SPACE))))
        known, new = self._words, self._word
        return b"".join([known[w] or new(w) for w in text.split(" ")])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library decodes them: pieces with their spaces, runs of byte pieces as UTF-8, U+FFFD for each byte that is part of no character, less the space before the first piece that isn't a control piece."""
        shown = self._shown
        ids = ids[np.argmin(self._control[ids]) :] if len(ids) and not self._control[ids].all() else ids[:0]
        if len(ids) and self.pieces[ids[0]].startswith(SPACE):
            head, ids = self.pieces[ids[0]][1:].replace(SPACE, " "), ids[1:]
        else:
            head = ""
        if not self._byte[ids].any():
            return head + "".join([shown[i] for i in ids.tolist()])
        try:  # pieces begin and end with a character, so if all bytes are UTF-8, each run of byte pieces is
            return head + b"".join([self._raw[i] for i in ids.tolist()]).decode()
        except UnicodeDecodeError:
            pass
        out, run = [head], bytearray()
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(shown[i])
        out.append(_utf8(bytes(run)))
        return "".join(out)


def _utf8(data: bytes) -> str:
    """Text of bytes; each byte that is part of no character is a U+FFFD of its own."""
    out = []
    while True:
        try:
            return "".join([*out, data.decode()])
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "\ufffd")
            data = data[e.start + 1 :]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model for each worker process and path."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """`keep` (default: all columns but the text) of each row and `ids`, array<int>, the encoding of its whole text; with decode also `decoded`.

    Null and empty texts have no ids and decode to an empty text. Repeated rows are encoded one by one,
    very long texts whole. No rows: no rows. path: the model file, the same on every executor. Nothing is
    shuffled. A kept column that has the name of a result gets underscores behind it.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in zip(keep, apart([f.name for f in extra], keep))] + extra)
    names = [f.name for f in schema]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            coded = [m.encode(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            sizes = np.array([len(c) // 4 for c in coded], np.int64)
            flat = np.frombuffer(b"".join(coded), np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decode:
                columns.append(pa.array([m.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return numbered(docs, [*keep, text]).mapInArrow(released(encode), schema)


def decode_documents(coded: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns but the ids) of each row and `decoded`; null ids: an empty text. A kept column of that name gets underscores behind it."""
    bounded_batches(coded.sparkSession)
    keep = [c for c in coded.columns if c != ids] if keep is None else keep
    schema = T.StructType([T.StructField(n, coded.schema[c].dataType) for c, n in zip(keep, apart(["decoded"], keep))] + [T.StructField("decoded", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return numbered(coded, [*keep, ids]).mapInArrow(released(decode), schema)
