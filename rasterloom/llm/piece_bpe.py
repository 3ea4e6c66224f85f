"""Exact SentencePiece BPE encoding by backtracking, and its decoding.

Encoding never runs the merge queue over a text. A token sequence is the merge result exactly if each token is the
result of merging its own characters and each adjacent pair is left alone when their joined characters are merged.
So the encoder walks a unit left to right taking the longest vocabulary match (found by an Aho-Corasick automaton),
checks each new pair by re-merging it (remembered), falls back to the next shorter match where the pair is not
compatible, and notes in a bitfield the positions from which no way led on.

Texts are cut before runs of the space mark, and where no piece of the vocabulary holds both neighbours: no merge
crosses such a place, so units can be encoded alone and remembered.

Defined results: null counts as empty; empty text has no ids but the end id; characters outside the vocabulary
become byte pieces (or the unknown id in a model without them); any length is taken whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Remembered units of each of two generations: when the younger is full it becomes the older, whose units move back when met.
MOST_UNITS = 300_000


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[i : i + n]
            i += n


codecs.register_error("piece-bytes", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """A SentencePiece BPE model: pieces, scores, and the flags of its normalizer."""

    def __init__(self, path: str):
        import ahocorasick
        import struct

        with open(path, "rb") as f:
            data = f.read()
        pieces, trainer, normal = [], {}, {}
        for field, value in proto_fields(data):
            if field == 1:
                d = dict(proto_fields(value))
                pieces.append((d.get(1, b"").decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, 1)))
            elif field == 2:
                trainer = dict(proto_fields(value))
            elif field == 3:
                normal = dict(proto_fields(value))
        if trainer.get(3, 1) != 2 or normal.get(2) or any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("only BPE models without a character map, user-defined or unused pieces are read")
        self.prefix, self.squeeze = normal.get(3, 1), normal.get(4, 1)
        if self.squeeze:
            raise ValueError("models that squeeze white space are not read")
        #: Kinds of the format: 1 normal, 2 unknown, 3 control, 6 byte.
        self.pieces = pieces
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == 2)
        self.end = next((i for i, p in enumerate(pieces) if p[2] == 3 and p[0] == "</s>"), None)
        self.byte = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == 6}
        self.rank = {p[0]: (-p[1], i) for i, p in enumerate(pieces) if p[2] == 1}
        self.bonds = {s[k : k + 2] for s in self.rank for k in range(len(s) - 1)}
        self.surface = [b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else bytes((int(s[3:5], 16),)) if k == 6 else s.replace(SPACE, " ").encode() for s, _, k in pieces]
        self.controls = {i for i, p in enumerate(pieces) if p[2] == 3}
        self.decimal = [str(i) for i in range(len(pieces))]
        self.pairs = {}
        self.units = Units(self)
        self.words = Units(self, self.cut_word)
        self.matches = ahocorasick.Automaton()
        for s in self.rank:
            if len(s) == 1 or self.merged(s) == [s]:
                self.matches.add_word(s, len(s))
        self.matches.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merge queue itself, for joined pairs and single pieces only: best score first, then leftmost."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(part)
            if b < len(part) and (r := self.rank.get(part[a] + part[b])):
                heapq.heappush(queue, (r[0], a, b, part[a], part[b]))

        for a in range(len(part) - 1):
            offer(a)
        while queue:
            _, a, b, left, right = heapq.heappop(queue)
            if part[a] != left or part[b] != right or after[a] != b:
                continue
            part[a], part[b] = left + right, ""
            after[a] = after[b]
            if after[b] < len(part):
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return [p for p in part if p]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the joined characters of two pieces leaves them apart as they are."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= 2 * MOST_UNITS:
                self.pairs.clear()
            found = self.pairs[left, right] = left[-1] + right[0] not in self.bonds or self.merged(left + right) == [left, right]
        return found

    def backtrack(self, unit: str) -> list[str]:
        """The unit's pieces: longest compatible matches, with a bitfield of failed positions."""
        n = len(unit)
        if unit in self.matches:
            return [unit]
        ends: list[list[int]] = [[i + 1] for i in range(n)]  # a character alone is always a symbol, known or not
        for last, size in self.matches.iter(unit):
            if size > 1:
                ends[last + 1 - size].append(last + 1)
        failed = bytearray(n // 8 + 1)
        path, choice = [0], [len(ends[0]) - 1]
        while path[-1] < n:
            at = path[-1]
            k = choice[-1]
            while k >= 0:
                to = ends[at][k]
                if not failed[to >> 3] >> (to & 7) & 1 and (len(path) == 1 or self.fits(unit[path[-2] : at], unit[at:to])):
                    break
                k -= 1
            if k >= 0:
                choice[-1] = k - 1
                path.append(to)
                choice.append(len(ends[to]) - 1 if to < n else -1)
            else:
                path.pop()
                choice.pop()
                failed[at >> 3] |= 1 << (at & 7)
                if not path:
                    raise AssertionError("no token sequence was found")
        return [unit[a:b] for a, b in zip(path, path[1:])]

    def ids(self, piece: str) -> list[int]:
        if found := self.rank.get(piece):
            return [found[1]]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]

    def normalized(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def cut_word(self, word: str) -> tuple[int, ...]:
        """A word's ids, cut where no piece reaches across."""
        bonds, out, start = self.bonds, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in bonds:
                out.extend(self.units[word[start:i]])
                start = i
        return (*out, *self.units[word[start:]])

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without an end id."""
        words = self.words
        return [i for w in WORD.findall(self.normalized(text or "")) for i in words[w]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids. A space that the model put before the text goes; control ids have no text."""
        surface, pieces = self.surface, self.pieces
        runs: list[list[int]] = [[]]
        if self.controls.isdisjoint(ids):
            runs[0] = ids
        else:  # bytes on both sides of a control id don't form one character
            for i in ids:
                if i in self.controls:
                    runs.append([])
                else:
                    runs[-1].append(i)
        raw = [b"".join([surface[i] for i in run]) for run in runs]
        if self.prefix and (k := next((k for k, run in enumerate(runs) if run), None)) is not None and pieces[runs[k][0]][0].startswith(SPACE):
            raw[k] = raw[k][1:]
        return "".join([r.decode("utf-8", "piece-bytes") for r in raw])


#: A run of space marks with what follows to the next; no piece has a mark after another character.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Units(dict):
    """Remembers the ids of units, twice MOST_UNITS at most."""

    def __init__(self, model: PieceModel, make=None):
        super().__init__()
        self.model, self.make, self.older = model, make, {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        found = self.older.get(unit)
        if found is None:
            m = self.model
            found = self.make(unit) if self.make else tuple([i for p in m.backtrack(unit) for i in m.ids(p)])
        if len(self) >= MOST_UNITS:
            self.older = dict(self)
            self.clear()
        self[unit] = found
        return found


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a path, loaded once in each process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each text (null: no ids) as array<int>; a column of that name is replaced."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).schema.add(out, T.ArrayType(T.IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            ids = [m.encode(t) for t in b.column(kept.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*kept, out])

    return df.select(*kept).mapInArrow(encode, schema)


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each array of ids (null: empty)."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).schema.add(out, "string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = [m.decode(i or []) for i in b.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*kept, out])

    return df.select(*kept).mapInArrow(decode, schema)


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text in one pass; digests of the ids (with the end id) and of the decoded text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        decimal = m.decimal.__getitem__
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = m.encode(text)
                ids.append(m.end)
                rows.append((doc, len(ids), hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, DIGEST_SCHEMA)
