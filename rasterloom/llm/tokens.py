"""Token ids of whole texts by the tokenizers library, remembered chunk by chunk.

Both vocabularies read here cut a text into words before they merge. No word reaches over the place where a space or
line feed follows something that isn't white space, nor the one where a mark of MARKS follows a letter A-Z: there texts
are cut into chunks. A batch's chunks are made distinct by Arrow; each new one goes through the tokenizers library
once, with the library's own settings, and is then remembered. So words, added tokens within a text (chunks are only
made where those hold neither white space nor MARKS) and every other rule are the library's. Texts of other
vocabularies go through the library whole.

Defined results: null and empty texts have no ids; equal texts have equal ids; texts without white space, of any
length, are one chunk.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np
import pyarrow as pa

from . import common

#: Remembered chunks of each of two generations, where a caller doesn't say; longer ones than LONGEST aren't kept.
MOST, LONGEST = 400_000, 256
#: Texts are encoded in slices of about so many bytes: the library is called once for a slice's new chunks.
SLICE = 6 << 20
#: Bytes that can't be the end of white space, when a space or line feed follows them.
SOLID = np.ones(256, bool)
SOLID[:0x21] = False
MARKS = b".,;:!?\")"
MARK, LETTER = np.zeros(256, bool), np.zeros(256, bool)
MARK[list(MARKS)] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: What the lower-casing vocabulary does to ASCII before it cuts words.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10]] = 32


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start in texts laid end to end, as sorted positions. Every non-empty text starts one."""
    n = len(data)
    start = (data == 0x20) | (data == 0x0A)
    at = np.flatnonzero(start)
    at = at[at > 0]
    before = data[at - 1]
    good = SOLID[before]
    tail = np.flatnonzero((before >= 0x80) & (before <= 0xAF))  # perhaps the last byte of other white space
    if len(tail):
        k = at[tail]
        p1, p2, p3 = data[k - 1], data[np.maximum(k - 2, 0)], data[np.maximum(k - 3, 0)]
        two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
        ogham = (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)
        general = (p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81))
        wide = (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
        good[tail[two | ogham | general | wide]] = False
    start = np.zeros(n, bool)
    start[at[good]] = True
    start[1:] |= MARK[data[1:]] & LETTER[data[:-1]]
    heads = offsets[:-1]
    start[heads[heads < offsets[1:]]] = True
    return np.flatnonzero(start)


class Memory:
    """Ids of chunks in two generations: when the younger is full it becomes the older, whose chunks move back when met."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.young: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def of(self, keys: list[bytes]) -> list[bytes]:
        """The values of distinct keys."""
        if len(self.young) > self.most:
            self.young, self.older = {}, self.young
        young, older = self.young, self.older
        out = list(map(young.get, keys))
        missing = [k for k, v in enumerate(out) if v is None]
        fresh = []
        for k in missing:
            v = older.get(keys[k])
            if v is None:
                fresh.append(k)
            else:
                out[k] = young[keys[k]] = v
        for k, v in zip(fresh, self.make([keys[k] for k in fresh]) if fresh else ()):
            out[k] = v
            if len(keys[k]) <= LONGEST:
                young[keys[k]] = v
        return out


class WordTokenizer:
    """Ids of a column of texts, as unsigned 32-bit integers laid end to end."""

    def __init__(self, path: str, most: int = MOST):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = self.folds = False
        added = spec.get("added_tokens", [])
        self.added = [t["content"].lower().encode() for t in added]
        if not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() or c in MARKS.decode() for c in t["content"]) for t in added):
            if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
                self.chunked = True
            elif (steps := pre.get("pretokenizers")) and steps[0].get("type") == "Split" and steps[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                self.chunked = self.folds = True
        self.memory = Memory(self.slow, most)

    def slow(self, texts: list[bytes]) -> list[bytes]:
        """The library's ids of each text as little-endian unsigned 32-bit integers."""
        found = self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        if sys.byteorder != "little" or array("I").itemsize != 4:
            return [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in found]
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, end to end, and the n + 1 offsets of the texts in them."""
        data, offsets = common.flat_bytes(column)
        if self.folds:
            folded = FOLD[data]
            raw = folded.tobytes()
            data = data if any(a in raw for a in self.added) else folded  # added tokens are found before anything is folded
        starts = chunk_starts(data, offsets) if self.chunked else offsets[:-1][np.diff(offsets) > 0]
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        ends = np.append(starts, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        words = self.memory.of(coded.dictionary.to_pylist()) if self.chunked else self.slow(coded.dictionary.to_pylist())
        laid = pa.array(words, pa.large_binary()).take(coded.indices)
        _, places, values = laid.buffers()
        ids = np.frombuffer(values, "<u4") if values is not None else np.zeros(0, "<u4")
        places = np.frombuffer(places, np.int64)[: len(starts) + 1] >> 2
        return ids[: int(places[-1])], places[np.searchsorted(starts, offsets)]


_loaded: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, most: int = MOST) -> WordTokenizer:
    """The tokenizer of a path, loaded once in each process; it remembers up to twice `most` chunks."""
    if (path, most) not in _loaded:
        _loaded[path, most] = WordTokenizer(path, most)
    return _loaded[path, most]
