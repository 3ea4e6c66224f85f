"""Byte-level BPE with a local rank file, by the tiktoken library: ids of whole texts, and raw bytes of ids.

The library's pattern parts a text into matches that are merged separately. Long texts are cut before the library sees
them, at places that no match reaches over: where white space follows something else, a match ends whatever comes
before or after. A run of white space is one match (all of it at the end of a text, all but its last character
elsewhere); the library's regular expressions give up on very long runs, so those go to its merges directly. Every cut
part thus gives the ids it has within its text. Decoding joins the ranks' bytes, which needn't be valid UTF-8 part by
part.

Defined results: null and empty texts have no ids, null and empty ids no bytes; rows are judged each, equal texts alike,
and rows without doc_id like others; a match of any length is merged whole; ids that no rank has raise ValueError; input
columns but the text (the ids) stay as they are, and one named like the output is replaced; an empty table gives none.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer texts are cut into parts of about so many characters; runs of white space over RUN characters are parts.
PART, RUN = 1 << 16, 1 << 10
#: What the library's regular expressions take for white space (Unicode's White_Space).
WHITE = "\t-\r \x85\xa0  -     　"
CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
RUNS = re.compile(f"[{WHITE}]{{{RUN},}}")
#: What a pattern must look like for these cuts to be safe: runs of one class, at most one space before them.
SPACES = r"|\s+(?!\S)|\s+"


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """The parts of a text in order; True: a part is one match."""
    start = 0
    for run in RUNS.finditer(text) if len(text) >= RUN else ():
        stop = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((p, False) for p in cuts(text, start, run.start()))
        yield text[run.start() : stop], True
        start = stop
    yield from ((p, False) for p in cuts(text, start, len(text)))


def cuts(text: str, start: int, stop: int) -> Iterator[str]:
    """text[start:stop] in parts of PART characters or more that end before white space."""
    while stop - start > PART and (found := CUT.search(text, start + PART, stop)) and found.start() < stop:
        yield text[start : found.start()]
        start = found.start()
    if start < stop:
        yield text[start:stop]


class RankTokenizer:
    """The library's encoding with the ranks of a file; no special tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = pattern.endswith(SPACES)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.known = np.zeros(int(self.ids.max(initial=0)) + 1, bool)
        self.known[self.ids] = True

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cut or len(text) < RUN:
            return little(self.library.encode_ordinary(text))
        return b"".join(little(self.library._encode_single_piece(p) if one else self.library.encode_ordinary(p)) for p, one in parts(text))

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of ids laid end to end."""
        found = np.frombuffer(ids or b"", "<u4")
        if len(found) and not (found.max() < len(self.known) and self.known[found].all()):
            raise ValueError("an id that no rank has")
        return self.library.decode_bytes(found.tolist())


def little(ids: list[int]) -> bytes:
    out = array("I", ids)
    return out.tobytes() if out.itemsize == 4 and sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


_loaded: dict[tuple[str, str], RankTokenizer] = {}


def tokenizer(path: str, pattern: str) -> RankTokenizer:
    """The tokenizer of a rank file, loaded once in each process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = RankTokenizer(path, pattern)
    return _loaded[path, pattern]


def _mapped(df: DataFrame, column: str, out: str, convert) -> DataFrame:
    """df with `column` replaced by a binary column `out`, made from it value by value in the workers."""
    kept = [c for c in df.columns if c not in (column, out)]
    source = df.select(*kept, F.col(column).alias(out))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"`{out}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([convert(v.as_py()) for v in batch.column(len(kept))], pa.large_binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made.cast(pa.binary())], names=batch.schema.names)

    return source.mapInArrow(run, schema)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the texts' ids (binary: little-endian unsigned 32-bit integers) in place of the texts."""
    return _mapped(df, text, out, lambda v: tokenizer(path, pattern).encode(v))


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the ids' raw bytes in place of the ids."""
    return _mapped(df, ids, out, lambda v: tokenizer(path, pattern).decode(v))


def rank_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: texts are encoded, then their ids decoded."""
    coded = encode_texts(docs.select("doc_id", "text"), path, pattern)
    told = coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode_ids(told, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
