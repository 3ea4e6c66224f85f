"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, convolved by filters of several widths, rectified, max-pooled over a window of fixed length and
classified by softmax. A text's windows cover it whole, side by side; its prediction is the language with the highest
mean probability over its windows. Where the network is applied, embedding and filters are multiplied out into tables
over byte pairs, so a window costs table rows and additions only.

The network learns from a bounded sample: about SAMPLE texts of each language (fewer where TOTAL texts would be
passed), chosen by a hash of doc_id, and WINDOWS windows of each, cut where the texts are. Every language that has a
label can be predicted, and everything else covers all rows.

Defined results: null text, or a text without a letter: `und`, score 0. No labelled text at all: `und` for every row.
Null languages and rows without doc_id are never learned; the latter are not held out. Repeated texts get equal predictions; every input row gives one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, WINDOWS, TOTAL = 1500, 3, 200_000
WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 5, 128, 0.01


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's category L (numbers in circles or fractions aren't)."""
    return any(map(str.isalpha, text))


@dataclass
class ByteNet:
    """Parameters: embedding, a filter bank (width x EMBED x FILTERS) with bias for each width, output layer."""

    languages: list[str]
    embed: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    _tables: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows over the pair at a position (all widths), the third byte (width 3), the second pair (width 4)."""
        if self._tables is None:
            t = [[self.embed @ bank[k] for k in range(len(bank))] for bank in self.banks]
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            first = np.concatenate([pair(t[0][0], t[0][1]), pair(t[1][0], t[1][1]), pair(t[2][0], t[2][1])], axis=1)
            self._tables = first.astype(np.float32), t[1][2].astype(np.float32), pair(t[2][2], t[2][3]).astype(np.float32)
        return self._tables

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Max-pooled, rectified filter outputs of windows (n x WINDOW bytes, padded by 3 zeros)."""
        first, third, second = self.tables()
        n = len(windows)
        padded = np.zeros((n, WINDOW + 3), np.uint8)
        padded[:, :WINDOW] = windows
        out = np.empty((n, 3 * FILTERS), np.float32)
        for s in range(0, n, 64):
            b = padded[s : s + 64]
            pairs = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            h = first.take(pairs[:, :WINDOW].ravel(), axis=0)
            h[:, FILTERS : 2 * FILTERS] += third.take(b[:, 2 : WINDOW + 2].ravel(), axis=0)
            h[:, 2 * FILTERS :] += second.take(pairs[:, 2 : WINDOW + 2].ravel(), axis=0)
            out[s : s + 64] = h.reshape(len(b), WINDOW, 3 * FILTERS).max(axis=1)
        return np.maximum(out + np.concatenate(self.biases).astype(np.float32), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.out.astype(np.float32) + self.out_bias.astype(np.float32)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts laid end to end (zero-padded at each text's end), and the text of each."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), n)
    start = np.cumsum(n) - n
    out = np.zeros((int(n.sum()), WINDOW), np.uint8)
    within = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    out.reshape(-1)[np.repeat(start * WINDOW, sizes) + within] = data
    return out, text


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 0) -> ByteNet:
    """Fits the network by Adam on weighted cross-entropy; each language weighs the same."""
    g = np.random.default_rng(seed)
    k = len(languages)
    p = {"embed": g.normal(0, 0.5, (256, EMBED)), "out": g.normal(0, 0.3, (len(WIDTHS) * FILTERS, k)), "out_bias": np.zeros(k)}
    for w in WIDTHS:
        p[f"bank{w}"], p[f"bias{w}"] = g.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)), np.zeros(FILTERS)
    first, second = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}
    weight = (len(labels) / (k * np.maximum(np.bincount(labels, minlength=k), 1)))[labels]
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(g.permutation(len(labels)), max(1, len(labels) // BATCH)):
            b, n = windows[rows], len(rows)
            x = p["embed"].astype(np.float32)[b]
            pools, spots = [], []
            for w in WIDTHS:
                columns = np.concatenate([x[:, t : WINDOW - w + 1 + t] for t in range(w)], axis=2)
                h = columns @ p[f"bank{w}"].astype(np.float32)
                at = h.argmax(axis=1)
                spots.append(at)
                pools.append(np.take_along_axis(h, at[:, None], 1)[:, 0] + p[f"bias{w}"])
            pooled = np.concatenate(pools, axis=1)
            act = np.maximum(pooled, 0)
            z = act @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), labels[rows]] -= 1
            z *= weight[rows][:, None] / n
            grad = {"out": act.T @ z, "out_bias": z.sum(0), "embed": np.zeros_like(p["embed"])}
            back = (z @ p["out"].T) * (pooled > 0)
            for j, w in enumerate(WIDTHS):
                d = back[:, j * FILTERS : (j + 1) * FILTERS]
                at = spots[j][:, :, None] + np.arange(w)  # n x FILTERS x w: only the winning positions carry a gradient
                seen = b[np.arange(n)[:, None, None], at]
                inputs = p["embed"][seen].reshape(n, FILTERS, w * EMBED)
                grad[f"bank{w}"] = np.einsum("nf,nfi->if", d, inputs)
                grad[f"bias{w}"] = d.sum(0)
                np.add.at(grad["embed"], seen.ravel(), (d[:, :, None] * p[f"bank{w}"].T[None]).reshape(-1, EMBED))
            step += 1
            for name, x_ in p.items():
                first[name] = 0.9 * first[name] + 0.1 * grad[name]
                second[name] = 0.999 * second[name] + 0.001 * grad[name] ** 2
                x_ -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(languages, p["embed"], [p[f"bank{w}"].reshape(w, EMBED, FILTERS) for w in WIDTHS], [p[f"bias{w}"] for w in WIDTHS], p["out"], p["out_bias"])


def sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, lang) to (doc_id, lang, window): up to WINDOWS windows of each text with a letter, chosen by a hash."""
    for batch in batches:
        for part in common.slices(batch, "text", 1 << 20):
            docs, texts, langs = (part.column(k).to_pylist() for k in range(3))
            rows = []
            for doc, text, lang in zip(docs, texts, langs):
                if not has_letter(text):
                    continue
                raw = text.encode()
                n = -(-len(raw) // WINDOW)
                turn = common.mix64(np.arange(n, dtype=np.uint64) + np.uint64(zlib.crc32(str(doc).encode()) << 20))
                for k in np.argsort(turn, kind="stable")[:WINDOWS].tolist():
                    rows.append((doc, lang, raw[k * WINDOW : (k + 1) * WINDOW].ljust(WINDOW, b"\0")))
            kinds = pa.int64(), pa.string(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=["doc_id", "lang", "window"])


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 0, total: int = TOTAL) -> ByteNet | None:
    """Trains on (doc_id, text, lang): about `sample` texts of each language, fewer where `total` texts would be passed."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    each = max(1, min(sample, total // len(counts)))
    share = spark.createDataFrame([(name, min(1.0, each / n)) for name, n in counts.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = rows.join(F.broadcast(share), "lang").where(chance < F.col("share")).select("doc_id", "text", "lang")
    found = chosen.mapInArrow(common.released(sample_windows), "doc_id long, lang string, window binary").toArrow()  # WINDOW bytes each
    if not found.num_rows:
        return None
    languages = sorted(counts)
    number = {name: k for k, name in enumerate(languages)}
    windows = np.frombuffer(b"".join(found["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    labels = np.array([number[x] for x in found["lang"].to_pylist()])
    docs = found["doc_id"].to_numpy()
    order = np.lexsort([*windows[:, 7::-1].T, labels, docs])  # the same order wherever rows come from
    return train(windows[order], labels[order], languages, seed)


PREDICTION_SCHEMA = "lang_pred string, score double"


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in common.slices(batch, text, 1 << 20):
                data, offsets = common.flat_bytes(part.column(at))
                letters = np.array([bool(t and has_letter(t)) for t in part.column(at).to_pylist()])
                names, scores = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if net is not None and letters.any():
                    windows, owner = cut_windows(data, offsets)
                    sums = np.zeros((part.num_rows, len(net.languages)))
                    np.add.at(sums, owner, net.probabilities(windows))
                    mean = sums / np.maximum(np.bincount(owner, minlength=part.num_rows), 1)[:, None]
                    best = mean.argmax(axis=1)
                    names = np.where(letters, np.array(net.languages, object)[best], "und")
                    scores = np.where(letters, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(common.released(label), schema)


def fold(of: str = "doc_id", folds: int = 3) -> F.Column:
    """crc32(doc_id as text) mod folds."""
    return F.crc32(F.col(of).cast("string").cast("binary")) % folds


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows whose fold of three is not 1."""
    net = fit(docs.where(fold() != 1))
    return predict(docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")
