"""Ranked lexical search over a clustered index whose documents stand in the order of a recursive graph bisection.

Index. A bounded sample of documents (SAMPLE) is bisected; the weights of its cuts send every document to one of up to
2**DEPTH ranges. Ranges are cut into shards by their exact bytes, so that none, however hot, is one task's; a task streams
its shards' texts and closes a block at BLOCK_BYTES or BLOCK_ROWS. Within its block a document gets its place by a
bisection of all the block's documents; CLUSTER places in a row are a cluster. A block is a row of the index: the places'
doc_ids, the terms' postings (place, impact), and each term's highest impact in each cluster. The sample and the ranges
only decide what stands together: results are the same for any.

Search. Items are taken in blocks of about ITEM_TERMS terms, which is what is broadcast. From the clusters' highest
impacts every block gets a bound for every item: the largest sum over its clusters. An item visits the blocks with its
highest bounds first, then more in each of WIDTHS' steps; it stops exactly when no block's bound reaches its current last
score. Within a block it visits clusters by their bounds in the same way. Places turn into doc_ids before anything is
ranked, so ties go by doc_id.

Terms are maximal runs of letters and digits of ASCII and of any other characters, A-Z lower-cased, by 64-bit hashes that
are taken as identities. All scores are integers.

Defined results: null and empty texts, and texts without a term, have no place in the index; texts of any length are
taken whole; repeated rows of a doc_id rank each, rows without doc_id behind others of their score; rows of one item_id
are one item with all their terms, rows without item_id are none; items without a term, or none of whose terms any
document has, have no rows; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bisection, common, shingles

TOP = 10
#: Documents that are bisected for the ranges, at most as many terms of one of them, and the levels of ranges.
SAMPLE, SAMPLE_TERMS, DEPTH = 2000, 1024, 5
#: The ranges' weights are kept for so many hashed terms.
FOLDED = 1 << 15
#: Bytes of texts that a shard aims at, and what closes a block; documents of a cluster.
SHARD_BYTES, BLOCK_BYTES, BLOCK_ROWS, CLUSTER = 4 << 20, 8 << 20, 4096, 64
#: Texts are taken in parts of about so many bytes, cut where no term is.
PART = 1 << 20
#: Distinct (item, term) pairs of a block of items, one item's at least.
ITEM_TERMS = 100_000
#: How many blocks an item has visited after each step; the last step visits all that are left.
WIDTHS = (1, 8, 64)
#: Ids of blocks are broadcast up to so many.
MOST_IDS = 1 << 20
#: Every byte that isn't part of a term becomes a space.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
INDEX = "block string, docs array<bigint>, terms binary, starts binary, places binary, impacts binary, cluster_starts binary, clusters binary, highest binary"


def _summed(owner: np.ndarray, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, term) in order, with their times added up."""
    by = np.lexsort((terms, owner))
    owner, terms, times = owner[by], terms[by], times[by]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])
    at = np.flatnonzero(new)
    return owner[at], terms[at], np.add.reduceat(times, at) if len(at) else times


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of every distinct term of each text, in the order of texts and terms."""
    data, offsets = common.flat_bytes(column)
    found, start, n = [], 0, len(data)
    while start < n:
        stop = min(n, start + PART)
        while stop < n and PLAIN[data[stop]] != 0x20:  # on to where no term is, or a text ends
            ahead = data[stop : stop + 4096]
            gap = np.flatnonzero(PLAIN[ahead] == 0x20)
            edge = offsets[np.searchsorted(offsets, stop)]
            stop = min(stop + (int(gap[0]) if len(gap) else len(ahead)), int(edge))
            if len(gap) or stop == edge:
                break
        first, last = np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, stop, "left")
        hashes, count = shingles.words(PLAIN[data[start:stop]], np.clip(offsets[first : last + 1], start, stop) - start)
        owner = np.repeat(np.arange(first, last), count)
        found.append(_summed(owner, hashes, np.ones(len(owner), np.int64)))
        start = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found)))


def folded(terms: np.ndarray) -> np.ndarray:
    return (terms % np.uint64(FOLDED)).astype(np.int64)


def _ranges(docs: DataFrame, rows: int, size: int) -> np.ndarray:
    """The weights of the ranges' cuts, from a sample of the documents."""
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, size / SHARD_BYTES)))))
    if not depth:
        return np.zeros((0, FOLDED), np.float32)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                owner, term, _ = bags(part.column(0))
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array([term[a : min(z, a + SAMPLE_TERMS)].tobytes() for a, z in zip(bounds, bounds[1:])], pa.binary())], names=["terms"])

    found = docs.select("text").sample(False, min(1.0, SAMPLE / max(rows, 1)), 7).limit(2 * SAMPLE).mapInArrow(terms, "terms binary").toArrow()
    each = [np.unique(folded(np.frombuffer(x, np.uint64))) for x in found.column(0).to_pylist()]
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return bisection.tree(owner, np.concatenate(each) if each else np.zeros(0, np.int64), len(each), depth, FOLDED)


def _placed(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, text, leaf, n_terms) of the documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                owner, term, times = bags(part.column(1))
                leaf = bisection.leaves(owner, folded(term), part.num_rows, shared.value)
                n = np.bincount(owner, weights=times, minlength=part.num_rows).astype(np.int64)
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf.astype(np.int32)), pa.array(n)], names=["doc_id", "text", "leaf", "n_terms"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(place, "doc_id long, text string, leaf int, n_terms long")


def block_row(name: str, docs: pa.Array, texts: pa.Array, documents: int, length: int) -> list:
    """A block of the index, from all its documents; `documents` and `length` are the corpus's counts N and L."""
    owner, hashes, times = bags(texts)
    n = np.bincount(owner, weights=times, minlength=len(texts)).astype(np.int64)
    terms, term = np.unique(hashes, return_inverse=True)
    new = bisection.order(owner, term, len(texts), CLUSTER)
    place = np.empty(len(texts), np.int64)
    place[new] = np.arange(len(texts))
    norm = 100 - 75 + 75 * n * documents // length
    impact = 1_000_000_000 * times // (1000 * times + 8 * norm[owner])
    by = np.lexsort((place[owner], term))
    term, at, impact = term[by], place[owner][by], impact[by]
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    key = term * (len(texts) // CLUSTER + 1) + at // CLUSTER
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    cluster_starts = np.searchsorted(term[first], np.arange(len(terms) + 1))
    parts = (terms, starts.astype("<i4"), at.astype("<u2"), impact.astype("<i4"), cluster_starts.astype("<i4"), (at[first] // CLUSTER).astype("u1"), np.maximum.reduceat(impact, first).astype("<i4"))
    return [name, docs.take(pa.array(new)), *(x.tobytes() for x in parts)]


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The stored index of (doc_id, text), and how many documents and terms with repeats it holds."""
    spark = docs.sparkSession
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    placed = common.stored(spark, _placed(docs, _ranges(docs, rows, size)), "placed", "zstd")
    stats = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("n_terms").alias("terms"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # 2**DEPTH rows
    documents, length = sum(r["n"] for r in stats), sum(r["terms"] for r in stats)
    pieces = {r["leaf"]: max(1, -(-r["bytes"] // SHARD_BYTES), -(-r["n"] // BLOCK_ROWS)) for r in stats}
    number = F.create_map(*(F.lit(int(x)) for pair in pieces.items() for x in pair)) if pieces else F.create_map(F.lit(0), F.lit(1))
    # A row's place in the stored table deals it out, so that rows alike are spread too.
    piece = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(number, F.col("leaf"))).alias("piece")
    shards = sum(pieces.values())
    dealt = placed.select("doc_id", "text", "leaf", piece).repartition(max(1, min(shards, 4096 + shards // 64)), "leaf", "piece").sortWithinPartitions("leaf", "piece")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held, held_bytes, now = [], 0, None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            row = block_row(uuid.uuid4().hex, table.column("doc_id").combine_chunks(), table.column("text").combine_chunks(), documents, length)
            kinds = [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([x.to_pylist() if isinstance(x, pa.Array) else x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 32) + batch.column(3).to_numpy(zero_copy_only=False)
            sizes = np.cumsum(common.lengths(batch.column(1)))
            a = 0
            while a < batch.num_rows:
                if held and (keys[a] != now or held_bytes >= BLOCK_BYTES or sum(x.num_rows for x in held) >= BLOCK_ROWS):
                    yield close()
                    held, held_bytes = [], 0
                before = int(sizes[a - 1]) if a else 0
                z = min(int(np.searchsorted(sizes, before + BLOCK_BYTES - held_bytes, "left")) + 1, a + BLOCK_ROWS - sum(x.num_rows for x in held), batch.num_rows)
                change = np.flatnonzero(keys[a:z] != keys[a])
                z = a + int(change[0]) if len(change) else z
                held.append(batch.slice(a, z - a))
                held_bytes, now, a = held_bytes + int(sizes[z - 1]) - before, keys[a], z
        if held:
            yield close()

    index = common.stored(spark, dealt.mapInArrow(common.released(build), INDEX), "index", "zstd")
    common.drop(placed)
    return index, documents, length


class Items:
    """A block of items: their terms' weights, and where an index block's terms are among them."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray):
        self.ids, self.item = np.unique(item, return_inverse=True)
        self.terms, self.term = np.unique(term, return_inverse=True)
        self.times = times
        self.weight = np.zeros(len(times), np.int64)

    def weigh(self, df: dict[int, int], documents: int) -> None:
        """Sets weights from how many documents have each term (by its number)."""
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(self.terms))], np.int64)
        self.weight = w[self.term] * self.times
        self.starts = np.searchsorted(self.item, np.arange(len(self.ids) + 1))


def _among(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted terms are among sorted terms, and whether they are."""
    at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
    return at, (terms[at] == wanted) if len(terms) else np.zeros(len(wanted), bool)


def _spans(starts: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the terms' spans, and for each which of the terms it belongs to."""
    n = starts[term + 1] - starts[term]
    of = np.repeat(np.arange(len(term)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[term], n), of


class Block:
    """A row of the index, read."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        read = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
        self.terms, self.cluster_starts = read("terms", np.uint64), read("cluster_starts", "<i4")
        self.clusters, self.highest = read("clusters", "u1"), read("highest", "<i4")
        self.read, self.batch, self.k = read, batch, k

    @functools.cached_property
    def postings(self) -> tuple[np.ndarray, ...]:
        return self.read("starts", "<i4"), self.read("places", "<u2"), self.read("impacts", "<i4")

    @functools.cached_property
    def docs(self) -> pa.Array:
        return self.batch.column("docs")[self.k].values

    def bounds(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The highest score that any document of each cluster can have. (Sums of integers under 2**53, exact as doubles.)"""
        at, of = _spans(self.cluster_starts, term)
        return np.bincount(self.clusters[at], weights=weight[of] * self.highest[at].astype(np.int64), minlength=1).astype(np.int64)

    def visit(self, term: np.ndarray, weight: np.ndarray, bounds: np.ndarray, least: int, top: int) -> tuple[np.ndarray, list]:
        """The best scores, and their doc_ids, among documents with a score of `least` or more."""
        starts, places, impacts = self.postings
        at, of = _spans(starts, term)
        place, worth = places[at], weight[of] * impacts[at].astype(np.int64)
        inside = place // CLUSTER
        by = np.argsort(-bounds, kind="stable")
        scores, open_ = np.zeros(len(self.docs), np.int64), np.zeros(len(bounds), bool)
        for k in (4, len(by)):  # the likeliest clusters first, then those that can still matter
            now = by[:k][(bounds[by[:k]] >= max(least, 1)) & ~open_[by[:k]]]
            if not len(now):
                continue
            fresh = np.zeros(len(bounds), bool)
            fresh[now] = True
            open_ |= fresh
            use = fresh[inside]
            scores += np.bincount(place[use], weights=worth[use], minlength=len(scores)).astype(np.int64)
            if len(scores) >= top:
                least = max(least, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
        rows = np.flatnonzero(scores >= max(least, 1))
        ids = self.docs.take(pa.array(rows)).to_pylist()
        best = sorted(range(len(rows)), key=lambda i: (-scores[rows[i]], ids[i] is None, ids[i]))[:top]
        return scores[rows[best]], [ids[i] for i in best]


def _items(items: DataFrame, text: str) -> DataFrame:
    """(item_id, term, times): the terms of every item, stored."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                owner, term, times = bags(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(term.view(np.int64)), pa.array(times)], names=["item_id", "term", "times"])

    found = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col(text).alias("text")).mapInArrow(terms, "item_id long, term long, times long")
    return common.stored(items.sparkSession, found.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "items")


RESULT = "item_id long, rank int, doc_id long, score long"


def search(index: DataFrame, documents: int, items: DataFrame, text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of an index of build_index() for every item's text."""
    spark = index.sparkSession
    terms = _items(items, text)
    blocks = max(1, -(-terms.count() // ITEM_TERMS))
    parts = []
    for k in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "term").toArrow()  # about ITEM_TERMS rows
        if own.num_rows:
            column = lambda c: own.column(c).to_numpy()
            parts.append(_search_block(index, documents, Items(column("item_id"), column("term").view(np.uint64), column("times")), top))
    common.drop(terms)
    return functools.reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], RESULT)


def _search_block(index: DataFrame, documents: int, items: Items, top: int) -> DataFrame:
    spark = index.sparkSession
    context = spark.sparkContext
    wanted = context.broadcast(items.terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own, starts = np.frombuffer(batch.column(0)[k].as_buffer(), np.uint64), np.frombuffer(batch.column(1)[k].as_buffer(), "<i4")
                at, there = _among(own, wanted.value)
                total[there] += np.diff(starts)[at[there]]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], names=["k", "n"])

    df = index.select("terms", "starts").mapInArrow(frequencies, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # one row a term
    wanted.destroy()
    items.weigh({r["k"]: r["n"] for r in df}, documents)
    shared = context.broadcast(items)

    def reached(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(item's number, its terms in the block, their weights, the clusters' bounds) where any term is there."""
        own = shared.value
        at, there = _among(block.terms, own.terms)
        for i, (a, z) in enumerate(zip(own.starts.tolist(), own.starts[1:].tolist())):
            term = own.term[a:z]
            use = there[term]
            if use.any():
                term, weight = at[term[use]], own.weight[a:z][use]
                yield i, term, weight, block.bounds(term, weight)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [(i, int(b.max())) for i, _, _, b in reached(Block(batch, k)) if b.max() > 0]
                if found:
                    i, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[k].as_py()] * len(i)), pa.array(i, pa.int32()), pa.array(b, pa.int64())], names=["block", "i", "bound"])

    bounded = common.stored(spark, index.select("block", "terms", "cluster_starts", "clusters", "highest").mapInArrow(bounds, "block string, i int, bound long"), "bounds")
    ordered = Window.partitionBy("i").orderBy(F.desc("bound"))
    likely = bounded.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= WIDTHS[-1] + 1).collect()  # 65 rows an item
    highest: list[list[int]] = [[] for _ in items.ids]
    for r in sorted(likely, key=lambda r: (r["i"], r["rank"])):
        highest[r["i"]].append(r["bound"])

    least = np.ones(len(items.ids), np.int64)  # the last of an item's best scores, once it has `top`
    high = np.full(len(items.ids), np.iinfo(np.int64).max)  # blocks with this bound or more are visited
    best: DataFrame | None = None
    for width in (*WIDTHS, None):
        edge = np.array([x[width - 1] if width and len(x) >= width else 0 for x in highest], np.int64)
        low = np.maximum(least, edge)
        more = width is None and any(len(x) > WIDTHS[-1] for x in highest)
        if not more and not any(l <= bound < h for x, l, h in zip(highest, low.tolist(), high.tolist()) for bound in x):
            continue
        fresh = _visit(index, bounded, reached, low, high, least.copy(), top)
        order = Window.partitionBy("i").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        both = fresh if best is None else best.drop("rank").unionByName(fresh)
        now = common.stored(spark, both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "best")
        if best is not None:
            common.drop(best)
        best, high = now, np.minimum(high, low)
        for r in best.where(F.col("rank") == top).select("i", "score").collect():  # a row an item
            least[r["i"]] = max(least[r["i"]], r["score"])
    common.drop(bounded)
    shared.destroy()
    if best is None:
        return spark.createDataFrame([], RESULT)
    names = spark.createDataFrame([(k, int(i)) for k, i in enumerate(items.ids.tolist())], "i int, item_id long")
    return best.join(F.broadcast(names), "i").select("item_id", "rank", "doc_id", "score")  # a row for each item of the block


def _visit(index: DataFrame, bounded: DataFrame, reached, low: np.ndarray, high: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """(i, doc_id, score): the best of each block for the items whose bound there is at least `low` and below `high`.

    Scores under `least` are left out.
    """
    spark = index.sparkSession
    limits = spark.createDataFrame([(k, int(a), int(z)) for k, (a, z) in enumerate(zip(low, high)) if a < z], "i int, low long, high long")
    ids = bounded.join(F.broadcast(limits), "i").where("bound >= low AND bound < high").select("block").distinct()
    if ids.count() <= MOST_IDS:
        index = index.join(F.broadcast(ids), "block", "left_semi")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch, k)
                found: tuple[list, list, list] = [], [], []
                for i, term, weight, bounds in reached(block):
                    if low[i] <= bounds.max() < high[i]:
                        scores, docs = block.visit(term, weight, bounds, int(least[i]), top)
                        found[0].extend([i] * len(docs))
                        found[1].extend(docs)
                        found[2].extend(scores.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=["i", "doc_id", "score"])

    return index.mapInArrow(visit, "i int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents of each item, best first."""
    index, documents, _ = build_index(docs)
    return search(index, documents, items)


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), docs AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n, words FROM words WHERE len(words) > 0
), totals AS (
  SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM docs
), tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(words) AS term FROM docs) GROUP BY ALL
), items AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL)
  GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(totals.N) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, totals WHERE term IN (SELECT term FROM items) GROUP BY term
), scores AS (
  SELECT i.item_id, d.row, d.doc_id, CAST(sum(i.times * w.w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (100 - 75 + (75 * d.n * totals.N) // totals.L)))) AS BIGINT) AS score
  FROM items i JOIN weights w USING (term) JOIN tf d USING (term), totals GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
