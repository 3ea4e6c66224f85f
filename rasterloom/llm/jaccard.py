"""N-gram Jaccard join: all links of word-shingle sets at a similarity threshold, and their components.

1.  One pass counts, for each of SKETCH hash buckets, the shingles of all documents that fall there. The array has a
    fixed size, is added up in the shuffle with whole counts, and gives an order of shingles, rarest buckets first, that
    is the same everywhere. Any such order gives the same links; this one keeps shared passages out of the prefixes.
    It also tells which shingles may be in very many prefixes; only those are grouped by aggregation and broadcast.
2.  A second pass makes each document's set: its size, a digest of the set (equal sets form a class, and the class's
    smallest doc_id stands for it), a bitmap signature, and the prefix of the set in that order: two sets of n shingles
    that are similar enough share one of their first n - ceil(t n) + 1 shingles, so meeting there loses nothing.
3.  Shingles that the same documents have in their prefixes count as one. Each shingle's smallest id leads; every
    document is paired with the one leader that most of its shingles have, for ROUNDS rounds: no more pairs than
    documents. Verified pairs are links; their components are found by distributed union-find after each round.
4.  Where a prefix shingle still holds members of several components, they are compared in tiles: rows sorted by
    size, in size bands (a band and the one below), cut into blocks of TILE rows; pairs of one component are left out,
    since a further link between them changes no component. A first round of tiles tries the likeliest pair of each
    two components, a last one all that are still apart. A tile's pairs pass the size bound, then the bit-count
    bound of the bitmaps, which limits the overlap from above, then the exact intersection of the sorted arrays,
    which a tile makes from the texts it gets: they take less room in a shuffle than their shingles' hashes.

Joins are merge joins at every size, so that a small input takes no other way than a large one.

Defined results: null or empty text, or a text without words: an empty set, linked with nothing; a text with fewer
words than a shingle is one shingle; equal texts have equal sets and link; an empty table gives no rows. Repeated
rows of one doc_id count once if their texts are alike; else each row's size is reported, and the id is linked by any
of its sets that its prefixes bring together. Rows without doc_id link nothing; their component
is that of the ids with the same set, or null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .shingles import shingle_sets

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
SKETCH, CHUNK = 1 << 23, 1 << 16
TILE, ROUNDS = 2048, 2
#: A tile's sets hold about so many shingles at most; a leader meets so many members in one task.
TILE_SHINGLES, STAR = 1 << 20, 256
#: Bits of the bitmap signatures; a signature of 2**k bits folds to fewer by or-ing its halves.
LEAST_BITS, MOST_BITS = 64, 2048


def _sets(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(*common.flat_bytes(part.column(at)), WORDS)


def shingle_sketch(docs: DataFrame) -> np.ndarray:
    """How many (document, shingle) pairs fall into each of SKETCH buckets, as bytes: eight steps to each doubling.

    Counts have 64 bits until the end, so buckets of common shingles stand out at any size of the input.
    """

    def packed(k: int, part: np.ndarray) -> pa.RecordBatch:
        raw = zstandard.ZstdCompressor(level=1).compress(part.astype("<u8" if part.max() >> 32 else "<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw], pa.binary())], names=["chunk", "counts"])

    def unpacked(raw: bytes) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        return np.frombuffer(raw, "<u8" if len(raw) == 8 * CHUNK else "<u4").astype(np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)  # a task has fewer pairs than that
        for batch in batches:
            for part in common.slices(batch, "text"):
                hashes, _ = _sets(part, 0)
                np.add.at(total, (hashes & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        for s in range(0, SKETCH, CHUNK):
            if (part := total[s : s + CHUNK]).any():
                yield packed(s // CHUNK, part.astype(np.uint64))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + unpacked(raw)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level(x).tobytes()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    rows = docs.select("text").mapInArrow(common.released(count), schema).repartition(16, "chunk").mapInArrow(common.released(add), schema)
    sketch = np.zeros(SKETCH, np.uint8)
    for r in rows.toLocalIterator():  # SKETCH bytes in all
        sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint8)
    return sketch


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that order them: exact to 8, then at eight steps to each doubling, for all of 32 bits."""
    x = np.maximum(counts.astype(np.float64), 1)
    return np.where(counts < 8, counts, np.minimum(8 * np.log2(x) - 16, 255)).astype(np.uint8)


def bitmap(hashes: np.ndarray) -> bytes:
    """A signature of the set: one bit per hash, about four bits for each member, 2**k bits in all."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 4 * len(hashes):
        bits *= 2
    marks = np.zeros(bits, np.uint8)
    marks[(hashes >> np.uint64(40)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def prefix_length(sizes: np.ndarray) -> np.ndarray:
    return sizes - -(-NUMERATOR * sizes // DENOMINATOR) + 1


def _profiles(docs: DataFrame, sketch: np.ndarray, busy: int) -> DataFrame:
    """doc_id, n, key (digest of the set), bits (signature), prefix (rarest shingles first). Stored.

    Shingles of the prefix whose bucket has the level `busy` or more are in a column of that name instead: only they can
    be in very many prefixes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in batches:
            for part in common.slices(batch, "text"):
                hashes, sizes = _sets(part, 1)
                ends = np.cumsum(sizes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                rank = rare[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((rank, owner))  # hashes are sorted within a text already, and lexsort is stable
                by_rank = hashes[order].view(np.int64)
                keep = np.where(sizes > 0, prefix_length(sizes), 0)
                within = np.arange(len(hashes)) - np.repeat(ends - sizes, sizes)
                own = within < np.repeat(keep, sizes)
                hot = own & (rank[order] >= busy)
                lists = []
                for use in (own & ~hot, hot):
                    ends_ = np.cumsum(np.bincount(owner[use], minlength=len(sizes)))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends_]).astype(np.int32)), pa.array(by_rank[use])))
                sets = np.split(hashes, ends[:-1]) if len(sizes) else []
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([bitmap(s) for s in sets], pa.binary()),
                    *lists,
                ], names=["doc_id", "n", "key", "bits", "prefix", "busy"])

    out = docs.select("doc_id", "text").mapInArrow(common.released(profile), "doc_id long, n long, key binary, bits binary, prefix array<long>, busy array<long>")
    out = common.stored(docs.sparkSession, out, "profiles")
    shared.destroy()
    return out


def needed(na, nb):
    """The least intersection that links sets of these sizes: 100 i >= 80 (na + nb - i)."""
    return -(-NUMERATOR * (na + nb) // (DENOMINATOR + NUMERATOR))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (tile, a, b, na, nb, bits_a, bits_b) that the size and bit-count bounds leave, as (tile, a, b)."""
    for batch in batches:
        rows = batch.num_rows
        column = lambda x, k: np.concatenate([batch.column(batch.schema.get_field_index(f"{x}{s}")).to_numpy(zero_copy_only=False) for s in k])  # noqa: E731, B023
        t = {"n": column("n", "ab"), "bits": column("bits_", "ab")}
        t["size"] = np.concatenate([common.lengths(batch.column(batch.schema.get_field_index(f"bits_{s}"))) for s in "ab"])
        na, nb = t["n"][:rows], t["n"][rows:]
        fits = np.flatnonzero(np.minimum(na, nb) >= needed(na, nb))
        keep, _, _ = bits_fit(t, fits, fits + rows)
        yield batch.select(["tile", "a", "b"]).take(pa.array(np.sort(keep)))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets share enough."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) >= needed(len(x), len(y))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, kind, a, b, text) sorted by tile and kind: texts (kind 0) come before pairs (kind 1), which stay if
    their sorted sets share enough. An id with several texts is linked by any of them."""
    tile, sets = None, {}
    for batch in batches:
        for part in common.slices(batch, "text"):
            out_a, out_b = [], []
            hashes, sizes = _sets(part, 4)
            own = np.split(hashes, np.cumsum(sizes)[:-1])
            for k, (t, kind, a, b) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)))):
                if t != tile:
                    tile, sets = t, {}
                if not kind:
                    if len(own[k]):
                        sets.setdefault(a, []).append(own[k].copy())
                elif any(linked(x, y) for x in sets.get(a, ()) for y in sets.get(b, ())):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def bounded_pairs(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (tile, a, b) that the size and bit-count bounds leave."""
    small = profiles.select("doc_id", "n", "bits")
    side = lambda x: small.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("tile", "a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(common.released(_bounded), "tile long, a long, b long")


def verified_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (tile, a, b) that link, by exact intersection. Stored. A tile gets each of its texts once, and makes the
    sets there: texts take less room in a shuffle than their shingles' hashes."""
    need = pairs.select("tile", F.explode(F.array("a", "b")).alias("doc_id")).distinct().hint("merge").join(texts, "doc_id")
    rows = need.selectExpr("tile", "0 AS kind", "doc_id AS a", "CAST(NULL AS BIGINT) AS b", "text").unionAll(pairs.selectExpr("tile", "1 AS kind", "a", "b", "CAST(NULL AS STRING) AS text"))
    rows = rows.repartition("tile").sortWithinPartitions("tile", "kind")
    return common.stored(pairs.sparkSession, rows.mapInArrow(common.released(_verified), "a long, b long"), "links")


def bits_fit(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row pairs (i, j) that the bit-count bound leaves, and by how much; signatures of one size are taken together."""
    size = t["size"]
    spare = np.full(len(i), -1, np.int64)
    for a, b in {*zip(size[i].tolist(), size[j].tolist())} if len(i) else ():
        k = np.flatnonzero((size[i] == a) & (size[j] == b))
        x, y = (_stacked(t["bits"], r[k], own, min(a, b)) for r, own in ((i, a), (j, b)))
        na, nb = t["n"][i[k]], t["n"][j[k]]
        bound = np.minimum(na - np.bitwise_count(x & ~y).sum(1), nb - np.bitwise_count(y & ~x).sum(1))
        spare[k] = bound - needed(na, nb)
    keep = spare >= 0
    return i[keep], j[keep], spare[keep]


def _stacked(bits: np.ndarray, rows: np.ndarray, own: int, size: int) -> np.ndarray:
    out = np.frombuffer(b"".join(bits[rows]), np.uint8).reshape(len(rows), own)
    while out.shape[1] > size:
        half = out.shape[1] // 2
        out = out[:, :half] | out[:, half:]
    return out


def _tile_pairs(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles that the bounds leave: rows (key, band, ti, tj, tile, n, doc, comp, block, home, bits) sorted by tile and n.

    best: of each two components, only the pair with the most to spare.
    """

    def pairs(t: dict[str, np.ndarray]) -> pa.RecordBatch:
        rows = len(t["n"])
        same = np.ones(rows, bool)
        out_a, out_b, out_s = [], [], []
        live = np.arange(rows)
        step = 1
        group = np.cumsum(np.concatenate([[0], (np.diff(t["key"]) != 0) | (np.diff(t["band"]) != 0) | (np.diff(t["ti"]) != 0) | (np.diff(t["tj"]) != 0)])) if rows else same
        while len(live):
            live = live[live + step < rows]
            other = live + step
            fits = (group[live] == group[other]) & (t["n"][live] * DENOMINATOR >= t["n"][other] * NUMERATOR)
            live, other = live[fits], other[fits]
            ok = (t["comp"][live] != t["comp"][other]) & (t["home"][live] | t["home"][other]) & ((t["ti"][live] == t["tj"][live]) | (t["block"][live] != t["block"][other]))
            x, y, spare = bits_fit(t, live[ok], other[ok])
            out_a.append(x)
            out_b.append(y)
            out_s.append(spare)
            step += 1
        a, b, spare = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out_s))
        if best and len(a):
            c, d = t["comp"][a], t["comp"][b]
            order = np.lexsort((-spare, np.maximum(c, d), np.minimum(c, d)))
            pair = np.stack([np.minimum(c, d), np.maximum(c, d)])[:, order]
            new = np.ones(len(order), bool)
            new[1:] = (pair[:, 1:] != pair[:, :-1]).any(axis=0)
            a, b = a[order[new]], b[order[new]]
        where, a, b = t["tile"][a], t["doc"][a], t["doc"][b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((where, high, low))
        where, low, high = where[order], low[order], high[order]
        new = np.ones(len(order), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        return pa.RecordBatch.from_arrays([pa.array(x[new], pa.int64()) for x in (where, low, high)], names=["tile", "a", "b"])

    names = ["key", "band", "ti", "tj", "tile", "n", "doc", "comp", "block", "home", "bits"]
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        t = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
        t["size"] = common.lengths(batch.column(len(names) - 1))
        if held is not None:
            t = {n: np.concatenate([held[n], t[n]]) for n in t}
        tile = np.stack([t[n] for n in names[:4]])
        change = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) if tile.shape[1] else []
        cut = int(change[-1]) + 1 if len(change) else 0  # the last tile may go on in the next batch
        held = {n: x[cut:] for n, x in t.items()}
        if cut:
            yield pairs({n: x[:cut] for n, x in t.items()})
    if held is not None and len(held["n"]):
        yield pairs(held)


def tile_candidates(members: DataFrame, best: bool = False) -> DataFrame:
    """(tile, a, b) of rows (key, doc, n, comp, bits) that share a key, lie in the same or the next size band, in other components."""
    banded = members.withColumn("own", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(DENOMINATOR / NUMERATOR)))).cast("int"))
    rows = banded.withColumn("band", F.explode(F.array("own", F.col("own") + 1))).withColumn("home", F.col("own") == F.col("band"))
    sizes = rows.groupBy("key", "band").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("home").alias("any_home")).where("any_home and c0 <> c1").select("key", "band", F.ceil(F.greatest(F.col("rows") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int").alias("blocks"))
    rows = rows.join(sizes.hint("merge"), ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "band", F.least("block", "j").cast("int").alias("ti"), F.greatest("block", "j").cast("int").alias("tj"), "n", "doc", "comp", "block", "home", "bits")
    tile = ["key", "band", "ti", "tj"]
    rows = rows.withColumn("tile", F.xxhash64(*tile)).select(*tile, "tile", "n", "doc", "comp", "block", "home", "bits")
    found = rows.repartition(*tile).sortWithinPartitions(*tile, "n", "doc").mapInArrow(lambda batches: _tile_pairs(batches, best), "tile long, a long, b long")
    return found.groupBy("a", "b").agg(F.min("tile").alias("tile")).select("tile", "a", "b")


def jaccard_join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles (doc_id, n, rep), links between class representatives (a, b), and components (node, component).

    The links are those that were verified: they join every two linked texts in one component.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    number = docs.count()
    profiles = _profiles(docs, shingle_sketch(docs), int(level(np.array([number // common.HOT_SHARE]))[0]))
    classes = profiles.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    reps = common.stored(spark, classes.select(F.col("rep").alias("doc_id"), "key"), "classes")
    own = profiles.where("n > 0").join(reps.select("doc_id").hint("merge"), "doc_id", "left_semi")
    own = common.stored(spark, own.select("doc_id", "prefix", "busy"), "prefixes")
    by_key = Window.partitionBy("key")
    x1, x2 = F.xxhash64("doc_id"), F.xxhash64(F.lit(1), "doc_id")
    facts = lambda over: [over(f).alias(n) for f, n in ((F.min("doc_id"), "first"), (F.max("doc_id"), "last"), (F.bit_xor(x1), "x1"), (F.bit_xor(x2), "x2"), (F.count("*"), "size"))]
    calm = own.select("doc_id", F.explode("prefix").alias("key")).select("key", F.col("doc_id").alias("doc"), *facts(lambda f: f.over(by_key))).where("first <> last")
    busy = own.select(F.explode("busy").alias("key"), "doc_id")
    told = common.stored(spark, busy.groupBy("key").agg(*facts(lambda f: f)).where("first <> last"), "busy")
    busy = common.spread_join(busy.withColumnRenamed("doc_id", "doc"), told.withColumn("share", F.col("size")), ["key"], "share")
    met = common.stored(spark, calm.unionByName(busy).drop("last"), "met")
    common.drop(told)
    common.drop(own)
    # Shingles with the same members lead to the same pairs: one of them stays, with their number.
    alike = common.stored(spark, met.where("doc = first").groupBy("first", "x1", "x2").agg(F.min("key").alias("key"), F.count("*").alias("w"), F.first("size").alias("size")).select("key", "w", "size"), "distinct")
    every = met
    met = common.stored(spark, common.spread_join(every.select("key", "doc"), alike, ["key"], "size").select("key", "doc", "w"), "alike")
    common.drop(every)
    common.drop(alike)
    wanted = met.select(F.col("doc").alias("doc_id")).distinct()
    texts = common.stored(spark, docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "texts")
    scratch = [met, texts]
    links = spark.createDataFrame([], "a long, b long")
    members = first_members = met.withColumn("comp", F.col("doc"))
    tried = links
    for step in ("star",) * ROUNDS + ("best", "all"):
        if step == "star":
            first = members.groupBy("key").agg(F.min("doc").alias("first"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).where("c0 <> c1").select("key", "first", "size")
            first = common.stored(spark, first, "leaders")
            scratch.append(first)
            led = common.spread_join(members, first, ["key"], "size").where("doc <> first").groupBy("first", "doc").agg(F.sum("w").alias("w"))
            led = led.join(tried.select(F.col("a").alias("first"), F.col("b").alias("doc")).hint("merge"), ["first", "doc"], "left_anti")
            pairs = led.groupBy("doc").agg(F.min(F.struct((-F.col("w")).alias("m"), "first")).alias("best")).select(F.col("best.first").alias("a"), F.col("doc").alias("b"))
            pairs = common.stored(spark, pairs, "star")
            scratch.append(pairs)
            tried = tried.unionAll(pairs)
            blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("blocks"))
            pairs = bounded_pairs(pairs.join(blocks.hint("merge"), "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks"))).alias("tile"), "a", "b"), profiles)
        else:
            mixed = members.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).where("c0 <> c1").select("key", "size")
            mixed = common.stored(spark, mixed, "mixed")
            scratch.append(mixed)
            rest = common.spread_join(members, mixed, ["key"], "size").join(profiles.select(F.col("doc_id").alias("doc"), "n", "bits").hint("merge"), "doc")
            pairs = tile_candidates(rest.select("key", "doc", "n", "comp", "bits"), step == "best").join(tried.hint("merge"), ["a", "b"], "left_anti").select("tile", "a", "b")
        pairs = common.stored(spark, pairs, "candidates")
        scratch.append(pairs)
        if step != "star":
            tried = tried.unionAll(pairs.select("a", "b"))
        links = links.unionAll(verified_links(pairs, texts))
        labels = connected_components(links)
        if step != "all":
            before = members
            members = common.stored(spark, met.join(labels.hint("merge"), F.col("doc") == F.col("node"), "left").select("key", "doc", "w", F.coalesce("component", "doc").alias("comp")), "members")
            if before is not first_members:
                common.drop(before)
    for t in (members, *scratch):  # what is returned reads profiles, classes, links and components
        common.drop(t)
    return profiles.join(reps.select("key", F.col("doc_id").alias("rep")).hint("merge"), "key", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), links, labels


def component_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest doc_id with the same set)."""
    profiles, _, labels = jaccard_join(docs)
    out = profiles.join(labels.hint("merge"), F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("class_id"))
