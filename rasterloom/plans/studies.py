"""Studies over rasters: context designs, predictors, headroom, codec ladder, comparison, sweeps, verification."""

from __future__ import annotations

import itertools
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import samples as S
from rasterloom.operators import abreast, codec, coders, entropy, motion, stencils, tiles, wavefront
from rasterloom.sources import rasters, shared
from rasterloom.sources.rasters import KEY

#: Extensions by kind (fixed values).
KINDS = {"image": ("png", "ppm", "pgm"), "clip": ("y4m", "mp4", "mkv")}

# ---------------------------------------------------------------- context designs

_BUCKETS = {n: S.bucket("activity", e) for n, e in S.ACTIVITY_LADDERS.items()}
#: Name to (contexts, expression) over the columns of stencils.med_bundle.
DESIGNS: dict[str, tuple[int, str]] = {
    "one": (1, "0"),
    **{f"act{n}": (n, _BUCKETS[n]) for n in (4, 8, 12, 16, 24, 32)},
    **{f"act{n}_signs": (9 * n, f"{_BUCKETS[n]} * 9 + {S.sign_pattern()}") for n in (8, 12)},
    "gradients": (365, S.gradient_triple()),
}
PREDICTORS = ("average", "planar", "med", "gap", "med_gap")


def _domain(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(sizes.items()), "design string, nctx int")


def context_designs(samples: DataFrame) -> DataFrame:
    """Cost of the MED residuals under every design: one pass over the samples, stacked by design."""
    stack = ", ".join(f"'{d}', CAST({e} AS INT)" for d, (_, e) in DESIGNS.items())
    tall = stencils.med_bundle(samples).selectExpr(*KEY, "sym", f"stack({len(DESIGNS)}, {stack}) AS (design, ctx)")
    return entropy.context_cost(tall, KEY, _domain(samples.sparkSession, {d: n for d, (n, _) in DESIGNS.items()}))


def best_design(costs: DataFrame) -> DataFrame:
    """The cheapest design of each plane; among equals the first by name."""
    best = costs.groupBy(*KEY).agg(F.min(F.struct("total_bytes", "design")).alias("b"))
    return best.select(*KEY, F.col("b.design").alias("design"), F.col("b.total_bytes").alias("total_bytes"))


CROSS = 6 * 12


def with_luma(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, media_id, frame_no, plane_no, y, x, activity, sym) with ctx: twelve activities, for chroma times six
    sizes of the luma symbol at the same place."""
    at = [*dict.fromkeys([*keys, "media_id", "frame_no"]), "y", "x"]
    luma = rows.where("plane_no = 0").select(*at, F.col("sym").alias("luma"))
    ctx = S.bucket("activity", S.ACTIVITY_LADDERS[12])
    return rows.join(luma, at).withColumn("ctx", F.expr(f"CASE WHEN plane_no = 0 THEN {ctx} ELSE {ctx} * 6 + {S.bucket('luma', S.LUMA)} END"))


def predictor_costs(samples: DataFrame) -> DataFrame:
    """Costs of each predictor's residuals under twelve activities by plane, and of MED's and GAP's beside luma (cross)."""
    rows = stencils.predictors(samples).withColumnRenamed("predictor", "design")
    plain = rows.withColumn("ctx", F.expr(S.bucket("activity", S.ACTIVITY_LADDERS[12]))).select(*KEY, "design", "ctx", "sym")
    cross = with_luma(rows.where("design IN ('med', 'gap')"), ["design"]).select(*KEY, F.concat("design", F.lit("_cross")).alias("design"), "ctx", "sym")
    spark = samples.sparkSession
    sized = entropy.context_cost(plain, KEY, _domain(spark, {p: 12 for p in PREDICTORS}))
    both = cross.select(*KEY, F.concat("design", F.when(F.col("plane_no") == 0, "/luma").otherwise("/chroma")).alias("design"), "ctx", "sym")
    crossed = entropy.context_cost(both, KEY, _domain(spark, {f"{p}_cross/{k}": n for p in ("med", "gap") for k, n in (("luma", 12), ("chroma", CROSS))}))
    return sized.unionAll(crossed.withColumn("design", F.substring_index("design", "/", 1)))


# ---------------------------------------------------------------- headroom

TAPS = ("w", "n", "nw", "ne", "ww", "nn")


def least_squares(samples: DataFrame) -> DataFrame:
    """media_id, frame_no, plane_no, weights: the linear predictor with the least squared error over inner samples,
    rounded to 1/64. Sums of products are aggregated; a 6 x 6 system is solved per plane."""
    near = stencils.repeated_neighbours(samples).where("y >= 2 AND x >= 2")
    pairs = [(a, b) for i, a in enumerate(TAPS) for b in TAPS[i:]]
    sums = near.groupBy(*KEY).agg(*[F.sum(F.col(a).cast("long") * F.col(b)).alias(f"{a}_{b}") for a, b in pairs], *[F.sum(F.col(a).cast("long") * F.col("v")).alias(f"{a}_v") for a in TAPS])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            weights = []
            for r in rows:
                m = np.zeros((6, 6))
                for i, a in enumerate(TAPS):
                    for j, b in enumerate(TAPS):
                        m[i, j] = r[f"{a}_{b}" if i <= j else f"{b}_{a}"]
                w, *_ = np.linalg.lstsq(m, np.array([r[f"{a}_v"] for a in TAPS], float), rcond=None)
                weights.append((np.rint(w * 64) / 64).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(weights, pa.list_(pa.float64()))], names=[*KEY, "weights"])

    return sums.mapInArrow(solve, samples.select(*KEY).schema.add("weights", T.ArrayType(T.DoubleType())))


def headroom(samples: DataFrame) -> DataFrame:
    """Conditional entropy of four predictors' residuals over all samples; edges repeat. A plane without inner samples has
    no linear predictor."""
    near = stencils.repeated_neighbours(samples).withColumn("activity", F.expr(S.spread())).join(least_squares(samples), KEY, "left")  # a row of weights a plane
    linear = " + ".join(f"weights[{k}] * {t}" for k, t in enumerate(TAPS))
    med = S.med("n", "w", "nw")
    clip = "greatest(0, least(255, CAST(bround({}) AS INT)))"
    known = "CASE WHEN weights IS NOT NULL THEN {} END".format
    stack = ", ".join(f"'{n}', {e}" for n, e in {"med": med, "gap": clip.format(S.gap_float()), "linear": known(clip.format(linear)), "med_linear": known(clip.format(f"({med} + {linear}) / 2"))}.items())
    rows = near.selectExpr(*KEY, "y", "x", "v", "activity", f"stack(4, {stack}) AS (predictor, pred)").where("pred IS NOT NULL")
    rows = rows.withColumns({"sym": F.expr(S.zigzag("v - pred")), "size": F.expr(f"abs({S.centre('v - pred')})")})
    return entropy.conditional_entropy(with_error(rows, ["predictor"], repeat=True), [*KEY, "predictor"])


def headroom_gap(rgb: DataFrame) -> DataFrame:
    """(name, n_bytes, vs_med): each predictor's ideal bytes over all planes after the colour transform, beside what the
    adaptive codec emits for the images (`measured`), in percent over MED's ideal."""
    ideal = headroom(stencils.colour_planes(rgb)).groupBy(F.col("predictor").alias("name")).agg(F.sum("entropy_bytes").alias("n_bytes"))
    coded = codec.encode_media(rasters.pack(rgb)).agg(F.sum("n_bytes").cast("double").alias("n_bytes")).select(F.lit("measured").alias("name"), "n_bytes")
    rows = ideal.unionAll(coded)
    med = F.max(F.when(F.col("name") == "med", F.col("n_bytes"))).over(Window.partitionBy())  # five rows
    return rows.select("name", F.round("n_bytes", 4).alias("n_bytes"), F.round(100 * (F.col("n_bytes") - med) / med, 4).alias("vs_med"))


def with_error(rows: DataFrame, keys: list[str], repeat: bool = False) -> DataFrame:
    """Rows with activity and size (of the residual), and ctx: the adaptive codec's activity times the sizes of the
    residuals to the left and above. Outside the plane: 0, or (repeat) the residual itself."""
    tile = tiles.tiled(rows, up=1, left=1, keys=keys)
    left, up = tiles.along_rows(keys), tiles.along_columns(keys)
    outside = F.col("size") if repeat else F.lit(0)
    err = F.coalesce(F.lag("size").over(left), outside) + F.coalesce(F.lag("size").over(up), outside)
    ctx = f"{S.bucket('activity', S.CODEC_ACTIVITY)} * {len(S.CODEC_ERROR) + 1} + {S.bucket('err', S.CODEC_ERROR)}"
    return tiles.own(tile.withColumn("err", err)).withColumn("ctx", F.expr(ctx))


# ---------------------------------------------------------------- static coders


def _each_histogram(hist: DataFrame, key: str, make, value: str) -> DataFrame:
    """key, sym and a value of all that make (256 counts to 256 numbers) doesn't leave at 0; hist: key, sym, n."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kind = value.split()
        for batch in batches:
            ends, cells = batch.column(1).offsets.to_numpy(), batch.column(1).values
            sym, n = (cells.field(k).to_numpy() for k in range(2))
            used, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                counts = np.zeros(256, np.int64)
                counts[sym[a:b]] = n[a:b]
                made = make(counts)
                used.append(np.flatnonzero(made))
                values.append(made[used[-1]])
            owner = np.repeat(np.arange(batch.num_rows), [len(u) for u in used[1:]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.concatenate(used), pa.int32()), pa.array(np.concatenate(values)).cast({"int": pa.int32(), "long": pa.int64()}[kind])], names=[key, "sym", name])

    cells = F.collect_list(F.struct(F.col("sym").cast("int"), F.col("n").cast("long"))).alias("cells")  # 256 at most
    return hist.groupBy(key).agg(cells).mapInArrow(apply, f"{key} string, sym int, {value}")


def normalised(hist: DataFrame, key: str) -> DataFrame:
    """key, sym, freq: histograms (256 rows a key at most) scaled to 4096."""
    return _each_histogram(hist, key, coders.normalise, "freq long")


def huffman_lengths(hist: DataFrame, key: str) -> DataFrame:
    """key, sym, len."""
    return _each_histogram(hist, key, coders.code_lengths, "len int")


def _each_text(texts: DataFrame, make, schema: str) -> DataFrame:
    """Applies make to (media_id, data) rows one text at a time; it returns the other columns' values."""
    names = [c.split()[0] for c in schema.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            rows = [(k, *make(np.frombuffer(d, np.uint8).astype(np.int64))) for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "))], names=names)

    return texts.select("media_id", "data").mapInArrow(apply, schema)


def _tables(data: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    hists = [np.bincount(s, minlength=256) for s in data]
    return hists, [coders.normalise(h) for h in hists]


def _texts_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(d.as_buffer(), np.uint8) for d in batch.column(1)]


def coder_sizes(texts: DataFrame) -> DataFrame:
    """Per media_id: symbols, Huffman and rANS bytes (tables included), and the rANS estimate. A batch's texts are coded side by side."""
    names = ["media_id", "symbols", "huffman_bytes", "rans_bytes", "rans_estimate"]

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _texts_of(batch)
            hists, freqs = _tables(data)
            rans = [len(coders.write_table(f)) + len(b) if f is not None else 0 for f, b in zip(freqs, abreast.rans_encode(data, freqs))]
            bits = [coders.estimate_bits(h, f) / 8 if f is not None else 0.0 for h, f in zip(hists, freqs)]
            columns = [pa.array(c, pa.int64()) for c in ([len(s) for s in data], [len(coders.huffman_encode(s)) for s in data], rans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(bits, pa.float64())], names=names)

    return texts.select("media_id", "data").mapInArrow(sized, "media_id string, symbols long, huffman_bytes long, rans_bytes long, rans_estimate double")


def coder_estimates(texts: DataFrame) -> DataFrame:
    """Per media_id: symbols and the rANS estimate, which a text's histogram gives without coding it."""

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _texts_of(batch)
            bits = [coders.estimate_bits(h, f) / 8 if f is not None else 0.0 for h, f in zip(*_tables(data))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in data], pa.int64()), pa.array(bits, pa.float64())], names=["media_id", "symbols", "rans_estimate"])

    return texts.select("media_id", "data").mapInArrow(estimated, "media_id string, symbols long, rans_estimate double")


def roundtrip(texts: DataFrame, coder: str) -> DataFrame:
    """media_id, data as decoded from each text's coded bytes, and how many those are. coder: huffman, rans or bits."""

    def make(s: np.ndarray) -> tuple:
        if not len(s):
            return b"", 0
        blob = coders.huffman_encode(s)
        return coders.huffman_decode(blob, len(s)).astype(np.uint8).tobytes(), len(blob)

    def rans(data: list[np.ndarray], counts: list[int]) -> tuple[list[int], list[np.ndarray]]:
        freqs = _tables(data)[1]
        tables, bodies = [coders.write_table(f) if f is not None else b"" for f in freqs], abreast.rans_encode(data, freqs)
        read = [coders.read_table(coders.Reader(t)) if t else None for t in tables]
        return [len(t) + len(b) for t, b in zip(tables, bodies)], abreast.rans_decode(bodies, counts, read)

    def bits(data: list[np.ndarray], counts: list[int]) -> tuple[list[int], list[np.ndarray]]:
        blobs = abreast.range_encode(data)
        return [len(b) for b in blobs], abreast.range_decode(blobs, counts)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _texts_of(batch)
            sizes, back = (rans if coder == "rans" else bits)(data, [len(t) for t in data])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.tobytes() for t in back], pa.binary()), pa.array(sizes, pa.int64())], names=["media_id", "data", "n_bytes"])

    schema = "media_id string, data binary, n_bytes long"
    return _each_text(texts, make, schema) if coder == "huffman" else texts.select("media_id", "data").mapInArrow(together, schema)


def huffman_decoded(packed: DataFrame) -> DataFrame:
    """(media_id, data, symbols, n_bytes) of coded (media_id, data, symbols)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            back = [coders.huffman_decode(d, n).astype(np.uint8).tobytes() for d, n in zip(coded, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary()), batch.column(2), pa.array([len(d) for d in coded], pa.int64())], names=["media_id", "data", "symbols", "n_bytes"])

    return packed.select("media_id", "data", "symbols").mapInArrow(read, "media_id string, data binary, symbols long, n_bytes long")


# ---------------------------------------------------------------- codecs side by side


def _image(rows: pa.Table) -> list[np.ndarray]:
    return [p for _, _, p in codec._ordered(rows)]


def _deflate(planes: list[np.ndarray]) -> tuple[bytes, list[np.ndarray]]:
    blob = zlib.compress(b"".join(p.tobytes() for p in planes), 9)
    return blob, _split(zlib.decompress(blob), planes)


def _split(raw: bytes, planes: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([p.size for p in planes])
    return [np.frombuffer(raw[e - p.size : e], np.uint8).reshape(p.shape) for e, p in zip(ends.tolist(), planes)]


def _huffman(planes: list[np.ndarray]) -> tuple[bytes, list[np.ndarray]]:
    s = np.concatenate([p.ravel() for p in planes]).astype(np.int64)
    blob = coders.huffman_encode(s)
    return blob, _split(coders.huffman_decode(blob, len(s)).astype(np.uint8).tobytes(), planes)


def _rans(planes: list[np.ndarray]) -> tuple[bytes, list[np.ndarray]]:
    s = np.concatenate([p.ravel() for p in planes]).astype(np.int64)
    freq = coders.normalise(np.bincount(s, minlength=256))
    table, body = coders.write_table(freq), coders.rans_encode(s, freq)
    return table + body, _split(coders.rans_decode(body, len(s), freq).astype(np.uint8).tobytes(), planes)


def _png(planes: list[np.ndarray]) -> tuple[bytes, list[np.ndarray]]:
    from rasterloom.sources import images

    if len(planes) == 2:
        raise ValueError("no such image")
    blob = images.write_png(np.stack(planes, axis=2) if len(planes) > 1 else planes[0])
    back = images.read_png(blob)
    return blob, [back[:, :, k] for k in range(back.shape[2])]


def _own(planes: list[np.ndarray]) -> tuple[bytes, list[np.ndarray]]:
    blob = codec.encode_image(planes)
    return blob, codec.decode_image(blob)


#: A codec is a function from planes to its bytes and what it decodes from them.
CODECS = {"raw": lambda p: (b"".join(x.tobytes() for x in p), p), "deflate": _deflate, "huffman": _huffman, "rans": _rans, "png": _png, "own": _own}

#: Samples (of all planes) of a strip that the codecs other than the adaptive one take at once; smaller images go whole.
STRIP_SAMPLES = 1 << 20

COMPARISON = "media_id string, codec string, raw_bytes long, n_bytes long, pixels long, cpu_s double, lossless boolean, max_err int, status string, library string"


def comparison(planes: DataFrame) -> DataFrame:
    """Every codec on every image (one row each), decoded and compared; CPU seconds cover both ways.

    The adaptive codec takes an image band by band, bands of one size side by side, as its streams do. The others take an
    image whole up to STRIP_SAMPLES; of a larger one each strip is a stream of its own, with its tables and headers.
    """
    spark = planes.sparkSession
    names = spark.createDataFrame([(n,) for n in CODECS if n != "own"], "codec string")
    columns = ["media_id", "codec", "part", "frame_no", "plane_no", "width", "height", "data"]
    strips = codec.cut_media(planes, STRIP_SAMPLES).crossJoin(F.broadcast(names)).select(*columns)  # a row for each codec

    def row(media: str, name: str, image: list, size: int | None, spent: float, worst: int | None, status: str) -> tuple:
        library = f"zlib {zlib.ZLIB_RUNTIME_VERSION}" if name in ("deflate", "png") else f"numpy {np.__version__}"
        return media, name, sum(p.size for p in image), size, image[0].size, spent, worst == 0, worst, status, library

    names_, kinds = [x.split()[0] for x in COMPARISON.split(", ")], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32(), pa.string(), pa.string()]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            media, images = rows.column(0).to_pylist(), [sum(codec.part_frames(p), []) for p in rows.column(2).to_pylist()]
            for places in codec.side_by_side([tuple(p.shape for p in i) for i in images]):
                began, status, blobs, worst = time.process_time(), "ok", [None] * len(places), [None] * len(places)
                try:
                    blobs = [b for b, _ in codec.encode_images([images[k] for k in places])]
                    worst = [max(int(abs(a.astype(int) - b).max()) for a, b in zip(images[k], back)) for k, back in zip(places, codec.decode_images(blobs))]
                except ValueError as e:
                    status = str(e)
                spent = (time.process_time() - began) / len(places)  # a part's share
                found = [row(media[k], "own", images[k], len(b) if w is not None else None, spent, w, status) for k, b, w in zip(places, blobs, worst)]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found), kinds)], names=names_)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        name = key[1].as_py()
        image = _image(rows)
        status, blob, worst = "ok", b"", None
        began = time.process_time()
        try:
            blob, back = CODECS[name](image)
            worst = max(int(abs(a.astype(int) - b).max()) for a, b in zip(image, back))
        except ValueError as e:
            status = str(e)
        spent = time.process_time() - began
        values = row(key[0].as_py(), name, image, len(blob) if worst is not None else None, spent, worst, status)
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=names_)

    key = ["media_id", "codec", "part"]
    every = strips.repartition(4 * spark.sparkContext.defaultParallelism, *key).groupBy(*key).applyInArrow(run, COMPARISON)
    every = every.unionAll(codec.gathered(codec.cut_media(planes), ["media_id", "part"]).mapInArrow(own, COMPARISON))
    sums = {c: F.sum(c).alias(c) for c in ("raw_bytes", "pixels", "cpu_s")}
    size = F.when(F.count("*") == F.count("n_bytes"), F.sum("n_bytes")).alias("n_bytes")
    status = F.coalesce(F.max(F.when(F.col("status") != "ok", F.col("status"))), F.lit("ok")).alias("status")
    found = every.groupBy("media_id", "codec").agg(*sums.values(), size, F.bool_and("lossless").alias("lossless"), F.max("max_err").alias("max_err"), status, F.first("library").alias("library"))
    return found.select(*(c.split()[0] for c in COMPARISON.split(", ")))


def rollup(results: DataFrame) -> DataFrame:
    """Totals per codec over lossless results, smallest first."""
    sums = results.where("lossless").groupBy("codec").agg(F.count("*").alias("images"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("n_bytes").alias("n_bytes"), F.sum("pixels").alias("pixels"), F.bool_and("lossless").alias("lossless"), F.sum("cpu_s").alias("cpu_s"))
    return sums.withColumns({"ratio": F.round(F.col("raw_bytes") / F.col("n_bytes"), 4), "bits_per_pixel": F.round(8 * F.col("n_bytes") / F.col("pixels"), 4)}).orderBy("n_bytes", "codec")


def verified(first: DataFrame, second: DataFrame) -> DataFrame:
    """media_id, lossless, max_error of two sample sets: a full outer join on coordinates, so missing samples count."""
    a = first.select(*KEY, "y", "x", F.col("v").alias("a"))
    b = second.select(*KEY, "y", "x", F.col("v").alias("b"))
    both = a.join(b, [*KEY, "y", "x"], "full_outer")
    return both.groupBy("media_id").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("lossless"), F.max(F.abs(F.coalesce("a", F.lit(999)) - F.coalesce("b", F.lit(-999)))).cast("int").alias("max_error"))


def ladder(rgb: DataFrame) -> DataFrame:
    """rung, name, n_bytes, saved: raw, Huffman, per plane, over MED, with colour, under contexts, the adaptive codec."""
    def sized(rows: DataFrame, keys: list[str], sym: str) -> DataFrame:
        hist = entropy.histogram(rows.withColumn("k", F.concat_ws("/", *keys) if keys else F.lit("all")), ["k"], sym)
        bits = entropy.coded_bits(hist, huffman_lengths(hist, "k"), ["k"])
        return bits.agg(F.sum(F.ceil(F.col("bits") / 8) + 128).cast("long").alias("n_bytes"))

    changed = stencils.colour_planes(rgb)
    rows = stencils.med_bundle(changed)
    stack = ", ".join(f"'act{n}', {_BUCKETS[n]}" for n in S.CODER_LADDERS)
    tall = rows.selectExpr(*KEY, "sym", f"stack({len(S.CODER_LADDERS)}, {stack}) AS (design, ctx)")
    costs = entropy.context_cost(tall, KEY, _domain(rgb.sparkSession, {f"act{n}": n for n in S.CODER_LADDERS}))
    contexts = costs.groupBy(*KEY).agg(F.min("total_bytes").alias("t")).agg(F.ceil(F.sum("t")).cast("long").alias("n_bytes"))
    from rasterloom.sources.rasters import pack

    rungs = [
        ("raw", rgb.agg(F.count("*").alias("n_bytes"))),
        ("huffman", sized(rgb, [], "v")),
        ("huffman by plane", sized(rgb, KEY, "v")),
        ("med", sized(stencils.med_residuals(rgb), KEY, "sym")),
        ("colour and med", sized(stencils.med_residuals(changed), KEY, "sym")),
        ("contexts", contexts),
        ("adaptive", codec.encode_media(pack(rgb)).agg(F.sum("n_bytes").alias("n_bytes"))),
    ]
    out = None
    for k, (name, size) in enumerate(rungs):
        row = size.select(F.lit(k).alias("rung"), F.lit(name).alias("name"), F.col("n_bytes").cast("long").alias("n_bytes"))
        out = row if out is None else out.unionAll(row)
    return out.withColumn("saved", F.round(1 - F.col("n_bytes") / F.lag("n_bytes").over(Window.orderBy("rung")), 4))  # seven rows


# ---------------------------------------------------------------- motion and sweeps

SEARCHED = "media_id string, frame_no int, brow int, bcol int, mode int, dy int, dx int, temporal long, spatial long"


def padded(planes: DataFrame) -> DataFrame:
    """Frames of one size: rows of 0 below those that are short."""
    full = planes.groupBy("media_id", "plane_no").agg(F.max("height").alias("full"))
    return planes.join(full, ["media_id", "plane_no"]).select("media_id", "frame_no", "plane_no", "width", F.col("full").alias("height"), F.expr("rpad(data, width * full, X'00')").alias("data"))


def _frame_pairs(planes: DataFrame) -> DataFrame:
    """Each first plane with the one of the frame before."""
    luma = padded(planes).where("plane_no = 0").select("media_id", "frame_no", "width", "height", "data")
    before = luma.select("media_id", (F.col("frame_no") + 1).alias("frame_no"), F.col("data").alias("ref"))
    return luma.join(before, ["media_id", "frame_no"])


def searched(planes: DataFrame, block: int = motion.BLOCK, penalty: int = motion.MOVE_PENALTY) -> DataFrame:
    """Mode, vector and costs of each block of every frame but the first."""
    pairs = _frame_pairs(planes).select("*", F.lit(block).alias("block"), F.lit(penalty).alias("penalty"))
    return _searched(pairs).drop("block", "penalty")


def _searched(pairs: DataFrame) -> DataFrame:
    """The search over frame pairs with their settings (block, penalty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cur, ref = (np.frombuffer(row[c], np.uint8).reshape(row["height"], row["width"]) for c in ("data", "ref"))
                found = motion.modes(cur, ref, row["block"], row["penalty"])
                by, bx = np.indices(found[0].shape, np.int32)
                n = by.size
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                settings = [pa.array(np.full(n, row[c], np.int32)) for c in ("block", "penalty")]
                yield pa.RecordBatch.from_arrays([pa.array([row["media_id"]] * n), pa.array(np.full(n, row["frame_no"], np.int32)), pa.array(by.ravel()), pa.array(bx.ravel()), *(pa.array(x.ravel(), k) for x, k in zip(found, kinds)), *settings], names=[x.split()[0] for x in f"{SEARCHED}, block int, penalty int".split(", ")])

    return pairs.mapInArrow(run, f"{SEARCHED}, block int, penalty int")


def kept(frame: DataFrame, what: str) -> DataFrame:
    """frame written once to the shared folder and read back."""
    spark = frame.sparkSession
    frame.write.parquet(path := shared.scratch(spark, what))
    return spark.read.schema(frame.schema).parquet(path)


def grid(spark: SparkSession) -> DataFrame:
    blocks = spark.createDataFrame([(8,), (16,), (32,)], "block int")
    return blocks.crossJoin(spark.createDataFrame([(0,), (48,), (96,)], "penalty int"))  # nine rows


def motion_sweep(planes: DataFrame, best: int = 5) -> DataFrame:
    """Motion cost of every setting of the search, the best few: one stored table of frame pairs, a task for pairs and
    settings side by side."""
    spark = planes.sparkSession
    pairs = kept(_frame_pairs(planes), "pairs").crossJoin(F.broadcast(grid(spark)))  # nine rows
    cost = F.sum(F.when(F.col("mode") == 1, F.col("temporal")).otherwise(F.col("spatial")))
    tasks = 4 * spark.sparkContext.defaultParallelism
    every = _searched(pairs.repartition(tasks, "media_id", "frame_no", "block", "penalty"))
    return every.groupBy("block", "penalty").agg(cost.alias("cost"), F.count("*").alias("blocks")).orderBy("cost", "block", "penalty").limit(best)


def settings_of(memory: int, activity: int, errors: str) -> wavefront.Settings:
    """Settings by the names that sweeps use."""
    return wavefront.Settings(S.ACTIVITY_LADDERS[activity], ERROR_LADDERS[errors], memory)


QUICK = "side string, media_id string, part int, bits double"


def quick(planes: DataFrame, a: tuple[int, int, str], b: tuple[int, int, str]) -> DataFrame:
    """(media_id, a_bytes, b_bytes, change): what images take under two settings, by the cost of their decisions alone.

    change is b over a in percent, negative where b is smaller. Bands of one size go side by side, and nothing is coded.
    """
    spark = planes.sparkSession
    sides = spark.createDataFrame([("a", *a), ("b", *b)], "side string, memory int, activity int, errors string")
    bands = codec.cut_media(planes).where("NOT clip").drop("clip").crossJoin(F.broadcast(sides))  # two rows

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            side, media, part, *settings = (rows.column(k).to_pylist() for k in range(6))
            named, images = list(zip(*settings)), [codec.part_frames(p)[0] for p in rows.column(6).to_pylist()]
            for places in codec.side_by_side([(n, *(p.shape for p in i)) for n, i in zip(named, images)]):
                bits = codec.images_bits([images[k] for k in places], settings_of(*named[places[0]]))
                yield pa.RecordBatch.from_arrays([pa.array([side[k] for k in places]), pa.array([media[k] for k in places]), pa.array([part[k] for k in places], pa.int32()), pa.array(bits)], names=["side", "media_id", "part", "bits"])

    found = codec.gathered(bands, ["side", "media_id", "part", "memory", "activity", "errors"]).mapInArrow(cost, QUICK)
    both = found.groupBy("media_id").pivot("side", ["a", "b"]).agg(F.sum("bits") / 8)
    return both.select("media_id", F.round("a", 1).alias("a_bytes"), F.round("b", 1).alias("b_bytes"), F.round(100 * (F.col("b") - F.col("a")) / F.col("a"), 4).alias("change"))


# ---------------------------------------------------------------- clip codecs side by side


Clip = list[list[np.ndarray]]


def _per_frame(groups: list[Clip]) -> list[tuple[int, Clip]]:
    images = [f for frames in groups for f in frames]
    blobs = [b""] * len(images)
    for places in codec.side_by_side([tuple(p.shape for p in i) for i in images]):
        for k, (blob, _) in zip(places, codec.encode_images([images[k] for k in places])):
            blobs[k] = blob
    back, sizes = iter(codec.decode_images(blobs)), iter(map(len, blobs))
    return [(sum(itertools.islice(sizes, len(frames))), list(itertools.islice(back, len(frames)))) for frames in groups]


def _differences(groups: list[Clip]) -> list[tuple[int, Clip]]:
    """The first frame, then each sample's difference from the frame before, modulo 256."""
    changes = [[[p - q for p, q in zip(f, before)] for before, f in zip([[np.uint8(0)] * 4, *frames], frames)] for frames in groups]
    found = []
    for size, back in _per_frame(changes):
        out: Clip = []
        for change in back:
            out.append([p + q for p, q in zip(change, out[-1])] if out else change)
        found.append((size, out))
    return found


def _by_motion(groups: list[Clip]) -> list[tuple[int, Clip]]:
    blobs = codec.encode_clips(groups)
    return list(zip(map(len, blobs), codec.decode_clips(blobs)))


def _abreast(many: Callable[[list[Clip]], list[tuple[int, Clip]]]) -> Callable[[Clip], tuple[int, Clip]]:
    """A codec of one group from one (its attribute many) that takes groups of one shape side by side."""

    def one(frames: Clip) -> tuple[int, Clip]:
        return many([frames])[0]

    one.many = many
    return one


def _deflated(frames: list[list[np.ndarray]]) -> tuple[int, list[list[np.ndarray]]]:
    found = [_deflate(f) for f in frames]
    return sum(len(b) for b, _ in found), [f for _, f in found]


#: A clip codec is a function from a group's frames to its bytes and the frames decoded from them. Frames' planes have one
#: size each; codecs of images take planes of one size only.
CLIP_CODECS = {"deflate": _deflated, "frames": _abreast(_per_frame), "difference": _abreast(_differences), "motion": _abreast(_by_motion)}
CODED = "codec string, media_id string, frame_no int, plane_no int, data binary, n_bytes long, cpu_s double, status string"


def clip_comparison(planes: DataFrame, group_frames: int = codec.GROUP_FRAMES) -> DataFrame:
    """A row for each clip and codec: raw and coded bytes, frames, processor seconds, whether it is lossless, and status.

    Clips are cut into groups of frames; every codec takes every group, those of one shape in a task side by side, and
    decodes it again; processor seconds are shared evenly by groups coded together. Lossless
    means that a full outer join of the planes that went in with those that came out leaves none alone and none unlike.
    A codec that doesn't take a clip's planes has a status, no size, and isn't lossless. Raw bytes don't count the rows of 0
    that a short frame is coded with.
    """
    spark = planes.sparkSession
    codecs = spark.createDataFrame([(k,) for k in CLIP_CODECS], "codec string")
    own = planes.select("media_id", "frame_no", "plane_no", F.octet_length("data").cast("long").alias("own"))
    planes = padded(planes)
    first = planes.groupBy("media_id").agg(F.min("frame_no").alias("_f"))
    groups = planes.join(first, "media_id").withColumn("part", F.expr(f"CAST((frame_no - _f) div {group_frames} AS INT)")).drop("_f")

    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names, media, planes_ = (rows.column(k).to_pylist() for k in (0, 1, 3))
            clips = [codec.part_frames(p) for p in planes_]
            for places in codec.side_by_side([(n, len(c), *(p.shape for f in c for p in f)) for n, c in zip(names, clips)]):
                coder = CLIP_CODECS[names[places[0]]]
                began = time.process_time()
                try:
                    found = [(*x, "ok") for x in coder.many([clips[k] for k in places])] if hasattr(coder, "many") else []
                except ValueError:
                    found = []
                for k in places[len(found) :]:  # one by one, each with a status of its own
                    try:
                        found.append((*coder(clips[k]), "ok"))
                    except ValueError as e:
                        found.append((None, [], str(e)))
                took = (time.process_time() - began) / len(places)
                out = []
                for k, (size, back, status) in zip(places, found):
                    order = list(dict.fromkeys(p["frame_no"] for p in planes_[k]))
                    out += [(names[k], media[k], f, p, plane.tobytes(), None, None, status) for f, own in zip(order, back) for p, plane in enumerate(own)]
                    out.append((names[k], media[k], None, None, None, size, took, status))  # the group's own row
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*out), CODED.split(", "))], names=[x.split()[0] for x in CODED.split(", ")])

    dealt = groups.select("media_id", "part", "frame_no", "plane_no", "width", "height", "data").crossJoin(F.broadcast(codecs))  # four rows
    coded = kept(codec.gathered(dealt, ["codec", "media_id", "part"]).mapInArrow(run, CODED), "coded")
    sizes = coded.where("frame_no IS NULL").groupBy("codec", "media_id").agg(F.when(F.count("*") == F.count("n_bytes"), F.sum("n_bytes")).alias("n_bytes"), F.round(F.sum("cpu_s"), 3).alias("cpu_s"), F.max("status").alias("status"))
    there = planes.join(own, ["media_id", "frame_no", "plane_no"]).select("media_id", "frame_no", "plane_no", F.col("data").alias("was"), "own").crossJoin(F.broadcast(codecs))
    back = coded.where("frame_no IS NOT NULL").select("codec", "media_id", "frame_no", "plane_no", "data")
    met = there.join(back, ["codec", "media_id", "frame_no", "plane_no"], "full_outer")
    same = F.min(F.coalesce(F.col("was") == F.col("data"), F.lit(False))).alias("lossless")
    equal = met.groupBy("codec", "media_id").agg(same, F.countDistinct("frame_no").alias("frames"), F.sum("own").alias("raw_bytes"))
    return equal.join(sizes, ["codec", "media_id"]).select("media_id", "codec", "frames", "raw_bytes", "n_bytes", "cpu_s", "lossless", "status")


#: Ladders of the neighbours' errors that a sweep tries, by name.
ERROR_LADDERS = {"e3": (1, 4, 12), "e6": wavefront.ERROR_EDGES}
SWEPT = "memory int, activity int, errors string, media_id string, part int, n_bytes long"


def settings_grid(spark: SparkSession) -> DataFrame:
    """Eighteen settings of the adaptive model: how long counts remember, the ladders of activity and of errors."""
    memory, activity = (spark.createDataFrame([(k,) for k in v], f"{n} int") for n, v in (("memory", (8, 10, 12)), ("activity", (12, 16, 24))))
    return memory.crossJoin(activity).crossJoin(spark.createDataFrame([(k,) for k in ERROR_LADDERS], "errors string"))


def sweep(planes: DataFrame, best: int = 5) -> DataFrame:
    """(memory, activity, errors, n_bytes, parts): the settings whose streams are smallest, by real bytes.

    Images are cut into bands once and stored; every band is coded under every setting, bands of one size and setting side by
    side, and only sizes come back. A setting travels in the stream's header, so each stream decodes by itself.
    """
    spark = planes.sparkSession
    bands = kept(codec.cut_media(planes).where("NOT clip").drop("clip"), "bands").crossJoin(F.broadcast(settings_grid(spark)))  # eighteen rows
    key = ["memory", "activity", "errors", "media_id", "part"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, images = list(zip(*(rows.column(k).to_pylist() for k in range(5)))), [codec.part_frames(p)[0] for p in rows.column(5).to_pylist()]
            for places in codec.side_by_side([(k[:3], *(p.shape for p in i)) for k, i in zip(keys, images)]):
                streams = codec.encode_images([images[k] for k in places], settings_of(*keys[places[0]][:3]))
                values = [(*keys[k], len(stream)) for k, (stream, _) in zip(places, streams)]
                arrow = {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}
                kinds = [arrow[x.split()[1]] for x in SWEPT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*values), kinds)], names=[x.split()[0] for x in SWEPT.split(", ")])

    coded = codec.gathered(bands, key).mapInArrow(code, SWEPT)
    sums = coded.groupBy("memory", "activity", "errors").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("parts"))
    return sums.orderBy("n_bytes", "memory", "activity", "errors").limit(best)


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, "[.]([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*KINDS["image"]), "image").when(ext.isin(*KINDS["clip"]), "clip").when(ext == "", "none").otherwise("other")
