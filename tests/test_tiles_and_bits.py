"""Halo tiles, bit packing, header folds, and the y4m source's pushdown."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import bitpack, codec, coders, entropy, stencils, tiles, wavefront
from rasterloom.plans import studies
from rasterloom.sources import rasters, y4m

SAMPLES = "media_id string, frame_no int, plane_no int, y int, x int, v int"


def plane(h, w, seed=0, most=256):
    return np.random.default_rng(seed).integers(0, most, (h, w)).astype(np.int64)


def frame_of(spark, *planes):
    rows = [("m", 0, p, y, x, int(v)) for p, a in enumerate(planes) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, SAMPLES).repartition(3)


def moved(a, dy, dx, top="repeat"):
    h, w = a.shape
    y, x = np.arange(h)[:, None] - dy, np.clip(np.arange(w)[None] - dx, 0, w - 1)
    out = a[np.clip(y, 0, h - 1), x]
    return out if top == "repeat" else np.where(y < 0, 0, out)


def grid(frame, column, shape, plane_no=0):
    out = np.full(shape, -999, np.int64)
    for r in frame.where(F.col("plane_no") == plane_no).select("y", "x", column).collect():
        out[r["y"], r["x"]] = -1 if r[column] is None else r[column]
    return out


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 4)
    monkeypatch.setattr(tiles, "COLUMNS", 3)


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (4, 3), (11, 8)])
def test_neighbours_across_tiles(spark, small_tiles, shape):
    a, b = plane(*shape), plane(*shape, seed=1)
    found = stencils.repeated_neighbours(frame_of(spark, a, b)).cache()
    for name, (dy, dx) in {"w": (0, 1), "n": (1, 0), "nw": (1, 1), "ne": (1, -1), "ww": (0, 2), "nn": (2, 0), "nne": (2, -1)}.items():
        assert np.array_equal(grid(found, name, shape), moved(a, dy, dx)), name
        assert np.array_equal(grid(found, name, shape, 1), moved(b, dy, dx)), name
    near = stencils.neighbours(frame_of(spark, a), second_ring=True).cache()
    zero = np.pad(a, ((1, 0), (1, 0)))
    assert np.array_equal(grid(near, "n", shape), zero[:-1, 1:]) and np.array_equal(grid(near, "nw", shape), zero[:-1, :-1])
    assert found.count() == 2 * a.size and near.count() == a.size


@pytest.mark.parametrize(("dy", "dx"), [(0, 0), (5, 4), (2, -3), (9, 0), (0, -7), (1, 20)])
def test_shifts_across_tiles(spark, small_tiles, dy, dx):
    a = plane(10, 8)
    for top in ("repeat", "zero"):
        found = stencils.shifted(frame_of(spark, a), dy, dx, top)
        assert np.array_equal(grid(found, "s", a.shape), moved(a, dy, dx, top))


def test_half_samples_across_tiles(spark, small_tiles):
    a = plane(9, 7)
    r, d = np.pad(a, ((0, 0), (0, 1)), "edge")[:, 1:], np.pad(a, ((0, 1), (0, 0)), "edge")[1:]
    rd = np.pad(r, ((0, 1), (0, 0)), "edge")[1:]
    found = stencils.half_sample_planes(frame_of(spark, a)).cache()
    for phase, want in enumerate((a, a + r + 1 >> 1, a + d + 1 >> 1, a + r + d + rd + 2 >> 2)):
        assert np.array_equal(grid(found.where(F.col("phase") == phase), "v", a.shape), want)


def test_no_window_over_a_whole_plane(spark):
    """One exchange by tile; every window lies within a tile; tiles grow in number with the rows."""
    frame = frame_of(spark, plane(300, 5))
    for made in (stencils.neighbours(frame, True), stencils.half_sample_planes(frame), stencils.shifted(frame, 2, -1), stencils.med_bundle(frame)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
        windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
        assert windows and all("_ty" in w and "_tx" in w for w in windows)
    count = lambda h: tiles.tiled(frame_of(spark, plane(h, 2)), up=1).where("_own").select("_ty", "_tx").distinct().count()
    assert (count(100), count(256), count(1000)) == (1, 2, 8)


def test_matches_and_runs(spark, small_tiles):
    a = plane(14, 9, seed=3, most=2)
    near = {(y, x): (a[y, x - 1], a[y - 1, x], a[y - 1, x - 1], a[y - 1, x + 1] if x + 1 < 9 else a[y - 1, x]) for y in range(1, 14) for x in range(1, 9)}
    last, want, run = {}, {}, {}
    for (y, x), key in near.items():
        pos = y * 9 + x
        match = last.get(key)
        last[key] = pos
        before = run.get((y, x - 1))
        long = 0 if match is None else 1 + (before[0] if before and before[1] == match - 1 and before[0] else 0)
        run[y, x] = long, match
        want[y, x] = match, long, None if not long else pos - long + 1
    for chunk in (1 << 16, 10):
        found = stencils.match_runs(stencils.previous_occurrence(frame_of(spark, a), 9, chunk), 9)
        assert {(r["y"], r["x"]): (r["match_pos"], r["run"], r["run_start"]) for r in found.collect()} == want


def test_headroom_by_hand(spark, small_tiles):
    """Predictors, contexts and entropies of the study in plain numpy, edges repeated, over all samples."""
    y, x = np.mgrid[0:17, 0:13]
    planes = [(y * 7 + x * 3 + plane(17, 13, 5, 9)) & 255, plane(17, 13, 6), plane(3, 9, 7)]
    centred = lambda d: (d + 128 & 255) - 128
    found = {(r["plane_no"], r["predictor"]): r["entropy_bytes"] for r in studies.headroom(frame_of(spark, *planes)).collect()}
    weights = {r["plane_no"]: r["weights"] for r in studies.least_squares(frame_of(spark, *planes)).collect()}
    want = {}
    for p, a in enumerate(planes):
        w, n, nw, ne, ww, nn, nne = (moved(a, *s) for s in ((0, 1), (1, 0), (1, 1), (1, -1), (0, 2), (2, 0), (2, -1)))
        med = np.where(nw >= np.maximum(n, w), np.minimum(n, w), np.where(nw <= np.minimum(n, w), np.maximum(n, w), n + w - nw))
        dh, dv = abs(w - ww) + abs(n - nw) + abs(n - ne), abs(w - nw) + abs(n - nn) + abs(ne - nne)
        d, base = dv - dh, (w + n) / 2 + (ne - nw) / 4
        gap = np.select([d > 80, d < -80, d > 32, d < -32, d > 8, d < -8], [w, n, (base + w) / 2, (base + n) / 2, (3 * base + w) / 4, (3 * base + n) / 4], base)
        predictions = {"med": med, "gap": gap}
        if p in weights:
            taps = np.stack([w, n, nw, ne, ww, nn], axis=2)
            solved, *_ = np.linalg.lstsq(taps[2:, 2:].reshape(-1, 6).astype(float), a[2:, 2:].ravel().astype(float), rcond=None)
            assert np.allclose(weights[p], np.rint(solved * 64) / 64)
            linear = taps @ np.array(weights[p])
            predictions |= {"linear": linear, "med_linear": (med + linear) / 2}
        spread = abs(centred(w - nw)) + abs(centred(nw - n)) + abs(centred(n - ne))
        for name, pred in predictions.items():
            residual = centred(a - np.rint(np.clip(pred, 0, 255)).astype(np.int64))
            size, sym = abs(residual), np.where(residual >= 0, residual * 2, -residual * 2 - 1)
            err = moved(size, 0, 1) + moved(size, 1, 0)
            from rasterloom.functions import samples as S

            ctx = np.searchsorted(S.CODEC_ACTIVITY, spread, "right") * 100 + np.searchsorted(S.CODEC_ERROR, err, "right")
            bits = 0.0
            for c in np.unique(ctx):
                counts = np.bincount(sym[ctx == c])
                counts = counts[counts > 0]
                bits -= (counts * np.log2(counts / counts.sum())).sum()
            want[p, name] = bits / 8
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 0.01 for k in want)


# ---- bits


@pytest.mark.parametrize("chunk", [3, 4096])
def test_packed_bits_are_the_coders(spark, monkeypatch, chunk):
    monkeypatch.setattr(bitpack, "BLOCK", 5)
    rng = np.random.default_rng(2)
    texts = {"one": b"aaaaaaa", "two": b"abab", "skew": bytes(np.minimum(255, rng.geometric(0.3, 700)).astype(np.uint8)), "all": bytes(range(256)) * 3, "deep": b"".join(bytes([k]) * int(1.7**k + 1) for k in range(18)), "none": b""}
    data = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()] + [("null", None)], "media_id string, data binary")
    symbols, counts = rasters.byte_rows(data), rasters.byte_counts(data)
    lengths = studies.huffman_lengths(counts, "media_id")
    offsets = bitpack.bit_offsets
    monkeypatch.setattr(bitpack, "bit_offsets", lambda coded, keys: offsets(coded, keys, chunk))
    packed = bitpack.huffman_packed(symbols, lengths, entropy.canonical_codes(lengths, ["media_id"]), ["media_id"])
    found = {r["media_id"]: bytes(r["data"]) for r in packed.collect()}
    assert found == {k: coders.huffman_encode(np.frombuffer(v, np.uint8).astype(np.int64)) for k, v in texts.items() if v}
    assert {(r["media_id"], r["sym"]): r["n"] for r in counts.collect()} == {(k, s): v.count(s) for k, v in texts.items() for s in set(v)}


@pytest.mark.parametrize("stretch", [3, 1 << 16])
def test_stretches_are_the_coders_and_not_a_row_a_byte(spark, monkeypatch, stretch):
    """Whole values by stretches: the coder's bits, from as many rows as there are stretches; decoded by pieces."""
    monkeypatch.setattr(coders, "DECODED", 7)
    rng = np.random.default_rng(3)
    texts = {"one": b"aaaaaaa", "two": b"abab", "skew": bytes(np.minimum(255, rng.geometric(0.3, 700)).astype(np.uint8)), "all": bytes(range(256)) * 3, "deep": b"".join(bytes([k]) * int(1.7**k + 1) for k in range(18)), "none": b""}
    data = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()] + [("null", None)], "media_id string, data binary")
    lengths = studies.huffman_lengths(rasters.byte_counts(data), "media_id")
    body = bitpack.stretch_packed(data, entropy.canonical_codes(lengths, ["media_id"]), "media_id", stretch)
    packed = bitpack.length_table(lengths, ["media_id"]).join(body, "media_id").select("media_id", F.concat("head", "data").alias("data"))
    found = {r["media_id"]: bytes(r["data"]) for r in packed.collect()}
    assert found == {k: coders.huffman_encode(np.frombuffer(v, np.uint8).astype(np.int64)) for k, v in texts.items() if v}
    for k, coded in found.items():
        assert coders.huffman_decode(coded, len(texts[k])).astype(np.uint8).tobytes() == texts[k]
        with pytest.raises(ValueError):
            coders.huffman_decode(coded[:-2], len(texts[k]) + 20)


def test_code_lengths_and_sizes_against_the_coder(spark):
    """A10, A11, A16: lengths of each text's tree, and the bits they take, beside the numpy coder's own."""
    rows = [("a", b"hello hello world"), ("b", bytes(range(40)) + b"zz" * 50)]
    data = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "media_id string, data binary")
    counts = rasters.byte_counts(data)
    lengths = studies.huffman_lengths(counts, "media_id")
    bits = {r["media_id"]: r["bits"] for r in entropy.coded_bits(counts, lengths, ["media_id"]).collect()}
    for k, v in rows:
        want = coders.code_lengths(np.bincount(np.frombuffer(v, np.uint8), minlength=256))
        assert {r["sym"]: r["len"] for r in lengths.where(F.col("media_id") == k).collect()} == {s: int(n) for s, n in enumerate(want) if n}
        assert len(coders.huffman_encode(np.frombuffer(v, np.uint8).astype(np.int64))) == 128 + -(-bits[k] // 8)


# ---- headers


def test_headers_by_a_fold(spark):
    rng = np.random.default_rng(1)
    v = lambda *xs: b"".join(coders.varint(int(x)) for x in xs)
    rows = []
    for k in range(120):
        size = lambda: rng.choice([rng.integers(1, 128), rng.integers(128, 70_000), rng.integers(1, 1 << 20)])
        planes, flags, block = (int(rng.integers(1, n)) for n in (5, 4, 256))
        kind = k % 3
        if kind == 0:
            head = codec.IMAGE + v(size(), size()) + bytes([planes, flags])
        elif kind == 1:
            head = codec.CLIP + v(size()) + bytes([planes, flags, block]) + v(*rng.integers(1, 3000, 2 * planes))
        else:
            head = codec.PARTS + bytes([k & 1]) + v(size(), size()) + bytes([planes]) + v(size()) + bytes([flags & 1, block]) + v(size())
        rows.append((str(k), bytearray(head + rng.bytes(int(rng.choice([0, 3, 300]))))))
    frame = codec.stream_info(spark.createDataFrame(rows, "media_id string, payload binary"))
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().toString())
    found = {r["media_id"]: r.asDict() for r in frame.collect()}
    for k, payload in rows:
        want = codec.header(bytes(payload))
        assert {n: found[k][n] for n in want} == want and found[k]["n_bytes"] == len(payload)
        assert abs(found[k]["bits_per_sample"] - 8 * len(payload) / want["samples"]) < 1e-9


@pytest.mark.parametrize("bad", [b"XXXX" + bytes(30), codec.IMAGE + b"\x80", codec.CLIP + bytes([1, 3, 0, 8, 4, 4]), b"", codec.PARTS])
def test_foreign_and_cut_headers(spark, bad):
    with pytest.raises(Exception, match="foreign or damaged"):
        codec.stream_info(spark.createDataFrame([("a", bytearray(bad))], "media_id string, payload binary")).collect()


# ---- the y4m source


def clip_planes(spark, frames, head):
    rng = np.random.default_rng(3)
    made = [[rng.integers(0, 256, s).astype(np.uint8) for s in head.shapes()] for _ in range(frames)]
    rows = [("c", k, p, a.shape[1], a.shape[0], bytearray(a.tobytes())) for k, f in enumerate(made) for p, a in enumerate(f)]
    return made, spark.createDataFrame(rows, "media_id string, frame_no int, plane_no int, width int, height int, data binary").repartition(4)


def test_parts_of_a_clip_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(y4m, "FRAMES_PER_PARTITION", 4)
    head = y4m.Header(6, 4, "420jpeg")
    made, planes = clip_planes(spark, 11, head)
    y4m.save(planes, f"file://{tmp_path}/out")
    y4m.save(planes, f"file://{tmp_path}/out")  # once more: the same files
    assert all(re.fullmatch(r"c-\d{9}[.]y4m", f.name) for f in (tmp_path / "out").iterdir())
    back = spark.read.format("y4m").load(str(tmp_path / "out"))
    found = {(r["media_id"], r["frame_no"], r["plane_no"]): bytes(r["data"]) for r in back.collect()}
    assert found == {("c", k, p): a.tobytes() for k, f in enumerate(made) for p, a in enumerate(f)}
    assert {(r["colourspace"], r["rate"]) for r in back.collect()} == {("420jpeg", "25:1")}
    wrong = planes.withColumn("height", F.lit(3))
    with pytest.raises(Exception, match="sizes"):
        y4m.save(wrong, str(tmp_path / "wrong"))
    assert not [f for f in (tmp_path / "wrong").iterdir() if not f.name.startswith("_temporary")]


class _Counted:
    def __init__(self, file, log):
        self.file, self.log = file, log

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        out = self.file.read(n)
        self.log.append(len(out))
        return out


@pytest.mark.parametrize(
    ("pushed", "frames", "planes"),
    [
        ([("LessThan", "frame_no", 3)], range(3), range(3)), ([("GreaterThanOrEqual", "frame_no", 7), ("LessThanOrEqual", "frame_no", 8)], (7, 8), range(3)),
        ([("EqualTo", "frame_no", 5), ("EqualTo", "plane_no", 0)], (5,), (0,)), ([("In", "frame_no", (1, 9, None)), ("GreaterThan", "plane_no", 0)], (1, 9), (1, 2)), ([("LessThan", "frame_no", 0)], (), ()), ([], range(10), range(3)),
    ],
)
def test_filters_decide_what_is_read(tmp_path, monkeypatch, pushed, frames, planes):
    """Only the header and the frames and planes that are left are read, to the byte."""
    import pyspark.sql.datasource as D

    head = y4m.Header(20, 10)
    rng = np.random.default_rng(4)
    clip = [[rng.integers(0, 256, s).astype(np.uint8) for s in head.shapes()] for _ in range(10)]
    (tmp_path / "c.y4m").write_bytes(data := y4m.write(clip, head))
    log, plain = [], y4m._open
    monkeypatch.setattr(y4m, "_open", lambda path: _Counted(plain(path), log))
    monkeypatch.setattr(y4m, "FRAMES_PER_PARTITION", 4)
    reader = y4m._Y4mReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([getattr(D, kind)((c,), v) for kind, c, v in pushed] + [other := D.EqualTo(("width",), 20)]))
    assert left == [other]
    runs = reader.partitions()
    headers = sum(log)
    rows = [r for run in runs for r in reader.read(run)]
    assert [(r[1], r[2]) for r in rows] == [(k, p) for k in frames for p in planes]
    assert all(r[5] == clip[r[1]][r[2]].tobytes() for r in rows)
    used = sum(log) - headers - sum(min(4096, len(data)) for run in runs if run.count)
    assert used == len(list(frames)) * 6 + sum(len(r[5]) for r in rows)


def test_filters_reach_the_source(spark, tmp_path):
    """A clip whose later frames are damaged: a filter that rules them out reads it, anything else stops."""
    head = y4m.Header(8, 4, "mono")
    data = bytearray(y4m.write([[np.full((4, 8), k, np.uint8)] for k in range(6)], head))
    at = head.size or len(head.line())
    data[at + 4 * 38 : at + 4 * 38 + 5] = b"XXXXX"
    (tmp_path / "d.y4m").write_bytes(data)
    y4m.register(spark)
    source = spark.read.format("y4m").load(str(tmp_path / "d.y4m"))
    assert source.where("frame_no < 4").count() == 4 and [r["frame_no"] for r in source.where("frame_no = 5").collect()] == [5]
    with pytest.raises(Exception, match="mark"):
        source.where("width = 8").collect()


# ---- settings and sweeps


@pytest.mark.parametrize("settings", [wavefront.DEFAULT, wavefront.Settings((3, 9), (1, 2, 300), 5), wavefront.Settings(tuple(range(1, 64)), (7,), 20)])
def test_streams_carry_their_settings(settings):
    image = [plane(23, 17, k).astype(np.uint8) // 3 for k in range(3)]
    stream = codec.encode_image(image, settings=settings)
    assert all(map(np.array_equal, codec.decode_image(stream), image)) and codec.header(stream)["samples"] == 3 * 23 * 17
    with pytest.raises(ValueError):
        wavefront.Settings((3, 3))


def test_sweep_by_real_bytes(spark, monkeypatch):
    y, x = np.mgrid[0:24, 0:20]
    image = [(y * 5 + x * 2 + plane(24, 20, 3, 6)).astype(np.uint8), plane(24, 20, 4, 40).astype(np.uint8)]
    rows = [("m", 0, p, 20, 24, bytearray(a.tobytes())) for p, a in enumerate(image)]
    planes = spark.createDataFrame(rows, "media_id string, frame_no int, plane_no int, width int, height int, data binary")
    from rasterloom.functions import samples as S

    sizes = sorted((len(codec.encode_image(image, settings=wavefront.Settings(S.ACTIVITY_LADDERS[a], studies.ERROR_LADDERS[e], m))), m, a, e) for m in (8, 10, 12) for a in (12, 16, 24) for e in ("e3", "e6"))
    found = [(r["n_bytes"], r["memory"], r["activity"], r["errors"]) for r in studies.sweep(planes).collect()]
    assert found == sizes[:5] and len(sizes) == 18


def test_motion_sweep_by_the_search(spark):
    from rasterloom.operators import motion

    a, b = plane(32, 48, 1).astype(np.uint8), plane(32, 48, 1).astype(np.uint8)
    b = np.roll(b, 2, axis=1)
    rows = [("m", k, 0, 48, 32, bytearray(f.tobytes())) for k, f in enumerate((a, b))]
    planes = spark.createDataFrame(rows, "media_id string, frame_no int, plane_no int, width int, height int, data binary")
    want = []
    for block in (8, 16, 32):
        for penalty in (0, 48, 96):
            mode, _, _, temporal, spatial = motion.modes(b, a, block, penalty)
            want.append((int(np.where(mode == 1, temporal, spatial).sum()), block, penalty))
    found = [(r["cost"], r["block"], r["penalty"]) for r in studies.motion_sweep(planes).collect()]
    assert found == sorted(want)[:5]


# ---- adaptive probabilities


@pytest.mark.parametrize("part", [3, 64, 4096])
def test_adaptive_probabilities_by_the_coders_bank(spark, part):
    """The fold's probabilities are those that the range coder's bank ends with; its bits are near the coded size."""
    from rasterloom.operators import adaptive

    rng = np.random.default_rng(6)
    rows, banks, bits, sizes = [], {}, {}, {}
    for c, chance in enumerate((0.03, 0.5, 0.98, 1.0)):
        coder, bank = coders.BitEncoder(), [32768]
        banks[c], bits[c] = bank, 0.0
        for k in range(900 if c else 1):
            bit = int(rng.random() < chance)
            p = max(32, min(65504, bank[0])) / 65536
            bits[c] -= np.log2(p if bit else 1 - p)
            coder.bit(bank, 0, bit)
            rows.append((c, 7 * k + c, bit))
        sizes[c] = len(coder.finish())
    rows.append((9, 1, None))
    found = {r["ctx"]: r for r in adaptive.learned(spark.createDataFrame(rows, "ctx int, pos long, bit int").repartition(4), ["ctx"], part).collect()}
    assert set(found) == set(banks)
    for c, r in found.items():
        assert r["p"] == banks[c][0] and abs(r["bits"] - bits[c]) < 1e-6 and r["n"] == (900 if c else 1)
        assert abs(sizes[c] - bits[c] / 8) <= 5


# ---- clip codecs


def test_clip_codecs_side_by_side(spark, monkeypatch):
    """A still clip, a panned one and one of uneven planes: sizes by direct calls, lossless by the join."""
    y, x = np.mgrid[0:16, 0:24]
    base = ((y * 5 + x * 3) % 200 + plane(16, 24, 2, 4)).astype(np.uint8)
    clips = {"still": [[base]] * 5, "panned": [[np.roll(base, 2 * k, axis=1)] for k in range(5)], "chroma": [[base, base[::2, ::2], base[1::2, ::2]]] * 2}
    rows = [(m, k, p, a.shape[1], a.shape[0], bytearray(np.ascontiguousarray(a).tobytes())) for m, frames in clips.items() for k, f in enumerate(frames) for p, a in enumerate(f)]
    planes = spark.createDataFrame(rows, "media_id string, frame_no int, plane_no int, width int, height int, data binary")
    found = {(r["media_id"], r["codec"]): r for r in studies.clip_comparison(planes, 3).collect()}
    assert len(found) == 12
    for (m, name), r in found.items():
        frames = [[np.ascontiguousarray(p) for p in f] for f in clips[m]]
        assert r["frames"] == len(frames) and r["raw_bytes"] == sum(p.size for f in frames for p in f)
        if m == "chroma" and name in ("frames", "difference"):
            assert not r["lossless"] and r["n_bytes"] is None and "size" in r["status"]
            continue
        assert r["lossless"] and r["status"] == "ok" and r["n_bytes"] == sum(studies.CLIP_CODECS[name](frames[a : a + 3])[0] for a in range(0, len(frames), 3))
    assert found["still", "difference"]["n_bytes"] < found["still", "frames"]["n_bytes"]
    lossy = lambda frames: (1, [[p ^ (k == 1) for p in f] for k, f in enumerate(frames)])
    short = lambda frames: (1, frames[:-1])
    for bad in (lossy, short):
        monkeypatch.setitem(studies.CLIP_CODECS, "deflate", bad)
        told = {(r["media_id"], r["codec"]): r["lossless"] for r in studies.clip_comparison(planes, 3).collect()}
        assert not told["still", "deflate"] and told["still", "motion"]


def test_groups_of_clips_side_by_side(monkeypatch):
    """Frames and groups of one shape go through the model together, with the bytes they have alone."""
    clips = [[[plane(8, 12, 5 * k + f, 40)] for f in range(3)] for k in range(4)]
    calls, encode = [], codec.encode_images
    monkeypatch.setattr(codec, "encode_images", lambda images, *a: (calls.append(len(images)), encode(images, *a))[1])
    for name in ("frames", "difference", "motion"):
        found = studies.CLIP_CODECS[name].many(clips)
        for (size, back), frames in zip(found, clips):
            assert size == studies.CLIP_CODECS[name](frames)[0] and all(np.array_equal(p, q) for f, g in zip(back, frames) for p, q in zip(f, g))
    assert calls[0] == 12


def test_raw_bytes_of_a_clip_with_a_short_last_frame(spark):
    frames = [plane(8, 10, 0, 9), plane(8, 10, 1, 9), plane(3, 10, 2, 9)]
    rows = [("m", k, 0, 10, f.shape[0], bytearray(f.astype(np.uint8).tobytes())) for k, f in enumerate(frames)]
    planes = spark.createDataFrame(rows, "media_id string, frame_no int, plane_no int, width int, height int, data binary")
    found = studies.clip_comparison(planes).collect()
    assert len(found) == 4 and all(r["raw_bytes"] == 190 and r["lossless"] and r["frames"] == 3 for r in found)


def test_streams_side_by_side_are_those_one_by_one(monkeypatch):
    """Images and clips of one size go through the model together, with statistics each; other sizes among them."""
    monkeypatch.setattr(codec, "ABREAST", 2)
    images = [[plane(9, 14 if k == 1 else 7, k + c, 20 + 60 * k) for c in range(3)] for k in range(4)]
    same = [images[k] for k in (0, 2, 3)]
    for settings in (wavefront.DEFAULT, studies.settings_of(8, 12, "e3")):
        alone = []
        for i in same:
            alone.append((codec.encode_image(i, told := {}, settings), told))
        assert codec.encode_images(same, settings) == alone
        assert np.allclose(codec.images_bits(same, settings), [codec.image_bits(i, settings) for i in same])
    streams = [codec.encode_image(i) for i in images]
    assert all(np.array_equal(a, b) for i, j in zip(images, codec.decode_images(streams)) for a, b in zip(i, j))
    clips = [[[plane(17, 20, 5 * k + f, 30 + 60 * k), plane(9, 10, k + f, 40)] for f in range(3)] for k in range(3)]
    streams = codec.encode_clips(clips)
    assert streams == [codec.encode_clip(c) for c in clips]
    assert all(np.array_equal(a, b) for c, d in zip(clips, codec.decode_clips(streams)) for f, g in zip(c, d) for a, b in zip(f, g))


def test_costs_are_near_coded_sizes(spark):
    """Within a thousandth of the coded bytes, or the few bytes that headers and lanes take; the change has its sign."""
    y, x = np.mgrid[0:90, 0:110]
    image = [((y * 3 + x * 2) // 3 + plane(90, 110, k, 24)).astype(np.uint8) for k in range(2)]
    a, b = (10, 16, "e6"), (4 + 4, 24, "e3")
    for name in (a, b):
        settings = studies.settings_of(*name)
        coded, cost = len(codec.encode_image(image, settings=settings)), codec.image_bits(image, settings) / 8
        lanes = wavefront.coders_of(90, 110)
        assert cost - 1 <= coded <= cost * 1.001 + 64 + 5 * lanes
    rows = [("m", 0, p, 110, 90, bytearray(i.tobytes())) for p, i in enumerate(image)]
    planes = spark.createDataFrame(rows, "media_id string, frame_no int, plane_no int, width int, height int, data binary")
    r = studies.quick(planes, a, b).first()
    assert abs(r["a_bytes"] - codec.image_bits(image, studies.settings_of(*a)) / 8) < 0.06
    assert abs(r["b_bytes"] - codec.image_bits(image, studies.settings_of(*b)) / 8) < 0.06
    assert abs(r["change"] - 100 * (r["b_bytes"] - r["a_bytes"]) / r["a_bytes"]) < 0.01


def test_displacements_shuffle_a_sample_twice(spark, monkeypatch):
    """Costs in small tiles against the join they stand for: holes, a sample twice, a short frame, a place below 0; and no
    join by coordinates, which would shuffle a row for each sample and displacement."""
    from rasterloom.operators import motion

    monkeypatch.setattr(motion, "TILE", (4, 4))
    rng = np.random.default_rng(4)
    rows = [("m", f, 0, y, x, int(rng.integers(0, 256))) for f in range(4) for y in range(7 if f == 1 else 11) for x in range(10) if rng.random() < 0.93]
    rows += [("m", 1, 0, 3, 4, 17), ("m", 2, 0, 0, 0, 200), ("m", 2, 0, -3, 2, 9), ("m", 0, 0, -1, -1, 5), ("m", None, 0, 1, 1, 5), ("n", 5, 0, 0, 0, 1), ("n", 6, 0, 0, 0, 3)]
    samples = spark.createDataFrame(rows, SAMPLES).repartition(3)
    kept = [r for r in rows if r[1] is not None]
    most = {m: (max(r[3] for r in rows if r[0] == m), max(r[4] for r in rows if r[0] == m)) for m in "mn"}
    refs, expected = {}, {}
    for m, f, _, y, x, v in kept:
        refs.setdefault((m, f, y, x), []).append(v)
    for m, f, _, y, x, v in kept:
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                place = (m, f - 1, max(0, min(most[m][0], y + dy)), max(0, min(most[m][1], x + dx)))
                for r in refs.get(place, []):
                    own = (m, f, int(y / 3), int(x / 3), dy, dx)
                    expected[own] = expected.get(own, 0) + int(motion.cost(np.array([v]), np.array([r]))[0])
    costs = motion.displacement_costs(samples, 2, 3)
    found = [tuple(r) for r in costs.collect()]
    assert len(found) == len(expected) and {r[:6]: r[6] for r in found} == expected
    plan = costs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("rightHint=(strategy=broadcast)") == 1


def test_slots_of_a_symbol_without_an_aggregation(spark):
    """The slots by hand, and that none is counted a row a slot (which kept a row of every symbol in one task's memory)."""
    from rasterloom.plans import queries as engine
    from tests.conftest import DATA

    freqs = spark.createDataFrame([("a", 3, 2), ("a", 9, 3), ("b", 0, 1)], "media_id string, sym int, freq long")
    assert sorted(tuple(r) for r in entropy.slot_lists(freqs, ["media_id"]).collect()) == [("a", 3, [0, 1]), ("a", 9, [2, 3, 4]), ("b", 0, [0])]
    assert sorted(tuple(r) for r in entropy.slot_table(freqs, ["media_id"]).collect()) == [("a", 0, 3), ("a", 1, 3), ("a", 2, 9), ("a", 3, 9), ("a", 4, 9), ("b", 0, 0)]
    plan = engine.slot_table(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1


# ---- large planes in strips


def test_large_images_are_compared_in_strips(spark, monkeypatch):
    """Every codec takes strips of an image beyond STRIP_SAMPLES, each a stream of its own, and a smaller image whole."""
    monkeypatch.setattr(studies, "STRIP_SAMPLES", 24 * 3 * 16)
    images = {"large": [plane(40, 24, k, 64).astype(np.uint8) for k in range(3)], "small": [plane(9, 24, k, 64).astype(np.uint8) for k in range(3)]}
    rows = [(m, 0, p, a.shape[1], a.shape[0], bytearray(a.tobytes())) for m, planes in images.items() for p, a in enumerate(planes)]
    found = studies.comparison(spark.createDataFrame(rows, codec.PLANE_SCHEMA)).collect()
    assert len(found) == 2 * len(studies.CODECS)
    for r in found:
        image = images[r["media_id"]]
        strips = [[p[a : a + 16] for p in image] for a in range(0, len(image[0]), 16)] if r["codec"] != "own" else [image]
        assert r["n_bytes"] == sum(len(studies.CODECS[r["codec"]](s)[0]) for s in strips)
        assert r["lossless"] and r["max_err"] == 0 and r["raw_bytes"] == sum(p.size for p in image) and r["pixels"] == image[0].size


def test_planes_are_packed_and_unpacked_in_strips(spark, monkeypatch):
    """No group holds more than PACKED_ROWS rows, no batch more than STRETCH samples; holes, whole strips of them, are 0."""
    monkeypatch.setattr(rasters, "PACKED_ROWS", 3)
    monkeypatch.setattr(rasters, "STRETCH", 7)
    a, b = plane(14, 5), plane(2, 9, 1)
    samples = frame_of(spark, a, b).where("plane_no = 1 OR NOT y BETWEEN 3 AND 7 AND NOT (y = 13 AND x = 4)")
    a[3:8], a[13, 4] = 0, 0
    packed = rasters.pack(samples)
    found = {r["plane_no"]: r for r in packed.collect()}
    for k, want in enumerate((a, b)):
        assert (found[k]["height"], found[k]["width"]) == want.shape and bytes(found[k]["data"]) == want.astype(np.uint8).tobytes()
    back = rasters.unpack(packed).collect()
    assert len(back) == a.size + b.size and all(r["v"] == (a, b)[r["plane_no"]][r["y"], r["x"]] for r in back)


def test_decoded_bands_have_their_first_rows(spark):
    """Bands leave the decoder one by one and are unpacked where they lie; a clip's groups keep their frame numbers."""
    image, frames = plane(50, 6, 2, 32), [plane(4, 6, k, 32) for k in range(5)]
    rows = [("image", 0, 0, y, x, int(v)) for (y, x), v in np.ndenumerate(image)] + [("clip", f, 0, y, x, int(v)) for f, a in enumerate(frames) for (y, x), v in np.ndenumerate(a)]
    bands = codec.decode_bands(codec.encode_media(rasters.pack(spark.createDataFrame(rows, SAMPLES)), band_samples=96, group_frames=2))
    assert {(r["media_id"], r["frame_no"], r["top"], r["height"]) for r in bands.collect()} == {("image", 0, 0, 16), ("image", 0, 16, 16), ("image", 0, 32, 16), ("image", 0, 48, 2), *(("clip", f, 0, 4) for f in range(5))}
    assert sorted(map(tuple, rasters.unpack(bands).collect())) == sorted(rows)
