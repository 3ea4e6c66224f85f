import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.operators import coders, codec, motion, wavefront


def picture(h, w, c=3, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    base = 128 + 60 * np.sin(x / 9) + 30 * np.cos(y / 7)
    shifts = (0, 12, -18, 0)
    planes = [np.clip(base + shifts[k] + rng.normal(0, 2, (h, w)), 0, 255).astype(np.uint8) for k in range(min(c, 3))]
    return planes + [np.full((h, w), 200, np.uint8)] * (c == 4)


def same(a, b):
    return len(a) == len(b) and all(np.array_equal(x, y) for x, y in zip(a, b))


@given(st.lists(st.integers(0, 255), max_size=400))
@settings(max_examples=60, deadline=None)
def test_static_coders_round_trip(values):
    s = np.array(values, np.int64)
    assert np.array_equal(coders.huffman_decode(coders.huffman_encode(s), len(s)), s)
    freq = coders.normalise(np.bincount(s, minlength=256))
    if len(s):
        assert freq.sum() == 4096 and ((freq > 0) == (np.bincount(s, minlength=256) > 0)).all()
        assert np.array_equal(coders.rans_decode(coders.rans_encode(s, freq), len(s), freq), s)
    again = coders.read_table(coders.Reader(coders.write_table(freq)))
    assert (freq is None and again is None) or np.array_equal(freq, again)


def test_sparse_histogram_and_deep_tree():
    hist = np.zeros(256, np.int64)
    hist[[0, 5, 200]] = 1_000_000, 1, 3
    freq = coders.normalise(hist)
    assert freq.sum() == 4096 and set(np.flatnonzero(freq)) == {0, 5, 200}
    deep = np.zeros(256, np.int64)
    deep[:40] = [int(1.7**k) + 1 for k in range(40)]
    lengths = coders.code_lengths(deep)
    assert lengths.max() <= 15 and (2.0 ** -lengths[lengths > 0]).sum() == 1


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 1 << 40])
def test_varints(n):
    assert coders.Reader(coders.varint(n)).varint() == n
    assert coders.Reader(coders.signed_varint(-n)).signed_varint() == -n
    with pytest.raises(ValueError):
        coders.varint(-1)


def test_bit_coder():
    rng = np.random.default_rng(1)
    bits = (rng.random(20000) < 0.03).astype(int).tolist()
    mixed = rng.integers(0, 2, 3000).tolist()
    coder, bank = coders.BitEncoder(), [32768] * 9
    for b in bits:
        coder.bit(bank, 0, b)
    for k, b in enumerate(mixed):
        coder.bit(bank, 1 + k % 8, b)
    coder.bypass(0x2345678, 28)
    data = coder.finish()
    assert len(data) * 8 < 0.5 * len(bits) + 1.1 * len(mixed)
    reader, bank = coders.BitDecoder(data), [32768] * 9
    assert [reader.bit(bank, 0) for _ in bits] == bits
    assert [reader.bit(bank, 1 + k % 8) for k in range(len(mixed))] == mixed
    assert reader.bypass(28) == 0x2345678


@pytest.mark.parametrize("shape", [(1, 1, 3), (1, 40, 3), (40, 1, 3), (7, 9, 1), (33, 51, 3), (16, 16, 4)])
def test_image_shapes(shape):
    image = picture(*shape)
    assert same(codec.decode_image(codec.encode_image(image)), image)


@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**32 - 1), st.sampled_from([2, 256]))
@settings(max_examples=25, deadline=None)
def test_random_planes(h, w, seed, values):
    image = [np.random.default_rng(seed).integers(0, values, (h, w)).astype(np.uint8) * (255 if values == 2 else 1)]
    assert same(codec.decode_image(codec.encode_image(image)), image)


def test_sizes():
    flat = [np.full((64, 64), 77, np.uint8)] * 3
    blob = codec.encode_image(flat)
    assert len(blob) < 400 and same(codec.decode_image(blob), flat)
    rng = np.random.default_rng(3)
    tile, noise = (rng.integers(0, 256, (n, n)).astype(np.uint8) for n in (24, 192))
    assert 4 * len(codec.encode_image([np.tile(tile, (8, 8))])) < len(codec.encode_image([noise]))
    smooth = picture(64, 96)
    assert len(codec.encode_image(smooth)) < 0.65 * 3 * 64 * 96


def test_extremes_wrap():
    image = [np.zeros((32, 32), np.uint8) for _ in range(3)]
    image[0][::2], image[1][:, ::3] = 255, 1
    assert same(codec.decode_image(codec.encode_image(image)), image)


def test_colour_choice():
    assert codec.header(codec.encode_image(picture(48, 64)))["colour"]
    rng = np.random.default_rng(5)
    unrelated = [rng.integers(0, 64, (64, 64)).astype(np.uint8), picture(64, 64, 1, 1)[0], np.full((64, 64), 200, np.uint8)]
    blob = codec.encode_image(unrelated)
    assert not codec.header(blob)["colour"] and same(codec.decode_image(blob), unrelated)
    assert same(codec.inverse_colour(codec.forward_colour(unrelated)), unrelated)


def test_clips():
    f = picture(40, 56, 3, 1)
    planar = [[np.roll(p, 3 * k, axis=1) for p in (f[0], f[1][::2, ::2], f[2][::2, ::2])] for k in range(3)]
    back = codec.decode_clip(codec.encode_clip(planar))
    assert len(back) == 3 and all(same(a, b) for a, b in zip(back, planar))
    colour = [[np.roll(p, k, axis=0) for p in picture(32, 32)] for k in (0, 2, 5)]
    blob = codec.encode_clip(colour, colour=True)
    assert all(same(a, b) for a, b in zip(codec.decode_clip(blob), colour)) and codec.header(blob)["frames"] == 3
    odd = [[np.roll(f[0][:39, :55], k, axis=0), np.roll(f[1][:20, :28], k, axis=0)] for k in range(2)]
    blob = codec.encode_clip(odd, block=8)
    assert codec.header(blob)["block"] == 8 and all(same(a, b) for a, b in zip(codec.decode_clip(blob), odd))
    still = codec.encode_clip([[f[0]]] * 8)
    assert len(still) < 1.2 * len(codec.encode_clip([[f[0]]]))


def test_opposite_motion_at_the_limit():
    """Vectors of neighbouring blocks that differ as much as they can."""
    rng = np.random.default_rng(9)
    ref = rng.integers(0, 256, (64, 64)).astype(np.uint8)
    cur = ref.copy()
    cur[:, :32], cur[:, 32:] = np.roll(ref, 8, axis=1)[:, :32], np.roll(ref, -8, axis=1)[:, 32:]
    clip = [[ref], [cur], [ref]]
    assert all(same(a, b) for a, b in zip(codec.decode_clip(codec.encode_clip(clip)), clip))


def test_motion_finds_a_shift():
    a = np.random.default_rng(3).integers(0, 256, (64, 64)).astype(np.uint8)
    dy, dx, _ = motion.search(np.roll(a, 4, axis=1), a)
    assert (dx[1:-1, 1:-1] == -8).mean() > 0.7 and (dy[1:-1, 1:-1] == 0).mean() > 0.7


def test_damaged_streams():
    blob = codec.encode_image(picture(20, 20))
    for bad in (b"XXXX" + bytes(32), blob[:50], blob[:30] + bytes((blob[30] ^ 1,)) + blob[31:]):
        with pytest.raises(ValueError):
            codec.decode_image(bad)
    with pytest.raises(ValueError):
        codec.encode_clip([])
    with pytest.raises(ValueError):
        codec.encode_image([np.zeros((2, 2), np.uint8)] * 5)


def test_rows_that_share_a_coder_are_never_in_flight_together():
    for h, w in ((1, 1), (5, 3), (100, 7), (7, 100)):
        n = wavefront.coders_of(h, w)
        for t in range(w + 2 * (h - 1)):
            rows = [y for y in range(h) if 0 <= t - 2 * y < w]
            assert len({y % n for y in rows}) == len(rows)


def test_parts_join():
    image = picture(90, 40)
    bands = [codec.encode_image([p[a : a + 32] for p in image]) for a in range(0, 90, 32)]
    blob = codec.join_parts(bands)
    assert same(codec.decode_image(blob), image) and codec.split_parts(blob) == bands
    head = codec.header(blob)
    assert (head["kind"], head["width"], head["height"], head["planes"], head["samples"]) == ("image", 40, 90, 3, 90 * 40 * 3)
    with pytest.raises(ValueError):
        codec.split_parts(blob[:-6] + b"xxxxxx")


@pytest.mark.parametrize("places, alone", [(1024, 20), (7, 2), (40, 0), (100, 100)])
def test_range_coder_abreast_is_the_coders(monkeypatch, places, alone):
    """Texts coded together have the streams that BitEncoder makes of each, and come back; a cut stream raises."""
    from rasterloom.operators import abreast

    monkeypatch.setattr(abreast, "PLACES", places)
    monkeypatch.setattr(abreast, "ALONE", alone)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, m, n).astype(np.uint8) for m, n in zip(rng.integers(1, 257, 60), rng.integers(0, 120, 60))]
    texts += [np.zeros(900, np.uint8), np.full(700, 255, np.uint8), np.tile([0, 255], 400).astype(np.uint8)]
    blobs = abreast.range_encode(texts)
    for text, blob in zip(texts, blobs):
        coder, bank = coders.BitEncoder(), [32768] * 256
        for v in text.tolist():
            for k in range(7, -1, -1):
                coder.bit(bank, (v | 256) >> k + 1, v >> k & 1)
        assert blob == (coder.finish() if len(text) else b"")
    assert same(abreast.range_decode(blobs, [len(t) for t in texts]), texts)
    with pytest.raises(ValueError):
        abreast.range_decode([b[: len(b) // 8] for b in blobs], [len(t) for t in texts])
    assert abreast.range_encode([]) == [] == abreast.range_decode([], [])


@pytest.mark.parametrize("together", [512, 3])
def test_rans_abreast_is_the_coders(monkeypatch, together):
    """Texts coded together have the streams that coders.rans_encode makes of each, and come back; a cut stream raises."""
    from rasterloom.operators import abreast

    monkeypatch.setattr(abreast, "TOGETHER", together)
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, m, n).astype(np.uint8) for m, n in zip(rng.integers(1, 257, 40), rng.integers(0, 700, 40))]
    texts += [np.full(4000, 255, np.uint8), np.zeros(1, np.uint8), np.arange(32, dtype=np.uint8), np.zeros(0, np.uint8)]
    freqs = [coders.normalise(np.bincount(t, minlength=256)) for t in texts]
    blobs = abreast.rans_encode(texts, freqs)
    assert blobs == [coders.rans_encode(t, f) for t, f in zip(texts, freqs)]
    assert same(abreast.rans_decode(blobs, [len(t) for t in texts], freqs), texts)
    with pytest.raises(ValueError):
        abreast.rans_decode([b[: len(b) - len(b) // 4] for b in blobs], [len(t) for t in texts], freqs)
    assert abreast.rans_encode([], []) == [] == abreast.rans_decode([], [], [])


def test_estimates_without_coding(spark):
    from rasterloom.plans import studies

    texts = spark.createDataFrame([("a", b"abracadabra" * 9), ("b", b"x"), ("c", b"")], "media_id string, data binary")
    coded = {r["media_id"]: (r["symbols"], r["rans_estimate"]) for r in studies.coder_sizes(texts).collect()}
    assert {r["media_id"]: (r["symbols"], r["rans_estimate"]) for r in studies.coder_estimates(texts).collect()} == coded and coded["c"] == (0, 0.0)
