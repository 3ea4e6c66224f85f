"""Adaptive lossless coding of planes along a wavefront.

The samples (y, t - 2 y) of step t have all their causal neighbours (left, above, above right, two rows up) in earlier
steps, so a step takes the samples of many rows at once, in numpy, with the whole causal context. All rows share one
bank of adaptive statistics; each row's decisions go to one of a few range coders (rows that are never in flight
together share one). Encoder and decoder run the same steps; only where a decision comes from differs. Everything that
a decision depends on is integer arithmetic.

A sample is predicted by a blend of predictors weighted by their errors at the neighbours, refined by a normalized
least-mean-squares combiner, or replaced by the sample of an earlier place with the same neighbours where such guesses
were right at the neighbours, or by motion compensation. The residual is coded as a zero flag, a sign, the bit length of its magnitude in unary, two
modelled bits below the leading one, and plain bits. Each modelled decision mixes several contexts' log odds by gated
weights and refines the result by an adaptive map.

Planes of one size that belong to different streams can go side by side (`copies`): a step then takes the samples of all
of them, each with statistics and coders of its own, so streams are the same as one by one and numpy has more to do a call.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from rasterloom.functions.samples import ACTIVITY_LADDERS

KINDS = 8  # luma, two chroma, alpha; each again for motion-compensated samples
TAPS = 9
MATCH_BITS, MATCH_TRUST = 18, 8
MAP_STEPS = 33
#: A range narrower than this that lies across a border between units is cut at the border, which costs bits.
NARROW = np.uint64(1 << 20)
#: Log odds in 1/256 of 12-bit probabilities, and back.
STRETCH = np.array([round(256 * math.log((k + 0.5) / (4095.5 - k))) for k in range(4096)], np.int64)
SQUASH = np.array([min(4090, max(5, round(4096 / (1 + math.exp(-(k - 2047) / 256))))) for k in range(4096)], np.int64)
LENGTHS = np.array([0] + [int(k).bit_length() for k in range(1, 257)], np.int64)


def levels(x: np.ndarray, edges: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


ACTIVITY_EDGES = ACTIVITY_LADDERS[16]
ERROR_EDGES = (1, 3, 6, 11, 20, 40)
SIDE_EDGES = (1, 3, 8, 20)


@dataclass(frozen=True)
class Settings:
    """What a stream may set: the ladders of activity and of the neighbours' errors, and how far counts grow before they
    are halved (a power of two; the smaller, the faster statistics follow a change)."""

    activity: tuple[int, ...] = ACTIVITY_EDGES
    errors: tuple[int, ...] = ERROR_EDGES
    memory: int = 10

    def __post_init__(self) -> None:
        for edges in (self.activity, self.errors):
            if not 0 < len(edges) < 64 or any(not 0 < a < b < 1 << 10 for a, b in zip(edges, (*edges[1:], (1 << 10) - 1))):
                raise ValueError("a ladder has up to 63 rising edges")
        if not 4 <= self.memory <= 20:
            raise ValueError("counts are halved at 2**4 to 2**20")


DEFAULT = Settings()


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the order that brings equal ones together, where each begins in it, and how many there are."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], order, starts, np.diff(starts, append=len(keys))


class Decision:
    """A family of binary decisions with several contexts each: counts, mixing weights, a refining map."""

    def __init__(self, contexts: tuple[int, ...], gates: int, memory: int = DEFAULT.memory, copies: int = 1):
        self.sizes, self.gates = contexts, gates
        self.counts = [np.zeros(2 * n * copies, np.int64) for n in contexts]
        self.limit = 1 << memory
        k = len(contexts)
        self.weights = np.full((gates * copies, k), 65536 * 5 // (4 * k), np.int64)
        start = SQUASH[np.clip((np.arange(MAP_STEPS) - 16) * 128 + 2047, 0, 4095)]
        self.map = np.tile(start << 4, gates * copies)

    def probability(self, contexts: list[np.ndarray], gate: np.ndarray, own: np.ndarray) -> np.ndarray:
        """12-bit probabilities of a 1 for samples of the copies `own`; remembers what update() needs."""
        self.at, self.gate = [2 * (c + own * n) for c, n in zip(contexts, self.sizes)], gate + own * self.gates
        stretched = []
        for counts, c in zip(self.counts, self.at):
            none, some = counts[c], counts[c + 1]
            p = ((some * 4 + 2) << 12) // ((none + some) * 4 + 4)
            stretched.append(STRETCH[np.minimum(p, 4095)])
        self.inputs = np.stack(stretched, axis=1)
        dot = (self.inputs * self.weights[self.gate]).sum(axis=1) >> 16
        self.mixed = SQUASH[np.clip(dot + 2047, 0, 4095)]
        place = np.clip(dot, -2047, 2047) + 2048
        self.cell = self.gate * MAP_STEPS + np.clip((place + 64) >> 7, 0, MAP_STEPS - 1)
        return np.clip((self.mixed + (self.map[self.cell] >> 4)) >> 1, 8, 4088)

    def update(self, bit: np.ndarray) -> None:
        for counts, c in zip(self.counts, self.at):
            np.add.at(counts, c + bit, 1)
            full = c[counts[c] + counts[c + 1] > self.limit]
            if len(full):
                full = np.unique(full)
                counts[full] >>= 1
                counts[full + 1] >>= 1
        error = (bit << 12) - self.mixed
        step = (self.inputs * error[:, None] + (1 << 9)) >> 10
        # Rows that share a gate step together; the mean step keeps the size of a step apart from their number.
        touched, order, starts, share = _groups(self.gate)
        self.weights[touched] += np.add.reduceat(step[order], starts, axis=0) * 4 // (3 + share)[:, None]
        hit, order, starts, n = _groups(self.cell)
        total = 65535 * np.add.reduceat(bit[order], starts)
        self.map[hit] += (total // n - self.map[hit]) * np.minimum(n, 16) >> 6


class Bank:
    """All adaptive state; lives for an image, or for a whole clip. copies: streams side by side, with a state each."""

    def __init__(self, settings: Settings = DEFAULT, copies: int = 1) -> None:
        self.settings, self.copies = settings, copies
        a, e, s = len(settings.activity) + 1, len(settings.errors) + 1, len(SIDE_EDGES) + 1
        family = lambda contexts, gates: Decision(contexts, gates, settings.memory, copies)
        self.zero = family((KINDS * a * e, KINDS * 9 * a, KINDS * e * s * s, KINDS * 8 * e), KINDS * a)
        self.sign = family((KINDS * 9 * 3, KINDS * a), KINDS)
        self.length = family((KINDS * a * e * 8, KINDS * s * s * 8 * 8, KINDS * 8 * 9), KINDS * 8)
        self.below = family((KINDS * 8 * 4, KINDS * 8 * 4 * a), KINDS)
        self.lms_contexts = 4 * (a + 1 >> 1)
        self.lms = np.zeros((copies * (KINDS // 2) * self.lms_contexts, TAPS), np.int64)
        self.statistics = {k: np.zeros(copies, np.int64) for k in ("samples", "nonzero", "plain_bits", "length_bits")}


class RowCoders:
    """Carry-less range coders of 48 bits side by side, with 16-bit units; they live for a whole stream.

    Row y of a plane uses coder y mod n. n: from coders_of() of the largest plane; streams side by side have n each.
    """

    MASK = np.uint64((1 << 48) - 1)

    def __init__(self, n: int, data: list[bytes] | None = None):
        self.n = n
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 48) - 1, np.uint64)
        self.decode = data is not None
        if data is None:
            self.out, self.put = np.zeros((n, 0), np.uint16), np.zeros(n, np.int64)
        else:
            units = [np.frombuffer(d[: len(d) & ~1], "<u2") for d in data]
            self.input = np.zeros((n, max(map(len, units), default=0) + 8), np.uint64)
            for k, u in enumerate(units):
                self.input[k, : len(u)] = u
            self.get, self.code = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            for _ in range(3):
                self.code = self.code << np.uint64(16) | self.input[np.arange(n), self.get]
                self.get += 1

    def reserve(self, units: int) -> None:
        """Room for so many more units in each coder."""
        if not self.decode:
            missing = int(self.put.max()) + units - self.out.shape[1]
            if missing > 0:
                self.out = np.pad(self.out, ((0, 0), (0, missing)))

    def bits(self, who: np.ndarray, p: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """One decision of each coder in `who` (12-bit probabilities of a 1)."""
        low, rng = self.low[who], self.range[who]
        bound = (rng >> np.uint64(12)) * p.astype(np.uint64)
        if self.decode:
            bit = (((self.code[who] - low) & self.MASK) < bound).astype(np.int64)
        one = bit == 1
        low = np.where(one, low, low + bound)
        rng = np.where(one, bound, rng - bound)
        over = low + rng > self.MASK  # a range never reaches past 48 bits
        rng = np.where(over, self.MASK - low, rng)
        while True:
            settled = (low ^ (low + rng)) >> np.uint64(32) == 0
            small = ~settled & (rng < NARROW)  # rarely: a range that narrow seldom lies across a border
            go = settled | small
            if not go.any():
                break
            border = np.uint64(1 << 32) - (low & np.uint64((1 << 32) - 1))
            cut = np.where(small, np.minimum(rng, np.maximum(border, np.uint64(2)) - np.uint64(1)), rng)
            k = who[go]
            if self.decode:
                at = np.minimum(self.get[k], self.input.shape[1] - 1)  # past the end come zeros, as left out by finish()
                self.code[k] = (self.code[k] << np.uint64(16) | self.input[k, at]) & self.MASK
                self.get[k] += 1
            else:
                self.out[k, self.put[k]] = (low[go] >> np.uint64(32)).astype(np.uint16)
                self.put[k] += 1
            low = np.where(go, (low << np.uint64(16)) & self.MASK, low)
            rng = np.where(go, cut << np.uint64(16), rng)
        self.low[who], self.range[who] = low, rng
        return bit

    def finish(self) -> list[bytes]:
        """Each coder's units: the fewest that name a value in its last range; zeros at the end are left out."""
        streams = []
        for row, p, low, size in zip(self.out, self.put.tolist(), self.low.tolist(), self.range.tolist()):
            for bits in (48, 32, 16, 0):
                value = -(-low >> bits) << bits
                if value < low + size:
                    break
            units = [*row[:p].tolist(), value >> 32 & 0xFFFF, value >> 16 & 0xFFFF, value & 0xFFFF]
            while units and not units[-1]:
                units.pop()
            streams.append(np.array(units, "<u2").tobytes())
        return streams


class CostCoders:
    """Stands in for RowCoders where only sizes are asked for: adds up what decisions cost, -log2 of their probability."""

    def __init__(self, n: int, copies: int = 1):
        self.n, self.totals = n * copies, np.zeros(copies)

    def reserve(self, units: int) -> None:
        pass

    def bits(self, who: np.ndarray, p: np.ndarray, bit: np.ndarray) -> np.ndarray:
        cost = -np.log2(np.where(bit == 1, p, 4096 - p) / 4096)
        self.totals += np.bincount(who // (self.n // len(self.totals)), weights=cost, minlength=len(self.totals))
        return bit


def coders_of(height: int, width: int) -> int:
    """Rows y and y + this many are never in flight together."""
    return max(1, min(height, width // 2 + 2))


def code_plane(bank: Bank, kind: int, height: int, width: int, source: np.ndarray | None, who: RowCoders, side: np.ndarray | None = None, moved: np.ndarray | None = None, temporal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """code_planes() of one stream."""
    stacks = [None if x is None else x[None] for x in (source, side, moved, temporal)]
    planes, sizes = code_planes(bank, kind, height, width, stacks[0], who, *stacks[1:])
    return planes[0], sizes[0]


def code_planes(bank: Bank, kind: int, height: int, width: int, source: np.ndarray | None, who: RowCoders | CostCoders, side: np.ndarray | None = None, moved: np.ndarray | None = None, temporal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes a plane of each stream side by side, or decodes them if there is no source: samples and maps of residual sizes.

    All arrays are stacks (stream, row, column). side: an earlier plane's residual sizes at the same place, as context.
    moved: the motion-compensated plane, used where `temporal` is set.
    """
    encode = source is not None
    pad, copies = 2, bank.copies
    stride, tall = width + 2 * pad, height + pad
    rows, sizes, signs, runs = (np.zeros(copies * tall * stride, np.int64) for _ in range(4))
    misses = np.zeros((4, copies * tall * stride), np.int64)
    matches = np.full(copies << MATCH_BITS, -1, np.int16)
    coders = who.n // copies
    who.reserve(16 + 2 * width * (-(-height // coders)))
    if side is not None and side.shape[1:] != (height, width):
        high, wide = side.shape[1:]
        side = side[:, np.minimum(np.arange(height) * high // max(height, 1), high - 1)][:, :, np.minimum(np.arange(width) * wide // max(width, 1), wide - 1)]
    for t in range(width + 2 * (height - 1)):
        y = np.arange(max(0, (t - width + 2) // 2), min(height - 1, t // 2) + 1)
        x = t - 2 * y
        inside = (x >= 0) & (x < width)
        y, x = y[inside], x[inside]
        if not len(y):
            continue
        own = np.repeat(np.arange(copies), len(y))
        y, x = np.tile(y, copies), np.tile(x, copies)
        here = (own * tall + y + pad) * stride + x + pad
        lane = own * coders + y % coders
        at = lambda a, dy, dx: a[here - (dy * stride + dx)]  # noqa: E731, B023
        top, left, last = y == 0, x == 0, x == width - 1
        w = np.where(left, np.where(top, 128, at(rows, 1, 0)), at(rows, 0, 1))
        n = np.where(top, w, at(rows, 1, 0))
        nw = np.where(top | left, np.where(top, w, n), at(rows, 1, 1))
        ne = np.where(top | last, n, at(rows, 1, -1))
        ww = np.where(x < 2, w, at(rows, 0, 2))
        nn = np.where(y < 2, n, at(rows, 2, 0))
        nne = np.where((y < 2) | last, nn, at(rows, 2, -1))
        # the blend
        lo, hi = np.minimum(n, w), np.maximum(n, w)
        p_med = np.where(nw >= hi, lo, np.where(nw <= lo, hi, n + w - nw))
        flat, steep = abs(w - ww) + abs(n - nw) + abs(n - ne), abs(w - nw) + abs(n - nn) + abs(ne - nne)
        mean = (w + n >> 1) + (ne - nw >> 2)
        tilt = steep - flat
        p_gap = np.select([tilt > 80, tilt < -80, tilt > 32, tilt < -32, tilt > 8, tilt < -8], [w, n, mean + w >> 1, mean + n >> 1, 3 * mean + w >> 2, 3 * mean + n >> 2], mean)
        choices = np.stack([p_med, p_gap, 2 * w - ww, n + ne - nne])
        past = misses[:, here - stride] + misses[:, here - 1] + misses[:, here - stride + 1] + misses[:, here - stride - 1]
        weight = (1 << 14) // (past * past // 4 + 3) + 1
        blend = (choices * weight).sum(axis=0) // weight.sum(axis=0)
        base = np.clip(blend, lo - 16, hi + 16)
        # the least-mean-squares combiner, around the blend
        activity = abs(w - nw) + abs(nw - n) + abs(n - ne)
        a = levels(activity, bank.settings.activity)
        context = (own * (KINDS // 2) + kind % (KINDS // 2)) * bank.lms_contexts + (a >> 1) * 4 + 2 * (w > nw) + (n > nw)
        zero = np.zeros_like(base)
        taps = np.stack([w - base, n - base, nw - base, ne - base, ww - base, nn - base, nne - base, np.where(left, zero, at(signs, 0, 1)), np.where(top, zero, at(signs, 1, 0))], axis=1)
        learned = base + ((taps * bank.lms[context]).sum(axis=1) + 32768 >> 16)
        pred = np.clip(learned, 0, 255)
        own_pred = pred
        # an earlier place with the same neighbours
        place = (w * 0x9E3779B1 + n * 0x85EBCA77 + nw * 0xC2B2AE3D + ne * 0x27D4EB2F + ww * 0x165667B1 + nn * 0x2545F491 >> 13) & (1 << MATCH_BITS) - 1
        place = place + (own << MATCH_BITS)
        guess = matches[place].astype(np.int64)
        sure = np.where(guess < 0, 0, np.minimum(at(runs, 0, 1) + at(runs, 1, 0), 15))  # how often such guesses were right just before
        pred = np.where(sure >= MATCH_TRUST, guess, pred)
        kinds = np.full(len(y), kind)
        if moved is not None:
            inter = temporal[own, y, x]
            pred = np.where(inter, moved[own, y, x], pred)
            kinds = kinds + np.where(inter, KINDS // 2, 0)
        # contexts
        ew, en, ene, enw = at(sizes, 0, 1), at(sizes, 1, 0), at(sizes, 1, -1), at(sizes, 1, 1)
        e = levels(ew + en + (ene + enw >> 1), bank.settings.errors)
        sl = levels(side[own, y, x], SIDE_EDGES) if side is not None else np.zeros(len(y), np.int64)
        el = levels(ew, SIDE_EDGES)
        pattern = 3 * (np.sign(w - nw) + 1) + np.sign(n - nw) + 1
        m = np.minimum(sure, 7)
        na, ne_, ns = len(bank.settings.activity) + 1, len(bank.settings.errors) + 1, len(SIDE_EDGES) + 1
        if encode:
            value = source[own, y, x].astype(np.int64)
            d = (value - pred + 128 & 255) - 128
            size = abs(d)
        else:
            d = size = np.zeros(len(y), np.int64)

        def decide(family: Decision, contexts: list[np.ndarray], gate: np.ndarray, which: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
            bit = who.bits(lane[which], family.probability(contexts, gate, own[which]), bit)  # noqa: B023
            family.update(bit)
            return bit

        some = decide(bank.zero, [(kinds * na + a) * ne_ + e, (kinds * 9 + pattern) * na + a, ((kinds * ne_ + e) * ns + sl) * ns + el, (kinds * 8 + m) * ne_ + e], kinds * na + a, np.arange(len(y)), (size > 0).astype(np.int64) if encode else None)
        k = np.flatnonzero(some)
        if len(k):
            sw, sn = np.where(left, 0, at(signs, 0, 1))[k], np.where(top, 0, at(signs, 1, 0))[k]
            lean = np.where(sure[k] > 0, np.sign(guess[k] - pred[k]) + 1, 1)
            negative = decide(bank.sign, [(kinds[k] * 9 + 3 * (np.sign(sw) + 1) + np.sign(sn) + 1) * 3 + lean, kinds[k] * na + a[k]], kinds[k], k, (d[k] < 0).astype(np.int64) if encode else None)
            less = size[k] - 1 if encode else None  # 0 to 127
            length = np.zeros(len(k), np.int64)
            target = LENGTHS[less] if encode else None
            live = np.arange(len(k))
            for step in range(7):
                if not len(live):
                    break
                i = k[live]
                kk = kinds[i]
                more = decide(bank.length, [((kk * na + a[i]) * ne_ + e[i]) * 8 + step, (((kk * ns + sl[i]) * ns + el[i]) * 8 + m[i]) * 8 + step, (kk * 8 + step) * 9 + pattern[i]], kk * 8 + step, i, (target[live] > step).astype(np.int64) if encode else None)
                live = live[more == 1]
                length[live] += 1
            got = np.where(length > 0, 1, 0)
            for depth in range(6):
                live = np.flatnonzero(length - 2 - depth >= 0)
                if not len(live):
                    break
                shift = length[live] - 2 - depth
                i = k[live]
                bit = (less[live] >> shift & 1) if encode else None
                if depth < 2:
                    node = (1 if depth == 0 else 2 + (got[live] & 1)) * np.ones(len(live), np.int64)
                    ctx = (kinds[i] * 8 + length[live]) * 4 + node
                    bit = decide(bank.below, [ctx, ctx * na + a[i]], kinds[i], i, bit)
                else:
                    bit = who.bits(lane[i], np.full(len(live), 2048), bit)
                    bank.statistics["plain_bits"] += np.bincount(own[i], minlength=copies)
                got[live] = got[live] << 1 | bit
            magnitude = np.where(length > 0, got, 0) + 1
            d = np.zeros(len(y), np.int64)
            d[k] = np.where(negative == 1, -magnitude, magnitude)
            bank.statistics["nonzero"] += np.bincount(own[k], minlength=copies)
            bank.statistics["length_bits"] += np.bincount(own[k], weights=length, minlength=copies).astype(np.int64)
        else:
            d = np.zeros(len(y), np.int64)
        bank.statistics["samples"] += len(y) // copies
        value = pred + d & 255
        rows[here], sizes[here], signs[here] = value, abs(d), np.clip(d, -16, 16)
        misses[:, here] = abs(choices - value)
        # learning
        error = np.clip(value - own_pred, -64, 64)
        power = (taps * taps).sum(axis=1) + 64
        step = taps * ((error << 13) // power)[:, None]
        touched, order, starts, share = _groups(context)
        bank.lms[touched] = np.clip(bank.lms[touched] + np.add.reduceat(step[order], starts, axis=0) // (share + 7)[:, None], -(1 << 19), 1 << 19)
        runs[here] = np.where(guess == value, np.minimum(at(runs, 0, 1) + 1, 15), 0)
        matches[place] = value
    inner = lambda a: a.reshape(copies, tall, stride)[:, pad:, pad : pad + width]
    return inner(rows).astype(np.uint8), inner(sizes)
