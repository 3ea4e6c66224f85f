"""Static coders and the adaptive range coder over many texts at a time: numpy steps take a byte (or a row of lanes) of each.

Streams are those of `coders`, byte for byte. Longer texts begin first; a text that ends leaves its place to the next one.
"""

from __future__ import annotations

import numpy as np

from rasterloom.operators.coders import LANES, LOW_STATE, SCALE_BITS

#: Texts that are coded together, and how few of them go on one by one.
PLACES, ALONE = 1024, 20
TOP, START = 1 << 24, 1 << 15
_BYTES = np.arange(256)
#: Of each byte, from its first bit: the node in the tree of decisions, and the bit.
_NODES = np.stack([(_BYTES | 256) >> 8 - k for k in range(8)], axis=1)
_BITS = np.stack([_BYTES >> 7 - k & 1 for k in range(8)], axis=1)
_P = np.arange(1 << 16)
#: A probability after a 0 (first half) or a 1.
_NEXT = np.concatenate([_P - (_P >> 5), _P + (65535 - _P >> 5)]).astype(np.uint16)


class _Places:
    """Which texts stand in which places; `at` is where a place's next byte lies, `end` where its text ends."""

    def __init__(self, ends: np.ndarray, sizes: np.ndarray):
        self.ends, self.sizes = ends, sizes
        self.order = np.argsort(-sizes, kind="stable")
        self.order = self.order[sizes[self.order] > 0]
        first = self.order[:PLACES]
        self.next, self.text, self.row = len(first), first, np.arange(len(first))
        self.at, self.end = ends[first] - sizes[first], ends[first]

    def turn(self) -> tuple[np.ndarray, np.ndarray | None]:
        """After a byte: the places whose texts end, and those that stay if no text is left for all of them."""
        over = np.flatnonzero(self.at == self.end)
        if not len(over):
            return over, None
        more = self.order[self.next : self.next + len(over)]
        self.next += len(more)
        if not len(more):
            return over, np.flatnonzero(self.at != self.end)
        new = over[: len(more)]
        self.text = self.text.copy()
        self.text[new], self.at[new], self.end[new] = more, self.ends[more] - self.sizes[more], self.ends[more]
        return over, None if len(more) == len(over) else np.delete(np.arange(len(self.at)), over[len(more) :])

    def keep(self, stay: np.ndarray) -> None:
        self.text, self.row, self.at, self.end = (x[stay] for x in (self.text, self.row, self.at, self.end))


def range_encode(texts: list[np.ndarray]) -> list[bytes]:
    """Each text (of bytes) as coders.BitEncoder codes it, a byte as a tree of eight decisions. No bytes: no bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.concatenate(texts) if len(texts) else np.zeros(0, np.uint8)
    places = _Places(np.cumsum(sizes), sizes)
    bank = np.full(len(places.text) * 256, START, np.uint16)
    low, span = np.zeros(len(places.text), np.int64), np.full(len(places.text), (1 << 32) - 1, np.int64)
    owners, cells = [], []  # a cell is a byte and, above it, a carry into the one before
    while len(low) > ALONE:
        v = data[places.at]
        nodes, ones = (places.row * 256)[:, None] + _NODES[v], _BITS[v]
        p = bank[nodes].astype(np.int64)
        bank[nodes] = _NEXT[p + (ones << 16)]
        p, ones = np.ascontiguousarray(np.maximum(p, 32).T), np.ascontiguousarray(ones.T)
        for k in range(8):
            bound = (span >> 16) * p[k]
            low += bound * (1 - ones[k])
            span = np.where(ones[k], bound, span - bound)
            need = np.flatnonzero(span < TOP)
            while len(need):
                out = low[need]
                owners.append(places.text[need])
                cells.append(out >> 24)
                low[need] = (out & TOP - 1) << 8
                span[need] <<= 8
                need = need[span[need] < TOP]
        places.at += 1
        text = places.text
        over, stay = places.turn()
        if len(over):
            for _ in range(4):
                owners.append(text[over])
                cells.append(low[over] >> 24)
                low[over] = (low[over] & TOP - 1) << 8
            low[over], span[over] = 0, (1 << 32) - 1
            bank.reshape(-1, 256)[places.row[over]] = START
            if stay is not None:
                low, span = low[stay], span[stay]
                places.keep(stay)
    for k in range(len(low)):
        a, own = int(places.row[k]) * 256, []
        _rest(data[places.at[k] : places.end[k]], bank[a : a + 256].tolist(), int(low[k]), int(span[k]), own)
        owners.append(np.full(len(own), places.text[k]))
        cells.append(np.array(own, np.int64))
    return _carried(owners, cells, len(texts))


def _rest(data: np.ndarray, bank: list[int], low: int, span: int, cells: list[int]) -> None:
    """What is left of one text."""
    for v in data.tolist():
        node, v = 1, v | 256
        for k in range(7, -1, -1):
            p = bank[node]
            bound = (span >> 16) * (p if p > 32 else 32)
            if v >> k & 1:
                span = bound
                bank[node] = p + (65535 - p >> 5)
            else:
                low += bound
                span -= bound
                bank[node] = p - (p >> 5)
            node = v >> k
            while span < 16777216:
                cells.append(low >> 24)
                low = (low & 16777215) << 8
                span <<= 8
    for _ in range(4):
        cells.append(low >> 24)
        low = (low & 16777215) << 8


def _carried(owners: list[np.ndarray], cells: list[np.ndarray], n: int) -> list[bytes]:
    """Cells put in order by text, carries added to the bytes before."""
    if not cells:
        return [b""] * n
    owner = np.concatenate(owners)
    order = np.argsort(owner.astype(np.uint16) if n < 1 << 16 else owner, kind="stable")
    out = np.concatenate(cells)[order].astype(np.uint16)
    while len(high := np.flatnonzero(out > 255)):
        out[high] &= 255
        out[high - 1] += 1
    blob, ends = out.astype(np.uint8).tobytes(), np.cumsum(np.bincount(owner, minlength=n)).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


def range_decode(blobs: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """Texts of counts bytes from range_encode()'s streams; a stream that ends too early raises ValueError."""
    sizes = np.array(counts, np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros(int(sizes.sum()), np.uint8)
    room = np.array([len(b) + 40 for b in blobs], np.int64)  # what a byte may read beyond the end is 0
    coded = np.frombuffer(b"".join(b + bytes(40) for b in blobs), np.uint8).astype(np.int64)
    begin, last = np.cumsum(room) - room, np.cumsum(room) - 32
    places = _Places(ends, sizes)

    def first(text: np.ndarray) -> np.ndarray:
        at = begin[text]
        return coded[at] << 24 | coded[at + 1] << 16 | coded[at + 2] << 8 | coded[at + 3]

    bank = np.full(len(places.text) * 256, START, np.uint16)
    code, span, pos = first(places.text) if len(places.text) else np.zeros(0, np.int64), np.full(len(places.text), (1 << 32) - 1, np.int64), begin[places.text] + 4
    while len(code) > ALONE:
        base = places.row * 256
        node = np.ones(len(code), np.int64)
        for _ in range(8):
            own = base + node
            p = bank[own].astype(np.int64)
            bound = (span >> 16) * np.maximum(p, 32)
            one = code < bound
            bit = one.astype(np.int64)
            bank[own] = _NEXT[p + (bit << 16)]
            code -= bound * (1 - bit)
            span = np.where(one, bound, span - bound)
            node += node + bit
            need = np.flatnonzero(span < TOP)
            while len(need):
                at = pos[need]
                code[need] = code[need] << 8 | coded[at]
                pos[need] = at + 1
                span[need] <<= 8
                need = need[span[need] < TOP]
        if (pos > last[places.text] + 1).any():
            raise ValueError("the data are cut off")
        out[places.at] = node - 256
        places.at += 1
        over, stay = places.turn()
        if len(over):
            text = places.text[over]
            code[over], span[over], pos[over] = first(text), (1 << 32) - 1, begin[text] + 4
            bank.reshape(-1, 256)[places.row[over]] = START
            if stay is not None:
                code, span, pos = code[stay], span[stay], pos[stay]
                places.keep(stay)
    for k in range(len(code)):
        a, text = int(places.row[k]) * 256, int(places.text[k])
        rest = coded[pos[k] : begin[text] + room[text]].tolist()
        n = int(places.end[k] - places.at[k])
        out[places.at[k] : places.end[k]] = _read_rest(rest, n, bank[a : a + 256].tolist(), int(code[k]), int(span[k]))
    return [out[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]


def _read_rest(coded: list[int], n: int, bank: list[int], code: int, span: int) -> np.ndarray:
    out, pos, most = bytearray(n), 0, len(coded) - 31
    for i in range(n):
        node = 1
        for _ in range(8):
            p = bank[node]
            bound = (span >> 16) * (p if p > 32 else 32)
            if code < bound:
                span = bound
                bank[node] = p + (65535 - p >> 5)
                node += node + 1
            else:
                code -= bound
                span -= bound
                bank[node] = p - (p >> 5)
                node += node
            while span < 16777216:
                code = code << 8 | coded[pos]
                pos += 1
                span <<= 8
        if pos > most:
            raise ValueError("the data are cut off")
        out[i] = node & 255
    return np.frombuffer(bytes(out), np.uint8)


# ---------------------------------------------------------------- rANS

#: Texts of near lengths whose rANS lanes go together.
TOGETHER = 512


def _groups(sizes: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    return [order[a : a + TOGETHER] for a in range(0, len(order), TOGETHER)]


def _starts(freqs: np.ndarray) -> np.ndarray:
    return np.cumsum(freqs, axis=1) - freqs


def rans_encode(texts: list[np.ndarray], freqs: list[np.ndarray | None]) -> list[bytes]:
    """Each text's stream of coders.rans_encode with its own table. No bytes: no bytes."""
    sizes, out, lane = np.array([len(t) for t in texts], np.int64), [b""] * len(texts), np.arange(LANES)
    for group in _groups(sizes):
        n, data = sizes[group], np.concatenate([texts[k] for k in group])
        begin, steps = np.cumsum(n) - n, -(-n // LANES)
        freq = np.stack([freqs[k] for k in group])
        start, freq = _starts(freq).ravel(), freq.ravel()
        state = np.full((len(group), LANES), LOW_STATE, np.int64)
        owners, units = [], []
        for k in range(int(steps[0]) - 1, -1, -1):
            c = int(np.searchsorted(-steps, -k))  # texts with a step k: steps fall
            at = k * LANES + lane
            own = at < n[:c, None]
            own_all = bool(own.all())
            s = data[begin[:c, None] + (at if own_all else np.minimum(at, n[:c, None] - 1))]
            s = (np.arange(c) * 256)[:, None] + s
            x, f = state[:c], freq[s]
            big = x >= f << (32 - SCALE_BITS)
            if not own_all:
                big &= own
            places = np.flatnonzero(big)
            owners.append(places // LANES)
            units.append(x.ravel()[places] & 0xFFFF)
            whole, rest = np.divmod(np.where(big, x >> 16, x), f)
            made = (whole << SCALE_BITS) + rest + start[s]
            state[:c] = made if own_all else np.where(own, made, x)
        owner, body = np.concatenate(owners[::-1]), np.concatenate(units[::-1])
        body = body[np.argsort(owner.astype(np.uint16), kind="stable")].astype("<u2").tobytes()
        ends = (2 * np.cumsum(np.bincount(owner, minlength=len(group)))).tolist()
        heads = state.astype("<u4")
        for k, (text, a, b) in enumerate(zip(group.tolist(), [0, *ends], ends)):
            out[text] = heads[k].tobytes() + body[a:b]
    return out


def rans_decode(blobs: list[bytes], counts: list[int], freqs: list[np.ndarray | None]) -> list[np.ndarray]:
    """Texts of counts bytes; a stream that ends too early raises ValueError."""
    sizes, out, lane = np.array(counts, np.int64), [np.zeros(0, np.uint8)] * len(counts), np.arange(LANES)
    for group in _groups(sizes):
        n = sizes[group]
        begin, steps = np.cumsum(n) - n, -(-n // LANES)
        if min(len(blobs[k]) for k in group) < 4 * LANES:
            raise ValueError("the data are cut off")
        freq = np.stack([freqs[k] for k in group])
        slots = np.concatenate([np.repeat(_BYTES, f) for f in freq]).astype(np.uint8)
        start, freq = _starts(freq).ravel(), freq.ravel()
        state = np.stack([np.frombuffer(blobs[k][: 4 * LANES], "<u4") for k in group]).astype(np.int64)
        bodies = [np.frombuffer(blobs[k][4 * LANES : len(blobs[k]) & ~1], "<u2") for k in group]
        ends = np.cumsum([len(b) for b in bodies])
        units, at = np.concatenate([*bodies, np.zeros(LANES, "<u2")]).astype(np.int64), ends - [len(b) for b in bodies]
        data = np.zeros(int(n.sum()), np.uint8)
        for k in range(int(steps[0])):
            c = int(np.searchsorted(-steps, -k))
            place = k * LANES + lane
            own = place < n[:c, None]
            x = state[:c]
            low = x & (1 << SCALE_BITS) - 1
            s = slots[(np.arange(c) << SCALE_BITS)[:, None] + low]
            data[(begin[:c, None] + place)[own]] = s[own]
            s = (np.arange(c) * 256)[:, None] + s
            x = freq[s] * (x >> SCALE_BITS) + low - start[s]
            need = (x < LOW_STATE) & own
            nth = np.cumsum(need, axis=1)
            x = np.where(need, x << 16 | units[np.minimum(at[:c, None] + nth - need, len(units) - 1)], x)
            at[:c] += nth[:, -1]
            if (at[:c] > ends[:c]).any():
                raise ValueError("the data are cut off")
            state[:c] = x
        for text, a, m in zip(group.tolist(), begin.tolist(), n.tolist()):
            out[text] = data[a : a + m]
    return out
