"""Static entropy coders: frequency tables, interleaved rANS, canonical Huffman; and an adaptive binary range coder."""

from __future__ import annotations

import heapq

import numpy as np

SCALE_BITS, LANES, LOW_STATE, MOST_LENGTH = 12, 32, 1 << 16, 15
#: Bytes of Huffman codes that are decoded together.
DECODED = 1 << 17


# ---------------------------------------------------------------- bytes


def varint(n: int) -> bytes:
    """LEB128."""
    if n < 0:
        raise ValueError("varints hold no negative numbers")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def signed_varint(n: int) -> bytes:
    return varint(2 * n if n >= 0 else -2 * n - 1)


class Reader:
    """Reads from bytes; running out raises ValueError."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def raw(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the data are cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def u8(self) -> int:
        return self.raw(1)[0]

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.u8()
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
            if shift > 63:
                raise ValueError("a number is too long")

    def signed_varint(self) -> int:
        n = self.varint()
        return n >> 1 if n & 1 == 0 else -(n + 1 >> 1)


# ---------------------------------------------------------------- frequency tables


def normalise(hist: np.ndarray, scale: int = 1 << SCALE_BITS) -> np.ndarray | None:
    """Counts scaled to a sum of `scale`; every used symbol keeps 1 at least. None: no symbol.

    Rounding is half to even; what is missing goes to the first most frequent symbol, what is too much is taken from the
    largest (then smallest symbol) first.
    """
    hist = np.asarray(hist, np.int64)
    total = int(hist.sum())
    if not total:
        return None
    freq = np.where(hist > 0, np.maximum(1, np.rint(hist * scale / total)), 0).astype(np.int64)
    gap = scale - int(freq.sum())
    if gap > 0:
        freq[int(freq.argmax())] += gap
    for s in np.lexsort((np.arange(len(freq)), -freq)).tolist():
        if gap >= 0:
            break
        cut = min(int(freq[s]) - 1, -gap)
        freq[s] -= cut
        gap += cut
    return freq


def write_table(freq: np.ndarray | None) -> bytes:
    """A count of used symbols, then a gap and a frequency less one for each."""
    used = [] if freq is None else np.flatnonzero(freq).tolist()
    out, last = [varint(len(used))], -1
    for s in used:
        out += [varint(s - last - 1), varint(int(freq[s]) - 1)]
        last = s
    return b"".join(out)


def read_table(reader: Reader, size: int = 256) -> np.ndarray | None:
    n, last = reader.varint(), -1
    freq = np.zeros(size, np.int64)
    for _ in range(n):
        last += reader.varint() + 1
        if last >= size:
            raise ValueError("a symbol is out of range")
        freq[last] = reader.varint() + 1
    return freq if n else None


def estimate_bits(hist: np.ndarray, freq: np.ndarray) -> float:
    """Bits of coding hist with a table."""
    used = np.flatnonzero(hist)
    return float((hist[used] * (SCALE_BITS - np.log2(freq[used]))).sum())


# ---------------------------------------------------------------- interleaved rANS


def rans_encode(symbols: np.ndarray, freq: np.ndarray) -> bytes:
    """LANES interleaved states over 16-bit units; symbol i belongs to state i mod LANES."""
    n = len(symbols)
    if not n:
        return b""
    start = np.concatenate([[0], np.cumsum(freq)])[:-1]
    steps = -(-n // LANES)
    state = np.full(LANES, LOW_STATE, np.int64)
    units: list[np.ndarray] = []
    for k in range(steps - 1, -1, -1):
        s = symbols[k * LANES : (k + 1) * LANES].astype(np.int64)
        x, f = state[: len(s)], freq[s]
        big = x >= f << (32 - SCALE_BITS)
        units.append((x[big] & 0xFFFF)[::-1])
        x = np.where(big, x >> 16, x)
        state[: len(s)] = (x // f << SCALE_BITS) + x % f + start[s]
    body = np.concatenate(units)[::-1].astype("<u2").tobytes() if units else b""
    return state.astype("<u4").tobytes() + body


def rans_decode(data: bytes, count: int, freq: np.ndarray) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    if len(data) < 4 * LANES:
        raise ValueError("the data are cut off")
    start = np.concatenate([[0], np.cumsum(freq)])[:-1]
    slots = np.repeat(np.arange(len(freq)), freq)
    state = np.frombuffer(data[: 4 * LANES], "<u4").astype(np.int64)
    units = np.frombuffer(data[4 * LANES : len(data) & ~1], "<u2").astype(np.int64)
    out, at = np.empty(count, np.int64), 0
    for a in range(0, count, LANES):
        m = min(LANES, count - a)
        x = state[:m]
        low = x & (1 << SCALE_BITS) - 1
        s = slots[low]
        out[a : a + m] = s
        x = freq[s] * (x >> SCALE_BITS) + low - start[s]
        need = np.flatnonzero(x < LOW_STATE)
        if at + len(need) > len(units):
            raise ValueError("the data are cut off")
        x[need] = x[need] << 16 | units[at : at + len(need)]
        at += len(need)
        state[:m] = x
    return out


# ---------------------------------------------------------------- canonical Huffman


def code_lengths(hist: np.ndarray, most: int = MOST_LENGTH) -> np.ndarray:
    """Code lengths of 0 to `most` bits; a single symbol gets one bit. Too deep a tree is built again from flatter counts."""
    counts = np.asarray(hist, np.int64).copy()
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) == 1:
        lengths[used[0]] = 1
    if len(used) < 2:
        return lengths
    while True:
        parent: dict[int, int] = {}
        heap = [(int(counts[s]), s) for s in used]
        heapq.heapify(heap)
        fresh = len(counts)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = fresh
            heapq.heappush(heap, (a + b, fresh))
            fresh += 1
        depth = {fresh - 1: 0}
        for node in range(fresh - 2, -1, -1):
            if node in parent:
                depth[node] = depth[parent[node]] + 1
        if max(depth[s] for s in used) <= most:
            for s in used:
                lengths[s] = depth[s]
            return lengths
        counts = np.where(counts > 0, (counts + 1) // 2, 0)


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, then by symbol."""
    codes = np.zeros(len(lengths), np.int64)
    code = last = 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def put_codes(size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The bits (a 0 or 1 each) of codes one after another, most significant bit first."""
    at = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        bits[at[own] + k] = code[own] >> (size[own] - 1 - k) & 1
    return bits


def huffman_encode(symbols: np.ndarray) -> bytes:
    """128 bytes of lengths (two in a byte), then codes, most significant bit first. No symbols: no bytes."""
    if not len(symbols):
        return b""
    lengths = code_lengths(np.bincount(symbols, minlength=256))
    codes = codes_of(lengths)
    bits = put_codes(lengths[symbols], codes[symbols])
    return (lengths[::2] << 4 | lengths[1::2]).astype(np.uint8).tobytes() + np.packbits(bits).tobytes()


def huffman_decode(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    if len(data) < 128:
        raise ValueError("the data are cut off")
    pairs = np.frombuffer(data[:128], np.uint8)
    lengths = np.stack([pairs >> 4, pairs & 15], axis=1).ravel().astype(np.int64)
    codes = codes_of(lengths)
    table, width = np.zeros(1 << MOST_LENGTH, np.uint8), np.zeros(1 << MOST_LENGTH, np.uint8)
    for s in np.flatnonzero(lengths).tolist():
        first, span = int(codes[s]) << MOST_LENGTH - int(lengths[s]), 1 << MOST_LENGTH - int(lengths[s])
        table[first : first + span], width[first : first + span] = s, lengths[s]
    coded = np.frombuffer(data[128:], np.uint8)
    out, done, at, n = np.empty(count, np.int64), 0, 0, 8 * len(coded)  # at: the bit where the next code begins
    while done < count:
        if at >= n:
            raise ValueError("the data are cut off")
        first = at // 8
        bits = np.unpackbits(coded[first : first + DECODED + 2])  # a code reaches into two bytes more at most
        span = min(8 * DECODED, n - 8 * first)
        padded = np.concatenate([bits, np.zeros(MOST_LENGTH, np.uint8)]).astype(np.uint16)
        window = np.zeros(span, np.uint16)
        for k in range(MOST_LENGTH):
            window = window << 1 | padded[k : k + span]
        steps, near, places = width[window].tolist(), at - 8 * first, []  # the code at every bit, then the chain of those that are codes
        for _ in range(count - done):
            if near >= span:
                break
            if not steps[near]:
                raise ValueError("the data are cut off")
            places.append(near)
            near += steps[near]
        out[done : done + len(places)] = table[window[places]]
        done += len(places)
        at = 8 * first + near
    return out


# ---------------------------------------------------------------- adaptive binary range coder


class BitEncoder:
    """Codes bits by adaptive 16-bit probabilities of a 1; carries are resolved in the output bytes."""

    def __init__(self) -> None:
        self.low, self.range, self.out = 0, (1 << 32) - 1, bytearray()

    def bit(self, bank: list[int], k: int, bit: int) -> None:
        p = bank[k]
        self.at(p, bit)
        bank[k] = p + ((65535 - p) >> 5) if bit else p - (p >> 5)

    def at(self, p: int, bit: int) -> None:
        bound = (self.range >> 16) * max(32, min(65504, p))
        if bit:
            self.range = bound
        else:
            self.low += bound
            self.range -= bound
        while self.range < 1 << 24:
            if self.low >= 1 << 32:
                self.carry()
            self.out.append(self.low >> 24)
            self.low = (self.low & 0xFFFFFF) << 8
            self.range <<= 8
        if self.low >= 1 << 32:
            self.carry()

    def carry(self) -> None:
        self.low &= (1 << 32) - 1
        k = len(self.out) - 1
        while self.out[k] == 255:
            self.out[k] = 0
            k -= 1
        self.out[k] += 1

    def bypass(self, value: int, bits: int) -> None:
        for k in range(bits - 1, -1, -1):
            self.at(32768, value >> k & 1)

    def finish(self) -> bytes:
        for _ in range(4):
            self.out.append(self.low >> 24)
            self.low = (self.low & 0xFFFFFF) << 8
        return bytes(self.out)


class BitDecoder:
    def __init__(self, data: bytes):
        self.data, self.pos = data, 4
        self.low, self.range = 0, (1 << 32) - 1
        self.code = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def bit(self, bank: list[int], k: int) -> int:
        p = bank[k]
        bit = self.at(p)
        bank[k] = p + ((65535 - p) >> 5) if bit else p - (p >> 5)
        return bit

    def at(self, p: int) -> int:
        bound = (self.range >> 16) * max(32, min(65504, p))
        bit = int(self.code < bound)
        if bit:
            self.range = bound
        else:
            self.code -= bound
            self.range -= bound
        while self.range < 1 << 24:
            if self.pos > len(self.data) + 8:
                raise ValueError("the data are cut off")
            self.code = self.code << 8 | (self.data[self.pos] if self.pos < len(self.data) else 0)
            self.pos += 1
            self.range <<= 8
        return bit

    def bypass(self, bits: int) -> int:
        value = 0
        for _ in range(bits):
            value = value << 1 | self.at(32768)
        return value
