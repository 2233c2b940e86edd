"""Lossless WebP as a media column: a decoder for the whole bitstream, and an encoder for 8-bit samples.

The decoder follows the public WebP lossless bitstream specification: prefix codes (simple and normal), meta prefix
images, back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Pixels
are arrays of shape (height, width, 4) in the order red, green, blue, alpha.

Where a picture has one group of codes of which only green carries bits, and no colour cache, as grey pictures do, runs of
literals are decoded by arrays, between back-references too: the code length at every bit of a segment gives jumps of 1, 2, 4 and 8 symbols, and only
the jumps of 8 are walked one by one. All else takes the plain loop.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
N_LITERALS, N_LENGTHS, N_DISTANCES = 256, 24, 40
#: Fixed values of the format: (x, y) of the 120 short distances.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
SEGMENT = 1 << 16


class BitReader:
    """Bits of a byte string, lowest bit first; beyond the end there are zeros."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


#: Numbers of 15 bits with their bits in reverse order.
REVERSED = (np.arange(1 << 15)[:, None] >> np.arange(15) & 1) @ (1 << np.arange(14, -1, -1))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol from the lengths, with its bits in the order of the stream."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    # left-aligned, each code begins where the one before it ends
    share = 1 << (15 - lengths[used])
    codes[used] = REVERSED[(np.cumsum(share) - share) & 0x7FFF]
    return codes


class PrefixCode:
    """A lookup table over the longest code: symbol and length for each value of the next bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.bits = 0 if len(used) == 1 else int(lengths.max())
        self.only = int(used[0])
        order = used[np.argsort(lengths[used], kind="stable")] if self.bits else used
        share = 1 << (self.bits - lengths[order] * bool(self.bits))
        if int(share.sum()) != 1 << self.bits:
            raise ValueError("an incomplete or oversubscribed prefix code")
        flipped = REVERSED[: 1 << self.bits] >> (15 - self.bits)
        self.symbols = np.repeat(order, share)[flipped]
        self.lengths = np.repeat(lengths[order] * bool(self.bits), share)[flipped].astype(np.uint8)
        self.reads, self.table, self.segment = 0, None, None
        if self.bits <= 7:
            self._list()

    def _list(self) -> None:
        self.table = list(zip(self.symbols.tolist(), self.lengths.tolist(), strict=True))

    def read(self, bits: BitReader) -> int:
        ahead = bits.peek(self.bits)
        if self.table is None:
            self.reads += 1
            if self.reads > 64:  # plain lists are faster to read, but not worth making for a few symbols
                self._list()
            bits.at += int(self.lengths[ahead])
            return int(self.symbols[ahead])
        symbol, n = self.table[ahead]
        bits.at += n
        return symbol


def read_code(bits: BitReader, size: int) -> PrefixCode:
    """A prefix code for an alphabet of ``size`` symbols."""
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        lengths[symbols] = 1
        return PrefixCode(lengths)
    own = np.zeros(19, np.int64)
    for symbol in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[symbol] = bits.read(3)
    code = PrefixCode(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, previous = 0, 8
    while at < size and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            previous = symbol or previous
            at += 1
        else:
            value, n = {16: (previous, lambda: 3 + bits.read(2)), 17: (0, lambda: 3 + bits.read(3)), 18: (0, lambda: 11 + bits.read(7))}[symbol]
            n = n()
            if at + n > size:
                raise ValueError("code lengths run over the alphabet")
            lengths[at : at + n] = value
            at += n
    return PrefixCode(lengths)


def _extra(bits: BitReader, prefix: int) -> int:
    """The number that a length or distance prefix and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(x + y * width, 1)


def _segment(bits: BitReader, code: PrefixCode, step: np.ndarray) -> tuple:
    """The next SEGMENT bytes as jumps: their first byte, their bits, and for each bit the bits ahead and the jumps of 1, 2, 4 and 8 literals."""
    first, mask = bits.at >> 3, np.uint32((1 << code.bits) - 1)
    data = bits.data[first : first + SEGMENT + 32]
    if len(data) < SEGMENT + 32:  # the end of the stream, which zeros follow
        data += bytes(64)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    ahead = raw[:-2].copy()
    ahead |= raw[1:-1] << 8
    ahead |= raw[2:] << 16
    window = np.empty((len(ahead), 8), np.uint16)
    for k in range(8):
        window[:, k] = (ahead >> np.uint32(k)) & mask
    window = window.ravel()
    n = len(window)
    # beyond the segment no symbol has a length, so jumps end there
    one = np.zeros(n + 128, np.uint8)
    one[:n] = step[window]
    place = np.arange(n, dtype=np.int32)
    two, four, eight = one.copy(), one.copy(), one.copy()
    two[:n] += one[place + one[:n]]
    four[:n] = two[:n] + two[place + two[:n]]
    eight[:n] = four[:n] + four[place + four[:n]]
    return first, n, window, one, two, four, eight.tobytes()


def _literal_run(bits: BitReader, code: PrefixCode, most: int) -> np.ndarray:
    """The literals of a one-code picture from here to the next other symbol, ``most`` at most."""
    if not code.bits:
        return np.full(most if code.only < N_LITERALS else 0, code.only, np.int64)
    literal = code.symbols < N_LITERALS
    out, got = [], 0
    while got < most:
        if code.segment is None or not code.segment[0] * 8 <= bits.at < code.segment[0] * 8 + code.segment[1] - 256:
            code.segment = _segment(bits, code, np.where(literal, code.lengths, 0).astype(np.uint8))
        first, n, window, one, two, four, jump = code.segment
        at, walk = bits.at - first * 8, []
        until = n - 1
        while at < until and len(walk) * 8 < most - got:
            walk.append(at)
            ahead_by = jump[at]
            if not ahead_by:
                break
            at += ahead_by
        p8 = np.array(walk, np.int32)
        p4 = np.stack([p8, p8 + four[p8]], 1).ravel()
        p2 = np.stack([p4, p4 + two[p4]], 1).ravel()
        p1 = np.stack([p2, p2 + one[p2]], 1).ravel()
        stop = np.flatnonzero((p1 >= n - 128) | (one[p1] == 0))
        size = min(int(stop[0]) if len(stop) else len(p1), most - got)
        p1 = p1[:size]
        out.append(code.symbols[window[p1]])
        got += size
        if not size:
            break
        bits.at = first * 8 + int(p1[-1]) + int(one[p1[-1]])
        if not literal[bits.peek(code.bits)]:
            break
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _read_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded picture: pixels as 0xAARRGGBB, in one array. Only the main picture can have a meta prefix image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    group_bits, groups = 0, None
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = -(-width >> group_bits)
        groups = ((_read_pixels(bits, across, -(-height >> group_bits), False) >> 8) & 0xFFFF).tolist()
    sizes = (N_LITERALS + N_LENGTHS + len(cache), 256, 256, 256, N_DISTANCES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(max(groups) + 1 if groups else 1)]
    n = width * height
    fast = groups is None and not cache and not any(c.bits for c in codes[0][1:4])
    pixels: list[int] = []
    out = np.empty(n, np.uint32) if fast else None
    rest = codes[0][3].only << 24 | codes[0][1].only << 16 | codes[0][2].only
    done = 0
    while done < n:
        if fast:
            run = _literal_run(bits, codes[0][0], n - done)
            out[done : done + len(run)] = run.astype(np.uint32) << 8 | np.uint32(rest)
            done += len(run)
            if done == n:
                break
        if bits.at > 8 * len(bits.data) + 64:
            raise ValueError("the bitstream ends early")
        green, red, blue, alpha, far = codes[groups[(done // width >> group_bits) * across + (done % width >> group_bits)] if groups else 0]
        symbol = green.read(bits)
        if symbol < N_LITERALS:
            r = red.read(bits)
            b = blue.read(bits)
            new = [alpha.read(bits) << 24 | r << 16 | symbol << 8 | b]
        elif symbol < N_LITERALS + N_LENGTHS:
            length = _extra(bits, symbol - N_LITERALS)
            back = _distance(_extra(bits, far.read(bits)), width)
            if back > done or done + length > n:
                raise ValueError("a back-reference outside the picture")
            source = out[done - back : done].tolist() if fast and back < length else out[done - back : done - back + length].tolist() if fast else pixels[done - back : done - back + length]
            new = (source * (-(-length // len(source))))[:length]
        else:
            new = [cache[symbol - N_LITERALS - N_LENGTHS]]
        if fast:
            out[done : done + len(new)] = new
        else:
            pixels += new
            if cache:
                for p in new:
                    cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        done += len(new)
    return out if fast else np.array(pixels, np.uint32)


def _bytes_of(pixels: np.ndarray) -> np.ndarray:
    """Pixels as blue, green, red, alpha bytes."""
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _average(a, b):
    return (a + b) >> 1


def predict(mode: int, left, top, top_left, top_right):
    """The prediction of a pixel from its neighbours; each is an integer array of four channels."""
    if mode == 0:
        return np.array([0, 0, 0, 255])
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        half = _average(left, top)
        # the format halves towards zero
        return np.clip(half + np.trunc((half - top_left) / 2).astype(np.int64), 0, 255)
    return np.array([0, 0, 0, 255])


def neighbours(pixels: np.ndarray, x: int, y: int):
    """Left, top, top left and top right of a pixel that isn't on the upper or left edge. Beyond the right edge the first
    pixel of the pixel's own row counts as top right."""
    width = pixels.shape[1]
    return pixels[y, x - 1], pixels[y - 1, x], pixels[y - 1, x - 1], pixels[y - 1, x + 1] if x + 1 < width else pixels[y, 0]


def mode_at(modes: np.ndarray, size_bits: int, x: int, y: int) -> int:
    """Predictor of a pixel: fixed on the upper and left edge, else by its block."""
    if y == 0:
        return 0 if x == 0 else 1
    return 2 if x == 0 else int(modes[y >> size_bits, x >> size_bits])


def _add_prediction(residual: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width, _ = residual.shape
    out = residual.astype(np.int64)
    out[0, 0] = (out[0, 0] + [0, 0, 0, 255]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        for x in range(1, width):
            out[y, x] = (out[y, x] + predict(int(modes[y >> size_bits, x >> size_bits]), *neighbours(out, x, y))) & 255
    return out.astype(np.uint8)


def _cross(elements: np.ndarray, size_bits: int, height: int, width: int, name: int) -> np.ndarray:
    """One multiplier of each pixel's block, as a signed number."""
    grid = elements[..., name].astype(np.int8).astype(np.int64)
    return np.repeat(np.repeat(grid, 1 << size_bits, 0), 1 << size_bits, 1)[:height, :width]


def _add_colour(pixels: np.ndarray, elements: np.ndarray, size_bits: int) -> np.ndarray:
    height, width, _ = pixels.shape
    part = lambda name: _cross(elements, size_bits, height, width, name)
    signed = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(np.int64)
    out = pixels.astype(np.int64)
    green = signed(out[..., 1])
    out[..., 2] += part(0) * green >> 5
    out[..., 0] += (part(1) * green >> 5) + (part(2) * signed(out[..., 2]) >> 5)
    return (out & 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file, (height, width, 4) red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless picture in the file")
        size = struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + size + (size & 1)
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = BitReader(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no signature of a lossless bitstream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    steps, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            across, down = -(-coded >> size_bits), -(-height >> size_bits)
            steps.append((kind, size_bits, _bytes_of(_read_pixels(bits, across, down, False)).reshape(down, across, 4), coded))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = np.cumsum(_bytes_of(_read_pixels(bits, n, 1, False)).astype(np.int64), axis=0).astype(np.uint8)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, packed, colours, coded))
            coded = -(-coded >> packed)
        else:
            steps.append((kind, 0, None, coded))
    pixels = _bytes_of(_read_pixels(bits, coded, height, True)).reshape(height, coded, 4)
    for kind, k, extra, wide in reversed(steps):
        if kind == PREDICTOR:
            pixels = _add_prediction(pixels, extra[..., 1] & 15, k)
        elif kind == CROSS_COLOUR:
            pixels = _add_colour(pixels, extra, k)
        elif kind == SUBTRACT_GREEN:
            pixels = pixels.copy()
            pixels[..., 0] += pixels[..., 1]
            pixels[..., 2] += pixels[..., 1]
        else:
            each = 8 >> k
            index = (pixels[..., 1][..., None] >> (np.arange(1 << k) * each)) & ((1 << each) - 1)
            index = index.reshape(height, -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)
            table[: len(extra)] = extra
            pixels = table[index]
    return np.ascontiguousarray(pixels[..., [2, 1, 0, 3]])


class BitWriter:
    """Bits, lowest first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= int(value) << self.n
        self.n += int(n)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for the counts, none above ``most``; a single symbol gets length 1."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weight = counts[used].tolist()
    while True:
        heap = [(w, k, k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, n = {}, len(weight)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[2]] = parent[b[2]] = n
            heapq.heappush(heap, (a[0] + b[0], n, n))
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(weight)]) <= most:
            lengths[used] = depth[: len(weight)]
            return lengths
        weight = [(w >> 1) + 1 for w in weight]


def write_code(bits: BitWriter, lengths: np.ndarray) -> None:
    """A prefix code: one or two symbols below 256 in the simple form, else its lengths."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        bits.write(1, 1)
        bits.write(len(used) - 1, 1)
        bits.write(1, 1)
        for symbol in used:
            bits.write(symbol, 8)
        return
    items, at = [], 0
    for symbol in [*used, len(lengths)]:
        gap = symbol - at
        while gap >= 11:
            items.append((18, min(gap, 138) - 11, 7))
            gap -= min(gap, 138)
        items += [(17, gap - 3, 3)] if gap >= 3 else [(0, 0, 0)] * gap
        if symbol < len(lengths):
            items.append((int(lengths[symbol]), 0, 0))
        at = symbol + 1
    own = code_lengths(np.bincount([i[0] for i in items], minlength=19), 7)
    codes = canonical(own)
    n = max(4, max(p for p, s in enumerate(CODE_LENGTH_ORDER) if own[s]) + 1)
    bits.write(0, 1)
    bits.write(n - 4, 4)
    for symbol in CODE_LENGTH_ORDER[:n]:
        bits.write(int(own[symbol]), 3)
    bits.write(0, 1)
    single = np.count_nonzero(own) == 1
    for symbol, value, extra in items:
        if not single:
            bits.write(int(codes[symbol]), int(own[symbol]))
        bits.write(value, extra)


def length_prefix(value: int) -> tuple[int, int, int]:
    """Prefix, extra bits' value and number for a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    n = value.bit_length() - 2
    prefix = 2 * n + 2 + (value >> n & 1)
    return prefix, value - ((2 + (prefix & 1)) << n), n


def container(stream: bytes) -> bytes:
    """A file around a lossless bitstream."""
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def header(bits: BitWriter, width: int, height: int) -> None:
    bits.write(0x2F, 8)
    bits.write(width - 1, 14)
    bits.write(height - 1, 14)
    bits.write(0, 4)


#: Least length of a back-reference to an earlier place, the longest of the format, and the farthest distance that a code can tell.
LEAST_COPY, MOST_COPY, FARTHEST = 32, 4096, (1 << 20) - 120
#: Codes of the short distances in a row of the encoder's width that it uses: the pixel before and the one above.
BEFORE, ABOVE = 2, 1


def find_copies(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches that repeat earlier ones, ascending and apart.

    Each aligned block of LEAST_COPY values is looked up by a rolling hash at all later places, so every repeat of twice
    that length is found; hits are compared value by value and taken as far as they go. A run of one value at the end is
    a copy of the value before.
    """
    n = len(values)
    differs = np.flatnonzero(values[max(0, n - MOST_COPY) :] != values[-1])
    tail = min(n - max(0, n - MOST_COPY) - (int(differs[-1]) + 1 if len(differs) else 0) - 1, n - 1, MOST_COPY - 1)
    tail = tail if tail >= 8 else 0
    n -= tail
    found = []
    if n >= 2 * LEAST_COPY:
        hashed, span, factor = values[:n].astype(np.uint64), 1, 0x9E3779B97F4A7C15
        while span < LEAST_COPY:
            hashed = hashed[:-span] * np.uint64(factor) + hashed[span:]
            span, factor = 2 * span, factor * factor & 0xFFFFFFFFFFFFFFFF
        blocks, first = np.unique(hashed[::LEAST_COPY], return_index=True)
        # most places are told off by the low bits
        low = np.uint64((1 << (16 * len(blocks)).bit_length()) - 1)
        flags = np.zeros(int(low) + 1, bool)
        flags[blocks & low] = True
        places = np.flatnonzero(flags[hashed & low])
        near = np.minimum(np.searchsorted(blocks, hashed[places]), len(blocks) - 1)
        sources = first[near] * LEAST_COPY
        real = (blocks[near] == hashed[places]) & (sources < places)
        places, sources = places[real], sources[real]
        done, k = 0, 0
        while k < len(places):
            start = int(places[k])
            back = start - int(sources[k])
            k += 1
            early = min(start - done, start - back, LEAST_COPY - 1)
            differs = np.flatnonzero(values[start - early : start] != values[start - early - back : start - back])
            start -= early - (int(differs[-1]) + 1 if len(differs) else 0)
            most = min(n - start, MOST_COPY)
            differs = np.flatnonzero(values[start : start + most] != values[start - back : start - back + most])
            length = int(differs[0]) if len(differs) else most
            if length >= LEAST_COPY and back <= FARTHEST:
                found.append((start, length, back))
                done = start + length
                k = int(np.searchsorted(places, done))
    return [*found, (n, tail, 1)] if tail else found


def encode_grey(samples: np.ndarray) -> bytes:
    """A grey picture of 8-bit samples (height, width) as a lossless WebP file.

    The subtract-green transform leaves red and blue at 0, so only green carries bits: one prefix code of literals and
    lengths, and one of distances, for the back-references of ``find_copies``.
    """
    height, width = samples.shape
    values = samples.ravel()
    told, kept = [], np.ones(len(values), bool)
    for start, length, back in find_copies(values):
        kept[start : start + length] = False
        told.append((start, length, length_prefix(length), length_prefix(BEFORE if back == 1 else ABOVE if back == width else back + len(NEAR))))
    counts = np.bincount(values[kept], minlength=N_LITERALS + N_LENGTHS)
    far_counts = np.zeros(N_DISTANCES, np.int64)
    for *_, (prefix, _, _), (far, _, _) in told:
        counts[N_LITERALS + prefix] += 1
        far_counts[far] += 1
    if not told:
        far_counts[1] = 1
    lengths, far_lengths = code_lengths(counts, 15), code_lengths(far_counts, 15)
    bits = BitWriter()
    header(bits, width, height)
    bits.write(1, 1)
    bits.write(SUBTRACT_GREEN, 2)
    bits.write(0, 3)  # no more transforms, no colour cache, no meta prefix image
    write_code(bits, lengths)
    for symbol in (0, 0, 255):
        bits.write(5 | symbol << 3, 11)  # the simple form of one symbol of eight bits
    write_code(bits, far_lengths)
    codes, far_codes = canonical(lengths), canonical(far_lengths)
    # a code of one symbol takes no bits
    lengths, far_lengths = lengths * (np.count_nonzero(lengths) > 1), far_lengths * (np.count_nonzero(far_lengths) > 1)
    shown, sizes, at = [], [], 0
    for start, length, (prefix, extra, n_extra), (far, far_extra, n_far) in told:
        symbol = N_LITERALS + prefix
        shown += [codes[values[at:start]], [codes[symbol] | extra << int(lengths[symbol]), far_codes[far], far_extra]]
        sizes += [lengths[values[at:start]], [lengths[symbol] + n_extra, far_lengths[far], n_far]]
        at = start + length
    shown, sizes = np.concatenate([*shown, codes[values[at:]]]).astype(np.int64), np.concatenate([*sizes, lengths[values[at:]]]).astype(np.int64)
    ends = np.cumsum(sizes) + bits.n
    starts = ends - sizes
    shifted = np.where(sizes > 0, shown, 0) << (starts & 7)
    total = (int(ends[-1]) + 7) >> 3
    # codes don't overlap, so bytes add up what falls into them
    stream = np.zeros(total + 8, np.int64)
    place = starts >> 3
    for k in range(4):
        part = shifted >> (8 * k) & 255
        if k < 3 or part.any():
            stream += np.bincount(place + k, weights=part, minlength=total + 8).astype(np.int64)[: total + 8]
    front = np.frombuffer(bits.value.to_bytes((bits.n + 7) >> 3, "little"), np.uint8)
    stream[: len(front)] += front
    return container(stream[:total].astype(np.uint8).tobytes())
