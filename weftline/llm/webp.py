"""Lossless WebP (VP8L): a full decoder, and an encoder for 8-bit samples whose stored form it reads back.

Decoder. Prefix codes (simple and normal, meta prefix groups), back-references with the two-dimensional
distance map, the colour cache, and the inverse of all four transforms: predictor, cross-colour, subtract-green
and colour-indexing palette (with packed pixels). decode() writes a (height, width, 4) array of RGBA samples.

Reading many images. Grey images of one batch with one prefix group (subtract-green, then a predictor, a palette
or neither) are decoded together: for every bit of all their streams the token that would start there (sample,
back-reference or cache index) gives the next bit, jumps of eight tokens are composed from single ones, and only
those jumps are followed one after another. Copied samples and cached colours are then found by following
pointers for all images at once, and transforms are undone by image. Any other stream takes the general path.

Encoder. Grey images of 64 samples a row with subtract-green. For each image it takes what needs the fewest bits
by the entropy of its symbols: samples as they are, predicted (left, above, above right, above left) or packed by
a palette of at most 16 colours; with back-references or without, with a colour cache or without. References go to the
latest earlier place with the same five samples, where that saves bits. Prefix codes come from each image's own
histograms, complete and at most 12 bits long; one prefix group an image, no cross-colour (grey has none).
More than 64 x 16384 samples become several images one after another.

Cases: a null text is stored as an empty one, which is padded to 64 zero samples. Texts of any length are
stored whole. Equal texts give equal bytes. A null or damaged stored form raises ValueError in decode(), and
gives a null result row in decode_webp(). Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import map_batches, slices, text_buffer

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
COLOUR_CACHE_MULTIPLIER = 0x1E35A7BD
SIGNATURE = 0x2F
ALPHABETS = (256 + 24, 256, 256, 256, 40)

WIDTH, MOST_ROWS, LONGEST_CODE = 64, 16384, 12


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)
        self._refill()

    def _refill(self) -> None:
        self.base = self.at & ~7
        part = self.data[self.base >> 3 : (self.base >> 3) + (1 << 8)]
        self.value, self.top = int.from_bytes(part, "little"), self.base + 8 * len(part)

    def peek(self, n: int) -> int:
        if self.at + n > self.top and self.top < self.end:
            self._refill()
        return (self.value >> (self.at - self.base)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return out


class Prefix:
    """A canonical prefix code as one table of its longest length; a single symbol takes no bits."""

    __slots__ = ("single", "longest", "table", "lengths")

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else -1
        self.longest = 0
        self.table: list[tuple[int, int]] = []
        if len(used) == 0:
            raise ValueError("an empty prefix code")
        if self.single >= 0:
            return
        n = lengths[used]
        self.longest = int(n.max())
        if (1 << (self.longest - n)).sum() != 1 << self.longest:
            raise ValueError("a prefix code that is not complete")

    def in_order(self, longest: int) -> np.ndarray:
        """symbol * 16 + length for each number of `longest` bits, the first bit read highest."""
        if self.single >= 0:
            return np.full(1 << longest, self.single * 16, np.uint16)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        n = self.lengths[order]
        return np.repeat((order * 16 + n).astype(np.uint16), 1 << (longest - n))

    def words(self) -> list[tuple[int, int]]:
        """Symbol and length for each number of the longest length's bits; made when first asked for."""
        if not self.table and self.single < 0:
            symbols, n = np.divmod(self.in_order(self.longest)[_flips(self.longest)], 16)
            self.table = list(zip(symbols.tolist(), n.tolist(), strict=True))
        return self.table

    def read(self, bits: Bits) -> int:
        if self.single >= 0:
            return self.single
        if not self.table:
            self.words()
        symbol, n = self.table[bits.peek(self.longest)]
        bits.at += n
        return symbol


_FLIPS: dict[int, np.ndarray] = {}


def _flips(n: int) -> np.ndarray:
    """For each number of n bits the one with its bits in reverse."""
    if n not in _FLIPS:
        x = np.arange(1 << n)
        out = np.zeros(1 << n, np.int64)
        for i in range(n):
            out |= ((x >> i) & 1) << (n - 1 - i)
        _FLIPS[n] = out
    return _FLIPS[n]


@lru_cache(maxsize=256)
def _length_code(lengths: bytes) -> Prefix:
    return Prefix(np.frombuffer(lengths, np.int64))


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = np.zeros(max(alphabet, 256), np.int64)
    if bits.read(1):  # simple: one or two symbols
        two = bits.read(1)
        first = bits.read(8) if bits.read(1) else bits.read(1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    code_lengths = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        code_lengths[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = _length_code(code_lengths.tobytes())
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    before, i = 8, 0
    table, longest = code.words(), code.longest
    while i < alphabet and most:
        most -= 1
        if code.single >= 0:
            s = code.single
        else:
            s, n = table[bits.peek(longest)]
            bits.at += n
        if s < 16:
            lengths[i] = s
            before = s or before
            i += 1
        else:
            n, value = ((3 + bits.read(2), before) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0))
            if i + n > alphabet:
                raise ValueError("more code lengths than symbols")
            lengths[i : i + n] = value
            i += n
    return Prefix(lengths)


def _count(bits: Bits, symbol: int) -> int:
    """Lengths and distances: a prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers; only the top image may have meta prefix groups."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("a colour cache of a size that isn't allowed")
    groups_of, block, groups = None, 0, 1
    if top and bits.read(1):
        block = bits.read(3) + 2
        w = (width + (1 << block) - 1) >> block
        meta = read_pixels(bits, w, (height + (1 << block) - 1) >> block, False)
        groups_of = ((meta >> 8) & 0xFFFF).reshape(-1, w).tolist()
        groups = max(map(max, groups_of)) + 1
    codes = [[read_prefix(bits, n + ((1 << cache_bits) if k == 0 and cache_bits else 0)) for k, n in enumerate(ALPHABETS)] for _ in range(groups)]
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    at, green, red, blue, alpha, far = 0, *codes[0]
    while at < total:
        if groups_of is not None:
            green, red, blue, alpha, far = codes[groups_of[(at // width) >> block][(at % width) >> block]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            px = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            out[at] = px
            at += 1
            if cache is not None:
                cache[((px * COLOUR_CACHE_MULTIPLIER) & 0xFFFFFFFF) >> shift] = px
        elif s < 280:
            n = _count(bits, s - 256)
            code = _count(bits, far.read(bits))
            if code > 120:
                back = code - 120
            else:
                dx, dy = DISTANCE_MAP[code - 1]
                back = max(1, dx + dy * width)
            if back > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + n):
                px = out[k] = out[k - back]
                if cache is not None:
                    cache[((px * COLOUR_CACHE_MULTIPLIER) & 0xFFFFFFFF) >> shift] = px
            at += n
        else:
            if cache is None or s - 280 >= len(cache):
                raise ValueError("a colour that the cache doesn't hold")
            px = out[at] = cache[s - 280]
            cache[((px * COLOUR_CACHE_MULTIPLIER) & 0xFFFFFFFF) >> shift] = px
            at += 1
        if bits.at > bits.end:
            raise ValueError("the stream ends too early")
    return np.array(out, np.uint32)


def _channels(px: np.ndarray) -> np.ndarray:
    """ARGB numbers as (..., 4) signed samples in the order alpha, red, green, blue."""
    return np.stack([(px >> s) & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int32)


def undo_predictor(px: np.ndarray, width: int, modes: np.ndarray, block: int) -> np.ndarray:
    """Adds to each pixel what its mode predicts from those left and above."""
    c = _channels(px).reshape(-1, width, 4)
    height = len(c)
    mode_of = ((modes >> 8) & 0xF).reshape(-1, (width + (1 << block) - 1) >> block)
    out = np.zeros_like(c)
    out[0, 0] = (c[0, 0] + np.array([255, 0, 0, 0])) & 0xFF
    if width > 1:
        out[0, 1:] = np.cumsum(np.concatenate([out[0, :1], c[0, 1:]]), axis=0)[1:] & 0xFF
    half = lambda a, b: (a + b) >> 1
    clamp = lambda a: np.minimum(np.maximum(a, 0), 255)
    for y in range(1, height):
        up = out[y - 1]
        out[y, 0] = (c[y, 0] + up[0]) & 0xFF
        modes_y = np.repeat(mode_of[y >> block], 1 << block)[:width].tolist()
        for x in range(1, width):
            left, top, tl = out[y, x - 1], up[x], up[x - 1]
            tr = up[x + 1] if x + 1 < width else out[y, 0]
            m = modes_y[x]
            if m == 0 or m > 13:
                p = np.array([255, 0, 0, 0])
            elif m == 1:
                p = left
            elif m == 2:
                p = top
            elif m == 3:
                p = tr
            elif m == 4:
                p = tl
            elif m == 5:
                p = half(half(left, tr), top)
            elif m == 6:
                p = half(left, tl)
            elif m == 7:
                p = half(left, top)
            elif m == 8:
                p = half(tl, top)
            elif m == 9:
                p = half(top, tr)
            elif m == 10:
                p = half(half(left, tl), half(top, tr))
            elif m == 11:
                guess = left + top - tl
                p = left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
            elif m == 12:
                p = clamp(left + top - tl)
            else:
                mean = half(left, top)
                d = mean - tl
                p = clamp(mean + np.where(d < 0, -(-d // 2), d // 2))
            out[y, x] = (c[y, x] + p) & 0xFF
    return _numbers(out)


def _numbers(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32).reshape(-1, 4)
    return c[:, 0] << 24 | c[:, 1] << 16 | c[:, 2] << 8 | c[:, 3]


def undo_cross_colour(px: np.ndarray, width: int, elements: np.ndarray, block: int) -> np.ndarray:
    c = _channels(px).reshape(-1, width, 4)
    e = _channels(elements).reshape(-1, (width + (1 << block) - 1) >> block, 4)
    e = np.repeat(np.repeat(e, 1 << block, 0), 1 << block, 1)[: len(c), :width].astype(np.int8).astype(np.int32)
    signed = lambda a: (a & 0xFF).astype(np.uint8).astype(np.int8).astype(np.int32)
    delta = lambda t, v: (t * signed(v)) >> 5
    red_to_blue, green_to_blue, green_to_red = e[..., 1], e[..., 2], e[..., 3]
    red = (c[..., 1] + delta(green_to_red, c[..., 2])) & 0xFF
    blue = (c[..., 3] + delta(green_to_blue, c[..., 2]) + delta(red_to_blue, red)) & 0xFF
    c[..., 1], c[..., 3] = red, blue
    return _numbers(c)


def undo_green(px: np.ndarray) -> np.ndarray:
    green = (px >> 8) & 0xFF
    return (px & 0xFF00FF00) | ((px + (green << 16 | green)) & 0x00FF00FF)


def undo_palette(px: np.ndarray, palette: np.ndarray, width: int, packing: int) -> np.ndarray:
    """Indices in the green channel, 2**packing to a pixel, become the palette's colours; none: transparent black."""
    index = (px >> 8) & 0xFF
    if packing:
        each = 8 >> packing
        index = ((index[:, None] >> (np.arange(1 << packing, dtype=np.uint32) * each)) & ((1 << each) - 1)).reshape(-1, ((width + (1 << packing) - 1) >> packing) << packing)[:, :width].reshape(-1)
    colours = np.concatenate([palette, np.zeros(256 - len(palette), np.uint32)])
    return colours[index]


def chunk_of(data: bytes) -> bytes:
    """The VP8L chunk of a RIFF file."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def _transforms(bits: Bits, width: int, height: int) -> tuple[list, int]:
    found, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            found.append((kind, width, block, read_pixels(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)))
        elif kind == 2:
            found.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            deltas = _channels(read_pixels(bits, n, 1, False))
            palette = _numbers(np.cumsum(deltas, axis=0))
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            found.append((kind, width, packing, palette))
            width = (width + (1 << packing) - 1) >> packing
    return found, width


def decode(data: bytes) -> np.ndarray:
    """A WebP file as (height, width, 4) RGBA samples."""
    bits = Bits(chunk_of(data))
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    transforms, coded_width = _transforms(bits, width, height)
    px = read_pixels(bits, coded_width, height, True)
    for kind, w, n, extra in reversed(transforms):
        if kind == 0:
            px = undo_predictor(px, w, extra, n)
        elif kind == 1:
            px = undo_cross_colour(px, w, extra, n)
        elif kind == 2:
            px = undo_green(px)
        else:
            px = undo_palette(px, extra, w, n)
    c = _channels(px).astype(np.uint8).reshape(height, width, 4)
    return c[..., [1, 2, 3, 0]]


# -- 8-bit samples ---------------------------------------------------------------------------------------


def code_lengths(histogram: np.ndarray, most: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of a complete prefix code for each row of counts; 0 where a count is 0.

    Starts from the rounded-up information of each symbol, which leaves room, and spends the room one bit at a
    time on the longest codes, the most frequent first; rows are treated all at once.
    """
    total = histogram.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.ceil(np.log2(total / histogram))
    used = histogram > 0
    lengths = np.where(used, np.clip(np.nan_to_num(bits, posinf=0), 1, most), 0).astype(np.int64)
    one = 1 << most
    share = lambda: np.where(used, one >> lengths, 0).sum(1)
    rank = np.argsort(-histogram, axis=1, kind="stable")
    while (over := share() > one).any():  # clipping at `most` may have taken too much: lengthen the rarest that can
        rows = np.flatnonzero(over)
        for r in rows:
            can = np.flatnonzero(used[r] & (lengths[r] < most))
            longest = can[lengths[r, can] == lengths[r, can].max()]
            lengths[r, longest[np.argmin(histogram[r, longest])]] += 1
    room = one - share()
    while True:
        before = room.copy()
        for k in range(int(used.sum(1).max())):
            col = rank[:, k]
            row = np.arange(len(room))
            n = lengths[row, col]
            gain = np.where(n > 0, one >> np.maximum(n, 1), 0)
            fine = (n > 1) & (gain > 0) & (gain <= room)
            lengths[row[fine], col[fine]] -= 1
            room = room - np.where(fine, gain, 0)
        if not room.any() or (room == before).all():
            break
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by row, bits in stream order (first bit lowest)."""
    rows, symbols = lengths.shape
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    n = np.take_along_axis(lengths, order, 1)
    top = 15
    span = np.where(n > 0, 1 << (top - n), 0)
    start = np.cumsum(span, axis=1) - span  # the code, padded to 15 bits
    codes = np.zeros_like(lengths)
    np.put_along_axis(codes, order, _flips(top)[np.minimum(start, (1 << top) - 1)], 1)
    return codes


class Writer:
    """Collects bits of a header, least significant first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


#: The code of code lengths: complete with 13 codes of four bits and six of five.
_LENGTH_CODE = np.array([4] * 13 + [5] * 6)
_LENGTH_WORDS = [(int(c), int(n)) for c, n in zip(canonical(_LENGTH_CODE[None])[0], _LENGTH_CODE, strict=True)]


def _put_lengths(w: Writer, lengths: list[int]) -> None:
    w.put(0, 1)
    w.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.put(int(_LENGTH_CODE[s]), 3)
    w.put(0, 1)  # lengths of the whole alphabet follow
    i, n = 0, len(lengths)
    while i < n:
        run = 1
        while i + run < n and lengths[i + run] == lengths[i]:
            run += 1
        if lengths[i] == 0 and run >= 3:
            run = min(run, 138)
            if run >= 11:
                w.put(*_LENGTH_WORDS[18])
                w.put(run - 11, 7)
            else:
                w.put(*_LENGTH_WORDS[17])
                w.put(run - 3, 3)
            i += run
        else:
            w.put(*_LENGTH_WORDS[lengths[i]])
            i += 1


def _put_one(w: Writer, symbol: int) -> None:
    """A simple code of one symbol."""
    w.put(1, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(symbol, 8)


#: Offset back to the sample that each of the encoder's predictors takes, by its mode; above right of a row's last
#: sample is the first of the same row, as the format has it.
PREDICTORS = {1: 1, 2: WIDTH, 3: WIDTH - 1, 4: WIDTH + 1}
#: Sizes of the colour cache that the encoder tries, in bits; the others only where the first pays.
CACHES = (1, 2, 3, 4, 6, 8)
#: Samples that a reference is looked up by; the longest reference and the farthest one.
SAME, LONGEST_COPY, FARTHEST = 5, 4096, (1 << 20) - 120
#: Bits of a header, about, for each symbol that a prefix code holds.
HEAD_BITS = 5


def _entropy(histogram: np.ndarray) -> np.ndarray:
    """Bits that each row's symbols need, with their code's header, about."""
    total = histogram.sum(1)
    log = lambda c: np.log2(np.maximum(c, 1))
    return total * log(total) - (histogram * log(histogram)).sum(1) + HEAD_BITS * (histogram > 0).sum(1)


def _histograms(row: np.ndarray, symbols: np.ndarray, rows: int, size: int) -> np.ndarray:
    return np.bincount(row * size + symbols, minlength=rows * size).reshape(rows, size)


def _predicted(samples: np.ndarray, offs: np.ndarray, back: int) -> np.ndarray:
    """What is left of each sample when the one `back` before it is taken away; edges as the format has them."""
    before = np.zeros(len(samples), np.uint8)
    before[back:] = samples[:-back] if back < len(samples) else samples[:0]
    column = np.arange(0, len(samples), WIDTH)
    before[column[1:]] = samples[column[:-1]]
    first = (offs[:-1, None] + np.arange(WIDTH)).reshape(-1)
    before[first] = samples[first - 1]
    before[offs[:-1]] = 0
    return samples - before


def _packed(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Palette, samples as indices, several to one, and the binary logarithm of how many; at most 16 colours."""
    palette, index = np.unique(samples, return_inverse=True)
    packing = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1
    each = index.reshape(-1, 1 << packing) << (np.arange(1 << packing) * (8 >> packing))
    return palette, each.sum(1).astype(np.uint8), packing


def _ways(samples: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Ways to code the images: samples, offsets, image and (transform, what it needs) of each.

    Every image as it is; after these the images that a predictor or a palette makes smaller.
    """
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    plain = _histograms(row, samples, n, 256)
    least = _entropy(plain)
    best: list[tuple] = [("", 0)] * n
    parts: dict[int, np.ndarray] = {}
    for mode, back in PREDICTORS.items():
        rest = _predicted(samples, offs, back)
        cost = _entropy(_histograms(row, rest, n, 256)) + 60
        for i in np.flatnonzero(cost < least).tolist():
            best[i], parts[i] = ("predictor", mode), rest[offs[i] : offs[i + 1]]
        least = np.minimum(least, cost)
    colours = (plain > 0).sum(1)
    for i in np.flatnonzero((colours > 1) & (colours <= 16)).tolist():
        palette, packed, packing = _packed(samples[offs[i] : offs[i + 1]])
        cost = float(_entropy(np.bincount(packed, minlength=256)[None])[0]) + 60 + 8 * len(palette)
        if cost < least[i]:
            best[i], parts[i] = ("palette", (palette, packing)), packed
    owner = sorted(parts)
    sizes = np.concatenate([np.diff(offs), np.array([len(parts[i]) for i in owner], np.int64)])
    return (
        np.concatenate([samples, *(parts[i] for i in owner)]),
        np.concatenate([[0], np.cumsum(sizes)]),
        np.concatenate([np.arange(n), np.array(owner, np.int64)]),
        [("", 0)] * n + [best[i] for i in owner],
    )


def _references(samples: np.ndarray, offs: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of references that save bits, where a sample of image i is worth worth[i] bits."""
    none = np.zeros(0, np.int64)
    n = len(samples)
    if n <= SAME:
        return none, none, none
    room = int(n).bit_length()
    key = samples.astype(np.uint64)
    for k in range(1, SAME):
        key = (key[:-1] << np.uint64(8)) | samples[k:]
    key <<= np.uint64(room)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    same = np.flatnonzero((key[1:] ^ key[:-1]) < np.uint64(1 << room))
    at = (key & np.uint64((1 << room) - 1)).astype(np.int32)
    back = np.zeros(n + 1, np.int64)  # distance to the latest place with the same samples
    back[at[same + 1]] = at[same + 1] - at[same]
    del key, at, same
    sizes = np.diff(offs)
    edge = np.arange(n) - np.repeat(offs[:-1], sizes)  # place in its image
    back[:n] *= (back[:n] <= edge) & (back[:n] <= FARTHEST)
    back[(offs[1:, None] - np.arange(1, SAME)).reshape(-1)] = 0
    # Places one after another at one distance are one longer copy.
    last = np.flatnonzero((back[1:] != back[:-1]) & (back[:-1] > 0))
    first = np.flatnonzero((back[1:] != back[:-1]) & (back[1:] > 0)) + 1
    if back[0] or not len(last):
        return none, none, none
    runs = last - first + 1
    far_bits = np.log2(back[first])
    value = worth[np.searchsorted(offs, first, "right") - 1]
    # From the middle of a copy less is left, and may not pay any more.
    start = np.flatnonzero(back)
    length = np.repeat(last + SAME, runs) - start
    least = np.maximum(np.floor((9 + far_bits) / np.maximum(value, 1e-9)) + 1, 2)
    pays = length >= np.repeat(least, runs)
    start, length = start[pays], np.minimum(length[pays], LONGEST_COPY)
    # From left to right, each at the first place that the one before leaves, and as far as the copy goes on.
    stop = memoryview(np.minimum(start + LONGEST_COPY, np.repeat(offs[1:], sizes)[start]))
    index = np.zeros(n + 2, np.int64)
    index[start + 1] = 1
    index = memoryview(np.cumsum(index))
    until, far, raw = memoryview(start + length), memoryview(back[start]), samples.tobytes()
    chosen, ends, i, count = [], [], 0, len(start)
    while i < count:
        e, d, most = until[i], far[i], stop[i]
        if e < most and raw[e] == raw[e - d]:
            while e + 16 <= most and raw[e : e + 16] == raw[e - d : e - d + 16]:
                e += 16
            while e < most and raw[e] == raw[e - d]:
                e += 1
        chosen.append(i)
        ends.append(e)
        i = index[e]
    start = start[chosen]
    return start, np.array(ends, np.int64) - start, back[start]


_NEAR: dict[int, np.ndarray] = {}


def _distance_codes(far: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The number that the format gives to a distance: near ones by the map, the smallest that fits."""
    out = far + 120
    for w in np.unique(width).tolist():
        if w not in _NEAR:
            near = np.zeros(8 * w + 9, np.int64)
            for code in range(120, 0, -1):
                dx, dy = DISTANCE_MAP[code - 1]
                near[max(1, dx + dy * w)] = code
            _NEAR[w] = near
        near = _NEAR[w]
        code = near[np.minimum(far, len(near) - 1)]
        out = np.where((width == w) & (far < len(near)) & (code > 0), code, out)
    return out


def _count_codes(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their value) of lengths and of distances' numbers."""
    n = count - 1
    k = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
    extra = np.where(n < 4, 0, k - 1)
    half = (n >> extra) & 1
    return np.where(n < 4, n, 2 * k + half), extra, np.where(n < 4, 0, n & ((1 << extra) - 1))


_KEYS: dict[tuple[int, int], np.ndarray] = {}


def _cache_keys(cache_bits: int, alpha: int) -> np.ndarray:
    """The place in a colour cache of each green sample, with that alpha."""
    if (cache_bits, alpha) not in _KEYS:
        px = np.arange(256, dtype=np.uint64) << np.uint64(8) | np.uint64(alpha << 24)
        _KEYS[cache_bits, alpha] = (((px * np.uint64(COLOUR_CACHE_MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
    return _KEYS[cache_bits, alpha]


def _latest(key: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The latest earlier place of the same image with the same key; -1: none."""
    room = int(len(key)).bit_length()
    kind = np.uint32 if room + int(key.max()).bit_length() <= 32 else np.uint64
    mixed = key.astype(kind) << kind(room) | np.arange(len(key), dtype=kind)
    mixed.sort()
    at = (mixed & kind((1 << room) - 1)).astype(np.int64)
    out = np.full(len(key), -1, np.int64)
    out[at[1:]] = np.where((mixed[1:] ^ mixed[:-1]) < kind(1 << room), at[:-1], -1)
    out[out < np.repeat(offs[:-1], np.diff(offs))] = -1
    return out


def _first_keys() -> np.ndarray:
    """Places in a cache of two colours, of samples with alpha 0 and 255."""
    return np.stack([_cache_keys(CACHES[0], 0), _cache_keys(CACHES[0], 255)])


def _latest_of_two(key: np.ndarray) -> np.ndarray:
    """The latest earlier place with the same key, 0 or 1; -1: none."""
    turns = np.flatnonzero(key[1:] != key[:-1]) + 1
    out = np.arange(-1, len(key) - 1)
    out[turns[:1]] = -1
    out[turns[1:]] = turns[:-1] - 1
    return out


def _put_head(w: Writer, rows: int, way: tuple) -> None:
    w.put(SIGNATURE, 8)
    w.put(WIDTH - 1, 14)
    w.put(rows - 1, 14)
    w.put(0, 4)
    w.put(1, 1)
    w.put(2, 2)  # subtract green: a grey pixel is its green sample alone
    kind, what = way
    if kind == "predictor":
        w.put(1, 1)
        w.put(0, 2)
        w.put(7, 3)  # blocks of 512 x 512, all of one mode
        w.put(0, 1)
        for s in (what, 0, 0, 0, 0):
            _put_one(w, s)
    elif kind == "palette":
        w.put(1, 1)
        w.put(3, 2)
        palette = what[0].tolist()
        w.put(len(palette) - 1, 8)
        w.put(0, 1)
        steps = np.diff([0, *palette])
        lengths = np.zeros((1, ALPHABETS[0]), np.int64)
        lengths[0, :256] = np.bincount(steps, minlength=256)
        several = (lengths > 0).sum() > 1
        lengths = code_lengths(lengths) if several else lengths * 0
        words = canonical(lengths)[0]
        if several:
            _put_lengths(w, lengths[0].tolist())
        else:
            _put_one(w, int(steps[0]))
        for s in (0, 0):
            _put_one(w, s)
        w.put(1, 1)  # alpha: 255, then 0; a simple code of two symbols, in order
        w.put(1, 1)
        w.put(0, 1)
        w.put(0, 1)
        w.put(255, 8)
        _put_one(w, 0)
        for k, s in enumerate(steps.tolist()):
            w.put(int(words[s]), int(lengths[0, s]))
            w.put(0 if k else 1, 1)
    w.put(0, 1)


def _put_code(w: Writer, lengths: list[int], used: np.ndarray) -> None:
    if len(used) > 1:
        _put_lengths(w, lengths)
    else:
        _put_one(w, int(used[0]) if len(used) else 0)


def encode_grey(payloads: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """A WebP file for each payload (a multiple of 64 bytes, at most 64 x 16384)."""
    samples, at, owner, ways = _ways(payloads, offs)
    n, sizes = len(ways), np.diff(at)
    row = np.repeat(np.arange(n), sizes)
    width = np.array([WIDTH >> (what[1] if kind == "palette" else 0) for kind, what in ways])
    alpha = np.array([0 if kind == "predictor" else 255 for kind, _ in ways])
    head = np.array([60 if kind else 0 for kind, _ in ways]) + np.array([8 * len(what[0]) if kind == "palette" else 0 for kind, what in ways])

    plain = _histograms(row, samples, n, 256)
    least = _entropy(plain) + head
    start, length, far = _references(samples, at, (least - head) / sizes)
    image = row[start]
    n_symbol, n_extra, n_value = _count_codes(length)
    d_symbol, d_extra, d_value = _count_codes(_distance_codes(far, width[image]))
    # Samples that references cover are not written.
    edges = np.zeros(len(samples) + 1, np.int8)
    edges[start] += 1
    edges[start + length] -= 1
    literal = np.flatnonzero(np.cumsum(edges[:-1], dtype=np.int8) == 0)
    distances = _histograms(image, d_symbol, n, ALPHABETS[4])
    beside = _entropy(distances) + np.bincount(image, n_extra + d_extra, n) + head
    green = np.hstack([_histograms(row[literal], samples[literal], n, 256), _histograms(image, n_symbol, n, 24)])
    cost = beside + _entropy(green)
    refers = cost < least
    least = np.minimum(cost, least)
    # A colour cache, of the size that saves most; it also holds what references copy.
    cache = np.zeros(n, np.int64)
    symbols = samples.astype(np.int64)
    key = _first_keys()[1][samples]
    if (alpha == 0).any():
        key = np.where(alpha[row] == 0, _first_keys()[0][samples], key)
    before, key = _latest_of_two(key)[literal], key[literal]
    hit = (before >= at[row[literal]]) & (samples[before] == samples[literal])
    with_cache = _histograms(row[literal], np.where(hit, 280 + key, samples[literal]), n, 282)
    with_cache[:, 256:280] = green[:, 256:]
    for i in np.flatnonzero(beside + _entropy(with_cache) < least).tolist():
        mine = slice(at[i], at[i + 1])
        own = literal[slice(*np.searchsorted(literal, at[i : i + 2]))] - at[i]
        for bits in CACHES:
            key = _cache_keys(bits, int(alpha[i]))[samples[mine]]
            before = _latest(key, np.array([0, sizes[i]]))[own]
            coded = np.where((before >= 0) & (samples[mine][before] == samples[mine][own]), 280 + key[own], samples[mine][own])
            histogram = np.bincount(coded, minlength=280 + (1 << bits))
            histogram[256:280] = green[i, 256:]
            total = beside[i] + _entropy(histogram[None])[0]
            if total < least[i]:
                least[i], cache[i], refers[i] = total, bits, True
                symbols[at[i] + own] = coded

    # The way of each image that needs the fewest bits, the first of equals.
    order = np.lexsort((np.arange(n), least, owner))
    chosen = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
    is_chosen = np.zeros(n, bool)
    is_chosen[chosen] = True
    ref = np.flatnonzero((refers & is_chosen)[image])
    start, length, image = start[ref], length[ref], image[ref]
    written = is_chosen[row]
    whole = np.zeros(len(samples), bool)
    whole[literal] = True
    written &= whole | ~refers[row]
    # One item a sample; a reference has two (length, distance), in the places of its first two samples.
    item = np.flatnonzero(written)
    most = 280 + (1 << int(cache.max()) if cache.any() else 0)
    green = _histograms(row[item], symbols[item], n, most)
    green[:, :280] += _histograms(image, 256 + n_symbol[ref], n, 280)
    distances = _histograms(image, d_symbol[ref], n, ALPHABETS[4])
    green, distances = green[chosen], distances[chosen]
    place = np.zeros(n, np.int64)
    place[chosen] = np.arange(len(chosen))
    lengths, codes = _prefix_codes(green)
    far_lengths, far_codes = _prefix_codes(distances)
    bits = np.zeros(len(samples) + 1, np.int64)
    value = np.zeros(len(samples) + 1, np.uint64)
    flat = place[row[item]] * most + symbols[item]
    bits[item], value[item] = lengths.reshape(-1)[flat], codes.reshape(-1)[flat].astype(np.uint64)
    for to, s, extra, rest, size, c, v in (
        (start, 256 + n_symbol[ref], n_extra[ref], n_value[ref], most, lengths, codes),
        (start + 1, d_symbol[ref], d_extra[ref], d_value[ref], ALPHABETS[4], far_lengths, far_codes),
    ):
        flat = place[image] * size + s
        bits[to] = c.reshape(-1)[flat] + extra
        value[to] = (v.reshape(-1)[flat] | rest << c.reshape(-1)[flat]).astype(np.uint64)
    item = np.concatenate([item, start, start + 1])
    written[start] = written[start + 1] = True
    item = np.flatnonzero(written)
    item = item[np.argsort(place[row[item]], kind="stable")]
    heads = []
    for i, c in enumerate(chosen.tolist()):
        w = Writer()
        _put_head(w, int(offs[i + 1] - offs[i]) // WIDTH, ways[c])
        w.put(1 if cache[c] else 0, 1)
        if cache[c]:
            w.put(int(cache[c]), 4)
        w.put(0, 1)  # one prefix group
        _put_code(w, lengths[i, : 280 + (1 << int(cache[c]) if cache[c] else 0)].tolist(), np.flatnonzero(green[i]))
        for s in (0, 0, int(alpha[c])):
            _put_one(w, s)
        _put_code(w, far_lengths[i].tolist(), np.flatnonzero(distances[i]))
        heads.append(w)
    return _files(heads, bits[item], value[item], np.bincount(place[row[item]], minlength=len(chosen)))


def _prefix_codes(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and codes by row; a row of one symbol or none takes no bits."""
    lengths = code_lengths(histogram)
    lengths[(histogram > 0).sum(1) <= 1] = 0
    return lengths, canonical(lengths)


def _files(heads: list[Writer], bits: np.ndarray, value: np.ndarray, items: np.ndarray) -> list[bytes]:
    """Files of a header and the items that follow each; items are one after another in the order of the headers."""
    head_bits = np.array([w.n for w in heads], np.int64)
    ends = np.cumsum(bits)
    last = np.cumsum(items)
    body = np.diff(np.concatenate([[0], ends[last - 1]]))
    stream_bytes = (head_bits + body + 7) // 8
    base = np.cumsum(stream_bytes) - stream_bytes
    # Each code is added into the 32-bit words that it touches; codes never overlap, so adding is joining.
    at = ends - bits + np.repeat(base * 8 + head_bits - (ends[last - 1] - body), items)
    value = value << (at & 31).astype(np.uint64)
    word = at >> 5
    words = np.zeros(int(stream_bytes.sum() + 11) // 4 + 2, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    words[word[first] + 1] += np.add.reduceat(value >> np.uint64(32), first)
    raw = words.astype("<u4").tobytes()
    out = []
    for w, b, size in zip(heads, base.tolist(), stream_bytes.tolist(), strict=True):
        head = w.value.to_bytes((w.n + 7) // 8, "little")
        stream = bytearray(raw[b : b + size])
        k = len(head)
        stream[: k - 1] = head[: k - 1]
        stream[k - 1] |= head[k - 1]
        if size & 1:
            stream.append(0)
        out.append(b"RIFF" + struct.pack("<I", 12 + len(stream)) + b"WEBPVP8L" + struct.pack("<I", size) + bytes(stream))
    return out


def encode_payloads(payloads: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """The stored form of each payload: one image, or several one after another."""
    most = WIDTH * MOST_ROWS
    cuts = [c for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) for c in range(a, b, most)]
    owner = np.searchsorted(offs, cuts, "right") - 1
    at = np.array([*cuts, offs[-1]])
    out = [b""] * (len(offs) - 1)
    for i, j in slices(at, most):
        for k, file in zip(owner[i:j].tolist(), encode_grey(payloads[at[i] : at[j]], at[i : j + 1] - at[i]), strict=True):
            out[k] += file
    return out


def files_of(stored: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(stored):
        size = struct.unpack_from("<I", stored, at + 4)[0] + 8
        out.append(stored[at : at + size])
        at += size
    return out


class Grey(NamedTuple):
    """A stream whose coded samples are green alone: what its head says, and the first bit of its tokens."""

    stream: bytes
    first: int
    width: int  # as coded
    pixels: int
    cache_bits: int
    alpha: int
    green: Prefix
    far: Prefix
    undo: list


def _grey(file: bytes) -> Grey | None:
    """The head of a stream, if it can be read together with others."""
    stream = chunk_of(file)
    bits = Bits(stream)
    if bits.read(8) != SIGNATURE:
        return None
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if bits.read(4) > 1:
        return None
    undo, width = _transforms(bits, width, height)
    kinds = [t[0] for t in undo]
    if kinds not in ([2], [2, 0], [2, 3]):
        return None
    if kinds == [2, 3] and ((undo[1][3] & 0xFFFF00FF) != 0xFF000000).any():
        return None
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11 or bits.read(1):
        return None
    green = read_prefix(bits, ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0))
    *rest, far = (read_prefix(bits, k) for k in ALPHABETS[1:])
    alpha = 0 if kinds == [2, 0] else 255
    if [p.single for p in rest] != [0, 0, alpha]:
        return None
    return Grey(stream, bits.at, width, width * height, cache_bits, alpha, green, far, undo[1:])


def undo_predictor_grey(rest: np.ndarray, width: int, modes: np.ndarray, block: int) -> np.ndarray | None:
    """The samples, where all blocks take one of the encoder's predictors; otherwise None."""
    mode = int(modes[0] >> 8) & 0xF
    if mode not in PREDICTORS or (((modes >> 8) & 0xF) != mode).any():
        return None
    rows = rest.reshape(-1, width)
    out = np.empty_like(rows)
    out[0] = np.cumsum(rows[0], dtype=np.uint8)
    # Slices, not single samples, so that sums wrap.
    if mode == 1:
        out[:, 0] = np.cumsum(rows[:, 0], dtype=np.uint8)
        out[1:, 1:] = rows[1:, 1:]
        out[1:] = np.cumsum(out[1:], axis=1, dtype=np.uint8)
        return out.reshape(-1)
    for y in range(1, len(rows)):
        up = out[y - 1]
        out[y, :1] = rows[y, :1] + up[:1]
        if mode == 2:
            out[y, 1:] = rows[y, 1:] + up[1:]
        elif mode == 3:
            out[y, 1:-1] = rows[y, 1:-1] + up[2:]
            out[y, -1:] = rows[y, -1:] + out[y, :1]
        else:
            out[y, 1:] = rows[y, 1:] + up[:-1]
    return out.reshape(-1)


#: Texts that are encoded together and streams that are decoded together: about so many bytes.
TOGETHER, STREAMS = 1 << 18, 1 << 16


def decode_samples(files: list[bytes]) -> list[bytes]:
    """The 8-bit samples (green) of each file."""
    out: list[bytes | None] = [None] * len(files)
    group: list[tuple[int, Grey]] = []
    size = pixels = 0

    def flush() -> None:
        nonlocal size, pixels
        if group:
            for (i, g), coded in zip(group, _decode_together([g for _, g in group]), strict=True):
                out[i] = _undone(g, coded, files[i])
        group.clear()
        size = pixels = 0

    for i, f in enumerate(files):
        grey = _grey(f)
        if grey is None:
            out[i] = decode(f)[..., 1].tobytes()
        elif grey.green.single >= 0:
            out[i] = _undone(grey, np.full(grey.pixels, grey.green.single, np.uint8) if grey.green.single < 256 else None, f)
        else:
            group.append((i, grey))
            size += len(grey.stream)
            pixels += grey.pixels
            if size >= STREAMS or pixels >= WIDTH * MOST_ROWS:
                flush()
    flush()
    return out


def _undone(g: Grey, coded: np.ndarray | None, file: bytes) -> bytes:
    """Samples from those that are coded; what isn't grey throughout is decoded by itself."""
    for kind, width, n, extra in g.undo if coded is not None else ():
        if kind == 0:
            coded = undo_predictor_grey(coded, width, extra, n)
        else:
            coded = (undo_palette(coded.astype(np.uint32) << 8, extra, width, n) >> 8).astype(np.uint8)
    return decode(file)[..., 1].tobytes() if coded is None else coded.tobytes()


def _follow(source: np.ndarray, todo: np.ndarray) -> None:
    """Makes each sample's source the one at the end of its chain."""
    while len(todo):
        now = source[todo]
        then = source[now]
        source[todo] = then
        todo = todo[now != then]


@lru_cache
def _token_bits(first: int = 0) -> np.ndarray:
    """Bits of the code and of what follows it, for each symbol * 16 + length; counts are the symbols from 256 - first on."""
    entry = np.arange(1 << 16)
    symbol = (entry >> 4) - 256 + first
    extra = np.where((symbol >= 4) & (symbol < (40 if first else 24)), (symbol - 2) >> 1, 0)
    return ((entry & 15) + extra).astype(np.uint8)


def _decode_together(group: list[Grey]) -> list[np.ndarray | None]:
    """Coded samples of each stream; None where one needs a colour that no sample has put into the cache."""
    longest = max(g.green.longest for g in group)
    far_longest = max(g.far.longest for g in group)
    # Tables for each stream, by the next bits, first bit highest: symbol * 16 + length.
    table = np.concatenate([g.green.in_order(longest) for g in group])
    far_table = np.concatenate([g.far.in_order(far_longest) for g in group])
    sizes = np.array([len(g.stream) for g in group])
    # A byte more for each: a distance of no bits may start where a stream ends, and is by that stream's code.
    base = np.cumsum(sizes + 1) - sizes - 1
    n = int(sizes.sum()) + len(group)
    raw = np.frombuffer(b"".join(g.stream + b"\0" for g in group) + bytes(16), np.uint8)
    window = lambda b: b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    most_first = window(_flips(8).astype(np.uint32)[raw])
    least_first = window(raw[::-1].astype(np.uint32))[::-1]
    stream_of = np.repeat(np.arange(len(group), dtype=np.uint32), sizes + 1)
    at_bit = (most_first[:n, None] << np.arange(8, dtype=np.uint32)) >> np.uint32(32 - longest)
    at_bit += (stream_of << np.uint32(longest))[:, None]
    entry = table[at_bit.reshape(-1)]
    del at_bit
    bits = 8 * n
    jump = np.empty(bits + 2, np.int32)
    np.add(np.arange(bits, dtype=np.int32), _token_bits()[entry], out=jump[:-2])
    jump[-2:] = bits + 1
    # After a reference's length and its extra bits comes its distance.
    refer = np.flatnonzero((entry >= 256 * 16) & (entry < 280 * 16))
    if len(refer):
        at_bit = (most_first[: n + 8, None] << np.arange(8, dtype=np.uint32)) >> np.uint32(31 - far_longest) >> np.uint32(1)
        at_bit[:n] += (stream_of << np.uint32(far_longest))[:, None]
        far_bits = _token_bits(256)[far_table][at_bit.reshape(-1)]
        del at_bit
        p = jump[refer]
        jump[refer] = p + far_bits[p]
    widths = np.array([g.width for g in group])
    near = np.array(DISTANCE_MAP)

    def count(symbol: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        value = (least_first[p >> 3] >> (p & 7).astype(np.uint32)).astype(np.int64) & ((1 << extra) - 1)
        return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + value) + 1, p + extra

    def references(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, distance and next bit of the references that start at these bits."""
        stream = stream_of[p >> 3].astype(np.int64)
        e = entry[p].astype(np.int64)
        length, p = count((e >> 4) - 256, p + (e & 15))
        code = (most_first[p >> 3] << (p & 7).astype(np.uint32)).astype(np.int64) >> (32 - far_longest)
        e = far_table[stream << far_longest | code].astype(np.int64)
        code, p = count(e >> 4, p + (e & 15))
        dx, dy = near[np.minimum(code, 120) - 1].T
        return length, np.where(code > 120, code - 120, np.maximum(1, dx + dy * widths[stream])), p

    np.minimum(jump, bits + 1, out=jump)
    two = jump[jump]
    four = two[two]
    eight = memoryview(four[four])
    starts, per = [], []
    for g, b, size in zip(group, base.tolist(), sizes.tolist(), strict=True):
        p, before, stop = 8 * b + g.first, len(starts), 8 * (b + size)
        while p < stop:
            starts.append(p)
            p = eight[p]
        per.append(len(starts) - before)
    grid = np.empty((len(starts), 8), np.int32)
    grid[:, 0] = starts
    for k in range(1, 8):
        grid[:, k] = jump[grid[:, k - 1]]
    token = grid.reshape(-1)
    owner = np.repeat(np.arange(len(group)), 8 * np.array(per))
    stop = 8 * (base + sizes)
    inside = token < stop[owner]
    token, owner = token[inside].astype(np.int64), owner[inside]
    symbol = entry[token] >> 4
    refer = np.flatnonzero((symbol >= 256) & (symbol < 280))
    copied, distance, _ = references(token[refer])
    advance = np.ones(len(token) + 1, np.int64)
    advance[refer] = copied
    ends = np.cumsum(advance[:-1])
    first = np.searchsorted(owner, np.arange(len(group)))
    if (np.diff(np.append(first, len(owner))) == 0).any():
        raise ValueError("the stream ends too early")
    pixels = np.array([g.pixels for g in group])
    here = ends - advance[:-1] - (ends[first] - advance[first])[owner]  # place in its own image
    need = here < pixels[owner]  # what follows are the last byte's unused bits
    done = np.zeros(len(group), np.int64)
    np.maximum.at(done, owner[need], (here + advance[:-1])[need])
    if (done != pixels).any() or (jump[token[need]] > stop[owner[need]]).any():
        raise ValueError("the stream ends too early, or a back-reference leaves the image")
    origin = np.cumsum(pixels) - pixels
    place = origin[owner] + here
    kept = need[refer]
    refer, copied, distance = refer[kept], copied[kept], distance[kept]
    if (distance > here[refer]).any():
        raise ValueError("a back-reference leaves the image")
    token, owner, symbol, place, at = token[need], owner[need], symbol[need], place[need], place[refer]
    total = int(pixels.sum())
    value = np.zeros(total, np.uint8)
    literal = symbol < 256
    value[place[literal]] = symbol[literal]
    source = np.arange(total)
    step = np.arange(int(copied.sum())) - np.repeat(np.cumsum(copied) - copied, copied)
    to = np.repeat(at, copied) + step
    source[to] = np.repeat(at - distance, copied) + step % np.repeat(distance, copied)
    _follow(source, to)
    bare: set[int] = set()
    cached = np.flatnonzero(symbol >= 280)
    if len(cached):
        key = np.zeros(total, np.int64)
        for i, g in enumerate(group):
            if g.cache_bits:
                part = slice(origin[i], origin[i] + g.pixels)
                key[part] = _cache_keys(g.cache_bits, g.alpha)[value[part]]
        key[place[cached]] = symbol[cached].astype(np.int64) - 280
        key = key[source]
        # The latest sample with a key is what its place in the cache holds.
        latest = _latest(key, np.append(origin, total))[place[cached]]
        bare = set(owner[cached[latest < 0]].tolist())
        source[place[cached]] = np.where(latest < 0, place[cached], latest)
        _follow(source, np.arange(total))
    value = value[source]
    return [None if i in bare else value[o : o + g.pixels] for i, (o, g) in enumerate(zip(origin.tolist(), group, strict=True))]


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads: each text with zeros up to a positive multiple of 64 bytes."""
    sizes = np.diff(offs)
    room = np.maximum(-(-sizes // WIDTH), 1) * WIDTH
    to = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(int(to[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - offs[:-1], sizes)] = data
    return out, to


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation and share of zero samples, and the row with the largest mean; each with fixed digits."""
    rows = samples.reshape(-1, WIDTH)
    return f"mean={samples.mean():.4f};std={samples.std():.4f};zero={(samples == 0).mean():.6f};rows={len(rows)};peak={int(rows.sum(1, dtype=np.int64).argmax())}"


def encode_webp(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): each text stored as WebP."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text_buffer(b.column(1))
        media: list[bytes] = []
        for i, j in slices(offs, TOGETHER):
            media += encode_payloads(*padded(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_bytes long, media binary")


def decode_webp(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows (id, height, width, samples) with RGBA samples as bytes; null where the media is null or damaged."""
    kind = stored.schema[id_col].dataType.simpleString()

    def one(media: bytes | None) -> tuple:
        try:
            px = decode(media or b"")
            return px.shape[0], px.shape[1], px.tobytes()
        except (ValueError, IndexError, struct.error):
            return None, None, None

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [one(m.as_py()) for m in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.binary())], names=[id_col, "height", "width", "samples"])

    return map_batches(stored.select(id_col, media_col), run, f"{id_col} {kind}, height int, width int, samples binary")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as WebP, reads the stored bytes back and returns digests of both, in one pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text_buffer(b.column(1))
        rows: list[tuple] = []
        for i, j in slices(offs, TOGETHER):
            stored = encode_payloads(*padded(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
            files = [files_of(s) for s in stored]
            parts = iter(decode_samples([f for fs in files for f in fs]))
            for media, fs in zip(stored, files, strict=True):
                back = b"".join(next(parts) for _ in fs)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(np.frombuffer(back, np.uint8))))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
