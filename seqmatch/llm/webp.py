"""Lossless WebP (VP8L) in NumPy: a decoder for all of the format and an encoder that can use each of its tools.

Decoding a run of literals does not go bit by bit.  For every bit offset of the stream the length of the pixel that would
start there is looked up at once, the true starts are found by hopping from one to the next, and their colours are
then gathered in one step.  Only back-references and colour-cache hits are handled one at a time.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, COLOR_INDEX = range(4)
MAX_SIDE = 1 << 14
# Fixed values of the format.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_CACHE_FACTOR = np.uint32(0x1E35A7BD)
_N_LENGTHS, _N_DISTANCES, _SIGNATURE, _LONGEST = 24, 40, 0x2F, 4096
# The 120 short distances: neighbours to the left and above, nearest first.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
_NEAR_CODE = {p: i + 1 for i, p in enumerate(_NEAR)}
_BLACK = 0xFF000000
_reversed: dict[int, np.ndarray] = {}


class FormatError(ValueError):
    """Bytes that are not a lossless WebP image."""


def _reverse(bits: int) -> np.ndarray:
    if bits not in _reversed:
        x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for _ in range(bits):
            x, out = x >> 1, out << 1 | x & 1
        _reversed[bits] = out
    return _reversed[bits]


# ---------------------------------------------------------------- prefix codes


class Prefix:
    """A canonical prefix code as tables over the next ``bits`` bits of the stream."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.lengths = lengths
        if len(used) < 2:
            self.bits, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0]), np.zeros(1, np.uint8)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order].astype(np.int64)
        self.bits = int(size[-1])
        runs = 1 << (self.bits - size)
        if runs.sum() != 1 << self.bits:
            raise FormatError("prefix code is not complete")
        turn = _reverse(self.bits)
        self.symbol = np.repeat(order, runs)[turn]
        self.length = np.repeat(size, runs)[turn].astype(np.uint8)

    def codes(self) -> np.ndarray:
        """Each symbol's code, first bit lowest."""
        out, code, last = np.zeros(len(self.lengths), np.int64), 0, 0
        used = np.flatnonzero(self.lengths)
        if len(used) < 2:
            return out
        for s in used[np.argsort(self.lengths[used], kind="stable")].tolist():
            n = int(self.lengths[s])
            code <<= n - last
            out[s], last = _reverse(n)[code], n
            code += 1
        return out


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a Huffman code of at most ``most`` bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    floor = 0
    while True:
        heap = [(max(int(c), floor), i) for i, c in enumerate(counts[used].tolist())]
        heapq.heapify(heap)
        parent, free = {}, len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = free
            heapq.heapreplace(heap, (a + b, free))
            free += 1
        depth = [0] * free
        for i in range(free - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= most:
            out[used] = depth[: len(used)]
            return out
        floor = max(1, 2 * floor, int(counts.sum()) >> most)


# ---------------------------------------------------------------- reading


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bits(self, n: int) -> int:
        if not n:
            return 0
        first = self.at >> 3
        if self.at + n > 8 * len(self.data):
            raise FormatError("stream ends early")
        got = int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return got

    def symbol(self, code: Prefix) -> int:
        if not code.bits:
            return int(code.symbol[0])
        first = self.at >> 3
        ahead = int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7) & ((1 << code.bits) - 1)
        self.at += int(code.length[ahead])
        if self.at > 8 * len(self.data):
            raise FormatError("stream ends early")
        return int(code.symbol[ahead])

    def number(self, prefix: int) -> int:
        """A length or distance from its prefix symbol and extra bits."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.bits(extra) + 1

    def _prefix_slowly(self, code: Prefix, lengths: np.ndarray, left: int) -> Prefix:
        """Code lengths that are all one symbol, which then takes no bits."""
        i, s = 0, int(code.symbol[0])
        while i < len(lengths) and left:
            left -= 1
            run, value = (1, s) if s < 16 else (3 + self.bits(2), 8) if s == 16 else (3 + self.bits(3), 0) if s == 17 else (11 + self.bits(7), 0)
            if i + run > len(lengths):
                raise FormatError("code lengths run over")
            lengths[i : i + run] = value
            i += run
        return Prefix(lengths)

    def prefix(self, size: int) -> Prefix:
        lengths = np.zeros(size, np.int64)
        if self.bits(1):
            two, wide = self.bits(1), self.bits(1)
            for s in [self.bits(8 if wide else 1), *([self.bits(8)] if two else [])]:
                if s >= size:
                    raise FormatError("symbol out of range")
                lengths[s] = 1
            return Prefix(lengths)
        small = np.zeros(19, np.int64)
        for i in range(4 + self.bits(4)):
            small[_LENGTH_ORDER[i]] = self.bits(3)
        code = Prefix(small)
        left = 2 + self.bits(2 + 2 * self.bits(3)) if self.bits(1) else size
        if not code.bits:
            return self._prefix_slowly(code, lengths, left)
        # at most 7 + 7 bits for each symbol
        first, shift = self.at >> 3, self.at & 7
        ahead, used, total = int.from_bytes(self.data[first : first + 2 * size + 8], "little") >> shift, 0, 8 * len(self.data) - self.at
        symbol, width, mask = code.symbol.tolist(), code.length.tolist(), (1 << code.bits) - 1
        out: list[int] = []
        last = 8
        while len(out) < size and left:
            left -= 1
            at = ahead & mask
            s, n = symbol[at], width[at]
            if s < 16:
                out.append(s)
                last = s or last
            elif s == 16:
                out += [last] * (3 + (ahead >> n & 3))
                n += 2
            elif s == 17:
                out += [0] * (3 + (ahead >> n & 7))
                n += 3
            else:
                out += [0] * (11 + (ahead >> n & 127))
                n += 7
            ahead >>= n
            used += n
        if len(out) > size:
            raise FormatError("code lengths run over")
        if used > total:
            raise FormatError("stream ends early")
        self.at += used
        lengths[: len(out)] = out
        return Prefix(lengths)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


class _Pixels:
    """Colours that come in order, with the colour cache brought up to date when it is asked."""

    def __init__(self, total: int, cache_bits: int):
        self.out, self.n, self.bits, self.kept = np.zeros(total, np.uint32), 0, cache_bits, 0
        self.cache = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None

    def put(self, colours: np.ndarray) -> None:
        self.out[self.n : self.n + len(colours)] = colours
        self.n += len(colours)

    def copy(self, length: int, distance: int) -> None:
        if distance > self.n or self.n + length > len(self.out):
            raise FormatError("back-reference out of range")
        a = self.n - distance
        self.put(self.out[a : a + length] if distance >= length else np.resize(self.out[a : self.n], length))

    def cached(self, key: int) -> None:
        fresh = self.out[self.kept : self.n]
        if len(fresh):
            self.cache[(fresh * _CACHE_FACTOR) >> np.uint32(32 - self.bits)] = fresh  # the last one stays
        self.kept = self.n
        self.put(self.cache[key : key + 1])


def _colours(alpha, red, green, blue) -> np.ndarray:
    a, r, g, b = (np.asarray(x).astype(np.uint32) for x in (alpha, red, green, blue))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def _read_runs(r: Reader, codes: list[Prefix], px: _Pixels, width: int) -> None:
    """All pixels of an image with one group of prefix codes."""
    total, base = len(px.out), r.at & ~7
    green, red, blue, alpha, far = codes
    raw = np.frombuffer(r.data, np.uint8)[base >> 3 :]
    padded = np.concatenate([raw, np.zeros(12, np.uint8)]).astype(np.uint32)
    words = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    windows = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
    end = 8 * len(raw)

    def look(table: np.ndarray, code: Prefix, offsets) -> np.ndarray:
        return table[windows[offsets] & np.uint32((1 << code.bits) - 1)]

    literal = np.where(green.symbol < 256, green.length, 0).astype(np.uint8)
    size = look(literal, green, slice(0, end)).astype(np.int64)
    rest = [c for c in (red, blue, alpha) if c.bits]
    if rest:
        for c in rest:
            size = np.where(size > 0, size + look(c.length, c, np.minimum(np.arange(end) + size, end)), 0)
    hop = size.astype(np.uint8).tobytes()
    b, starts, n = r.at - base, [], px.n
    add = starts.append
    flushed = 0

    def flush(upto: int) -> None:
        nonlocal flushed
        p = np.array(starts[flushed:upto], np.int64)
        flushed = upto
        if not len(p):
            return
        g = look(green.symbol, green, p)
        p = p + look(green.length, green, p)
        got = []
        for c in (red, blue, alpha):
            got.append(look(c.symbol, c, p) if c.bits else np.full(len(p), c.symbol[0]))
            p = p + look(c.length, c, p) if c.bits else p
        px.put(_colours(got[2], got[0], g, got[1]))

    while n < total:
        try:
            for _ in range(total - n):
                step = hop[b]
                if not step:
                    break
                add(b)
                b += step
        except IndexError:
            raise FormatError("stream ends early") from None
        n = px.n + len(starts) - flushed
        if n >= total:
            break
        flush(len(starts))
        r.at = base + b
        s = r.symbol(green)
        if s < 256 + _N_LENGTHS:
            length = r.number(s - 256)
            px.copy(length, _distance(r.number(r.symbol(far)), width))
        else:
            px.cached(s - 256 - _N_LENGTHS)
        b, n = r.at - base, px.n
    flush(len(starts))
    if b > end:
        raise FormatError("stream ends early")
    r.at = base + b


def _read_slowly(r: Reader, group_of: np.ndarray | None, groups: list[list[Prefix]], px: _Pixels, width: int) -> None:
    """Pixel by pixel: for images with several groups, or with codes of no bits."""
    while px.n < len(px.out):
        green, red, blue, alpha, far = groups[int(group_of[px.n]) if group_of is not None else 0]
        s = r.symbol(green)
        if s < 256:
            red_, blue_, alpha_ = r.symbol(red), r.symbol(blue), r.symbol(alpha)
            px.put(np.array([alpha_ << 24 | red_ << 16 | s << 8 | blue_], np.uint32))
        elif s < 256 + _N_LENGTHS:
            length = r.number(s - 256)
            px.copy(length, _distance(r.number(r.symbol(far)), width))
        else:
            px.cached(s - 256 - _N_LENGTHS)


def _read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise FormatError("colour cache too large")
    group_of, n_groups = None, 1
    if main and r.bits(1):
        shift = r.bits(3) + 2
        across, down = -(-width >> shift), -(-height >> shift)
        meta = _read_image(r, across, down, False) >> np.uint32(8) & np.uint32(0xFFFF)
        n_groups = int(meta.max()) + 1
        group_of = meta.reshape(down, across)[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift].ravel()
    sizes = (256 + _N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, _N_DISTANCES)
    groups = [[r.prefix(s) for s in sizes] for _ in range(n_groups)]
    px = _Pixels(width * height, cache_bits)
    if n_groups == 1 and groups[0][0].bits:
        _read_runs(r, groups[0], px, width)
    elif n_groups == 1 and not any(c.bits for c in groups[0][:4]) and groups[0][0].symbol[0] < 256:
        g, d, b, a = (int(c.symbol[0]) for c in groups[0][:4])
        px.put(np.full(width * height, a << 24 | d << 16 | g << 8 | b, np.uint32))
    else:
        _read_slowly(r, group_of, groups, px, width)
    return px.out


# ---------------------------------------------------------------- transforms


def _split(argb: np.ndarray) -> np.ndarray:
    """Channels alpha, red, green, blue in the last axis, as int32."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _join(c: np.ndarray) -> np.ndarray:
    return _colours(*(c[..., i] & 255 for i in range(4)))


def _predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    half = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        by_left, by_top = np.abs(top - corner).sum(axis=-1, keepdims=True), np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(by_left < by_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        gap = mean - corner
        return np.clip(mean + np.where(gap < 0, -(-gap >> 1), gap >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), left.shape)


_LEFT_FREE = {0, 2, 3, 4, 8, 9}


def _predicted(c: np.ndarray, modes: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """Add (inverse) or subtract the prediction; modes that do not use the left pixel go a run at a time."""
    height, width, _ = c.shape
    out = c.copy() if inverse else np.empty_like(c)
    black = np.array([255, 0, 0, 0], np.int32)
    for y in range(height):
        row, src = (out[y], out) if inverse else (c[y], c)
        if y == 0:
            if inverse:
                start = (c[0, 0] + black) & 255
                out[0, 0] = start
                if width > 1:
                    out[0, 1:] = (np.cumsum(c[0, 1:], axis=0) + start) & 255
            else:
                out[0, 0] = (c[0, 0] - black) & 255
                out[0, 1:] = (c[0, 1:] - c[0, :-1]) & 255
            continue
        above = src[y - 1]
        if inverse:
            row[0] = (c[y, 0] + above[0]) & 255
        else:
            out[y, 0] = (c[y, 0] - above[0]) & 255
        x = 1
        while x < width:
            end = min(width, ((x >> shift) + 1) << shift)
            mode = int(modes[y >> shift, x >> shift])
            right = above[x + 1 : end + 1]
            if end == width:
                right = np.concatenate([right, row[:1]])
            if not inverse:
                out[y, x:end] = (c[y, x:end] - _predict(mode, row[x - 1 : end - 1], above[x:end], above[x - 1 : end - 1], right)) & 255
            elif mode in _LEFT_FREE:
                row[x:end] = (c[y, x:end] + _predict(mode, row[x - 1 : end - 1], above[x:end], above[x - 1 : end - 1], right)) & 255
            elif mode == 1:
                row[x:end] = (np.cumsum(c[y, x:end], axis=0) + row[x - 1]) & 255
            else:
                for i in range(x, end):
                    row[i] = (c[y, i] + _predict(mode, row[i - 1], above[i], above[i - 1], right[i - x])) & 255
            x = end
    return out


def _crossed(c: np.ndarray, elements: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """Undo (inverse) or make the cross-colour transform; an element has red_to_blue, green_to_blue, green_to_red."""
    height, width, _ = c.shape
    e = elements[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift]
    signed = lambda v: (v & 255) - ((v & 128) << 1)
    part = lambda t, v: (signed(t) * signed(v)) >> 5
    out, green = c.copy(), c[..., 2]
    sign = 1 if inverse else -1
    red = (c[..., 1] + sign * part(e[..., 3], green)) & 255
    out[..., 1] = red
    out[..., 3] = (c[..., 3] + sign * (part(e[..., 2], green) + part(e[..., 1], red if inverse else c[..., 1]))) & 255
    return out


def _bundle(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def unwrapped(data: bytes) -> bytes:
    """The stream of a file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise FormatError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    return data[20 : 20 + size]


def wrapped(body: bytes) -> bytes:
    """The file of a stream."""
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def size_of(r: Reader) -> tuple[int, int]:
    """Width and height, from the beginning of a stream."""
    if r.bits(8) != _SIGNATURE:
        raise FormatError("bad signature")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise FormatError("unknown version")
    return width, height


def decode(data: bytes) -> np.ndarray:
    """Pixels of one image as an array (height, width) of 0xAARRGGBB."""
    r = Reader(unwrapped(data))
    width, height = size_of(r)
    undo: list[tuple] = []
    across = width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            shift = r.bits(3) + 2
            w, h = -(-across >> shift), -(-height >> shift)
            undo.append((kind, across, shift, _read_image(r, w, h, False).reshape(h, w)))
        elif kind == COLOR_INDEX:
            n = r.bits(8) + 1
            table = _join(np.cumsum(_split(_read_image(r, n, 1, False)), axis=0))
            undo.append((kind, across, _bundle(n), table))
            across = -(-across >> _bundle(n))
        else:
            undo.append((kind, across, 0, None))
    return undone(_read_image(r, across, height, True).reshape(height, across), undo)


def undone(argb: np.ndarray, undo: list[tuple]) -> np.ndarray:
    """Pixels before the transforms (kind, width, shift or bundling, data), the last of them first."""
    for kind, wide, shift, extra in reversed(undo):
        if kind == SUBTRACT_GREEN:
            green = argb >> np.uint32(8) & np.uint32(255)
            redblue = (argb & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)
            argb = argb & np.uint32(0xFF00FF00) | redblue & np.uint32(0x00FF00FF)
        elif kind == COLOR_INDEX:
            green = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
            if shift:
                x, bits = np.arange(wide), 8 >> shift
                green = green[:, x >> shift] >> (bits * (x & ((1 << shift) - 1))) & ((1 << bits) - 1)
            argb = np.where(green < len(extra), extra[np.minimum(green, len(extra) - 1)], 0).astype(np.uint32)
        elif kind == PREDICTOR:
            argb = _join(_predicted(_split(argb), _split(extra)[..., 2] & 15, shift, True))
        else:
            argb = _join(_crossed(_split(argb), _split(extra), shift, True))
    return argb


# ---------------------------------------------------------------- writing


class Writer:
    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.value, self.n = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def _close(self) -> None:
        if self.n:
            raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, bitorder="little")[: self.n])
            self.value, self.n = 0, 0

    def many(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Append codes of the given sizes, each first bit lowest."""
        self._close()
        most = int(sizes.max()) if len(sizes) else 0
        if most:
            k = np.arange(most)
            self.parts.append(((codes[:, None] >> k) & 1).astype(np.uint8)[k < sizes[:, None]])

    def bytes(self) -> bytes:
        self._close()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes() if self.parts else b""

    def prefix(self, counts: np.ndarray) -> Prefix:
        """Write a code for symbols with these counts, and give it."""
        used = np.flatnonzero(counts).tolist()
        if len(used) <= 2 and all(s < 256 for s in used):
            used = used or [0]
            wide = used[0] > 1
            self.bits(1, 1)
            self.bits(len(used) - 1, 1)
            self.bits(int(wide), 1)
            self.bits(used[0], 8 if wide else 1)
            if len(used) == 2:
                self.bits(used[1], 8)
            lengths = np.zeros(len(counts), np.int64)
            lengths[used] = 1
            return Prefix(lengths)
        lengths = code_lengths(counts)
        tokens: list[tuple[int, int, int]] = []
        cuts = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
        for a, value, b in zip(cuts, lengths[cuts[:-1]].tolist(), cuts[1:], strict=False):
            run = b - a
            if value:
                tokens.append((value, 0, 0))
                run -= 1
            while run:
                take = min(run, 6 if value else 138)
                if take < 3:
                    tokens += [(value, 0, 0)] * take
                elif value:
                    tokens.append((16, take - 3, 2))
                else:
                    tokens.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
                run -= take
        kinds = np.bincount([t[0] for t in tokens], minlength=19)
        small = Prefix(code_lengths(kinds, 7))
        codes, sizes = small.codes(), small.lengths
        last = max(i for i, s in enumerate(_LENGTH_ORDER) if sizes[s])
        self.bits(0, 1)
        self.bits(max(0, last - 3), 4)
        for s in _LENGTH_ORDER[: max(4, last + 1)]:
            self.bits(int(sizes[s]), 3)
        self.bits(0, 1)
        width = sizes.tolist() if small.bits else [0] * 19
        code, value, at = codes.tolist(), 0, 0
        for s, extra, n in tokens:
            value |= (code[s] | extra << width[s]) << at
            at += width[s] + n
        self.bits(value, at)
        return Prefix(lengths)


def _as_prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


def _runs(argb: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Copies (place, length, distance 1) of the pixel before, for runs of ``least`` or more."""
    same = np.concatenate([[False], argb[1:] == argb[:-1], [False]])
    turn = np.flatnonzero(same[1:] != same[:-1]) + 1
    return [(a, n, 1) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True) for a, n in ((x, min(4096, b - x)) for x in range(a, b, 4096)) if n >= least]


def matches(argb: np.ndarray, lane: np.ndarray, place: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of copies of earlier pixels of the same image, none over another.

    ``lane`` numbers the image of each pixel, ``place`` the pixels of an image.  A place's partner is the last earlier
    one with the same three pixels; places in a row whose partners are in a row as well are one copy."""
    none = np.zeros(0, np.int64)
    total = len(argb)
    if total < 3:
        return none, none, none
    p = argb.astype(np.uint64)
    key = p[:-2] * np.uint64(0x9E3779B97F4A7C15) + p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:] * np.uint64(0x165667B19E3779F9)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    inside = np.flatnonzero(place[2:] >= 2)  # all three pixels are of one image
    packed = np.sort((key[inside] >> np.uint64(33) << np.uint64(32)).view(np.int64) ^ inside)
    order = packed & 0xFFFFFFFF
    a, b = order[:-1], order[1:]
    same = (packed[1:] >> 32 == packed[:-1] >> 32) & (lane[a] == lane[b])
    a, b = a[same], b[same]
    same = (argb[a] == argb[b]) & (argb[a + 1] == argb[b + 1]) & (argb[a + 2] == argb[b + 2])
    far = np.zeros(total, np.int64)
    far[b[same]] = (b - a)[same]
    cuts = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1], [True]]))
    start, end, far = cuts[:-1], cuts[1:], far[cuts[:-1]]
    start, end, far = start[far > 0], end[far > 0] + 2, far[far > 0]
    if not len(start):
        return none, none, none
    start = np.maximum(start, np.concatenate([[0], end[:-1]]))
    keep = end - start >= least
    start, length, far = start[keep], (end - start)[keep], far[keep]
    parts = -(-length // _LONGEST)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(start, parts) + nth * _LONGEST, np.minimum(_LONGEST, np.repeat(length, parts) - nth * _LONGEST), np.repeat(far, parts)


def _matches(argb: np.ndarray) -> list[tuple[int, int, int]]:
    found = matches(argb, np.zeros(len(argb), np.int32), np.arange(len(argb)))
    return list(zip(*(x.tolist() for x in found), strict=True))


def _write_image(w: Writer, argb: np.ndarray, width: int, main: bool, copies: list[tuple[int, int, int]] = (), cache_bits: int = 0, tiles: tuple[int, np.ndarray] | None = None) -> None:
    """Write pixels with the given copies; ``tiles`` (bits, group of each tile) makes several groups of codes."""
    argb = argb.ravel()
    w.bits(int(cache_bits > 0), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    group_of = np.zeros(len(argb), np.int64)
    n_groups = 1
    if main:
        w.bits(int(tiles is not None), 1)
        if tiles is not None:
            shift, groups = tiles
            w.bits(shift - 2, 3)
            _write_image(w, _colours(np.full(groups.size, 255), groups.ravel() >> 8, groups.ravel() & 255, np.zeros(groups.size)), groups.shape[1], False)
            n_groups, height = int(groups.max()) + 1, len(argb) // width
            group_of = groups[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift].ravel()
    c = _split(argb)
    literal, hits = np.ones(len(argb), bool), {}
    for a, n, _ in copies:
        literal[a : a + n] = False
    if cache_bits:
        cache = np.zeros(1 << cache_bits, np.uint32)
        keys = ((argb * _CACHE_FACTOR) >> np.uint32(32 - cache_bits)).tolist()
        for i, (k, v) in enumerate(zip(keys, argb.tolist(), strict=True)):
            if literal[i] and i and cache[k] == v:
                hits[i] = k
            cache[k] = v
        literal[list(hits)] = False
    size = 256 + _N_LENGTHS + (1 << cache_bits if cache_bits else 0)
    special = sorted([(a, "copy", n, d) for a, n, d in copies] + [(i, "hit", k, 0) for i, k in hits.items()])
    coded = []
    for a, kind, n, d in special:
        if kind == "hit":
            coded.append((a, 256 + _N_LENGTHS + n, (), ()))
        else:
            near = next((_NEAR_CODE[p] for p in ((d % width, d // width), (d % width - width, d // width + 1)) if p in _NEAR_CODE), None)
            length, far = _as_prefix(n), _as_prefix(near or d + 120)
            coded.append((a, 256 + length[0], length, far))
    all_codes = []
    for g in range(n_groups):
        mine = literal & (group_of == g)
        part = c if mine.all() else c[mine]
        counts = [np.bincount(part[:, ch], minlength=s) for ch, s in ((2, size), (1, 256), (3, 256), (0, 256))] + [np.zeros(_N_DISTANCES, np.int64)]
        for a, s, _, far in coded:
            if group_of[a] == g:
                counts[0][s] += 1
                if far:
                    counts[4][far[0]] += 1
        made = [w.prefix(k) for k in counts]
        all_codes.append([(p.codes(), p.lengths if p.bits else np.zeros_like(p.lengths)) for p in made])

    def literals(a: int, b: int) -> None:
        if a >= b:
            return
        if n_groups == 1:
            sets = [(all_codes[0], c[a:b])]
        else:
            cuts = [a, *(np.flatnonzero(np.diff(group_of[a:b])) + a + 1).tolist(), b]
            sets = [(all_codes[int(group_of[x])], c[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        for codes, part in sets:
            used = [(codes[i], part[:, ch]) for i, ch in ((0, 2), (1, 1), (2, 3), (3, 0)) if codes[i][1].any()]
            if len(used) == 1:
                w.many(used[0][0][0][used[0][1]], used[0][0][1][used[0][1]])
            elif used:
                w.many(np.stack([k[0][v] for k, v in used], axis=1).ravel(), np.stack([k[1][v] for k, v in used], axis=1).ravel())

    at = 0
    for a, s, length, far in coded:
        literals(at, a)
        codes = all_codes[int(group_of[a])]
        w.bits(int(codes[0][0][s]), int(codes[0][1][s]))
        at = a + 1
        if far:
            w.bits(length[1], length[2])
            w.bits(int(codes[4][0][far[0]]), int(codes[4][1][far[0]]))
            w.bits(far[1], far[2])
            at = a + next(n for x, n, _ in copies if x == a)
    literals(at, len(argb))


@dataclass
class Options:
    """What the encoder uses.  ``palette`` indexes colours where there are at most 256; ``predictor`` is a mode or an
    array of modes; ``cross`` is (red_to_blue, green_to_blue, green_to_red); ``copies`` is 'runs', 'all' or ''."""

    subtract_green: bool = False
    palette: bool = False
    predictor: int | np.ndarray | None = None
    cross: tuple[int, int, int] | None = None
    shift: int = 4
    cache_bits: int = 0
    copies: str = ""
    tiles: tuple[int, np.ndarray] | None = None
    least: int = field(default=16)


def encode(argb: np.ndarray, options: Options | None = None) -> bytes:
    """One image from an array (height, width) of 0xAARRGGBB."""
    o = options or Options()
    height, width = argb.shape
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("a side has 1 to 16384 pixels")
    w = Writer()
    w.bits(_SIGNATURE, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(int((argb >> np.uint32(24) != 255).any()), 1)
    w.bits(0, 3)
    if o.palette and len(table := np.unique(argb)) <= 256:
        w.bits(1, 1)
        w.bits(COLOR_INDEX, 2)
        w.bits(len(table) - 1, 8)
        _write_image(w, _join(np.diff(_split(table), axis=0, prepend=0)), len(table), False)
        index, shift = np.searchsorted(table, argb), _bundle(len(table))
        if shift:
            across, bits = -(-width >> shift), 8 >> shift
            index = np.pad(index, ((0, 0), (0, (across << shift) - width))).reshape(height, across, 1 << shift)
            index = (index << (bits * np.arange(1 << shift))).sum(axis=2)
            width = across
        argb = _colours(np.full(index.shape, 255), np.zeros(index.shape), index, np.zeros(index.shape))
    blocks = -(-height >> o.shift), -(-width >> o.shift)
    if o.predictor is not None:
        modes = np.broadcast_to(np.asarray(o.predictor), blocks)
        w.bits(1, 1)
        w.bits(PREDICTOR, 2)
        w.bits(o.shift - 2, 3)
        _write_image(w, _colours(np.full(blocks, 255), np.zeros(blocks), modes, np.zeros(blocks)), blocks[1], False)
        argb = _join(_predicted(_split(argb), modes, o.shift, False))
    if o.cross is not None:
        elements = np.broadcast_to(np.array([255, *o.cross], np.int32) & 255, (*blocks, 4))
        w.bits(1, 1)
        w.bits(CROSS_COLOR, 2)
        w.bits(o.shift - 2, 3)
        _write_image(w, _join(elements), blocks[1], False)
        argb = _join(_crossed(_split(argb), elements, o.shift, False))
    if o.subtract_green:
        w.bits(1, 1)
        w.bits(SUBTRACT_GREEN, 2)
        green = argb >> np.uint32(8) & np.uint32(255)
        argb = argb & np.uint32(0xFF00FF00) | ((argb >> np.uint32(16)) - green & np.uint32(255)) << np.uint32(16) | argb - green & np.uint32(255)
    w.bits(0, 1)
    flat = np.ascontiguousarray(argb).ravel()
    copies = _runs(flat, o.least) if o.copies == "runs" else _matches(flat) if o.copies == "all" else []
    _write_image(w, argb, width, True, copies, o.cache_bits, o.tiles)
    return wrapped(w.bytes())
