"""Lossless WebP for many small images at once.

Calls of NumPy on one image of a few thousand pixels cost more than the pixels do, so both directions work on all images
of a batch in lockstep, an image being a *lane*: one step merges two nodes of every lane's Huffman tree, reads one code
length of every lane's header, or one pixel of every lane's stream.  Lanes are ordered by size, so that those still at
work are always the first ones.

The encoder chooses for each image by the size that it estimates: no transform, subtract green, cross-colour with
multipliers fitted to the image, a predictor, or a palette; then a colour cache or none.  Copies of earlier pixels are
always looked for.  The decoder takes images that other encoders could have made; what has several groups of prefix
codes, a palette or codes of over MOST bits goes one by one through ``webp.decode``.
"""

from __future__ import annotations

import numpy as np

from . import webp
from .webp import _CACHE_FACTOR, _LENGTH_ORDER, _N_DISTANCES, _N_LENGTHS, _NEAR, _NEAR_CODE, COLOR_INDEX, CROSS_COLOR, PREDICTOR, SUBTRACT_GREEN, FormatError

MOST, MOST_CHANNEL, CACHE_BITS = 10, 9, 9
SAMPLE_ROWS = 4
SHIFT = 9
PLAIN, GREEN, CROSS, LEFT, TOP, PALETTE = range(6)
TOOLS = ("plain", "subtract_green", "cross_colour", "predictor_left", "predictor_top", "palette")
_CODE_LENGTHS = 256 + _N_LENGTHS
_CHECK = 256
_REPEAT = np.array([0] * 16 + [2, 3, 7])
U = np.uint64


_small = np.concatenate([[0.0], (k := np.arange(1.0, 1 << 13)) * np.log2(k)])


def _log2(counts: np.ndarray) -> np.ndarray:
    """counts * log2(counts) summed over the last axis."""
    if counts.size and counts.max() >= len(_small):
        large = np.maximum(counts, 1)
        return (large * np.log2(large)).sum(axis=-1)
    return _small[counts].sum(axis=-1)


def _sorted(lane: np.ndarray, key: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three columns in their own order; keys have 31 bits, symbols 12."""
    packed = np.sort(lane << 43 | key << 12 | symbol)
    return packed >> 43, packed >> 12 & 0x7FFFFFFF, packed & 0xFFF


# ---------------------------------------------------------------- prefix codes of many lanes


def huffman(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of at most ``most`` bits for each row of counts; a row with one symbol gets length 1 for it."""
    lanes, size = counts.shape
    out = np.zeros((lanes, size), np.uint8)
    shift = np.maximum(0, np.ceil(np.log2(np.maximum(1, counts.max(axis=1, initial=1)))).astype(np.int64) - 30)
    counts = np.maximum(counts >> shift[:, None], counts > 0)
    used = (counts > 0).sum(axis=1)
    out[(used == 1)[:, None] & (counts > 0)] = 1
    todo, floor = np.flatnonzero(used > 1), np.zeros(lanes, np.int64)
    while len(todo):
        now = np.where(counts[todo] > 0, np.maximum(counts[todo], floor[todo, None]), 0)
        made = _tree(now)
        ok = made.max(axis=1) <= most
        out[todo[ok]] = made[ok]
        todo = todo[~ok]
        floor[todo] = np.maximum(np.maximum(1, 2 * floor[todo]), counts[todo].sum(axis=1) >> most)
    return out


def _tree(counts: np.ndarray) -> np.ndarray:
    """Depths of the leaves of each row's Huffman tree; every row has two symbols or more."""
    lane, symbol = np.nonzero(counts)
    weight = counts[lane, symbol].astype(np.int64)
    n = np.bincount(lane, minlength=len(counts))
    lanes = np.argsort(-n, kind="stable")  # most symbols first
    place = np.empty_like(lanes)
    place[lanes] = np.arange(len(lanes))
    n = n[lanes]
    row, weight, symbol = _sorted(place[lane], weight, symbol)
    width = int(n[0]) + 2
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    leaf = np.full((len(n), width), 1 << 60, np.int64)
    leaf[row, nth] = weight
    node = np.full((len(n), width), 1 << 60, np.int64)
    leaf, node = leaf.ravel(), node.ravel()
    leaf_parent, node_parent = np.zeros(len(leaf), np.int32), np.zeros(len(node), np.int32)
    base = np.arange(len(n)) * width
    at_leaf, at_node = base.copy(), base.copy()
    active = [int(x) for x in np.searchsorted(-n, -np.arange(2, int(n[0]) + 1), side="right")]
    for j, a in enumerate(active):  # all rows with more than j + 1 symbols make their node j
        total = 0
        for _ in (0, 1):
            x, y = at_leaf[:a], at_node[:a]
            p, q = leaf[x], node[y]
            first = p <= q
            total = total + np.where(first, p, q)
            leaf_parent[x[first]] = j
            node_parent[y[~first]] = j
            at_leaf[:a] += first
            at_node[:a] += ~first
        node[base[:a] + j] = total
    depth = np.zeros(len(node), np.int32)
    for j in range(int(n[0]) - 3, -1, -1):
        a = active[j + 1]
        here = base[:a] + j
        depth[here] = depth[base[:a] + node_parent[here]] + 1
    here = row * width + nth
    out = np.zeros(counts.shape, np.uint8)
    out[lanes[row], symbol] = depth[row * width + leaf_parent[here]] + 1
    return out


def _reverse(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    v = values.copy()
    for _ in range(15):
        out = out << 1 | v & 1
        v >>= 1
    return out >> (15 - bits)


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of each row, first bit lowest; 0 where a row has one symbol only."""
    lane, symbol = np.nonzero(lengths)
    out = np.zeros(lengths.shape, np.int64)
    if not len(lane):
        return out
    lane, size, symbol = _sorted(lane, lengths[lane, symbol].astype(np.int64), symbol)
    room = 1 << (15 - size)
    before = np.cumsum(room) - room
    first = np.concatenate([[True], lane[1:] != lane[:-1]])
    before -= np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(lane))))
    out[lane, symbol] = _reverse(before >> (15 - size), size)
    return out


def tables(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(flat table, bits): entry lane << bits | next bits is symbol << 4 | length.  A row of one symbol takes no bits."""
    lanes = len(lengths)
    used = (lengths > 0).sum(axis=1)
    wide = np.where(used[:, None] > 1, lengths, 0)
    bits = int(wide.max()) if lanes else 0
    out = np.zeros((lanes, 1 << bits), np.uint16)
    single = np.flatnonzero(used <= 1)
    out[single] = (lengths[single].argmax(axis=1) << 4)[:, None]
    lane, symbol = np.nonzero(wide)
    if len(lane):
        lane, size, symbol = _sorted(lane, wide[lane, symbol].astype(np.int64), symbol)
        many = np.flatnonzero(used > 1)
        run = 1 << (bits - size)
        if (np.bincount(lane, weights=run, minlength=lanes)[many] != 1 << bits).any():
            raise FormatError("prefix code is not complete")
        filled = np.repeat((symbol << 4 | size).astype(np.uint16), run).reshape(len(many), -1)
        out[many] = filled[:, webp._reverse(bits)]
    return out.ravel(), bits


# ---------------------------------------------------------------- writing


class _Tokens:
    """Values of up to 63 bits of many lanes, in the order in which each lane writes them."""

    def __init__(self, lanes: int):
        self.lanes, self.lane, self.value, self.bits = lanes, [], [], []

    def put(self, lane: np.ndarray, value, bits) -> None:
        """``lane`` ascends; ``value`` and ``bits`` may be one number for all."""
        self.lane.append(lane.astype(np.uint16))
        self.value.append(np.broadcast_to(np.asarray(value), lane.shape).astype(U))
        self.bits.append(np.broadcast_to(np.asarray(bits), lane.shape).astype(np.uint8))

    def streams(self) -> list[bytes]:
        lane = np.concatenate(self.lane)
        order = np.argsort(lane, kind="stable")
        lane, value, bits = lane[order], np.concatenate(self.value)[order], np.concatenate(self.bits)[order].astype(np.int64)
        end = np.cumsum(bits)
        total = np.bincount(lane, weights=bits, minlength=self.lanes).astype(np.int64)
        words = (total + 63) // 64 + 1
        first = np.cumsum(words) - words
        at = end - bits + (64 * first - (np.cumsum(total) - total))[lane]
        out = np.zeros(int(words.sum()) + 1, U)
        shift = (at & 63).astype(U)
        np.add.at(out, at >> 6, value << shift)
        over = np.flatnonzero((at & 63) + bits > 64)
        np.add.at(out, (at[over] >> 6) + 1, value[over] >> (U(64) - shift[over]))
        raw = out.view(np.uint8)
        return [raw[8 * f : 8 * f + (t + 7) // 8].tobytes() for f, t in zip(first.tolist(), total.tolist(), strict=True)]


def _write_code(t: _Tokens, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for each lane's counts; codes and their lengths (0 where nothing needs to be written)."""
    lanes, size = counts.shape
    used = (counts > 0).sum(axis=1)
    lengths = huffman(counts, MOST if size > 256 else MOST_CHANNEL)
    simple = (used <= 2) & ~(counts[:, 256:] > 0).any(axis=1)
    mine = np.flatnonzero(simple)
    low = (counts[mine] > 0).argmax(axis=1)
    two = used[mine] == 2
    high = size - 1 - (counts[mine, ::-1] > 0).argmax(axis=1)
    t.put(mine, 1 | two << 1 | 1 << 2 | low << 3 | np.where(two, high, 0) << 11, np.where(two, 19, 11))
    mine = np.flatnonzero(~simple)
    if len(mine):
        _write_lengths(t, mine, lengths[mine])
    code = codes(lengths)
    return code, np.where(used[:, None] > 1, lengths, 0)


def _write_lengths(t: _Tokens, lanes: np.ndarray, lengths: np.ndarray) -> None:
    """Code lengths as runs, with a prefix code of their own."""
    n, size = lengths.shape
    flat = lengths.ravel().astype(np.int64)
    edge = np.ones(len(flat), bool)
    edge[1:] = flat[1:] != flat[:-1]
    edge[::size] = True
    first = np.flatnonzero(edge)
    run, value, row = np.diff(np.append(first, len(flat))), flat[first], first // size
    # a run of zeros is blocks of 138 and a rest; any other run one length, blocks of 6 and a rest; rests under 3 are spelled out
    block = np.where(value == 0, 138, 6)
    body = np.where(value == 0, run, run - 1)
    full, rest = body // block, body % block
    parts = (value > 0) + full + np.where(rest >= 3, 1, rest)
    of = np.repeat(np.arange(len(run)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    head = (value[of] > 0) & (k == 0)
    k = k - (value[of] > 0)
    amount = np.where(k < full[of], block[of], rest[of])
    spelled = head | (amount < 3)
    zero = value[of] == 0
    kind = np.where(spelled, value[of], np.where(zero, np.where(amount >= 11, 18, 17), 16))
    extra = np.where(spelled, 0, np.where(kind == 18, amount - 11, amount - 3))
    more = np.where(spelled, 0, np.choose(np.clip(kind - 16, 0, 2), [2, 3, 7]))
    of_row = row[of]
    counts = np.bincount(of_row * 19 + kind, minlength=19 * n).reshape(n, 19)
    small = huffman(counts, 7)
    code = codes(small)
    ordered = small[:, list(_LENGTH_ORDER)]
    last = 19 - (ordered[:, ::-1] > 0).argmax(axis=1)
    stored = np.maximum(last, 4)
    t.put(lanes, (stored - 4) << 1, 5)
    shifts = 3 * np.arange(19)
    t.put(lanes, (ordered.astype(np.int64) << shifts).sum(axis=1), 3 * stored)
    t.put(lanes, 0, 1)
    width = np.where((small > 0).sum(axis=1)[:, None] > 1, small, 0)[of_row, kind].astype(np.int64)
    t.put(lanes[of_row], code[of_row, kind] | extra << width, width + more)


def _as_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and extra bits of lengths or distances from 1."""
    v = value - 1
    high = np.maximum(1, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64))
    second = v >> (high - 1) & 1
    small = v < 4
    return np.where(small, v, 2 * high + second), np.where(small, 0, v - ((2 + second) << (high - 1))), np.where(small, 0, high - 1)


def _near_codes(width: int) -> np.ndarray:
    """Code of each distance that a neighbour has, 0 for others."""
    out = np.zeros(8 * width + 16, np.int64)
    for (x, y), c in sorted(_NEAR_CODE.items(), key=lambda p: -p[1]):
        if x + y * width >= 1:
            out[x + y * width] = c
    return out


class Batch:
    """Pixels of many images of one width, one image after the other, as channels red, green and blue."""

    def __init__(self, images: list[np.ndarray], width: int):
        """``images``: arrays of bytes, three for each pixel, a multiple of 3 * width each."""
        self.lanes, self.width = len(images), width
        raw = np.concatenate(images)
        self.red, self.green, self.blue = (raw[i::3].astype(np.int32) for i in range(3))
        self.n = np.array([len(x) // 3 for x in images])
        self.first = np.cumsum(self.n) - self.n
        self.lane = np.repeat(np.arange(self.lanes, dtype=np.int32), self.n)
        self.place = np.arange(len(self.lane), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.n)

    def _left_of(self, at: np.ndarray, place: np.ndarray, mode: int) -> np.ndarray:
        """Where the predictor ``mode`` (1 left, 2 top) of the places ``at`` looks: the first row has left, the first column
        top neighbours, the first pixel (-1) none."""
        left = (place % self.width > 0) & ((place < self.width) if mode == 2 else True)
        return np.where(place == 0, -1, np.where(left, at - 1, at - self.width))

    def choose(self, literal: np.ndarray) -> np.ndarray:
        """The transform of each image, and its channels put in place of the pixels.

        Sizes are estimated for the pixels that are no copies, from SAMPLE_ROWS rows or a little more of each image at equal
        distances: entropy, and some bits for the code of each symbol."""
        height = self.n // self.width
        step = np.maximum(1, height // SAMPLE_ROWS).astype(np.int32)
        at = np.flatnonzero(literal & (self.place // self.width % step[self.lane] == 0))
        total = np.add.reduceat(literal, self.first, dtype=np.int64)
        lane, place = self.lane[at], self.place[at]
        n = np.bincount(lane, minlength=self.lanes)
        base, whole, scale = lane.astype(np.int64) * 256, n * np.log2(n), total / n
        r, g, b = (c[at] for c in (self.red, self.green, self.blue))
        signed = lambda v: (v ^ 128) - 128
        sg, first = signed(g), np.cumsum(n) - n
        mean = lambda v: np.add.reduceat(v, first, dtype=np.int64) / n
        middle = mean(sg)
        spread = np.maximum(mean(sg * sg) - middle**2, 1e-9)
        self.cross = [np.clip(np.rint(32 * (mean(sg * s) - middle * mean(s)) / spread), -128, 127).astype(np.int32) for s in (signed(r), signed(b))]

        def bits(*channels: np.ndarray) -> np.ndarray:
            out = np.zeros(self.lanes)
            for c in channels:
                counts = np.bincount(base + (c & 255), minlength=256 * self.lanes).reshape(self.lanes, 256)
                out += scale * (whole - _log2(counts)) + 4.0 * (counts > 0).sum(axis=1)
            return out

        sizes = [bits(r, g, b), bits(r - g, g, b - g) + 3, bits(*(c - (m[lane] * sg >> 5) if m is not None else c for c, m in zip((r, g, b), (self.cross[0], None, self.cross[1]), strict=True))) + 62]
        for mode in (1, 2):
            by = self._left_of(at, place, mode)
            sizes.append(bits(*(c[at] - np.where(by < 0, 0, c[by]) for c in (self.red, self.green, self.blue))) + 62)
        # a palette: its colours' own entropy, and that of their numbers
        colour = np.sort((self.lane.astype(np.int64) << 24 | self.red << 16 | self.green << 8 | self.blue)[literal])
        edge = np.flatnonzero(np.concatenate([[True], colour[1:] != colour[:-1], [True]]))
        table, times = colour[edge[:-1]], np.diff(edge)
        of = table >> 24
        colours = np.bincount(of, minlength=self.lanes)
        few = colours <= 256
        keep = few[of]
        table, times, of = table[keep], times[keep], of[keep]
        number = total * np.log2(total) - np.bincount(of, weights=times * np.log2(times), minlength=self.lanes)
        for s in (0, 8, 16):
            counts = np.bincount(of * 256 + (table >> s & 255), minlength=256 * self.lanes).reshape(self.lanes, 256)
            number += colours * np.log2(colours) - _log2(counts) + 4.0 * (counts > 0).sum(axis=1)
        sizes.append(np.where(few, number + 4.0 * colours + 150, np.inf))
        self.tool = tool = np.argmin(np.stack(sizes), axis=0)
        self._transform(GREEN, lambda r, g, b, at: (r - g, g, b - g))
        self._transform(CROSS, lambda r, g, b, at: (r - (self.cross[0][self.lane[at]] * signed(g) >> 5), g, b - (self.cross[1][self.lane[at]] * signed(g) >> 5)))
        whole = self.red, self.green, self.blue
        for mode, kind in ((1, LEFT), (2, TOP)):
            self._transform(kind, lambda r, g, b, at, mode=mode: tuple(c[at] - np.where((by := self._left_of(at, self.place[at], mode)) < 0, 0, c[by]) for c in whole))
        return tool

    def _transform(self, kind: int, change) -> None:
        if not (self.tool == kind).any():
            return
        at = np.flatnonzero((self.tool == kind)[self.lane])
        made = change(self.red[at], self.green[at], self.blue[at], at)
        self.red, self.green, self.blue = (c.copy() for c in (self.red, self.green, self.blue))
        for c, m in zip((self.red, self.green, self.blue), made, strict=True):
            c[at] = m & 255

    def _literal(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which pixels no copy covers."""
        step = np.zeros(len(self.lane) + 1, np.int8)
        step[start] += 1
        np.add.at(step, start + length, -1)
        return np.cumsum(step[:-1], dtype=np.int8) == 0

    def hits(self, argb: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the colour cache of each lane's bits holds the pixel, and under which number."""
        key = ((argb * _CACHE_FACTOR) >> (32 - bits).astype(np.uint32)[self.lane]).astype(np.int32)
        packed = np.sort(self.lane.astype(np.int64) << 42 | key.astype(np.int64) << 31 | np.arange(len(argb)))
        order, group = packed & 0x7FFFFFFF, packed >> 31
        same = np.zeros(len(argb), bool)
        same[order[1:]] = (group[1:] == group[:-1]) & (argb[order[1:]] == argb[order[:-1]])
        return same, key

    def encode(self) -> list[bytes]:
        """Files of all images; those with the palette are made one by one."""
        before = self.red, self.green, self.blue
        argb = np.uint32(0xFF000000) | (self.red << 16 | self.green << 8 | self.blue).astype(np.uint32)
        start, length, far = webp.matches(argb, self.lane, self.place)
        tool = self.choose(self._literal(start, length))
        # a predictor leaves alpha 0, as every pixel's prediction, the first one's black too, is opaque
        predicted = (tool == LEFT) | (tool == TOP)
        alpha = np.where(predicted, 0, 255)
        argb = np.where(predicted, 0, 0xFF000000).astype(np.uint32)[self.lane] | (self.red << 16 | self.green << 8 | self.blue).astype(np.uint32)
        if predicted.any():  # the other transforms keep equal pixels equal
            start, length, far = webp.matches(argb, self.lane, self.place)
        literal = self._literal(start, length)
        # a cache of about half as many colours as there are pixels, or none
        cache_bits = np.clip(np.ceil(np.log2(self.n)).astype(np.int64) - 1, 4, CACHE_BITS)
        hit, key = self.hits(argb, cache_bits)
        hit &= literal
        wide, slots = _CODE_LENGTHS + (1 << CACHE_BITS), 1 << CACHE_BITS

        def counted(at: np.ndarray, c: np.ndarray, size: int = 256) -> np.ndarray:
            return np.bincount(self.lane[at].astype(np.int64) * size + c[at], minlength=size * self.lanes).reshape(self.lanes, size)

        def size(*counts: np.ndarray) -> np.ndarray:
            out = np.zeros(self.lanes)
            for c in counts:
                total = c.sum(axis=1)
                out += total * np.log2(np.maximum(total, 1)) - _log2(c) + 4.0 * (c > 0).sum(axis=1)
            return out

        at = np.flatnonzero(literal)
        every_way = [counted(at, c) for c in (self.green, self.red, self.blue)]
        at = np.flatnonzero(hit)
        hits = counted(at, key, slots)
        with_cache = [x - counted(at, c) for x, c in zip(every_way, (self.green, self.red, self.blue), strict=True)]
        cached = size(np.concatenate([with_cache[0], hits], axis=1), *with_cache[1:]) < size(*every_way)
        cache_bits = np.where(cached, cache_bits, 0)
        hit &= cached[self.lane]
        plain = literal & ~hit
        self.cached = cached
        green = np.zeros((self.lanes, wide), np.int64)
        green[:, :256], red, blue = (np.where(cached[:, None], x, y) for x, y in zip(with_cache, every_way, strict=True))
        green[:, _CODE_LENGTHS:] = np.where(cached[:, None], hits, 0)
        near = _near_codes(self.width)
        coded = np.where(far < len(near), near[np.minimum(far, len(near) - 1)], 0)
        coded = np.where(coded > 0, coded, far + 120)
        l_sym, l_extra, l_bits = _as_prefix(length)
        d_sym, d_extra, d_bits = _as_prefix(coded)
        of = self.lane[start].astype(np.int64)
        np.add.at(green, (of, 256 + l_sym), 1)
        distance = np.bincount(of * _N_DISTANCES + d_sym, minlength=_N_DISTANCES * self.lanes).reshape(self.lanes, _N_DISTANCES)

        t, every = _Tokens(self.lanes), np.arange(self.lanes)
        height = self.n // self.width
        t.put(every, webp._SIGNATURE | (self.width - 1) << 8 | (height - 1) << 22, 40)
        one = lambda s: 1 | 1 << 2 | np.asarray(s, np.int64) << 3  # noqa: E731  a code of one symbol, 11 bits
        only = np.flatnonzero(tool == GREEN)
        t.put(only, 1 | SUBTRACT_GREEN << 1, 3)
        only = np.flatnonzero(predicted)
        t.put(only, 1 | PREDICTOR << 1 | (SHIFT - 2) << 3, 7)
        mode = np.where(tool[only] == LEFT, 1, 2)
        t.put(only, one(mode) | one(0) << 11 | one(0) << 22 | one(255) << 33 | one(0) << 44, 55)
        only = np.flatnonzero(tool == CROSS)
        t.put(only, 1 | CROSS_COLOR << 1 | (SHIFT - 2) << 3, 7)
        to_red, to_blue = (m[only].astype(np.int64) & 255 for m in self.cross)
        t.put(only, one(to_blue) | one(0) << 11 | one(to_red) << 22 | one(255) << 33 | one(0) << 44, 55)
        t.put(every, np.where(cached, 1 << 1 | cache_bits << 2, 0), np.where(cached, 7, 3))
        # the alphabet ends with the lane's cache, so lanes of one size are written together
        g_code, g_size = np.zeros(green.shape, np.int64), np.zeros(green.shape, np.uint8)
        for bits in np.unique(cache_bits).tolist():
            mine = np.flatnonzero(cache_bits == bits)
            end = _CODE_LENGTHS + (1 << bits if bits else 0)
            part = _Tokens(self.lanes)
            c, s = _write_code(part, green[mine, :end])
            g_code[mine, :end], g_size[mine, :end] = c, s
            for lane, value, n in zip(part.lane, part.value, part.bits, strict=True):
                t.put(mine[lane], value, n)
        r_code, r_size = _write_code(t, red)
        b_code, b_size = _write_code(t, blue)
        alphas = np.zeros((self.lanes, 256), np.int64)
        alphas[every, alpha] = 1
        _write_code(t, alphas)
        d_code, d_size = _write_code(t, distance)

        value, bits = np.zeros(len(argb), np.int64), np.zeros(len(argb), np.uint8)
        at = np.flatnonzero(plain)
        lane = self.lane[at].astype(np.int64)
        g, r, b = lane * wide + self.green[at], lane * 256 + self.red[at], lane * 256 + self.blue[at]
        w1, w2 = g_size.ravel()[g], r_size.ravel()[r]
        w2 = w1 + w2
        value[at] = g_code.ravel()[g] | r_code.ravel()[r] << w1 | b_code.ravel()[b] << w2
        bits[at] = w2 + b_size.ravel()[b]
        at = np.flatnonzero(hit)
        g = self.lane[at].astype(np.int64) * wide + _CODE_LENGTHS + key[at]
        value[at], bits[at] = g_code.ravel()[g], g_size.ravel()[g]
        s = 256 + l_sym
        w1 = g_size[of, s].astype(np.int64)
        w2 = w1 + l_bits
        w3 = w2 + d_size[of, d_sym]
        value[start] = g_code[of, s] | l_extra << w1 | d_code[of, d_sym] << w2 | d_extra << w3
        bits[start] = w3 + d_bits
        told = np.ones(len(argb), bool)
        told[~literal] = False
        told[start] = True
        t.put(self.lane[told], value[told], bits[told])
        bodies = t.streams()
        out = [webp.wrapped(x) for x in bodies]
        for i in np.flatnonzero(tool == PALETTE).tolist():
            a, z = int(self.first[i]), int(self.first[i] + self.n[i])
            px = webp._colours(np.full(z - a, 255), *(c[a:z] for c in before)).reshape(-1, self.width)
            out[i] = webp.encode(px, webp.Options(palette=True, copies="all"))
        return out


# ---------------------------------------------------------------- reading


class _Lanes:
    """Bit streams of many lanes in one buffer: ``take`` reads from some of them and moves on."""

    def __init__(self, streams: list[bytes], at: np.ndarray):
        size = np.array([len(s) for s in streams])
        first = np.cumsum(size) - size
        raw = np.frombuffer(b"".join([*streams, bytes(32 * _CHECK)]), np.uint8)
        self.words = np.ndarray((len(raw) // 4 - 2,), "<i8", raw, strides=(4,)).copy()
        self.at, self.end = 8 * first + at, 8 * (first + size)

    def look(self, which) -> np.ndarray:
        """The next bits, 33 of them right."""
        p = self.at[which]
        return self.words[p >> 5] >> (p & 31)

    def take(self, which, bits) -> np.ndarray:
        """``bits`` (a number or one for each lane, 32 at most) of the lanes ``which``."""
        got = self.look(which) & ((1 << bits) - 1)
        self.at[which] += bits
        return got

    def check(self) -> None:
        if (self.at > self.end).any():
            raise FormatError("stream ends early")


def _read_lengths(s: _Lanes, lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code lengths of the next prefix code of each lane; ``sizes`` are the alphabets'."""
    out = np.zeros((len(lanes), int(sizes.max())), np.uint8)
    simple = s.take(lanes, 1) == 1
    mine = np.flatnonzero(simple)
    if len(mine):
        where = lanes[mine]
        two, wide = s.take(where, 1), s.take(where, 1)
        low = s.take(where, np.where(wide, 8, 1))
        high = s.take(where, np.where(two, 8, 0))
        if (low >= sizes[mine]).any() or (high >= sizes[mine]).any():
            raise FormatError("symbol out of range")
        out[mine, low] = 1
        out[mine[two == 1], high[two == 1]] = 1
    mine = np.flatnonzero(~simple)
    if not len(mine):
        return out
    where, size = lanes[mine], sizes[mine]
    n = 4 + s.take(where, 4)
    small = np.zeros((len(mine), 19), np.uint8)
    for i, symbol in enumerate(_LENGTH_ORDER):
        has = np.flatnonzero(i < n)
        small[has, symbol] = s.take(where[has], 3)
    table, bits = tables(small)
    limited = s.take(where, 1)
    wide = s.take(where, np.where(limited, 3, 0))
    left = np.where(limited, 2 + s.take(where, np.where(limited, 2 + 2 * wide, 0)), size)
    at, last = np.zeros(len(mine), np.int64), np.full(len(mine), 8)
    told: list[tuple[np.ndarray, ...]] = []
    live, step = np.arange(len(mine)), 0
    mask = (1 << bits) - 1
    while True:
        live = live[(at[live] < size[live]) & (left[live] > 0)]
        if not len(live):
            break
        ahead = s.look(where[live])
        got = table[live << bits | ahead & mask].astype(np.int64)
        kind, used = got >> 4, got & 15
        more = _REPEAT[kind]
        extra = ahead >> used & ((1 << more) - 1)
        run = np.where(kind < 16, 1, extra + np.where(kind == 18, 11, 3))
        value = np.where(kind < 16, kind, np.where(kind == 16, last[live], 0))
        s.at[where[live]] += used + more
        set_ = np.flatnonzero(value)
        told.append((live[set_], at[live[set_]], run[set_], value[set_]))
        last[live] = np.where((kind < 16) & (kind > 0), kind, last[live])
        at[live] += run
        left[live] -= 1
        step += 1
        if not step % _CHECK:
            s.check()
    if (at > size).any():
        raise FormatError("code lengths run over")
    row, first, run, value = (np.concatenate(x) for x in zip(*told, strict=True))
    nth = np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run)
    out[mine[np.repeat(row, run)], np.repeat(first, run) + nth] = np.repeat(value, run)
    return out


def _number(s: _Lanes, lanes: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Lengths or distances from their prefix symbols and extra bits."""
    extra = np.maximum(0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + s.take(lanes, extra) + 1)


def _pixels(s: _Lanes, n: np.ndarray, width: np.ndarray, cache_bits: np.ndarray) -> list[np.ndarray]:
    """All pixels of each lane; lanes come with most pixels first."""
    lanes = np.arange(len(n))
    sizes = [_CODE_LENGTHS + np.where(cache_bits > 0, 1 << cache_bits, 0), *(np.full(len(n), k) for k in (256, 256, 256, _N_DISTANCES))]
    read = [_read_lengths(s, lanes, k) for k in sizes]
    s.check()
    if max(int(x.max()) for x in read) > MOST:
        raise OverflowError
    (green, g_bits), (red, r_bits), (blue, b_bits), (alpha, a_bits), (far, d_bits) = (tables(x) for x in read)
    g_mask, r_mask, b_mask, a_mask, d_mask = ((1 << x) - 1 for x in (g_bits, r_bits, b_bits, a_bits, d_bits))
    near_x, near_y = (np.array([0, *(p[i] for p in _NEAR)]) for i in (0, 1))
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint32)
    caching = bool(cache_bits.any())
    slots = np.maximum(2, 1 << cache_bits)
    cache_at = np.cumsum(slots) - slots
    cache = np.zeros(int(slots.sum()), np.uint32)
    cache_shift = np.where(cache_bits > 0, 32 - cache_bits, 31).astype(np.uint32)
    left, back = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    g_base, r_base, b_base, a_base, d_base = (lanes << x for x in (g_bits, r_bits, b_bits, a_bits, d_bits))
    constant = alpha.astype(np.int64) >> 4 << 24 if not a_bits else None
    live = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist() if len(n) else []
    copying = 0  # the last step at which some lane copies
    at, words = s.at, s.words
    for t, a in enumerate(live):
        p = at[:a]
        w = words[p >> 5] >> (p & 31)
        e = green[g_base[:a] + (w & g_mask)].astype(np.int64)
        used = e & 15
        w >>= used
        x = red[r_base[:a] + (w & r_mask)].astype(np.int64)
        size = x & 15
        w >>= size
        y = blue[b_base[:a] + (w & b_mask)].astype(np.int64)
        size += y & 15
        colour = (x >> 4 << 16) + (e >> 4 << 8) + (y >> 4)
        if constant is None:
            p = p + used + size
            z = alpha[a_base[:a] + (words[p >> 5] >> (p & 31) & a_mask)].astype(np.int64)
            p = at[:a]
            size += z & 15
            colour += z >> 4 << 24
        else:
            colour += constant[:a]
        special = np.flatnonzero(e >= 4096)
        size[special] = 0
        used += size
        colour = colour.astype(np.uint32)
        if copying >= t:
            busy = np.flatnonzero(left[:a] > t)
            used[busy] = 0
            special = special[left[special] <= t]
            colour[busy] = out[first[busy] + t - back[busy]]
        p += used
        if len(special):
            kind = e[special] >> 4
            kept = kind >= _CODE_LENGTHS
            hit = special[kept]
            colour[hit] = cache[cache_at[hit] + kind[kept] - _CODE_LENGTHS]
            if len(hit) < len(special):
                which = special[~kept]
                length = _number(s, which, kind[~kept] - 256)
                e = far[d_base[which] + (s.look(which) & d_mask)].astype(np.int64)
                at[which] += e & 15
                code = _number(s, which, e >> 4)
                place = np.minimum(code, 120)
                by = np.where(code > 120, code - 120, np.maximum(1, near_x[place] + near_y[place] * width[which]))
                until = t + length
                if (by > t).any() or (until > n[which]).any():
                    raise FormatError("back-reference out of range")
                left[which], back[which] = until, by
                copying = max(copying, int(until.max()) - 1)
                colour[which] = out[first[which] + t - by]
        out[first[:a] + t] = colour
        if caching:
            cache[cache_at[:a] + ((colour * _CACHE_FACTOR) >> cache_shift[:a])] = colour
        if not t % _CHECK:
            s.check()
    s.check()
    return np.split(out, first[1:])


def pixels_of(data: bytes) -> int:
    """How many pixels a file's first bytes tell of."""
    both = int.from_bytes(data[21:25], "little")
    return ((both & 0x3FFF) + 1) * ((both >> 14 & 0x3FFF) + 1)


def _header(data: bytes) -> tuple[bytes, int, int, int, int, list[tuple]] | None:
    """Stream, first bit of the pixels' prefix codes, width, height, cache bits and transforms; None if not for lockstep."""
    body = webp.unwrapped(data)
    r = webp.Reader(body)
    width, height = webp.size_of(r)
    undo: list[tuple] = []
    while r.bits(1):
        kind = r.bits(2)
        if kind == COLOR_INDEX:
            return None
        if kind == SUBTRACT_GREEN:
            undo.append((kind, width, 0, None))
        else:
            shift = r.bits(3) + 2
            w, h = -(-width >> shift), -(-height >> shift)
            undo.append((kind, width, shift, webp._read_image(r, w, h, False).reshape(h, w)))
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise FormatError("colour cache too large")
    if r.bits(1):
        return None
    return body, r.at, width, height, cache_bits, undo


def decode(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of each image as an array (height, width) of 0xAARRGGBB."""
    out: list[np.ndarray | None] = [None] * len(files)
    heads = [_header(f) for f in files]
    lanes = sorted((i for i, h in enumerate(heads) if h), key=lambda i: -heads[i][2] * heads[i][3])
    if lanes:
        mine = [heads[i] for i in lanes]
        n, width, bits = (np.array(x) for x in ([h[2] * h[3] for h in mine], [h[2] for h in mine], [h[4] for h in mine]))
        try:
            pixels = _pixels(_Lanes([h[0] for h in mine], np.array([h[1] for h in mine])), n, width, bits)
        except OverflowError:
            pixels = None
        if pixels is not None:
            for i, h, px in zip(lanes, mine, pixels, strict=True):
                out[i] = webp.undone(px.reshape(h[3], h[2]), h[5])
    return [webp.decode(f) if px is None else px for f, px in zip(files, out, strict=True)]
