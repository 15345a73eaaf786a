"""Lossless WebP: a decoder for the whole bit stream, and an encoder that stores bytes in it.

Texts are kept as images 16 pixels wide: four bytes make a pixel's green, red, blue and alpha. The encoder
takes back-references to equal pixels, chooses by estimated size among no transform, the predictor (left or top), cross-colour, subtract-green
and palette transforms, and the colour cache or none, and gives each channel a Huffman code. The decoder inverts all of these; it also reads meta prefix codes
and transforms that other encoders write.

Most texts are short, so both sides work on many images at once: the encoder keeps a group of images in arrays and builds the codes of several groups
side by side, the decoder reads the symbols of a slice's images in step, but for the ``ALONE`` largest, and follows copies and cache afterwards.
An image's bytes do not hang on what stands beside it.

Null and empty texts are stored as one block of zeros; other columns are ignored; repeated rows give equal rows; an empty table gives none;
null and repeated doc_ids are kept; payloads over ``IMAGE_BYTES`` go to several images, one after the other, so texts of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

WIDTH, IMAGE_BYTES, PAD = 16, 1 << 20, 64
#: Bytes of texts that a task stores at a time, unless one text is longer.
SLICE_BYTES = 8 << 20
#: Fixed values of the format: order of code lengths, and the first 120 distances as (x, y) steps.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)


def near_distances() -> list[tuple[int, int]]:
    """(dx, dy) of the distance codes 1..120, by rule: nearest first, then the row above before the left, right before left."""
    spots = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(spots, key=lambda s: (s[0] * s[0] + s[1] * s[1], abs(s[0]), s[1] == 0 and 1, -s[0]))


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        p = self.at
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        return int.from_bytes(self.data[p >> 3:(p >> 3) + 5], "little") >> (p & 7) & (1 << n) - 1

    def array(self, n: int) -> np.ndarray:
        p = self.at
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        raw = np.frombuffer(self.data, np.uint8, ((p + n + 7) >> 3) - (p >> 3), p >> 3)
        return np.unpackbits(raw, bitorder="little")[p & 7:(p & 7) + n]


class Prefix:
    """A canonical prefix code; ``only`` is the symbol of a code without bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        self.even, self.symbols, self.table = 0, used, None
        if self.only is None:
            sizes = lengths[used]
            if (2.0 ** -sizes.astype(float)).sum() != 1:
                raise ValueError("a prefix code is not complete")
            if sizes.min() == sizes.max():
                self.even = int(sizes[0])
            self.lengths = lengths

    def build(self) -> dict[tuple[int, int], int]:
        if self.table is None:
            self.table, code = {}, 0
            for size in range(1, 16):
                for s in np.flatnonzero(self.lengths == size):
                    self.table[size, code] = int(s)
                    code += 1
                code <<= 1
        return self.table

    def windows(self, most: int, shift: int) -> memoryview:
        """By the next ``most`` bits, the first one highest: the symbol, shifted, times 16, and its length."""
        if self.only is not None:
            return memoryview(np.full(1 << most, self.only << shift + 4))
        sizes = self.lengths[self.symbols]
        order = np.argsort(sizes, kind="stable")
        return memoryview(np.repeat(self.symbols[order] << shift + 4 | sizes[order], 1 << (most - sizes[order])))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        table, code = self.build(), 0
        for size in range(1, 16):
            code = code << 1 | bits.take(1)
            if (size, code) in table:
                return table[size, code]
        raise ValueError("no such prefix code")


REVERSED = [int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)]


REVERSE = np.array(REVERSED)


def _places(sizes: np.ndarray) -> np.ndarray:
    """For runs so long, one after the other: each member's place in its run."""
    return np.arange(int(sizes.sum())) - np.repeat(sizes.cumsum() - sizes, sizes)


def _before(key: np.ndarray) -> np.ndarray:
    """The last place before with an equal key of 43 bits, or -1."""
    key = np.sort(key << 20 | np.arange(len(key)))
    place = key & (1 << 20) - 1
    same = key[1:] >> 20 == key[:-1] >> 20
    before = np.full(len(key), -1)
    before[place[1:][same]] = place[:-1][same]
    return before


def small_codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Each used symbol's bits, the first one lowest, and their number: none where one symbol is used."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, at = {}, 0
    for n, s in used:
        out[s] = REVERSED[at], n
        at += 1 << (15 - n)
    if at != 1 << 15:
        raise ValueError("a prefix code is not complete")
    return out


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, np.int64)
    if bits.take(1):
        two = bits.take(1)
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return Prefix(lengths)
    of, n = [0] * 19, 4 + bits.take(4)
    if n > 19:
        raise ValueError("too many lengths of lengths")
    for i in range(0, n, 5):
        word = bits.take(3 * min(5, n - i))
        for k in range(i, min(i + 5, n)):
            of[LENGTH_ORDER[k]], word = word & 7, word >> 3
    inner, most = small_codes(of), alphabet
    if bits.take(1):
        most = 2 + bits.take(2 + 2 * bits.take(3))
    if len(inner) == 2 and max(inner) < 16 and most >= alphabet:
        lengths[:] = np.array(sorted(inner))[bits.array(alphabet)]
        return Prefix(lengths)
    table = [(0, 0)] * 128
    for s, (code, size) in inner.items():
        table[code::1 << size] = [(s, size)] * (128 >> size)
    at, last, data, p, found, word, rest = 0, 8, bits.data, bits.at, [], 0, 0
    while at < alphabet and most:
        most -= 1
        if rest < 14:
            word, rest = int.from_bytes(data[p >> 3:(p >> 3) + 64], "little") >> (p & 7), 504
        s, size = table[word & 127]
        p += size
        rest -= size
        word >>= size
        if s < 16:
            if s:
                found.append((at, s))
                last = s
            at += 1
        else:
            n, size = (3 + (word & 3), 2) if s == 16 else (3 + (word & 7), 3) if s == 17 else (11 + (word & 127), 7)
            p += size
            rest -= size
            word >>= size
            if at + n > alphabet:
                raise ValueError("too many code lengths")
            if s == 16:
                found += [(k, last) for k in range(at, at + n)]
            at += n
    if p > 8 * len(data):
        raise ValueError("the image ends early")
    bits.at = p
    if found:
        places, sizes = zip(*found)
        lengths[list(places)] = sizes
    return Prefix(lengths)


def _extra(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + bits.take(n) + 1


#: Bits that are made windows at a time.
BITS = 1 << 17
#: Extra bits and least value of each length and distance symbol.
EXTRA = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(40)])
LEAST = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)])
HASH = 0x1E35A7BD
NEAR = near_distances()


@lru_cache(64)
def near_table(w: int) -> tuple[np.ndarray, np.ndarray]:
    """The distance of each near code, and the first code of each distance (0: none), in an image so wide."""
    near = np.array([max(1, dx + dy * w) for dx, dy in NEAR])
    codes = np.zeros(int(near.max()) + 1, np.int64)
    codes[near[::-1]] = np.arange(120, 0, -1)
    return near, codes


def read_pixels(bits: Bits, group: list[Prefix], w: int, h: int, cache_bits: int) -> np.ndarray:
    """The pixels of an image with one group of prefix codes."""
    left, out, shift, begin = w * h, [], 32 - cache_bits, bits.at
    most = max([1, *(int(p.lengths.max()) for p in group if p.only is None)])
    greens, reds, blues, alphas, distances = (p.windows(most, c) for p, c in zip(group, (0, 16, 0, 24, 0), strict=True))
    data, cache, near, add = bits.data, [0] * (1 << cache_bits), near_table(w)[0].tolist(), out.append
    last = 8 * len(data)
    while left:
        if begin > last:
            raise ValueError("the image ends early")
        raw = np.unpackbits(np.frombuffer(data[begin >> 3:(begin >> 3) + (BITS >> 3) + 24] + bytes(20), np.uint8), bitorder="little")[begin & 7:]
        x = raw.astype(np.uint16)
        for k in (1, 2, 4, 8):  # the next 2, 4, 8 and 16 bits
            x = (x[:-k] << k) | x[k:]
        x, at, end = memoryview(x >> (16 - most)), 0, min(BITS, last - begin + 1)
        while left and at < end:
            e = greens[x[at]]
            at += e & 15
            s = e >> 4
            if s < 256:
                e = reds[x[at]]
                at += e & 15
                f = blues[x[at]]
                at += f & 15
                a = alphas[x[at]]
                at += a & 15
                v = s << 8 | e >> 4 | f >> 4 | a >> 4
                add(v)
                left -= 1
                if cache_bits:
                    cache[(v * HASH & 0xFFFFFFFF) >> shift] = v
            elif s >= 280:
                add(cache[s - 280])
                left -= 1
            else:
                bits.at = begin + at
                size = _extra(bits, s - 256)
                e = distances[x[bits.at - begin]]
                bits.at += e & 15
                back = _extra(bits, e >> 4)
                at, back, left = bits.at - begin, back - 120 if back > 120 else near[back - 1], left - size
                if back > len(out) or left < 0:
                    raise ValueError("a back-reference leaves the image")
                part = out[len(out) - back:len(out) - back + size]
                if size > back:
                    part = (part * -(-size // back))[:size]
                out += part
                if cache_bits:
                    for v in part if size <= 2 * back else part[-back:]:  # of pixels that repeat, the last ones
                        cache[(v * HASH & 0xFFFFFFFF) >> shift] = v
        begin += at
    bits.at = begin
    if bits.at > last:
        raise ValueError("the image ends early")
    return np.array(out, "<u4").view(np.uint8).reshape(h, w, 4)[..., [1, 2, 0, 3]]


def read_image(bits: Bits, w: int, h: int, main: bool) -> np.ndarray:
    """Pixels (h, w, 4) in the order green, red, blue, alpha, before inverse transforms."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, shift = None, 0
    if main and bits.take(1):
        shift = 2 + bits.take(3)
        small = read_image(bits, (w + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift, False)
        meta = small[:, :, 1].astype(int) << 8 | small[:, :, 0]
    groups = []
    for _ in range(1 if meta is None else int(meta.max()) + 1):
        groups.append([read_prefix(bits, a + ((1 << cache_bits) if i == 0 and cache_bits else 0)) for i, a in enumerate(ALPHABETS)])
    first = groups[0][:4]
    if len(groups) == 1 and not cache_bits and all(p.only is not None or p.even for p in first) and (first[0].only or 0) < 256 and (first[0].only is not None or first[0].symbols[-1] < 256):
        sizes = [0 if p.only is not None else p.even for p in first]
        raw = bits.array(w * h * sum(sizes)).reshape(w * h, sum(sizes))
        out, at = np.empty((w * h, 4), np.uint8), 0
        for c, (p, n) in enumerate(zip(first, sizes, strict=True)):
            if n:
                code = np.packbits(raw[:, at:at + n], axis=1)[:, 0] >> (8 - n)
                out[:, c] = p.symbols[code]
            else:
                out[:, c] = p.only
            at += n
        return out.reshape(h, w, 4)
    if meta is None and (groups[0][0].only is None or groups[0][0].only < 256):
        return read_pixels(bits, groups[0], w, h, cache_bits)
    near, out, at, n = near_distances(), np.zeros((w * h, 4), np.uint8), 0, w * h
    cache, cached = np.zeros((1 << cache_bits, 4), np.uint8), 0

    def remember(upto: int) -> int:
        for k in range(cached, upto):
            g, r, b, a = (int(x) for x in out[k])
            argb = a << 24 | r << 16 | g << 8 | b
            cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = out[k]
        return upto

    while at < n:
        group = groups[0 if meta is None else meta[at // w >> shift, at % w >> shift]]
        s = group[0].read(bits)
        if s < 256:
            out[at] = [s, *(p.read(bits) for p in group[1:4])]
            at += 1
        elif s < 280:
            size, code = _extra(bits, s - 256), _extra(bits, group[4].read(bits))
            if code > 120:
                back = code - 120
            else:
                dx, dy = near[code - 1]
                back = max(1, dx + dy * w)
            if back > at or at + size > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(size):
                out[at + k] = out[at + k - back]
            at += size
        else:
            cached = remember(at)
            out[at] = cache[s - 280]
            at += 1
        if cache_bits and at - cached > 4096:
            cached = remember(at)
    return out.reshape(h, w, 4)


#: Images of a slice that are read one by one, the largest; symbols of the others are read in step.
ALONE = 96
#: Entries that the tables of an image read in step may have.
TABLES = 1 << 13


def _tables(lengths: np.ndarray, up: int | None) -> tuple[np.ndarray, ...]:
    """By row of code lengths: entries (symbol, and length in the last four bits) by the next bits, where the row's begin, the bits they go by, and whether the
    code is whole. up: the first bit is the highest, and the symbol is shifted so far; else the first bit is the lowest."""
    n = len(lengths)
    row, symbol = np.divmod(np.flatnonzero(lengths), lengths.shape[1])
    size = lengths[row, symbol].astype(np.int64)
    m = np.bincount(row, minlength=n)
    only = m == 1
    whole = only | (np.bincount(row, 1 << (15 - size), minlength=n) == 1 << 15)
    size[only[row]] = 0
    key = np.sort((row << 32) | (size << 28) | np.arange(len(row)))
    order = key & (1 << 28) - 1
    row, symbol, size = row[order], symbol[order], size[order]
    most = np.ones(n, np.int64)
    last = m.cumsum() - 1
    most[m > 0] = np.maximum(1, size[last[m > 0]])
    some = whole[row]
    row, symbol, size = row[some], symbol[some], size[some]
    each = np.where(whole, 1 << most, 0)
    begin = each.cumsum() - each
    entries = np.repeat(symbol << 4 + (up or 0) | size, 1 << (most[row] - size))
    if up is None:
        out = np.empty_like(entries)
        out[np.repeat(begin, each) + (REVERSE[_places(each)] >> (15 - np.repeat(most, each)))] = entries
        entries = out
    return entries, begin, most, whole


def read_codes(words: np.ndarray, at: np.ndarray, alphabets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code lengths of one code of each image, the places behind them, and whether they are as they should be; words: 57 bits or more from each byte on."""
    n, row = len(at), max(256, int(alphabets.max()))
    lengths, good = np.zeros((n, row), np.uint8), np.ones(n, bool)
    look = lambda p: (words[p >> 3] >> (p & 7).astype(np.uint64)).view(np.int64)
    w = look(at)
    simple, two, wide = (w & 1) == 1, (w >> 1 & 1) == 1, np.where(w >> 2 & 1, 8, 1)
    some = np.flatnonzero(simple)
    lengths[some, (w >> 3 & (1 << wide) - 1)[some]] = 1
    some = np.flatnonzero(simple & two)
    lengths[some, (w >> (3 + wide) & 255)[some]] = 1
    at = at + np.where(simple, 3 + wide + 8 * two, 0)
    lane = np.flatnonzero(~simple)
    if not len(lane):
        return lengths, at, good
    count, p = 4 + (w[lane] >> 1 & 15), at[lane] + 5
    w, inner = look(p), np.zeros((len(lane), 19), np.uint8)
    for k, s in enumerate(LENGTH_ORDER):
        inner[:, s] = np.where(k < count, w >> 3 * k & 7, 0)
    entries, begin, most, whole = _tables(inner, None)
    good[lane] = whole & (count <= 19)
    p = p + 3 * count
    w = look(p)
    bits = 2 + 2 * (w >> 1 & 7)
    left = np.where(w & 1, 2 + (w >> 4 & (1 << bits) - 1), 1 << 20)
    p = p + np.where(w & 1, 4 + bits, 1)
    begin = np.where(whole, begin, 0)
    known, mask, end, to = lengths.ravel(), (1 << most) - 1, lane * row + alphabets[lane], lane * row
    left = np.where(whole, left, 0)
    step = 0
    while True:
        # of those that are through nothing moves
        live = (to < end) & (left > 0)
        if step % 8 == 0 and not live.all():
            at[lane[~live]] = p[~live]
            good[lane[to > end]] = False
            lane, p, left, begin, mask, end, to = (x[live] for x in (lane, p, left, begin, mask, end, to))
            live = live[live]
            if not len(lane):
                return lengths, at, good
        step += 1
        w = look(p)
        e = entries[begin + (w & mask)]
        size, s = e & 15, e >> 4
        w >>= size
        put = np.flatnonzero(live & (s < 16))
        known[to[put]] = s[put]
        bad = live & (s == 16)
        if bad.any():  # lengths that repeat: read one by one
            good[lane[bad]] = False
        more = REPEAT_BITS[s]
        p = p + (size + more) * live
        to = to + np.where(s < 16, 1, REPEAT_LEAST[s] + (w & (1 << more) - 1)) * live
        left = left - live


REPEAT_BITS = np.array([0] * 16 + [2, 3, 7])
REPEAT_LEAST = np.array([0] * 16 + [3, 3, 11])


def _words(data: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte on, its own the lowest."""
    out = np.empty((len(data) - 8, 8), np.uint8)
    for i in range(8):
        out[:, i] = data[i:len(data) - 8 + i]
    return out.view("<u8").ravel()


def read_many(streams: list[Bits], pixels: np.ndarray, widths: np.ndarray, cache_bits: np.ndarray) -> list[np.ndarray | None]:
    """Pixels of images with one group of codes each, from where their codes begin: symbols are read in step, then back-references and the
    cache are followed to the pixels they stand for. None for those that must be read alone."""
    n = len(streams)
    starts = np.array([len(b.data) for b in streams]).cumsum() - np.array([len(b.data) for b in streams])
    data = np.frombuffer(b"".join([b.data for b in streams]) + bytes(1024), np.uint8)
    words = _words(data)
    at, good = 8 * starts + np.array([b.at for b in streams]), np.ones(n, bool)
    codes = []
    for c, alphabet in enumerate(ALPHABETS):
        lengths, at, fine = read_codes(words, at, np.full(n, alphabet) + (np.where(cache_bits > 0, 1 << cache_bits, 0) if c == 0 else 0))
        good &= fine
        entries, begin, most, whole = _tables(lengths, (8, 16, 0, 24, 0)[c])
        good &= whole
        codes.append((entries.view(np.uint64), begin, most))
    good &= (sum(x[2] for x in codes[:4]) <= 57) & (sum(1 << x[2] for x in codes) <= TABLES)
    # by the highest bits first: each byte's bits are turned round
    del words
    words = _words(TURNED[data]).byteswap(inplace=True)
    room = pixels + 1  # one more takes what comes after the end
    first = room.cumsum() - room
    token, copied = np.zeros(int(room.sum()), np.int64), []
    lane = np.flatnonzero(good)
    p, to, end = at[lane], first[lane], first[lane] + pixels[lane]
    shifts, offsets = np.stack([(64 - most).astype(np.uint64)[lane] for _, _, most in codes]), np.stack([begin[lane] for _, begin, _ in codes])
    greens, reds, blues, alphas, far = (x[0] for x in codes)
    low, step = np.uint64(15), 0
    while True:
        live = to < end
        if step % 16 == 0 and not live.all():
            at[lane[~live]] = p[~live]
            lane, p, to, end, shifts, offsets = lane[live], p[live], to[live], end[live], shifts[:, live], offsets[:, live]
            live = live[live]
        if not len(lane):
            break
        step += 1
        w = words[p >> 3] << (p & 7).view(np.uint64)
        e = greens[(w >> shifts[0]).view(np.int64) + offsets[0]]
        size = e & low
        w <<= size
        r = reds[(w >> shifts[1]).view(np.int64) + offsets[1]]
        n_r = r & low
        w <<= n_r
        b = blues[(w >> shifts[2]).view(np.int64) + offsets[2]]
        n_b = b & low
        w <<= n_b
        a = alphas[(w >> shifts[3]).view(np.int64) + offsets[3]]
        s = (e >> np.uint64(12)).view(np.int64)
        literal = s < 256
        token[to] = np.where(literal, ((e | r | b | a) >> np.uint64(4)).view(np.int64), -s)
        after = p + (size + literal * (n_r + n_b + (a & low))).view(np.int64)
        more = live.astype(np.int64)
        some = np.flatnonzero((s < 280) & live & ~literal)
        if len(some):
            own, k = after[some], s[some] - 256
            w = words[own >> 3] << (own & 7).view(np.uint64)
            extra = EXTRA[k]
            length = LEAST[k] + (REVERSE[(w >> np.uint64(49)).view(np.int64)] & (1 << extra) - 1)
            w <<= extra.view(np.uint64)
            e = far[(w >> shifts[4, some]).view(np.int64) + offsets[4, some]]
            size = e & low
            after[some] = own + extra + size.view(np.int64) + EXTRA[(e >> np.uint64(4)).view(np.int64)]
            copied.append((lane[some], to[some], length, (e >> np.uint64(4)).view(np.int64), (w << size).view(np.int64)))
            more[some] = length
        to += more
        p = np.where(live, after, p)
    if (to > end).any() or (at > 8 * (starts + np.array([len(b.data) for b in streams])))[good].any():
        raise ValueError("the image ends early")
    return _resolved(token, copied, first, pixels, widths, cache_bits, good)


TURNED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)
NEAR_X, NEAR_Y = np.array([(0, 0), *NEAR]).T


def _turned(w: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The next bits, up to 18, as a number whose lowest bit comes first."""
    high = (w >> np.uint64(44)).view(np.int64)  # 20 bits
    return (REVERSE[high >> 5] | REVERSE[(high & 31) << 10] << 15) & (1 << bits) - 1


def _resolved(token: np.ndarray, copied: list, first: np.ndarray, pixels: np.ndarray, widths: np.ndarray, cache_bits: np.ndarray, good: np.ndarray) -> list[np.ndarray | None]:
    """Pixels by tokens: below zero the slots of the cache and, where ``copied`` says so, back-references."""
    lane, place, length, k, w = (np.concatenate(x) for x in zip(*copied, strict=True)) if copied else np.zeros((5, 0), np.int64)
    back = LEAST[k] + _turned(w.view(np.uint64), EXTRA[k])
    near = np.minimum(back, 120)
    back = np.where(back > 120, back - 120, np.maximum(1, NEAR_X[near] + NEAR_Y[near] * widths[lane]))
    if ((back > place - first[lane]) | (place + length > (first + pixels)[lane])).any():
        raise ValueError("a back-reference leaves the image")
    order = np.argsort(place)
    place, length, back = place[order], length[order], back[order]
    out, i = [], 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(first, first[i] + CHUNK, side="right")) - 1) if first[-1] > first[i] + CHUNK else len(first)
        a, z = int(first[i]), int(first[j - 1] + pixels[j - 1]) + 1
        some = slice(*np.searchsorted(place, [a, z]).tolist())
        out += _followed_all(token[a:z], (place[some] - a, length[some], back[some]), first[i:j] - a, pixels[i:j], cache_bits[i:j], good[i:j])
        i = j
    return out


#: Pixels that are followed to their sources at a time, unless one image has more.
CHUNK = 1 << 16


def _followed_all(token: np.ndarray, copied: tuple, first: np.ndarray, pixels: np.ndarray, cache_bits: np.ndarray, good: np.ndarray) -> list[np.ndarray | None]:
    at, size, back = copied
    inside = np.repeat(at, size) + _places(size)
    to, hit = np.arange(len(token)), token < 0
    to[inside] -= np.repeat(back, size)
    hit[inside] = hit[first + pixels] = False
    hit = np.flatnonzero(hit)
    if len(hit):
        # a pixel from the cache has the slot that names it, a copied one that of its source
        image = np.repeat(np.arange(len(first)), pixels + 1)
        slot = (token * HASH & 0xFFFFFFFF) >> (32 - cache_bits)[image]
        slot[hit] = -token[hit] - 280
        slot[inside] = slot[_followed(to, inside)[inside]]
        slot[first + pixels] = 1 << 12
        old = _before(image << 13 | slot)[hit]
        good = good.copy()
        good[image[hit[old < 0]]] = False  # a slot that nothing was put in
        to[hit] = np.maximum(old, 0)
    raw = token[_followed(to, np.concatenate([inside, hit]))].astype("<u4").view(np.uint8).reshape(-1, 4)[:, [1, 2, 0, 3]]
    return [raw[i:i + m] if ok else None for i, m, ok in zip(first.tolist(), pixels.tolist(), good.tolist(), strict=True)]


def _followed(to: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where pointers end, all of ``some`` pointing back."""
    to = to.copy()
    while len(some):
        here = to[some]
        there = to[here]
        moved = there != here
        some = some[moved]
        to[some] = there[moved]
    return to


def _avg(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    return left if sum(abs(int(x)) for x in top - corner) < sum(abs(int(x)) for x in left - corner) else top


def _clamp(x):
    return np.clip(x, 0, 255)


#: Predictions from left, top, top right and top left.
PREDICTORS = (
    None, lambda l, t, r, c: l, lambda l, t, r, c: t, lambda l, t, r, c: r, lambda l, t, r, c: c, lambda l, t, r, c: _avg(_avg(l, r), t),
    lambda l, t, r, c: _avg(l, c), lambda l, t, r, c: _avg(l, t), lambda l, t, r, c: _avg(c, t), lambda l, t, r, c: _avg(t, r), lambda l, t, r, c: _avg(_avg(l, c), _avg(t, r)),
    lambda l, t, r, c: _select(l, t, c), lambda l, t, r, c: _clamp(l + t - c), lambda l, t, r, c: _clamp(_avg(l, t) + np.fix((_avg(l, t) - c) / 2).astype(int)),
)


def unpredict(px: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    h, w, _ = px.shape
    out = px.astype(int)
    black = np.array([0, 0, 0, 255])
    kinds = np.unique(modes)
    if len(kinds) == 1 and kinds[0] in (0, 1, 2):
        if kinds[0] != 2:
            out[1:, 0] = (out[:, 0].cumsum(axis=0) + black)[1:] if h else out[1:, 0]
            out[0, 0] += black
            if kinds[0] == 0:
                out[1:, 1:] += black
                out[0] = out[0].cumsum(axis=0)
            else:
                out = out.cumsum(axis=1)
        else:
            out[0, 0] += black
            out[0] = out[0].cumsum(axis=0)
            out = out.cumsum(axis=0)
        return (out & 255).astype(np.uint8)
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = black if x == 0 else out[0, x - 1]
            elif x == 0:
                p = out[y - 1, 0]
            else:
                mode = int(modes[y >> shift, x >> shift])
                right = out[y - 1, x + 1] if x + 1 < w else out[y, 0]
                p = PREDICTORS[mode](out[y, x - 1], out[y - 1, x], right, out[y - 1, x - 1]) if mode and mode < 14 else black
            out[y, x] = (out[y, x] + p) & 255
    return out.astype(np.uint8)


def uncross(px: np.ndarray, small: np.ndarray, shift: int) -> np.ndarray:
    """Green is added to red, green and red to blue, by signed eighths of 32."""
    h, w, _ = px.shape
    t = small.repeat(1 << shift, 0).repeat(1 << shift, 1)[:h, :w].astype(np.int8).astype(int)
    g, out = px[..., 0].astype(np.int8).astype(int), px.astype(int)
    red = (out[..., 1] + (t[..., 2] * g >> 5)) & 255
    blue = out[..., 2] + (t[..., 0] * g >> 5) + (t[..., 1] * red.astype(np.uint8).astype(np.int8).astype(int) >> 5)
    out[..., 1], out[..., 2] = red, blue & 255
    return out.astype(np.uint8)


def opened(data: bytes) -> tuple[Bits, int, int, list]:
    """A stream up to its main image: that one's width and height, and the transforms."""
    bits = Bits(data)
    if bits.take(8) != 0x2F:
        raise ValueError("not a lossless image")
    w, h = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    todo, seen, width = [], set(), w
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (0, 1):
            shift = 2 + bits.take(3)
            todo.append((kind, shift, read_image(bits, (width + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift, False), width))
        elif kind == 2:
            todo.append((kind, 0, None, width))
        else:
            n = bits.take(8) + 1
            table = read_image(bits, n, 1, False)[0].astype(int).cumsum(axis=0).astype(np.uint8)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, shift, table, width))
            width = (width + (1 << shift) - 1) >> shift
    return bits, width, h, todo


def restored(px: np.ndarray, h: int, todo: list) -> np.ndarray:
    """Inverts the transforms."""
    for kind, shift, side, wide in reversed(todo):
        if kind == 0:
            px = unpredict(px, side[..., 0] & 15, shift)
        elif kind == 1:
            px = uncross(px, side, shift)
        elif kind == 2:
            px = px.copy()
            px[..., 1:3] += px[..., :1]
        else:
            index = px[..., 0]
            if shift:
                each = 8 >> shift
                index = ((index[..., None] >> (each * np.arange(1 << shift))) & ((1 << each) - 1)).reshape(h, -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)
            table[: len(side)] = side
            px = table[index]
    return px


def decode_stream(data: bytes) -> np.ndarray:
    return decode_all([data])[0]


def decode_all(streams: list[bytes]) -> list[np.ndarray]:
    """Pixels of streams: of many, all but the largest are read in step."""
    parts = [opened(data) for data in streams]
    order, together, out = np.argsort([w * h for _, w, h, _ in parts]).tolist(), [], [None] * len(parts)
    for i in order[:-ALONE]:
        bits = parts[i][0]
        begin, cache = bits.at, bits.take(4) if bits.take(1) else 0
        if cache > 11 or bits.take(1):  # meta prefix codes
            bits.at = begin
        else:
            together.append((i, begin, cache))
    if together:
        which, begin, cache = zip(*together, strict=True)
        sizes = np.array([parts[i][1:3] for i in which])
        for i, at, px in zip(which, begin, read_many([parts[i][0] for i in which], sizes.prod(axis=1), sizes[:, 0], np.array(cache)), strict=True):
            parts[i][0].at, out[i] = at, px
    for i, (bits, w, h, todo) in enumerate(parts):
        px = read_image(bits, w, h, True) if out[i] is None else out[i].reshape(h, w, 4)
        out[i] = restored(px, h, todo)
    return out


#: Symbols that each of an image's five codes may have; a code's symbols begin at its place in a row of ``ROW``.
MOST = (256 + 24 + 1024, 256, 256, 256, 40)
FIRST = np.array([0, *np.cumsum(MOST)[:-1]])
ROW = sum(MOST)


def code_lengths(code: np.ndarray, symbol: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Length of each used symbol in the Huffman code it belongs to, at most ``most``: counts are evened until a code fits.

    Codes are numbered without gaps and come in order, their symbols rising. Codes with about as many symbols are built side by side."""
    m = np.bincount(code)
    begin, lengths = m.cumsum() - m, np.ones(len(code), np.int64)
    todo, top = np.flatnonzero(m > 1), 128
    weight = count.astype(np.int64)
    while len(todo):
        again = []
        while len(todo):
            some, todo = todo[m[todo] <= top], todo[m[todo] > top]
            top *= 4
            if not len(some):
                continue
            some = some[np.argsort(-m[some], kind="stable")]
            sizes = m[some]
            at = np.repeat(begin[some], sizes) + _places(sizes)
            which = np.repeat(np.arange(len(some)), sizes)
            key = np.sort((which << 42) | (count[at] << 11) | _places(sizes))
            at = np.repeat(begin[some], sizes) + (key & 2047)
            depth = _depths(sizes, which, weight[at])
            lengths[at] = depth
            high = np.maximum.reduceat(depth, sizes.cumsum() - sizes) > most
            if high.any():
                again.append(some[high])
                at = at[high[which]]
                weight[at] = weight[at] // 2 + 1  # in the order of the counts
        todo, top = np.sort(np.concatenate(again)) if again else todo, 128
    return lengths


def _depths(m: np.ndarray, which: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Depths of leaves in Huffman trees, m falling; leaves of each tree by rising count. Of equal weights leaves come first, then older nodes."""
    n, high = len(m), int(m[0])
    leaf = _places(m)
    weight = np.full((2 * high, n), 1 << 29, np.int32)  # rows of leaves, an endless one, and rows of nodes
    weight[leaf, which] = count
    flat, above, node = weight.ravel(), np.zeros((2 * high, n), np.int32), (high + 1) * n
    up, i, j = above.ravel(), np.arange(n), node + np.arange(n)
    active = np.searchsorted(-m, -np.arange(1, high), side="left")  # codes with a node k
    for k in range(high - 1):
        a = active[k]
        if a < len(i):
            i, j = i[:a], j[:a]
        both = 0
        for _ in range(2):
            # the lightest two of the leaves and of the nodes made so far
            x, y = flat[i], flat[j]
            is_leaf = x <= y
            up[np.where(is_leaf, i, j)] = k
            both = both + np.minimum(x, y)
            step = is_leaf * n
            i = i + step
            j = j + (n - step)
        flat[node + k * n:node + k * n + a] = both
    depth = np.zeros((high, n), np.int64)
    deep = depth.ravel()
    for k in range(high - 3, -1, -1):
        a = active[k + 1]
        depth[k, :a] = deep[above[high + 1 + k, :a] * n + np.arange(a)] + 1
    return deep[above[leaf, which] * n + which] + 1


def codes_of(code: np.ndarray, symbol: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each used symbol's bits, the first one lowest, and how many; none where a code has one symbol."""
    bits, sizes = np.zeros(len(code), np.int64), np.where(np.bincount(code)[code] > 1, lengths, 0) if len(code) else lengths
    some = np.flatnonzero(sizes)
    key = np.sort((code[some] << 46) | (sizes[some] << 42) | np.arange(len(some)))
    order = some[key & (1 << 42) - 1]
    size = 1 << (15 - sizes[order])
    bits[order] = REVERSE[(size.cumsum() - size) & 0x7FFF]  # a code fills all of 15 bits
    return bits, sizes


def pack(words: np.ndarray, begin: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
    """Puts fields of 64 bits at most to their places, which rise."""
    values, word, off = values.astype(np.uint64), begin >> 6, (begin & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] |= np.bitwise_or.reduceat(values << off, first)
    over = np.flatnonzero((begin & 63) + sizes > 64)
    words[word[over] + 1] |= values[over] >> (np.uint64(64) - off[over])


def runs(code: np.ndarray, symbol: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code lengths as symbols with the value and number of their extra bits: zeros before each used one, it, and the zeros at the end.

    ends: the alphabet's size of each code."""
    n = len(ends)
    at = np.arange(len(code)) + code  # one more for each code's end
    used, size, owner = np.empty((3, len(code) + n), np.int64)
    last = np.bincount(code, minlength=n).cumsum() + np.arange(n)
    used[at], size[at], owner[at] = symbol, lengths, code
    used[last], size[last], owner[last] = ends, -1, np.arange(n)
    gap = np.diff(used, prepend=-1) - 1
    gap[1:][owner[1:] != owner[:-1]] = used[1:][owner[1:] != owner[:-1]]
    long = (gap + 127) // 138  # of up to 138 zeros, the last of them of more than ten
    rest = np.where(gap > 138 * long, gap - 138 * long, 0)
    few = np.where(rest > 2, 1, rest)
    each = long + few + (size >= 0)
    of, k = np.repeat(np.arange(len(gap)), each), _places(each)
    wide, own = k < long[of], (size[of] >= 0) & (k == each[of] - 1)
    seventeen = ~wide & ~own & (rest[of] > 2)
    out = np.where(wide, 18, np.where(own, size[of], np.where(seventeen, 17, 0)))
    extra = np.where(wide, np.minimum(gap[of] - 138 * k, 138) - 11, np.where(seventeen, rest[of] - 3, 0))
    return owner[of], out, extra, 7 * wide + 3 * seventeen


def declared(code: np.ndarray, symbol: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code, value and size of the fields that declare codes; ``code`` of the used symbols, ``ends`` as in ``runs``."""
    n = len(ends)
    m = np.bincount(code, minlength=n)
    first = m.cumsum() - m
    short = m < 3
    short[code[symbol >= 256]] = False
    head, head_n = np.ones(n, np.int64), np.full(n, 4)
    one, two = np.flatnonzero(short & (m > 0)), np.flatnonzero(short & (m == 2))
    head[one], head_n[one] = 0b101 | symbol[first[one]] << 3, 11
    head[two] |= 0b10 | symbol[first[two] + 1] << 11
    head_n[two] = 19
    whole = np.flatnonzero(~short)
    if not len(whole):
        return np.arange(n), head, head_n
    place = np.full(n, -1)
    place[whole] = np.arange(len(whole))
    some = place[code] >= 0
    owner, s, extra, extra_n = runs(place[code[some]], symbol[some], lengths[some], ends[whole])
    used = np.flatnonzero(np.bincount(owner * 19 + s, minlength=19 * len(whole)))
    inner_code, inner_symbol = np.divmod(used, 19)
    inner = code_lengths(inner_code, inner_symbol, np.bincount(owner * 19 + s)[used], 7)
    table = np.zeros((2, len(whole) * 19), np.int64)
    table[:, used] = codes_of(inner_code, inner_symbol, inner)
    grid = np.zeros((len(whole), 19), np.int64)
    grid[inner_code, inner_symbol] = inner
    grid = grid[:, LENGTH_ORDER]
    most = np.maximum(4, 19 - np.argmax(grid[:, ::-1] > 0, axis=1))
    head[whole], head_n[whole] = (most - 4) << 1 | (grid << (5 + 3 * np.arange(19))).sum(axis=1), 6 + 3 * most
    bits, sizes = table[:, owner * 19 + s]
    owner = whole[owner]
    order = np.argsort(np.concatenate([np.arange(n), owner]), kind="stable")
    return tuple(np.concatenate(x)[order] for x in ((np.arange(n), owner), (head, bits | extra << sizes), (head_n, sizes + extra_n)))


def _planes(px: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(px.T)


class Images:
    """Channels (green, red, blue, alpha) of images, one after the other, with their sizes: ``PIXELS`` and ``IMAGES`` at most."""

    def __init__(self, px: np.ndarray, sizes: np.ndarray):
        self.px, self.sizes, self.begin, self.n = px, sizes, sizes.cumsum() - sizes, len(sizes)
        self.image = np.repeat(np.arange(self.n), sizes)
        self.v = np.ascontiguousarray(px[[2, 0, 1, 3]].T).view("<u4").ravel().astype(np.int64)

    def ranks(self) -> np.ndarray:
        """Numbers of the colours of all images, by image, then by value."""
        key = np.sort(self.image << 52 | self.v << 20 | np.arange(len(self.v)))
        out = np.empty(len(key), np.int64)
        out[key & (1 << 20) - 1] = np.concatenate([[False], key[1:] >> 20 != key[:-1] >> 20]).cumsum()
        return out


#: Bounds of a group of images that is kept in arrays, unless one has more pixels, and full groups whose codes are built at once.
PIXELS, IMAGES, GROUPS = 1 << 16, 1 << 10, 8


def copies(of: Images, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of back-references: from left to right, to the last place where this pixel and the next stood."""
    key = rank[:-1] << 20 | rank[1:]
    last = (of.begin + of.sizes - 1)[:-1]
    before = _before(key)
    before[last] = -1  # a pixel and the next image's first one
    some = np.flatnonzero(before >= 0)
    found, end, pixels, ends = [], 0, memoryview(rank), (of.begin + of.sizes)[of.image[some]]
    for at, old, most in zip(some.tolist(), before[some].tolist(), np.minimum(4096, ends - some).tolist(), strict=True):
        if at >= end:
            size = 2
            while size < most and pixels[old + size] == pixels[at + size]:
                size += 1
            end = at + size
            found.append((at, size, at - old))
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def alone(n: int, spans) -> np.ndarray:
    """Places of the pixels that no back-reference gives."""
    edge = np.zeros(n + 1, np.int8)
    edge[spans[0]] += 1
    edge[spans[0] + spans[1]] -= 1
    return np.flatnonzero(edge.cumsum(dtype=np.int8)[:n] == 0)


X_LOG_X = np.concatenate([[0.0], (lambda x: x * np.log2(x))(np.arange(1.0, 1 << 12))])


def _logs(count: np.ndarray) -> np.ndarray:
    """x log x of counts."""
    out = X_LOG_X.take(count, mode="clip")
    high = np.flatnonzero(count.ravel() >= len(X_LOG_X))
    if len(high):
        x = count.ravel()[high]
        out.ravel()[high] = x * np.log2(x)
    return out


def _entropy(code: np.ndarray, n: int, each: int) -> np.ndarray:
    """Bits of each image's symbols, about, with six a symbol for its code; code: the image times ``each``, and the symbol."""
    count = np.bincount(code, minlength=n * each).reshape(n, each)
    total = count.sum(axis=1)
    return _logs(total) - _logs(count).sum(axis=1) + 6 * np.count_nonzero(count, axis=1)


def _counts(px, image: np.ndarray, n: int) -> np.ndarray:
    """How often each image has each value of each channel."""
    at = image << 8
    return np.stack([np.bincount(at + x, minlength=n << 8).reshape(n, 256) for x in px], axis=1)


def costs_of(count: np.ndarray) -> np.ndarray:
    """Bits of each image's pixels, about, from their counts."""
    n = len(count)
    logs = _logs(count.reshape(n, -1)).sum(axis=1)
    return 4 * _logs(count[:, 0].sum(axis=1)) - logs + 6 * np.count_nonzero(count.reshape(n, -1), axis=1)


def _symbol(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, value of the extra bits and their number of lengths or distance codes."""
    s = np.searchsorted(LEAST, x, side="right") - 1
    return s, x - LEAST[s], EXTRA[s]


def _joined(*fields: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of fields that follow each other."""
    value, size = fields[0]
    for x, n in fields[1:]:
        value, size = value | x << size, size + n
    return value, size


def write_images(of: Images, widths: np.ndarray, main: np.ndarray, spans, known: np.ndarray, heads: list[list[tuple[int, int]]], fresh: np.ndarray):
    """Streams of images; known: the estimate for the pixels that no back-reference gives, or NaN; heads: values and sizes of the fields
    before each one; fresh: it begins a stream, which it shares with those after it that do not."""
    (at, size, back), v, n = spans, of.v, of.n
    single = alone(len(v), spans)
    whose = of.image[single]
    lone, many = of.px[:, single], np.bincount(whose, minlength=n)
    k = np.clip(np.frexp(many)[1] - 2, 1, 10)
    slot = (v * HASH & 0xFFFFFFFF) >> (32 - k)[of.image]
    old = _before(of.image << 10 | slot)[single]
    hits = (old >= 0) & (v[old] == v[single]) & (many >= 16)[whose]
    rest = costs_of(_counts(lone[:, ~hits], whose[~hits], n)) + _entropy(whose[hits] << 10 | slot[single[hits]], n, 1024) + _entropy(whose << 1 | hits, n, 2)
    blank = np.isnan(known)
    if blank.any():
        known = np.where(blank, costs_of(_counts(lone, whose, n)), known)
    cached = (np.bincount(whose[hits], minlength=n) > 0) & (rest < known)
    hits &= cached[whose]
    literal, repeated, plain, of_literal = single[~hits], single[hits], lone[:, ~hits], whose[~hits]
    length, length_bits, length_n = _symbol(size)
    code = back + 120
    for w in np.unique(widths).tolist():
        table = near_table(w)[1]
        d = table[np.minimum(back, len(table) - 1)] * (back < len(table))
        code = np.where((d > 0) & (widths == w)[of.image[at]], d, code)
    dist, dist_bits, dist_n = _symbol(code)
    # five codes for each image
    row, of_copy = of_literal * ROW, of.image[at]
    which = [*(row + FIRST[c] + plain[c] for c in range(4)), whose[hits] * ROW + 280 + slot[repeated], of_copy * ROW + 256 + length, of_copy * ROW + FIRST[4] + dist]
    count = np.bincount(np.concatenate(which), minlength=n * ROW)
    used = np.flatnonzero(count)
    image, spot = np.divmod(used, ROW)
    channel = np.searchsorted(FIRST, spot, side="right") - 1
    code, symbol = image * 5 + channel, spot - FIRST[channel]
    dense = np.concatenate([[0], (code[1:] != code[:-1]).cumsum()])
    asked = dense, symbol, count[used]
    del single, whose, lone, slot, old, hits, row, plain, of_literal, of_copy, count
    lengths = yield asked
    ends = np.tile(np.array(ALPHABETS), (n, 1))
    ends[cached, 0] += 1 << k[cached]
    told = declared(code, symbol, lengths, ends.ravel())
    table = np.zeros(n * ROW, np.int32)
    bits, sizes = codes_of(dense, symbol, lengths)
    table[used] = bits << 4 | sizes
    green, red, blue, alpha, cache, copy, far = (table[x].astype(np.int64) for x in which)
    value, bits = np.zeros(len(v), np.int64), np.full(len(v), -1)
    value[repeated], bits[repeated] = cache >> 4, cache & 15
    value[literal], bits[literal] = _joined((green >> 4, green & 15), (red >> 4, red & 15), (blue >> 4, blue & 15), (alpha >> 4, alpha & 15))
    value[at], bits[at] = _joined((copy >> 4, copy & 15), (length_bits, length_n), (far >> 4, far & 15), (dist_bits, dist_n))
    place = np.flatnonzero(bits >= 0)
    value, bits = value[place], bits[place]
    # each image: its head, whether it has a cache and of which size, that it has no meta codes, its codes, its pixels
    flags = zip(heads, cached.tolist(), k.tolist(), main.tolist(), strict=True)
    told_heads = [(i, *f) for i, (fields, cache, bits_of, m) in enumerate(flags) for f in (*fields, (1 | bits_of << 1, 5 + m) if cache else (0, 1 + m))]
    sections = [np.array(told_heads, np.int64).T, (told[0] // 5, *told[1:]), (of.image[place], value, bits)]
    parts = np.stack([np.bincount(owner, m, minlength=n).astype(np.int64) for owner, _, m in sections], axis=1)
    total = np.add.reduceat(parts.sum(axis=1), first := np.flatnonzero(fresh))
    words = (total + 63) // 64
    base = np.repeat(64 * (words.cumsum() - words), np.diff(first, append=n))
    run = parts.sum(axis=1).cumsum() - parts.sum(axis=1)
    start = base + run - np.repeat(run[first], np.diff(first, append=n))
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    for part, (owner, x, m) in enumerate(sections):
        run = m.cumsum() - m
        begin = start + parts[:, :part].sum(axis=1) - run[np.searchsorted(owner, np.arange(n))]
        pack(out, begin[owner] + run, x, m)
    raw, at = out.astype("<u8").tobytes(), (words.cumsum() - words) * 8
    return [raw[i:i + j] for i, j in zip(at.tolist(), ((total + 7) >> 3).tolist(), strict=True)]


def _flat(*pixel: int) -> list[tuple[int, int]]:
    """A small image of one colour."""
    return [(0, 1), *((0b101 | x << 3, 11) for x in (*pixel, 0))]


def crossed(px: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Red less green, blue less green and blue less red, by 32nds; factors: three of each pixel."""
    (g, r, b), (x, y, z) = px[:3].view(np.int8).astype(np.int16), factors.astype(np.int16)
    return (r - (x * g >> 5)).astype(np.uint8), (b - (y * g >> 5) - (z * r >> 5)).astype(np.uint8)


def slopes(px: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Factors of red by green, blue by green and blue by red, in each image."""
    g, r, b = px[:3].view(np.int8).astype(np.int64)
    sums = {id(x): np.add.reduceat(x, begin) for x in (g, r, b)}
    both = lambda x, y: np.add.reduceat(x * y, begin) - sums[id(x)] * sums[id(y)] / n
    slope = lambda x, y, square: np.clip(np.rint(32 * both(x, y) / np.maximum(1.0, square)), -127, 127).astype(np.int64)
    green = both(g, g)
    return np.stack([slope(g, r, green), slope(g, b, green), slope(r, b, both(r, r))])


def predicted(of: Images, mode: int) -> np.ndarray:
    """Differences from the pixel to the left (1) or above (2), in images of ``WIDTH``."""
    p, px, far = np.empty_like(of.px), of.px, 1 if mode == 1 else WIDTH
    p[:, far:] = px[:, :-far]
    if mode == 1:
        p[:, WIDTH::WIDTH] = px[:, :-WIDTH:WIDTH]
    else:
        for x in range(1, WIDTH):  # first rows: the pixel to the left
            p[:, of.begin + x] = px[:, of.begin + x - 1]
    p[:, of.begin] = np.array([[0], [0], [0], [255]], np.uint8)
    return px - p


def indexed(colours: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Palette, its indices packed into green, and the width."""
    m = len(colours)
    shift = 3 if m <= 2 else 2 if m <= 4 else 1 if m <= 16 else 0
    packed = (index.reshape(-1, 1 << shift) << ((8 >> shift) * np.arange(1 << shift))).sum(axis=1)
    px = np.zeros((len(packed), 4), np.uint8)
    px[:, 0], px[:, 3] = packed, 255
    table = colours.astype("<u4").view(np.uint8).reshape(-1, 4)[:, [1, 2, 0, 3]]
    return _planes(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), _planes(px), WIDTH >> shift


#: Bits that a back-reference takes, about.
COPY = 20


def _streams(payloads: list[bytes]):
    """Image streams of payloads whose lengths are multiples of ``PAD``, within the bounds of ``Images``."""
    of = Images(_planes(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 4)), np.array([len(p) >> 2 for p in payloads]))
    n, rank = of.n, of.ranks()
    spans = copies(of, rank)
    single = alone(len(of.v), spans)
    whose, lone = of.image[single], of.px[:, single]
    many = np.bincount(whose, minlength=n)
    factors = slopes(lone, many.cumsum() - many, many)
    given, none = COPY * np.bincount(of.image[spans[0]], minlength=n), _counts(lone, whose, n)
    pixels = [costs_of(none)]
    for red, blue in (lone[1:3] - lone[0], crossed(lone, factors[:, whose])):  # green and alpha stay
        count = none.copy()
        count[:, 1:3] = _counts((red, blue), whose, n)
        pixels.append(costs_of(count))
    ahead = [costs_of(_counts(predicted(of, mode), of.image, n)) for mode in (1, 2)]
    pixels = np.stack([*pixels[:2], *ahead, pixels[2]])
    costs = np.concatenate([pixels + np.stack([given, given + 3, given * 0 + 61, given * 0 + 61, given + 61]), np.full((1, n), np.inf)])  # with the bits besides the pixels'
    costs[4][~factors.any(axis=0)] = np.inf
    low = np.minimum.reduceat(rank, of.begin)
    colours = np.diff(low, append=int(rank.max()) + 1)
    palettes = {}
    for i in np.flatnonzero((colours <= 256) & (2 * colours <= of.sizes)).tolist():
        part = slice(of.begin[i], of.begin[i] + of.sizes[i])
        index, table = rank[part] - low[i], np.zeros(colours[i], np.int64)
        table[index] = of.v[part]
        palettes[i] = indexed(table, index)
    if palettes:
        tables, packed, _ = zip(*palettes.values(), strict=True)
        few = Images(np.concatenate(packed, axis=1), np.array([x.shape[1] for x in packed]))
        own = copies(few, few.ranks())
        left = alone(len(few.v), own)
        table = costs_of(_counts(np.concatenate(tables, axis=1), np.repeat(np.arange(few.n), [x.shape[1] for x in tables]), few.n))
        costs[5, list(palettes)] = COPY * np.bincount(few.image[own[0]], minlength=few.n) + costs_of(_counts(few.px[:, left], few.image[left], few.n)) + table + 40
    del rank, single, whose, lone, none  # while codes are asked for, arrays of other groups stand beside these
    best = np.argmin(costs, axis=0)
    changed, main_head = of.px, (0x2F | WIDTH - 1 << 8 | (of.sizes // WIDTH - 1) << 22 | 1 << 36).tolist()
    heads = [[(x, 40), (0, 1)] for x in main_head]
    for kind in np.unique(best[(best > 0) & (best < 5)]).tolist():
        which = (best == kind)[of.image]
        if kind in (2, 3):
            px = predicted(of, kind - 1)
        else:
            red, blue = of.px[1:3] - of.px[0] if kind == 1 else crossed(of.px, factors[:, of.image])
            px = np.stack([of.px[0], red, blue, of.px[3]])
        changed = np.where(which, px, changed)
        for i in np.flatnonzero(best == kind).tolist():
            t, side = ((1 | 2 << 1, 3), []) if kind == 1 else ((1 | 7 << 3, 6), _flat(kind - 1, 0, 0, 255)) if kind < 4 else ((1 | 1 << 1 | 7 << 3, 6), _flat(*(int(factors[c, i]) & 255 for c in (1, 2, 0)), 255))
            heads[i] = [(main_head[i], 40), t, *side, (0, 1)]
    # those whose back-references stay, then those whose pixels are new or come behind a palette
    stay = (best < 2) | (best == 4)
    out = [b""] * n
    streams = yield from _same(of, changed, spans, stay, pixels[np.minimum(best, 4), np.arange(n)], heads)
    for i, stream in zip(np.flatnonzero(stay).tolist(), streams, strict=True):
        out[i] = stream
    parts, others = [], np.flatnonzero(~stay).tolist()
    for i in others:
        if best[i] < 5:
            parts.append((changed[:, of.begin[i]:of.begin[i] + of.sizes[i]], WIDTH, 1, heads[i], True))
        else:
            table, px, width = palettes[i]
            parts += [(table, table.shape[1], 0, [(main_head[i], 40), (1 | 3 << 1 | table.shape[1] - 1 << 3, 11)], True), (px, width, 1, [(0, 1)], False)]
    if parts:
        px, widths, main, heads, begins = zip(*parts, strict=True)
        of = Images(np.concatenate(px, axis=1), np.array([x.shape[1] for x in px]))
        streams = yield from write_images(of, np.array(widths), np.array(main), copies(of, of.ranks()), np.full(of.n, np.nan), list(heads), np.array(begins))
        for i, stream in zip(others, streams, strict=True):
            out[i] = stream
    return out


def _same(of: Images, px: np.ndarray, spans, some: np.ndarray, known: np.ndarray, heads: list):
    """Streams of some of the images, with other pixels and the back-references found before."""
    if not some.any():
        return []
    kept, chosen = some[of.image], np.flatnonzero(some)
    mine = kept[spans[0]]
    place = kept.cumsum() - 1
    sub = of if px is of.px and some.all() else Images(px[:, kept], of.sizes[some])
    return (yield from write_images(sub, np.full(sub.n, WIDTH), np.ones(sub.n, np.int64), (place[spans[0][mine]], spans[1][mine], spans[2][mine]), known[some], [heads[i] for i in chosen.tolist()], np.ones(sub.n, bool)))


def together(groups: list) -> list[bytes]:
    """Runs encoders of groups of images side by side: the codes that they ask for are built at once."""
    out, asked = [b""] * len(groups), [(i, g, None) for i, g in enumerate(groups)]
    while asked:
        waiting = []
        for i, group, lengths in asked:
            try:
                waiting.append((i, group, group.send(lengths)))
            except StopIteration as done:
                out[i] = done.value
        asked = []
        if waiting:
            first = np.cumsum([0, *(int(code[-1]) + 1 for _, _, (code, _, _) in waiting)])
            code, symbol, count = (np.concatenate(x) for x in zip(*((code + k, s, c) for k, (_, _, (code, s, c)) in zip(first, waiting)), strict=True))
            lengths = np.split(code_lengths(code, symbol, count, 15), np.cumsum([len(c) for _, _, (_, _, c) in waiting])[:-1])
            asked = [(i, group, x) for (i, group, _), x in zip(waiting, lengths, strict=True)]
    return [stream for streams in out for stream in streams]


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """WebP files of payloads whose lengths are multiples of ``PAD``: one for each ``IMAGE_BYTES``, one after the other."""
    cut = [(i, p[k:k + IMAGE_BYTES]) for i, p in enumerate(payloads) for k in range(0, len(p), IMAGE_BYTES)]
    files, groups, pixels = [[] for _ in payloads], [[]], [0]
    for _, p in cut:
        size = len(p) >> 2
        if groups[-1] and (pixels[-1] + size > PIXELS or len(groups[-1]) == IMAGES):
            groups.append([])
            pixels.append(0)
        groups[-1].append(p)
        pixels[-1] += size
    run, streams = (np.cumsum(pixels) // (GROUPS * PIXELS)).tolist(), []
    for k in sorted(set(run)):
        streams += together([_streams(g) for g, r in zip(groups, run, strict=True) if g and r == k])
    for (i, _), data in zip(cut, streams, strict=True):
        chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
        files[i].append(b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk)
    return [b"".join(x) for x in files]


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


def _chunks(media: bytes) -> list[bytes]:
    """The image streams of the WebP files that follow each other in ``media``."""
    at, out = 0, []
    while at < len(media):
        if media[at:at + 4] != b"RIFF" or media[at + 8:at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end, p = at + 8 + int.from_bytes(media[at + 4:at + 8], "little"), at + 12
        while p < end:
            size = int.from_bytes(media[p + 4:p + 8], "little")
            if media[p:p + 4] == b"VP8L":
                out.append(media[p + 8:p + 8 + size])
                break
            p += 8 + size + (size & 1)
        else:
            raise ValueError("no lossless image in the file")
        at = end
    return out


def images_all(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each of ``media`` the pixel arrays (h, w, 4: green, red, blue, alpha) of its WebP files."""
    chunks = [_chunks(m) for m in media]
    px = iter(decode_all([c for x in chunks for c in x]))
    return [[next(px) for _ in x] for x in chunks]


def images(media: bytes) -> list[np.ndarray]:
    return images_all([media])[0]


def feature(px: np.ndarray) -> str:
    """Average hash: of 64 equal stretches of samples, which are brighter than the mean of all."""
    mean = px.reshape(64, -1).mean(axis=1)
    return np.packbits(mean > mean.mean()).tobytes().hex()


def _store(batches):
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for i, j in slices(texts, SLICE_BYTES):
            media = encode_all([t + b"\0" * (-len(t) % PAD if t else PAD) for t in texts[i:j]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _inspect(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        media = batch.column("media").to_pylist()
        size = sum(len(m) for m in media)
        size = size // max(1, -(-size // SLICE_BYTES)) + (1 << 16)  # slices about alike
        for file, px in ((file, px) for i, j in slices(media, size) for file, px in zip(media[i:j], images_all(media[i:j]), strict=True)):
            px = px[0].reshape(-1) if len(px) == 1 else np.concatenate([p.reshape(-1) for p in px])
            raw = px.tobytes()
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-PAD:]), len(file), hashlib.sha256(file).hexdigest(), feature(px)))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as lossless WebP."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def inspect(stored: DataFrame) -> DataFrame:
    """Decodes ``media`` and describes payload, stored form and pixels."""
    return stored.mapInArrow(_inspect, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digest(docs: DataFrame) -> DataFrame:
    return inspect(store(docs))
