"""Lossless WebP (VP8L): a decoder of the whole format, and a store of payload images.

The decoder reads prefix codes (simple and normal, with meta codes), back-references and
the colour cache, and inverts the predictor, cross-colour, subtract-green and palette
transforms, to pixel arrays of 32-bit ARGB.  ``decode_many`` reads one symbol of each of
many images at a time by array operations, and resolves back-references of all images
by pointer jumping; images with a colour cache or meta codes, and the last few that are
longer than the others, are read symbol by symbol.

``store`` keeps each payload as grey samples, one byte a pixel, in files written by
``webp_write`` (palette or subtract-green, back-references, prefix codes); ``load`` reads
the stored bytes back through the decoder.

Defined cases: a null text is empty; an empty payload is one row of padding; a payload of
more than ``ROWS`` rows is several files in a row (``pixels`` takes single images only);
rows are independent of one another, so repeated rows and null ids change nothing; only
doc_id and text are read, so no other column can clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestral.llm import shared, text, webp_write

# Fixed values of the format.
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD

def distance_offsets() -> list[tuple[int, int]]:
    """The 120 neighbours of short distance codes, as (columns left, rows up).

    Up to seven rows up, seven columns right and eight left; nearest first, then by more
    rows up, then left before right.
    """
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.value, self.held = data, at, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            chunk = self.data[self.at : self.at + 8]
            if not chunk:
                if self.held < 0 or self.at > len(self.data) + 64:
                    raise ValueError("truncated WebP data")
                self.at += 8
                self.held += 64
                continue
            self.value |= int.from_bytes(chunk, "little") << self.held
            self.at += len(chunk)
            self.held += 8 * len(chunk)

    def read(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.held -= n
        return out

    @property
    def position(self) -> int:
        return 8 * self.at - self.held


@lru_cache
def _reversed(bits: int) -> np.ndarray:
    """The numbers of so many bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate((2 * out, 2 * out + 1))
    return out


class Code:
    """A canonical prefix code as a table over its longest length: length << 16 | symbol."""

    def __init__(self, lengths: tuple[int, ...]):
        every = np.array(lengths)
        used = np.flatnonzero(every)
        n = every[used]
        self.single = None
        if len(used) == 1:
            self.single, self.longest = int(used[0]), 0
            self.table = used.astype(np.int64)
            return
        self.longest = int(n.max()) if len(n) else 0
        spans = 1 << self.longest - n
        if not len(used) or spans.sum() != 1 << self.longest:
            raise ValueError("incomplete prefix code")
        order = np.argsort(n, kind="stable")
        self.table = np.repeat((n << 16 | used)[order], spans[order])[_reversed(self.longest)]

    @cached_property
    def entries(self) -> list[int]:
        return self.table.tolist()

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        bits.need(self.longest)
        entry = self.entries[bits.value & ((1 << self.longest) - 1)]
        n = entry >> 16
        bits.value >>= n
        bits.held -= n
        return entry & 0xFFFF


@lru_cache(256)
def _code(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        count = bits.read(1) + 1
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if count == 2:
            lengths[bits.read(8)] = 1
        return _code(tuple(lengths))
    order = [0] * 19
    for i in range(4 + bits.read(4)):
        order[webp_write.CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = _code(tuple(order))
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    i, last = 0, 8
    if code.single is not None and 0 < code.single < 16:  # every length is the same, without bits
        i = min(left, size)
        lengths[:i] = [code.single] * i
        left = 0
    while i < size and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[i] = n
            i += 1
            last = n or last
            continue
        repeat = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
        if i + repeat > size:
            raise ValueError("code lengths beyond the alphabet")
        if n == 16:
            lengths[i : i + repeat] = [last] * repeat
        i += repeat
    return _code(tuple(lengths))


def _prefixed(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


@dataclass
class Coded:
    """An image whose codes are known and whose symbols are still to be read."""

    bits: Bits
    width: int
    height: int
    codes: list[list[Code]]
    cache_bits: int = 0
    meta: list[int] | None = None
    meta_bits: int = 0


def _begin(bits: Bits, width: int, height: int, main: bool) -> Coded:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        across = (width + (1 << meta_bits) - 1) >> meta_bits
        meta = (_image(bits, across, (height + (1 << meta_bits) - 1) >> meta_bits, False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, s) for s in sizes] for _ in range(groups)]
    return Coded(bits, width, height, codes, cache_bits, meta, meta_bits)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    return _symbols(_begin(bits, width, height, main))


def _symbols(image: Coded) -> np.ndarray:
    """The pixels, symbol by symbol."""
    bits, width, meta, meta_bits = image.bits, image.width, image.meta, image.meta_bits
    n, codes, cache_bits = width * image.height, image.codes, image.cache_bits
    across = (width + (1 << meta_bits) - 1) >> meta_bits
    one = codes[0]
    cache_size = 1 << cache_bits if cache_bits else 0
    offsets = distance_offsets()
    out = [0] * n
    cache = [0] * cache_size
    cached, i = 0, 0
    shift = 32 - cache_bits
    while i < n:
        if meta is not None:
            y, x = divmod(i, width)
            one = codes[meta[(y >> meta_bits) * across + (x >> meta_bits)]]
        s = one[0].read(bits)
        if s < 256:
            r = one[1].read(bits)
            b = one[2].read(bits)
            out[i] = one[3].read(bits) << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 280:
            length = _prefixed(s - 256, bits)
            distance = _prefixed(one[4].read(bits), bits)
            if distance > 120:
                distance -= 120
            else:
                dx, dy = offsets[distance - 1]
                distance = max(1, dx + dy * width)
            if distance > i or i + length > n:
                raise ValueError("back-reference out of the image")
            for _ in range(length):
                out[i] = out[i - distance]
                i += 1
        else:
            while cached < i:
                cache[(out[cached] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.uint32)


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0xFF00FF) + (b & 0xFF00FF) & 0xFF00FF)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _pack(p) -> int:
    a, r, g, b = p
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, corner: int) -> int:
    to_left = sum(abs(t - c) for t, c in zip(_parts(top), _parts(corner)))
    to_top = sum(abs(x - c) for x, c in zip(_parts(left), _parts(corner)))
    return left if to_left < to_top else top


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction of one of the 14 modes; ``right`` is above right, ``corner`` above left."""
    match mode:
        case 0:
            return 0xFF000000
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _pack(_clamp(a + b - c) for a, b, c in zip(_parts(left), _parts(top), _parts(corner)))
        case 13:
            mean = _average(left, top)
            return _pack(_clamp(m + int((m - c) / 2)) for m, c in zip(_parts(mean), _parts(corner)))
    return 0xFF000000


def _invert_predictor(pixels: np.ndarray, width: int, height: int, size_bits: int, modes: np.ndarray) -> np.ndarray:
    kinds = modes >> 8 & 15
    across = (width + (1 << size_bits) - 1) >> size_bits
    out, kinds = pixels.tolist(), kinds.tolist()
    for i, value in enumerate(out):
        y, x = divmod(i, width)
        if not y:
            p = out[i - 1] if x else 0xFF000000
        elif not x:
            p = out[i - width]
        else:
            p = predicted(kinds[(y >> size_bits) * across + (x >> size_bits)], out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        out[i] = _add(value, p)
    return np.array(out, np.uint32)


def _invert_cross_color(pixels: np.ndarray, width: int, height: int, size_bits: int, blocks: np.ndarray) -> np.ndarray:
    across = (width + (1 << size_bits) - 1) >> size_bits
    y, x = np.divmod(np.arange(width * height), width)
    e = blocks[(y >> size_bits) * across + (x >> size_bits)]
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(pixels >> 8)
    red = (pixels >> 16 & 255).astype(np.int32) + (signed(e) * green >> 5) & 255
    blue = (pixels & 255).astype(np.int32) + (signed(e >> 8) * green >> 5)
    blue = blue + (signed(e >> 16) * signed(red) >> 5) & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _invert_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & np.uint32(0xFF00FF00) | ((pixels & 0xFF00FF) + (green << 16 | green) & 0xFF00FF)


def _invert_palette(pixels: np.ndarray, width: int, height: int, packed: int, palette: np.ndarray) -> np.ndarray:
    index = pixels >> 8 & 255
    if packed:
        per, bits = 1 << packed, 8 >> packed
        row = (width + per - 1) >> packed
        parts = index.reshape(height, row, 1) >> (np.arange(per, dtype=np.uint32) * bits) & ((1 << bits) - 1)
        index = parts.reshape(height, row * per)[:, :width].ravel()
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def _opened(data: bytes) -> tuple[Coded, int, list]:
    """The main image of a file, the width of the whole, and the transforms to invert."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    bits = Bits(data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown VP8L version")
    undo = []
    across = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            size_bits = bits.read(3) + 2
            side = lambda n: (n + (1 << size_bits) - 1) >> size_bits  # noqa: B023, E731
            blocks = _image(bits, side(across), side(height), False)
            undo.append((_invert_predictor if kind == PREDICTOR else _invert_cross_color, (across, height, size_bits, blocks)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_invert_green, ()))
        else:
            count = bits.read(8) + 1
            palette = _image(bits, count, 1, False)
            palette = np.cumsum(np.ascontiguousarray(palette).view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).view(np.uint32).ravel()
            packed = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append((_invert_palette, (across, height, packed, palette)))
            across = (across + (1 << packed) - 1) >> packed
    return _begin(bits, across, height, True), width, undo


#: Images left of a batch that are read one after the other: by then steps cost more than symbols.
FEW = 160
_PREFIX = np.arange(40)
_EXTRA = np.where(_PREFIX < 4, 0, _PREFIX - 2 >> 1)
_BASE = np.where(_PREFIX < 4, _PREFIX + 1, (2 + (_PREFIX & 1) << _EXTRA) + 1)
_NEAR = np.array(distance_offsets())


class _Tables:
    """One of the five codes of many images, as one array."""

    def __init__(self, codes: list[Code]):
        sizes = [len(c.table) for c in codes]
        self.base = np.cumsum([0, *sizes[:-1]])
        self.mask = np.array(sizes, np.uint64) - np.uint64(1)
        self.all = np.concatenate([c.table for c in codes])

    def keep(self, which: np.ndarray) -> None:
        self.base, self.mask = self.base[which], self.mask[which]

    def look(self, window: np.ndarray, rows=slice(None)) -> np.ndarray:
        return self.all[self.base[rows] + (window & self.mask[rows]).view(np.int64)]


def _lockstep(images: list[Coded]) -> list[np.ndarray]:
    """Pixels of images of one code group and no colour cache."""
    blobs = [i.bits.data for i in images]
    begin = np.cumsum([0, *(len(b) + 16 for b in blobs[:-1])])
    raw = b"".join(b + bytes(16) for b in blobs)
    windows = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)).copy()  # the 64 bits from each byte on
    total = np.array([i.width * i.height for i in images])
    offset = np.cumsum(total) - total
    places, values, copies = [], [], []  # tokens of all images, by place among all pixels

    def fetch(p: np.ndarray) -> np.ndarray:
        return windows[p >> 3] >> (p & 7).view(np.uint64)

    live = np.arange(len(images))
    at = 8 * begin + np.array([i.bits.position for i in images])
    stop = 8 * (begin + np.array([len(b) for b in blobs]))
    width = np.array([i.width for i in images])
    tables = [_Tables([i.codes[0][k] for i in images]) for k in range(5)]
    coloured = any(i.codes[0][k].longest for i in images for k in (1, 2, 3))
    still = sum(t.all[t.base] << s for t, s in zip(tables[1:4], (16, 0, 24)))  # where other channels never change
    done = offset.copy()
    end = offset + total
    while len(live) > FEW:
        e = tables[0].look(fetch(at))
        at = at + (e >> 16)
        s = e & 0xFFFF
        copy = np.flatnonzero(s > 255)
        moved = done + 1
        if len(copy):
            p, k = at[copy], s[copy] - 256
            extra = _EXTRA[k]
            length = _BASE[k] + (fetch(p) & (np.uint64(1) << extra.view(np.uint64)) - np.uint64(1)).view(np.int64)
            p += extra
            window = fetch(p)
            e = tables[4].look(window, copy)
            n, k = e >> 16, e & 0xFFFF
            extra = _EXTRA[k]
            distance = _BASE[k] + (window >> n.view(np.uint64) & (np.uint64(1) << extra.view(np.uint64)) - np.uint64(1)).view(np.int64)
            at[copy] = p + n + extra
            near = np.flatnonzero(distance <= 120)
            distance -= 120
            if len(near):
                xy = _NEAR[distance[near] + 119]
                distance[near] = np.maximum(1, xy[:, 0] + xy[:, 1] * width[copy[near]])
            moved[copy] += length - 1
            if (distance > done[copy] - offset[live[copy]]).any():
                raise ValueError("back-reference out of the image")
            copies.append((done[copy], length, distance))
            plain = np.flatnonzero(s < 256)
            place, s = done[plain], s[plain]
        else:
            plain, place = slice(None), done
        value = s << 8
        if coloured:
            p = at[plain]
            for t, shift in zip(tables[1:4], (16, 0, 24)):
                e = t.look(fetch(p), plain)
                p = p + (e >> 16)
                value |= (e & 0xFFFF) << shift
            at[plain] = p
        else:
            value |= still[plain]
        places.append(place)
        values.append(value)
        done = moved
        over = done >= end
        if over.any():
            if (done > end).any() or (at > stop).any():
                raise ValueError("truncated WebP data")
            keep = np.flatnonzero(~over)
            live, at, done, end, stop, width, still = (x[keep] for x in (live, at, done, end, stop, width, still))
            for t in tables:
                t.keep(keep)
    for i, p, d in zip(live.tolist(), at.tolist(), done.tolist()):
        one, two, three = _follow(images[i], p - 8 * int(begin[i]), d - int(offset[i]))
        places.append(np.array(one, np.int64) + offset[i])
        values.append(np.array(two, np.int64))
        if three:
            copies.append(tuple(np.array(three).T + np.array([[offset[i]], [0], [0]])))
    out = np.zeros(int(total.sum()), np.uint32)
    out[np.concatenate(places)] = np.concatenate(values)
    del places, values
    if copies:
        _resolve(out, np.append(offset, len(out)), *(np.concatenate([c[k] for c in copies]) for k in range(3)))
    return [out[a : a + n] for a, n in zip(offset.tolist(), total.tolist())]


def _follow(image: Coded, at: int, done: int) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """The rest of one image as literals (place, value) and copies (place, length, distance)."""
    data, n, width = image.bits.data + bytes(16), image.width * image.height, image.width
    stop = 8 * len(image.bits.data)
    green, *others, far = image.codes[0]
    entries, mask = green.entries, (1 << green.longest) - 1
    places, values, copies = [], [], []
    channels = [(c.entries, (1 << c.longest) - 1, s) for c, s in zip(others, (16, 0, 24)) if c.longest]
    still = sum(c.single << s for c, s in zip(others, (16, 0, 24)) if c.single is not None)
    far_entries, far_mask = far.entries, (1 << far.longest) - 1
    extras, bases, near = _EXTRA.tolist(), _BASE.tolist(), _NEAR.tolist()
    value = held = 0
    byte = at >> 3
    if at & 7:
        value, held, byte = data[byte] >> (at & 7), 8 - (at & 7), byte + 1
    while done < n:
        if held < 64:  # the longest token is shorter
            value |= int.from_bytes(data[byte : byte + 32], "little") << held
            byte += 32
            held += 256
        e = entries[value & mask]
        size = e >> 16
        value >>= size
        held -= size
        s = e & 0xFFFF
        if s < 256:
            s = s << 8 | still
            for more, m, shift in channels:
                e = more[value & m]
                value >>= e >> 16
                held -= e >> 16
                s |= (e & 0xFFFF) << shift
            places.append(done)
            values.append(s)
            done += 1
            continue
        extra = extras[s - 256]
        length = bases[s - 256] + (value & (1 << extra) - 1)
        value >>= extra
        e = far_entries[value & far_mask]
        size = e >> 16
        value >>= size
        k = extras[e & 0xFFFF]
        distance = bases[e & 0xFFFF] + (value & (1 << k) - 1)
        value >>= k
        held -= extra + size + k
        if distance > 120:
            distance -= 120
        else:
            x, y = near[distance - 1]
            distance = max(1, x + y * width)
        if distance > done or done + length > n:
            raise ValueError("back-reference out of the image")
        copies.append((done, length, distance))
        done += length
        if 8 * byte - held > stop:
            raise ValueError("truncated WebP data")
    if 8 * byte - held > stop:
        raise ValueError("truncated WebP data")
    return places, values, copies


def _resolve(out: np.ndarray, first: np.ndarray, place: np.ndarray, length: np.ndarray, distance: np.ndarray) -> None:
    """Fill the copies of some images: pointers to earlier pixels are doubled until all point at literals."""
    order = np.argsort(place)
    place, length, distance = place[order], length[order], distance[order].astype(np.int32)
    for a, b in webp_write.blocks(first):
        begin, end = int(first[a]), int(first[b])
        own = slice(*np.searchsorted(place, (begin, end)))
        n, pixels = length[own], out[begin:end]
        to = np.repeat((place[own] - begin - np.cumsum(n) + n).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
        pointer = np.arange(end - begin, dtype=np.int32)
        pointer[to] = to - np.repeat(distance[own], n)
        copied = np.zeros(end - begin, bool)
        copied[to] = True
        open_ = to
        while len(open_):
            next_ = pointer[open_]
            more = copied[next_]
            open_ = open_[more]
            pointer[open_] = pointer[next_[more]]
        pixels[to] = pixels[pointer[to]]


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels, height x width, of each lossless WebP file."""
    opened = [_opened(f) for f in files]
    together = [k for k, (i, _, _) in enumerate(opened) if i.meta is None and not i.cache_bits]
    together.sort(key=lambda k: len(files[k]))
    out: list[np.ndarray] = [None] * len(files)
    for k, flat in zip(together, _lockstep([opened[k][0] for k in together]) if together else ()):
        out[k] = flat
    for k, (image, width, undo) in enumerate(opened):
        flat = _symbols(image) if out[k] is None else out[k]
        for invert, args in reversed(undo):
            flat = invert(flat, *args)
        out[k] = flat.reshape(image.height, width)
    return out


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels, height x width, of one file."""
    return decode_many([data])[0]


#: Rows of one image, and bytes of payload that are written or read together.
ROWS, TOGETHER = 8192, 8 << 20


def write_payloads(payloads: list[bytes], unit: int = 576, rows: int = ROWS) -> list[bytes]:
    """For each payload its files, one after the other: grey images a unit wide."""
    parts = [(k, p[a : a + unit * rows]) for k, p in enumerate(payloads) for a in range(0, len(p), unit * rows)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for group in _groups(parts, [len(p) for _, p in parts]):
        for (k, _), file in zip(group, webp_write.write([p for _, p in group], unit)):
            out[k].append(file)
    return [b"".join(x) for x in out]


def _groups(rows: list, sizes: list[int]) -> Iterator[list]:
    """Neighbours of about ``TOGETHER`` bytes (one row at least)."""
    held, size = [], 0
    for row, n in zip(rows, sizes):
        if held and size + n > TOGETHER:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def payload_of(pixels: np.ndarray) -> bytes:
    """The grey samples."""
    return pixels.astype(np.uint8).tobytes()


def features(pixels: np.ndarray) -> str:
    """Size, mean of the grey samples (hundredths) and a 64-bit average hash of 64 cells in a row."""
    return _feature(pixels.astype(np.uint8))


def _feature(samples: np.ndarray) -> str:
    height, width = samples.shape
    flat = samples.ravel()
    cells = np.add.reduceat(flat, np.arange(64) * len(flat) // 64, dtype=np.int64)
    total = int(cells.sum()) if len(flat) >= 64 else int(flat.sum(dtype=np.int64))
    return f"{width}x{height}|{total * 100 // len(flat)}|{np.packbits(cells * 64 > total).tobytes().hex()}"


def files(media: bytes) -> list[bytes]:
    """Each file of some that follow one another."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at:end])
        at = end
    return out


def store(docs: DataFrame, unit: int = 576) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded with 255, as WebP files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, limit=TOGETHER):
            data, offsets = text.strings(batch.column("text"))
            raw = data.tobytes()
            payloads = [raw[a:b] + b"\xff" * (unit * max(1, -(-(b - a) // unit)) - (b - a)) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(write_payloads(payloads, unit), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return shared.arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame) -> DataFrame:
    """Digests and features of the payload decoded from each text's media."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, "media", TOGETHER):
            stored = batch.column("media").to_pylist()
            parts = [(k, f) for k, m in enumerate(stored) for f in files(m)]
            digests, sizes, tails, marks = [hashlib.sha256() for _ in stored], [0] * len(stored), [b""] * len(stored), [[] for _ in stored]
            for group in _groups(parts, [file_pixels(f) for _, f in parts]):
                for (k, _), image in zip(group, decode_many([f for _, f in group])):
                    samples = image.astype(np.uint8)
                    payload = samples.tobytes()
                    digests[k].update(payload)
                    sizes[k] += len(payload)
                    tails[k] = (tails[k] + payload[-32:])[-32:]
                    marks[k].append(_feature(samples))
            columns = [
                pa.array(sizes, pa.int64()),
                pa.array([d.hexdigest() for d in digests]),
                pa.array([zlib.crc32(t) for t in tails], pa.int64()),
                pa.array([len(m) for m in stored], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                pa.array([";".join(m) for m in marks]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=[c.split()[0] for c in schema.split(", ")])

    return shared.arrow(media, run, schema)


def file_pixels(data: bytes) -> int:
    """Pixels of a file of one image chunk, from its head."""
    head = int.from_bytes(data[21:25], "little")
    return ((head & 0x3FFF) + 1) * ((head >> 14 & 0x3FFF) + 1)


def pixels(media: DataFrame) -> DataFrame:
    """(doc_id, width, height, argb array<int>): the pixel array of each media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, "media"):
            images = decode_many(batch.column("media").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([i.shape[1] for i in images], pa.int32()), pa.array([i.shape[0] for i in images], pa.int32()), pa.array([i.ravel().view(np.int32) for i in images], pa.list_(pa.int32()))],
                names=["doc_id", "width", "height", "argb"],
            )

    return shared.arrow(media.select("doc_id", "media"), run, "doc_id long, width int, height int, argb array<int>")
