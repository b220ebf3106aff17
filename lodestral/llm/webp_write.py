"""Writer of grey lossless WebP images: palette or subtract-green, back-references, prefix codes.

Many images are written at once by array operations: their samples lie in one array,
where sorting (four samples, place) gives each place the nearest earlier one of the same
samples; runs of one distance, as far as they go on, are back-references.  Each image has prefix codes of its
own, of at most ``LONGEST`` bits.  Up to 16 different samples become a palette, with
several pixels in one; else green is subtracted, which leaves red and blue nothing.
A predictor, colour transform or colour cache would only add to such images: text has no
smooth neighbours, grey has no colours, and a cache entry says no more than a green code.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SUBTRACT_GREEN, PALETTE = 2, 3
GREEN, FAR = 280, 40
#: Bits of a code; samples of a copy and how far it reaches.
LONGEST, COPY, REACH = 12, 4096, (1 << 20) - 120
#: Samples by which a copy is taken beyond its run.
FURTHER = 8
#: Copies that are looked through, and samples that are worked on, at a time.
PIECE, BLOCK = 1 << 18, 1 << 17

_REVERSE = np.zeros(1 << LONGEST, np.uint32)
for _bit in range(LONGEST):
    _REVERSE |= (np.arange(1 << LONGEST, dtype=np.uint32) >> np.uint32(_bit) & np.uint32(1)) << np.uint32(LONGEST - 1 - _bit)


class BitWriter:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def container(payload: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def blocks(first: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring images of about ``BLOCK`` samples together, so that arrays over them stay in a cache."""
    cuts = np.flatnonzero(np.diff(first[:-1] // BLOCK)) + 1
    edges = [0, *cuts.tolist(), len(first) - 1]
    return list(zip(edges, edges[1:]))


def copies(samples: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy tokens over all images: place, length (1: a literal) and distance (0: a literal)."""
    n = len(samples)
    place = np.arange(n, dtype=np.int32)
    distance, step = np.zeros(n, np.int32), np.ones(n, np.int32)
    if n > 4:
        distance = _nearest(samples, first, place)
        last = np.flatnonzero(np.append(distance[1:] != distance[:-1], True)).astype(np.int32)  # the ends of runs of one distance
        reach = last + 4  # how far the samples of a run agree with those before: four of its last, and what follows
        far = distance[last]
        stop = np.repeat(first[1:].astype(np.int32), np.diff(np.searchsorted(last, first)))
        open_ = np.flatnonzero(far)
        for _ in range(FURTHER):
            open_ = open_[reach[open_] < stop[open_]]
            open_ = open_[samples[reach[open_]] == samples[reach[open_] - far[open_]]]
            reach[open_] += 1
        length = np.repeat(reach, np.diff(last, prepend=-1)) - place
        step = np.where(distance > 0, np.minimum(length, COPY), 1)
    # Copies one after the other: the next one is the first that begins where the last has ended, or later.
    use = step > 1
    begins = np.flatnonzero(use)
    after = np.append(0, np.cumsum(use, dtype=np.int32))[begins + step[begins]]
    chosen, k = [], 0
    for a in range(0, len(after), PIECE):
        part = after[a : a + PIECE].tolist()
        b = a + len(part)
        while k < b:
            chosen.append(k)
            k = part[k - a]
    begins = begins[np.array(chosen, np.int64)]
    inside = np.zeros(n + 1, np.int8)
    inside[begins + 1] += 1
    inside[begins + step[begins]] -= 1
    at = np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8) == 0)
    copied = np.zeros(n, bool)
    copied[begins] = True
    copied = copied[at]
    return at, np.where(copied, step[at], 1).astype(np.int64), np.where(copied, distance[at], 0).astype(np.int64)


def _nearest(samples: np.ndarray, first: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How far back the same four samples lie in the same image, 0 if they don't."""
    n = len(samples)
    key = np.ndarray(n - 3, "<u4", samples.tobytes(), strides=(1,)).astype(np.uint64) << np.uint64(32) | place[: n - 3].astype(np.uint64)
    key.sort()
    value, at = (key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint32).view(np.int32)
    del key
    before = np.full(n, -1, np.int32)
    before[at[1:]] = np.where(value[1:] == value[:-1], at[:-1], -1)
    sizes = np.diff(first)
    fits = (before >= np.repeat(first[:-1].astype(np.int32), sizes)) & (place <= np.repeat((first[1:] - 4).astype(np.int32), sizes))
    distance = (place - before) * fits
    if n > REACH:
        distance[distance > REACH] = 0
    return distance


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and extra bits of lengths or distances from 1 up."""
    v = values - 1
    high = np.frexp(v.astype(np.float64))[1] - 1  # place of the highest bit
    bits = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(bits, 0) & 1)), bits, v & (1 << bits) - 1


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code of at most LONGEST bits; a lone symbol has length 1."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].tolist()
    n = len(weights)
    while True:
        # Huffman's tree by two queues: leaves by weight, then inner nodes as they are made.
        inner, up = [], [0] * (2 * n - 1)
        leaf = node = 0
        for k in range(n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (node >= k or weights[leaf] <= inner[node]):
                    total += weights[leaf]
                    up[leaf] = n + k
                    leaf += 1
                else:
                    total += inner[node]
                    up[n + node] = n + k
                    node += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if depth[0] <= LONGEST:
            out[used] = depth[:n]
            return out
        weights = [(w >> 1) + 1 for w in weights]


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest, of each row of lengths."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    order = np.lexsort((symbol, n, row))
    row, symbol, n = row[order], symbol[order], n[order]
    span = 1 << LONGEST - n
    begin = (np.cumsum(span) - span) & (1 << LONGEST) - 1  # complete codes fill the space
    out = np.zeros(lengths.shape, np.int64)
    out[row, symbol] = _REVERSE[begin]
    return out


_LENGTHS = (*range(LONGEST + 1), 16, 17, 18)
_LENGTH_CODE = {s: int(f"{k:04b}"[::-1], 2) for k, s in enumerate(_LENGTHS)}
_CODE_HEAD = BitWriter()
_CODE_HEAD.put(0, 1)  # a normal code
_CODE_HEAD.put(len(_LENGTHS) - 4, 4)
for _symbol in CODE_LENGTH_ORDER[: len(_LENGTHS)]:  # these are the sixteen of _LENGTHS, four bits each
    _CODE_HEAD.put(4, 3)
_CODE_HEAD.put(0, 1)  # lengths of all symbols follow


def _put_code(out: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) == 1 and used[0] < 256:
        put_single(out, used[0])
        return
    out.put(_CODE_HEAD.value, _CODE_HEAD.size)
    value = size = 0
    at = 0
    for s, n in zip([*used, len(lengths)], [*lengths[used].tolist(), None]):
        zeros = s - at
        while zeros:
            if zeros < 3:
                value |= _LENGTH_CODE[0] << size
                size += 4
                zeros -= 1
            elif zeros < 11:
                value |= (_LENGTH_CODE[17] | zeros - 3 << 4) << size
                size += 7
                zeros = 0
            else:
                k = min(zeros, 138)
                value |= (_LENGTH_CODE[18] | k - 11 << 4) << size
                size += 11
                zeros -= k
        if n:
            value |= _LENGTH_CODE[n] << size
            size += 4
        at = s + 1
    out.put(value, size)


def put_single(out: BitWriter, symbol: int) -> None:
    """A simple code of one symbol."""
    wide = symbol > 1
    out.put(1 | wide << 2 | symbol << 3, 11 if wide else 4)


def _put_flat(out: BitWriter, size: int) -> None:
    """Eight bits for each of the first 256 symbols: a code of code lengths that holds 8 alone."""
    out.put(0, 1)
    out.put(12 - 4, 4)
    for symbol in CODE_LENGTH_ORDER[:12]:
        out.put(symbol == 8, 3)
    out.put(size != 256, 1)
    if size != 256:
        out.put(3, 3)
        out.put(256 - 2, 8)


def _put_palette(out: BitWriter, shades: list[int]) -> None:
    """The palette's image: differences of grey colours, eight bits a channel."""
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(len(shades) - 1, 8)
    out.put(0, 1)  # no colour cache
    for size in (GREEN, 256, 256):
        _put_flat(out, size)
    if len(shades) == 1:
        put_single(out, 255)
    else:
        out.put(0b0011 | 0 << 3 | 255 << 4, 12)  # two symbols of alpha: 0, 255
    put_single(out, 0)
    last = 0
    for k, shade in enumerate(shades):
        flipped = int(f"{shade - last & 255:08b}"[::-1], 2)
        out.put(flipped * 0x010101, 24)
        if len(shades) > 1:
            out.put(k == 0, 1)
        last = shade


def _prepared(payload: bytes, unit: int) -> tuple[np.ndarray, BitWriter, int]:
    """What is coded as green of each pixel, the head of the file, and whether alpha is opaque."""
    samples = np.frombuffer(payload, np.uint8)
    height = len(samples) // unit
    out = BitWriter()
    out.put(0x2F | unit - 1 << 8 | height - 1 << 22, 40)
    shades = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(shades) > 16:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
    else:
        _put_palette(out, shades.tolist())
        packed = 3 if len(shades) <= 2 else 2 if len(shades) <= 4 else 1
        per, bits = 1 << packed, 8 >> packed
        index = np.zeros(256, np.uint8)
        index[shades] = np.arange(len(shades))
        rows = np.zeros((height, -(-unit // per) * per), np.uint8)
        rows[:, :unit] = index[samples].reshape(height, unit)
        samples = np.bitwise_or.reduce(rows.reshape(height, -1, per) << (np.arange(per, dtype=np.uint8) * np.uint8(bits)), axis=2).ravel()
    out.put(0, 3)  # no more transforms, no colour cache, no meta codes
    return samples, out


def _scatter(words: np.ndarray, place: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
    """Or values of some bits into 64-bit words at rising bit places."""
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[starts]] |= np.bitwise_or.reduceat(value << shift, starts)
    over = np.flatnonzero((place & 63) + size > 64)
    words[word[over] + 1] |= value[over] >> np.uint64(64) - shift[over]


def write(payloads: list[bytes], unit: int = 576) -> list[bytes]:
    """A file for each payload, a multiple of ``unit`` bytes: a grey image ``unit`` wide."""
    if not payloads:
        return []
    prepared = [_prepared(p, unit) for p in payloads]
    first = np.cumsum([0, *(len(s) for s, _ in prepared)])
    samples = np.concatenate([s for s, _ in prepared])
    tokens = []
    for a, b in blocks(first):
        at, length, distance = copies(samples[first[a] : first[b]], first[a : b + 1] - first[a])
        tokens.append((at + first[a], length, distance))
    at, length, distance = (np.concatenate([t[k] for t in tokens]) for k in range(3))
    image = np.searchsorted(first, at, side="right") - 1
    n = len(prepared)
    symbol = samples[at].astype(np.int64)
    copy = np.flatnonzero(distance)
    copy = copy[length[copy] > 1]
    k, length_bits, length_extra = prefixes(length[copy])
    symbol[copy] = 256 + k
    far, far_bits, far_extra = prefixes(distance[copy] + 120)
    greens = np.bincount(image * GREEN + symbol, minlength=n * GREEN).reshape(n, GREEN)
    fars = np.bincount(image[copy] * FAR + far, minlength=n * FAR).reshape(n, FAR)
    fars[fars.sum(axis=1) == 0, 0] = 1
    green_lengths = np.array([code_lengths(c) for c in greens])
    far_lengths = np.array([code_lengths(c) for c in fars])
    for (_, head), g, f in zip(prepared, green_lengths, far_lengths):
        _put_code(head, g)
        for fixed in (0, 0, 255):
            put_single(head, fixed)
        _put_code(head, f)
    for lengths in (green_lengths, far_lengths):  # a lone symbol takes no bits
        lengths[np.count_nonzero(lengths, axis=1) == 1] = 0
    # A token's bits, lowest first: green code, then of a copy its length's extra bits, distance code and extra bits.
    size = green_lengths[image, symbol]
    value = codes(green_lengths)[image, symbol].astype(np.uint64)
    own = image[copy]
    tail = size[copy]
    for v, b in ((length_extra, length_bits), (codes(far_lengths)[own, far], far_lengths[own, far]), (far_extra, far_bits)):
        value[copy] |= v.astype(np.uint64) << tail.astype(np.uint64)
        tail = tail + b
    size[copy] = tail
    heads = np.array([h.size for _, h in prepared])
    tokens = np.bincount(image, weights=size, minlength=n).astype(np.int64)
    bytes_ = -(-(heads + tokens) // 8)
    begin = np.cumsum(bytes_) - bytes_
    words = np.zeros(int(bytes_.sum()) // 8 + 2, np.uint64)
    before = np.cumsum(size) - size
    _scatter(words, before + (8 * begin + heads - (np.cumsum(tokens) - tokens))[image], value, size)
    raw = words.view(np.uint8)
    out = []
    for (_, head), a, m in zip(prepared, begin.tolist(), bytes_.tolist()):
        body = bytearray(raw[a : a + m].tobytes())
        whole = -(-head.size // 8)
        body[:whole] = (int.from_bytes(body[:whole], "little") | head.value).to_bytes(whole, "little")
        out.append(container(bytes(body)))
    return out
