"""The WebP decoder against streams written bit by bit with every feature of the format."""

import hashlib
import zlib

import numpy as np
import pytest

from lodestral.llm import webp, webp_write


class Writer(webp_write.BitWriter):
    def codes(self, lengths):
        """A normal prefix code, its code lengths written with five bits each."""
        if sum(1 for n in lengths if n) == 1:
            self.put(1, 1)
            self.put(0, 1)
            s = next(i for i, n in enumerate(lengths) if n)
            self.put(1, 1)
            self.put(s, 8)
            return {s: (0, 0)}
        self.put(0, 1)
        self.put(15, 4)
        order = [0] * 19
        for n in range(16):
            order[n] = 4
        for s in webp_write.CODE_LENGTH_ORDER:
            self.put(order[s], 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)
        return canonical(lengths)


def canonical(lengths):
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def skewed(symbols, size):
    """Code lengths 1, 2, 3 ... for up to 13 symbols, else a flat power of two."""
    symbols = sorted(set(symbols))
    lengths = [0] * size
    if len(symbols) <= 13:
        for k, s in enumerate(symbols):
            lengths[s] = max(1, min(k + 1, len(symbols) - 1))
        return lengths
    bits = (len(symbols) - 1).bit_length()
    spare = (1 << bits) - len(symbols)
    for k, s in enumerate(symbols):
        lengths[s] = bits - 1 if k < spare else bits
    return lengths


def prefix(value):
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> high - 1 & 1
    return 2 * high + second, high - 1, v - ((2 + second) << high - 1)


def image(w, pixels, width, main=True, cache_bits=0, copies=True):
    """Pixels as literals, cache hits and back-references."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    offsets = webp.distance_offsets()
    ops, i, cache = [], 0, [0] * (1 << cache_bits)
    slot = lambda p: (p * webp.CACHE_MULTIPLIER & 0xFFFFFFFF) >> 32 - cache_bits
    while i < len(pixels):
        best = (0, 0)
        if copies:
            for d in range(1, min(i, 3 * width) + 1):
                n = 0
                while i + n < len(pixels) and n < 4096 and pixels[i + n] == pixels[i + n - d]:
                    n += 1
                best = max(best, (n, -d))
        if best[0] >= 3:
            n, d = best[0], -best[1]
            code = next((k + 1 for k, (x, y) in enumerate(offsets) if max(1, x + y * width) == d), d + 120)
            ops.append(("copy", n, code))
        elif cache_bits and cache[slot(pixels[i])] == pixels[i] and i:
            ops.append(("cache", slot(pixels[i])))
            n = 1
        else:
            ops.append(("literal", pixels[i]))
            n = 1
        for k in range(i, i + n):
            if cache_bits:
                cache[slot(pixels[k])] = pixels[k]
        i += n
    size = 280 + (1 << cache_bits if cache_bits else 0)
    green = [o[1] >> 8 & 255 if o[0] == "literal" else 256 + prefix(o[1])[0] if o[0] == "copy" else 280 + o[1] for o in ops]
    literals = [o[1] for o in ops if o[0] == "literal"] or [0]
    distances = [prefix(o[2])[0] for o in ops if o[0] == "copy"] or [0]
    tables = [w.codes(skewed(s, n)) for s, n in ((green, size), ([p >> 16 & 255 for p in literals], 256), ([p & 255 for p in literals], 256), ([p >> 24 for p in literals], 256), (distances, 40))]
    for o, g in zip(ops, green):
        w.put(*tables[0][g])
        if o[0] == "literal":
            for table, s in zip(tables[1:4], (o[1] >> 16 & 255, o[1] & 255, o[1] >> 24)):
                w.put(*table[s])
        elif o[0] == "copy":
            _, bits, extra = prefix(o[1])
            w.put(extra, bits)
            s, bits, extra = prefix(o[2])
            w.put(*tables[4][s])
            w.put(extra, bits)


def head(width, height):
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def finish(w):
    return webp_write.container(w.value.to_bytes(-(-w.size // 8), "little"))


def noisy(width, height, colours, seed=0):
    rng = np.random.default_rng(seed)
    palette = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.int64)
    return [int(x) for x in palette[rng.integers(0, colours, width * height)]]


@pytest.mark.parametrize("cache_bits", [0, 1, 5, 11])
@pytest.mark.parametrize("colours", [1, 2, 9, 300])
def test_plain(cache_bits, colours):
    pixels = noisy(19, 13, colours)
    w = head(19, 13)
    w.put(0, 1)
    image(w, pixels, 19, cache_bits=cache_bits)
    assert webp.decode(finish(w)).ravel().tolist() == pixels


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height, bits = 11, 9, 2
    pixels = noisy(width, height, 200, mode)
    left = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        guess = (pixels[i - 1] if x else 0xFF000000) if not y else pixels[i - width] if not x else webp.predicted(mode, pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])
        left.append(sum(((p >> s & 255) - (guess >> s & 255) & 255) << s for s in (0, 8, 16, 24)))
    w = head(width, height)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(bits - 2, 3)
    across = -(-width // (1 << bits))
    image(w, [0xFF000000 | mode << 8] * (across * -(-height // (1 << bits))), across, main=False)
    w.put(0, 1)
    image(w, left, width)
    assert webp.decode(finish(w)).ravel().tolist() == pixels


def test_known_predictions():
    left, top, right, corner = 0x10203040, 0x20304050, 0x01020304, 0x18283848
    assert webp.predicted(7, left, top, right, corner) == 0x18283848 and webp.predicted(12, left, top, right, corner) == 0x18283848
    assert webp.predicted(11, 0xFF000000, 0xFF000010, 0, 0xFF000010) == 0xFF000000 and webp.predicted(12, 0xF0, 0xF0, 0, 0x10) == 0xFF
    assert webp.predicted(13, 0x10, 0x10, 0, 0x20) == 0x08 and webp.predicted(13, 0x10, 0x10, 0, 0x13) == 0x0F


def test_green_and_cross_colour():
    width, height, bits = 9, 7, 2
    pixels = noisy(width, height, 60, 3)
    signed = lambda v: (v & 255) - 256 * ((v & 255) >> 7)
    across = -(-width // (1 << bits))
    blocks = [0xFF000000 | (k * 37 & 255) << 16 | (k * 91 + 200 & 255) << 8 | (k * 53 + 7 & 255) for k in range(across * -(-height // (1 << bits)))]
    coded = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        e, green = blocks[(y >> bits) * across + (x >> bits)], p >> 8
        red = (p >> 16) - (signed(e) * signed(green) >> 5) & 255
        blue = (p & 255) - (signed(e >> 8) * signed(green) >> 5) - (signed(e >> 16) * signed(p >> 16) >> 5) & 255
        coded.append(p & 0xFF00FF00 | red << 16 | blue)
    minus = [p & 0xFF00FF00 | ((p >> 16 & 255) - (p >> 8 & 255) & 255) << 16 | (p & 255) - (p >> 8 & 255) & 255 for p in coded]
    w = head(width, height)
    w.put(1, 1)
    w.put(webp.CROSS_COLOR, 2)
    w.put(bits - 2, 3)
    image(w, blocks, across, main=False)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(0, 1)
    image(w, minus, width, cache_bits=3)
    assert webp.decode(finish(w)).ravel().tolist() == pixels


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 11, 16, 90])
def test_palette(colours):
    width, height = 13, 6
    rng = np.random.default_rng(colours)
    palette = [int(x) for x in rng.integers(0, 1 << 32, colours, dtype=np.uint64)]
    index = rng.integers(0, colours, width * height).reshape(height, width)
    pixels = [palette[k] for k in index.ravel()]
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, bits = 1 << packed, 8 >> packed
    rows = []
    for row in index:
        for a in range(0, width, per):
            rows.append(0xFF000000 | sum(int(v) << k * bits for k, v in enumerate(row[a : a + per])) << 8)
    deltas = [sum(((p >> s & 255) - ((palette[k - 1] if k else 0) >> s & 255) & 255) << s for s in (0, 8, 16, 24)) for k, p in enumerate(palette)]
    w = head(width, height)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(colours - 1, 8)
    image(w, deltas, colours, main=False)
    w.put(0, 1)
    image(w, rows, -(-width // per))
    assert webp.decode(finish(w)).ravel().tolist() == pixels


def test_meta_codes():
    width, height = 10, 8
    pixels = noisy(width, height, 40, 8)
    w = head(width, height)
    for bit in (0, 0, 1):  # no transform, no cache, meta codes
        w.put(bit, 1)
    w.put(0, 3)  # blocks of 4 x 4
    groups = [k % 3 for k in range(3 * 2)]
    image(w, [0xFF000000 | g << 8 for g in groups], 3, main=False)
    tables = []
    for g in range(3):
        own = [p for i, p in enumerate(pixels) if groups[(i // width >> 2) * 3 + (i % width >> 2)] == g]
        tables.append([w.codes(skewed(s, n)) for s, n in (([p >> 8 & 255 for p in own], 280), ([p >> 16 & 255 for p in own], 256), ([p & 255 for p in own], 256), ([p >> 24 for p in own], 256), ([0], 40))])
    for i, p in enumerate(pixels):
        for table, s in zip(tables[groups[(i // width >> 2) * 3 + (i % width >> 2)]], (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)):
            w.put(*table[s])
    assert webp.decode(finish(w)).ravel().tolist() == pixels


def prose(n, words=300, seed=0):
    rng = np.random.default_rng(seed)
    known = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäß.,"), int(k))) for k in rng.integers(2, 9, words)]
    out = " ".join(known[int(k) ** 2 // words] for k in rng.integers(0, words, n // 3)).encode()
    return out[:n]


def padded(raw, unit=576):
    return raw + b"\xff" * (unit * max(1, -(-len(raw) // unit)) - len(raw))


def plain_feature(images):
    """The feature by loops over samples."""
    out = []
    for payload, width in images:
        n, total = len(payload), sum(payload)
        cells = [sum(payload[n * k // 64 : n * (k + 1) // 64]) for k in range(64)]
        out.append(f"{width}x{n // width}|{total * 100 // n}|{sum((c * 64 > total) << 63 - k for k, c in enumerate(cells)):016x}")
    return ";".join(out)


PAYLOADS = [
    padded(b""),
    padded(b"a"),
    padded(b"abc"),
    padded(b"abcd" * 40),
    padded(b"0123456789abcde"),
    padded(b"0123456789abcdef"),
    padded(bytes(range(256))),
    padded(b"ab" * 5000),
    padded(b"x" * 9000),
    *(padded(prose(n, seed=n)) for n in (100, 575, 576, 577, 3000, 40000)),
    np.random.default_rng(1).integers(0, 256, 576 * 17, dtype=np.uint8).tobytes(),
    np.random.default_rng(2).integers(0, 2, 576 * 9, dtype=np.uint8).tobytes(),
]


@pytest.mark.parametrize("few", [0, 24])
def test_payloads(monkeypatch, few):
    """Together and each alone, read by array steps and one by one."""
    monkeypatch.setattr(webp, "FEW", few)
    files = webp.write_payloads(PAYLOADS)
    assert [webp.payload_of(x) for x in webp.decode_many(files)] == PAYLOADS
    assert [webp.write_payloads([p])[0] for p in PAYLOADS] == files
    for file, payload in zip(files, PAYLOADS):
        image = webp.decode(file)
        assert len(file) == 8 + int.from_bytes(file[4:8], "little") and image.shape == (len(payload) // 576, 576) and webp.file_pixels(file) == len(payload)
        assert webp.features(image) == plain_feature([(payload, 576)])
        assert (image >> 24 == 255).all() and (image >> 8 & 255 == image & 255).all() and (image >> 16 & 255 == image & 255).all()
    assert len(files[-3]) < 0.6 * len(PAYLOADS[-3])  # prose becomes smaller


def test_symbol_by_symbol():
    """The general reader agrees with the one by array steps."""
    for file in webp.write_payloads(PAYLOADS):
        image, width, undo = webp._opened(file)
        flat = webp._symbols(image)
        for invert, args in reversed(undo):
            flat = invert(flat, *args)
        assert (flat.reshape(image.height, width) == webp.decode(file)).all()


def test_copies():
    """Tokens tile each image, and what they copy is there."""
    parts = [np.frombuffer(p, np.uint8) for p in PAYLOADS]
    first = np.cumsum([0, *map(len, parts)])
    samples = np.concatenate(parts)
    at, length, distance = webp_write.copies(samples, first)
    assert (np.diff(np.append(at, len(samples))) == length).all() and set(first[:-1]) <= set(at)
    for i, n, d in zip(at.tolist(), length.tolist(), distance.tolist()):
        if n > 1:
            begin = first[np.searchsorted(first, i, side="right") - 1]
            assert i - d >= begin and all(samples[k] == samples[k - d] for k in range(i, i + n))


@pytest.mark.parametrize("counts", [[5], [1, 1], [1, 2, 4, 8], [2**k for k in range(30)], [1] * 280, [0, 3, 0, 9, 1]])
def test_code_lengths(counts):
    lengths = webp_write.code_lengths(np.array(counts))
    used = [int(n) for n, c in zip(lengths, counts) if c]
    assert max(used) <= webp_write.LONGEST and all(n == 0 for n, c in zip(lengths, counts) if not c)
    assert len(used) == 1 or sum(2.0**-n for n in used) == 1


@pytest.mark.parametrize("value", [1, 2, 4, 5, 6, 7, 100, 4096, 1 << 20])
def test_prefixes(value):
    symbol, bits, extra = (int(x[0]) for x in webp_write.prefixes(np.array([value])))
    assert (symbol, bits, extra) == prefix(value)


def test_several_images():
    payload = np.random.default_rng(1).integers(0, 256, 576 * 50, dtype=np.uint8).tobytes()
    files = webp.files(webp.write_payloads([payload], rows=20)[0])
    assert len(files) == 3 and b"".join(webp.payload_of(x) for x in webp.decode_many(files)) == payload


def test_long_text(spark):
    """A text of several images, 11 MB."""
    text = prose(11_000_003).decode(errors="ignore")
    r = webp.load(webp.store(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    payload = padded(text.encode())
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert r["feature"].count(";") == len(payload) // (576 * webp.ROWS)


def test_mixed_batch():
    """Images of every kind in one batch."""
    pixels = noisy(19, 13, 40)
    w = head(19, 13)
    w.put(0, 1)
    image(w, pixels, 19, cache_bits=4)
    v = head(19, 13)
    v.put(0, 1)
    image(v, pixels, 19)
    batch = [finish(w), finish(v)] * 20 + webp.write_payloads(PAYLOADS)
    got = webp.decode_many(batch)
    assert all(x.ravel().tolist() == pixels for x in got[:40]) and [webp.payload_of(x) for x in got[40:]] == PAYLOADS


def test_errors():
    good = webp.write_payloads([padded(prose(4000))])[0]
    for bad in (b"", b"RIFF0000WEBPVP8 " + b"\0" * 8, good[:20] + b"\0" + good[21:], b"JUNK" + good[4:], good[:16] + (300).to_bytes(4, "little") + good[20:320]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_columns(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 1000), (4, "é" * 1000), (None, "x" * 576)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, media int")
    got = webp.load(webp.store(docs)).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert webp.load(webp.store(docs.limit(0))).isEmpty()
    assert all(r["media_sha256"] == hashlib.sha256(webp.write_payloads([padded((t or "").encode())])[0]).hexdigest() and r["feature"] == plain_feature([(padded((t or "").encode()), 576)]) for r in got for i, t in rows if i == r["doc_id"])
    image = webp.pixels(webp.store(docs.filter("doc_id = 1"))).first()
    assert (image["width"], image["height"], len(image["argb"])) == (576, 1, 576)
