"""More image file codecs in plain Python and numpy: TIFF, DPX, Cineon, GIF, ICO, DDS and PSD."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lumenframe.sources.codecs import CODECS, Codec, Pixels, decode_png, encode_png, to_bytes


def packbits(data: bytes, size: int) -> bytes:
    """Runs and literals of the PackBits scheme, until size bytes are there."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size])


def lzw(data: bytes, width: int, big_endian: bool, early: int) -> bytes:
    """LZW codes of growing size; width is that of a literal, early how many codes before the table is full the size grows."""
    clear, end = 1 << width, (1 << width) + 1
    table: list[bytes] = []
    out, bits, held, size, before = bytearray(), 0, 0, width + 1, b""
    for byte in data:
        bits = bits << 8 | byte if big_endian else bits | byte << held
        held += 8
        while held >= size:
            if big_endian:
                code = bits >> (held - size)
                bits &= (1 << (held - size)) - 1
            else:
                code = bits & ((1 << size) - 1)
                bits >>= size
            held -= size
            if code == end:
                return bytes(out)
            if code == clear:
                table = [bytes([k]) for k in range(clear)] + [b"", b""]
                size, before = width + 1, b""
                continue
            if code < len(table):
                word = table[code]
            elif before:
                word = before + before[:1]
            else:
                raise ValueError("bad LZW code")
            if before and len(table) < 4096:
                table.append(before + word[:1])
            out += word
            before = word
            if len(table) + early >= 1 << size and size < 12:
                size += 1
    return bytes(out)


# The TIFF tags in use.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
TYPES = {1: "B", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def tiff_tags(data: bytes, order: str, at: int) -> dict[int, tuple]:
    """The numeric tags of the directory at a place."""
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in TYPES:
            fmt = f"{order}{TYPES[kind] * count}"
            place = at + 10 + 12 * k
            if struct.calcsize(fmt) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            tags[tag] = struct.unpack_from(fmt, data, place)
    return tags


def decode_tiff(data: bytes) -> Pixels:
    """The first directory: strips or tiles, contiguous or separate, plain, LZW, deflate or PackBits, with a horizontal predictor."""
    order = "<" if data[:2] == b"II" else ">"
    t = tiff_tags(data, order, struct.unpack_from(order + "I", data, 4)[0])
    one = lambda tag, default: t.get(tag, (default,))[0]
    w, h, n, bits, kind, planar = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1), one(FORMAT, 1), one(PLANAR, 1)
    tiled = TILE_WIDTH in t
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (w, min(one(ROWS, h), h))
    offsets, counts = (t[TILE_OFFSETS], t[TILE_COUNTS]) if tiled else (t[OFFSETS], t[COUNTS])
    own = 1 if planar == 2 else n
    across, down = -(-w // bw), -(-h // bh)
    out = np.zeros((h, w, n))
    for k, (at, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(k, across * down)
        y0, x0 = place // across * bh, place % across * bw
        rows = bh if tiled else min(bh, h - y0)
        line = -(-bw * own * bits // 8)
        raw = _unpacked(data[at : at + count], one(COMPRESSION, 1), rows * line)
        v = _samples(raw, rows, bw, own, bits, kind, order, one(PREDICTOR, 1))
        v = v[: h - y0, : w - x0]
        c = slice(plane, plane + 1) if planar == 2 else slice(0, n)
        out[y0 : y0 + v.shape[0], x0 : x0 + v.shape[1], c] = v
    photometric = one(PHOTOMETRIC, 1)
    if photometric == 0:
        out[:, :, 0] = 1 - out[:, :, 0]
    if photometric == 3 and PALETTE in t:
        colors = np.array(t[PALETTE]).reshape(3, -1).T / 65535.0
        return colors[np.rint(out[:, :, 0] * ((1 << bits) - 1)).astype(int)]
    return out


def _unpacked(raw: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        return raw
    if compression == 5:
        return lzw(raw, 8, True, 1)[:size]
    if compression in (8, 32946):
        return zlib.decompress(raw)
    if compression == 32773:
        return packbits(raw, size)
    raise ValueError(f"TIFF compression {compression}")


def _samples(raw: bytes, rows: int, width: int, n: int, bits: int, kind: int, order: str, predictor: int) -> np.ndarray:
    """Normalised samples; integers to 0 and 1, floats as they are."""
    if kind == 3:
        return np.frombuffer(raw, f"{order}f{bits // 8}", rows * width * n).reshape(rows, width, n).astype(float)
    if bits in (8, 16, 32):
        v = np.frombuffer(raw, f"{order}u{bits // 8}", rows * width * n).reshape(rows, width, n)
        if predictor == 2:
            v = np.cumsum(v, axis=1, dtype=v.dtype)
        return v / float((1 << bits) - 1)
    line = -(-width * n * bits // 8)
    wide = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : width * n * bits]
    return (wide.reshape(rows, width * n, bits) @ (1 << np.arange(bits)[::-1])).reshape(rows, width, n) / float((1 << bits) - 1)


def encode_tiff(v: Pixels) -> bytes:
    """One deflated strip of 16-bit samples, little endian."""
    h, w, n = v.shape
    pixels = zlib.compress(to_bytes(v, 16).astype("<u2").tobytes())
    tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [16] * n), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [2 if n > 2 else 1]), (OFFSETS, 4, [0]), (SAMPLES, 3, [n]), (ROWS, 4, [h]), (COUNTS, 4, [len(pixels)]), (PLANAR, 3, [1]), (FORMAT, 3, [1] * n)]
    place = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", b""
    for tag, kind, values in tags:
        packed = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(packed) > 4:
            own, extra = struct.pack("<I", place + len(extra)), extra + packed
        else:
            own = packed.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + own
    start = place + len(extra)
    entries = entries.replace(struct.pack("<HHII", OFFSETS, 4, 1, 0), struct.pack("<HHII", OFFSETS, 4, 1, start))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra + pixels


def _ten_bits(data: bytes, order: str, at: int, count: int) -> np.ndarray:
    """Three 10-bit samples in the upper bits of each 32-bit word."""
    words = np.frombuffer(data, f"{order}u4", -(-count // 3), at)
    return np.stack([words >> 22 & 1023, words >> 12 & 1023, words >> 2 & 1023], 1).ravel()[:count] / 1023.0


# DPX descriptors and how many channels each has.
DPX_CHANNELS = {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 50: 3, 51: 4, 52: 4}


def decode_dpx(data: bytes) -> Pixels:
    """The first element: 8, 10 (filled, method A) or 16 bits."""
    order = ">" if data[:4] == b"SDPX" else "<"
    start = struct.unpack_from(order + "I", data, 4)[0]
    w, h = struct.unpack_from(order + "II", data, 772)
    descriptor, bits = data[800], data[803]
    at = struct.unpack_from(order + "I", data, 808)[0]
    at = at if 0 < at < len(data) else start
    n = DPX_CHANNELS.get(descriptor, 3)
    if bits == 10:
        line = -(-w * n // 3) * 4
        v = np.stack([_ten_bits(data, order, at + y * line, w * n) for y in range(h)])
    elif bits in (8, 16):
        v = np.frombuffer(data, f"{order}u{bits // 8}", h * w * n, at) / float((1 << bits) - 1)
    else:
        raise ValueError(f"DPX of {bits} bits")
    v = v.reshape(h, w, n)
    return v[:, :, ::-1] if descriptor == 52 else v


def encode_dpx(v: Pixels) -> bytes:
    """Big endian, 16 bits, one element."""
    h, w, n = v.shape
    head = bytearray(2048)
    struct.pack_into(">4sI8sI", head, 0, b"SDPX", 2048, b"V2.0", 2048 + 2 * v.size)
    struct.pack_into(">HHII", head, 768, 0, 1, w, h)
    head[800], head[803] = {1: 6, 3: 50, 4: 51}[n], 16
    struct.pack_into(">I", head, 808, 2048)
    return bytes(head) + to_bytes(v, 16).astype(">u2").tobytes()


def decode_cineon(data: bytes) -> Pixels:
    """RGB of 10 bits, three samples in a word."""
    order = ">" if data[:4] == b"\x80\x2a\x5f\xd7" else "<"
    at = struct.unpack_from(order + "I", data, 4)[0]
    n = data[193]
    w, h = struct.unpack_from(order + "II", data, 200)
    return _ten_bits(data, order, at, w * h * n).reshape(h, w, n)


def encode_cineon(v: Pixels) -> bytes:
    rgb = v if v.shape[2] == 3 else np.repeat(v[:, :, :1], 3, 2)
    h, w, n = rgb.shape
    head = bytearray(1024)
    struct.pack_into(">4sI", head, 0, b"\x80\x2a\x5f\xd7", 1024)
    head[193] = n
    for k in range(n):
        head[196 + 28 * k : 200 + 28 * k] = bytes([0, k + 1, 10, 0])
        struct.pack_into(">II", head, 200 + 28 * k, w, h)
    q = np.floor(np.clip(rgb, 0, 1) * 1023 + 0.5).astype(np.uint32)
    return bytes(head) + (q[:, :, 0] << 22 | q[:, :, 1] << 12 | q[:, :, 2] << 2).astype(">u4").tobytes()


def decode_gif(data: bytes) -> Pixels:
    """The first frame on the whole canvas; alpha if it has a transparent colour or leaves some of the canvas free."""
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, clear = 13, -1
    colors = np.zeros((256, 3))

    def palette(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3) / 255.0, at + 3 * n

    if flags & 128:
        colors, at = palette(at, flags)
    while data[at] != 0x2C:
        if data[at] != 0x21:
            raise ValueError("GIF without an image")
        if data[at + 1] == 0xF9 and data[at + 3] & 1:
            clear = data[at + 6]
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    x0, y0, fw, fh, own = struct.unpack_from("<HHHHB", data, at + 1)
    at += 10
    if own & 128:
        colors, at = palette(at, own)
    width, blocks = data[at], b""
    at += 1
    while data[at]:
        blocks += data[at + 1 : at + 1 + data[at]]
        at += data[at] + 1
    index = np.frombuffer(lzw(blocks, width, False, 0)[: fw * fh].ljust(fw * fh, b"\0"), np.uint8).reshape(fh, fw)
    if own & 64:  # interlaced: every eighth row, then those between
        rows = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, fh, step)]
        plain = np.empty_like(index)
        plain[rows] = index
        index = plain
    out = np.zeros((h, w, 4))
    out[y0 : y0 + fh, x0 : x0 + fw, :3] = colors[np.minimum(index, len(colors) - 1)]
    out[y0 : y0 + fh, x0 : x0 + fw, 3] = index != clear
    return out if (out[:, :, 3] < 1).any() else out[:, :, :3]


def encode_gif(v: Pixels) -> bytes:
    """Colours of a 6 x 7 x 6 cube; codes of nine bits, with a clear code before the table grows."""
    rgb = v[:, :, :3] if v.shape[2] >= 3 else np.repeat(v[:, :, :1], 3, 2)
    h, w, _ = rgb.shape
    r, g, b = (np.rint(np.clip(rgb[:, :, k], 0, 1) * n).astype(int) for k, n in enumerate((5, 6, 5)))
    index = (r * 42 + g * 6 + b).ravel().tolist()
    colors = bytes(round(255 * x / n) for k in range(252) for x, n in ((k // 42, 5), (k // 6 % 7, 6), (k % 6, 5))).ljust(768, b"\0")
    codes = []
    for k in range(0, len(index), 250):
        codes += [256, *index[k : k + 250]]
    bits = 0
    for place, code in enumerate([*codes, 257]):
        bits |= code << 9 * place
    raw = bits.to_bytes(-(-9 * (len(codes) + 1) // 8), "little")
    blocks = b"".join(bytes([len(raw[k : k + 255])]) + raw[k : k + 255] for k in range(0, len(raw), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + colors + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b"\0\x3b"


def decode_ico(data: bytes) -> Pixels:
    """The largest image: a PNG, or a bitmap of 24 or 32 bits, or with a palette of 8."""
    entries = [struct.unpack_from("<BBBBHHII", data, 6 + 16 * k) for k in range(struct.unpack_from("<H", data, 4)[0])]
    *_, size, at = max(entries, key=lambda e: (e[0] or 256) * (e[1] or 256))
    own = data[at : at + size]
    if own[:4] == b"\x89PNG":
        return decode_png(own)
    head, w, h, _, bits = struct.unpack_from("<IiiHH", own, 0)
    h, place = h // 2, head
    if bits == 8:
        n = struct.unpack_from("<I", own, 32)[0] or 256
        colors = np.frombuffer(own, np.uint8, 4 * n, place).reshape(n, 4)[:, 2::-1] / 255.0
        line = -(-w // 4) * 4
        index = np.frombuffer(own, np.uint8, line * h, place + 4 * n).reshape(h, line)[::-1, :w]
        return colors[index]
    line = -(-w * bits // 32) * 4
    rows = np.frombuffer(own, np.uint8, line * h, place).reshape(h, line)[::-1, : w * bits // 8].reshape(h, w, bits // 8)
    return rows[:, :, [2, 1, 0, 3][: bits // 8]] / 255.0


def encode_ico(v: Pixels) -> bytes:
    if max(v.shape[:2]) > 256:
        raise ValueError("an icon has 256 pixels a side at most")
    png = encode_png(v)
    return struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", v.shape[1] % 256, v.shape[0] % 256, 0, 0, 1, 32, len(png), 22) + png


def decode_dds(data: bytes) -> Pixels:
    """The top level of one image: pixels with bit masks, or blocks of the DXT1 kind."""
    h, w = struct.unpack_from("<II", data, 12)
    flags, four, bits, *masks = struct.unpack_from("<I4sIIIII", data, 80)
    if flags & 4:
        if four != b"DXT1":
            raise ValueError(f"DDS blocks {four!r}")
        return _dxt1(data, w, h)
    size = bits // 8
    raw = np.frombuffer(data, np.uint8, w * h * size, 128).reshape(h, w, size).astype(np.uint32)
    value = sum(raw[:, :, k] << (8 * k) for k in range(size))
    used = [m for m in masks if m]
    shift = [(m & -m).bit_length() - 1 for m in used]
    return np.stack([(value & m) >> s for m, s in zip(used, shift, strict=True)], 2) / np.array([float(m >> s) for m, s in zip(used, shift, strict=True)])


def _dxt1(data: bytes, w: int, h: int) -> Pixels:
    """Blocks of four by four: two colours of 5, 6 and 5 bits, and two bits a pixel between them."""
    bw, bh = -(-w // 4), -(-h // 4)
    blocks = np.frombuffer(data, np.dtype([("c", "<u2", 2), ("bits", "<u4")]), bw * bh, 128)
    ends = np.stack([(blocks["c"] >> 11) / 31.0, (blocks["c"] >> 5 & 63) / 63.0, (blocks["c"] & 31) / 31.0, np.ones((len(blocks), 2))], 2)
    a, b = ends[:, 0], ends[:, 1]
    four = (blocks["c"][:, 0] > blocks["c"][:, 1])[:, None]
    table = np.stack([a, b, np.where(four, (2 * a + b) / 3, (a + b) / 2), np.where(four, (a + 2 * b) / 3, 0.0)], 1)
    index = blocks["bits"][:, None] >> (2 * np.arange(16, dtype=np.uint32)) & 3
    pixels = np.take_along_axis(table, index[:, :, None].astype(int), 1).reshape(bh, bw, 4, 4, 4)
    out = pixels.transpose(0, 2, 1, 3, 4).reshape(bh * 4, bw * 4, 4)[:h, :w]
    return out if (out[:, :, 3] < 1).any() else out[:, :, :3]


def encode_dds(v: Pixels) -> bytes:
    """Thirty-two bits a pixel: blue, green, red, alpha."""
    h, w, n = v.shape
    full = np.ones((h, w, 4))
    full[:, :, :3] = v[:, :, :3] if n >= 3 else v[:, :, :1]
    if n == 4:
        full[:, :, 3] = v[:, :, 3]
    head = bytearray(128)
    struct.pack_into("<4sIIIII", head, 0, b"DDS ", 124, 0x100F, h, w, 4 * w)
    struct.pack_into("<II4sIIIII", head, 76, 32, 0x41, b"\0" * 4, 32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000)
    struct.pack_into("<I", head, 108, 0x1000)
    return bytes(head) + to_bytes(full[:, :, [2, 1, 0, 3]]).tobytes()


def decode_psd(data: bytes) -> Pixels:
    """The composite image of 8 or 16 bits, plain or PackBits."""
    n, h, w, bits, _ = struct.unpack_from(">HIIHH", data, 12)
    at = 26
    for _ in range(3):
        at += 4 + struct.unpack_from(">I", data, at)[0]
    packed = struct.unpack_from(">H", data, at)[0]
    at += 2
    line = w * bits // 8
    if packed == 0:
        raw = data[at : at + n * h * line]
    elif packed == 1:
        sizes = struct.unpack_from(f">{n * h}H", data, at)
        at += 2 * n * h
        rows = []
        for s in sizes:
            rows.append(packbits(data[at : at + s], line))
            at += s
        raw = b"".join(rows)
    else:
        raise ValueError(f"PSD compression {packed}")
    return np.frombuffer(raw, f">u{bits // 8}").reshape(n, h, w).transpose(1, 2, 0) / float((1 << bits) - 1)


CODECS |= {
    "tiff": Codec(("tif", "tiff", "env", "sm", "tx", "vsm"), lambda d: d[:4] in (b"II*\0", b"MM\0*"), decode_tiff, encode_tiff),
    "dpx": Codec(("dpx",), lambda d: d[:4] in (b"SDPX", b"XPDS"), decode_dpx, encode_dpx),
    "cineon": Codec(("cin",), lambda d: d[:4] in (b"\x80\x2a\x5f\xd7", b"\xd7\x5f\x2a\x80"), decode_cineon, encode_cineon),
    "gif": Codec(("gif",), lambda d: d[:6] in (b"GIF87a", b"GIF89a"), decode_gif, encode_gif),
    "ico": Codec(("ico",), lambda d: d[:4] == b"\0\0\1\0", decode_ico, encode_ico),
    "dds": Codec(("dds",), lambda d: d[:4] == b"DDS ", decode_dds, encode_dds),
    "psd": Codec(("psd", "pdd"), lambda d: d[:4] == b"8BPS", decode_psd, None),
}
# Targa has no signature of its own, so it is asked last.
for _name in ("targa", "term", "null"):
    CODECS[_name] = CODECS.pop(_name)
