"""Image file codecs in plain Python and numpy: bytes to arrays of normalised floats and back.

Each codec is a probe of the content, a decoder and an encoder; those formats
that need a library which may be missing are not listed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Pixels = np.ndarray  # height, width, channels


@dataclass(frozen=True)
class Codec:
    extensions: tuple[str, ...]
    probe: Callable[[bytes], bool]
    decode: Callable[[bytes], Pixels] | None
    encode: Callable[[Pixels], bytes] | None


def to_bytes(v: Pixels, bits: int = 8) -> np.ndarray:
    top = (1 << bits) - 1
    return np.floor(np.clip(np.nan_to_num(v) * top + 0.5, 0, top)).astype(np.uint8 if bits == 8 else np.uint16)


def _tokens(data: bytes, n: int, at: int = 2) -> tuple[list[int], int]:
    """The next n numbers of a header with comments, and where the data start."""
    out: list[int] = []
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_pnm(data: bytes) -> Pixels:
    kind = data[:2]
    if kind in (b"PF", b"Pf"):
        head = data.split(None, 4)
        w, h, scale = int(head[1]), int(head[2]), float(head[3])
        n = 3 if kind == b"PF" else 1
        raw = np.frombuffer(data[len(data) - w * h * n * 4 :], "<f4" if scale < 0 else ">f4")
        return raw.reshape(h, w, n)[::-1].astype(float)
    n = 3 if kind in (b"P3", b"P6") else 1
    bitmap = kind in (b"P1", b"P4")
    size, at = _tokens(data, 2 if bitmap else 3)
    w, h = size[:2]
    top = 1 if bitmap else size[2]
    if kind == b"P1":
        return 1.0 - np.array([c - 48 for c in data[at:] if c in b"01"], float)[: w * h].reshape(h, w, 1)
    if kind in (b"P2", b"P3"):
        return np.array(data[at:].split()[: w * h * n], float).reshape(h, w, n) / top
    if kind == b"P4":
        rows = np.frombuffer(data[at:], np.uint8)[: -(-w // 8) * h].reshape(h, -1)
        return 1.0 - np.unpackbits(rows, axis=1)[:, :w, None].astype(float)
    raw = np.frombuffer(data[at:], np.uint8 if top < 256 else ">u2")[: w * h * n]
    return raw.reshape(h, w, n) / top


def encode_pnm(v: Pixels) -> bytes:
    h, w, n = v.shape
    rgb = n >= 3
    return b"P%d\n%d %d\n255\n" % (6 if rgb else 5, w, h) + to_bytes(v[:, :, : 3 if rgb else 1]).tobytes()


def encode_pfm(v: Pixels) -> bytes:
    h, w, n = v.shape
    rgb = n >= 3
    return b"%s\n%d %d\n-1.0\n" % (b"PF" if rgb else b"Pf", w, h) + v[::-1, :, : 3 if rgb else 1].astype("<f4").tobytes()


def decode_bmp(data: bytes) -> Pixels:
    start, = struct.unpack_from("<I", data, 10)
    header, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) & ~3
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, -1)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        n = (start - 14 - header) // 4
        table = np.frombuffer(data, np.uint8, 4 * n, 14 + header).reshape(n, 4)
        rows = table[rows[:, :, 0]][:, :, :3]
    order = [2, 1, 0, 3] if rows.shape[2] == 4 else [2, 1, 0]
    return rows[:, :, order] / 255.0


def encode_bmp(v: Pixels) -> bytes:
    h, w, _ = v.shape
    rgb = to_bytes(np.repeat(v[:, :, :1], 3, 2) if v.shape[2] < 3 else v[:, :, :3])
    stride = (w * 3 + 3) & ~3
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_tga(data: bytes) -> Pixels:
    skip, _, kind = data[0], data[1], data[2]
    w, h, bits, flags = struct.unpack_from("<HHBB", data, 12)
    n, at = bits // 8, 18 + skip
    if kind in (2, 3):
        raw = np.frombuffer(data, np.uint8, w * h * n, at)
    elif kind in (10, 11):
        out, need = bytearray(), w * h * n
        while len(out) < need:
            head, at = data[at], at + 1
            count = (head & 127) + 1
            if head & 128:
                out += data[at : at + n] * count
                at += n
            else:
                out += data[at : at + n * count]
                at += n * count
        raw = np.frombuffer(bytes(out[:need]), np.uint8)
    else:
        raise ValueError("unsupported TGA")
    v = raw.reshape(h, w, n)
    v = v if flags & 32 else v[::-1]
    return (v if n == 1 else v[:, :, [2, 1, 0, 3][:n]]) / 255.0


def encode_tga(v: Pixels) -> bytes:
    h, w, n = v.shape
    n = 1 if n < 3 else min(n, 4)
    raw = to_bytes(v[:, :, :n])
    raw = raw if n == 1 else raw[:, :, [2, 1, 0, 3][:n]]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if n == 1 else 2, 0, 0, 0, 0, 0, w, h, 8 * n, 32 | (8 if n == 4 else 0)) + raw.tobytes()


def decode_hdr(data: bytes) -> Pixels:
    at = data.index(b"\n\n") + 2
    end = data.index(b"\n", at)
    size = data[at:end].split()
    h, w, at = int(size[1]), int(size[3]), end + 1
    out = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if data[at : at + 2] != b"\2\2" or not 8 <= w < 32768:
            out[y] = np.frombuffer(data, np.uint8, w * 4, at).reshape(w, 4)
            at += w * 4
            continue
        at += 4
        for c in range(4):
            x = 0
            while x < w:
                n, at = data[at], at + 1
                if n > 128:
                    out[y, x : x + n - 128, c] = data[at]
                    x, at = x + n - 128, at + 1
                else:
                    out[y, x : x + n, c] = np.frombuffer(data, np.uint8, n, at)
                    x, at = x + n, at + n
    scale = np.where(out[:, :, 3:] > 0, np.ldexp(1.0, out[:, :, 3:].astype(int) - 136), 0.0)
    return out[:, :, :3] * scale


def encode_hdr(v: Pixels) -> bytes:
    h, w, _ = v.shape
    rgb = np.maximum(np.repeat(v[:, :, :1], 3, 2) if v.shape[2] < 3 else v[:, :, :3], 0)
    top = rgb.max(2)
    exponent = np.frexp(top)[1]
    out = np.zeros((h, w, 4), np.uint8)
    lit = top > 1e-32
    out[lit, :3] = (rgb * np.ldexp(1.0, 8 - exponent)[:, :, None])[lit]
    out[lit, 3] = (exponent + 128)[lit]
    return b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y %d +X %d\n" % (h, w) + out.tobytes()


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def decode_png(data: bytes) -> Pixels:
    at, body, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, bits, color, _, _, interlace = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += size + 12
    if interlace or bits not in (8, 16):
        raise ValueError("unsupported PNG")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step, stride = n * bits // 8, w * n * bits // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    before = np.zeros(stride, np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + before
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0).ravel()
        elif kind in (3, 4):
            for i in range(stride):
                a = line[i - step] if i >= step else 0
                b, c = before[i], before[i - step] if i >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    d = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                    guess = a if d[0] <= d[1] and d[0] <= d[2] else b if d[1] <= d[2] else c
                line[i] = (line[i] + guess) & 255
        before = line & 255
        out[y] = before
    v = out.view(">u2") if bits == 16 else out
    v = v.reshape(h, w, n)
    return palette[v[:, :, 0]] / 255.0 if color == 3 else v / float((1 << bits) - 1)


def encode_png(v: Pixels) -> bytes:
    h, w, n = v.shape
    n = min(n, 4)
    rows = np.zeros((h, 1 + w * n), np.uint8)
    rows[:, 1:] = to_bytes(v[:, :, :n]).reshape(h, -1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def decode_sgi(data: bytes) -> Pixels:
    _, packed, size, _, w, h, n = struct.unpack_from(">hBBHHHH", data, 0)
    kind = np.uint8 if size == 1 else np.dtype(">u2")
    out = np.zeros((n, h, w))
    if not packed:
        out[:] = np.frombuffer(data, kind, n * h * w, 512).reshape(n, h, w)
    else:
        starts = np.frombuffer(data, ">u4", n * h, 512).reshape(n, h)
        for c in range(n):
            for y in range(h):
                at, x = int(starts[c, y]), 0
                while x < w:
                    head = int.from_bytes(data[at : at + size], "big") & 255
                    at += size
                    count = head & 127
                    if not count:
                        break
                    if head & 128:
                        out[c, y, x : x + count] = np.frombuffer(data, kind, count, at)
                        at += count * size
                    else:
                        out[c, y, x : x + count] = np.frombuffer(data, kind, 1, at)[0]
                        at += size
                    x += count
    return out.transpose(1, 2, 0)[::-1] / float((1 << 8 * size) - 1)


def encode_sgi(v: Pixels) -> bytes:
    h, w, n = v.shape
    head = struct.pack(">hBBHHHHii", 474, 0, 1, 3 if n > 1 else 2, w, h, n, 0, 255)
    return head + bytes(512 - len(head)) + to_bytes(v[::-1]).transpose(2, 0, 1).tobytes()


def decode_fits(data: bytes) -> Pixels:
    cards: dict[str, str] = {}
    at = 0
    while True:
        block = data[at : at + 2880].decode("ascii")
        at += 2880
        for i in range(0, 2880, 80):
            key, _, value = block[i : i + 80].partition("=")
            cards.setdefault(key.strip(), value.split("/")[0].strip())
        if "END" in cards:
            break
    bits, dims = int(cards["BITPIX"]), [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards["NAXIS"]))]
    kind = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bits]
    w, h, n = (dims + [1, 1])[:3]
    v = np.frombuffer(data, kind, w * h * n, at).reshape(n, h, w).transpose(1, 2, 0)[::-1].astype(float)
    return v if bits < 0 else v / (255.0 if bits == 8 else float((1 << (bits - 1)) - 1))


def encode_fits(v: Pixels) -> bytes:
    h, w, n = v.shape
    cards = [("SIMPLE", "T"), ("BITPIX", "-32"), ("NAXIS", "3"), ("NAXIS1", str(w)), ("NAXIS2", str(h)), ("NAXIS3", str(n))]
    head = "".join(f"{k:<8}= {x:>20}".ljust(80) for k, x in cards) + "END".ljust(80)
    body = v[::-1].transpose(2, 0, 1).astype(">f4").tobytes()
    pad = lambda b, c: b + c * (-len(b) % 2880)
    return pad(head.encode(), b" ") + pad(body, b"\0")


def decode_zfile(data: bytes) -> Pixels:
    magic, w, h = struct.unpack_from("<ihh", data, 0)
    order = "<" if magic == 0x2F0867AB else ">"
    if order == ">":
        _, w, h = struct.unpack_from(">ihh", data, 0)
    return np.frombuffer(zlib.decompress(data[136:]), order + "f4").reshape(h, w, 1).astype(float)


def encode_zfile(v: Pixels) -> bytes:
    h, w, _ = v.shape
    return struct.pack("<ihh", 0x2F0867AB, w, h) + bytes(128) + zlib.compress(v[:, :, 0].astype("<f4").tobytes())


def encode_term(v: Pixels) -> bytes:
    """Blocks of 24-bit colour for a terminal."""
    rgb = to_bytes(np.repeat(v[:, :, :1], 3, 2) if v.shape[2] < 3 else v[:, :, :3])
    return b"\n".join(b"".join(b"\x1b[48;2;%d;%d;%dm " % tuple(p) for p in row.tolist()) + b"\x1b[0m" for row in rgb) + b"\n"


CODECS: dict[str, Codec] = {
    "pnm": Codec(("pbm", "pgm", "pnm", "ppm"), lambda d: d[:1] == b"P" and d[1:2] in b"123456", decode_pnm, encode_pnm),
    "pfm": Codec(("pfm",), lambda d: d[:2] in (b"PF", b"Pf"), decode_pnm, encode_pfm),
    "bmp": Codec(("bmp", "dib"), lambda d: d[:2] == b"BM", decode_bmp, encode_bmp),
    "png": Codec(("png",), lambda d: d[:8] == b"\x89PNG\r\n\x1a\n", decode_png, encode_png),
    "hdr": Codec(("hdr", "rgbe"), lambda d: d[:2] == b"#?", decode_hdr, encode_hdr),
    "sgi": Codec(("bw", "int", "inta", "rgb", "rgba", "sgi"), lambda d: d[:2] == b"\x01\xda", decode_sgi, encode_sgi),
    "fits": Codec(("fits",), lambda d: d[:6] == b"SIMPLE", decode_fits, encode_fits),
    "zfile": Codec(("zfile",), lambda d: d[:4] in (b"\xab\x67\x08\x2f", b"\x2f\x08\x67\xab"), decode_zfile, encode_zfile),
    "targa": Codec(("tga", "tpic"), lambda d: len(d) > 18 and d[2] in (2, 3, 10, 11), decode_tga, encode_tga),
    "term": Codec(("term",), lambda d: False, None, encode_term),
    "null": Codec(("nul", "null"), lambda d: False, None, lambda v: b""),
}


def by_name(name: str) -> Codec:
    """Of a format's name, an extension, or a file name."""
    name = name.rsplit(".", 1)[-1].lower()
    found = CODECS.get(name) or next((c for c in CODECS.values() if name in c.extensions), None)
    if found is None:
        raise ValueError(f"no codec for {name!r}")
    return found


def decode(data: bytes, filename: str = "") -> Pixels:
    """By content first, then by the file's extension."""
    found = next((c for c in CODECS.values() if c.probe(data)), None) or by_name(filename)
    if found.decode is None:
        raise ValueError(f"{filename!r} can only be written")
    return found.decode(data)


from lumenframe.sources import formats  # noqa: E402, F401  (its codecs join the table above)
