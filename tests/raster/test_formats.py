"""Files made byte by byte from the formats' own rules, and what is written read back."""

import struct
import zlib

import numpy as np
import pytest

from lumenframe.sources import codecs, formats


def tiff(order, tags, pixels):
    """A TIFF of plain rules: header, pixels, directory, then what does not fit in an entry."""
    at = 8 + len(pixels)
    at += at % 2
    place = at + 2 + 12 * len(tags) + 4
    body, extra = struct.pack(order + "H", len(tags)), b""
    for tag, kind, values in tags:
        raw = struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
        if len(raw) > 4:
            own, extra = struct.pack(order + "I", place + len(extra)), extra + raw
        else:
            own = raw.ljust(4, b"\0")
        body += struct.pack(order + "HHI", tag, kind, len(values)) + own
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at)
    return head + pixels + b"\0" * ((8 + len(pixels)) % 2) + body + b"\0" * 4 + extra


def strip_tags(w, h, n, bits, compression, photometric, size, more=()):
    return sorted([(256, 3, [w]), (257, 3, [h]), (258, 3, [bits] * n), (259, 3, [compression]), (262, 3, [photometric]), (273, 4, [8]), (277, 3, [n]), (278, 3, [h]), (279, 4, [size]), *more])


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_by_hand(order):
    rgb = np.arange(2 * 3 * 3).reshape(2, 3, 3) * 10
    raw = rgb.astype(np.uint8).tobytes()
    assert (codecs.decode(tiff(order, strip_tags(3, 2, 3, 8, 1, 2, len(raw)), raw)) * 255).round().tolist() == rgb.tolist()
    packed = zlib.compress(rgb.astype(order + "u2").tobytes())
    assert (codecs.decode(tiff(order, strip_tags(3, 2, 3, 16, 8, 2, len(packed)), packed)) * 65535).round().tolist() == rgb.tolist()
    differences = rgb.copy()
    differences[:, 1:] -= rgb[:, :-1]
    raw = differences.astype(np.uint8).tobytes()
    assert (codecs.decode(tiff(order, strip_tags(3, 2, 3, 8, 1, 2, len(raw), [(317, 3, [2])]), raw)) * 255).round().tolist() == rgb.tolist()
    floats = np.array([[0.5, -2.0, 7.25]]).astype(order + "f4").tobytes()
    assert codecs.decode(tiff(order, strip_tags(3, 1, 1, 32, 1, 1, 12, [(339, 3, [3])]), floats)).ravel().tolist() == [0.5, -2.0, 7.25]


def test_tiff_kinds():
    # One bit, white is zero; PackBits: a run of three and a literal of two.
    assert codecs.decode(tiff("<", strip_tags(10, 1, 1, 1, 1, 0, 2), b"\xaa\x40")).ravel().tolist() == [0, 1, 0, 1, 0, 1, 0, 1, 1, 0]
    v = codecs.decode(tiff(">", strip_tags(5, 1, 1, 8, 32773, 1, 5), bytes([254, 51, 1, 102, 255])))
    assert (v * 5).round(6).ravel().tolist() == [1, 1, 1, 2, 5]
    # LZW, codes of nine bits: clear, 7, 258 (7 7), 8, end.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257)).ljust(48, "0")
    raw = int(bits, 2).to_bytes(6, "big")
    assert (codecs.decode(tiff("<", strip_tags(4, 1, 1, 8, 5, 1, 6), raw)) * 255).round().ravel().tolist() == [7, 7, 7, 8]
    # Two tiles of 16 x 16 beside each other, of an image 20 wide.
    a, b = np.full((16, 16), 3, np.uint8), np.full((16, 16), 9, np.uint8)
    tags = [(256, 3, [20]), (257, 3, [5]), (258, 3, [8]), (259, 3, [1]), (262, 3, [1]), (277, 3, [1]), (322, 3, [16]), (323, 3, [16]), (324, 4, [8, 264]), (325, 4, [256, 256])]
    got = (codecs.decode(tiff("<", tags, a.tobytes() + b.tobytes()))[:, :, 0] * 255).round()
    assert got.shape == (5, 20) and (got[:, :16] == 3).all() and (got[:, 16:] == 9).all()
    palette = [0, 65535, 0, 0] + [0, 0, 65535, 0] + [0, 0, 0, 65535]
    assert codecs.decode(tiff("<", strip_tags(4, 1, 1, 2, 1, 3, 1, [(320, 3, palette)]), bytes([0b00011011]))).tolist() == [[[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]]]


def test_tiff_long_lzw():
    """The table grows beyond nine, ten and eleven bits."""
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(0, 6, 20000, np.uint8))
    table, out, size, word = {bytes([k]): k for k in range(256)}, "", 9, b""
    codes = [(256, 9)]
    upto = 258
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        codes.append((table[word], size))
        table[word + bytes([c])] = upto
        upto += 1
        if upto == (1 << size):
            size += 1
        word = bytes([c])
        if upto == 4094:
            codes.append((table[word], size))
            codes.append((256, size))
            table, upto, size, word = {bytes([k]): k for k in range(256)}, 258, 9, b""
    if word:
        codes.append((table[word], size))
    codes.append((257, size))
    out = "".join(f"{c:0{s}b}" for c, s in codes)
    raw = int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")
    assert formats.lzw(raw, 8, True, 1) == data


def test_dpx_and_cineon_by_hand():
    word = 1023 << 22 | 512 << 12 | 1 << 2
    head = bytearray(2048)
    struct.pack_into(">4sI", head, 0, b"SDPX", 2048)
    struct.pack_into(">II", head, 772, 1, 1)
    head[800], head[803] = 50, 10
    struct.pack_into(">I", head, 808, 2048)
    assert (codecs.decode(bytes(head) + struct.pack(">I", word)) * 1023).round().tolist() == [[[1023, 512, 1]]]
    head = bytearray(1024)
    struct.pack_into(">4sI", head, 0, b"\x80\x2a\x5f\xd7", 1024)
    head[193] = 3
    struct.pack_into(">II", head, 200, 1, 1)
    assert (codecs.decode(bytes(head) + struct.pack(">I", word)) * 1023).round().tolist() == [[[1023, 512, 1]]]


def test_gif_by_hand():
    # Four colours; codes of three bits, then four: clear 4, 1, 2, 3, 0, end 5. The second colour is transparent.
    codes, bits, place = [(4, 3), (1, 3), (2, 3), (3, 3), (0, 4), (5, 4)], 0, 0
    for c, s in codes:
        bits |= c << place
        place += s
    raw = bits.to_bytes(-(-place // 8), "little")
    colors = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    control = b"\x21\xf9\x04\x01\0\0\x01\0"
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x91, 0, 0) + colors + control + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x02" + bytes([len(raw)]) + raw + b"\0\x3b"
    assert codecs.decode(data).tolist() == [[[1, 0, 0, 0], [0, 1, 0, 1]], [[0, 0, 1, 1], [0, 0, 0, 1]]]


def test_dds_by_hand():
    head = bytearray(128)
    struct.pack_into("<4sIIII", head, 0, b"DDS ", 124, 0, 4, 4)
    struct.pack_into("<II4s", head, 76, 32, 4, b"DXT1")
    block = struct.pack("<HHI", 0xF800, 0x001F, 0b11100100)  # red and blue; the first row is 0, 1, 2, 3
    v = codecs.decode(bytes(head) + block)
    assert np.allclose(v[0], [[1, 0, 0], [0, 0, 1], [2 / 3, 0, 1 / 3], [1 / 3, 0, 2 / 3]]) and np.allclose(v[1:], [1, 0, 0])
    struct.pack_into("<4sIIII", head, 0, b"DDS ", 124, 0, 1, 1)
    struct.pack_into("<II4sIIIII", head, 76, 32, 0x40, b"\0" * 4, 16, 0xF800, 0x07E0, 0x001F, 0)
    assert np.allclose(codecs.decode(bytes(head) + struct.pack("<H", 31 << 11 | 63)), [[[1, 1 / 63, 1]]])
    assert np.allclose(codecs.decode(bytes(head) + struct.pack("<H", 31 << 11 | 21 << 5)), [[[1, 1 / 3, 0]]])


def test_psd_and_ico_by_hand():
    head = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 1, 2, 8, 3) + struct.pack(">III", 0, 0, 0)
    assert (codecs.decode(head + struct.pack(">H", 0) + bytes([10, 20, 30, 40, 50, 60])) * 255).round().tolist() == [[[10, 30, 50], [20, 40, 60]]]
    rows = [bytes([255, 7]), bytes([1, 1, 2]), bytes([255, 9])]
    assert (codecs.decode(head + struct.pack(">HHHH", 1, *map(len, rows)) + b"".join(rows)) * 255).round().tolist() == [[[7, 1, 9], [7, 2, 9]]]
    bitmap = struct.pack("<IiiHHIIiiII", 40, 1, 4, 1, 32, 0, 0, 0, 0, 0, 0) + bytes([1, 2, 3, 4, 5, 6, 7, 8]) + b"\0" * 8
    ico = struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", 1, 2, 0, 0, 1, 32, len(bitmap), 22) + bitmap
    assert (codecs.decode(ico) * 255).round().tolist() == [[[7, 6, 5, 8]], [[3, 2, 1, 4]]]


@pytest.mark.parametrize(("name", "channels", "close"), [("tiff", 1, 1e-4), ("tiff", 3, 1e-4), ("tiff", 4, 1e-4), ("dpx", 1, 1e-4), ("dpx", 3, 1e-4), ("dpx", 4, 1e-4), ("cineon", 3, 1e-3), ("gif", 3, 0.101), ("ico", 4, 3e-3), ("dds", 3, 3e-3), ("dds", 4, 3e-3)])
def test_written_and_read(name, channels, close):
    v = np.random.default_rng(3).uniform(0, 1, (13, 31, channels))
    got = codecs.decode(codecs.by_name(name).encode(v), f"x.{name}")
    assert got.shape[:2] == v.shape[:2] and np.abs(got[:, :, :channels] - v).max() <= close


def test_malformed_files():
    for data in (b"II*\0\xff\xff\xff\x7f", b"GIF89a\0", b"DDS " + b"\0" * 10, b"SDPX"):
        with pytest.raises((ValueError, struct.error, IndexError)):
            codecs.decode(data)
