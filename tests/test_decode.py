"""Image files from bytes, against files made here by the formats' rules."""

import struct
import zlib

import numpy as np
import pytest
from rastrel.kernels import decode, paint
from rastrel.sources import pixels

RNG = np.random.default_rng(0)
IMAGE = RNG.integers(0, 256, (7, 5, 4)).astype(np.uint8)
FLAT = np.full((6, 9, 4), (10, 200, 30, 255), np.uint8)


def png_of(samples, depth, colour, filters, extra=b""):
    """samples: bytes by rows; each row with a filter of its own."""
    height, stride = samples.shape
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    body = b""
    for y in range(height):
        kind, row = filters[y % len(filters)], samples[y].astype(int)
        left = np.concatenate([np.zeros(step, int), row])[:stride]
        up = samples[y - 1].astype(int) if y else np.zeros(stride, int)
        corner = np.concatenate([np.zeros(step, int), up])[:stride]
        p = left + up - corner
        near = np.stack([abs(p - left), abs(p - up), abs(p - corner)]).argmin(0)
        guess = [0 * row, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kind]
        body += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda name, part: struct.pack(">I", len(part)) + name + part + struct.pack(">I", zlib.crc32(name + part))
    width = {1: stride * 8, 2: stride * 4, 4: stride * 2, 8: stride // step, 16: stride // step}[depth]
    packed = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


def test_png_of_every_filter_and_depth():
    assert (decode.image(paint.png(IMAGE / 255)) == IMAGE).all()
    assert (decode.image(png_of(IMAGE.reshape(7, -1), 8, 6, (0, 1, 2, 3, 4))) == IMAGE).all()
    rgb = np.ascontiguousarray(IMAGE[..., :3])
    assert (decode.image(png_of(rgb.reshape(7, -1), 8, 2, (4, 3, 1)))[..., :3] == rgb).all()
    wide = (IMAGE.astype(">u2") * 257).view(np.uint8).reshape(7, -1)
    assert (decode.image(png_of(wide, 16, 6, (2, 4))) == IMAGE).all()
    bits = RNG.integers(0, 256, (3, 2)).astype(np.uint8)
    assert (decode.image(png_of(bits, 1, 0, (0, 1)))[..., 0] == np.unpackbits(bits, axis=1) * 255).all()
    chunk = lambda name, part: struct.pack(">I", len(part)) + name + part + bytes(4)
    table = chunk(b"PLTE", bytes(range(48))) + chunk(b"tRNS", bytes([0, 128]))
    got = decode.image(png_of(np.array([[0x01, 0x2F]], np.uint8), 4, 3, (0,), table))
    assert got.tolist() == [[[0, 1, 2, 0], [3, 4, 5, 128], [6, 7, 8, 255], [45, 46, 47, 255]]]


def test_other_formats():
    h, w = IMAGE.shape[:2]
    bgr = np.zeros((h, 16), np.uint8)
    bgr[:, : 3 * w] = IMAGE[::-1, :, 2::-1].reshape(h, -1)
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + bgr.tobytes()
    assert (decode.image(bmp)[..., :3] == IMAGE[..., :3]).all()
    assert (decode.image(b"farbfeld" + struct.pack(">II", w, h) + (IMAGE.astype(">u2") * 257).tobytes()) == IMAGE).all()
    assert (decode.image(b"P6 # note\n5 7\n255\n" + IMAGE[..., :3].tobytes())[..., :3] == IMAGE[..., :3]).all()
    assert decode.image(b"P1\n3 2\n0 1 0 #x\n110")[..., 0].tolist() == [[255, 0, 255], [0, 0, 255]]
    assert decode.image(b"P2 2 1 15 0 15")[..., 0].tolist() == [[0, 255]]
    assert decode.image(b"P4 9 1\n" + bytes([0b10000000, 0b10000000]))[0, :, 0].tolist() == [0, *[255] * 7, 0]
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, w, h, 32, 32)
    assert (decode.image(head + IMAGE[..., [2, 1, 0, 3]].tobytes()) == IMAGE).all()
    packed = struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 9, 6, 24, 0) + bytes([128 | 53, 30, 200, 10])
    assert (decode.image(packed) == FLAT).all()
    strips = zlib.compress(IMAGE[:4].tobytes()), zlib.compress(IMAGE[4:].tobytes())
    entries = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 4, 200), (259, 3, 1, 8), (262, 3, 1, 2), (273, 4, 2, 208), (277, 3, 1, 4), (278, 3, 1, 4), (279, 4, 2, 216)]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", *e[:3]) + (struct.pack("<HH", e[3], 0) if e[1] == 3 and e[2] == 1 else struct.pack("<I", e[3])) for e in entries) + bytes(4)
    tiff = (b"II*\0" + struct.pack("<I", 8) + ifd).ljust(200, b"\0") + struct.pack("<4H2I2I", 8, 8, 8, 8, 224, 224 + len(strips[0]), *map(len, strips)) + strips[0] + strips[1]
    assert (decode.image(tiff) == IMAGE).all()


def test_qoi():
    """Every kind of chunk."""
    chunks = bytes([0xFE, 10, 20, 30, 0x40 | 3 << 4 | 2 << 2 | 1, 0x80 | 40, 0x9A, 0xFF, 1, 2, 3, 4, 0xC0 | 2, (10 * 3 + 20 * 5 + 30 * 7 + 255 * 11) % 64])
    want = [(10, 20, 30, 255), (11, 20, 29, 255), (11 + 8 + 1, 28, 29 + 8 + 2, 255), *[(1, 2, 3, 4)] * 4, (10, 20, 30, 255)]
    assert decode.image(b"qoif" + struct.pack(">IIBB", 4, 2, 4, 0) + chunks + bytes(7) + b"\1").reshape(-1, 4).tolist() == list(map(list, want))


def test_files_by_content(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(paint.png(IMAGE / 255))  # named wrongly
    (tmp_path / "b.ppm").write_bytes(b"P6 5 7 255\n" + IMAGE[..., :3].tobytes())
    (tmp_path / "c.txt").write_bytes(b"no image")
    rows = pixels.read_files(spark, str(tmp_path), broken="drop").collect()
    assert sorted(bytes(r["data"]) == IMAGE.tobytes() for r in rows) == [False, True] and {(r["width"], r["height"]) for r in rows} == {(5, 7)}
    with pytest.raises(Exception, match="known format"):
        pixels.read_files(spark, str(tmp_path)).collect()
    for data in (b"", b"BM", b"\x89PNG\r\n\x1a\n", b"P6 5 7 255\nxx", b"qoif" + bytes(9), paint.png(IMAGE / 255)[:60]):
        with pytest.raises(ValueError):
            decode.image(data)
