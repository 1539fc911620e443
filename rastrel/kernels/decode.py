"""Image files from their bytes, told apart by content: PNG, BMP, PNM, farbfeld, QOI, TGA and baseline TIFF as 8-bit RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def rgba(samples: np.ndarray) -> np.ndarray:
    """Grey, grey and alpha, RGB or RGBA samples (height, width, 1 to 4) of 8 or 16 bits as 8-bit RGBA."""
    if samples.dtype == np.uint16:
        samples = ((samples.astype(np.uint32) * 255 + 32767) // 65535).astype(np.uint8)
    n = samples.shape[2]
    alpha = samples[..., -1:] if n in (2, 4) else np.full((*samples.shape[:2], 1), 255, np.uint8)
    return np.ascontiguousarray(np.concatenate([samples[..., :3] if n >= 3 else np.repeat(samples[..., :1], 3, 2), alpha], 2))


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """PNG rows (a filter byte, then `stride` bytes) without their filters; step: bytes of a pixel."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y, (kind, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:])):
        if kind == 0:
            out[y] = line
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            out[y] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            given, up, made = line.tolist(), above.tolist(), [0] * stride
            for x, v in enumerate(given):
                a, b = (made[x - step], up[x]) if x >= step else (0, up[x])
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                made[x] = (v + guess) & 255
            out[y] = made
        else:
            raise ValueError("a PNG row has an unknown filter")
        above = out[y]
    return out


def png(data: bytes) -> np.ndarray:
    at, body, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or not body:
        raise ValueError("a PNG without a head or pixels")
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG isn't read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride = -(-width * channels * depth // 8)
    rows = _unfiltered(zlib.decompress(b"".join(body)), height, stride, max(1, channels * depth // 8))
    if depth == 16:
        samples = rows.view(">u2").astype(np.uint16).reshape(height, width, channels)
    elif depth == 8:
        samples = rows.reshape(height, width, channels)
    else:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        samples = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[..., None]
        samples = samples if colour == 3 else samples * np.uint8(255 // ((1 << depth) - 1))
    if colour == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[: len(palette), :3] = palette
        table[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        return table[samples[..., 0]]
    out = rgba(samples)
    if clear and colour in (0, 2):
        key = np.frombuffer(clear, ">u2")[:channels]
        key = key if depth >= 8 else key * (255 // ((1 << depth) - 1))
        out[(samples == key).all(2), 3] = 0
    return out


def bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if depth not in (24, 32) or packing not in (0, 3):
        raise ValueError("only BMP of 24 or 32 plain bits is read")
    step, stride = depth // 8, -(-width * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, start).reshape(-1, stride)[:, : width * step].reshape(-1, width, step)
    rows = rows if height < 0 else rows[::-1]
    out = rgba(rows[..., [2, 1, 0]])
    if step == 4 and rows[..., 3].any():
        out[..., 3] = rows[..., 3]
    return out


def pnm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1:2], 2, []
    plain = kind in b"123"
    while len(numbers) < (2 if kind in b"14" else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    width, height, *most = numbers
    channels, at = 3 if kind in b"36" else 1, at + 1
    if kind == b"4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, height * -(-width // 8), at).reshape(height, -1), axis=1)[:, :width]
        return rgba(((1 - bits) * 255).astype(np.uint8)[..., None])
    if plain:
        text = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        found = np.array([c - 48 for c in text if c in b"01"] if kind == b"1" else list(map(int, text.split())), np.int64)[: width * height * channels]
        if kind == b"1":
            found, most = 1 - found, [1]
    else:
        found = np.frombuffer(data, np.uint8 if most[0] < 256 else ">u2", width * height * channels, at).astype(np.int64)
    return rgba(((found * 255 * 2 + most[0]) // (2 * most[0])).astype(np.uint8).reshape(height, width, channels))


def farbfeld(data: bytes) -> np.ndarray:
    width, height = struct.unpack_from(">II", data, 8)
    return rgba(np.frombuffer(data, ">u2", width * height * 4, 16).astype(np.uint16).reshape(height, width, 4))


def qoi(data: bytes) -> np.ndarray:
    width, height = struct.unpack_from(">II", data, 4)
    out, seen, pixel, at, done, total = bytearray(), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, 0, width * height
    while done < total:
        tag, run = data[at], 1
        at += 1
        r, g, b, a = pixel
        if tag == 0xFE:
            pixel, at = (*data[at : at + 3], a), at + 3
        elif tag == 0xFF:
            pixel, at = tuple(data[at : at + 4]), at + 4
        elif tag < 0x40:
            pixel = seen[tag]
        elif tag < 0x80:
            pixel = ((r + (tag >> 4 & 3) - 2) & 255, (g + (tag >> 2 & 3) - 2) & 255, (b + (tag & 3) - 2) & 255, a)
        elif tag < 0xC0:
            green, more = (tag & 63) - 32, data[at]
            at += 1
            pixel = ((r + green + (more >> 4) - 8) & 255, (g + green) & 255, (b + green + (more & 15) - 8) & 255, a)
        else:
            run = (tag & 63) + 1
        seen[(pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64] = pixel
        run = min(run, total - done)
        out += bytes(pixel) * run
        done += run
    return np.frombuffer(bytes(out), np.uint8).reshape(height, width, 4)


def tga(data: bytes) -> np.ndarray:
    skip, mapped, kind, _, _, _, _, _, width, height, depth, how = struct.unpack_from("<BBBHHBHHHHBB", data)
    step = depth // 8
    if mapped or kind not in (2, 3, 10, 11) or step not in (1, 3, 4):
        raise ValueError("only TGA of grey, 24 or 32 bits is read")
    at, total = 18 + skip, width * height
    if kind in (2, 3):
        raw = data[at : at + total * step]
    else:
        parts, done = [], 0
        while done < total:
            n = (data[at] & 127) + 1
            size = step if data[at] & 128 else n * step
            part = data[at + 1 : at + 1 + size]
            parts.append(part * n if data[at] & 128 else part)
            at, done = at + 1 + size, done + n
        raw = b"".join(parts)[: total * step]
    rows = np.frombuffer(raw, np.uint8).reshape(height, width, step)
    rows = rows if how & 32 else rows[::-1]
    rows = rows[:, ::-1] if how & 16 else rows
    return rgba(rows if step == 1 else rows[..., [2, 1, 0]] if step == 3 else rows[..., [2, 1, 0, 3]])


def tiff(data: bytes) -> np.ndarray:
    end = "<" if data[:2] == b"II" else ">"
    sizes = {1: "B", 3: "H", 4: "I"}
    (at,) = struct.unpack_from(f"{end}I", data, 4)
    (n,) = struct.unpack_from(f"{end}H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{end}HHI", data, at + 2 + 12 * i)
        if kind in sizes:
            form = f"{end}{count}{sizes[kind]}"
            place = at + 10 + 12 * i
            tags[tag] = struct.unpack_from(form, data, place if struct.calcsize(form) <= 4 else struct.unpack_from(f"{end}I", data, place)[0])
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, channels, packing, meaning = one(256), one(257), one(277, 1), one(259, 1), one(262, 1)
    if set(tags.get(258, (1,))) not in ({8}, {16}) or packing not in (1, 8, 32946) or meaning not in (0, 1, 2) or one(284, 1) != 1 or one(317, 1) not in (1, 2) or 273 not in tags or not 1 <= channels <= 4:
        raise ValueError("only TIFF of plain or deflated strips of 8 or 16 bits is read")
    wide = tags[258][0] == 16
    strips = [data[a : a + size] for a, size in zip(tags[273], tags[279])]
    raw = b"".join(zlib.decompress(s) if packing != 1 else s for s in strips)
    samples = np.frombuffer(raw, f"{end}u2" if wide else np.uint8, width * height * channels).reshape(height, width, channels).astype(np.uint16 if wide else np.uint8)
    if one(317, 1) == 2:
        samples = np.cumsum(samples, axis=1, dtype=samples.dtype)
    return rgba(np.iinfo(samples.dtype).max - samples if meaning == 0 else samples)


#: What files of each format begin with.
BEGINNINGS = ((b"\x89PNG\r\n\x1a\n", png), (b"BM", bmp), (b"farbfeld", farbfeld), (b"qoif", qoi), (b"II*\x00", tiff), (b"MM\x00*", tiff), *((b"P%d" % k, pnm) for k in range(1, 7)))


def image(data: bytes) -> np.ndarray:
    """8-bit RGBA pixels (height, width, 4) of a file of any of these formats; ValueError for others, and for broken files."""
    read = next((f for begin, f in BEGINNINGS if data.startswith(begin)), None)
    if read is None and len(data) > 18 and data[1] == 0 and data[2] in (2, 3, 10, 11) and data[16] in (8, 24, 32):
        read = tga  # has no beginning of its own
    if read is None:
        raise ValueError("not an image of a known format")
    try:
        found = read(data)
    except (struct.error, zlib.error, IndexError, KeyError, TypeError) as fault:
        raise ValueError(f"a broken image: {fault}") from fault
    if not found.size:
        raise ValueError("an image without pixels")
    return found
