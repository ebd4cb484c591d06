import struct
import zlib

import numpy as np
import pytest

from stackweave.plans import blocks
from stackweave.plans.blocks import Layout
from stackweave.sources import images


def paeth(a, b, c):
    p = a + b - c
    return min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]


def filtered(a, kinds, step, bits=8, colour=0, damage=False):
    """A PNG file whose rows take the given filters in turn, byte by byte after the format's rules."""
    h, w = a.shape[0], a.shape[1] * step
    rows = a.astype(">u2" if bits == 16 else "u1").tobytes()
    raw = bytearray()
    at = lambda y, x: rows[y * w + x] if y >= 0 and x >= 0 else 0
    for y in range(h):
        k = kinds[y % len(kinds)]
        raw.append(k)
        for x in range(w):
            left, up, corner = at(y, x - step), at(y - 1, x), at(y - 1, x - step)
            raw.append((at(y, x) - [0, left, up, (left + up) // 2, paeth(left, up, corner)][k]) % 256)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body) ^ damage)
    z = zlib.compress(bytes(raw))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], h, bits, colour, 0, 0, 0)) + part(b"IDAT", z[:20]) + part(b"tEXt", b"x") + part(b"IDAT", z[20:]) + part(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
@pytest.mark.parametrize(("samples", "colour", "bits"), [(1, 0, 8), (3, 2, 8), (4, 6, 8), (2, 4, 8), (1, 0, 16), (3, 2, 16)])
def test_png_rows(kinds, samples, colour, bits):
    a = np.random.default_rng(1).integers(0, 2**bits, (9, 7, samples))
    got = images.decode(filtered(a, kinds, samples * bits // 8, bits, colour))
    assert np.array_equal(got.transpose(1, 2, 0), a)


def test_refused_images():
    a = np.zeros((2, 2, 1), int)
    for data in (filtered(a, [0], 1, damage=True), filtered(a, [0], 1, colour=3), b"GIF89a..", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises((ValueError, TypeError)):
            images.decode(data)


def plain_tiff(a, order="<", strips=2):
    """Rows in strips; a is rows, columns, samples."""
    h, w, s = a.shape
    kind = f"{order}u{a.dtype.itemsize}"
    per = -(-h // strips)
    data = [a[k : k + per].astype(kind).tobytes() for k in range(0, h, per)]
    at, offsets = 8, []
    for d in data:
        offsets.append(at)
        at += len(d)
    more, body = b"", b""
    entries = [(256, 3, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8] * s), (259, 3, [1]), (273, 4, offsets), (277, 3, [s]), (279, 4, [len(d) for d in data])]
    table = at + 0
    behind = table + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            body += struct.pack(f"{order}HHII", tag, kind, len(values), behind + len(more))
            more += raw
        else:
            body += struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, table) + b"".join(data) + struct.pack(f"{order}H", len(entries)) + body + b"\0\0\0\0" + more


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("samples", "kind"), [(1, np.uint8), (1, np.uint16), (3, np.uint8)])
def test_tiff_strips(order, samples, kind):
    a = np.random.default_rng(2).integers(0, np.iinfo(kind).max, (9, 7, samples)).astype(kind)
    assert np.array_equal(images.decode(plain_tiff(a, order)).transpose(1, 2, 0), a)


def test_a_folder_is_a_stack(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 256, (11, 6, 5)).astype(np.uint8)
    for n, frame in enumerate(a):
        (tmp_path / f"cam__12__20200102_030405_{n}.tiff").write_bytes(plain_tiff(frame[..., None]))
        (tmp_path / f"cam__12__20200102_030405_{n}.png").write_bytes(images.encode_png(frame))
    for extension in (".tiff", ".png"):
        pipe = images.folder(spark, str(tmp_path), extension, Layout(4, 6, 5))
        assert pipe.shape.n == 11 and np.array_equal(pipe.to_numpy()[:, 0], a) and np.array_equal(pipe.to_numpy((slice(9, 11),))[:, 0], a[9:])
    listed = images.listing(spark, str(tmp_path), "*.png").collect()
    assert len(listed) == 11 and all(r.bytes > 50 for r in listed)
    with pytest.raises(ValueError):
        images.folder(spark, str(tmp_path), ".gif")


def test_encoded_frames(spark):
    a = np.random.default_rng(4).integers(0, 256, (5, 1, 6, 7)).astype(float)
    pipe = blocks.from_arrays(spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(a)], "n long, px array<double>"), "n", "px", 6, 7)
    files = images.encoded(pipe)
    assert np.array_equal(images.from_files(files, pipe.shape).to_numpy(), a)
    colour = np.random.default_rng(5).integers(0, 256, (3, 4, 5))
    assert np.array_equal(images.png(images.encode_png(colour)), colour)
