"""Image files as frames: 8-bit and 16-bit PNG and plain TIFF, decoded on arrays in the tasks that read the files.

PNG: grey, grey with alpha, RGB and RGBA, not interlaced; rows are undone by their five filters. TIFF: uncompressed strips of
8 or 16 bits, one or several samples a pixel, either byte order. Channels are those of the file. A folder's frames are in
the order of the number in their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import Block, BlockPipe, Layout, Source, Table
from ..plans.index import Shape

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the colour type of a PNG header; palettes are not read.
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: Numbers of the TIFF fields that are read.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _PER_PIXEL, _COUNTS, _PLANAR = 256, 257, 258, 259, 273, 277, 279, 284
_TIFF_SIZES = {1: "B", 3: "H", 4: "I"}


def _undo(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes of an image's rows from what their filters left. step: bytes of a pixel."""
    out = np.zeros((rows.shape[0] + 1, rows.shape[1] + step), np.uint8)  # a row above and a pixel to the left are 0
    for k, kind in enumerate(kinds.tolist()):
        row, above, here = rows[k], out[k], out[k + 1]
        if kind == 0:
            here[step:] = row
        elif kind == 1:
            pixels = row.reshape(-1, step)
            here[step:] = np.cumsum(pixels, axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            here[step:] = row + above[step:]
        elif kind == 3:
            left, up = [0] * step, above[step:].tolist()
            for i, v in enumerate(row.tolist()):
                left.append((v + (left[i] + up[i]) // 2) & 255)
            here[:] = left
        elif kind == 4:
            left, up, corner = [0] * step, above[step:].tolist(), above.tolist()
            for i, v in enumerate(row.tolist()):
                a, b, c = left[i], up[i], corner[i]
                to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                near = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
                left.append((v + near) & 255)
            here[:] = left
        else:
            raise ValueError(f"row filter {kind}")
    return out[1:, step:]


def png(data: bytes) -> np.ndarray:
    """Channels, rows and columns of a PNG file."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG file")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"a damaged part {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    w, h, bits, colour, _, _, interlaced = head
    if bits not in (8, 16) or colour not in _SAMPLES or interlaced:
        raise ValueError(f"PNG of {bits} bits, colour type {colour}, interlaced {interlaced}")
    samples = _SAMPLES[colour]
    step = samples * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * step)
    rows = np.ascontiguousarray(_undo(raw[:, 1:], raw[:, 0], step))
    return rows.view(">u2" if bits == 16 else "u1").reshape(h, w, samples).transpose(2, 0, 1)


def tiff(data: bytes) -> np.ndarray:
    """Channels, rows and columns of the first image of a TIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    at = struct.unpack(f"{order}I", data[4:8])[0]
    found: dict[int, tuple[int, ...]] = {}
    for k in range(struct.unpack(f"{order}H", data[at : at + 2])[0]):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack(f"{order}HHI", data[entry : entry + 8])
        if kind in _TIFF_SIZES:
            size = struct.calcsize(_TIFF_SIZES[kind]) * count
            place = entry + 8 if size <= 4 else struct.unpack(f"{order}I", data[entry + 8 : entry + 12])[0]
            found[tag] = struct.unpack(f"{order}{count}{_TIFF_SIZES[kind]}", data[place : place + size])
    h, w, samples = found[_HEIGHT][0], found[_WIDTH][0], found.get(_PER_PIXEL, (1,))[0]
    bits = set(found.get(_BITS, (1,)))
    if found.get(_COMPRESSION, (1,))[0] != 1 or bits not in ({8}, {16}) or found.get(_PLANAR, (1,))[0] != 1:
        raise ValueError("only uncompressed TIFF of 8 or 16 bits, samples side by side, is read")
    raw = b"".join(data[o : o + n] for o, n in zip(found[_OFFSETS], found[_COUNTS], strict=True))
    return np.frombuffer(raw, f"{order}u{bits.pop() // 8}").reshape(h, w, samples).transpose(2, 0, 1)


def decode(data: bytes) -> np.ndarray:
    """An image by what its first bytes say."""
    return png(data) if data[:8] == _SIGNATURE else tiff(data)


def encode_png(frame: np.ndarray, level: int = 6) -> bytes:
    """A PNG file of a grey (rows, columns) or colour (1 to 4 channels, rows, columns) image of bytes; each row is filtered by the one above."""
    a = frame[None] if frame.ndim == 2 else frame
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[a.shape[0]]
    rows = a.transpose(1, 2, 0).reshape(a.shape[1], -1).astype(np.uint8)
    left = np.vstack([rows[:1], rows[1:] - rows[:-1]]) if len(rows) else rows
    raw = np.hstack([np.full((len(rows), 1), 2, np.uint8), left])

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", a.shape[2], a.shape[1], 8, colour, 0, 0, 0)
    return _SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw.tobytes(), level)) + part(b"IEND", b"")


def encoded(pipe: BlockPipe, level: int = 6) -> DataFrame:
    """n and content: each frame as a PNG file; values are cut off to 0..255."""
    if pipe.shape.c != 1:
        raise ValueError("frames of one channel are written")

    def write(blocks) -> pa.RecordBatch:
        rows = [(n + k, encode_png(np.clip(frame, 0, 255).astype(np.uint8), level)) for _, n, _, _, a in blocks for k, frame in enumerate(a)]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["n", "content"])

    whole = pipe.laid(y=pipe.shape.y, x=pipe.shape.x)
    return whole.run(whole.whole(), write, "n long, content binary")


def from_files(files: DataFrame, shape: Shape, layout: Layout | None = None, kind: str = "<u2") -> BlockPipe:
    """The stack of images in a table of n and content, all of one size."""
    def read(batch: pa.RecordBatch) -> Iterator[Block]:
        for n, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            a = decode(content.as_py())
            if a.shape != (shape.c, shape.y, shape.x):
                raise ValueError(f"image {n} has the shape {a.shape}")
            for c in range(shape.c):
                yield c, n, 0, 0, a[c][None]

    one = Layout(1, shape.y, shape.x)
    return BlockPipe([Table(files.select("n", "content"), read, "n", one, shape, kind)], Source(0, shape), layout or one)


def folder(spark: SparkSession, path: str, extension: str = ".tiff", layout: Layout | None = None) -> BlockPipe:
    """The stack of a folder's images. The first one says what size and how many channels all have."""
    from .registry import image_folder

    files = image_folder(spark, path, extension)
    first = files.where("n = 0").select("content").head()
    if first is None:
        raise ValueError(f"no {extension} files in {path}")
    count = files.select("n").count()
    c, h, w = decode(bytes(first[0])).shape
    return from_files(files, Shape(count, c, h, w), layout)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes and modified of a folder's files, in order of their names; nothing is read of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy("path")
