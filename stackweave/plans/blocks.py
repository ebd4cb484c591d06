"""Packed blocks: a stack as rows of whole arrays, one for each range of frames and tile of rows and columns.

A block is (c, n0, y0, x0, nn, yy, xx, data): its first place, its size on each axis, and its values as little-endian
doubles in the order of the axes. No pixel is a row. A `BlockPipe` is a plan over such rows: a tree of sources, operators on
arrays and traced functions of several stacks. A wanted range is cut into output blocks, and the halo rules of the
operators say which source range each of them reads. Each source block is cut into the pieces that output blocks need,
pieces meet in one exchange by output block, and a task runs the whole tree of operators on each. Where every output
block needs just the source block in its place there is no exchange at all.

What a task holds is one output block with its halo; Layout says how large that is.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import AXES, Halo, Shape, normalise

SCHEMA = "c int, n0 long, y0 int, x0 int, nn int, yy int, xx int, data binary"
SPACE = ("n", "y", "x")  # axes of a block's array; channels are blocks of their own
_INTS = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
_NAMES = ("c", "n0", "y0", "x0", "nn", "yy", "xx", "data")

Ranges = dict[str, tuple[int, int]]
#: A block in a task: channel, first frame, row and column, and the values.
Block = tuple[int, int, int, int, np.ndarray]


@dataclass(frozen=True)
class Layout:
    """Frames, rows and columns of a block; the last ones of an axis are smaller."""

    n: int = 64
    y: int = 64
    x: int = 64

    def __getitem__(self, axis: str) -> int:
        return getattr(self, axis)

    def cut(self, axis: str, ranges: Ranges) -> int:
        """How many blocks a range has on an axis."""
        a, b = ranges[axis]
        return -(-(b - a) // self[axis])

    def range(self, axis: str, ranges: Ranges, k: int) -> tuple[int, int]:
        a, b = ranges[axis]
        return a + k * self[axis], min(a + (k + 1) * self[axis], b)


@dataclass(frozen=True)
class Place:
    """What a kernel may want to know: the ranges it gets and has to give, and the whole source's shape."""

    source: Ranges
    wanted: Ranges
    shape: Shape


@dataclass(frozen=True)
class BlockOp:
    """kernel(a, place) of an array by frames, rows and columns.

    The halo says what it reads. On an axis with a radius the array is widened by its edge first, so the kernel gives
    2 * radius places less than it gets. A kernel that gives a whole axis is cut to the wanted range.
    """

    name: str
    kernel: Callable[[np.ndarray, Place], np.ndarray]
    halo: Halo = field(default_factory=Halo)
    shape: Callable[[Shape], Shape] | None = None

    def out(self, shape: Shape) -> Shape:
        return self.shape(shape) if self.shape else self.halo.shape(shape)


class BlockChain(tuple):
    """Block operators to be joined with | and put behind a pipe."""

    def __or__(self, other: BlockOp | BlockChain) -> BlockChain:
        return BlockChain((*self, *(other if isinstance(other, BlockChain) else (other,))))


@dataclass(frozen=True)
class Source:
    """The k-th table that a plan reads."""

    k: int
    shape: Shape

    def need(self, ranges: Ranges) -> dict[int, Ranges]:
        return {self.k: ranges}

    def compute(self, ranges: Ranges, arrays: dict[int, tuple[Ranges, np.ndarray]]) -> np.ndarray:
        held, a = arrays[self.k]
        return a[tuple(slice(ranges[x][0] - held[x][0], ranges[x][1] - held[x][0]) for x in SPACE)]

    def moved(self, by: int) -> Source:
        return Source(self.k + by, self.shape)


@dataclass(frozen=True)
class Applied:
    """An operator on a plan."""

    inner: Source | Applied
    op: BlockOp

    @property
    def shape(self) -> Shape:
        return self.op.out(self.inner.shape)

    def need(self, ranges: Ranges) -> dict[int, Ranges]:
        return self.inner.need(self.op.halo.source(ranges, self.inner.shape))

    def compute(self, ranges: Ranges, arrays: dict) -> np.ndarray:
        source = self.op.halo.source(ranges, self.inner.shape)
        a = self.inner.compute(source, arrays)
        pads = []
        for axis in SPACE:
            r = self.op.halo.reach.get(axis)
            r = r.radius if r else 0
            pads.append((r - (ranges[axis][0] - source[axis][0]), r - (source[axis][1] - ranges[axis][1])) if r else (0, 0))
        if any(map(any, pads)):
            a = np.pad(a, pads, mode="edge")
        a = self.op.kernel(a, Place(source, ranges, self.inner.shape))
        size = tuple(ranges[x][1] - ranges[x][0] for x in SPACE)
        if a.shape != size:
            a = a[tuple(slice(None) if a.shape[k] == size[k] else slice(*ranges[x]) for k, x in enumerate(SPACE))]
        return a

    def moved(self, by: int) -> Applied:
        return Applied(self.inner.moved(by), self.op)


def bounding(a: Ranges, b: Ranges) -> Ranges:
    """The smallest ranges that hold both."""
    return {x: (min(a[x][0], b[x][0]), max(a[x][1], b[x][1])) for x in AXES}


def read_blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """Blocks from rows of SCHEMA."""
    head = [batch.column(k).to_pylist() for k in range(7)]
    for c, n, y, x, a, b, d, data in zip(*head, batch.column(7), strict=True):
        yield c, n, y, x, np.frombuffer(data.as_buffer(), "<f8").reshape(a, b, d)


def write_blocks(blocks: Iterable[Block]) -> pa.RecordBatch:
    rows = [(c, n, y, x, *a.shape, np.ascontiguousarray(a, "<f8").tobytes()) for c, n, y, x, a in blocks]
    columns = list(zip(*rows, strict=True)) or [()] * 8
    return pa.record_batch([*(pa.array(c, t) for c, t in zip(columns[:7], _INTS, strict=True)), pa.array(columns[7], pa.binary())], names=_NAMES)


def write_pixels(blocks: Iterable[Block]) -> pa.RecordBatch:
    """Rows n, c, y, x, v."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for c, n, y, x, a in blocks:
        at = np.indices(a.shape).reshape(3, -1)
        for part, values in zip(parts, (at[0] + n, np.full(a.size, c), at[1] + y, at[2] + x, a.ravel()), strict=True):
            part.append(values)
    kinds = (np.int64, np.int32, np.int32, np.int32, np.float64)
    return pa.record_batch([pa.array(np.concatenate(p) if p else np.zeros(0), pa.from_numpy_dtype(k), safe=False) if not p else pa.array(np.concatenate(p).astype(k)) for p, k in zip(parts, kinds, strict=True)], names=["n", "c", "y", "x", "v"])


PIXELS = "n long, c int, y int, x int, v double"
_WRITERS = {"blocks": (write_blocks, SCHEMA), "pixels": (write_pixels, PIXELS)}


@dataclass(frozen=True)
class Table:
    """A table of a plan: read(batch) gives its blocks, `n` is the column of a row's first frame, layout its blocks' sizes.

    kind is the smallest type that holds its values exactly: pieces are exchanged as that. y and x are the columns of a
    row's first row and column, if it has them: a wanted range filters by all three.
    """

    frame: DataFrame
    read: Callable[[pa.RecordBatch], Iterator[Block]]
    n: str
    layout: Layout
    shape: Shape
    kind: str = "<f8"
    y: str | None = None
    x: str | None = None

    def within(self, ranges: Ranges) -> DataFrame:
        """The rows whose blocks can reach into the ranges."""
        df = self.frame
        for axis, column in (("n", self.n), ("y", self.y), ("x", self.x)):
            a, b = ranges[axis]
            if column and (a, b) != (0, self.shape[axis]):
                df = df.where((F.col(column) > a - self.layout[axis]) & (F.col(column) < b))
        return df


class _Router:
    """Which output blocks need a source block: one for each source of a plan, used in tasks.

    Tiles of a frame are listed; the blocks along the frames are found by bisection, since both ends of what they read rise.
    """

    def __init__(self, plan, ranges: Ranges, layout: Layout, k: int, kinds: tuple[str, ...]):
        self.plan, self.ranges, self.layout, self.k, self.kinds = plan, ranges, layout, k, kinds
        self.count = layout.cut("n", ranges)
        self.tiles = list(itertools.product(*(range(layout.cut(a, ranges)) for a in ("y", "x"))))
        self._ends: dict[int, tuple[int, int]] = {}  # of the blocks that a task asks for

    def block(self, i: int, tile: int) -> Ranges:
        j, k = self.tiles[tile]
        return {"n": self.layout.range("n", self.ranges, i), "c": self.ranges["c"], "y": self.layout.range("y", self.ranges, j), "x": self.layout.range("x", self.ranges, k)}

    def need(self, i: int, tile: int) -> Ranges:
        return self.plan.need(self.block(i, tile))[self.k]

    def ends(self, i: int) -> tuple[int, int]:
        if i not in self._ends:
            self._ends[i] = self.need(i, 0)["n"]
        return self._ends[i]

    def frames(self, a: int, b: int) -> range:
        """The output blocks along the frames that read some of the source's frames a to b - 1."""
        every = range(self.count)
        first = bisect.bisect_right(every, a, key=lambda i: self.ends(i)[1])
        return range(first, bisect.bisect_left(every, b, lo=first, key=lambda i: self.ends(i)[0]))

    def pieces(self, block: Block, rectangles: list[Ranges]) -> Iterator[tuple]:
        c, n, y, x, a = block
        if not self.ranges["c"][0] <= c < self.ranges["c"][1]:
            return
        for i in self.frames(n, n + a.shape[0]):
            lo, hi = self.ends(i)
            for tile, r in enumerate(rectangles):
                cut = [(max(s, o), min(e, o + m)) for (s, e), o, m in (((lo, hi), n, a.shape[0]), (r["y"], y, a.shape[1]), (r["x"], x, a.shape[2]))]
                if all(s < e for s, e in cut):
                    piece = a[tuple(slice(s - o, e - o) for (s, e), o in zip(cut, (n, y, x), strict=True))]
                    yield c, i, tile, self.k, *(s for s, _ in cut), *piece.shape, np.ascontiguousarray(piece, self.kinds[self.k]).tobytes()


_PIECE = "c int, i long, tile int, k int, n0 long, y0 int, x0 int, nn int, yy int, xx int, data binary"
_PIECE_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.binary())
#: Bytes of pieces that a task hands over at once.
_BATCH_BYTES = 16 << 20


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], names=[f.split()[0] for f in _PIECE.split(", ")])


def _deal(router: _Router, read):
    def deal(batches):
        rectangles = [router.need(0, t) for t in range(len(router.tiles))] if router.count else []
        rows, size = [], 0
        for b in batches:
            for block in read(b):
                for piece in router.pieces(block, rectangles):
                    rows.append(piece)
                    size += len(piece[-1])
                    if size > _BATCH_BYTES:
                        yield _piece_batch(rows)
                        rows, size = [], 0
        if rows:
            yield _piece_batch(rows)

    return deal


class BlockPipe:
    """A plan over tables of blocks, with the layout of its output."""

    def __init__(self, tables: list[Table], plan, layout: Layout):
        self.tables, self.plan, self.layout = tables, plan, layout

    @property
    def shape(self) -> Shape:
        return self.plan.shape

    def __len__(self) -> int:
        return self.shape.n

    def then(self, op: BlockOp | BlockChain) -> BlockPipe:
        plan = self.plan
        for one in op if isinstance(op, BlockChain) else (op,):
            plan = Applied(plan, one)
        return BlockPipe(self.tables, plan, self.layout)

    __or__ = then

    def laid(self, n: int | None = None, y: int | None = None, x: int | None = None) -> BlockPipe:
        """The same plan with other output blocks."""
        return BlockPipe(self.tables, self.plan, Layout(n or self.layout.n, y or self.layout.y, x or self.layout.x))

    @property
    def kinds(self) -> tuple[str, ...]:
        return tuple(t.kind for t in self.tables)

    def whole(self) -> Ranges:
        return {a: (0, self.shape[a]) for a in AXES}

    def aligned(self, ranges: Ranges) -> bool:
        """Whether each output block needs just the source block in its place: then nothing has to be exchanged."""
        if len(self.tables) != 1 or ranges != self.whole():
            return False
        table = self.tables[0]
        if not table.shape.n or table.layout[SPACE[0]] != self.layout.n or table.shape.n != self.shape.n:
            return False
        router = _Router(self.plan, ranges, self.layout, 0, self.kinds)
        if any(op.halo.source({"n": (5, 6), "c": (0, 1), "y": (0, 1), "x": (0, 1)}, s)["n"] != (5, 6) for op, s in self._ops()):
            return False
        held = self.whole() | {a: (0, table.shape[a]) for a in AXES}
        tiles = [(table.layout.range("y", held, j), table.layout.range("x", held, k)) for j in range(table.layout.cut("y", held)) for k in range(table.layout.cut("x", held))]
        return tiles == [(r["y"], r["x"]) for r in (router.need(0, t) for t in range(len(router.tiles)))]

    def _ops(self) -> list[tuple[BlockOp, Shape]]:
        out, plan = [], self.plan
        while isinstance(plan, Applied):
            out.append((plan.op, plan.inner.shape))
            plan = plan.inner
        return out

    def explain_plan(self, index=slice(None)) -> str:
        """How the blocks of a range are made."""
        ranges, _ = normalise(index, self.shape)
        need = self.plan.need(ranges)
        lines = [f"output {ranges} in blocks of {self.layout.n} x {self.layout.y} x {self.layout.x}", "no exchange" if self.aligned(ranges) else "one exchange, by output block"]
        return "\n".join([*lines, *(f"source {k} reads {r}" for k, r in sorted(need.items()))])

    def run(self, ranges: Ranges, write: Callable[[Iterable[Block]], pa.RecordBatch], schema: str) -> DataFrame:
        """What `write` makes of the output blocks of a range; their places are those in the whole output."""
        plan, layout = self.plan, self.layout
        if any(a >= b for a, b in ranges.values()):
            return self.tables[0].frame.sparkSession.createDataFrame([], schema)
        need = plan.need(ranges)
        frames = []
        for k, t in enumerate(self.tables):
            frames.append(t.within(need[k]) if k in need else None)
        if self.aligned(ranges):
            return frames[0].mapInArrow(_in_place(plan, self.tables[0].read, ranges, write), schema)
        dealt = None
        for k, t in enumerate(self.tables):
            if k in need:
                one = frames[k].mapInArrow(_deal(_Router(plan, ranges, layout, k, self.kinds), t.read), _PIECE)
                dealt = one if dealt is None else dealt.unionByName(one)
        return dealt.groupBy("c", "i", "tile").applyInArrow(_meet(_Router(plan, ranges, layout, min(need), self.kinds), write), schema)

    def _at(self, index, kind: str) -> tuple[DataFrame, list[str]]:
        ranges, picked = normalise(index, self.shape)
        return self.run(ranges, *_WRITERS[kind]), picked

    def blocks(self, index=slice(None)) -> DataFrame:
        """The output's blocks; those of a range start at its first place."""
        return self._at(index, "blocks")[0]

    def all(self) -> DataFrame:
        """The pixels, as those of a FramePipe."""
        return self.run(self.whole(), *_WRITERS["pixels"])

    def __getitem__(self, index) -> DataFrame:
        frame, picked = self._at(index, "pixels")
        return frame.drop(*picked)

    def subbatches(self, window: dict, stride: dict | None = None) -> Iterator[tuple[Ranges, DataFrame]]:
        """The ranges of tiles in row-major order, lazily, and the blocks of each."""
        from .index import tiles

        for ranges in tiles(self.shape, window, stride):
            yield ranges, self.run(ranges, *_WRITERS["blocks"])

    def kept(self, path: str) -> BlockPipe:
        """Writes the blocks as Parquet, in order of their frames, and reads them from now on."""
        self.blocks().repartitionByRange("n0", "y0", "x0").sortWithinPartitions("n0", "y0", "x0").write.parquet(path)
        return stored(self.tables[0].frame.sparkSession.read.parquet(path), self.shape, self.layout)

    def to_numpy(self, index=slice(None)) -> np.ndarray:
        """A small range as an array in the order of the axes."""
        ranges, picked = normalise(index, self.shape)
        out = np.full([b - a for a, b in ranges.values()], np.nan)
        for batch in self.run(ranges, *_WRITERS["blocks"]).toArrow().to_batches():
            for c, n, y, x, a in read_blocks(batch):
                at = c - ranges["c"][0], n - ranges["n"][0], y - ranges["y"][0], x - ranges["x"][0]
                out[at[1] : at[1] + a.shape[0], at[0], at[2] : at[2] + a.shape[1], at[3] : at[3] + a.shape[2]] = a
        return out.squeeze(tuple(AXES.index(a) for a in picked))


def _in_place(plan, read, ranges: Ranges, write):
    """Blocks of a batch that have the same tile run together: such plans treat each frame by itself."""

    def run(batches):
        for b in batches:
            groups: dict[tuple, list[Block]] = {}
            for block in read(b):
                groups.setdefault((block[0], *block[2:4], block[4].shape[1:]), []).append(block)
            out = []
            for (c, y, x, size), blocks in groups.items():
                a = np.concatenate([g[4] for g in blocks]) if len(blocks) > 1 else blocks[0][4]
                held = {"n": (0, len(a)), "c": (c, c + 1), "y": (y, y + size[0]), "x": (x, x + size[1])}
                wanted = _mapped(plan, held, ranges)
                got = plan.compute(wanted, {0: (held, a)})
                at = 0
                for g in blocks:
                    n = g[4].shape[0]
                    out.append((c, g[1], wanted["y"][0], wanted["x"][0], got[at : at + n]))
                    at += n
            yield write(out)

    return run


def _mapped(plan, held: Ranges, ranges: Ranges) -> Ranges:
    """The output tile that needs a source tile of an aligned plan."""
    if plan.need(held | {"y": ranges["y"], "x": ranges["x"]})[0] == held:
        return held | {"y": ranges["y"], "x": ranges["x"]}
    return held


def _meet(router: _Router, write):
    plan = router.plan

    def meet(table: pa.Table) -> pa.Table:
        c, i, tile = (table.column(k)[0].as_py() for k in range(3))
        wanted = router.block(i, tile) | {"c": (c, c + 1)}
        arrays = {k: (r, np.full([r[a][1] - r[a][0] for a in SPACE], np.nan)) for k, r in plan.need(wanted).items()}
        for batch in table.to_batches():
            head = [batch.column(k).to_pylist() for k in range(3, 10)]
            for k, n, y, x, a, b, d, data in zip(*head, batch.column(10), strict=True):
                r, whole = arrays[k]
                at = n - r["n"][0], y - r["y"][0], x - r["x"][0]
                whole[at[0] : at[0] + a, at[1] : at[1] + b, at[2] : at[2] + d] = np.frombuffer(data.as_buffer(), router.kinds[k]).reshape(a, b, d)
        got = plan.compute(wanted, arrays)
        return pa.Table.from_batches([write([(c, wanted["n"][0], wanted["y"][0], wanted["x"][0], got)])])

    return meet


def stored(frame: DataFrame, shape: Shape, layout: Layout) -> BlockPipe:
    """A pipe over a table of blocks (SCHEMA), all of them of this layout."""
    return BlockPipe([Table(frame.select(*_NAMES), read_blocks, "n0", layout, shape, "<f8", "y0", "x0")], Source(0, shape), layout)


def from_arrays(df: DataFrame, n: str, values: str, height: int, width: int, channels: int = 1, frames: int | None = None, layout: Layout | None = None) -> BlockPipe:
    """Frames from an array column in row order, (c height + y) width + x; `n` numbers them without gaps.

    Each row is read as blocks of one frame; layout is that of the output, whole frames one by one if none is given.
    """
    if frames is None:
        frames = df.agg(F.max(n)).head()[0]
        frames = 0 if frames is None else frames + 1
    area = height * width

    def read(batch: pa.RecordBatch) -> Iterator[Block]:
        column = batch.column(1)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        for k, i in enumerate(batch.column(0).to_pylist()):
            frame = flat[k * channels * area : (k + 1) * channels * area].reshape(channels, 1, height, width)
            for c in range(channels):
                yield c, i, 0, 0, frame[c]

    kinds = {"float": "<f4", "tinyint": "i1", "smallint": "<i2", "int": "<i4"}
    kind = kinds.get(df.schema[values].dataType.elementType.simpleString(), "<f8")
    shape, one = Shape(frames, channels, height, width), Layout(1, height, width)
    return BlockPipe([Table(df.select(F.col(n).cast("long").alias("n"), F.col(values)), read, "n", one, shape, kind)], Source(0, shape), layout or one)


def from_pixels(pipe, layout: Layout | None = None) -> BlockPipe:
    """Packs the pixels of a FramePipe: the one exchange by pixel, into blocks of the layout."""
    layout, s = layout or Layout(), pipe.shape
    ranges = {a: (0, s[a]) for a in AXES}

    def pack(table: pa.Table) -> pa.Table:
        i, j, k, c = (table.column(name)[0].as_py() for name in ("_i", "_j", "_k", "c"))
        at = [layout.range(a, ranges, b) for a, b in zip(SPACE, (i, j, k), strict=True)]
        out = np.full([b - a for a, b in at], np.nan)
        out[tuple(table.column(a).to_numpy() - lo for a, (lo, _) in zip(SPACE, at, strict=True))] = table.column("v").to_numpy()
        return pa.Table.from_batches([write_blocks([(c, *(lo for lo, _ in at), out)])])

    keys = [F.floor(F.col(a) / layout[a]).cast("long").alias(f"_{b}") for a, b in zip(SPACE, "ijk", strict=True)]
    return stored(pipe.all().select("n", "c", "y", "x", F.col("v").cast("double").alias("v"), *keys).groupBy("c", "_i", "_j", "_k").applyInArrow(pack, SCHEMA), s, layout)


def _partial_sums(blocks: Iterable[Block]) -> pa.RecordBatch:
    return write_blocks([(c, a.shape[0], y, x, a.sum(0, keepdims=True)) for c, n, y, x, a in blocks])


def mean_frame(pipe: BlockPipe, index=slice(None)) -> DataFrame:
    """c, y, x, v: the mean over the frames of a range; each output block is summed in its task, tiles meet once."""
    ranges, _ = normalise(index, pipe.shape)
    sums = pipe.run(ranges, _partial_sums, SCHEMA)

    def add(table: pa.Table) -> pa.Table:
        total, count, at = 0.0, 0, None
        for batch in table.to_batches():
            for c, n, y, x, a in read_blocks(batch):
                total, count, at = total + a, count + n, (c, y, x)
        pixels = write_pixels([(at[0], 0, at[1], at[2], total / count)])
        return pa.Table.from_batches([pixels]).select(["c", "y", "x", "v"])

    return sums.groupBy("c", "y0", "x0").applyInArrow(add, "c int, y int, x int, v double")


def frame_means(pipe: BlockPipe, index=slice(None)) -> DataFrame:
    """n, mean, deviation (of the sample) of each frame of a range; tiles send sums of frames."""
    ranges, _ = normalise(index, pipe.shape)

    def sums(blocks: Iterable[Block]) -> pa.RecordBatch:
        parts = [(np.arange(n, n + len(a)), np.full(len(a), a[0].size if len(a) else 0), a.sum((1, 2)), (a * a).sum((1, 2))) for _, n, _, _, a in blocks]
        n, k, s, q = (np.concatenate(p) if parts else np.zeros(0) for p in (zip(*parts, strict=True) if parts else [()] * 4))
        return pa.record_batch([pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64)), pa.array(s.astype(np.float64)), pa.array(q.astype(np.float64))], names=["n", "k", "s", "q"])

    both = pipe.run(ranges, sums, "n long, k long, s double, q double").groupBy("n").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("k")
    return both.select("n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") - F.col("k") * mean * mean, F.lit(0.0)) / (F.col("k") - 1)).alias("deviation"))
