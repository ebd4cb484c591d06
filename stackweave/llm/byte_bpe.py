"""Byte-level BPE by rank files: words found by scans of transition functions, merges kept in a cache.

The pattern that splits a text into words is a walk over eight states. Each code point, with what the next two are,
is a function from the state before it to the state behind it. Such functions can be composed in any grouping, and
all that come up by composing are a small set, numbered once. So the states of a whole batch of texts are a prefix
scan of small numbers by a table: no regular expression, no loop over code points. A text's first code point stands for
a constant function, so texts need no separator, and a text that is longer than a batch is one piece of it.

States: nothing open, letters, numbers, other marks, one space before a word, white space, and one or two letters
of a contraction that are still to come. A word starts where the state and the code point say so.

Which code points are letters, numbers or white space is asked of the tiktoken library once on the driver, since its
Unicode version differs from Python's, and sent to all tasks (1.1 MB).
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_row, id_back, ship, slices

FREE, LETTERS, NUMBERS, MARKS, SPACE, BLANKS, ONE_MORE, TWO_MORE = range(8)
#: Classes of code points.
MARK, LETTER, NUMBER, BLANK = range(4)
# What a code point does, given its class and the next two.
_LETTER, _NUMBER, _MARK, _SHORT, _LONG, _INNER, _LAST_SPACE, _LAST_BLANK = range(8)


def code_point_classes() -> bytes:
    """The class of every code point as the tiktoken library sees it; surrogates, which no text has, are marks."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    every, out = points.tobytes().decode("utf-32-le"), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = kind
    return out.tobytes()


def _steps() -> np.ndarray:
    """The state behind a code point, by what it does and the state before."""
    out = np.empty((8, 8), np.uint8)
    for does, then in ((_LETTER, LETTERS), (_NUMBER, NUMBERS), (_MARK, MARKS), (_SHORT, ONE_MORE), (_LONG, TWO_MORE), (_INNER, BLANKS), (_LAST_SPACE, SPACE), (_LAST_BLANK, FREE)):
        out[does] = then
    out[_LETTER, TWO_MORE], out[_LETTER, ONE_MORE] = ONE_MORE, FREE
    for does in (_SHORT, _LONG):  # behind a mark or a space an apostrophe is one more mark
        out[does, [MARKS, SPACE]] = MARKS
    return out


def _starts() -> np.ndarray:
    """Whether a word starts at a code point, by what it does and the state before."""
    out = np.ones((8, 8), bool)
    out[_LETTER, [LETTERS, SPACE, ONE_MORE, TWO_MORE]] = False
    out[_NUMBER, [NUMBERS, SPACE]] = False
    for does in (_MARK, _SHORT, _LONG):
        out[does, [MARKS, SPACE]] = False
    out[_INNER, BLANKS] = False
    return out


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that composing gives: each one's states, the number of first-then-second, and of the constants.

    The first eight are those of _steps().
    """
    known = [tuple(f) for f in _steps().tolist()]
    known += [(s,) * 8 for s in range(8) if (s,) * 8 not in known]
    at = {f: k for k, f in enumerate(known)}
    table: dict[tuple[int, int], int] = {}
    while len(table) < len(known) ** 2:
        for i, j in itertools.product(range(len(known)), repeat=2):
            if (i, j) not in table:
                both = tuple(known[j][s] for s in known[i])
                if both not in at:
                    at[both] = len(known)
                    known.append(both)
                table[i, j] = at[both]
    n = len(known)
    return np.array(known, np.uint8), np.array([table[i, j] for i in range(n) for j in range(n)], np.uint8).reshape(n, n), np.array([at[(s,) * 8] for s in range(8)], np.uint8)


def scan(functions: np.ndarray, width: int = 256) -> np.ndarray:
    """The state before each function, if nothing is open before the first one.

    Rows of `width` functions are composed at once, the rows' results are scanned alike, and a second pass through the
    rows starts each one in its own state. The work is linear.
    """
    states, then, _ = _functions()
    n = len(functions)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)  # each step reads neighbours
    state = np.zeros(rows, np.uint8)
    if rows > 1:
        total = grid[0]
        for column in grid[1:]:
            total = then[total, column]
        state = scan(total, width)
    out = np.empty((width, rows), np.uint8)
    for k in range(width):
        out[k] = state
        state = states[grid[k], state]
    return out.T.reshape(-1)[:n]


class Splitter:
    """Finds where words start; classes: the class of each code point."""

    def __init__(self, classes: bytes):
        self.classes = np.frombuffer(classes, np.uint8)

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The places of `points` where a word starts. first: where the texts start, rising, none of them empty."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes[points]
        head = np.zeros(n + 2, bool)
        head[first], head[n:] = True, True
        end = head[1 : n + 1]  # no code point of the same text follows
        follows = np.append(kind[1:], 0).astype(np.uint8)
        does = np.array([_MARK, _LETTER, _NUMBER, _INNER], np.uint8)[kind]
        last = (kind == BLANK) & ~end & (follows != BLANK)
        does[last] = np.where(points[last] == 32, _LAST_SPACE, _LAST_BLANK)
        quote = np.flatnonzero((points == 39) & ~end)
        if len(quote):
            one = points[quote + 1]
            does[quote[np.isin(one, [ord(c) for c in "stmd"])]] = _SHORT
            longer = quote[~head[quote + 2]]
            pair = points[longer + 1].astype(np.int64) << 32 | points[longer + 2]
            does[longer[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = _LONG
        _, _, constants = _functions()
        steps, functions = _steps(), does.copy()
        functions[first] = constants[steps[does[first], FREE]]
        before = scan(functions)
        before[first] = FREE
        return np.flatnonzero(_starts()[does, before])


#: Bytes of a word up to which all its pairs are looked through for each merge; a longer one has them in a queue.
_SHORT_WORD = 48
_NONE = 1 << 62


def joins(ranks: dict[bytes, int]) -> dict[int, int]:
    """The id of each piece that two pieces join to, by the numbers of these (the first one's id << 32 | the second one's)."""
    get, out = ranks.get, {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            if (a := get(piece[:k])) is not None and (b := get(piece[k:])) is not None:
                out[a << 32 | b] = rank
    return out


def merge(word: bytes, ranks: dict[bytes, int], joined: dict[int, int] | None = None) -> tuple[int, ...]:
    """The ids of a word: of neighbouring pieces that join to a known one, those with the lowest rank, leftmost first."""
    if word in ranks:
        return (ranks[word],)
    if len(word) > _SHORT_WORD:
        return tuple(ranks[p] for p in _queued(word, ranks))
    return _looked_through([ranks[word[i : i + 1]] for i in range(len(word))], joins(ranks) if joined is None else joined)


def _looked_through(ids: list[int], joined: dict[int, int]) -> tuple[int, ...]:
    """A piece's rank is its id, so what two pieces join to says both how early they do and what stands there then."""
    get = joined.get
    pairs = [get(a << 32 | b, _NONE) for a, b in itertools.pairwise(ids)]
    while pairs and (low := min(pairs)) < _NONE:
        i = pairs.index(low)
        ids[i] = low
        del ids[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(ids[i - 1] << 32 | low, _NONE)
        if i < len(pairs):
            pairs[i] = get(low << 32 | ids[i + 1], _NONE)
    return tuple(ids)


def _queued(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at a place
    queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, j, k = heapq.heappop(queue)
        if end[i] != j or j >= n or end[j] != k:
            continue  # one of the two has been joined meanwhile
        end[i], end[j] = k, -1
        if k < n:
            before[k] = i
            if (r := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(queue, (r, i, k, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:k])) is not None:
            heapq.heappush(queue, (r, h, i, k))
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes batches of texts by the ranks of a file."""

    #: Words that half of the cache holds before it takes the place of the other half, and bytes of the longest one in it.
    MOST_WORDS, LONGEST = 1 << 18, 64

    def __init__(self, path: str, classes: bytes):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = Splitter(classes)
        self.joined = joins(self.ranks)
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.before: dict[bytes, tuple[int, ...]] = {}
        self.pieces: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)

    def _ids(self, word: bytes) -> tuple[int, ...]:
        found = self.before.get(word)
        if found is None:
            found = merge(word, self.ranks, self.joined)
        if len(word) <= self.LONGEST:
            if len(self.known) >= self.MOST_WORDS:
                self.before = self.known.copy()  # words that come up again go over into the new half
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, the byte of its text at which each one starts, and the first id of each text and the end."""
        raw = "".join(texts.to_pylist())
        points = np.frombuffer(raw.encode("utf-32-le"), "<u4")
        data = raw.encode()
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int32)
        text_at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        byte_at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        first = np.searchsorted(byte_at, text_at[:-1][size > 0])
        words = byte_at[self.split.starts(points, first)]
        bounds, known, new = np.append(words, len(data)).tolist(), self.known, self._ids
        found = [known.get(w) or new(w) for w in (data[a:b] for a, b in itertools.pairwise(bounds))]
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(count.sum()))
        at = np.cumsum(self.lengths[ids]) - self.lengths[ids]  # words lie end to end, so tokens do
        cut = np.searchsorted(at, text_at)
        return ids, at - np.repeat(text_at[:-1], np.diff(cut)), cut

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode_range(self, ids: np.ndarray, starts: np.ndarray, a: int, b: int) -> bytes:
        """Bytes a to b - 1 of a text from its ids and their starts; only the tokens that reach into the range are read."""
        lo, hi = max(int(np.searchsorted(starts, a, "right")) - 1, 0), int(np.searchsorted(starts, b))
        if a >= b or lo >= hi:
            return b""
        return self.decode(ids[lo:hi])[a - int(starts[lo]) : b - int(starts[lo])]


@functools.lru_cache(maxsize=2)
def codec(path: str, classes: bytes | None = None) -> Codec:
    return Codec(path, classes or code_point_classes())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False, places: bool = True) -> DataFrame:
    """id, ids, starts: the token ids of each whole text and the byte of the text at which each token starts (unless `places` is False).

    back: decodes the ids in the same pass and adds `decoded` (binary). There is one row for each row of `docs`, repeated
    ids and rows included; a null or empty text has no ids; a null id is common.NULL_ID. Other columns are not read.
    The path of the rank file has to be the same on all machines.
    """
    spark = docs.sparkSession
    ship(spark)
    classes = spark.sparkContext.broadcast(code_point_classes())

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(path, classes.value)
        for b in slices(batches):
            ids, starts, cut = own.encode(b.column(1).cast(pa.string()))
            at = pa.array(cut, pa.int32())
            columns = {"id": b.column(0), "ids": pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()))}
            if places:
                columns["starts"] = pa.ListArray.from_arrays(at, pa.array(starts, pa.int32()))
            if back:
                columns["decoded"] = pa.array([own.decode(ids[a:z]) for a, z in itertools.pairwise(cut.tolist())], pa.binary())
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return each_row(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>" + ", starts array<int>" * places + ", decoded binary" * back)


def decode(coded: DataFrame, path: str, a: int = 0, b: int | None = None) -> DataFrame:
    """id and decoded (binary): the bytes a to b - 1 of each text, or all from a on, from `coded` (id, ids, starts)."""
    spark = coded.sparkSession
    ship(spark)
    classes = spark.sparkContext.broadcast(code_point_classes())

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(path, classes.value)
        for batch in slices(batches):
            out = [own.decode_range(np.array(i, np.int64), np.array(s, np.int64), a, 2**62 if b is None else b) for i, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["id", "decoded"])

    return coded.select("id", "ids", "starts").mapInArrow(run, "id long, decoded binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of each row."""
    both = encode(docs, path, id_col, text_col, True, False)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(id_back("id", "doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
