"""Byte-level BPE encoding and decoding with tree concatenation of long texts.

Texts up to `piece_points` code points are encoded in the task that reads them. A longer text is halved until its
pieces are short enough; the pieces are dealt to all tasks and encoded in parallel, and then joined pairwise as a
tree. At each join a window around the cut is encoded again and grows until its first tokens are those of the left
side and its last tokens those of the right side.

Why agreement is exact: a byte-level BPE sequence is the encoding of its text if and only if each two neighbours are
the encoding of their own text. Inside the left side, the window and the right side this holds already, and where
they overlap they have the same tokens, so it holds across both seams. The word splitter has to see the same words,
too. A window therefore starts and ends only where that is sure: between a letter or digit and white space, where
every scan splits, or inside a run of letters, of digits or of punctuation, which every scan takes to its end.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import every_row, id_back, rows, slices

#: Code points that both sides of a window have to agree on.
MARGIN = 16


@functools.cache
def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class Codec:
    """Encodes and decodes as the tokenizers library does with the given file and add_special_tokens=False."""

    def __init__(self, path: str):
        import tiktoken

        with open(path) as f:
            spec = json.load(f)
        chars, model = byte_of_char(), spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [ranks[bytes(chars[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if merged != sorted(merged) or any(len(t) == 1 and merged and i >= merged[0] for t, i in ranks.items()):
            raise ValueError("ids have to follow the order of the merges")
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("a plain byte-level splitter is needed")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = frozenset(special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.lengths[i] = len(t)

    def encode(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> str:
        return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _kind(c: str) -> str:
    if c.isalpha():
        return "letter"
    if c in "0123456789":
        return "digit"
    return "mark" if c.isascii() and c.isprintable() and c != " " else ""


def _safe(text: str, at: int, start: bool) -> bool:
    """Whether all scans that pass here split alike behind (start) or before this place."""
    if at <= 0 or at >= len(text):
        return True
    a, b = text[at - 1], text[at]
    if b in " \n" and _kind(a) in ("letter", "digit"):
        return True
    return bool(_kind(a)) and _kind(a) == _kind(b) and not (start and b == "'")


def _edges(codec: Codec, text: str, ids: np.ndarray) -> np.ndarray:
    """The code point at which each token starts and the last ends; -1 inside a code point."""
    ends = np.concatenate([[0], np.cumsum(codec.lengths[ids])])
    raw = np.frombuffer(text.encode(), np.uint8)
    first = (raw & 0xC0) != 0x80
    points = np.concatenate([np.cumsum(first) - 1, [len(text)]])
    whole = np.concatenate([first, [True]])
    return np.where(whole[ends], points[ends], -1)


def join(codec: Codec, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], window: int = 64) -> tuple[str, np.ndarray]:
    """The encoding of two neighbours' text from the encodings of both."""
    text, cut = left[0] + right[0], len(left[0])
    if not left[0] or not right[0]:
        return text, np.concatenate([left[1], right[1]])
    edge_l, edge_r = _edges(codec, *left), _edges(codec, *right)
    while True:
        i = next((k for k in range(int(np.searchsorted(np.maximum.accumulate(edge_l), cut - window, "right")) - 1, -1, -1) if edge_l[k] >= 0 and _safe(text, int(edge_l[k]), True)), 0) if window < cut else 0
        j = len(right[1])
        if window < len(right[0]):
            j = next((k for k in range(int(np.searchsorted(np.maximum.accumulate(edge_r), window, "left")), j) if edge_r[k] >= 0 and _safe(text, cut + int(edge_r[k]), False)), j)
        p, q = int(edge_l[i]), cut + int(edge_r[j])
        mid = codec.encode(text[p:q])
        m = n = 0
        if i:  # tokens that reach over the margin
            m = int(np.argmax(edge_l[i:] >= p + MARGIN)) or len(left[1]) - i
        if j < len(right[1]):
            ahead = np.flatnonzero((edge_r[:j] >= 0) & (edge_r[:j] <= q - cut - MARGIN))
            n = j - (int(ahead[-1]) if len(ahead) else 0)
        if np.array_equal(mid[:m], left[1][i : i + m]) and np.array_equal(mid[len(mid) - n :], right[1][j - n : j]):
            return text, np.concatenate([left[1][:i], mid, right[1][j:]])
        if p == 0 and q == len(text):
            return text, mid
        window *= 2


def tree(codec: Codec, parts: list[tuple[str, np.ndarray]]) -> tuple[str, np.ndarray]:
    while len(parts) > 1:
        parts = [join(codec, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def halves(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    half = len(text) // 2
    return halves(text[:half], most) + halves(text[half:], most)


_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("text", pa.string())])
_CODED = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])


def _split(most: int):
    def split(batches):
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = halves(text, most)
                yield pa.record_batch([pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], schema=_PIECES)

    return split


def _encode(path: str, at: int, back: bool = False):
    """Adds the ids to a batch whose column `at` is the text; the text gives way to that of the ids if `back` is set."""

    def encode(batches):
        own = codec(path)
        for b in slices(batches):
            ids = [own.encode(t) for t in b.column(at).to_pylist()]
            text = pa.array([own.decode(i) for i in ids], pa.string()) if back else b.column(at)
            coded = pa.array([i.tobytes() for i in ids], pa.binary())
            yield pa.record_batch([*(b.column(k) for k in range(at)), coded, text], names=[*b.schema.names[:at], "ids", "text"])

    return encode


def _join(path: str, back: bool):
    def joined(table: pa.Table) -> pa.Table:
        own, parts = codec(path), table.sort_by("piece")
        found = [(t, np.frombuffer(i, "<u4")) for t, i in zip(parts.column("text").to_pylist(), parts.column("ids").to_pylist(), strict=True)]
        text, ids = tree(own, found)
        return pa.table([pa.array([parts.column("id")[0].as_py()], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([own.decode(ids) if back else text], pa.string())], schema=_CODED)

    return joined


@every_row("id")
def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", piece_points: int = 32768, back: bool = False) -> DataFrame:
    """id, ids, text: the token ids of each whole text as little-endian unsigned 32-bit integers, and the text.

    back: `text` is decoded from the ids in the same pass. A null or empty text has no ids. A null id is returned as the
    smallest long, see common.NULL_ID. One document is put together in one task, as it is one row before and after; no
    task holds more than that.
    """
    texts = rows(docs, id_col, text_col)
    short = texts.where(F.length("text") <= piece_points).mapInArrow(_encode(path, 1, back), "id long, ids binary, text string")
    pieces = texts.where(F.length("text") > piece_points).mapInArrow(_split(piece_points), "id long, piece int, text string")
    coded = pieces.repartition("id", "piece").mapInArrow(_encode(path, 2), "id long, piece int, ids binary, text string")
    return short.unionByName(coded.groupBy("id").applyInArrow(_join(path, back), "id long, ids binary, text string"))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """id, ids and the text of the ids, from `coded` (id, ids)."""

    def run(batches):
        own = codec(path)
        for b in slices(batches):
            texts = pa.array([own.decode(np.frombuffer(i, "<u4")) for i in b.column(1).to_pylist()], pa.string())
            yield pa.record_batch([b.column(0), b.column(1), texts], names=["id", "ids", "text"])

    return coded.select("id", "ids").mapInArrow(run, "id long, ids binary, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", piece_points: int = 32768) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    both = encode(docs, path, id_col, text_col, piece_points, True)  # one Python worker for each task
    return both.select(id_back("id", "doc_id"), F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

