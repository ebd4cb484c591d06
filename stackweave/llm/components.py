"""Connected components of a link table, by rounds in which every task contracts what it has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links that a task contracts at once.
LINKS = 1 << 18


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, rising, and of each one the smallest node that these links reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def _contracted(most: int):
    """Links (u, v), all of one u behind each other and v rising, as links of each node to the smallest one that the
    links at hand reach.

    `own` are the rows of the nodes u, one for each. `open` says whether one of them has a smaller neighbour and another one
    besides, so the links aren't yet those of every node to the smallest one of its component.
    """

    def batch(u: np.ndarray, v: np.ndarray, last: bool) -> tuple[pa.RecordBatch, list]:
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        least, most_ = v[first], v[np.append(first[1:], len(u)) - 1]
        more = bool(((least < u[first]) & (least != most_)).any())
        nodes, root = smallest(u, v)
        own = np.zeros(len(nodes), bool)
        own[np.searchsorted(nodes, u)] = True
        at = np.searchsorted(nodes, u[-1])
        own[at] &= last  # the last one's links may go on, its smallest ones go along
        rows = own | (root != nodes)
        columns = [pa.array(nodes[rows]), pa.array(root[rows]), pa.array(own[rows]), pa.array(np.full(int(rows.sum()), more))]
        return pa.record_batch(columns, names=["u", "v", "own", "open"]), [(nodes[at], min(least[-1], root[at])), (nodes[at], least[-1])]

    def run(batches):
        held, size, carried = [], 0, []
        for b in batches:
            for k in range(0, b.num_rows, most):
                piece = b.slice(k, most)
                held.append((piece.column(0).to_numpy(), piece.column(1).to_numpy()))
                size += piece.num_rows
                if size > most:
                    out, carried = batch(*_joined(carried, held), False)
                    yield out
                    held, size = [], 0
        if held or carried:
            yield batch(*_joined(carried, held), True)[0]

    return run


def _joined(carried: list, held: list) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.array([c[k] for c in carried], np.int64), *(h[k] for h in held)]) for k in range(2))


def components(links: DataFrame, scratch: Scratch, most: int = LINKS) -> DataFrame:
    """id, component for each id that occurs in `links` (a, b): component is the smallest id that links reach.

    In each round tasks contract the links that happen to lie together, then every link goes to the tasks of both of its
    nodes, in one exchange, and a task points all nodes of its links at the smallest one that these reach: the step of
    alternating large and small stars for each of its nodes, and more, as its nodes share neighbours. A task contracts
    `most` links at a time, so its memory is bounded whatever a node's links.
    """
    kinds = "u long, v long, own boolean, open boolean"
    edges, before = links.select(F.col("a").alias("u"), F.col("b").alias("v")), None
    while True:
        both = edges.select("u", "v").mapInArrow(_contracted(most), kinds)
        both = both.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("l")).select("l.u", "l.v")
        edges = scratch.keep(both.repartition("u").sortWithinPartitions("u", "v").mapInArrow(_contracted(most), kinds))
        if before is not None:
            scratch.drop(before)
        if not edges.agg(F.max("open")).head()[0]:
            return edges.where("own").select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = edges
