"""Chat formatting with role repair of least cost.

A legal conversation is a word of an automaton: perhaps a system turn, then user and assistant turns in alternation,
the assistant's last. Each given turn is kept, relabelled or merged into the turn before it, and empty turns may be
inserted; dynamic programming over the automaton's states finds the cheapest way.

One turn is a 4 x 4 matrix of costs from state to state, and a sequence of turns is their product with (min, +), which
is associative. A long conversation is therefore cut by a sort over all tasks: each part is reduced to its matrix, the
few matrices of a conversation fix the states between its parts, and each part is then repaired on its own. No task
gathers a whole conversation. Turns are rendered one by one; the fragments of a conversation in order are its text.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, id_back, ship, slices

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: States from which each state may follow.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
KEEP, MERGE, RELABEL = range(3)
ACTIONS = ("keep", "merge", "relabel")
INF = 1 << 30
DEFAULT = {"merge": 1, "relabel": 2, "insert": 3}


@functools.cache
def moves(role: int, merge: int, relabel: int, insert: int) -> list[list[tuple]]:
    """For a turn with this role, from state to state: cost, action and the roles inserted before it.

    role is 1 to 3 as the states, or 0 for any other. Of equal costs the fewest inserted turns, then the first action.
    """
    out = [[(INF, KEEP, ())] * 4 for _ in range(4)]
    for s in range(4):
        for n in range(3):
            for between in itertools.product(range(1, 4), repeat=n):
                chain = (s, *between)
                if any(b not in LEGAL[a] for a, b in itertools.pairwise(chain)):
                    continue
                ways = [(t, 0 if t == role else relabel, KEEP if t == role else RELABEL) for t in LEGAL[chain[-1]]]
                if not n and s != START:
                    ways.append((s, merge if s == role else merge + relabel, MERGE))
                for t, cost, action in ways:
                    way = (cost + n * insert, action, between)
                    if (way[0], n, action) < (out[s][t][0], len(out[s][t][2]), out[s][t][1]):
                        out[s][t] = way
    return out


def ending(s: int, insert: int) -> tuple[int, tuple]:
    """Cost of the turns inserted at the end."""
    return {START: (0, ()), SYSTEM: (2 * insert, (USER, ASSISTANT)), USER: (insert, (ASSISTANT,)), ASSISTANT: (0, ())}[s]


def product(roles: list[int], costs: tuple) -> np.ndarray:
    """The matrix of a sequence of turns."""
    steps = [np.array([[w[0] for w in row] for row in moves(r, *costs)], np.int64) for r in range(4)]
    out = np.where(np.eye(4, dtype=bool), 0, INF).astype(np.int64)
    for r in roles:
        out = np.minimum((out[:, :, None] + steps[r][None]).min(1), INF)
    return out


def repair(roles: list[int], first: int, last: int, costs: tuple) -> list[tuple]:
    """state, action, inserted, cost of each turn on a cheapest way from one state to another."""
    best = [[INF] * 4 for _ in range(len(roles) + 1)]
    best[0][first] = 0
    back = []
    for k, r in enumerate(roles):
        table, came = moves(r, *costs), [0] * 4
        for t in range(4):
            ways = [(best[k][s] + table[s][t][0], table[s][t][1], s) for s in range(4)]
            best[k + 1][t], _, came[t] = min(ways)
        back.append(came)
    out, t = [], last
    for k in range(len(roles) - 1, -1, -1):
        s = back[k][t]
        cost, action, between = moves(roles[k], *costs)[s][t]
        out.append((t, action, between, cost))
        t = s
    return out[::-1]


def _grouped(batches, columns: int):
    """Runs of rows with the same first two columns, over batches that are sorted by them."""
    key, held = None, []
    for b in slices(batches, 4096):
        for row in zip(*(b.column(k).to_pylist() for k in range(columns)), strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row)
    if held:
        yield key, held


def _matrices(costs: tuple):
    def run(batches):
        for (conv, part), turns in _grouped(batches, 4):
            flat = product([r[3] for r in turns], costs).ravel().tolist()
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([flat], pa.list_(pa.int64()))], names=["conv", "part", "m"])

    return run


def _between(costs: tuple):
    """The states before and behind each part of a conversation, whose matrices come in order."""

    def run(batches):
        for b in slices(batches):
            out = [[] for _ in range(5)]
            for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cost, came = [0, INF, INF, INF], []
                for p in parts:
                    m = np.array(p["m"], np.int64).reshape(4, 4) + np.array(cost, np.int64)[:, None]
                    came.append(m.argmin(0).tolist())
                    cost = np.minimum(m.min(0), INF).tolist()
                t = min(range(4), key=lambda s: (cost[s] + ending(s, costs[2])[0], s))
                for k in range(len(parts) - 1, -1, -1):
                    s = came[k][t]
                    for column, value in zip(out, (conv, parts[k]["part"], s, t, k + 1 == len(parts)), strict=True):
                        column.append(value)
                    t = s
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["conv", "part", "first", "last", "final"])

    return run


_DONE = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("action", pa.string()), ("role", pa.string()), ("inserted", pa.list_(pa.string())), ("appended", pa.list_(pa.string())), ("cost", pa.int64()), ("opens", pa.bool_())])


def _repaired(costs: tuple):
    def run(batches):
        names = lambda states: [ROLES[s - 1] for s in states]
        for (_, part), turns in _grouped(batches, 7):
            first, last, final = turns[0][4:]
            out = [[] for _ in _DONE]
            fixed = repair([r[3] for r in turns], first, last, costs)
            for k, (row, (state, action, between, cost)) in enumerate(zip(turns, fixed, strict=True)):
                end = ending(last, costs[2]) if final and k + 1 == len(turns) else (0, ())
                values = (part, row[2], ACTIONS[action], ROLES[state - 1], names(between), names(end[1]), cost + end[0], first == START and k == 0)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _DONE, strict=True)], schema=_DONE)

    return run


def format_conversations(turns: DataFrame, costs: dict = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each given turn: conv_id, turn, part, seq, given_role, action, role, inserted, appended, cost, fragment.

    Turns are in the order of turn, then role, then a hash of the text, then text; nulls come first. Repeated rows are turns of their own. A null or
    unknown role has to be relabelled; a null text counts as empty. A null conv_id is one more conversation. A turn
    opens with a line <|role|> and ends with a line <|end|>; in texts `<|` becomes `< |`, so no text can open a turn.
    `inserted` are the roles of empty turns before a turn and `appended` of those at the conversation's end. The
    fragments of a conversation in the order of part and seq are its text.
    """
    spark = turns.sparkSession
    ship(spark)
    scratch, c = Scratch(spark), (costs["merge"], costs["relabel"], costs["insert"])
    given = turns.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(NULL_ID)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("given_role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    given = given.withColumn("tie", F.xxhash64("text"))
    order = ["conv", "turn", "given_role", "tie"]
    code = sum((F.when(F.col("given_role") == r, k + 1).otherwise(0) for k, r in enumerate(ROLES)), F.lit(0))
    placed = given.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), F.coalesce(code, F.lit(0)).alias("code"))
    placed = scratch.keep(placed)
    small = placed.select("conv", "part", "seq", "code")

    def dealt(df):
        return df.repartition("conv", "part").sortWithinPartitions("conv", "part", "seq")

    parts = dealt(small).mapInArrow(_matrices(c), "conv long, part int, m array<long>")
    # a conversation has at most one part in each partition of the sort
    states = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "m"))).alias("parts")).mapInArrow(_between(c), "conv long, part int, first int, last int, final boolean")
    states = scratch.keep(states)
    done = dealt(small.join(states, ["conv", "part"]).select("conv", "part", "seq", "code", "first", "last", "final"))
    done = scratch.keep(done.mapInArrow(_repaired(c), "part int, seq long, action string, role string, inserted array<string>, appended array<string>, cost long, opens boolean"))
    both = placed.drop("code", "tie").join(done, ["part", "seq"])

    def empty(roles):
        return F.array_join(F.transform(roles, lambda r: F.concat(F.lit("<|end|>\n<|"), r, F.lit("|>\n"))), "")

    safe = F.regexp_replace("text", r"<\|", "< |")
    opening = F.concat(empty(F.col("inserted")), F.lit("<|end|>\n<|"), F.col("role"), F.lit("|>\n"), safe)
    opening = F.when(F.col("opens"), F.substring(opening, 9, 1 << 30)).otherwise(opening)  # nothing ends before the first turn
    body = F.when(F.col("action") == "merge", F.concat(F.lit("\n"), safe)).otherwise(opening)
    last = placed.groupBy("conv").agg(F.max(F.struct("part", "seq")).alias("z")).select("z.part", "z.seq", F.lit("<|end|>\n").alias("closing"))
    both = both.join(scratch.keep(last), ["part", "seq"], "left")
    fragment = F.concat(body, empty(F.col("appended")), F.coalesce("closing", F.lit("")))
    return both.select(id_back("conv", "conv_id"), "turn", F.col("part").cast("long").alias("part"), "seq", "given_role", "action", "role", "inserted", "appended", "cost", fragment.alias("fragment"))


def report(turns: DataFrame) -> DataFrame:
    """conv_id, turn, action, role, n_inserted, cost, fragment_sha256 of each given turn."""
    out = format_conversations(turns)
    return out.select("conv_id", "turn", "action", "role", (F.size("inserted") + F.size("appended")).cast("long").alias("n_inserted"), "cost", F.sha2(F.col("fragment").cast("binary"), 256).alias("fragment_sha256"))
