import functools
import random
import re

from stackweave.llm import chat

COSTS = (1, 2, 3)


def cheapest(roles):
    """By trying everything, turn by turn."""

    @functools.cache
    def go(k, state, fresh):
        if k == len(roles):
            best = chat.ending(state, COSTS[2])[0]
        else:
            r = roles[k]
            best = 1 << 30
            for t in chat.LEGAL[state]:
                best = min(best, (0 if t == r else COSTS[1]) + go(k + 1, t, False))
            if state and not fresh:
                best = min(best, COSTS[0] + (0 if state == r else COSTS[1]) + go(k + 1, state, False))
            if fresh < 2:
                for t in chat.LEGAL[state]:
                    best = min(best, COSTS[2] + go(k, t, fresh + 1))
        return best

    return go(0, chat.START, 0)


def test_repair_costs_as_little_as_trying_everything():
    r = random.Random(1)
    for _ in range(300):
        roles = [r.randrange(4) for _ in range(r.randrange(1, 12))]
        m = chat.product(roles, COSTS)[chat.START]
        last = min(range(4), key=lambda s: m[s] + chat.ending(s, 3)[0])
        total = m[last] + chat.ending(last, 3)[0]
        assert total == cheapest(tuple(roles))
        assert sum(x[3] for x in chat.repair(roles, chat.START, int(last), COSTS)) == m[last]


def test_conversations_are_legal_and_whole(spark):
    r = random.Random(2)
    names = ["system", "user", "assistant", "tool", None]
    rows = [(c, t, r.choice(names), r.choice(["hi", "", None, "a <|user|> b", "x\ny"]), "z") for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(None, 0, "user", "q", "z"), (None, None, "user", "q0", "z"), (70, 1, "user", "same", "z"), (70, 1, "user", "same", "z")]
    rows += [(99, t, r.choice(names), f"t{t}", "z") for t in range(3000)]  # one conversation over many partitions
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = chat.format_conversations(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == len(rows)
    assert len({x.part for x in out if x.conv_id == 99}) > 1
    by = {}
    for x in sorted(out, key=lambda x: (x.part, x.seq)):
        by.setdefault(x.conv_id, []).append(x)
    for conv, turns in by.items():
        given = [x for x in rows if x[0] == conv]
        text = "".join(x.fragment for x in turns)
        opened = re.findall(r"^<\|(\w+)\|>$", text, flags=re.M)
        opened = [x for x in opened if x != "end"]
        assert re.fullmatch("s?(ua)*", "".join(x[0] for x in opened)), opened
        assert text.count("<|end|>\n") == len(opened)
        codes = tuple(chat.ROLES.index(x.given_role) + 1 if x.given_role in chat.ROLES else 0 for x in turns)
        if len(codes) < 20:
            assert sum(x.cost for x in turns) == cheapest(codes)
        else:
            m = chat.product(list(codes), COSTS)[0]
            assert sum(x.cost for x in turns) == min(m[s] + chat.ending(s, 3)[0] for s in range(4))
        assert sorted(x.turn if x.turn is not None else -1 for x in turns) == sorted(-1 if x[1] is None else x[1] for x in given)
        assert all("a < |user|> b" in text for x in given if x[3] and "<|user" in x[3])
    assert chat.format_conversations(df.limit(0)).count() == 0
