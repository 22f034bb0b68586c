import itertools
import random

from townledger.llm import chat
from townledger.llm.common import prepare


def least_cost(roles):
    """All role assignments, each turn merged or set apart with the fewest fillers."""
    best = chat.FAR
    for target in itertools.product((1, 2, 3), repeat=len(roles)):
        def go(k, state, cost):
            nonlocal best
            if k == len(roles):
                best = min(best, cost + chat.INSERT * len(chat.CLOSE[state]))
                return
            label = chat.label_cost(roles[k], target[k])
            if state == target[k]:
                go(k + 1, target[k], cost + label + chat.MERGE)
            if (state, target[k]) in chat.FILL:
                go(k + 1, target[k], cost + label + chat.INSERT * len(chat.FILL[state, target[k]]))
        go(0, chat.START, 0)
    return best


def legal(text):
    names = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
    if names[:1] == ["system"]:
        names = names[1:]
    return names and all(n == ("user", "assistant")[i % 2] for i, n in enumerate(names)) and len(names) % 2 == 0


def test_costs_are_least_and_sequences_legal(spark):
    prepare(spark)
    rng = random.Random(3)
    pool = ["system", "user", "assistant", "User ", "tool", None, "human"]
    convs = {c: [rng.choice(pool) for _ in range(rng.randint(1, 6))] for c in range(40)}
    rows = [(c, k, r, f"t{k}") for c, rs in convs.items() for k, r in enumerate(rs)]
    rows += [(None, 0, "user", None), (7, None, "assistant", ""), (50, 1, "user", "a"), (50, 1, "user", "a")]
    convs[7] = ["assistant", *convs[7]]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for c, rs in convs.items():
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(rs)))
        cost = sum(chat.label_cost(r.role, chat.ROLES.index(r.new_role)) + chat.MERGE * r.merged + chat.INSERT * r.n_inserted for r in mine)
        assert cost == least_cost(rs)
        text = "".join(r.rendered for r in mine)
        assert legal(text) and text.count("<|im_end|>") == text.count("<|im_start|>")
        assert all(f"t{k}" in text for k in range(len(rs) - (c == 7)))


def test_one_long_conversation_over_many_tasks(spark):
    prepare(spark)
    rng = random.Random(4)
    roles = [rng.choice(["user", "assistant", "tool", "system"]) for _ in range(4000)]
    df = spark.createDataFrame([(1, k, r, str(k)) for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = sorted(chat.repair(df).collect(), key=lambda r: r.position)
    cost = sum(chat.label_cost(r.role, chat.ROLES.index(r.new_role)) + chat.MERGE * r.merged + chat.INSERT * r.n_inserted for r in got)
    table = chat.forward(chat.np.array([0, chat.FAR, chat.FAR, chat.FAR]), roles)
    assert cost == min(table[-1][s] + chat.INSERT * len(chat.CLOSE[s]) for s in range(4))
    assert legal("".join(r.rendered for r in got))


def test_empty_table(spark):
    prepare(spark)
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string, conv string")).count() == 0
