"""Role repair against enumeration."""

import itertools
import random

import pytest

from voltweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, edit string"


def cost_of(codes, roles):
    total, before = 0, len(chat.ROLES)
    for c, r in zip(codes, roles):
        total += chat.STEP[before][r] + chat.LABEL[c][r]
        before = r
    return total + chat.END[before]


def best(codes):
    return min(cost_of(codes, roles) for roles in itertools.product(range(3), repeat=len(codes)))


def turns(spark, conversations):
    rows = [(c, t, role, f"{c}.{t}", "e") for c, roles in conversations.items() for t, role in enumerate(roles)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def by_conversation(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.position)):
        out.setdefault(r.conv_id, []).append(r)
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_cheapest_and_legal(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    r = random.Random(3)
    names = ["system", "user", "assistant", "USER ", "gpt", None, "tool"]
    conversations = {c: [r.choice(names) for _ in range(r.randint(1, 7))] for c in range(60)}
    code = lambda n: {"system": 0, "user": 1, "assistant": 2, "USER ": 1, "gpt": 2}.get(n, -1)
    got = by_conversation(chat.repair(turns(spark, conversations)).collect())
    for c, roles in conversations.items():
        rows = got[c]
        assert [x.turn for x in rows] == list(range(len(roles)))
        codes = [code(n) for n in roles]
        assert cost_of(codes, [chat.ROLES.index(x.new_role) for x in rows]) == best(codes)
        text = "".join(x.rendered for x in rows)
        assert text.count("<|im_start|>") == text.count("<|im_end|>") and text.endswith(chat.CLOSE)
        said = [part.split("\n")[0] for part in text.split("<|im_start|>")[1:]]
        assert said[-1] == "assistant" and all(b in chat.NEXT[a] for a, b in zip(["", *said], said))
        assert all(f"{c}.{t}" in text for t in range(len(roles)))


def test_blocks_change_nothing_but_ties(spark, monkeypatch):
    long = {1: (["user", "assistant"] * 40)[:-1] + ["user", "user", "assistant", "tool"]}
    whole = [x.new_role for x in by_conversation(chat.repair(turns(spark, long)).collect())[1]]
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert [x.new_role for x in by_conversation(chat.repair(turns(spark, long)).collect())[1]] == whole


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, ""), (1, 0, "user", None, ""), (1, None, "system", "", ""), (None, 1, "user", "x", ""), (None, 2, None, "y" * 300_000, "")]
    got = by_conversation(chat.repair(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [r.edit for r in got[1]] == ["keep", "keep", "merge"] and [r.new_role for r in got[None]] == ["user", "assistant"]
    assert chat.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clean_conversations_stay_as_they_are(spark):
    got = chat.repair(turns(spark, {5: ["system", "user", "assistant"]})).orderBy("position").collect()
    assert [r.edit for r in got] == ["keep"] * 3
    assert "".join(r.rendered for r in got) == (
        "<|im_start|>system\n5.0<|im_end|>\n<|im_start|>user\n5.1<|im_end|>\n<|im_start|>assistant\n5.2<|im_end|>\n")


def roles_of(codes, block):
    """The operator's parts, put together without Spark."""
    parts = [codes[k: k + block] for k in range(0, len(codes), block)]
    before = chat.prefixes([chat.matrix(p) for p in parts])
    lasts = chat.cuts([chat.traced(p, b) for p, b in zip(parts, before)], before[-1])
    return [r for p, b, last in zip(parts, before, lasts) for r in chat.resolve(p, b, last)[1:]]


def test_ties_do_not_depend_on_the_blocks():
    """All sequences of 4 and 6 turns: the cheapest repair whose roles, read from the end, come first."""
    for n in (4, 6):
        for codes in itertools.product((-1, 0, 1, 2), repeat=n):
            whole = roles_of(list(codes), 10)
            assert all(roles_of(list(codes), block) == whole for block in (1, 2, 3)), codes
            if n == 4:
                ways = [w for w in itertools.product(range(3), repeat=n) if cost_of(codes, w) == best(codes)]
                assert tuple(whole) == min(ways, key=lambda w: w[::-1]), codes


def test_ties_in_blocks_of_rows(spark, monkeypatch):
    r = random.Random(9)
    conversations = {c: [r.choice(["system", "user", "assistant", "x"]) for _ in range(r.randint(1, 11))] for c in range(80)}
    whole = {c: [x.new_role for x in v] for c, v in by_conversation(chat.repair(turns(spark, conversations)).collect()).items()}
    for block in (1, 3):
        monkeypatch.setattr(chat, "BLOCK", block)
        got = by_conversation(chat.repair(turns(spark, conversations)).collect())
        assert {c: [x.new_role for x in v] for c, v in got.items()} == whole
