import random

import pytest

from spendaudit.llm import chat_format
from spendaudit.llm.chat_format import format_chats

SCHEMA = "conv_id long, turn long, role string, text string, place int, h0 string"


@pytest.fixture
def chats(spark):
    def make(conversations):
        """{id: [(role, text)]} or rows."""
        rows = conversations if isinstance(conversations, list) else [(c, k, r, t) for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
        return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)

    return make


def texts(df):
    parts = {}
    for r in sorted(format_chats(df).collect(), key=lambda r: (r.conv_id, r.part)):
        parts[r.conv_id] = parts.get(r.conv_id, "") + r.text
    return parts


def brute(conversations):
    keep = {}
    for c, turns in conversations.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in conversations.values())
        earlier = any(o == turns and k < c for k, o in conversations.items())
        if not longer and not earlier:
            keep[c] = "".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in turns)
    return keep


def test_random_snapshots_match_brute_force(chats):
    pick = random.Random(4)
    conversations = {}
    for c in range(150):
        if conversations and pick.random() < 0.6:
            base = conversations[pick.choice(list(conversations))]
            cut = base[: pick.randrange(1, len(base) + 1)]
        else:
            cut = []
        conversations[c] = cut + [(pick.choice("ua"), str(pick.randrange(4))) for _ in range(pick.randrange(0 if cut else 1, 4))]
    assert texts(chats(conversations)) == brute(conversations)


def test_blocks_and_parts_change_nothing(chats, monkeypatch):
    conversations = {1: [("user", str(i)) for i in range(300)], 2: [("user", str(i)) for i in range(170)], 3: [("user", str(i)) for i in range(169)] + [("user", "x")]}
    assert texts(chats(conversations)) == brute(conversations)
    monkeypatch.setattr(chat_format, "BLOCK_TURNS", 7)
    rows = format_chats(chats(conversations)).collect()
    assert {r.conv_id for r in rows} == {1, 3} and max(r.n_part_turns for r in rows) == 64
    assert texts(chats(conversations)) == brute(conversations)


def test_odd_rows(chats):
    rows = [
        (None, 0, "user", "lost"), (1, 0, "user", None), (2, 0, "user", ""), (3, 0, None, "a"), (4, 0, "user", "dup"), (4, 0, "user", "dup"),
        (5, 7, "b", "second"), (5, 7, "a", "first"), (5, None, "z", "before"), (6, 0, "user", "é" * 5000), (7, -3, "user", "dup"), (7, 900, "user", "more"),
    ]
    got = texts(chats(rows))
    assert set(got) == {1, 2, 3, 5, 6, 7}  # 4 is a prefix of 7: places count, not turn numbers
    assert got[3].startswith("<|im_start|>unknown\na")
    assert [line for line in got[5].split("\n") if "<|im_end|>" in line] == ["before<|im_end|>", "first<|im_end|>", "second<|im_end|>"]


def test_one_opening_and_many_copies(chats):
    conversations = {c: [("user", "hi"), ("bot", str(c // 4))] for c in range(400)} | {c: [("user", "hi")] for c in range(400, 700)}
    df = chats(conversations)
    assert texts(df) == brute(conversations)
    assert {r.n_equal for r in format_chats(df).collect()} == {4}


def test_empty_table_and_plan(chats, spark):
    assert format_chats(chats([])).collect() == []
    plan = format_chats(chats({1: [("a", "b")]}))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
