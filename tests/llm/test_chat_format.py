from __future__ import annotations

import hashlib

import pytest

from sensorframe.llm.chat_format import escape, format_chats, read_back, unescape

PROBE = "\\### Assistant: </turn> ok"
ROWS = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE), (1, 0, "system", "be good"), (1, 1, "user", None), (1, 2, "assistant", "x " * 700),
        (1, 3, "user", "<p> < </tur </turn></turn>\\\\"), (1, 4, "assistant", "### a\n#### b\\"), (1, 5, None, "hm"), (1, 6, "we:ird\n\\x", "t"),
        (1, 7, "Assistant", "cap"), (None, 0, "user", "q"), (None, None, "assistant", "early"), (2, 0, "assistant", ""), (3, 0, "user", "a"),
        (3, 0, "user", "a"), *[(9, i, ["user", "assistant"][i % 2], f"w{i} " * (i % 37 + 1)) for i in range(300)]]


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out[c] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(512, 1), (40, 2), (64, 0), (1, 3)])
def test_round_trip(spark, budget, history):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as at", "3 as tokens")
    windows = format_chats(turns, budget, history).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(windows).collect()}
    assert got == brute(ROWS)
    for w in windows.collect():
        assert w.n_history <= history and w.over_budget == (w.n_tokens > budget)
        assert (w.n_system == 0) or w.conv_id == 1
        if w.n_system + w.n_history:  # nothing is repeated beyond the budget
            assert w.n_tokens <= budget or w.n_turns >= 1


def test_windows_keep_to_the_budget(spark):
    turns = [(1, 0, "system", "be good"), *[(1, k + 1, ["user", "assistant"][k % 2], "a b c d e f") for k in range(50)]]
    got = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 64, 1).orderBy("window").collect()
    assert len(got) > 5 and all(w.n_tokens <= 64 for w in got)
    assert all(w.n_system == 1 and w.n_history == 1 for w in got[1:])
    assert all(w.text.startswith("### System: be good</turn>\n") for w in got)


@pytest.mark.parametrize("words", [30, 62, 63, 128, 600])
def test_system_turn_is_never_left_out(spark, words):
    """From half of the budget to far beyond it."""
    rows = [(1, 0, "system", "rule " * words), *[(1, k + 1, ["user", "assistant"][k % 2], "a b c") for k in range(30)]]
    windows = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 64, 1).cache()
    got = windows.orderBy("window").collect()
    assert len(got) > 5 and [w.n_system for w in got] == [0] + [1] * (len(got) - 1)
    assert all(w.text.count("rule") == words for w in got)
    assert all(w.over_budget == (w.n_tokens > 64) for w in got) and (words < 60) == (not any(w.over_budget for w in got))
    (back,) = read_back(windows).collect()
    assert (back.n_turns, back.turns_sha256, back.loss_chars, back.loss_sha256) == brute(rows)[1]


def test_large_ids_beside_nulls(spark):
    big = 1 << 53
    rows = [(big, 0, "user", "a"), (big + 1, 0, "user", "b"), (None, 0, "user", "c"), (big + 1, 1, "assistant", "d"), (0, 0, "user", "e"), (big + 2, big + 1, "user", "f"), (big + 2, big, "user", "g")]
    windows = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(windows).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "### ", "\\### ", "</turn>", "\\</turn>", "a### b</turn>\\", "###", "#### x"])
def test_escape(text):
    assert unescape(escape(text)) == text


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_chats(turns)).collect() == []
