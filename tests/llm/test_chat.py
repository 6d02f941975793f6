"""Formatting there and back."""

from __future__ import annotations

import hashlib
import random

from wiretally.llm import chat

BITS = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "\n", " ", "a", "é", "%0A", "<", "/s>"]


def test_round_trip_of_any_text_and_role(spark):
    chance = random.Random(8)
    talks = {}
    for conv in range(60):
        talks[conv] = [
            (
                chance.choice(["user", "assistant", "system", "a\nb</s>%0A", "", "\\"]),
                "".join(chance.choices(BITS, k=chance.randint(0, 12))),
            )
            for _ in range(chance.randint(1, 9))
        ]
    talks[60] = [("user", "\\" * 20_000), ("assistant", "\\" * 20_000 + "</s>" + "x" * 100_000)]
    rows = [(conv, turn, role, text) for conv, own in talks.items() for turn, (role, text) in enumerate(own)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.examples(table.repartition(4))
    counts = {conv: 0 for conv in talks}
    for r in made.collect():
        counts[r.conv_id] += 1
        own = r.formatted[r.loss_start : r.loss_end]
        assert "</s>" not in own.replace("\\</s>", "") and r.formatted.endswith("\n</s>")
    for conv, own in talks.items():
        replies = sum(role == "assistant" for role, _ in own)
        assert counts[conv] == replies + (own[-1][0] != "assistant")
    for r in chat.read_back(made).collect():
        own = talks[r.conv_id]
        loss = "".join(text for role, text in own if role == "assistant")
        lines = "".join(f"{role}\n{text}\n" for role, text in own)
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_edge_rows(spark):
    rows = [
        (1, 0, None, None, 1), (1, 1, "assistant", "x", 1), (1, 1, "assistant", "x", 1), (None, None, "user", "q", 1),
        (2, 0, "user", "", 1), (3, 0, "assistant", None, 1), (1, None, "system", "first", 1),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    found = {r.conv_id: r for r in chat.read_back(chat.examples(table)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in found.items()} == {1: (4, 2), None: (1, 0), 2: (1, 0), 3: (1, 0)}
    text = "system\nfirst\n\n\nassistant\nx\nassistant\nx\n"
    assert found[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert chat.read_back(chat.examples(table.limit(0))).count() == 0


def test_only_the_last_reply_is_trainable(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = sorted(chat.examples(table).collect())
    assert [r.formatted[r.loss_start : r.loss_end] for r in made] == ["t1", "t3", "t5"]
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(made, made[1:], strict=False))
