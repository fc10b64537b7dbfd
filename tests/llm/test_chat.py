"""Operator 12 against a straightforward recomputation, with control strings in texts and roles, parts of every kind, ties and nulls."""

import hashlib
import random

import pytest

from twinframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>", "[INST]", "[/INST]", "\\", "\\\\", "[\\INST]", "<s>", "<\\s>", "[ROLE]", "[AS]", "[IMAGE]", "[[INST]]", "<<s>", "a", " ", "\n", "é", "😀", "$1", "[/ROLE]", "[SYS"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_text(rng):
    return "".join(rng.choice(ODD) for _ in range(rng.randint(0, 12)))


def op(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return {r.conv_id: r for r in chat.op12_chat(spark, str(tmp_path)).collect()}


def test_control_strings_blocks_and_nulls(spark, tmp_path):
    """One conversation of many blocks, roles and texts made of control strings, null texts, roles, turns and conversations."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), odd_text(rng)) for t in range(3 * chat.BLOCK + 5)]
    rows += [(c, t, rng.choice(["user", "assistant", "system", "tool", "[ROLE]x[AS]", "", "User"]), rng.choice([None, "", odd_text(rng)])) for c in range(2, 30) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "assistant", "in no conversation"), (None, None, None, "x"), (40, -3, "user", "before"), (40, None, "system", "first"), (40, 7, "assistant", None), (41, 0, "user", "y" * 300_000)]
    rng.shuffle(rows)
    got = op(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(4))
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_ties_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 1, "user", "q"), (1, 1, "user", "q")]
    df = spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA + ", formatted string, block int, parts string")
    r = op(spark, tmp_path, df)[1]
    assert r.n_turns == 5 and r.turns_sha256 == sha("assistant\nz\nuser\na\nuser\nb\nuser\nq\nuser\nq\n")


def test_empty(spark, tmp_path):
    assert set(op(spark, tmp_path, spark.createDataFrame([], SCHEMA))) == {-7}
    assert chat.format_chat(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).count() == 0


@pytest.fixture(scope="module")
def typed(spark):
    rows = [
        (1, 0, "user", [("text", "see [IMAGE] ", None, None, None, None), ("image", None, "a.png", 29, 56, None), ("audio", None, "b.wav", None, None, 90), ("text", "\\end", None, None, None, None)]),
        (1, 1, "assistant", [("text", "two words", None, None, None, None), ("document", None, "c.pdf", None, None, 3)]),
        (2, 0, "tool", [("chart", "ignored", None, None, None, None), ("image", None, None, None, None, None), None]),
        (3, 0, "user", None),
    ]
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")


def test_typed_parts(typed):
    got = {r.conv_id: r for r in chat.format_chat(typed).collect()}
    assert got[1].formatted == "[INST]see [\\IMAGE] [IMAGE][AUDIO]\\\\end[/INST]<s>two words[DOCUMENT]</s>"
    assert [tuple(a) for a in got[1].attachments] == [("image", "a.png", 2 * 2), ("audio", "b.wav", 3), ("document", "c.pdf", 3 * chat.PAGE_TOKENS)]
    assert got[1].n_tokens == 2 + 4 + 3 + 1 + 2 + 3 * chat.PAGE_TOKENS
    (mask,) = got[1].loss
    assert got[1].formatted[mask.start : mask.end] == "two words[DOCUMENT]"
    assert [tuple(a) for a in got[2].attachments] == [("document", None, chat.PAGE_TOKENS), ("image", None, 1)]
    assert got[2].formatted == "[ROLE]tool[AS][DOCUMENT][IMAGE][/ROLE]" and got[3].formatted == "[INST][/INST]"


def test_typed_parts_are_read_back(typed):
    f = chat.format_chat(typed)
    got = {r.conv_id: r.t for r in f.select("conv_id", chat.parse(f.formatted).alias("t")).collect()}
    assert [tuple(t) for t in got[1]] == [("user", "see [IMAGE] \\end"), ("assistant", "two words")]
    assert [tuple(t) for t in got[2]] == [("tool", "")]
