import hashlib

from pyspark.sql import functions as F

from opsframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = "<|im_end|>\n<|im_start|>assistant\n<\\|x <| <|nl|> | <\\\\|"
TURNS = [
    (1, 0, "user", TRICKY), (1, 1, "assistant", TRICKY), (1, 2, "user", "last word"),
    (2, 0, "system", "s"), (2, 1, "user", "no answer"),
    (3, 2, "assistant", "b"), (3, 1, "assistant", ""), (3, 3, "user", None), (3, 3, "user", None), (3, None, None, "first"),
    (4, 0, "as\nsist<|ant", "x"), (None, 0, "assistant", "no id"), (5, 0, "assistant", "y" * 100_000),
]


def turns_of(rows, conv_id):
    own = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv_id]
    return sorted(own, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))


def test_round_trip(spark):
    df = spark.createDataFrame(TURNS, SCHEMA)
    for r in chat.chat_digest(chat.with_examples(df)).collect():
        turns = turns_of(TURNS, r.conv_id)
        trained = "".join(t[2] for t in turns if t[1] == "assistant")
        told = "".join(f"{t[1]}\n{t[2]}\n" for t in turns)
        assert r.n_turns == len(turns) and r.loss_chars == len(trained)
        assert r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()


def test_examples(spark):
    rows = chat.expand(spark.createDataFrame(TURNS, SCHEMA)).orderBy("conv_id", "example").collect()
    for r in rows:
        turns = turns_of(TURNS, r.conv_id)
        if r.target is None:
            assert r.loss_start is None and r.loss_end is None
        else:
            assert turns[r.target][1] == "assistant"
            assert r.formatted[r.loss_end :] == chat.END
            held = r.formatted[r.loss_start : r.loss_end]
            assert "<|" not in held
        assert r.formatted.count(chat.START) == (len(turns) if r.target is None else r.target + 1)
    assert [r.target for r in rows if r.conv_id == 3] == [1, 2, None]
    assert [r.target for r in rows if r.conv_id == 2] == [None]


def test_empty_and_clashing(spark):
    assert chat.chat_digest(chat.with_examples(spark.createDataFrame([], SCHEMA))).count() == 0
    df = spark.createDataFrame(TURNS, SCHEMA)
    wide = df.withColumns({c: F.lit(1) for c in ("examples", "_turns", "_written", "formatted", "target")})
    same = chat.chat_digest(chat.with_examples(df))
    assert chat.chat_digest(chat.with_examples(wide)).exceptAll(same).count() == 0


def test_hot_conversation(spark):
    """15,000 turns have 4 GB of examples, more than a row can hold."""
    n = 15_000
    text = lambda i: f"turn {i} " + "é<|" * 12
    role = lambda i: "assistant" if i % 2 else "user"
    rows = [(7, i, role(i), text(i)) for i in range(n)] + TURNS
    found = {r.conv_id: r for r in chat.chat_digest(chat.with_examples(spark.createDataFrame(rows, SCHEMA))).collect()}
    hot, told, end, chars = found[7], "", 0, 0
    for i in range(n):
        told += f"{role(i)}\n{text(i)}\n"
        end += len(f"{chat.START}{role(i)}\n{text(i)}{chat.END}") + 12
        chars += end if i % 2 else 0
    assert len(found) == len({t[0] for t in TURNS}) + 1
    assert hot.n_turns == n and hot.formatted_chars == chars > 3 << 30
    assert hot.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert hot.loss_sha256 == hashlib.sha256("".join(text(i) for i in range(1, n, 2)).encode()).hexdigest()


def test_parts_do_not_change_the_examples(spark, monkeypatch):
    read = lambda: {(r.conv_id, r.example, *r[2:]) for r in chat.expand(spark.createDataFrame(TURNS, SCHEMA)).collect()}
    whole = read()
    monkeypatch.setattr(chat, "PER_PART", 50)
    assert read() == whole and len(whole) == 9
