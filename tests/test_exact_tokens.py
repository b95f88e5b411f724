"""Token counts and cuts against the vocabulary's own library."""

import base64
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

from compare import SF_DIR
from opsframe.operators import sessions as os_
from opsframe.plans.registry import CATALOG, table
from opsframe.plans.sessions import vocabulary


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_usage_of_messages(spark, encoding):
    want = defaultdict(lambda: [0, 0, 0])
    for row in table(spark, SF_DIR, "conversations").collect():
        ours = row.role == "assistant"
        want[str(row.conv_id)][0] += ours
        want[str(row.conv_id)][2 if ours else 1] += len(encoding.encode_ordinary(row.text))
    got = CATALOG["message_usage_exact"].build(spark, SF_DIR).collect()
    assert {r.session_id: [r.steps, r.in_tokens, r.out_tokens] for r in got} == dict(want)


def test_usage_of_sessions_counts_joined_text(spark, encoding):
    rows = [("a", [("user", "Hel"), ("assistant", "x"), ("user", "lo <|endoftext|>"), (None, "!"), ("user", None)]), ("b", []), ("c", None)]
    sessions = spark.createDataFrame(rows, "session_id string, trace array<struct<role:string,content:string>>")
    got = {r.session_id: (r.steps, r.in_tokens, r.out_tokens) for r in os_.usage_of_sessions(sessions, vocabulary(spark).count).collect()}
    joined = len(encoding.encode_ordinary("Hello <|endoftext|>!"))
    assert got["a"] == (1, joined, 1) and got["b"] == (0, 0, 0) and got["c"][1:] == (0, 0)
    assert joined < sum(len(encoding.encode_ordinary(t)) for t in ("Hel", "lo <|endoftext|>", "!"))


def test_history(spark, encoding):
    sessions = defaultdict(list)
    for row in table(spark, SF_DIR, "conversations").orderBy("conv_id", "turn").collect():
        sessions[str(row.conv_id)].append((row.turn, row.text))
    want = {}
    for name, turns in sessions.items():
        total = 0
        for turn, text in reversed(turns):
            cost = len(encoding.encode_ordinary(text)) + 4
            total += cost
            if total <= 150:
                want[name, turn] = text
            elif total == cost:
                want[name, turn] = encoding.decode(encoding.encode_ordinary(text)[:146])
                break
            else:
                break
    got = {(r.session_id, r.turn): r.content for r in CATALOG["history_trim_exact"].build(spark, SF_DIR).collect()}
    assert got == want and any(len(text) != len(dict(sessions[n])[t]) for (n, t), text in want.items())


def test_cut_in_a_character_and_nulls(spark, encoding):
    words = vocabulary(spark)
    df = spark.createDataFrame([("naïve 😀 text",), (None,), ("",)], "t string")
    for n in range(1, 8):
        got = [r[0] for r in df.select(words.cut(df.t, n)).collect()]
        assert got == [encoding.decode(encoding.encode_ordinary("naïve 😀 text")[:n]), None, ""]
