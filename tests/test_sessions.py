"""Transcripts, actions and solutions on the documented cases."""

import json

import pytest
from pyspark.sql import functions as F

from opsframe.functions import sessions as fs
from opsframe.operators import actions as oa, sessions as os_
from opsframe.plans import catalog  # noqa: F401
from opsframe.plans.registry import CATALOG
from opsframe.sources.readers import read_sessions, unreadable_sessions

MESSAGES = "session_id STRING, turn LONG, role STRING, content STRING"
SESSION = "session_id STRING, trace ARRAY<STRUCT<role: STRING, content: STRING>>"


def _block(call, indent=""):
    return f"Action:\n{indent}```\n{indent}{call}\n{indent}```\n"


def _parse(spark, texts, how=oa.extract_actions):
    rows = [("s", i, "assistant", text) for i, text in enumerate(texts)]
    return how(spark.createDataFrame(rows, MESSAGES)).orderBy("turn").collect()


@pytest.mark.parametrize("indent", ["", "        "])
@pytest.mark.parametrize("call,api,args", [
    ("myApi()", "myApi", []),
    ("myApi(10)", "myApi", ["10"]),
    ("myApi(10, 'error')", "myApi", ["10", "'error'"]),
    ("get_logs('compose-post-service', 'test')", "get_logs", ["'compose-post-service'", "'test'"]),
    ("f('a, b', \"c)(\", [1, 'x'], {'k': 'v'}, None, True, -2.5,)", "f",
     ["'a, b'", '"c)("', "[1, 'x']", "{'k': 'v'}", "None", "True", "-2.5"]),
    ("f(r'it\\'s')".replace("r'", "'"), "f", ["'it\\'s'"]),
])
def test_calls(spark, call, api, args, indent):
    row = _parse(spark, [_block(call, indent)])[0]
    assert (row.parse_status, row.api_name, row.positional) == ("ok", api, args)


def test_strict_needs_an_unindented_fence(spark):
    texts = [_block("f()"), _block("f()", "  ")]
    rows = _parse(spark, texts, lambda m: oa.extract_actions(m, strict=True))
    assert [r.parse_status for r in rows] == ["ok", "bad_block"]


@pytest.mark.parametrize("call,command", [
    ('exec_shell("kubectl get pods -n test-social-network")', "kubectl get pods -n test-social-network"),
    ("exec_shell(command='ls')", "ls"),
    ("exec_shell(\"kubectl patch svc -p='[{\\\"op\\\": \\\"replace\\\"}]'\")", "kubectl patch svc -p='[{\"op\": \"replace\"}]'"),
    ("exec_shell('echo it\\'s')", "echo it's"),
])
def test_shell_commands(spark, call, command):
    row = _parse(spark, [_block(call)])[0]
    assert (row.parse_status, row.command) == ("ok", command)


@pytest.mark.parametrize("text,status", [
    ("no block at all", "bad_block"),
    (_block("f()") + _block("g()"), "bad_block"),
    (_block('echo "Hello World"'), "no_call"),
    (_block("exec_shell(ls)"), "bad_quotes"),
    (_block("f(g(1))"), "unsupported"),
    (_block("f(1 + 2)"), "unsupported"),
    (_block("f('open)"), "unsupported"),
])
def test_rejected(spark, text, status):
    assert _parse(spark, [text])[0].parse_status == status


def test_context(spark):
    text = "Thought: look at `x`.\n\n" + _block("f()") + "\nThen wait.\n"
    row = _parse(spark, [text])[0]
    assert row.context == ["Thought: look at `x`.\n\nAction:", "Then wait."]


@pytest.mark.parametrize("call,kind,text,items,pairs", [
    ("submit('yes')", "text", "yes", None, None),
    ("submit(has_anomaly='yes')", "list", None, [], None),
    ("submit(['service1', 'service2'])", "list", None, ["service1", "service2"], None),
    ("submit(faulty_components=['s1', 's2'])", "list", None, [], None),
    ("submit({'system_level': 'xxx', 'fault_type': 'yyy'})", "map", None, None, {"system_level": "xxx", "fault_type": "yyy"}),
    ("submit({'a': 'x', 'a': 'y'})", "map", None, None, {"a": "y"}),
    ("submit({})", "map", None, None, {}),
    ("submit([])", "list", None, [], None),
    ("submit()", "list", None, [], None),
    ("submit(None)", "none", None, None, None),
    ("submit(7)", "number", "7", None, None),
    ("submit('a', \"b\")", "list", None, ["a", "b"], None),
    ("submit('it\\'s\\n\\\\n')", "text", "it's\n\\n", None, None),
])
def test_solutions(spark, call, kind, text, items, pairs):
    rows = [("s", 0, "assistant", _block("submit('old')")), ("s", 1, "assistant", _block(call)), ("s", 2, "env", _block("submit('no')"))]
    actions = oa.extract_actions(spark.createDataFrame(rows, MESSAGES))
    row = oa.submitted_solution(actions).collect()[0]
    assert (row.submit_turn, row.sol_kind, row.sol_text, row.sol_list, row.sol_map) == (1, kind, text, items, pairs)


@pytest.mark.parametrize("text,api,args,command", [
    ("```\nsubmit\n```", "submit", ["None"], None),
    ("submit", "submit", ["None"], None),
    ("submit('x')", "submit", ["'x'"], None),
    ("ls -l", "exec_shell", [], "ls -l"),
    ("Run:\n```bash\nls\npwd\n```", "exec_shell", [], "ls\npwd"),
    ("`ls`", "exec_shell", [], "ls"),
])
def test_onboarding(spark, text, api, args, command):
    row = _parse(spark, [text], oa.onboarding_actions)[0]
    assert (row.api_name, row.positional, row.command) == (api, args, command)


def test_render_and_judge(spark):
    trace = [("user", "Hello"), ("assistant", "Hi there!")]
    df = spark.createDataFrame([("s", trace)], SESSION)
    text = "###user:\nHello\n\n###assistant:\nHi there!\n\n"
    assert df.select(fs.render_trace(F.col("trace"))).collect()[0][0] == text
    request = os_.judge_requests(df).collect()[0]
    assert text in request.user and "[[rating]]" in request.system and "{trace}" not in request.user
    rows = os_.rendered_messages(os_.explode_sessions(df)).orderBy("turn").collect()
    assert "".join(r.rendered for r in rows) == text
    assert [r.offset for r in rows] == [0, text.index("###assistant")]


@pytest.mark.parametrize("text,score", [
    ("Rating: [[5]]", 5.0), ("[3]", 3.0), ("none", -1.0), ("[2] then [[7.5]]", 7.5), ("[[x]] [4.]", 4.0),
])
def test_judge_score(spark, text, score):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(fs.parse_judge_score(F.col("t"))).collect()[0][0] == score


def test_service_view_in_both_forms(spark):
    rows = [("closed", [("user", "u"), ("env", "e")]), ("open", [("env", "e"), ("assistant", "a")])]
    df = spark.createDataFrame(rows, SESSION)
    view = df.select("session_id", fs.service_trace_view(F.col("trace"), F.lit("S"), F.lit("T")).alias("trace"))
    nested = {r.session_id: [tuple(m) for m in r.trace] for r in view.collect()}
    front = [("system", "S"), ("user", "T")]
    assert nested == {"closed": [*front, ("user", "u")], "open": [*front, ("env", "e"), ("assistant", "a")]}
    flat = {}
    for r in os_.service_view(os_.explode_sessions(df), "S", "T").orderBy("turn").collect():
        flat.setdefault(r.session_id, []).append((r.role, r.content))
    assert flat == nested


def test_tail_summary_in_both_forms(spark):
    trace = [("user", str(i) * 400) for i in range(7)]
    df = spark.createDataFrame([("s", trace), ("t", trace[:2])], SESSION)
    want = {"s": "\n".join(f"user: {str(i) * 300}" for i in range(2, 7)), "t": "\n".join(f"user: {str(i) * 300}" for i in range(2))}
    assert {r[0]: r[1] for r in df.select("session_id", fs.tail_summary(F.col("trace"))).collect()} == want
    assert {r[0]: r[1] for r in os_.tail_summaries(os_.explode_sessions(df)).collect()} == want


@pytest.mark.parametrize("limit,kept", [
    (1000, [(0, 40), (1, 40), (2, 40)]), (28, [(1, 40), (2, 40)]), (27, [(2, 40)]), (14, [(2, 40)]), (10, [(2, 24)]),
])
def test_history(spark, limit, kept):
    rows = [("s", i, "user", "x" * 40) for i in range(3)]
    got = os_.trim_history(spark.createDataFrame(rows, MESSAGES), limit).orderBy("turn").collect()
    assert [(r.turn, len(r.content)) for r in got] == kept


def test_history_stops_at_the_first_that_does_not_fit(spark):
    sizes = [4, 400, 4, 4]
    rows = [("s", i, "user", "x" * n) for i, n in enumerate(sizes)]
    got = os_.trim_history(spark.createDataFrame(rows, MESSAGES), 30).collect()
    assert sorted(r.turn for r in got) == [2, 3]


def test_usage(spark):
    rows = [("s", 0, "user", "12345"), ("s", 1, "assistant", "123"), ("s", 2, "assistant", "12"), ("s", 3, "env", "1234")]
    df = spark.createDataFrame(rows, MESSAGES)
    assert tuple(os_.usage(df).collect()[0]) == ("s", 2, 3, 2)
    assert tuple(os_.usage(df, F.length).collect()[0]) == ("s", 2, 9, 5)


def test_session_files(spark, tmp_path):
    good = {"agent": "a", "session_id": "1", "problem_id": "p", "start_time": 1.5, "end_time": 2.5,
            "trace": [{"role": "user", "content": "hi"}], "results": {"steps": 3, "anything": [1]}}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=4))
    (tmp_path / "bad.json").write_text('{"agent": "a", ')
    rows = read_sessions(spark, str(tmp_path)).selectExpr(
        "session_id", "trace[0].content AS c", "try_variant_get(results, '$.steps', 'int') AS steps").collect()
    assert [tuple(r) for r in rows] == [("1", "hi", 3)]
    broken = unreadable_sessions(spark, str(tmp_path)).collect()
    assert [r.file.rsplit("/", 1)[1] for r in broken] == ["bad.json"]


def test_remaining_and_cached(spark):
    problems = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "problem_id STRING")
    done = spark.createDataFrame([("a", "m", "p1"), ("a", "m", "p1"), ("a", "other", "p2"), ("a", "m", None)],
                                 "agent STRING, model STRING, problem_id STRING")
    assert sorted(r[0] for r in os_.remaining_problems(problems, done, "a", "m").collect()) == ["p2", "p3"]
    requests = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id INT, content STRING").withColumn(
        "payload_key", os_.payload_key(F.struct("content")))
    cache = requests.filter("id = 1").select("payload_key", F.lit("r").alias("response"))
    assert {(r.id, r.response) for r in os_.cached_responses(requests, cache).collect()} == {(1, "r"), (2, None), (3, None)}
    assert [r.waiting for r in os_.cache_misses(requests, cache).collect()] == [2]


@pytest.mark.parametrize("name,column,of_nothing", [
    ("session_service_view", "view", "###system:\nYou operate a service.\n\n###user:\nFind the fault.\n\n"),
    ("session_tail_summary", "summary", ""),
    ("session_render", "rendered", ""),
    ("judge_requests", "user", fs.JUDGE_TASK.replace("{trace}", "")),
])
def test_sessions_without_messages_are_kept(spark, tmp_path, name, column, of_nothing):
    rows = [(1, "a\nb"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.session_id: r[column] for r in CATALOG[name].build(spark, str(tmp_path)).collect()}
    assert set(found) == {"1", "2", "3"}
    assert found["2"] == found["3"] == of_nothing != found["1"]
