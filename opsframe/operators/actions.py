"""Agent messages to actions: the fenced call, its name, its arguments, the submitted solution.

Everything is columns and regular expressions. Arguments are understood in the documented shapes:
text, numbers, True/False/None, lists and dicts of those, positional or by keyword. Other Python
expressions get ``parse_status = 'unsupported'``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.match import strip

SHELL = "exec_shell"
SUBMIT = "submit"

_CLOSED_STRICT = r"(?sU)```\s*\n(.*?)\n```"
# The closing fence may be indented with its block.
_CLOSED = r"(?sU)```\s*\n(.*?)\n[ \t]*```"
_OUTSIDE = r"(?s)```.*?```|(?=```)"

_TEXT = r"""(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")"""
_ATOM = rf"(?:{_TEXT}|[+-]?\d+(?:\.\d+)?|True|False|None)"
_ITEMS = rf"(?:{_ATOM}\s*(?:,\s*{_ATOM}\s*)*+,?\s*)?"
_PAIR = rf"{_TEXT}\s*:\s*{_ATOM}\s*"
_LIST = rf"(?:\[\s*{_ITEMS}\]|\(\s*{_ITEMS}\))"
_MAP = rf"\{{\s*(?:{_PAIR}(?:,\s*{_PAIR})*+,?\s*)?\}}"
_VALUE = rf"(?:{_ATOM}|{_LIST}|{_MAP})"
_NAME = r"[A-Za-z_]\w*\s*=\s*"
_ARGUMENTS = (
    rf"(?s)^(?:{_VALUE}(?:\s*,\s*{_VALUE})*+(?:\s*,\s*{_NAME}{_VALUE})*+"
    rf"|{_NAME}{_VALUE}(?:\s*,\s*{_NAME}{_VALUE})*+)\s*,?\s*$"
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _fenced(content: Column) -> Column:
    """Lines between the first two lines that carry a fence; empty without two of them."""
    # Up to the next fence, then back to the end of the line before it.
    opened = F.regexp_extract(content, r"(?s)```[^\n]*\n(.*?)```", 1)
    return F.regexp_extract(opened, r"(?s)^(.*)\n", 1)


def _context(content: Column) -> Column:
    parts = F.transform(F.split(content, _OUTSIDE, -1), strip)
    return F.filter(parts, lambda p: p != "")


def _unquote(token: Column) -> Column:
    """Value of a text token with its common escapes undone; other tokens as written."""
    inner = F.regexp_extract(token, r"(?s)^.(.*).$", 1)
    hold = F.lit("\u0000")
    for written, meant in ((r"\\", hold), (r"\'", F.lit("'")), (r"\"", F.lit('"')),
                           (r"\n", F.lit("\n")), (r"\t", F.lit("\t"))):
        inner = F.replace(inner, F.lit(written), meant)
    inner = F.replace(inner, hold, F.lit("\\"))
    return F.when(token.rlike(r"^['\"]"), inner).otherwise(token)


def _kind(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^['\"]"), "text")
        .when(token.rlike(r"^[\[(]"), "list")
        .when(token.startswith("{"), "map")
        .when(token == "None", "none")
        .when(token.isin("True", "False"), "bool")
        .otherwise("number")
    )


def _atoms(token: Column) -> Column:
    found = F.regexp_extract_all(token, F.lit(f"({_ATOM})"), F.lit(1))
    return F.transform(found, _unquote)


def _pairs(token: Column) -> Column:
    """Map of alternating atoms; of equal keys the last counts."""

    def build(flat: Column) -> Column:
        even = F.filter(flat, lambda _, i: i % 2 == 0)
        odd = F.filter(flat, lambda _, i: i % 2 == 1)
        last = lambda pair, i: ~F.array_contains(
            F.slice(even, i + 2, F.size(even)), pair["key"]
        )
        zipped = F.transform(
            F.arrays_zip(even.alias("k"), odd.alias("v")),
            lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")),
        )
        return F.map_from_entries(F.filter(zipped, last))

    return _let(_atoms(token), build)


def _split_call(block: Column) -> tuple[Column, Column, Column]:
    """(has both parentheses, name before the first, text up to the last)."""
    opening = F.instr(block, "(")
    closing = F.length(block) - F.instr(F.reverse(block), ")") + 1
    both = (opening > 0) & block.contains(")")
    name = F.when(opening > 0, strip(F.substring(block, F.lit(1), opening - 1))).otherwise("")
    inside = F.substring(block, opening + 1, F.greatest(closing - opening - 1, F.lit(0)))
    return both, name, strip(inside)


def _tokens(args_text: Column) -> Column:
    return F.regexp_extract_all(args_text, F.lit(f"((?:{_NAME})?{_VALUE})"), F.lit(1))


def _understood(args_text: Column) -> Column:
    return (args_text == "") | args_text.rlike(_ARGUMENTS)


def _shell_text(args_text: Column) -> Column:
    """Text of the one quoted argument of a shell call; NULL when it is not quoted."""
    bare = F.when(
        args_text.startswith("command="),
        strip(F.replace(args_text, F.lit("command="), F.lit(""))),
    ).otherwise(args_text)

    def unquote(text: Column) -> Column:
        quoted = lambda q: text.startswith(q) & text.endswith(q)
        peeled = F.when(quoted('"'), F.regexp_replace(text, r'^"+|"+$', "")).when(
            quoted("'"), F.regexp_replace(text, r"^'+|'+$", "")
        )
        return F.replace(
            F.replace(peeled, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'")
        )

    return _let(bare, unquote)


def _arguments(tokens: Column) -> tuple[Column, Column]:
    """(positional, keyword) tokens."""
    named = lambda t: t.rlike("^" + _NAME)
    return F.filter(tokens, lambda t: ~named(t)), F.filter(tokens, named)


def parse_call(content: Column, strict: bool = False) -> Column:
    """``struct<parse_status, api_name, args_text, command, tokens>`` of an agent message.

    Exactly one closed block is required. ``tokens`` are the arguments as written, ``command`` is
    the unquoted shell text. ``strict`` rejects an indented closing fence.
    """
    pattern = _CLOSED_STRICT if strict else _CLOSED
    one_block = F.size(F.regexp_extract_all(content, F.lit(pattern), F.lit(1))) == 1

    def call(block: Column) -> Column:
        both, name, inside = _split_call(block)
        return F.struct(both.alias("both"), name.alias("name"), inside.alias("inside"))

    def result(c: Column) -> Column:
        bare = c["inside"] == ""
        shell = c["name"] == SHELL
        command = F.when(shell & ~bare, _shell_text(c["inside"]))
        status = (
            F.when(~one_block, "bad_block")
            .when(~c["both"], "no_call")
            .when(bare, "ok")
            .when(shell, F.when(command.isNull(), "bad_quotes").otherwise("ok"))
            .when(_understood(c["inside"]), "ok")
            .otherwise("unsupported")
        )
        return F.struct(
            status.alias("parse_status"),
            c["name"].alias("api_name"),
            c["inside"].alias("args_text"),
            command.alias("command"),
            _tokens(c["inside"]).alias("tokens"),
        )

    return _let(_let(_fenced(content), call), result)


def parse_lenient(content: Column) -> Column:
    """As ``parse_call``, but a bare ``submit`` counts and anything that is no ``submit(...)`` is a
    shell command."""

    def result(block: Column) -> Column:
        both, _, inside = _split_call(block)
        trimmed = strip(block)
        bare, call = trimmed == SUBMIT, trimmed.startswith(SUBMIT + "(")
        args_text = F.when(bare, "None").when(call & both, inside).otherwise(F.lit(""))
        command = F.when(~(bare | call), F.regexp_replace(block, r"^[` \n]+|[` \n]+$", ""))
        return F.struct(
            F.when(_understood(args_text), "ok").otherwise("unsupported").alias("parse_status"),
            F.when(bare | call, SUBMIT).otherwise(SHELL).alias("api_name"),
            args_text.alias("args_text"),
            command.alias("command"),
            _tokens(args_text).alias("tokens"),
        )

    whole = lambda block: F.when(block == "", strip(content)).otherwise(block)
    return _let(_let(_fenced(content), whole), result)


def _bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A filter on a projected value is rewritten onto its input, which would parse each message once
    for every use. A one-row generator keeps the values as they are.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _actions(messages: DataFrame, parse) -> DataFrame:
    ours = messages.filter(F.col("role") == "assistant")
    parsed = _bind(ours, _call=parse(F.col("content"))).select("*", "_call.*")
    positional, keywords = _arguments(F.col("tokens"))
    return parsed.withColumns({
        "positional": positional, "keywords": keywords, "context": _context(F.col("content")),
    }).drop("_call", "tokens")


def extract_actions(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Assistant messages with ``api_name, args_text, command, positional, keywords, context,
    parse_status``."""
    return _actions(messages, lambda content: parse_call(content, strict))


def onboarding_actions(messages: DataFrame) -> DataFrame:
    """Lenient form of ``extract_actions``."""
    return _actions(messages, parse_lenient)


def solution(positional: Column) -> Column:
    """``struct<kind, text, items, pairs>``: one positional argument is the solution itself; none or
    several are a list of them."""
    no_text = F.lit(None).cast("string")
    no_pairs = F.lit(None).cast("map<string,string>")

    def build(kind, text, items, pairs) -> Column:
        return F.struct(
            kind.alias("kind"), text.alias("text"), items.alias("items"), pairs.alias("pairs")
        )

    def single(token: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            return build(
                kind,
                F.when(kind.isin("text", "number", "bool"), _unquote(token)),
                F.when(kind == "list", _atoms(token)),
                F.when(kind == "map", _pairs(token)),
            )

        return _let(_kind(token), by_kind)

    def choose(tokens: Column) -> Column:
        many = build(F.lit("list"), no_text, F.transform(tokens, _unquote), no_pairs)
        return F.when(F.size(tokens) == 1, _let(tokens[0], single)).otherwise(many)

    return _let(positional, choose)


def _with_solution(df: DataFrame, positional: Column) -> DataFrame:
    """Adds ``sol_kind, sol_text, sol_list, sol_map``; all NULL where nothing was sent."""
    sent = F.when(positional.isNotNull(), solution(positional))
    parts = {"sol_kind": "kind", "sol_text": "text", "sol_list": "items", "sol_map": "pairs"}
    bound = _bind(df, _sent=sent)
    return bound.withColumns({name: F.col("_sent")[part] for name, part in parts.items()}).drop("_sent")


def _is_submit(call: Column) -> Column:
    return (call["parse_status"] == "ok") & (call["api_name"] == SUBMIT)


def submitted_solution(actions: DataFrame) -> DataFrame:
    """Last well-formed ``submit`` of each session; pre-aggregated, one row per session travels."""
    submits = actions.filter((F.col("parse_status") == "ok") & (F.col("api_name") == SUBMIT))
    last = submits.groupBy("session_id").agg(
        F.max("turn").alias("submit_turn"), F.max_by("positional", "turn").alias("positional")
    )
    return _with_solution(last, F.col("positional")).drop("positional")


def session_solution(sessions: DataFrame) -> DataFrame:
    """Nested sessions with the solution last submitted; found in the row itself, no exchange."""
    candidates = F.filter(
        "trace", lambda m: (m["role"] == "assistant") & m["content"].contains(SUBMIT)
    )
    calls = F.filter(F.transform(candidates, lambda m: parse_call(m["content"])), _is_submit)
    bound = _bind(sessions, _last=F.try_element_at(calls, F.lit(-1)))
    positional = F.when(F.col("_last").isNotNull(), _arguments(F.col("_last.tokens"))[0])
    return _with_solution(bound.withColumn("_positional", positional), F.col("_positional")).drop(
        "_last", "_positional"
    )
