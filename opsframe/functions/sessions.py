"""Session transcripts as arrays of ``struct<role, content>``, and token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASSISTANT = "assistant"
ENVIRONMENT = "env"
TOKENS_PER_MESSAGE = 4

# The judge's instructions and the frame put around a transcript.
JUDGE_SYSTEM = """Please act as an impartial judge and evaluate the quality of the response provided by an AI assistant towards a Service Operations task displayed below. 
Your evaluation should consider factors such as the helpfulness, relevance, accuracy, depth, creativity, and level of detail of the response. 
Begin your evaluation by providing a short explanation. Be as objective as possible. 
After providing your explanation, you must rate the response on a scale of 1 to 10 by strictly following this format: "[[rating]]", for example: "Rating: [[5]]".

"""
JUDGE_TASK = """<|The Start of Assistant A's Interaction with Service|>

{trace}

<|The End of Assistant A's Interaction with Service|>"
"""


def estimate_tokens(chars: Column) -> Column:
    """Documented estimate, one token per four characters; not an exact token count."""
    return F.ceil(chars / 4).cast("long")


def render_message(role: Column, content: Column) -> Column:
    return F.concat(F.lit("###"), role, F.lit(":\n"), content, F.lit("\n\n"))


def render_trace(trace: Column) -> Column:
    """All messages as text; empty for a transcript that is empty or NULL."""
    rendered = F.transform(trace, lambda m: render_message(m["role"], m["content"]))
    return F.coalesce(F.array_join(rendered, ""), F.lit(""))


def summary_line(role: Column, content: Column, chars: int = 300) -> Column:
    return F.concat(role, F.lit(": "), F.substring(content, 1, chars))


def tail_summary(trace: Column, n: int = 5, chars: int = 300) -> Column:
    """Last ``n`` messages, each cut to ``chars``, one per line; empty for an empty or NULL transcript."""
    tail = F.slice(trace, F.greatest(F.size(trace) - n + 1, F.lit(1)), n)
    lines = F.transform(tail, lambda m: summary_line(m["role"], m["content"], chars))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def service_trace_view(trace: Column, system: Column, task: Column, closing: Column | None = None) -> Column:
    """System and user message in front; a closing environment message is left out.

    ``closing`` is the number of messages in the last turn, one if not given. An empty or NULL
    transcript gives the two front messages.
    """
    ends = F.size(trace) - (F.lit(1) if closing is None else closing)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    served = lambda m, i: (i < ends) | F.coalesce(m["role"] != ENVIRONMENT, F.lit(True))
    body = F.filter(trace, served)
    front = F.array(message("system", system), message("user", task))
    return F.coalesce(F.concat(front, body), front)


def judge_prompt(rendered: Column) -> Column:
    return F.replace(F.lit(JUDGE_TASK), F.lit("{trace}"), rendered)


def parse_judge_score(text: Column) -> Column:
    """First ``[[n]]``, else first ``[n]``, else -1; n may have decimals."""
    pick = lambda rx: F.nullif(F.regexp_extract(text, rx, 1), F.lit(""))
    found = F.coalesce(pick(r"\[\[(\d+\.?\d*)\]\]"), pick(r"\[(\d+\.?\d*)\]"))
    return F.coalesce(found.cast("double"), F.lit(-1.0))


def task_time(ttd: Column, ttl: Column, tta: Column, ttm: Column) -> Column:
    return F.coalesce(ttd, ttl, tta, ttm)
