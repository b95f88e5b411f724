"""Log messages and shell commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shell commands whose output is a log (logs, events, describe, watch).
LOG_COMMAND = (
    r"\b(?:kubectl\s+(?:logs|get\s+events|describe|get\s+\S+\s+-w)|docker\s+(?:logs|events))\b"
)

# Blocked fragments in checking order, with the answer given for each.
BLOCKED_COMMANDS = (
    ("kubectl edit", "Error: Cannot use `kubectl edit`. Use `kubectl patch` instead."),
    ("edit svc", "Error: Cannot use `kubectl edit`. Use `kubectl patch` instead."),
    (
        "kubectl port-forward",
        "Error: Cannot use `kubectl port-forward` because it is an interactive command.",
    ),
    ("docker logs -f", "Error: Cannot use `docker logs -f`. Use `docker logs` instead."),
    ("kubectl logs -f", "Error: Cannot use `kubectl logs -f`. Use `kubectl logs` instead."),
)


def normalize_message(text: Column) -> Column:
    """``severity:X,message:Y`` (or ``level:``) for a JSON message with both as text.

    Text holding the word ``severity`` is only tried for that key. Anything else stays as it is.
    """
    parsed = F.try_parse_json(text)

    def as_text(key: str) -> Column:
        item = F.try_variant_get(parsed, f"$.{key}", "variant")
        return F.when(
            F.schema_of_variant(item) == "STRING", F.try_variant_get(parsed, f"$.{key}", "string")
        )

    def short(key: str) -> Column:
        return F.coalesce(
            F.concat(F.lit(f"{key}:"), as_text(key), F.lit(",message:"), as_text("message")), text
        )

    return (
        F.when(text.contains("severity"), short("severity"))
        .when(text.contains("level"), short("level"))
        .otherwise(text)
    )


def is_log_command(command: Column) -> Column:
    return command.rlike(LOG_COMMAND)


def command_policy(command: Column) -> Column:
    """Answer of the first blocked fragment found in the command; NULL when it is allowed."""
    verdict = F.lit(None).cast("string")
    for fragment, answer in reversed(BLOCKED_COMMANDS):
        verdict = F.when(command.contains(fragment), answer).otherwise(verdict)
    return verdict


def has_error_text(text: Column) -> Column:
    return F.lower(text).contains("error")
