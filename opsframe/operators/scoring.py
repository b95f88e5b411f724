"""Scoring of submitted solutions against the ground truth.

A solution is ``sol_kind`` (text, list, map, number, bool, none; NULL when nothing was submitted)
with ``sol_text``, ``sol_list`` and ``sol_map``. A scorer adds columns, ``success`` among them, to a
table that has the solution and the problem's truth. ``evaluate`` takes the scorer of each task from
``SCORERS``, where further ones can be put.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.match import exact_match, exact_match_ci
from opsframe.functions.sessions import ASSISTANT, estimate_tokens, task_time
from opsframe.operators.actions import session_solution

Scorer = Callable[[DataFrame], DataFrame]


def detection_accuracy(kind: Column, text: Column, expected: Column) -> Column:
    right = exact_match_ci(text, expected)
    return (
        F.when(F.coalesce(kind, F.lit("none")) != "text", "Invalid Format")
        .when(right, "Correct")
        .otherwise("Incorrect")
    )


def score_detection(df: DataFrame) -> DataFrame:
    """Adds ``accuracy``: Correct, Incorrect or Invalid Format (anything that is not text)."""
    return df.withColumn(
        "accuracy",
        detection_accuracy(F.col("sol_kind"), F.col("sol_text"), F.col("expected")),
    )


def score_localization(df: DataFrame) -> DataFrame:
    """Adds ``loc_accuracy, success, is_subset``.

    Exact answer 100; truth among n answers 100 / n; else 0. Success needs the exact answer. For a
    text answer containment is by character, for a map by key.
    """
    kind = F.coalesce(F.col("sol_kind"), F.lit("none"))
    members = (
        F.when(kind == "list", F.col("sol_list"))
        .when(kind == "map", F.map_keys("sol_map"))
        .when(kind == "text", F.split("sol_text", ""))
        .otherwise(F.array().cast("array<string>"))
    )
    truth = F.array("component")
    exact = F.when(kind == "list", exact_match(F.col("sol_list"), truth)).otherwise(
        (kind == "text") & F.coalesce(F.col("sol_text") == F.col("component"), F.lit(False))
    )
    return (
        df.withColumn("_members", F.filter(members, lambda m: m.isNotNull()))
        .withColumn("_exact", F.coalesce(exact, F.lit(False)))
        .withColumn(
            "is_subset", F.coalesce(F.array_contains("_members", F.col("component")), F.lit(False))
        )
        .withColumn(
            "loc_accuracy",
            F.when(F.col("_exact"), 100.0)
            .when(F.col("is_subset"), 100.0 / F.size("_members"))
            .otherwise(0.0),
        )
        .withColumn(
            "success", F.col("_exact") | (F.col("is_subset") & (F.size("_members") == 1))
        )
        .drop("_members", "_exact")
    )


def score_analysis(df: DataFrame) -> DataFrame:
    """Adds ``system_level_correct, fault_type_correct, success``; only a map can be right."""

    def right(key: str) -> Column:
        given = F.coalesce(F.try_element_at("sol_map", F.lit(key)), F.lit(""))
        same = (F.col("sol_kind") == "map") & exact_match_ci(given, F.col(key))
        return F.coalesce(same, F.lit(False))

    return (
        df.withColumn("system_level_correct", right("system_level"))
        .withColumn("fault_type_correct", right("fault_type"))
        .withColumn("success", F.col("system_level_correct") & F.col("fault_type_correct"))
    )


def _detected(df: DataFrame) -> DataFrame:
    return score_detection(df).withColumn("success", F.col("accuracy") == "Correct")


SCORERS: dict[str, Scorer] = {
    "detection": _detected,
    "localization": score_localization,
    "analysis": score_analysis,
}


def score_join(submissions: DataFrame, problems: DataFrame) -> DataFrame:
    """Submissions with the truth of their problem."""
    return submissions.join(problems, "problem_id")


def unknown_problems(submissions: DataFrame, problems: DataFrame) -> DataFrame:
    """Submissions whose problem id is not in the catalogue."""
    return submissions.join(problems.select("problem_id"), "problem_id", "left_anti")


def _chars(trace: Column, ours: bool) -> Column:
    """Total length of one side's messages."""
    mine = F.filter(trace, lambda m: (m["role"] == ASSISTANT) == F.lit(ours))
    return F.aggregate(
        mine, F.lit(0).cast("long"), lambda total, m: total + F.coalesce(F.length(m["content"]), F.lit(0))
    )


def solved_sessions(sessions: DataFrame, envelope: Sequence[str] = ()) -> DataFrame:
    """Nested sessions with steps, token estimates and the solution last submitted.

    All of it is read from the session's own array, so nothing is exchanged.
    """
    trace = F.col("trace")
    return session_solution(sessions).select(
        "session_id", "agent", "problem_id", "start_time", "end_time", *envelope,
        F.size(F.filter(trace, lambda m: m["role"] == ASSISTANT)).cast("long").alias("steps"),
        estimate_tokens(_chars(trace, False)).alias("in_tokens"),
        estimate_tokens(_chars(trace, True)).alias("out_tokens"),
        "sol_kind", "sol_text", "sol_list", "sol_map",
    )


def evaluate(
    sessions: DataFrame,
    problems: DataFrame,
    mitigation: DataFrame | None = None,
    envelope: Sequence[str] = (),
    scorers: dict[str, Scorer] | None = None,
) -> DataFrame:
    """Nested sessions of known problems to one result row each; ``unknown_problems`` has the others.

    Columns named in ``envelope`` are carried along.

    ``mitigation`` is ``(session_id, success)`` from the recovery checks; without it the success of
    mitigation sessions is NULL, since it is not in the transcript. Every entry of ``SCORERS`` says the
    success of the sessions of its task; the columns named here come from the three built-in ones.
    ``scorers`` are further rules by task, for this evaluation alone; they may take a built-in one's place.
    """
    solved = solved_sessions(sessions, envelope)
    known = score_join(solved, problems)
    task = F.col("task")
    scored, success = known, F
    for name, scorer in {**SCORERS, **(scorers or {})}.items():
        scored = scorer(scored).withColumnRenamed("success", f"_success_{name}")
        success = success.when(task == name, F.col(f"_success_{name}"))
    if mitigation is None:
        scored = scored.withColumn("mit_success", F.lit(None).cast("boolean"))
    else:
        checks = mitigation.select("session_id", F.col("success").alias("mit_success"))
        scored = scored.join(checks, "session_id", "left")
    spent = F.col("end_time") - F.col("start_time")
    times = [
        F.when(task == name, spent).alias(label)
        for name, label in (
            ("detection", "TTD"), ("localization", "TTL"), ("analysis", "TTA"), ("mitigation", "TTM"),
        )
    ]
    only = lambda name, column: F.when(task == name, F.col(column))
    return scored.select(
        "session_id", "agent", "problem_id", *envelope, "task",
        "steps", "in_tokens", "out_tokens", *times,
        only("detection", "accuracy").alias("detection_accuracy"),
        only("localization", "loc_accuracy").alias("localization_accuracy"),
        only("localization", "is_subset").alias("is_subset"),
        only("analysis", "system_level_correct").alias("system_level_correct"),
        only("analysis", "fault_type_correct").alias("fault_type_correct"),
        success.otherwise(F.col("mit_success")).alias("success"),
    ).withColumn("task_time", task_time(*[F.col(c) for c in ("TTD", "TTL", "TTA", "TTM")]))
