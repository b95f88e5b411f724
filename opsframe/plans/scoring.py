"""Scoring queries: match rules, per-task scorers, recovery checks, whole-session evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import match as fm
from opsframe.functions.problems import problem_catalogue
from opsframe.operators import health as oh, scoring as osc, sessions as os_
from opsframe.plans.adapters import (
    CATALOGUE_SQL,
    SESSIONS_SQL,
    STATUSES_SQL,
    SUBMISSIONS_SQL,
    sessions,
    statuses,
    submissions,
)
from opsframe.plans.registry import query, table


@query("match_exact", "C1", f"""
    SELECT session_id, coalesce(sol_list = [component], false) AS list_match,
           coalesce([sol_text] = [component], false) AS text_match
    FROM ({SUBMISSIONS_SQL})""")
def match_exact(spark, sf):
    truth = F.array("component")
    return submissions(spark, sf).select(
        "session_id",
        fm.exact_match(F.col("sol_list"), truth).alias("list_match"),
        fm.exact_match(F.array("sol_text"), truth).alias("text_match"),
    )


@query("match_ignoring_case", "C2", f"""
    SELECT session_id, lower(trim(raw_level)) = lower(system_level) AS same FROM ({SUBMISSIONS_SQL})""")
def match_ignoring_case(spark, sf):
    same = fm.exact_match_ci(F.col("raw_level"), F.col("system_level"))
    return submissions(spark, sf).select("session_id", same.alias("same"))


@query("match_in_range", "C3", """
    SELECT o_orderkey, o_totalprice >= 250000 - 50000 AND o_totalprice <= 250000 + 50000 AS inside FROM orders""")
def match_in_range(spark, sf):
    inside = fm.in_range(F.col("o_totalprice"), F.lit(250000), F.lit(50000))
    return table(spark, sf, "orders").select("o_orderkey", inside.alias("inside"))


_TRUTHS = "['svc' || CAST(o_custkey % 10 AS VARCHAR), 'svc' || CAST((o_custkey + o_orderkey) % 10 AS VARCHAR)]"


@query("match_sets", "C4", f"""
    SELECT session_id, list_has_all({_TRUTHS}, sol_list) AS is_subset, list_has_all(sol_list, {_TRUTHS}) AS is_superset
    FROM ({SUBMISSIONS_SQL}) WHERE sol_list IS NOT NULL""")
def match_sets(spark, sf):
    truths = F.expr("array(concat('svc', o_custkey % 10), concat('svc', (o_custkey + o_orderkey) % 10))")
    listed = submissions(spark, sf).filter(F.col("sol_list").isNotNull())
    return listed.select(
        "session_id",
        fm.is_subset(F.col("sol_list"), truths).alias("is_subset"),
        fm.is_superset(F.col("sol_list"), truths).alias("is_superset"),
    )


_DETECTION_SQL = f"""SELECT *, CASE WHEN sol_text IS NULL THEN 'Invalid Format'
    WHEN lower(trim(sol_text)) = lower(expected) THEN 'Correct' ELSE 'Incorrect' END AS accuracy
    FROM ({SUBMISSIONS_SQL})"""


@query("score_detection", "C5", f"SELECT session_id, accuracy FROM ({_DETECTION_SQL})")
def score_detection(spark, sf):
    return osc.score_detection(submissions(spark, sf)).select("session_id", "accuracy")


@query("detection_confusion", "A14", f"""
    SELECT agent, count(*) FILTER (WHERE accuracy = 'Correct' AND expected = 'Yes') AS tp,
        count(*) FILTER (WHERE accuracy = 'Incorrect' AND expected = 'No') AS fp,
        count(*) FILTER (WHERE accuracy = 'Correct' AND expected = 'No') AS tn,
        count(*) FILTER (WHERE accuracy = 'Incorrect' AND expected = 'Yes') AS fn,
        count(*) FILTER (WHERE accuracy = 'Invalid Format') AS invalid
    FROM ({_DETECTION_SQL}) GROUP BY agent""")
def detection_confusion(spark, sf):
    return os_.detection_confusion(osc.score_detection(submissions(spark, sf)))


@query("score_localization", "C6", f"""
    SELECT session_id, round(CASE WHEN exact THEN 100 WHEN inside THEN 100.0 / n ELSE 0 END, 6) AS loc_accuracy,
           exact OR (inside AND n = 1) AS success, inside AS is_subset
    FROM (SELECT session_id,
                 CASE sol_kind WHEN 'text' THEN sol_text = component WHEN 'list' THEN sol_list = [component] ELSE false END AS exact,
                 CASE sol_kind WHEN 'list' THEN list_contains(sol_list, component) ELSE false END AS inside,
                 CASE sol_kind WHEN 'list' THEN len(sol_list) ELSE 2 END AS n
          FROM ({SUBMISSIONS_SQL}))""")
def score_localization(spark, sf):
    scored = osc.score_localization(submissions(spark, sf))
    return scored.select("session_id", F.round("loc_accuracy", 6).alias("loc_accuracy"), "success", "is_subset")


@query("score_analysis", "C7", f"""
    SELECT session_id, a AS system_level_correct, b AS fault_type_correct, a AND b AS success
    FROM (SELECT session_id, sol_kind = 'map' AND lower(trim(raw_level)) = lower(system_level) AS a,
                 sol_kind = 'map' AND lower(trim(raw_fault)) = lower(fault_type) AS b FROM ({SUBMISSIONS_SQL}))""")
def score_analysis(spark, sf):
    scored = osc.score_analysis(submissions(spark, sf))
    return scored.select("session_id", "system_level_correct", "fault_type_correct", "success")


@query("score_truth_join", "J3", f"""
    SELECT s.session_id, s.problem_id, p.task, p.expected, p.component, p.system_level, p.fault_type
    FROM ({SESSIONS_SQL}) s JOIN ({CATALOGUE_SQL}) p USING (problem_id)""")
def score_truth_join(spark, sf):
    known = osc.score_join(sessions(spark, sf), problem_catalogue(spark))
    return known.select(
        "session_id", "problem_id", "task", "expected", "component", "system_level", "fault_type"
    )


@query("score_unknown_problems", "J3", f"""
    SELECT session_id, problem_id FROM ({SESSIONS_SQL}) WHERE starts_with(problem_id, 'unknown-')""")
def score_unknown_problems(spark, sf):
    return osc.unknown_problems(sessions(spark, sf), problem_catalogue(spark)).select(
        "session_id", "problem_id"
    )


_EVALUATE_SQL = f"""
    SELECT s.session_id, s.agent, s.problem_id, p.task, CAST(2 AS BIGINT) AS steps,
        CAST(ceil((5 + 2 + 5) / 4.0) AS BIGINT) AS in_tokens,
        CAST(ceil((len(look) + len(done)) / 4.0) AS BIGINT) AS out_tokens,
        round(end_time - start_time, 6) AS task_time,
        CASE WHEN p.task = 'detection' THEN CASE o_orderkey % 5
             WHEN 0 THEN CASE WHEN expected = 'Yes' THEN 'Correct' ELSE 'Incorrect' END
             WHEN 1 THEN CASE WHEN expected = 'No' THEN 'Correct' ELSE 'Incorrect' END
             ELSE 'Invalid Format' END END AS detection_accuracy,
        CASE WHEN p.task = 'localization' THEN CASE WHEN o_orderkey % 5 = 2 AND component IN ('user-service', 'geo')
             THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END END AS localization_accuracy,
        CASE WHEN p.task = 'localization' THEN o_orderkey % 5 = 2 AND component IN ('user-service', 'geo') END AS is_subset,
        CASE WHEN p.task = 'analysis' THEN o_orderkey % 5 = 3 AND system_level = 'Virtualization' END AS system_level_correct,
        CASE WHEN p.task = 'analysis' THEN o_orderkey % 5 = 3 AND fault_type = 'Misconfiguration' END AS fault_type_correct,
        CASE p.task WHEN 'detection' THEN (o_orderkey % 5 = 0 AND expected = 'Yes') OR (o_orderkey % 5 = 1 AND expected = 'No')
             WHEN 'localization' THEN false
             WHEN 'analysis' THEN o_orderkey % 5 = 3 AND system_level = 'Virtualization' AND fault_type = 'Misconfiguration'
             END AS success
    FROM ({SESSIONS_SQL}) s JOIN ({CATALOGUE_SQL}) p USING (problem_id)"""


def _evaluated(spark, sf):
    return osc.evaluate(sessions(spark, sf), problem_catalogue(spark))


@query("session_evaluate", "C9 N8 N9 J3 C5 C6 C7 A2 A3 A4", _EVALUATE_SQL)
def session_evaluate(spark, sf):
    return _evaluated(spark, sf).drop("TTD", "TTL", "TTA", "TTM").withColumn(
        "task_time", F.round("task_time", 6)
    )


def _answers_in_words(df):
    """A rule of one's own for mitigation: any answer given as text."""
    return df.withColumn("success", F.coalesce(F.col("sol_kind") == "text", F.lit(False)))


@query("session_evaluate_custom", "C9", f"""
    SELECT session_id, task, CASE WHEN task = 'mitigation' THEN CAST(session_id AS BIGINT) % 5 IN (0, 1) ELSE success END AS success
    FROM ({_EVALUATE_SQL})""")
def session_evaluate_custom(spark, sf):
    scored = osc.evaluate(sessions(spark, sf), problem_catalogue(spark), scorers={"mitigation": _answers_in_words})
    return scored.select("session_id", "task", "success")


@query("session_scorecard", "A13", f"""
    SELECT agent, task, count(*) AS sessions, count(*) FILTER (WHERE success) AS successes,
           round(avg(steps), 6) AS avg_steps FROM ({_EVALUATE_SQL}) GROUP BY ROLLUP (agent, task)""")
def session_scorecard(spark, sf):
    return os_.scorecard(_evaluated(spark, sf)).withColumn("avg_steps", F.round("avg_steps", 6))


@query("session_table", "A13", f"""
    SELECT s.session_id, s.agent, s.problem_id, round(s.end_time - s.start_time, 6) AS spent,
           e.task, e.steps, e.success FROM ({SESSIONS_SQL}) s LEFT JOIN ({_EVALUATE_SQL}) e USING (session_id)""")
def session_table(spark, sf):
    results = _evaluated(spark, sf).select("session_id", "task", "steps", "success")
    flat = os_.session_table(sessions(spark, sf), results)
    spent = F.round(F.col("end_time") - F.col("start_time"), 6).alias("spent")
    return flat.select("session_id", "agent", "problem_id", spent, "task", "steps", "success")


# --- recovery --------------------------------------------------------------------------------

_OK = """CASE WHEN coalesce(waiting_reason, '') = 'CrashLoopBackOff' THEN false
     WHEN coalesce(terminated_reason, 'Completed') <> 'Completed' THEN false ELSE ready END"""
_OK_LENIENT = """CASE WHEN waiting_reason IS NOT NULL
     THEN waiting_reason NOT IN ('CrashLoopBackOff', 'Error', 'ImagePullBackOff', 'ErrImagePull')
     WHEN coalesce(terminated_reason, 'Completed') <> 'Completed' THEN false ELSE ready END"""
_SPACES_SQL = "SELECT 'ns' || CAST(p_partkey AS VARCHAR) AS namespace FROM part"
_HEALTH_SQL = f"""
    SELECT namespace, coalesce(healthy, true) AS healthy, coalesce(healthy_lenient, true) AS healthy_lenient
    FROM ({_SPACES_SQL}) LEFT JOIN (
      SELECT namespace, bool_and({_OK}) AS healthy, bool_and({_OK_LENIENT}) AS healthy_lenient
      FROM ({STATUSES_SQL}) GROUP BY namespace) USING (namespace)"""


def _spaces(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("ns"), F.col("p_partkey").cast("string")).alias("namespace"))


@query("namespace_health", "A6", _HEALTH_SQL)
def namespace_health(spark, sf):
    return oh.namespace_health(statuses(spark, sf), _spaces(spark, sf))


# Rows of a high quantity are pods that are listed but have reported no status.
_REPORTED = "l_quantity < 45"
_READY_SQL = f"""
    SELECT namespace, coalesce(all_ready, false) AS all_ready FROM ({_SPACES_SQL}) LEFT JOIN (
      SELECT namespace, bool_and(pod_ready) AS all_ready FROM (
        SELECT namespace, pod, coalesce(bool_and(ready) FILTER (WHERE {_REPORTED}), false) AS pod_ready
        FROM ({STATUSES_SQL}) GROUP BY namespace, pod) GROUP BY namespace) USING (namespace)"""


def _readiness(spark, sf):
    rows = statuses(spark, sf)
    return oh.readiness(rows.filter(_REPORTED), rows, _spaces(spark, sf))


@query("namespace_readiness", "A7", _READY_SQL)
def namespace_readiness(spark, sf):
    return _readiness(spark, sf)


@query("pods_of_services", "C8", f"""
    WITH pods AS (SELECT DISTINCT namespace, pod FROM ({STATUSES_SQL})),
    names AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'svc' || p_partkey % 500 WHEN 1 THEN 'c' || p_partkey % 90 || '-' ELSE '' || p_partkey % 50 END AS service FROM part)
    SELECT DISTINCT namespace, service, true AS pod_exists FROM pods, names WHERE contains(pod, service)""")
def pods_of_services(spark, sf):
    names = table(spark, sf, "part").selectExpr(
        "CASE p_partkey % 3 WHEN 0 THEN 'svc' || p_partkey % 500 WHEN 1 THEN 'c' || p_partkey % 90 || '-' ELSE '' || p_partkey % 50 END AS service"
    )
    return oh.services_named_in(statuses(spark, sf), names)


_FAULTS = (
    "k8s_target_port-misconfig", "scale_pod_zero_social_net", "assign_to_non_existent_node_social_net",
    "wrong_bin_usage", "misconfig_app_hotel_res", "auth_miss_mongodb",
)
_FAULT_LIST = ", ".join(f"'{f}'" for f in _FAULTS)
_CASE = "'ns' || cast(o_orderkey % 2500 AS {0}) AS namespace, 'svc' || cast(o_custkey % 10 AS {0}) AS service"


@query("score_mitigation", "C8 A6 A7", f"""
    WITH c AS (SELECT o_orderkey AS case_id, {_CASE.format("VARCHAR")}, ([{_FAULT_LIST}])[o_orderkey % 6 + 1] AS fault FROM orders),
    st AS ({STATUSES_SQL}), h AS ({_HEALTH_SQL}), r AS ({_READY_SQL}),
    dep AS (SELECT namespace, 'svc' || (l_suppkey % 10) AS service,
                   arg_min(CASE WHEN l_quantity < 40 THEN 9090 ELSE 9999 END, (l_linenumber, l_orderkey, l_suppkey, l_quantity)) AS port,
                   bool_and(l_linenumber < 7) AS replicas, bool_and(l_quantity > 3) AS command
            FROM st GROUP BY ALL)
    SELECT case_id, namespace, fault, service,
        CASE fault WHEN '{_FAULTS[0]}' THEN 'port' WHEN '{_FAULTS[1]}' THEN 'replicas' WHEN '{_FAULTS[2]}' THEN 'pod_exists'
             WHEN '{_FAULTS[3]}' THEN 'command' WHEN '{_FAULTS[4]}' THEN 'readiness' ELSE 'health' END AS rule,
        CASE fault WHEN '{_FAULTS[0]}' THEN coalesce(port = 9090, false) AND coalesce(healthy, true)
             WHEN '{_FAULTS[1]}' THEN coalesce(replicas, false) AND coalesce(healthy, true)
             WHEN '{_FAULTS[2]}' THEN EXISTS (SELECT 1 FROM st WHERE st.namespace = c.namespace AND contains(st.pod, c.service)) AND coalesce(healthy, true)
             WHEN '{_FAULTS[3]}' THEN coalesce(command, false) AND coalesce(healthy_lenient, true)
             WHEN '{_FAULTS[4]}' THEN coalesce(all_ready, false) ELSE coalesce(healthy, true) END AS success
    FROM c LEFT JOIN h USING (namespace) LEFT JOIN r USING (namespace) LEFT JOIN dep USING (namespace, service)""")
def score_mitigation(spark, sf):
    rows = statuses(spark, sf)
    service = F.concat(F.lit("svc"), F.col("l_suppkey") % 10)
    placed = rows.withColumn("service", service).withColumn("deployment", service)
    cases = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS case_id", *_CASE.format("string").split(", "),
        f"array({_FAULT_LIST})[cast(o_orderkey % 6 AS int)] AS fault",
    )
    return oh.score_mitigation(
        cases,
        oh.namespace_health(rows, _spaces(spark, sf)),
        _readiness(spark, sf),
        oh.ports_ok(
            placed.withColumn("target_port", F.expr("CASE WHEN l_quantity < 40 THEN 9090 ELSE 9999 END"))
            .withColumn("position", F.struct("l_linenumber", "l_orderkey", "l_suppkey", "l_quantity"))
        ),
        oh.replicas_ok(
            placed.withColumn("desired", F.lit(1)).withColumn("available", F.expr("if(l_linenumber < 7, 1, 0)"))
        ),
        oh.services_with_pod(rows, [f"svc{i}" for i in range(10)]),
        oh.commands_ok(
            placed.withColumn("command", F.expr("array('run', if(l_quantity > 3, 'profile', 'geo'))"))
        ),
    )
