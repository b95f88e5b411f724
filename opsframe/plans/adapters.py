"""Test tables in the shape of each telemetry family.

Every adapter is row-local (no grouping), so arrays stay as small as the row they come from. The
``*_SQL`` texts are the same mapping for the SQL counterparts, as CTE bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions.lines import split_lines
from opsframe.functions.problems import catalogue_rows
from opsframe.operators.ordered import number_rows
from opsframe.plans.registry import table

# --- metrics ---------------------------------------------------------------------------------

_POD = """CASE WHEN user_id % 25 = 0 THEN 'loadgenerator-' || cast(user_id AS string)
     WHEN user_id % 25 = 1 THEN 'redis-cart-' || cast(user_id AS string)
     ELSE 'svc' || cast(user_id % 10 AS string) || '-' || cast(user_id AS string) END"""
_METRIC = """CASE event_type WHEN 'view' THEN 'container_cpu_usage_seconds_total'
     WHEN 'click' THEN 'container_network_receive_bytes_total'
     WHEN 'error' THEN 'container_memory_usage_bytes'
     WHEN 'signup' THEN 'container_memory_cache'
     ELSE 'node_load1' END"""
_SAMPLE = f"""
    event_type, user_id % 10 AS shard, {_METRIC} AS metric, {_POD} AS pod,
    'node' || cast(user_id % 3 AS string) AS instance,
    CASE WHEN user_id % 4 = 0 THEN 'other' ELSE 'shop' END AS namespace,
    CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'lo' ELSE 'eth0' END END
      AS interface,
    ts, event_id AS sample_id, value"""
SAMPLES_SQL = f"SELECT {_SAMPLE} FROM events".replace("AS string", "AS VARCHAR")
INVENTORY_SQL = f"SELECT DISTINCT {_POD} AS pod FROM events WHERE value > 180".replace(
    "AS string", "AS VARCHAR"
)


def exprs(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, start, quoted = [], 0, 0, False
    for i, ch in enumerate(text):
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and not quoted:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(*exprs(_SAMPLE))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pods that reported a high value at least once."""
    events = table(spark, sf_dir, "events").filter("value > 180")
    return events.select(F.expr(_POD).alias("pod")).distinct()


# --- logs ------------------------------------------------------------------------------------

_MESSAGE = """CASE event_id % 4
     WHEN 0 THEN '{"severity":"' || event_type || '","message":"m' || cast(user_id AS string) || '"}'
     WHEN 1 THEN '{"level":"' || event_type || '","message":"m' || cast(user_id AS string) || '"}'
     WHEN 2 THEN 'severity high: ' || event_type
     ELSE '{"level":' || cast(user_id AS string) || ',"message":"m"}' END"""
_LOG = f"""
    'log-' || cast(event_id AS string) AS log_id, ts,
    'svc' || cast(user_id % 10 AS string) || '-' || cast(user_id AS string) AS pod_name,
    'c' || cast(user_id % 3 AS string) AS container_name,
    'ns' || cast(user_id % 4 AS string) AS namespace,
    CASE WHEN event_id % 11 <> 0 THEN 'node' || cast(user_id % 5 AS string) END AS node_name,
    {_MESSAGE} AS message, event_id, user_id, event_type"""
LOGS_SQL = f"SELECT {_LOG} FROM events".replace("AS string", "AS VARCHAR")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(*exprs(_LOG))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


LOG_HITS_SQL = f"""
    SELECT *, CASE WHEN event_id % 13 = 0 THEN 'yesterday'
                   ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS date
    FROM ({LOGS_SQL})"""


def log_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested search hits; some lack a node name, some have no usable time."""
    at = F.when(F.expr("event_id % 13 = 0"), "yesterday").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )
    named = lambda c: F.struct(F.col(c).alias("name"))
    return logs(spark, sf_dir).select(
        F.col("log_id").alias("_id"),
        F.struct(
            at.alias("@timestamp"),
            F.col("message"),
            F.struct(
                named("pod_name").alias("pod"),
                named("container_name").alias("container"),
                F.col("namespace"),
                named("node_name").alias("node"),
            ).alias("kubernetes"),
        ).alias("_source"),
    )


LINES_SQL = """
    SELECT CAST(user_id AS VARCHAR) AS stream,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
           CASE WHEN event_id % 9 = 0 THEN 'event=' || event_type
                ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z level=info event=' || event_type END
             AS line
    FROM events"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream per user, numbered in time order hour by hour; some lines have no timestamp."""
    return timed_lines(spark, sf_dir).drop("ts")


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_lines`` with the time of each line."""
    text = F.when(
        F.expr("event_id % 9 = 0"), F.concat(F.lit("event="), "event_type")
    ).otherwise(
        F.concat(
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.lit(" level=info event="),
            "event_type",
        )
    )
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("stream"), "ts", "event_id", text.alias("line")
    )
    numbered = number_rows(
        rows, ["stream"], [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts")
    )
    return numbered.select("stream", "seq", "line", F.col("ts").cast("timestamp").alias("ts"))


# --- documents as texts and as sessions ------------------------------------------------------

LINE_BREAK_SQL = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"

DOCUMENT_PARTS_SQL = f"""
    SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts
    FROM (SELECT doc_id, regexp_split_to_array(text, '{LINE_BREAK_SQL}') AS parts FROM documents)"""
DOCUMENT_LINES_SQL = f"""
    SELECT CAST(doc_id AS VARCHAR) AS stream, CAST(i AS BIGINT) AS seq, parts[i + 1] AS line
    FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM ({DOCUMENT_PARTS_SQL}))"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("stream"),
        F.posexplode(split_lines(F.col("text"))).alias("seq", "line"),
    ).withColumn("seq", F.col("seq").cast("long"))


DOCUMENT_MESSAGES_SQL = f"""
    SELECT stream AS session_id, seq AS turn,
           CASE WHEN seq % 2 = 0 THEN 'assistant' ELSE 'env' END AS role, line AS content
    FROM ({DOCUMENT_LINES_SQL})"""


def document_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one nested session: its lines are messages of alternating roles."""
    turns = F.transform(
        split_lines(F.col("text")),
        lambda line, i: F.struct(
            F.when(i % 2 == 0, "assistant").otherwise("env").alias("role"), line.alias("content")
        ),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("session_id"), turns.alias("trace")
    )


# --- conversations as messages, with actions -------------------------------------------------

MESSAGES_SQL = """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text AS content
    FROM conversations"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id AS string) AS session_id", "turn", "role", "text AS content"
    )


# Text of an assistant turn by (conv_id + turn) % 8.
_ACTIONS = (
    "exec_shell(\"kubectl logs svc' || cast(turn AS string) || ' -n shop\")",
    'submit("Yes")',
    "submit([''svc' || cast(conv_id % 10 AS string) || ''', ''svc1''])",
    'submit({"system_level": "Application", "fault_type": "Misconfiguration"})',
    "submit()",
    "get_logs(''shop'', \"svc' || cast(conv_id % 10 AS string) || '\")",
    None,
    "submit(has_anomaly=''yes'')",
)


def _action_content() -> str:
    cases = []
    for n, call in enumerate(_ACTIONS):
        body = (
            "'I would submit now.'"
            if call is None
            else "'Thought: look.' || chr(10) || '```' || chr(10) || '" + call
            + "' || chr(10) || '```' || chr(10) || 'Then wait.'"
        )
        cases.append(f"WHEN {n} THEN {body}")
    return "CASE (conv_id + turn) % 8 " + " ".join(cases) + " END"


def action_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose assistant turns carry a call (or none), chosen by position."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id AS string) AS session_id", "turn", "role",
        f"CASE WHEN role = 'assistant' THEN {_action_content()} ELSE text END AS content",
    )


CATALOGUE_SQL = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")"
        for row in catalogue_rows()
    )
    + ") AS p(problem_id, fault, task, idx, app, deployment, expected, component, system_level, fault_type)"
)

# --- spans -----------------------------------------------------------------------------------

# Every order is a root span of its own trace; every line item is landed as a copy of part of that
# trace: a child span of the root, and a delivery span below it.
SPANS_SQL = """
    SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, 'root' AS span_id, 'ROOT' AS parent_span,
           'svc' || (o_custkey % 10) AS service_name, 'order' AS operation_name,
           epoch_us(o_orderdate) AS start_time, CAST(floor(o_totalprice) AS BIGINT) AS duration,
           o_orderstatus = 'F' AS has_error,
           CASE WHEN o_orderstatus = 'O' THEN 'Unknown' ELSE o_orderstatus END AS response
    FROM orders
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR), 'line-' || l_linenumber, 'root',
           'svc' || (l_suppkey % 10), 'pick', epoch_us(l_shipdate), CAST(floor(l_quantity) AS BIGINT),
           l_returnflag = 'R', CASE WHEN l_linestatus = 'F' THEN '5xx' ELSE '200' END
    FROM lineitem
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR), 'ship-' || l_linenumber, 'line-' || l_linenumber,
           'svc' || (l_partkey % 10), 'ship', epoch_us(l_shipdate), CAST(floor(l_extendedprice) AS BIGINT),
           false, 'Unknown'
    FROM lineitem"""


def _tag(key: str, value: str) -> str:
    return f"struct('{key}' AS key, parse_json({value}) AS value)"


def raw_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested raw traces. Reference, tag and service look-ups take every documented turn."""
    orders = table(spark, sf_dir, "orders").withColumn("_us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    items = table(spark, sf_dir, "lineitem").withColumn("_us", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    refs = "array(named_struct('refType', '{0}', 'spanID', {1}), named_struct('refType', 'CHILD_OF', 'spanID', {2}))"
    span = (
        "named_struct('spanID', {id}, 'processID', {pid}, 'operationName', '{op}', 'startTime', _us, "
        "'duration', cast({dur} AS bigint), 'references', {refs}, 'tags', {tags})"
    )
    no_refs = "cast(NULL AS array<struct<refType:string,spanID:string>>)"
    root = span.format(
        id="'root'", pid="'p1'", op="order", dur="o_totalprice", refs=no_refs,
        tags="CASE WHEN o_orderstatus = 'O' THEN NULL ELSE array("
        + _tag("error", "CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE '\"true\"' END") + ", "
        + _tag("http.status_code", "concat('\"', o_orderstatus, '\"')") + ") END",
    )
    pick = span.format(
        id="concat('line-', l_linenumber)", pid="'p1'", op="pick", dur="l_quantity",
        refs=refs.format("FOLLOWS_FROM", "'elsewhere'", "'root'"),
        tags="array(" + _tag("error", "CASE WHEN l_returnflag = 'R' THEN '1' ELSE 'false' END") + ", "
        + _tag("http.status_code", "'200'") + ", "
        + _tag("response_class", "CASE WHEN l_linestatus = 'F' THEN '\"5xx\"' ELSE '200' END") + ")",
    )
    ship = span.format(
        id="concat('ship-', l_linenumber)", pid="'p2'", op="ship", dur="l_extendedprice",
        refs=refs.format("CHILD_OF", "concat('line-', l_linenumber)", "'root'"),
        tags="cast(NULL AS array<struct<key:string,value:variant>>)",
    )
    service = "named_struct('serviceName', concat('svc', {0}))"
    heads = orders.selectExpr(
        "cast(o_orderkey AS string) AS traceID", f"array({root}) AS spans",
        f"map('p1', {service.format('o_custkey % 10')}) AS processes",
    )
    parts = items.selectExpr(
        "cast(l_orderkey AS string) AS traceID", f"array({pick}, {ship}) AS spans",
        f"map('p1', {service.format('l_suppkey % 10')}, 'p2', {service.format('l_partkey % 10')}) AS processes",
    )
    return heads.unionByName(parts)


# --- submissions and recovery ----------------------------------------------------------------

# Orders as submissions; the list has 0-3 services, taken from the order itself.
_SUBMISSION = """
    o_orderkey AS session_id, 'agent' || cast(o_custkey % 3 AS string) AS agent,
    CASE o_orderstatus WHEN 'F' THEN 'text' WHEN 'O' THEN 'list' ELSE 'map' END AS sol_kind,
    CASE o_orderkey % 3 WHEN 0 THEN ' yes ' WHEN 1 THEN 'No' ELSE 'svc' || cast(o_orderkey % 10 AS string) END AS raw_text,
    'svc' || cast(o_custkey % 10 AS string) AS component,
    CASE WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS expected,
    CASE WHEN o_custkey % 5 = 0 THEN 'Application' ELSE 'Virtualization' END AS system_level,
    'Misconfiguration' AS fault_type,
    CASE WHEN o_orderkey % 2 = 0 THEN ' application' ELSE 'virtualization' END AS raw_level,
    CASE WHEN o_orderkey % 3 = 0 THEN 'misconfiguration ' ELSE 'Code Defect' END AS raw_fault,
    o_orderkey, o_custkey, o_totalprice, o_orderdate"""
SUBMISSIONS_SQL = f"""
    SELECT *, CASE WHEN sol_kind = 'text' THEN raw_text END AS sol_text,
           CASE WHEN sol_kind = 'list' THEN
             list_transform(range(o_orderkey % 4), lambda i: 'svc' || CAST((o_custkey + i * o_orderkey) % 10 AS VARCHAR))
           END AS sol_list
    FROM (SELECT {_SUBMISSION} FROM orders)""".replace("AS string", "AS VARCHAR")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(*exprs(_SUBMISSION))
    listed = (
        "CASE WHEN sol_kind = 'list' THEN CASE WHEN o_orderkey % 4 = 0 THEN cast(array() AS array<string>) ELSE "
        "transform(sequence(0, cast(o_orderkey % 4 - 1 AS int)), "
        "i -> concat('svc', (o_custkey + i * o_orderkey) % 10)) END END"
    )
    return (
        rows.withColumn("sol_text", F.expr("CASE WHEN sol_kind = 'text' THEN raw_text END"))
        .withColumn("sol_list", F.expr(listed))
        .withColumn(
            "sol_map",
            F.expr("CASE WHEN sol_kind = 'map' THEN map('system_level', raw_level, 'fault_type', raw_fault) END"),
        )
    )


_STATUS = """
    'ns' || cast(l_partkey AS string) AS namespace, 'svc' || cast(l_suppkey % 10 AS string) || '-pod' || cast(l_suppkey AS string) AS pod,
    'c' || cast(l_linenumber AS string) AS container,
    l_orderkey % 307 NOT IN (3, 4, 5) AS ready,
    CASE l_orderkey % 307 WHEN 0 THEN 'CrashLoopBackOff' WHEN 1 THEN 'ErrImagePull'
         WHEN 5 THEN 'ContainerCreating' END AS waiting_reason,
    CASE l_orderkey % 307 WHEN 2 THEN 'Error' WHEN 3 THEN 'Completed' WHEN 6 THEN 'Completed' END AS terminated_reason,
    l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"""
STATUSES_SQL = f"SELECT {_STATUS} FROM lineitem".replace("AS string", "AS VARCHAR")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*exprs(_STATUS))


# --- scored sessions -------------------------------------------------------------------------

PROBLEM_IDS = [row[0] for row in catalogue_rows()]
_TICKS = "'```' || chr(10)"
_CLOSE = "chr(10) || '```'"
_LOOK = f"'Look first.' || chr(10) || {_TICKS} || 'exec_shell(\"kubectl get pods\")' || {_CLOSE}"
_ARGUMENT = """CASE o_orderkey % 5 WHEN 0 THEN '"Yes"' WHEN 1 THEN '"no "'
     WHEN 2 THEN '["user-service", "geo"]'
     WHEN 3 THEN '{"system_level": " virtualization", "fault_type": "Misconfiguration"}' ELSE '' END"""
_DONE = f"'Done.' || chr(10) || {_TICKS} || 'submit(' || {_ARGUMENT} || ')' || {_CLOSE}"
_ENVELOPE = """
    cast(o_orderkey AS string) AS session_id, 'agent' || cast(o_custkey % 3 AS string) AS agent,
    'org/model-' || cast(o_custkey % 4 AS string) AS model, o_orderkey, o_custkey,
    o_totalprice / 1000 AS spent"""


_IDS = ", ".join(f"'{p}'" for p in PROBLEM_IDS)

# Problem id by order key, from a list by position; positions past the list give an unknown id.
SESSIONS_SQL = f"""
    SELECT *, epoch(o_orderdate) AS start_time, epoch(o_orderdate) + spent AS end_time
    FROM (SELECT {_ENVELOPE}, coalesce(([{_IDS}])[(o_orderkey // 5) % 97 + 1], 'unknown-' || cast((o_orderkey // 5) % 97 AS string)) AS problem_id, o_orderdate,
                 {_LOOK} AS look, {_DONE} AS done FROM orders)""".replace("AS string", "AS VARCHAR")


# The same sessions as attempts of which no one takes up every seventh problem.
ATTEMPTS_SQL = f"""
    SELECT {_ENVELOPE}, coalesce(([{_IDS}])[no - CAST(no % 7 = 3 AS INTEGER) + 1], 'unknown') AS problem_id
    FROM (SELECT *, (o_orderkey // 5) % 97 AS no FROM orders)""".replace("AS string", "AS VARCHAR")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without their transcripts; every seventh problem has none."""
    rows = table(spark, sf_dir, "orders").withColumn("no", F.expr("cast((o_orderkey div 5) % 97 AS int)"))
    picked = f"coalesce(get(array({_IDS}), no - cast(no % 7 = 3 AS int)), 'unknown') AS problem_id"
    return rows.selectExpr(*exprs(_ENVELOPE), picked)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested sessions: user, assistant, env, submitting assistant, env."""
    say = "named_struct('role', '{0}', 'content', {1})"
    trace = ", ".join((
        say.format("user", "'Begin'"), say.format("assistant", _LOOK), say.format("env", "'ok'"),
        say.format("assistant", _DONE), say.format("env", "'VALID'"),
    ))
    began = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    no = "cast((o_orderkey div 5) % 97 AS int)"
    picked = f"coalesce(get(array({_IDS}), {no}), 'unknown-' || cast({no} AS string))"
    rows = table(spark, sf_dir, "orders").withColumn("start_time", began)
    return rows.selectExpr(
        *exprs(_ENVELOPE), f"{picked} AS problem_id", f"array({trace}) AS trace", "start_time"
    ).withColumn("end_time", F.col("start_time") + F.col("spent"))


# --- GPU-cluster trace -----------------------------------------------------------------------

GPU_SQL = {
    "job": """SELECT 'job' || o_orderkey AS job_name, 'inst' || (o_orderkey % 5000) AS inst_id,
        'user' || (o_custkey % 100) AS "user",
        CASE o_orderstatus WHEN 'F' THEN 'Terminated' WHEN 'O' THEN 'Running' ELSE 'Failed' END AS status,
        CAST(epoch(o_orderdate) AS DOUBLE) AS start_time, CAST(epoch(o_orderdate) + 3600 AS DOUBLE) AS end_time
        FROM orders""",
    "task": """SELECT 'job' || l_orderkey AS job_name,
        CASE WHEN l_linenumber = 1 THEN 'ps' ELSE 'worker' || l_linenumber END AS task_name,
        CAST(min(l_quantity) AS INTEGER) AS inst_num, CAST(epoch(min(l_shipdate)) AS DOUBLE) AS start_time,
        CAST(min(l_quantity) * 100 AS DOUBLE) AS plan_cpu, CAST(max(l_quantity) AS DOUBLE) AS plan_mem,
        CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE 50 * l_linenumber END AS DOUBLE) AS plan_gpu,
        CASE WHEN l_linenumber % 2 = 0 THEN 'T4' ELSE 'V100' END AS gpu_type
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "instance": """SELECT 'job' || l_orderkey AS job_name,
        CASE WHEN l_linenumber = 1 THEN 'ps' ELSE 'worker' || l_linenumber END AS task_name,
        'i' || l_partkey || '-' || l_suppkey AS inst_name,
        'w' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS worker_name,
        'm' || l_suppkey AS machine FROM lineitem""",
    "sensor": """SELECT 'job' || l_orderkey AS job_name,
        CASE WHEN l_linenumber = 1 THEN 'ps' ELSE 'worker' || l_linenumber END AS task_name,
        'w' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS worker_name,
        l_quantity * 80 AS cpu_usage, l_discount * 1000 AS gpu_wrk_util, l_quantity / 2 AS avg_mem,
        l_quantity AS max_mem, l_tax * 100 AS avg_gpu_wrk_mem FROM lineitem""",
    "machine_spec": """SELECT 'm' || s_suppkey AS machine, CAST(96 AS DOUBLE) AS cap_cpu,
        CAST(512 AS DOUBLE) AS cap_mem, CAST(s_nationkey % 8 AS DOUBLE) AS cap_gpu FROM supplier""",
    "machine_metric": """SELECT 'w' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS worker_name,
        'm' || l_suppkey AS machine, l_quantity AS machine_cpu, l_discount AS machine_gpu,
        l_tax AS machine_load_1, CAST(l_linenumber AS DOUBLE) AS machine_num_worker FROM lineitem""",
    "group_tag": """SELECT 'inst' || p_partkey AS inst_id, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'T4' END AS gpu_type_spec,
        p_brand AS "group", CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN '' ELSE lower(p_type) END AS workload
        FROM part""",
}


def gpu(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the cluster trace. Test tables stand in: job = order, instance = line item."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
    s = lambda text: F.expr(text)
    role = s("CASE WHEN l_linenumber = 1 THEN 'ps' ELSE concat('worker', l_linenumber) END").alias("task_name")
    job = s("concat('job', l_orderkey)").alias("job_name")
    worker = s("concat('w', l_orderkey, '-', l_linenumber, '-', l_partkey)").alias("worker_name")
    machine = s("concat('m', l_suppkey)").alias("machine")
    if name == "job":
        return table(spark, sf_dir, "orders").select(
            s("concat('job', o_orderkey)").alias("job_name"),
            s("concat('inst', o_orderkey % 5000)").alias("inst_id"),
            s("concat('user', o_custkey % 100)").alias("user"),
            s("CASE o_orderstatus WHEN 'F' THEN 'Terminated' WHEN 'O' THEN 'Running' ELSE 'Failed' END").alias("status"),
            seconds("o_orderdate").alias("start_time"),
            (seconds("o_orderdate") + 3600).alias("end_time"),
        )
    items = table(spark, sf_dir, "lineitem")
    if name == "task":
        grouped = items.groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"), F.min("l_shipdate").alias("d0")
        )
        return grouped.select(
            job, role, F.col("q0").cast("int").alias("inst_num"), seconds("d0").alias("start_time"),
            (F.col("q0") * 100).alias("plan_cpu"), F.col("q1").alias("plan_mem"),
            s("cast(CASE WHEN l_linenumber = 1 THEN 0 ELSE 50 * l_linenumber END AS double)").alias("plan_gpu"),
            s("CASE WHEN l_linenumber % 2 = 0 THEN 'T4' ELSE 'V100' END").alias("gpu_type"),
        )
    if name == "instance":
        return items.select(job, role, s("concat('i', l_partkey, '-', l_suppkey)").alias("inst_name"), worker, machine)
    if name == "sensor":
        return items.select(
            job, role, worker, s("l_quantity * 80").alias("cpu_usage"),
            s("l_discount * 1000").alias("gpu_wrk_util"), s("l_quantity / 2").alias("avg_mem"),
            s("l_quantity").alias("max_mem"), s("l_tax * 100").alias("avg_gpu_wrk_mem"),
        )
    if name == "machine_metric":
        return items.select(
            worker, machine, s("l_quantity").alias("machine_cpu"), s("l_discount").alias("machine_gpu"),
            s("l_tax").alias("machine_load_1"), s("cast(l_linenumber AS double)").alias("machine_num_worker"),
        )
    if name == "machine_spec":
        return table(spark, sf_dir, "supplier").select(
            s("concat('m', s_suppkey)").alias("machine"), F.lit(96.0).alias("cap_cpu"),
            F.lit(512.0).alias("cap_mem"), s("cast(s_nationkey % 8 AS double)").alias("cap_gpu"),
        )
    if name == "group_tag":
        return table(spark, sf_dir, "part").select(
            s("concat('inst', p_partkey)").alias("inst_id"),
            s("CASE WHEN p_size % 3 = 0 THEN '' ELSE 'T4' END").alias("gpu_type_spec"),
            F.col("p_brand").alias("group"),
            s("CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN '' ELSE lower(p_type) END").alias("workload"),
        )
    raise ValueError(f"no such trace table: {name}")
