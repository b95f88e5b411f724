"""Declared schemas of every landed input and every produced table (DDL strings)."""

METRIC_DUMP = "metric MAP<STRING, STRING>, values ARRAY<ARRAY<STRING>>"
KPI_TABLE = "timestamp LONG, cmdb_id STRING, kpi_name STRING, value DOUBLE"

RAW_TRACE = """
    traceID STRING,
    spans ARRAY<STRUCT<
        spanID: STRING, processID: STRING, operationName: STRING,
        startTime: LONG, duration: LONG,
        references: ARRAY<STRUCT<refType: STRING, spanID: STRING>>,
        tags: ARRAY<STRUCT<key: STRING, value: VARIANT>>>>,
    processes MAP<STRING, STRUCT<serviceName: STRING>>
"""
TRACE_RESPONSE = """
    data ARRAY<STRUCT<
        traceID: STRING,
        spans: ARRAY<STRUCT<
            spanID: STRING, processID: STRING, operationName: STRING,
            startTime: LONG, duration: LONG,
            references: ARRAY<STRUCT<refType: STRING, spanID: STRING>>,
            tags: ARRAY<STRUCT<key: STRING, value: VARIANT>>>>,
        processes: MAP<STRING, STRUCT<serviceName: STRING>>>>
"""
SPAN_TABLE = """
    trace_id STRING, span_id STRING, parent_span STRING, service_name STRING,
    operation_name STRING, start_time LONG, duration LONG, has_error BOOLEAN, response STRING
"""

LOG_HIT = """
    _id STRING,
    _source STRUCT<
        `@timestamp`: STRING, message: STRING,
        kubernetes: STRUCT<pod: STRUCT<name: STRING>, container: STRUCT<name: STRING>,
                           namespace: STRING, node: STRUCT<name: STRING>>>
"""
LOG_HIT_FIELDS = """
    _id: STRING,
    _source: STRUCT<
        `@timestamp`: STRING, message: STRING,
        kubernetes: STRUCT<pod: STRUCT<name: STRING>, container: STRUCT<name: STRING>,
                           namespace: STRING, node: STRUCT<name: STRING>>>
"""
LOG_TABLE = """
    log_id STRING, timestamp DOUBLE, date STRING, pod_name STRING, container_name STRING,
    namespace STRING, node_name STRING, message STRING
"""
LOG_LINE = "stream STRING, seq LONG, line STRING"

MESSAGE = "role STRING, content STRING"
SESSION = """
    agent STRING, session_id STRING, problem_id STRING, start_time DOUBLE, end_time DOUBLE,
    trace ARRAY<STRUCT<role: STRING, content: STRING>>, results VARIANT
"""

CONTAINER_STATUS = """
    namespace STRING, pod STRING, container STRING, ready BOOLEAN,
    waiting_reason STRING, terminated_reason STRING
"""

GPU_TRACE = {
    "job": "job_name STRING, inst_id STRING, user STRING, status STRING, start_time DOUBLE, end_time DOUBLE",
    "task": (
        "job_name STRING, task_name STRING, inst_num INT, status STRING, start_time DOUBLE, "
        "end_time DOUBLE, plan_cpu DOUBLE, plan_mem DOUBLE, plan_gpu DOUBLE, gpu_type STRING"
    ),
    "instance": (
        "job_name STRING, task_name STRING, inst_name STRING, worker_name STRING, status STRING, "
        "start_time DOUBLE, end_time DOUBLE, machine STRING"
    ),
    "sensor": (
        "job_name STRING, task_name STRING, worker_name STRING, inst_id STRING, machine STRING, "
        "gpu_name STRING, cpu_usage DOUBLE, gpu_wrk_util DOUBLE, avg_mem DOUBLE, max_mem DOUBLE, "
        "avg_gpu_wrk_mem DOUBLE, max_gpu_wrk_mem DOUBLE, read DOUBLE, write DOUBLE, "
        "read_count DOUBLE, write_count DOUBLE"
    ),
    "machine_spec": "machine STRING, gpu_type STRING, cap_cpu DOUBLE, cap_mem DOUBLE, cap_gpu DOUBLE",
    "machine_metric": (
        "worker_name STRING, machine STRING, start_time DOUBLE, end_time DOUBLE, "
        "machine_cpu_iowait DOUBLE, machine_cpu_kernel DOUBLE, machine_cpu_usr DOUBLE, "
        "machine_gpu DOUBLE, machine_load_1 DOUBLE, machine_net_receive DOUBLE, "
        "machine_num_worker DOUBLE, machine_cpu DOUBLE"
    ),
    "group_tag": "inst_id STRING, user STRING, gpu_type_spec STRING, `group` STRING, workload STRING",
}
