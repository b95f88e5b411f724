"""GPU-cluster trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.operators import cluster as oc
from opsframe.operators.joins import pod_services as resolve
from opsframe.plans.adapters import GPU_SQL, exprs, gpu
from opsframe.plans.registry import query, table

_JOB_DETAILS_SQL = f"""
    SELECT j.job_name, j."user", j.status AS job_status, t.task_name, t.plan_cpu, t.plan_gpu, t.gpu_type,
           i.inst_name, i.machine
    FROM ({GPU_SQL['job']}) j JOIN ({GPU_SQL['task']}) t ON j.job_name = t.job_name
    JOIN ({GPU_SQL['instance']}) i ON t.job_name = i.job_name AND t.task_name = i.task_name
    WHERE j.status = 'Terminated'"""


def _job_details(spark, sf):
    return oc.job_details(*[gpu(spark, sf, name) for name in ("job", "task", "instance")])


@query("gpu_job_details", "J6", _JOB_DETAILS_SQL)
def gpu_job_details(spark, sf):
    return _job_details(spark, sf)


@query("gpu_job_details_top", "O3 J6", f"""{_JOB_DETAILS_SQL}
    ORDER BY plan_cpu DESC, j.job_name, t.task_name, inst_name, machine LIMIT 100""")
def gpu_job_details_top(spark, sf):
    ordered = _job_details(spark, sf).orderBy(
        F.desc("plan_cpu"), "job_name", "task_name", "inst_name", "machine"
    )
    return ordered.limit(100)


@query("gpu_usage_capacity", "J7", f"""
    SELECT s.worker_name, s.cpu_usage, round(s.gpu_wrk_util, 6) AS gpu_wrk_util, s.avg_mem, s.max_mem,
           round(s.avg_gpu_wrk_mem, 6) AS avg_gpu_wrk_mem, m.cap_cpu, m.cap_mem, m.cap_gpu
    FROM ({GPU_SQL['sensor']}) s JOIN ({GPU_SQL['instance']}) i ON s.worker_name = i.worker_name
    JOIN ({GPU_SQL['machine_spec']}) m ON i.machine = m.machine""")
def gpu_usage_capacity(spark, sf):
    out = oc.usage_beside_capacity(*[gpu(spark, sf, n) for n in ("sensor", "instance", "machine_spec")])
    return out.withColumn("gpu_wrk_util", F.round("gpu_wrk_util", 6)).withColumn(
        "avg_gpu_wrk_mem", F.round("avg_gpu_wrk_mem", 6)
    )


@query("gpu_machine_load", "J8", f"""
    SELECT i.job_name, i.task_name, i.inst_name, i.worker_name, i.machine, m.machine_cpu, m.machine_gpu,
           m.machine_load_1, m.machine_num_worker
    FROM ({GPU_SQL['instance']}) i JOIN ({GPU_SQL['machine_metric']}) m USING (worker_name, machine)""")
def gpu_machine_load(spark, sf):
    return oc.instance_machine_load(gpu(spark, sf, "instance"), gpu(spark, sf, "machine_metric"))


@query("gpu_job_tags", "J8", f"""
    SELECT j.job_name, inst_id, j."user", j.status, g.gpu_type_spec, g."group", g.workload
    FROM ({GPU_SQL['job']}) j JOIN ({GPU_SQL['group_tag']}) g USING (inst_id)""")
def gpu_job_tags(spark, sf):
    return oc.job_tags(gpu(spark, sf, "job"), gpu(spark, sf, "group_tag"))


@query("gpu_plan_vs_actual", "J9", f"""
    WITH u AS (SELECT job_name, task_name, avg(cpu_usage) AS cpu_usage, avg(avg_mem) AS avg_mem, max(max_mem) AS max_mem,
                      avg(gpu_wrk_util) AS gpu_wrk_util FROM ({GPU_SQL['sensor']}) GROUP BY ALL)
    SELECT job_name, task_name, plan_cpu, plan_mem, plan_gpu, round(cpu_usage, 6) AS cpu_usage,
           round(avg_mem, 6) AS avg_mem, max_mem, round(gpu_wrk_util, 6) AS gpu_wrk_util,
           round(cpu_usage / nullif(plan_cpu, 0), 6) AS cpu_ratio, round(avg_mem / nullif(plan_mem, 0), 6) AS mem_ratio,
           round(gpu_wrk_util / nullif(plan_gpu, 0), 6) AS gpu_ratio
    FROM ({GPU_SQL['task']}) t JOIN u USING (job_name, task_name)""")
def gpu_plan_vs_actual(spark, sf):
    out = oc.plan_vs_actual(gpu(spark, sf, "task"), gpu(spark, sf, "sensor"))
    rounded = ("cpu_usage", "avg_mem", "gpu_wrk_util", "cpu_ratio", "mem_ratio", "gpu_ratio")
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query("gpu_workloads", "A9", f"""
    SELECT workload, count(*) AS "count" FROM ({GPU_SQL['group_tag']})
    WHERE workload IS NOT NULL AND workload <> '' GROUP BY workload""")
def gpu_workloads(spark, sf):
    return oc.workload_distribution(gpu(spark, sf, "group_tag"))


@query("gpu_scheduling_latency", "A10", f"""
    SELECT j.job_name, j.start_time AS job_start, t.first_task_start, t.first_task_start - j.start_time AS latency
    FROM ({GPU_SQL['job']}) j JOIN (SELECT job_name, min(start_time) AS first_task_start
      FROM ({GPU_SQL['task']}) GROUP BY job_name) t USING (job_name)""")
def gpu_scheduling_latency(spark, sf):
    return oc.scheduling_latency(gpu(spark, sf, "job"), gpu(spark, sf, "task"))


@query("gpu_job_shape", "A11", f"""
    SELECT job_name, count(*) AS tasks, CAST(sum(inst_num) AS BIGINT) AS parallel_instances,
           round(sum(inst_num * plan_gpu / 100), 6) AS gpus_requested, round(sum(inst_num * plan_cpu / 100), 6) AS cpus_requested,
           CASE WHEN bool_or(task_name = 'ps') THEN 'parameter_server' ELSE 'all_reduce' END AS architecture
    FROM ({GPU_SQL['task']}) GROUP BY job_name""")
def gpu_job_shape(spark, sf):
    shape = oc.job_shape(gpu(spark, sf, "task"))
    return shape.withColumns({c: F.round(c, 6) for c in ("gpus_requested", "cpus_requested")})


# Pods with two labels; the namespace decides which of them names the service.
_POD = """o_orderkey AS pod_no, 'pod-' || cast(o_orderkey AS {0}) AS pod,
    CASE o_custkey % 4 WHEN 0 THEN 'test-social-network' WHEN 1 THEN 'test-hotel-reservation' WHEN 2 THEN 'astronomy-shop' ELSE 'default' END AS namespace,
    'app-' || cast(o_custkey % 10 AS {0}) AS label_app, 'kompose-' || cast(o_custkey % 10 AS {0}) AS label_kompose,
    'name-' || cast(o_custkey % 10 AS {0}) AS label_name, 'wrk2-job' AS label_job"""


@query("pod_services", "J1", f"""
    SELECT pod, namespace, CASE namespace WHEN 'test-social-network' THEN label_app WHEN 'test-hotel-reservation' THEN label_kompose
           WHEN 'astronomy-shop' THEN label_name ELSE label_job END AS service FROM (SELECT {_POD.format("VARCHAR")} FROM orders)""")
def pod_services(spark, sf):
    pods = table(spark, sf, "orders").selectExpr(*exprs(_POD.format("string")))
    labels = F.create_map(
        F.lit("app"), "label_app", F.lit("io.kompose.service"), "label_kompose",
        F.lit("app.kubernetes.io/name"), "label_name", F.lit("job-name"), "label_job",
    )
    return resolve(pods.select("pod", "namespace", labels.alias("labels")))
