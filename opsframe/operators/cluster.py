"""GPU-cluster workload trace: documented joins and summaries.

No join carries a broadcast hint: the planner broadcasts a side only below its size limit and
otherwise shuffles, splitting skewed keys at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAMETER_SERVER = "ps"


def job_details(
    job: DataFrame, task: DataFrame, instance: DataFrame, status: str | None = "Terminated"
) -> DataFrame:
    """Jobs of a status with their tasks and instances."""
    jobs = job.filter(F.col("status") == status) if status else job
    return (
        jobs.select("job_name", "user", F.col("status").alias("job_status"))
        .join(task.select("job_name", "task_name", "plan_cpu", "plan_gpu", "gpu_type"), "job_name")
        .join(
            instance.select("job_name", "task_name", "inst_name", "machine"),
            ["job_name", "task_name"],
        )
    )


def usage_beside_capacity(
    sensor: DataFrame, instance: DataFrame, machine_spec: DataFrame
) -> DataFrame:
    used = sensor.select(
        "worker_name", "cpu_usage", "gpu_wrk_util", "avg_mem", "max_mem", "avg_gpu_wrk_mem"
    )
    return (
        used.join(instance.select("worker_name", "machine"), "worker_name")
        .join(machine_spec.select("machine", "cap_cpu", "cap_mem", "cap_gpu"), "machine")
        .drop("machine")
    )


def instance_machine_load(instance: DataFrame, machine_metric: DataFrame) -> DataFrame:
    """Instances with the load of their machine over their life."""
    metric = machine_metric.select(
        "worker_name", "machine", "machine_cpu", "machine_gpu", "machine_load_1", "machine_num_worker"
    )
    return instance.select("job_name", "task_name", "inst_name", "worker_name", "machine").join(
        metric, ["worker_name", "machine"]
    )


def job_tags(job: DataFrame, group_tag: DataFrame) -> DataFrame:
    """Jobs with their semantic tags."""
    tags = group_tag.select("inst_id", "gpu_type_spec", "group", "workload")
    return job.select("job_name", "inst_id", "user", "status").join(tags, "inst_id")


def plan_vs_actual(task: DataFrame, sensor: DataFrame) -> DataFrame:
    """Requested and used resources per task; ratios are NULL where nothing was requested.

    Sensor rows are averaged per task before the join, so the join is one to one.
    """
    used = sensor.groupBy("job_name", "task_name").agg(
        F.avg("cpu_usage").alias("cpu_usage"),
        F.avg("avg_mem").alias("avg_mem"),
        F.max("max_mem").alias("max_mem"),
        F.avg("gpu_wrk_util").alias("gpu_wrk_util"),
    )
    ratio = lambda used_, plan: F.try_divide(F.col(used_), F.nullif(F.col(plan), F.lit(0.0)))
    return (
        task.select("job_name", "task_name", "plan_cpu", "plan_mem", "plan_gpu")
        .join(used, ["job_name", "task_name"])
        .withColumn("cpu_ratio", ratio("cpu_usage", "plan_cpu"))
        .withColumn("mem_ratio", ratio("avg_mem", "plan_mem"))
        .withColumn("gpu_ratio", ratio("gpu_wrk_util", "plan_gpu"))
    )


def workload_distribution(group_tag: DataFrame, sort: bool = True) -> DataFrame:
    named = group_tag.filter(F.col("workload").isNotNull() & (F.col("workload") != ""))
    counted = named.groupBy("workload").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "workload") if sort else counted


def scheduling_latency(job: DataFrame, task: DataFrame) -> DataFrame:
    """Earliest task start minus job start."""
    started = task.groupBy("job_name").agg(F.min("start_time").alias("first_task_start"))
    return (
        job.select("job_name", F.col("start_time").alias("job_start"))
        .join(started, "job_name")
        .withColumn("latency", F.col("first_task_start") - F.col("job_start"))
    )


def job_shape(task: DataFrame) -> DataFrame:
    """Tasks, instances and GPUs per job, and its architecture: a ``ps`` task or none.

    Tasks of a job run together, so the parallel instances are the sum over its tasks.
    """
    server = F.bool_or(F.col("task_name") == PARAMETER_SERVER)
    return task.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("inst_num").cast("long").alias("parallel_instances"),
        F.sum(F.col("inst_num") * F.col("plan_gpu") / 100).alias("gpus_requested"),
        F.sum(F.col("inst_num") * F.col("plan_cpu") / 100).alias("cpus_requested"),
        F.when(server, "parameter_server").otherwise("all_reduce").alias("architecture"),
    )
