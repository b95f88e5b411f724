"""Recovery checks over snapshot tables of container statuses, services and deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRASH_LOOP = "CrashLoopBackOff"
# Waiting reasons that count as an error in the command check.
BAD_WAITING = (CRASH_LOOP, "Error", "ImagePullBackOff", "ErrImagePull")

EXPECTED_PORT = 9090
EXPECTED_REPLICAS = 1
EXPECTED_COMMAND = "profile"

# Fault -> check made beside the health of the namespace. Faults not listed need
# health only.
MITIGATION_RULES = (
    ("k8s_target_port-misconfig", "port"),
    ("scale_pod_zero_social_net", "replicas"),
    ("assign_to_non_existent_node_social_net", "pod_exists"),
    ("wrong_bin_usage", "command"),
    ("misconfig_app_hotel_res", "readiness"),
)


def _done_badly() -> Column:
    return F.col("terminated_reason").isNotNull() & (F.col("terminated_reason") != "Completed")


def container_ok() -> Column:
    """Tested in this order: crash loop, bad end, readiness."""
    return (
        F.when(F.coalesce(F.col("waiting_reason") == CRASH_LOOP, F.lit(False)), False)
        .when(_done_badly(), False)
        .otherwise(F.coalesce("ready", F.lit(False)))
    )


def container_ok_lenient() -> Column:
    """A waiting container is bad only for the listed reasons, whatever its readiness."""
    return (
        F.when(F.col("waiting_reason").isNotNull(), ~F.col("waiting_reason").isin(*BAD_WAITING))
        .when(_done_badly(), False)
        .otherwise(F.coalesce("ready", F.lit(False)))
    )


def namespace_health(statuses: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """Per namespace: is every container fine. Namespaces without rows are healthy."""
    checked = statuses.groupBy("namespace").agg(
        F.bool_and(container_ok()).alias("healthy"),
        F.bool_and(container_ok_lenient()).alias("healthy_lenient"),
    )
    if namespaces is None:
        return checked
    return namespaces.select("namespace").distinct().join(checked, "namespace", "left").select(
        "namespace",
        F.coalesce("healthy", F.lit(True)).alias("healthy"),
        F.coalesce("healthy_lenient", F.lit(True)).alias("healthy_lenient"),
    )


def readiness(
    statuses: DataFrame, pods: DataFrame, namespaces: DataFrame | None = None
) -> DataFrame:
    """Per namespace: at least one pod, and every pod has statuses, all of them ready."""
    per_pod = statuses.groupBy("namespace", "pod").agg(
        F.bool_and(F.coalesce("ready", F.lit(False))).alias("_ready")
    )
    checked = (
        pods.select("namespace", "pod").distinct().join(per_pod, ["namespace", "pod"], "left")
        .groupBy("namespace")
        .agg(F.bool_and(F.coalesce("_ready", F.lit(False))).alias("all_ready"))
    )
    if namespaces is None:
        return checked
    return namespaces.select("namespace").distinct().join(checked, "namespace", "left").select(
        "namespace", F.coalesce("all_ready", F.lit(False)).alias("all_ready")
    )


#: Letters of the pieces by which names are looked up in longer ones.
GRAM = 4


def ports_ok(services: DataFrame) -> DataFrame:
    """Per (namespace, service): does its first port lead to the expected one."""
    return services.groupBy("namespace", "service").agg(
        F.coalesce(F.min_by("target_port", "position") == EXPECTED_PORT, F.lit(False)).alias("port_ok")
    )


def replicas_ok(deployments: DataFrame) -> DataFrame:
    """Per (namespace, deployment): one replica wanted and one available."""
    right = (F.col("desired") == EXPECTED_REPLICAS) & (F.col("available") == EXPECTED_REPLICAS)
    return deployments.groupBy("namespace", F.col("deployment").alias("service")).agg(
        F.bool_and(F.coalesce(right, F.lit(False))).alias("replicas_ok")
    )


def services_with_pod(pods: DataFrame, services: list[str]) -> DataFrame:
    """(namespace, service) pairs for which some pod name contains the service.

    ``services`` is the short list of components of the catalogue, so each pod names its matches
    itself and no pod is compared with another table.
    """
    named = F.filter(F.array(*[F.lit(s) for s in services]), lambda s: F.col("pod").contains(s))
    return pods.select("namespace", F.explode(named).alias("service")).distinct().withColumn(
        "pod_exists", F.lit(True)
    )


def services_named_in(pods: DataFrame, services: DataFrame) -> DataFrame:
    """``services_with_pod`` for services given as a table of any size (column ``service``).

    A name that a pod contains has all its grams in the pod's name, so each service is looked up by
    its rarest gram of at most ``GRAM`` letters and each pod by all of its own; what meets is compared
    in full. An equi-join, with no pair of a pod and a service that have no gram in common. A pod name is
    looked up once, in however many namespaces it occurs.
    """
    names = services.select("service").filter("service IS NOT NULL").distinct()

    def grams(text: Column, size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - size + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, size)))

    size = F.least(F.char_length("service"), F.lit(GRAM))
    parts = names.select("service", F.explode(grams(F.col("service"), size)).alias("gram"))
    often = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keyed = parts.join(often, "gram").groupBy("service").agg(F.min(F.struct("n", "gram")).alias("key"))
    keyed = keyed.select("service", F.col("key.gram").alias("gram"))
    own = [grams(F.col("pod"), F.lit(n)) for n in range(GRAM + 1)]
    looked = pods.select("pod").distinct().withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(*own)))))
    met = looked.join(keyed, "gram").filter(F.col("pod").contains(F.col("service"))).select("pod", "service")
    placed = pods.select("namespace", "pod").distinct().join(met, "pod")
    return placed.select("namespace", "service").distinct().withColumn("pod_exists", F.lit(True))


def commands_ok(containers: DataFrame) -> DataFrame:
    """Per (namespace, deployment): the binary is in every container's command."""
    listed = F.coalesce(F.array_contains("command", EXPECTED_COMMAND), F.lit(False))
    return containers.groupBy("namespace", F.col("deployment").alias("service")).agg(
        F.bool_and(listed).alias("command_ok")
    )


def mitigation_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(MITIGATION_RULES), "fault STRING, rule STRING")


def score_mitigation(
    cases: DataFrame,
    health: DataFrame,
    ready: DataFrame,
    ports: DataFrame,
    replicas: DataFrame,
    existing: DataFrame,
    commands: DataFrame,
) -> DataFrame:
    """``cases(case_id, namespace, fault, service)`` with ``rule`` and ``success``.

    The other inputs are the per-namespace and per-service results above; all joins are equi-joins
    on those pre-aggregated tables.
    """
    spark = cases.sparkSession
    at = ["namespace", "service"]
    no = lambda column: F.coalesce(column, F.lit(False))
    joined = (
        cases.join(F.broadcast(mitigation_rules(spark)), "fault", "left")
        .join(health, "namespace", "left")
        .join(ready, "namespace", "left")
        .join(ports, at, "left")
        .join(replicas, at, "left")
        .join(existing, at, "left")
        .join(commands, at, "left")
    )
    healthy = F.coalesce("healthy", F.lit(True))
    lenient = F.coalesce("healthy_lenient", F.lit(True))
    rule = F.coalesce("rule", F.lit("health"))
    success = (
        F.when(rule == "port", no(F.col("port_ok")) & healthy)
        .when(rule == "replicas", no(F.col("replicas_ok")) & healthy)
        .when(rule == "pod_exists", no(F.col("pod_exists")) & healthy)
        .when(rule == "command", no(F.col("command_ok")) & lenient)
        .when(rule == "readiness", no(F.col("all_ready")))
        .otherwise(healthy)
    )
    return joined.select(
        "case_id", "namespace", "fault", "service", rule.alias("rule"), success.alias("success")
    )
