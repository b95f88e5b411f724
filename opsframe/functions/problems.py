"""Problem ids and the ground-truth catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = ("detection", "localization", "analysis", "mitigation")

_ALL = "detection localization analysis mitigation"
_FIND = "detection localization"

# Fault, tasks, application, ground truth per variant. A fault with several variants
# lists one component each, numbered from 1. "-" stands for no value.
_FAULTS = (
    ("k8s_target_port-misconfig", _ALL, "social_network", ("user-service", "text-service", "post-storage-service"), "Virtualization", "Misconfiguration"),
    ("auth_miss_mongodb", _ALL, "social_network", ("url-shorten-mongodb",), "Application", "Misconfiguration"),
    ("revoke_auth_mongodb", _ALL, "hotel_reservation", ("mongodb-geo", "mongodb-rate"), "Application", "Authentication Issue"),
    ("user_unregistered_mongodb", _ALL, "hotel_reservation", ("mongodb-geo", "mongodb-rate"), "Application", "Network/Storage Issue"),
    ("misconfig_app_hotel_res", _ALL, "hotel_reservation", ("geo",), "Application", "Misconfiguration"),
    ("scale_pod_zero_social_net", _ALL, "social_network", ("user-service",), "Virtualization", "Operation Error"),
    ("assign_to_non_existent_node_social_net", _ALL, "social_network", ("user-service",), "Virtualization", "Dependency Problem"),
    ("container_kill", _FIND, "hotel_reservation", ("geo",), "-", "-"),
    ("pod_failure_hotel_res", _FIND, "hotel_reservation", ("user",), "-", "-"),
    ("pod_kill_hotel_res", _FIND, "hotel_reservation", ("user",), "-", "-"),
    ("network_loss_hotel_res", _FIND, "hotel_reservation", ("user",), "-", "-"),
    ("network_delay_hotel_res", _FIND, "hotel_reservation", ("user",), "-", "-"),
    ("astronomy_shop_ad_service_failure", _FIND, "astronomy_shop", ("ad",), "-", "-"),
    ("astronomy_shop_ad_service_high_cpu", _FIND, "astronomy_shop", ("ad",), "-", "-"),
    ("astronomy_shop_ad_service_manual_gc", _FIND, "astronomy_shop", ("ad",), "-", "-"),
    ("astronomy_shop_cart_service_failure", _FIND, "astronomy_shop", ("cart",), "-", "-"),
    ("astronomy_shop_image_slow_load", _FIND, "astronomy_shop", ("frontend",), "-", "-"),
    ("astronomy_shop_kafka_queue_problems", _FIND + " mitigation", "astronomy_shop", ("kafka",), "-", "-"),
    ("astronomy_shop_loadgenerator_flood_homepage", _FIND, "astronomy_shop", ("frontend",), "-", "-"),
    ("astronomy_shop_payment_service_failure", _FIND, "astronomy_shop", ("payment",), "-", "-"),
    ("astronomy_shop_payment_service_unreachable", _FIND, "astronomy_shop", ("checkout",), "-", "-"),
    ("astronomy_shop_product_catalog_service_failure", _FIND, "astronomy_shop", ("product-catalog",), "-", "-"),
    ("astronomy_shop_recommendation_service_cache_failure", _FIND, "astronomy_shop", ("recommendation",), "-", "-"),
    ("redeploy_without_PV", "detection analysis mitigation", "hotel_reservation", ("-",), "Virtualization", "Operation Error"),
    ("wrong_bin_usage", _ALL, "hotel_reservation", ("profile",), "Application", "Network/Storage Issue"),
    ("flower_node_stop", "detection", "flower", ("supernode-1",), "-", "-"),
    ("flower_model_misconfig", "detection", "flower", ("clientapp-1",), "-", "-"),
)

# These ids carry no variant number.
_UNNUMBERED = ("container_kill", "flower_node_stop", "flower_model_misconfig")

# Applications of the false-positive problems.
_QUIET_APPS = ("hotel_reservation", "social_network", "astronomy_shop")

CATALOGUE_SCHEMA = (
    "problem_id STRING, fault STRING, task STRING, idx INT, app STRING, deployment STRING, "
    "expected STRING, component STRING, system_level STRING, fault_type STRING"
)


def catalogue_rows() -> list[tuple]:
    rows = []
    blank = lambda text: None if text == "-" else text
    for fault, tasks, app, components, level, kind in _FAULTS:
        for n, component in enumerate(components, start=1):
            for task in tasks.split():
                numbered = fault not in _UNNUMBERED
                rows.append((
                    f"{fault}-{task}-{n}" if numbered else f"{fault}-{task}",
                    fault, task, n if numbered else None, app,
                    "docker" if app == "flower" else "k8s",
                    "Yes", blank(component), blank(level), blank(kind),
                ))
    for app in _QUIET_APPS:
        rows.append((
            f"noop_detection_{app}-1", "noop", "detection", 1, app, "k8s", "No", None, None, None,
        ))
    return rows


def problem_catalogue(spark: SparkSession) -> DataFrame:
    """Literal dimension of fixed size (one row per problem id)."""
    return spark.createDataFrame(catalogue_rows(), CATALOGUE_SCHEMA)


def problem_task(problem_id: Column) -> Column:
    """Task named anywhere in the id; NULL when none is."""
    task = F.lit(None).cast("string")
    for name in reversed(TASKS):
        task = F.when(problem_id.contains(name), name).otherwise(task)
    return task


def problem_index(problem_id: Column) -> Column:
    return F.nullif(F.regexp_extract(problem_id, r"-(\d+)$", 1), F.lit("")).cast("int")


def problem_fault(problem_id: Column) -> Column:
    """Text before the task name."""
    return F.regexp_extract(problem_id, r"^(.*?)[-_](?:" + "|".join(TASKS) + r")", 1)


def problem_parts(problem_id: Column) -> Column:
    return F.struct(
        problem_fault(problem_id).alias("fault"),
        problem_task(problem_id).alias("task"),
        problem_index(problem_id).alias("idx"),
    )
