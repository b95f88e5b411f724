"""Pods to services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Namespace -> label that carries the service name.
SERVICE_LABELS = (
    ("test-social-network", "app"),
    ("test-hotel-reservation", "io.kompose.service"),
    ("astronomy-shop", "app.kubernetes.io/name"),
    ("default", "job-name"),
)


def pod_services(pods: DataFrame) -> DataFrame:
    """``(pod, namespace, service)`` of the pods whose namespace and label are known.

    The label table is a literal of four rows.
    """
    labels = pods.sparkSession.createDataFrame(list(SERVICE_LABELS), "namespace STRING, label STRING")
    named = pods.join(F.broadcast(labels), "namespace").withColumn(
        "service", F.try_element_at("labels", F.col("label"))
    )
    return named.filter(F.col("service").isNotNull()).select("pod", "namespace", "service")
