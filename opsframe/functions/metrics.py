"""Metric names, ids and rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exported container metrics.
CONTAINER_METRICS = (
    "container_cpu_usage_seconds_total",
    "container_cpu_user_seconds_total",
    "container_cpu_system_seconds_total",
    "container_cpu_cfs_throttled_seconds_total",
    "container_cpu_cfs_throttled_periods_total",
    "container_cpu_cfs_periods_total",
    "container_cpu_load_average_10s",
    "container_memory_cache",
    "container_memory_usage_bytes",
    "container_memory_working_set_bytes",
    "container_memory_rss",
    "container_memory_mapped_file",
    "container_spec_cpu_period",
    "container_spec_cpu_quota",
    "container_spec_memory_limit_bytes",
    "container_spec_cpu_shares",
    "container_threads",
    "container_threads_max",
    "container_network_receive_errors_total",
    "container_network_receive_packets_dropped_total",
    "container_network_receive_packets_total",
    "container_network_receive_bytes_total",
    "container_network_transmit_bytes_total",
    "container_network_transmit_errors_total",
    "container_network_transmit_packets_dropped_total",
    "container_network_transmit_packets_total",
)

# The network counters among them.
NETWORK_METRICS = tuple(m for m in CONTAINER_METRICS if m.startswith("container_network_"))

# Service-mesh metrics.
MESH_METRICS = (
    "istio_requests_total",
    "istio_request_duration_milliseconds_sum",
    "istio_request_bytes_sum",
    "istio_response_bytes_sum",
    "istio_request_messages_total",
    "istio_response_messages_total",
    "istio_tcp_sent_bytes_total",
    "istio_tcp_received_bytes_total",
    "istio_tcp_connections_opened_total",
    "istio_tcp_connections_closed_total",
)

# Rated like counters although the name does not end in _total.
RATED_BY_NAME = (
    "container_last_seen",
    "container_memory_cache",
    "container_memory_max_usage_bytes",
)

# Pods that are never part of an inventory.
EXCLUDED_POD_PREFIXES = ("loadgenerator-", "redis-cart")

RATED_INTERFACE = "eth0"


def is_excluded_pod(pod: Column, prefixes: tuple[str, ...] = EXCLUDED_POD_PREFIXES) -> Column:
    return reduce(lambda a, b: a | b, [pod.startswith(p) for p in prefixes])


def metric_family(name: Column) -> Column:
    """``network`` counter, other ``counter`` or ``gauge``."""
    rated = name.endswith("_total") | name.isin(*RATED_BY_NAME)
    return (
        F.when(rated & name.isin(*NETWORK_METRICS), "network")
        .when(rated, "counter")
        .otherwise("gauge")
    )


def kpi_name(name: Column, interface: Column) -> Column:
    """Network metrics carry their interface when the label is present."""
    return F.when(
        name.isin(*NETWORK_METRICS) & interface.isNotNull(), F.concat_ws(".", name, interface)
    ).otherwise(name)


def cmdb_id(instance: Column, pod: Column) -> Column:
    return F.concat(instance, F.lit("."), pod)


def mesh_id(pod: Column, source: Column, destination: Column) -> Column:
    """``pod.side.source.destination``; side says which end of the call the pod is."""
    side = F.when(F.split_part(pod, F.lit("-"), F.lit(1)) == source, "source").otherwise("destination")
    return F.concat_ws(".", pod, side, source, destination)


def mesh_known(source: Column, destination: Column, services: list[str]) -> Column:
    """False when an end is not a known service, unless the source is ``unknown``."""
    return (source == "unknown") | (source.isin(*services) & destination.isin(*services))


def mesh_kpi(
    name: Column, protocol: Column, response_code: Column, grpc_status: Column, flags: Column
) -> Column:
    """TCP series are told apart by flags, others by protocol and both response codes."""
    blank = F.lit("")
    coded = F.concat_ws(
        ".", name, protocol, F.coalesce(response_code, blank), F.coalesce(grpc_status, blank)
    )
    return (
        F.when(protocol.isNull(), name)
        .when(protocol == "tcp", F.concat_ws(".", name, flags))
        .otherwise(coded)
    )


def round3(value: Column) -> Column:
    return F.round(value, 3)
